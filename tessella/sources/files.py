"""Files as DataFrames: PDF folders, layout JSON, JSON lines and configuration."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import casefold
from tessella.operators.recovery import top_left

LOW_TEXT = 80


def pdf_registry(spark: SparkSession, path: str, namespace: str = "doc") -> DataFrame:
    """One row per *.pdf of a folder (not below it), by case-folded name: doc_id from the content's hash, title and version from the name,
    and the size. An empty folder is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.pdf$", "")
    digest = F.sha2("content", 256)
    rows = files.select(F.concat(F.lit(namespace + ":"), F.substring(digest, 1, 24)).alias("doc_id"), F.replace(stem, F.lit("_"), F.lit(" ")).alias("title"), name.alias("source_filename"), digest.alias("source_sha256"), F.col("length").alias("bytes"), stem.alias("document_version"))
    if rows.isEmpty():
        raise ValueError(f"no PDF in {path}")
    return rows.orderBy(casefold(F.col("source_filename")), "source_filename")


def pdf_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(source_filename, page_index, chars, low_text) by a given extractor of page texts, which runs where the file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_filename"), "content")

    def pages(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(n, i, len(t.strip())) for n, c in zip(pdf["source_filename"], pdf["content"], strict=True) for i, t in enumerate(extract(bytes(c)))]
            yield pd.DataFrame(rows, columns=["source_filename", "page_index", "chars"])

    return files.mapInPandas(pages, "source_filename string, page_index int, chars int").withColumn("low_text", F.col("chars") < LOW_TEXT)


def layout_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, self_ref, place, position, collection, item) of layout JSON files: every object with a self_ref, on its own or in a list. item is its
    JSON text, place and position where it stands in the file. Of a repeated self_ref the last one of the file counts."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"), F.json_object_keys("value").alias("_keys"))
    top = raw.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer())).select("file", F.col("key").alias("collection"), F.array_position("_keys", F.col("key")).alias("place"), F.col("value").alias("_x"))
    kind = F.schema_of_variant("_x")
    lists = top.filter(kind.startswith("ARRAY")).select("file", "collection", "place", F.posexplode(F.try_variant_get("_x", "$", "array<variant>")).alias("position", "_i"))
    single = top.filter(kind.startswith("OBJECT")).select("file", "collection", "place", F.lit(0).alias("position"), F.col("_x").alias("_i"))
    every = lists.unionByName(single).select("file", "collection", "place", "position", F.try_variant_get("_i", "$.self_ref", "string").alias("self_ref"), F.to_json("_i").alias("item")).filter("self_ref is not null")
    return every.groupBy("file", "self_ref").agg(F.max(F.struct("place", "position", "collection", "item")).alias("_l")).select("file", "self_ref", "_l.*")


# Fields of a layout item that are read.
_REF = "array<struct<`$ref`:string,cref:string>>"
ITEM = f"label string, text string, level int, content_layer string, children {_REF}, captions {_REF}, prov array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>, data struct<table_cells:array<struct<start_row_offset_idx:int,start_col_offset_idx:int,text:string>>>"
#: The parent of an item that nothing links; no reference is spelt so.
UNLINKED = "#unlinked"


def flat_layout(layout: DataFrame, documents: DataFrame, heights: DataFrame | None = None) -> dict[str, DataFrame]:
    """items and table_cells as build_corpus takes them, and warnings (doc_id, warning), of layout_items().

    documents: doc_id, file; files of no document are left out. heights: doc_id, page_index, height, by which boxes that are measured from
    the bottom are turned; without them these have no box. Body and furniture are the roots; an item's place is that among its parent's children,
    or behind them among its captions; of several parents the first that is stated counts. An item that nothing links comes last and is marked as
    of unknown order by build_corpus. An item without a label has the name of its collection.
    """
    read = layout.join(documents.select("doc_id", "file"), "file").select("doc_id", F.col("self_ref").alias("ref"), "collection", "place", "position", F.from_json("item", ITEM).alias("i"))
    refs = lambda c, kind: F.transform(F.coalesce(c, F.array().cast(_REF)), lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.coalesce(x["$ref"], x["cref"], F.lit("")).alias("child")))
    links = read.select("doc_id", F.col("ref").alias("parent_ref"), "place", "position", F.explode(F.concat(refs(F.col("i.children"), 0), refs(F.col("i.captions"), 1))).alias("l")).select("doc_id", "parent_ref", "place", "position", "l.*")
    of = links.groupBy("doc_id", F.col("child").alias("ref")).agg(F.min(F.struct("place", "position", "kind", "k", "parent_ref")).alias("_l"))
    root = F.coalesce(F.col("collection").isin("body", "furniture"), F.lit(False))
    j = read.join(of, ["doc_id", "ref"], "left").withColumn("_root", root)
    unlinked = F.col("_l").isNull() & ~F.col("_root")
    grouping = F.col("collection").isin("body", "furniture", "groups")
    parent = F.when(F.col("_root"), F.lit(None)).otherwise(F.coalesce("_l.parent_ref", F.lit(UNLINKED)))
    order = F.when(F.col("_root"), F.when(F.col("collection") == "body", 0).otherwise(1)).when(unlinked, F.col("place") * 1_000_000_000 + F.col("position")).otherwise(F.col("_l.kind") * 1_000_000_000 + F.col("_l.k")).cast("bigint")
    label = F.when(F.col("collection").isin("body", "furniture"), F.col("collection")).when(F.col("collection") == "groups", "group").otherwise(F.coalesce("i.label", "collection"))
    box = F.get(F.col("i.prov"), F.lit(0))["bbox"]
    placed = j.withColumn("page_index", F.get(F.col("i.prov"), F.lit(0))["page_no"] - 1)
    placed = placed.join(heights.select("doc_id", "page_index", "height"), ["doc_id", "page_index"], "left") if heights is not None else placed.withColumn("height", F.lit(None).cast("double"))
    turned = top_left(box["l"], box["t"], box["r"], box["b"], box["coord_origin"], F.col("height"))
    items = placed.select("doc_id", order.alias("ordinal"), "ref", parent.alias("parent_ref"), label.alias("label"), "i.level", F.coalesce("i.text", F.lit("")).alias("text"), "page_index", F.coalesce(F.col("i.content_layer"), F.when(F.col("_root"), F.col("collection"))).alias("layer"), F.when(F.size("i.captions") > 0, F.transform("i.captions", lambda x: F.coalesce(x["$ref"], x["cref"]))).alias("caption_refs"), F.when(turned["t"].isNotNull() & turned["b"].isNotNull(), turned).alias("item_box"))
    cells = read.filter("i.label = 'table'").select("doc_id", "ref", F.posexplode("i.data.table_cells").alias("cell_index", "c")).select("doc_id", "ref", "cell_index", F.col("c.start_row_offset_idx").alias("row"), F.col("c.start_col_offset_idx").alias("col"), "c.text")
    lost = links.join(read.select("doc_id", F.col("ref").alias("child")), ["doc_id", "child"], "left_anti").select("doc_id", F.concat(F.lit("unresolved_reference:"), "child").alias("warning"))
    alone = j.filter(unlinked & ~F.coalesce(grouping, F.lit(False))).select("doc_id", F.concat(F.lit("unlinked_item_appended_unknown_reading_order:"), "ref").alias("warning"))
    return {"items": items, "table_cells": cells, "warnings": lost.unionByName(alone).distinct()}


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines in UTF-8; blank lines are passed over."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("_j")).select("_j.*") if schema else lines.select(F.try_parse_json("value").alias("record"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Nulls are written, and characters beyond ASCII stay as they are."""
    df.write.option("ignoreNullFields", "false").json(path)


# Parts of key names that point to a secret.
SECRET = ("api_key", "apikey", "password", "secret", "token", "credential")


def load_config(path: str) -> dict[str, Any]:
    """A TOML or JSON configuration. Keys that look like secrets are refused at any depth, but for those that name an environment
    variable (…_env); chunking.max_tokens defaults to 384 and may not exceed 512."""
    with open(path, "rb") as f:
        data = tomllib.load(f) if path.endswith(".toml") else json.load(f)

    def check(x: Any) -> None:
        for k, v in x.items() if isinstance(x, dict) else ():
            low = k.lower()
            if any(s == low or low.endswith("_" + s) for s in SECRET) and not low.endswith("_env"):
                raise ValueError(f"credentials do not belong into a configuration: {k}")
            check(v)
        for v in x if isinstance(x, list) else ():
            check(v)

    check(data)
    chunking = data.setdefault("chunking", {})
    if not 0 < chunking.setdefault("max_tokens", 384) <= 512:
        raise ValueError("chunking.max_tokens must be within 1..512")
    return data


def settings(environment: dict[str, str] | None = None) -> dict[str, Any]:
    """Settings from the environment (TESSELLA_…), with their defaults."""
    env = os.environ if environment is None else environment
    out = {"rewrite_mode": env.get("TESSELLA_REWRITE_MODE", "conditional")}
    if out["rewrite_mode"] not in ("conditional", "disabled"):
        raise ValueError("TESSELLA_REWRITE_MODE must be conditional or disabled")
    for name, default in (("retrieval_history_chars", 2400), ("answer_history_chars", 9000), ("rewrite_timeout_s", 30), ("rewrite_max_tokens", 96), ("answer_timeout_s", 120), ("answer_max_tokens", 512)):
        out[name] = int(env.get(f"TESSELLA_{name.upper()}", default))
        if out[name] < 1:
            raise ValueError(f"{name} must be positive")
    return out
