"""The two pipelines on the driver's tables. Models are stand-ins: hashed tokens as the encoder, and a generator that cites the first passage.
They hold no SQL: a bundle's passages depend on a sequential splitter, an answer on the models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import plugins
from tessella.common import latest, table
from tessella.functions import text as X
from tessella.operators import store
from tessella.plans.documents import _items
from tessella.plans.pipelines import answers, build_corpus


def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all manuals, built from their blocks as layout items."""
    docs = latest(table(spark, sf_dir, "bundle_documents"), "doc_id", "registered_at", "title", "source_filename").select("doc_id", "title", "source_filename")
    pages = latest(table(spark, sf_dir, "blocks"), "block_id", "ingested_at", "page_index", "content_layer").select(F.col("block_id").alias("ref"), "page_index", F.col("content_layer").alias("layer"))
    items = _items(spark, sf_dir).drop("doc_title").withColumn("text", F.coalesce("text", F.lit(""))).join(pages, "ref")
    chunks = build_corpus(docs, items, 384)["chunks"]
    return chunks.select("chunk_id", "doc_id", "section_id", "piece", "token_count", F.size("source_spans").alias("spans"), F.md5("text").alias("text_md5"))


def _generator(prompt: str) -> str:
    return json.dumps({"response_type": "answer", "answerable": True, "answer": "See the passage.", "citation_ids": ["C001"]})


def _answered(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Answers to every request whose number is divisible by 100, against all passages; a rewrite is the last question and the new one."""
    c = latest(table(spark, sf_dir, "chunks"), "chunk_id", "ingested_at", "doc_id", "section_id", "text", "source_spans")
    docs = latest(table(spark, sf_dir, "bundle_documents"), "doc_id", "registered_at", "title", "source_filename")
    secs = latest(table(spark, sf_dir, "sections"), "section_id", "written_at", "title", "path")
    numbered = store.dense_ordinals(c.drop("ingested_at"), "chunk_id")  # what is joined to a passage is not sorted and written down with it
    chunks = numbered.join(docs.select("doc_id", F.col("title").alias("_t"), "source_filename"), "doc_id", "left").join(secs.select("section_id", "path"), "section_id", "left").withColumn("retrieval_text", X.retrieval_text(F.col("_t"), F.col("source_filename"), F.col("path"), F.col("text")))
    vectors = plugins.encode(chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")), "text", plugins.hashing_encoder(), limit=100_000).select("chunk_id", "vector")
    item = F.transform("context", lambda x: F.struct(x["q"].alias("Q"), F.when(F.trim(F.coalesce(x["a"], F.lit(""))) == "", "-").otherwise(x["a"]).alias("A")))
    asked = latest(table(spark, sf_dir, "qa_requests"), "request_id", "received_at", "conversation_id", "context", "question").withColumn("number", F.regexp_extract("request_id", "([0-9]+)$", 1).try_cast("bigint")).filter("number % 100 = 0")
    body = F.to_json(F.struct("conversation_id", F.coalesce(item, F.array().cast("array<struct<Q:string,A:string>>")).alias("context"), "question"), {"ignoreNullFields": "false"})
    return answers(asked.select(F.col("number").alias("request_id"), body.alias("body")), {"chunks": chunks, "vectors": vectors, "documents": docs, "sections": secs}, plugins.hashing_encoder(), _generator, lambda q, h: f"{h.splitlines()[0]} {q}"[:2000] if h else None)


def qa_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _answered(spark, sf_dir)["responses"]
    return out.select("request_id", "conversation_id", "status", "response_type", "answer", F.size("sources").alias("sources"), F.get(F.col("sources"), F.lit(0))["document"].alias("document"))


def qa_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _answered(spark, sf_dir)["traces"]
    return t.select("request_id", "rewrite_triggered", "rewrite_succeeded", "rewrite_query", "rewrite_calls", "answer_calls", "retrieved_documents", F.transform("retrieved_chunks", lambda c: c["chunk_id"]).alias("retrieved_chunks"), "response_type", "answerable", "final_k")


QUERIES = {"corpus_build": corpus_build, "qa_batch": qa_batch, "qa_trace": qa_trace}
SQL: dict[str, str] = {}
