"""Queries of the llm subpackage, over the whole driver tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.common import table
from tessella.llm import filler, leaks, packing, pairs, sentences, splitting, visual

# The token of TESTDATA.md for DuckDB.
_HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAD9}\x{20000}-\x{323AF}]"
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_tokens(c: str) -> str:
    """DuckDB expression for the number of tokens of a column."""
    runs = rf"regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+')"
    return rf"(coalesce(list_sum(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '{_HAN}') THEN length(r) ELSE 1 END)), 0) + length(regexp_replace({c}, '[\p{{L}}\p{{N}}_{_SPACE}]+', '', 'g')))::BIGINT"


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "sections"), table(spark, sf_dir, "size_limits"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage is over its limit exactly if the operator makes pieces of it; its first piece stands for it."""
    return _pieces(spark, sf_dir).filter("piece = 0").select("chunk_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(sentences.block_and_unit_records(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "source_units")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs_ = pairs.history_pairs(table(spark, sf_dir, "qa_requests"), table(spark, sf_dir, "pipeline_traces"))
    return pairs.find_defects(pairs_, table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.look_pairs(visual.block_and_request_records(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "qa_requests")))


def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text of blocks and requests: its class, its copies, and how many distinct texts read the same."""
    keyed = visual.same_look(visual.block_and_request_records(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "qa_requests")))
    return visual.look_texts(keyed).select("kind", F.hex("class_key").alias("class_key"), F.hex("text_key").alias("text_key"), "copies", "texts")


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank block and request with its text in the consistent form."""
    records = visual.block_and_request_records(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "qa_requests"))
    once = records.filter("id is not null and text is not null").dropDuplicates(["kind", "id"])
    return visual.canonical(once, "text").select("kind", "id", "canonical_text")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = table(spark, sf_dir, "size_limits").filter("limit_name = 'container'").agg(F.max("max_tokens")).head()[0]
    return packing.pack(table(spark, sf_dir, "documents"), capacity)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is over the capacity exactly if the packing gives it a second piece."""
    return _packed(spark, sf_dir).filter("piece = 1").select("doc_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_places(spark, sf_dir).select("doc_id", "item_id")


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filler.find_filler(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_forms": p5_forms, "p5_texts": p5_texts, "p6_found": p6_found, "p6_containers": p6_containers, "p7_found": p7_found, "p7_places": p7_places, "p8_found": p8_found, "p8_scores": p8_scores}
SQL = {
    "p1_found": f"""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) AS k FROM chunks) WHERE k = 1),
s AS (SELECT section_id, array_to_string(path, ' > ') AS p FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY written_at DESC) AS k FROM sections) WHERE k = 1)
SELECT chunk_id FROM c LEFT JOIN s USING (section_id) WHERE {sql_tokens("c.text")} + coalesce({sql_tokens("s.p")}, 0) > max_tokens""",
    "p6_found": f"""SELECT DISTINCT doc_id FROM documents WHERE {sql_tokens("text")} > (SELECT max_tokens FROM size_limits WHERE limit_name = 'container')""",
}
