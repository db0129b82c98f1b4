"""Registered queries over tables in which every title, passage and question holds a dash, as the driver's do: the pairs that share it are not shuffled."""

import pytest

import __spark_entry__

PAIRS = 250_000


def shuffled(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("dashes"))
    spark.range(1, 5001).selectExpr("id as doc_id", "concat('Start - a', id % 50) as text", "concat('Note - b', id) as title", "'f.md' as source_filename", "'en' as lang").write.parquet(f"{d}/documents.parquet")
    spark.range(100, 150).selectExpr("id as vec_id", "array(1.0f, float(id)) as embedding", "'x' as label").write.parquet(f"{d}/embeddings.parquet")
    now = "timestamp'2026-01-01'"
    spark.range(2500).selectExpr("concat('c', id) as chunk_id", "'d' as doc_id", "'s' as section_id", "concat('Start - a', id % 50) as text", "cast(array() as array<struct<block_id:string,page_index:int,source_start_char:int,source_end_char:int,chunk_start_char:int,chunk_end_char:int>>) as source_spans", f"{now} as ingested_at").write.parquet(f"{d}/chunks.parquet")
    spark.sql(f"select 'd' as doc_id, 'Note' as title, 'f.pdf' as source_filename, {now} as registered_at").write.parquet(f"{d}/bundle_documents.parquet")
    spark.sql(f"select 's' as section_id, 'Part' as title, array('Part') as path, {now} as written_at").write.parquet(f"{d}/sections.parquet")
    spark.range(1, 101).selectExpr("concat('req_', id * 100) as request_id", "id as conversation_id", "cast(array() as array<struct<q:string,a:string>>) as context", "concat('Start - b', id, '?') as question", f"{now} as received_at").write.parquet(f"{d}/qa_requests.parquet")
    return d


@pytest.mark.parametrize(("name", "rows"), [("ablation_topk", 1000), ("rrf_two_way", 250), ("cited_sources", 150), ("hybrid_search_rewrite", 250), ("qa_batch", 100), ("rrf_four_way", 250)])
def test_pairs_that_share_a_term_are_not_shuffled(spark, tables, name, rows):
    before = shuffled(spark)
    assert len(__spark_entry__.queries()[name](spark, tables).collect()) == rows
    assert shuffled(spark) - before < 0.6 * PAIRS
