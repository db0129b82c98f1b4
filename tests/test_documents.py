import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import chunking as C
from tessella.operators import recovery as R
from tessella.operators import structure as S
from tessella.plans import corpus as plans_corpus
from tessella.plans import documents as plans_documents


def test_sections_from_headings(spark):
    rows = [(0, "heading", 1, "A"), (1, "text", None, "x"), (2, "heading", 3, "B (1/2)"), (3, "heading", 3, "b (2/2)"), (4, "text", None, "y"), (5, "heading", 2, "C"), (6, "heading", None, "D"), (7, "heading", 3, "B (2/2)")]
    items = spark.createDataFrame([("d", "Doc", o, f"r{o}", k, lv, t) for o, k, lv, t in rows] + [("e", None, 0, "e0", "text", None, None)], "doc_id string, doc_title string, ordinal bigint, ref string, label string, level int, text string")
    got = {r["ref"]: r for r in S.section_scan(items).collect()}
    assert {k: r["section_ref"] for k, r in got.items()} == {"r0": "r0", "r1": "r0", "r2": "r2", "r3": "r2", "r4": "r2", "r5": "r5", "r6": "r6", "r7": "r7", "e0": "e"}
    assert got["r2"]["path"] == ["Doc", "A", "B"] and got["r5"]["parent_ref"] == "r0" and got["r6"]["parent_ref"] == "d" and not got["r3"]["is_section"]
    heads = items.filter("label = 'heading'").withColumn("level", F.coalesce("level", F.lit(1)))
    assert [r["ref"] for r in S.continuations(heads).filter("goes_on").collect()] == ["r3"]


def test_section_scan_against_a_stack(spark):
    rng = random.Random(5)
    rows = [(f"d{d}", None, i, f"{d}-{i}", rng.choice(["heading", "text"]), rng.randrange(1, 5), "t") for d in range(4) for i in range(40)]
    got = {r["ref"]: r["section_ref"] for r in S.section_scan(spark.createDataFrame(rows, "doc_id string, doc_title string, ordinal bigint, ref string, label string, level int, text string")).collect()}
    last = {}
    for d, _, _, ref, label, _, _ in rows:
        last[d] = ref if label == "heading" else last.get(d, d)
        assert got[ref] == last[d]


def test_table_rows(spark):
    cells = spark.createDataFrame([("t", 0, 0, 1, "b"), ("t", 1, 0, 0, "aa"), ("t", 2, 1, 0, None), ("t", 3, 0, 1, "c")], "table_ref string, cell_index int, row int, col int, text string")
    got = {r["row_index"]: r for r in S.table_rows(cells).collect()}
    assert got[0]["text"] == "aa | b | c" and [tuple(x) for x in got[0]["cell_spans"]] == [(1, 0, 2), (0, 5, 6), (3, 9, 10)] and got[1]["text"] == ""


def test_audits(spark):
    blocks = spark.createDataFrame([("d", "x" * 90, 0, "text", "body"), ("d", " \n", 1, "heading", None), ("d", None, None, "page_footer", "body"), ("d", "y", 1, "text", "furniture")], "doc_id string, text string, page_index int, kind string, content_layer string")
    units = spark.createDataFrame([("d", "u"), ("e", "u")], "doc_id string, u string")
    got = {r["doc_id"]: tuple(r)[1:] for r in S.parse_audit(blocks, units).collect()}
    assert got == {"d": (4, 2, 1, 2, 1, 1), "e": (0, 0, 0, 0, 0, 1)}
    assert [tuple(r) for r in S.low_text_pages(blocks).collect()] == [("d", 2, [2])]


def gaps(spark, text, spans):
    b = spark.createDataFrame([("b", text)], "block_id string, text string")
    s = spark.createDataFrame([("b", a, e) for a, e in spans], "block_id string, start_char int, end_char int")
    return sorted((r["from_char"], r["to_char"]) for r in C.coverage_gaps(b, s).collect())


def test_coverage(spark):
    assert gaps(spark, "abcdef", [(0, 3)]) == [(3, 6)] and gaps(spark, "abcdef", [(0, 3), (3, 6)]) == [] and gaps(spark, "ab  ef", [(0, 2), (4, 6)]) == []
    assert gaps(spark, "abcdef", []) == [(0, 6)] and gaps(spark, "abcdef", [(2, 3), (1, 5)]) == [(0, 1), (5, 6)] and gaps(spark, "abc", [(0, 9)]) == []


def test_spans_and_offsets(spark):
    blocks = spark.createDataFrame([("s", "b", 1, "xyz"), ("s", "a", 0, "ab"), ("s", "c", 2, None)], "section_id string, block_id string, ordinal int, text string")
    assert {r["block_id"]: (r["start_char"], r["end_char"]) for r in C.canonical_offsets(blocks).collect()} == {"a": (0, 2), "b": (3, 6), "c": (7, 7)}
    left = spark.createDataFrame([("k", 0, 4, 1)], "k string, start_char int, end_char int, l int")
    right = spark.createDataFrame([("k", 2, 9, 7), ("k", 4, 5, 8), ("z", 0, 9, 9)], "k string, start_char int, end_char int, r int")
    assert [(r["l"], r["r"], r["start_char"], r["end_char"]) for r in C.span_intersections(left, right, "k").collect()] == [(1, 7, 2, 4)]


@pytest.mark.parametrize("budget", [1, 3, 10, 1000])
def test_budget_spans_partition_the_text(budget):
    rng = random.Random(budget)
    text = "".join(rng.choice(["word ", "重", "\n", "x.y ", "longerword"]) for _ in range(200))
    spans = C.budget_spans(text, budget)
    assert "".join(text[a:b] for a, b in spans) == text and all(C.count_tokens(text[a:b]) <= budget for a, b in spans)
    assert C.budget_spans("", budget) == []


def test_budget_chunks_refuse_a_full_path(spark):
    rows = spark.createDataFrame([("s", ["a"], "one two three four", 0), ("t", ["a b c d e f"], "x", 0), ("u", None, "x", None), ("s", ["a"], "five", 100)], "section_id string, path array<string>, text string, base bigint")
    got = sorted((r["section_id"], r["piece"], r["start_char"], r["end_char"]) for r in C.budget_chunks(rows, 5).collect())
    assert got == [("s", 0, 0, 8), ("s", 1, 8, 18), ("s", 100, 100, 104), ("t", -1, 0, 0), ("u", 0, 0, 1)]


def test_alignment():
    assert C.align_segments("a  b\n\nc d ", ["a b", "", "c  d"]) == [(0, 4), (6, 9)]
    for bad in (["a b"], ["c d", "a b"], ["a x"]):
        with pytest.raises(ValueError):
            C.align_segments("a  b\n\nc d ", bad)


def test_boxes_and_cells(spark):
    box = lambda l, t, r, b, o: R.top_left(*(F.lit(x).cast("double") for x in (l, t, r, b)), F.lit(o), F.lit(100.0))  # noqa: E731, E741
    r = spark.range(1).select(box(5, 90, 1, 80, None), box(1, 2, 5, 4, "TOPLEFT"), box(None, 2, 5, 4, "TOPLEFT")).head()
    assert tuple(r[0]) == (1, 10, 5, 20) and tuple(r[1]) == (1, 2, 5, 4) and r[2] is None
    B = "struct<l:double,t:double,r:double,b:double>"
    items = spark.createDataFrame([("d", 0, "i1", 1, "pump ", "s1", (0.0, 0.0, 10.0, 10.0)), ("d", 0, "i2", 2, "station", "s2", (10.0, 0.0, 20.0, 10.0)), ("d", 1, "i3", 3, "x", None, None)], f"doc_id string, page_index int, item_ref string, item_order int, text string, section_id string, item_box {B}")
    cells = spark.createDataFrame(
        [("d", 0, "c1", "pump", 0, (1.0, 1.0, 5.0, 5.0)), ("d", 0, "c2", "pump station", 0, (1.0, 1.0, 15.0, 5.0)), ("d", 0, "c3", "valve", 0, (1.0, 1.0, 5.0, 5.0)), ("d", 0, "c4", "***", 0, (1.0, 1.0, 5.0, 5.0)), ("d", 0, "c5", "pump", 3, (1.0, 1.0, 5.0, 5.0)), ("d", 0, "c6", "far", 0, (90.0, 90.0, 95.0, 95.0)), ("d", 1, "c7", "far", 0, None), ("d", 0, "c8", None, 0, None)],
        f"doc_id string, page_index int, cell_ref string, text string, rendering_mode int, cell_box {B}",
    )
    got = {r["cell_ref"]: (r["status"], r["section_id"]) for r in R.cell_status(cells, items).collect()}
    assert got == {"c1": ("matched", None), "c2": ("matched_across", None), "c3": ("recovered", "s1"), "c4": ("nonsemantic", None), "c5": ("invisible", None), "c6": ("recovered", "s1"), "c7": ("recovered", None), "c8": ("nonsemantic", None)}
    missing = R.missing_pages(spark.createDataFrame([("d", 3), ("e", None)], "doc_id string, page_count int"), items)
    report = R.recovery_report(R.cell_status(cells, items), missing).collect()
    assert [tuple(r) for r in missing.collect()] == [("d", 2)] and [tuple(r) for r in report] == [("d", 5, 2, 3, 1, "incomplete")]


def test_stretches_of_a_long_section(spark):
    blocks = spark.createDataFrame([("s", f"b{i:02d}", i, "x" * 9) for i in range(20)] + [("t", "b", 0, None)], "section_id string, block_id string, ordinal int, text string")
    whole = "\n".join(["x" * 9] * 20)
    rows = sorted((r["section_id"], r["base"], r["text"]) for r in C.section_texts(blocks, 50).collect())
    assert len(rows) == 5 and all(whole[b:b + len(t)] == t and len(t) <= 59 for s, b, t in rows if s == "s") and rows[-1] == ("t", 0, "")
    assert [(r["base"], r["text"]) for r in C.section_texts(blocks.filter("section_id = 's'")).collect()] == [(0, whole)]


def test_every_line_of_a_block_is_a_native_cell(spark):
    schema = "doc_id string, page_index int, block_id string, ordinal bigint, text string, item_box struct<l:double,t:double,r:double,b:double>"
    boxed = spark.createDataFrame([("d", 0, "b1", 1, "first\nsecond", (0.0, 0.0, 120.0, 40.0)), ("d", 0, "b2", 5, "one", (150.0, 60.0, 270.0, 100.0)), ("d", 0, "b3", 7, "x\n\nz", (0.0, 120.0, 120.0, 160.0))], schema)
    got = {r["cell_ref"]: (r["text"], r["rendering_mode"], tuple(r["cell_box"])) for r in plans_corpus._cells(boxed).collect()}
    assert got["b1"] == ("first", 0, (0, 10, 120, 20)) and got["b1:1"] == ("second", 0, (0, 20, 120, 30)) and got["b2"] == ("one", 0, (2150, 70, 2270, 90))
    assert sorted(got) == ["b1", "b1:1", "b2", "b3", "b3:1", "b3:2"] and got["b3:2"][:2] == ("z", 3)


def test_budget_chunks_query_cuts_and_refuses_at_the_default_budget(spark, tmp_path):
    blocks = [("b1", "d", "s", 0, "word " * 700), ("b2", "d", "t", 1, "text")]
    sections = [("s", "d", ["Guide"]), ("t", "d", ["long " * 400])]
    at = F.lit("2025-01-01").cast("timestamp")
    spark.createDataFrame(blocks, "block_id string, doc_id string, section_id string, ordinal bigint, text string").select("*", F.lit(0).alias("page_index"), F.lit("text").alias("kind"), F.lit("body").alias("content_layer"), F.lit("r").alias("native_ref"), F.lit("v").alias("parse_version"), F.lit(False).alias("reading_order_unresolved"), at.alias("ingested_at")).write.parquet(f"{tmp_path}/blocks.parquet")
    spark.createDataFrame(sections, "section_id string, doc_id string, path array<string>").select("*", F.lit(None).cast("string").alias("parent_id"), F.lit("x").alias("title"), F.lit(1).alias("level"), F.lit(0).cast("bigint").alias("ordinal"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.lit("k").alias("kind"), at.alias("written_at")).write.parquet(f"{tmp_path}/sections.parquet")
    got = sorted((r["section_id"], r["piece"], r["tokens"]) for r in plans_documents.budget_chunks(spark, str(tmp_path)).collect())
    assert [g[:2] for g in got] == [("s", 0), ("s", 1), ("t", -1)] and got[0][2] <= 384 and got[2][2] > 384
