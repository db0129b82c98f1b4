import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.llm.splitting import natural_places, oversized, split_oversized, split_text, valley_depths
from tessella.llm.tokens import token_count, token_spans

T0, T1 = datetime(2025, 1, 1), datetime(2025, 2, 1)


def test_tokens(spark):
    cases = {"": 0, " \n　": 0, "a_b c-d": 4, "重新 MQTT": 3, "MQTT代理": 6, "तुरंत": 5, "é é": 3, "10.5%": 4, "​": 1, "ア代": 2}
    df = spark.createDataFrame(list(cases.items()), "t string, n int")
    assert all(r[0] == r[1] for r in df.select("n", token_count(F.col("t"))).collect())
    assert {t: len(token_spans(t)) for t in cases} == cases
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab1_ .,-重新アé\n €𠀀", k=30)) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", token_count(F.col("t"))).collect()
    assert all(n == len(token_spans(t)) for t, n in got)


def text(rng, n):
    return "".join(rng.choice(["alpha beta gamma. ", "delta epsilon\n", "重新啟動。", "one two three four five six seven ", "x! "]) for _ in range(n))


@pytest.mark.parametrize(("budget", "overlap"), [(30, 5), (12, 0), (5, 20), (1, 3)])
def test_pieces(budget, overlap):
    rng = random.Random(budget)
    for n in (0, 1, 20, 120):
        t = text(rng, n)
        spans = token_spans(t)
        pieces = split_text(t, budget, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
        kept = max(0, min(overlap, budget - 1))
        for k, (a, b, before, tokens) in enumerate(pieces):
            assert sum(a <= s and e <= b for s, e in spans) == tokens <= max(budget, 1)
            if k:  # the overlap is the tokens at the end of the piece before
                assert before == min(kept, sum(e <= pieces[k - 1][1] for _, e in spans)) and sum(a <= s and e <= pieces[k - 1][1] for s, e in spans) == before


def test_cuts_are_natural_and_at_the_valley():
    a, b = "pump valve pressure pump valve. " * 4, "invoice customer payment invoice customer. " * 4
    t = a + b
    pieces = split_text(t, 36, 4, block=12)
    assert t[pieces[0][1]:].startswith("invoice") and len(pieces) == 2
    spans = token_spans(t)
    places = natural_places(t, spans)
    depth = valley_depths([t[x:y] for x, y in spans], places, 12)
    assert max(depth, key=depth.get) == len(token_spans(a))
    assert natural_places("See Fig. 3 now. Then e.g. this", token_spans("See Fig. 3 now. Then e.g. this")) == [6]


def frames(spark):
    chunks = [("c1", "s1", "w " * 20, 16, T0), ("c1", "s1", "w " * 30, 16, T1), ("c1", "s1", "w " * 30, 16, T1), ("c2", "s1", "w " * 13, 16, T0), ("c3", "none", "w " * 17, 16, T0), ("c4", "s1", None, 16, T0), ("c5", "s1", "", 16, T0), ("c6", "s1", "w " * 30, None, T0), (None, "s1", "w " * 30, 16, T0), ("c7", "s2", "w w", 16, T0), ("c8", None, "w " * 16, 16, T0)]
    sections = [("s1", ["a", "b"], T0), ("s1", ["a", "b", "c", "d"], datetime(2024, 1, 1)), ("s2", ["p " * 16], T0)]
    limits = [("chunk-16", 16, 3), ("container", 100, None), ("chunk-x", 9, 9)]
    return (spark.createDataFrame([(*c, "x") for c in chunks], "chunk_id string, section_id string, text string, max_tokens int, ingested_at timestamp, path_tokens string"), spark.createDataFrame(sections, "section_id string, path array<string>, written_at timestamp"), spark.createDataFrame(limits, "limit_name string, max_tokens int, overlap_tokens int"))


def test_operator(spark):
    chunks, sections, limits = frames(spark)
    rows = split_oversized(chunks, sections, limits).collect()
    assert {r["chunk_id"] for r in rows} == {"c1", "c3", "c7"}  # c2 has 13 + 3 tokens, which is its limit
    c1 = sorted((r for r in rows if r["chunk_id"] == "c1"), key=lambda r: r["piece"])
    assert [r["tokens"] for r in c1] == [13, 13, 10] and all(r["fits"] for r in c1) and [r["overlap_tokens"] for r in c1] == [0, 3, 3]
    assert all(("w " * 30)[r["start_char"]:r["end_char"]] == r["text"] for r in c1)
    assert [r["fits"] for r in rows if r["chunk_id"] == "c7"] == [False, False]
    assert oversized(chunks.filter("false"), sections).count() == 0 and split_oversized(chunks, sections.filter("false"), limits.filter("false")).filter("chunk_id = 'c1'").count() == 2
