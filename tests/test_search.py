import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.functions.text import tokenize
from tessella.operators.dense import dense_search, mean_pool, normalize, scoped, vector_fault
from tessella.operators.fusion import REWRITE_WEIGHTS, hybrid_search, hybrid_search_with_rewrite, weighted_rrf
from tessella.operators import lexical
from tessella.operators.lexical import bm25_search, build_index, query_terms


def tokens(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(tokenize("t")).collect()]


def test_tokenizer(spark):
    assert tokens(spark, "Restart the Server-2!", "重新啟動 MQTT", "MQTT代理x", "Straße", None, " \t　") == [
        ["restart", "the", "server", "-", "2", "!"], ["重", "新", "啟", "動", "mqtt"], ["m", "q", "t", "t", "代", "理", "x"], ["strasse"], [], []]


def brute_bm25(docs, query, k, k1=1.2, b=0.75):
    tf = [Counter(d.split()) for d in docs]
    n, avg = len(docs), sum(sum(c.values()) for c in tf) / max(1, len(docs)) or 1.0
    df = Counter(t for c in tf for t in c)
    score = [round(sum(q * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * sum(c.values()) / avg)) for t, q in Counter(query.split()).items() if c[t]), 9) for c in tf]
    return [(i, score[i]) for i in sorted(range(n), key=lambda i: (-score[i], i))[:k]]


def test_bm25_against_brute_force(spark):
    rng = random.Random(4)
    docs = [" ".join(rng.choices("alpha beta gamma delta eps".split(), k=rng.randrange(0, 9))) for _ in range(40)]
    queries = ["alpha beta", "eps eps delta", "nothing here", ""]
    corpus = spark.createDataFrame(list(enumerate(docs)), "ordinal bigint, text string")
    got = bm25_search(build_index(corpus), spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string"), 7).collect()
    for q, text in enumerate(queries):
        rows = sorted((r["rank"], r["ordinal"], round(r["score"], 8)) for r in got if r["query_id"] == q)
        assert rows == [(i, o, round(s, 8)) for i, (o, s) in enumerate(brute_bm25(docs, text, 7), 1)]


def test_bm25_in_batches_and_blocks(spark, monkeypatch):
    """What cannot reach the best is not summed up, queries of the same terms are scored once: no result changes, however it is cut."""
    rng = random.Random(9)
    names = [f"w{i}" for i in range(40)]
    docs = [" ".join(rng.choices(names, [1 / (i + 1) for i in range(40)], k=rng.randrange(0, 30))) for _ in range(300)]
    queries = [" ".join(rng.choices(names, k=rng.randrange(1, 6))) for _ in range(12)] + ["w0 w1 w39", "w39 w1 w0", "w0", "none w0 w0", ""]
    corpus = spark.createDataFrame(list(enumerate(docs)), "ordinal bigint, text string").repartition(2)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")
    want = {(q, i): (o, s) for q, text in enumerate(queries) for i, (o, s) in enumerate(brute_bm25(docs, text, 5), 1)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for sent, wanted, block in ((1000, None, 4096), (1000, query_terms(asked), 3), (0, query_terms(asked), 3)):
            monkeypatch.setattr(lexical, "SENT", sent)
            index = build_index(corpus, wanted)
            got = {(r["query_id"], r["rank"]): (r["ordinal"], r["score"]) for r in bm25_search(index, asked, 5, block=block).collect()}
            assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-8 for x in want)
            if wanted is not None:
                kept = {t for q in queries for t in q.split()}
                assert {(r["ordinal"], r["term"], r["tf"]) for r in index.postings.collect()} == {(i, t, n) for i, d in enumerate(docs) for t, n in Counter(d.split()).items() if t in kept}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def shuffled(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_that_share_a_term_are_not_shuffled(spark):
    """400,000 pairs share the dash."""
    corpus = spark.createDataFrame([(i, f"- a{i % 50}") for i in range(2000)], "ordinal bigint, text string").repartition(4)
    asked = spark.createDataFrame([(i, f"- b{i}") for i in range(200)], "query_id bigint, text string")
    before = shuffled(spark)
    assert bm25_search(build_index(corpus, query_terms(asked)), asked).filter("ordinal < 20").count() == 4000
    assert shuffled(spark) - before < 100_000


def test_pairs_are_not_shuffled_by_fused_searches(spark):
    corpus = spark.createDataFrame([(i, f"- a{i % 50}", [1.0, float(i)]) for i in range(2000)], "ordinal bigint, text string, vector array<double>").repartition(4)
    asked = spark.createDataFrame([(i, f"- b{i}", [1.0, float(i)]) for i in range(200)], "query_id bigint, text string, vector array<double>")
    q, e = asked.select("query_id", "text"), asked.select("query_id", "vector")
    index = build_index(corpus.select("ordinal", "text"), query_terms(q))
    for search in (lambda: hybrid_search(index, corpus.select("ordinal", "vector"), q, e), lambda: hybrid_search_with_rewrite(index, corpus.select("ordinal", "vector"), (q, e), (q, e))):
        before = shuffled(spark)
        assert search().count() == 1000
        assert shuffled(spark) - before < 150_000


def test_bm25_parameters(spark):
    index = build_index(spark.createDataFrame([(0, "a")], "ordinal bigint, text string"))
    q = spark.createDataFrame([(0, "a")], "query_id bigint, text string")
    for bad in ({"k": 0}, {"k": True}, {"k1": 0}, {"b": 2}):
        with pytest.raises(ValueError):
            bm25_search(index, q, **bad)


def test_dense_search_and_faults(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() - 0.5 for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5), (61, None), (62, [1.0]), (63, [float("nan")] * 5)]
    rows += [(64, rows[0][1])]  # a tie
    v = spark.createDataFrame(rows, "ordinal bigint, vector array<double>")
    got = dense_search(v, v.filter("ordinal in (0, 5, 60, 61, 63)").withColumnRenamed("ordinal", "query_id"), 4, block=1).collect()

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)

    assert {r["query_id"] for r in got} == {0, 5}
    for q in (0, 5):
        want = sorted(((-cos(rows[q][1], r[1]), r[0]) for r in rows if r[1] and len(r[1]) == 5 and r[0] not in (60, 63)))[:4]
        assert [(r["ordinal"], round(r["score"], 5)) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(o, round(-s, 5)) for s, o in want]
    faults = {r[0]: r[1] for r in v.select("ordinal", vector_fault(F.col("vector"), 5)).collect()}
    assert [faults[i] for i in (0, 60, 61, 62, 63)] == [None, "zero", "null", "dimension", "not_finite"]
    assert dense_search(scoped(v.withColumn("label", F.col("ordinal") % 2), spark.createDataFrame([(1,)], "label bigint"), "label"), v.filter("ordinal = 0").withColumnRenamed("ordinal", "query_id"), 100).filter("ordinal % 2 = 0").count() == 0


def test_normalize_and_mean_pool(spark):
    df = spark.createDataFrame([([3.0, 4.0], [[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]], [1, 1, 0])], "v array<double>, s array<array<double>>, m array<int>")
    r = df.select(normalize(F.col("v")), mean_pool(F.col("s"), F.col("m")), mean_pool(F.col("s"), F.array(*[F.lit(0)] * 3))).head()
    assert [round(x, 6) for x in r[0]] == [0.6, 0.8] and [round(x, 6) for x in r[1]] == [0.707107, 0.707107] and r[2] == [0.0, 0.0]


def ranked(spark, *ids):
    return spark.createDataFrame([(0, i, k) for k, i in enumerate(ids, 1)], "query_id bigint, ordinal string, rank int")


def test_rrf(spark):
    lists = [("w", ranked(spark, "a", "b"), 0.3), ("x", ranked(spark, "b", "c"), 0.3), ("y", ranked(spark, "c", "d"), 0.2), ("z", ranked(spark, "d", "a"), 0.2)]
    got = weighted_rrf(lists, 4).orderBy("rank").collect()
    assert [r["ordinal"] for r in got] == ["b", "a", "c", "d"] and set(got[0]["components"]) == {"w", "x"}
    assert abs(got[0]["score"] - (0.3 / 62 + 0.3 / 61)) < 1e-12
    assert {r["ordinal"] for r in weighted_rrf([("w", ranked(spark, "a"), 1), ("x", ranked(spark, "b"), 0)]).collect()} == {"a", "b"}
    for bad in ({"lists": []}, {"lists": [("w", ranked(spark, "a"), -1)]}, {"lists": [("w", ranked(spark, "a"), 0)]}, {"lists": lists, "k": 0}):
        with pytest.raises(ValueError):
            weighted_rrf(**bad)


def test_weights_of_a_rewrite(spark):
    """Six passages; the rewrite's lists lead, and each passage keeps the parts of the lists that hold it."""
    lists = [(n, ranked(spark, *ids), w) for (n, w), ids in zip(REWRITE_WEIGHTS, (["c0"], ["c0"], ["c5"], ["c5"]), strict=True)]
    got = weighted_rrf(lists).orderBy("rank").collect()
    assert [r["ordinal"] for r in got] == ["c5", "c0"] and set(got[0]["components"]) == {"rewrite_bm25", "rewrite_dense"}
    assert abs(got[0]["score"] - 0.80 / 61) < 1e-12 and abs(got[1]["score"] - 0.20 / 61) < 1e-12


def test_empty_corpus_and_repeats(spark):
    empty = spark.createDataFrame([], "ordinal bigint, text string")
    q = spark.createDataFrame([(0, "a b"), (1, None)], "query_id bigint, text string")
    assert bm25_search(build_index(empty), q).count() == 0
    corpus = spark.createDataFrame([(0, None), (1, ""), (2, "a " * 5000)], "ordinal bigint, text string")
    got = {(r["query_id"], r["ordinal"]): r["rank"] for r in bm25_search(build_index(corpus), q, 2).collect()}
    assert got == {(0, 2): 1, (0, 0): 2, (1, 0): 1, (1, 1): 2}
