import random

import numpy as np
import pytest

from tessella.llm.packing import assign, pack, piece_spans
from tessella.llm.tokens import token_spans


def test_assign_fills_and_balances():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 1025, 3000))[::-1]
    where = assign(sizes, 1024, 1.0, 1 / 1024)
    load = np.bincount(where, weights=sizes)
    assert load.max() <= 1024 and len(load) <= 1.02 * np.ceil(sizes.sum() / 1024) + 1
    assert list(assign(np.array([1024, 1024, 1]), 1024, 1, 0)) == [0, 1, 2]
    small = assign(np.full(40, 10), 100, 1.0, 0.1)
    assert set(np.bincount(small)) == {10}


def documents(spark):
    rows = [(1, "w " * 250), (2, "w " * 100), (3, "w " * 101), (4, None), (5, "  　"), (6, "w"), (6, "w"), (None, "w w"), (7, "")]
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, piece int, container_id string")


def test_pack(spark):
    rows = pack(documents(spark), 100).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["tokens"]))
    assert {k: sorted(v) for k, v in by.items()} == {1: [(0, 0, 100), (1, 100, 100), (2, 200, 50)], 2: [(0, 0, 100)], 3: [(0, 0, 100), (1, 100, 1)], 6: [(0, 0, 1)]}
    load = {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
    assert max(load.values()) <= 100 and len(load) == 5
    assert pack(documents(spark).filter("false"), 100).count() == 0
    with pytest.raises(ValueError):
        pack(documents(spark), 0)


def test_shards_lose_little(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 60)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    total = sum(len(t) // 2 for _, t in rows)
    for shard in (8192, 150):
        got = pack(df, 64, shard=shard)
        assert got.count() == 600 and got.select("container_id").distinct().count() <= total / 64 * 1.04 + 600 / shard + 1


def test_piece_spans():
    t = " a b  c d e "
    assert [t[a:b] for a, b in piece_spans(t, 2)] == [" a b  ", "c d ", "e "] and "".join(t[a:b] for a, b in piece_spans(t, 2)) == t
    assert len(token_spans(t)) == 5 and piece_spans("", 3) == [(0, 0)]
