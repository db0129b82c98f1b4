import random
from datetime import datetime

import pytest

from tessella.operators.structure import layout_order, section_pages
from tessella.operators.tree import descendant_pairs, faulty_sections, section_trees

SCHEMA = "section_id string, doc_id string, parent_id string, title string, path array<string>, ordinal bigint, written_at timestamp"
T0 = datetime(2025, 1, 1)


def brute(rows):
    """Depth, root, path, descendants and fault of every section by following parents one by one."""
    by = {r[0]: r for r in rows}
    out = {}
    for s, r in by.items():
        chain, at = [s], s
        while (p := by[at][2] or None) and p in by and p not in chain:
            chain.append(p)
            at = p
        p = by[at][2] or None
        if p and p in by:
            loop = chain[chain.index(p):]
            out[s] = (None, None, None, "cycle" if s in loop else "below_cycle", min(loop))
            continue
        path = [by[x][3] for x in reversed(chain)]
        if p:
            fault = ("missing_parent", p)
        elif by[at][1] != r[1]:
            fault = ("foreign_root", at)
        elif r[4] != path:
            fault = ("stale_path", at)
        else:
            fault = (None, None)
        out[s] = (at, len(chain) - 1, path, *fault)
    below = {s: 0 for s in by}
    for s, v in out.items():
        at = s
        while v[0] and (at := (by[at][2] if by[at][2] in by else None)):
            below[at] += 1
    return out, below


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parent = rng.choice([None, "", "gone"]) if rng.random() < 0.2 else f"s{rng.randrange(n):03d}" if rng.random() < 0.15 else f"s{rng.randrange(i):03d}" if i else None
        rows.append((f"s{i:03d}", rng.choice("dd e".split()), parent, rng.choice(["a", "b", None]), [rng.choice("ab")], i, T0))
    good, _ = brute(rows)
    return [(*r[:4], good[r[0]][2] if good[r[0]][2] and rng.random() < 0.5 else r[4], *r[5:]) for r in rows]


@pytest.mark.parametrize(("seed", "n"), [(1, 40), (2, 90)])
def test_random_forests_with_cycles(spark, seed, n):
    rows = random_rows(seed, n)
    want, below = brute(rows)
    got = {r["section_id"]: r for r in section_trees(spark.createDataFrame(rows + rows[:5], SCHEMA)).collect()}
    assert set(got) == set(want)
    for s, (root, depth, path, fault, anchor) in want.items():
        g = got[s]
        assert (g["root_id"], g["depth"], g["path"], g["fault"], g["anchor_id"]) == (root, depth, path, fault, anchor), s
        if root:
            assert g["descendants"] == below[s]
    by = {r[0]: r for r in rows}
    sound = [g for g in got.values() if g["root_id"]]
    for a in sound:  # intervals hold exactly the ancestors
        for b in sound:
            inside = a["root_id"] == b["root_id"] and a["entry"] < b["entry"] < a["exit"]
            at, up = b["section_id"], False
            while (p := by[at][2] or None) in by:
                up, at = up or p == a["section_id"], p
            assert inside == up


def test_deep_chain_and_wide_parent(spark):
    chain = [(f"c{i:04d}", "d", f"c{i - 1:04d}" if i else None, "t", ["t"] * (i + 1), i, T0) for i in range(300)]
    wide = [("w", "d", None, "t", ["t"], 0, T0)] + [(f"w{i:04d}", "d", "w", "t", ["t", "t"], 1, T0) for i in range(500)]
    got = {r["section_id"]: r for r in section_trees(spark.createDataFrame(chain + wide, SCHEMA)).collect()}
    assert got["c0299"]["depth"] == 299 and got["c0000"]["descendants"] == 299 and got["w"]["descendants"] == 500
    assert not [r for r in got.values() if r["fault"]]
    assert sorted(r["entry"] for r in got.values() if r["root_id"] == "w")[:3] == [0, 1, 3]


def test_cases(spark):
    late = datetime(2026, 1, 1)
    rows = [
        ("a", "d", "a", "self", ["self"], 0, T0),  # a cycle of one
        ("b", "d", "a", "below", ["below"], 0, T0),
        ("c", "d", "x", "old", ["old"], 0, T0),
        ("c", "d", None, "new", ["new"], 0, late),  # the later row is valid
        ("c", "d", None, "new", ["new"], 0, late),
        (None, "d", None, "none", ["none"], 0, late),
        ("e", None, "c", None, ["new", None], None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as root_id", "2 as depth", "3 as entry", "'x' as anchor")
    got = {(r["section_id"], r["fault"], r["anchor_id"]) for r in faulty_sections(df).collect()}
    assert got == {("a", "cycle", "a"), ("b", "below_cycle", "a"), ("e", "foreign_root", "c")}


def test_empty(spark):
    trees = section_trees(spark.createDataFrame([], SCHEMA))
    assert trees.count() == 0 and descendant_pairs(trees).count() == 0


def test_descendant_pairs_and_pages(spark):
    rows = [("a", "d", None, "t", None, 0, T0), ("b", "d", "a", "t", None, 1, T0), ("c", "d", "b", "t", None, 2, T0), ("e", "d", "a", "t", None, 3, T0)]
    trees = section_trees(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in descendant_pairs(trees).collect()} == {("a", "b"), ("a", "c"), ("a", "e"), ("b", "c")}
    pages = spark.createDataFrame([("c", 7), ("c", 4), ("e", 1), ("b", None)], "section_id string, page_index int")
    got = {r[0]: (r[1], r[2]) for r in section_pages(trees.select("section_id", "parent_id"), pages).collect()}
    assert got == {"a": (1, 7), "b": (4, 7), "c": (4, 7), "e": (1, 1)}


def test_layout_order_with_orphans_and_cycles(spark):
    nodes = spark.createDataFrame([("body", None, 0), ("x", "body", 2), ("y", "body", 1), ("y1", "y", 0), ("o", "gone", 5), ("k", "m", 1), ("m", "k", 2)], "node_id string, parent_id string, ordinal bigint")
    got = {r["node_id"]: (r["root_id"], r["position"], r["orphan"]) for r in layout_order(nodes).collect()}
    assert got == {"body": ("body", 0, False), "y": ("body", 1, False), "y1": ("body", 2, False), "x": ("body", 3, False), "o": ("o", 0, True), "k": (None, 0, True), "m": (None, 1, True)}
