import random
import unicodedata

import pyarrow as pa

from tessella.llm.visual import LOOKALIKES, canonical, canonical_texts, look_pairs, look_texts, same_look


def form(*texts):
    return canonical_texts(pa.array(texts, pa.string())).to_pylist()


def test_same_look():
    same = [("Ｋｅｅｐ ９", "Keep 9"), ("Кеер lаbеl", "Keep label"), ("café", "café"), ("ガ", "ガ"), ("ｶﾞ", "ガ"), ("ﬁt", "fit"), ("a​b﻿c­", "abc"), ("a b c　d", "a b c d"), ("x‐y‑z", "x-y-z"), ("q̣́", "q̣́"), ("⽤", "用"), ("한", "한"), ("ﻻ", "لا"), ("流", "流"), ("ё", "ё"), ("a\tb", "a b")]
    for a, b in same:
        x, y = form(a, b)
        assert x == y, (a, b)


def test_different_look():
    for a, b in [("81", "8¹"), ("A", "a"), ("e", "é"), ("a b", "a  b"), ("a\nb", "a b"), ("ab", "a_b"), ("a-b", "a – b"), ("L", "Ḷ"), (" a", "a"), ("…", "...")]:
        x, y = form(a, b)
        assert x != y, (a, b)


def test_edges():
    assert form(None, "", "plain", "​", "x" * 100_000 + "é") == [None, "", "plain", "", "x" * 100_000 + "é"]
    assert form("́a", "́") == ["́a", "́"]  # a mark without a base


def test_against_the_unicode_database():
    """Without look-alikes and width the form is NFC; batches of texts do not run into one another."""
    rng = random.Random(7)
    pool = "aeioubcdAEO .̧̣̀́̈éñữçåΩ한국각각あがバ中"
    texts = ["".join(rng.choices(pool, k=rng.randrange(0, 14))) for _ in range(3000)]
    assert form(*texts) == [unicodedata.normalize("NFC", t) for t in texts]
    again = form(*form(*texts))
    assert again == form(*texts)


def test_look_alikes_are_single_letters():
    assert all(len(a) == len(b) == 1 and a != b for a, b in LOOKALIKES.items())


SCHEMA = "kind string, id string, text string, form string, class_key int"


def test_pairs(spark):
    rows = [("block", "b1", "Kit é"), ("block", "b2", "Кit é"), ("block", "b3", "Kit é"), ("block", "b3", "Kit é"), ("request", "r1", "Kit é"), ("block", "b4", "Kit é"), ("block", "b5", None), ("block", "b6", " ​"), ("block", None, "Kit é"), ("block", "b7", ""), ("block", "b8", "kit é")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in look_pairs(df).collect())
    assert got == [("b1", "b2"), ("b1", "b3"), ("b2", "b3"), ("b2", "b4"), ("b3", "b4")]  # b1 and b4 are equal in code points
    assert look_pairs(df.filter("false")).count() == 0 and same_look(df).filter("id = 'b3'").count() == 1


def test_copies_of_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr("tessella.llm.visual.SHARE", 3)
    rows = [("block", f"a{i:02}", "Kit é") for i in range(10)] + [("block", f"b{i:02}", "Кit é") for i in range(7)] + [("block", "c", "Kit é"), ("block", "d", "other")]
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    got = [tuple(r) for r in look_pairs(df).collect()]
    same = {i: t for _, i, t in rows}
    want = {(a, b) for a in same for b in same if a < b and same[a] != same[b] and "d" not in (a, b)}
    assert set(got) == want and len(got) == len(want)
    texts = {(r["copies"], r["texts"]) for r in look_texts(same_look(df)).collect()}
    assert texts == {(10, 3), (7, 3), (1, 3), (1, 1)} or texts == {(11, 2), (7, 2), (1, 1)}


def test_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "ａ", "old"), (2, None, "old")], "id int, text string, canonical_text string")
    assert [tuple(r) for r in canonical(df, "text").orderBy("id").collect()] == [(1, "ａ", "a"), (2, None, None)]
    assert canonical(df, "text", "text").columns == ["id", "canonical_text", "text"]


def test_letters_of_other_scripts_and_numerals():
    for a, b in [("ρlαn", "plan"), ("ɡɑs", "gas"), ("Ⅳ ⅻ ⅼ", "IV xii l"), ("ꓐⲟ", "Bo")]:
        x, y = form(a, b)
        assert x == y, (a, b)
