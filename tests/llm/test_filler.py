import random
from pydoc_data.topics import topics

import numpy as np

from tessella.llm import filler
from tessella.llm.filler import Reader, bitmap, find_filler, judge_batch, lower_part, may_hold, pair_hash, stretches

SUBJECTS = ["the archive", "the operator", "the status lamp", "the relay board", "an expired certificate", "the flow meter"]
VERBS = ["is rotated at midnight", "confirms the reading of the counter", "must be calibrated by trained staff", "answers with a short status line", "stops the listener on the port"]
ENDS = ["without stopping the line", "while the pump stays powered", "to keep the archive consistent", "as described in the chapter", "unless the code is shown"]
KEYS = ["cheap", "relay", "sensor", "gateway", "driver", "firmware", "free shipping", "price", "repair", "review", "online", "wholesale", "manual pdf"]


def prose(rng, n):
    return " ".join(f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(ENDS)}." for _ in range(n))


def salad(rng, n):
    own = rng.sample(KEYS, 6)
    return rng.choice([", ", " ", "; ", " | ", ". "]).join(rng.choice(own) for _ in range(n))


def links(rng, n):
    return "\n".join(f"* https://shop{rng.randrange(400)}.example/cat/x-{rng.randrange(9999)} * {rng.choice(KEYS)}" for _ in range(n))


def tags(rng, n):
    return " ".join(f"#{rng.choice(KEYS).replace(' ', '')}" for _ in range(n))


def corpus(rng):
    good = [prose(rng, rng.randrange(2, 12)) for _ in range(400)]
    good += ["Terms\n\n" + "\n".join(f"{rng.choice(KEYS)}: {prose(rng, 2)}" for _ in range(4)) for _ in range(20)]
    good += [prose(rng, 8) + "\n\nSee also\n" + links(rng, 3) for _ in range(10)]
    bad = [salad(rng, 60) for _ in range(20)] + [prose(rng, 1) + "\n" + salad(rng, 80) for _ in range(10)] + [links(rng, 15) for _ in range(10)] + [tags(rng, 60) for _ in range(10)]
    return good, bad


def test_found(spark):
    good, bad = corpus(random.Random(8))
    rows = [(i, t) for i, t in enumerate(good)] + [(10_000 + i, t) for i, t in enumerate(bad)] + [(20_000, None), (20_001, " 　"), (20_002, "..."), (None, bad[0]), (10_000, bad[0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double")
    got = {r["doc_id"] for r in find_filler(df).collect()}
    assert got == set(range(10_000, 10_000 + len(bad)))


def test_empty_and_without_filler(spark):
    df = spark.createDataFrame([(i, prose(random.Random(i), 5)) for i in range(50)], "doc_id bigint, text string")
    assert find_filler(df).count() == 0 and find_filler(df.filter("false")).count() == 0


def words(text):
    r = Reader()
    numbers, lengths = r.read([text])
    spelt = {n: w for w, n in r.numbers.items()}
    assert lengths.tolist() == [len(numbers)]
    return [spelt[n] for n in numbers.tolist()]


def test_words_and_stretches():
    assert words("Buy #Relay2 at https://a.example/x?y=1 價格 12.5") == ["buy", "<tag>", "<tag>", "<tag>", "at", "<link>", "<link>", "<link>", "價格", "0", "0"]
    assert words("請先抄下序號センサーです") == ["請先抄下", "序號", "センサー", "です"]
    assert words('<a href="https://a.example/x">more</a> text') == ["<link>", "<link>", "<link>", "more", "text"]
    page, at, first = stretches(np.array([95, 0, 7]), 40)
    assert np.bincount(at).tolist() == [47, 48, 0, 7] and first.tolist() == [0, 2, 3] and page[-1] == 2
    assert stretches(np.array([0]), 40)[1].tolist() == []


def test_a_stretch_is_judged_by_its_own_pairs():
    none = np.zeros(0, dtype=np.int64), np.zeros(0)
    owner, part, total, length, sure, asked, again, known, told, others, weights, offsets = judge_batch(["a b c d e f", "x y " * 20, "#k " * 20], 60, 0.2, *none)
    assert owner.tolist() == [1, 2] and part.tolist() == [0, 0] and asked.tolist() == [True, False] and sure.tolist() == [0, 60] and told.tolist() == known.tolist() == [0, 0] and again[0] > 0.9
    x, y = (np.array([int(Reader.read.__globals__["xxhash"].xxh64_intdigest(c))], dtype=np.uint64) for c in "xy")
    near = {int(pair_hash(x, y).view(np.int64)[0]), int(pair_hash(y, x).view(np.int64)[0])}
    assert set(others.tolist()) == near and offsets.tolist() == [0, 4, 4] and abs(weights.sum() - 0.5) < 1e-6  # all pairs, less half of them turned round
    sent = np.array(sorted(near))
    told = judge_batch(["x y " * 20], 60, 0.2, sent, np.array([0.4, 0.4]))[8]
    assert abs(told[0] - 0.2) < 1e-6


def test_lower_part(spark):
    df = spark.createDataFrame([(0.1, 25), (0.5, 75)], "npmi double, n bigint")
    assert 0.1 <= lower_part(df, 0.25) <= 0.102 and 0.3 <= lower_part(df, 0.26) <= 0.301 and lower_part(df.filter("false"), 0.25) == 0


def test_pairs_that_are_joined_and_those_that_are_sent_agree(spark):
    good, bad = corpus(random.Random(5))
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    scores = [{r["doc_id"]: round(r["score"], 9) for r in find_filler(df, heavy=h).collect()} for h in (1, 100, 100_000)]
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) > 40


def made_up(rng, n):
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


def test_keywords_found_only_on_their_own_page(spark):
    rng = random.Random(3)
    good, bad = corpus(rng)
    own = [" ".join(rng.choice(k) for _ in range(150)) for k in (made_up(rng, 8) for _ in range(10))]
    phrases = [" ".join(made_up(rng, 4) * 60) for _ in range(5)]
    twice = own[:1] + phrases[:1]  # the same texts under other numbers vouch for nothing
    for rest in (good + bad, good):
        rows = list(enumerate(rest + own + phrases + twice))
        got = {r["doc_id"] for r in find_filler(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got == set(range(len(good), len(rows)))


def test_prose_that_is_not_made_of_templates(spark):
    rng = random.Random(4)
    good, bad = corpus(rng)
    texts = sorted((" ".join(topics[k].split()) for k in topics), key=len)[-30:]  # the language reference of Python
    varied = texts[:10] + [" ".join(t.split()[200:320]) for t in texts[10:15]]
    rows = list(enumerate(good + varied + bad))
    got = {r["doc_id"] for r in find_filler(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == set(range(len(good + varied), len(rows)))
    alone = [" ".join(t.split()[i : i + 120]) for t in texts for i in (0, 200)]
    assert find_filler(spark.createDataFrame(list(enumerate(alone)), "doc_id bigint, text string")).count() == 0


def test_salad_that_repeats_no_pair(spark, monkeypatch):
    """Words of whole pages in no order; a fifth of the pairs do not repeat."""
    rng = random.Random(11)
    good, _ = corpus(rng)
    vocabulary = sorted({w for t in good[:400] for w in t.replace(".", "").split()})
    mixed = [" ".join(w for _ in range(2) for w in rng.sample(vocabulary, len(vocabulary))) for _ in range(30)]
    none = np.zeros(0, dtype=np.int64), np.zeros(0)
    assert judge_batch(mixed, 60, 0.2, *none)[0].size == 0
    texts = sorted((" ".join(topics[k].split()) for k in topics), key=len)[-30:]
    varied = [" ".join(t.split()[200:320]) for t in texts]  # sentences of another subject
    alone = [" ".join(made_up(rng, 90)) for _ in range(5)]  # words that no page holds tell nothing
    rows = list(enumerate(good + varied + alone + mixed))
    for sent, heavy in ((0, 1), (0, 100_000), (1_000_000, 1)):  # looked up by join, in the tasks for the most part, and there alone
        monkeypatch.setattr(filler, "SENT", sent)
        got = {r["doc_id"] for r in find_filler(spark.createDataFrame(rows, "doc_id bigint, text string"), heavy=heavy).collect()}
        assert got == set(range(len(rows) - len(mixed), len(rows)))


def test_bitmap(spark):
    keys = [-(2**63), -1, 0, 63, 64, 2**63 - 1, 123456789]
    held = bitmap(spark.createDataFrame([(k,) for k in keys], "key bigint"))
    assert may_hold(held, np.array(keys)).all() and not may_hold(held, np.array([1, 2, 62])).any()
    assert not may_hold(bitmap(spark.createDataFrame([], "key bigint")), np.array(keys)).any()


def test_filler_is_the_same_with_pairs_joined(spark, monkeypatch):
    good, bad = corpus(random.Random(5))
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    scores = []
    for sent in (0, 1_000_000):
        monkeypatch.setattr(filler, "SENT", sent)
        scores.append({r["doc_id"]: round(r["score"], 9) for r in find_filler(df, heavy=100).collect()})
    assert scores[0] == scores[1] and len(scores[0]) > 40
