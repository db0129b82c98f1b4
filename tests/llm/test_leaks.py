import random

from tessella.llm.leaks import automaton, find_leaks, letters, letters_at, prepared, scan

ITEM = "A trainee at Orethpel saw the Ristgas gauge swing 33 times in a row shortly after the Ethfen ferry had left"
ZH = "蘅蕨淞的實習生聽見霧澗隔牆後傳來86下短促敲擊，當時前往蘅蘅的渡輪剛離岸。"
W = ITEM.split()


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")


def items(spark, *rows):
    return spark.createDataFrame(list(rows) or [(1, "en", ITEM), (2, "ZH", ZH), (3, "en", "too short"), (4, "de", None)], "item_id bigint, lang string, text string")


def test_found_and_not_found(spark):
    texts = [
        "Intro. " + " ".join(W[3:15]) + " outro",  # 0: twelve words
        "Intro. " + " ".join(W[3:14]) + " outro",  # 1: eleven
        "> " + "\n> ".join(w.upper() for w in W),  # 2: quoted, capitals
        " ".join(W[:12]).translate({c: c + 0xFEE0 for c in range(0x21, 0x7F)}),  # 3: full width
        "<b>" + "</b> <i x='1'>".join(W) + "</i>, &amp; more",  # 4: markup
        "**" + "**, _".join(W[2:14]) + "_",  # 5: punctuation
        " ".join([*W[:6], "very", *W[6:17]]),  # 6: a word more, then eleven
        " ".join(W[:11]) + " tha",  # 7: the last word is another
        "x" + " ".join(W[:12]),  # 8: begins inside a word
        " ".join(W[:11]) + " int o",  # 9
        ZH[3:23],  # 10: twenty characters
        ZH[3:22],  # 11: nineteen
        "前" + " ".join(ZH),  # 12: blanks between characters
        None, "", "  ", "Z" * 200_000 + " " + ITEM,  # 13 to 16
    ]
    got = sorted((r["doc_id"], r["item_id"]) for r in find_leaks(docs(spark, *texts), items(spark)).collect())
    assert got == [(0, 1), (2, 1), (3, 1), (4, 1), (5, 1), (10, 2), (12, 2), (16, 1)]


def test_offsets_and_repeats(spark):
    text = "Before – " + ITEM.replace("saw", "ＳＡＷ") + ". After"
    df = docs(spark, text).union(docs(spark, text))
    r = find_leaks(df, items(spark, (1, "en", ITEM), (1, "en", ITEM))).collect()
    assert len(r) == 1 and text[r[0]["start_char"]:r[0]["end_char"]] == ITEM.replace("saw", "ＳＡＷ")


def test_places_are_exact_where_characters_compose(spark):
    w = " ".join(W[:12])
    hangul = "\u1112\u1161\u11ab"
    texts = ["x" + w + " " + hangul, hangul + " " + w + " " + hangul, "ﬁ " + w + "e\u0301", "\uff76\uff9e " + w]
    got = {r["doc_id"]: texts[r["doc_id"]][r["start_char"] : r["end_char"]] for r in find_leaks(docs(spark, *texts), items(spark)).collect()}
    assert got == {1: w, 3: w}  # glued to another letter at one end a window has too few whole words
    for t in texts:
        assert letters_at(t)[0] == letters(t)
    longer = "Intro. " + " ".join(W[2:18]) + " outro"
    r = find_leaks(docs(spark, longer), items(spark)).collect()[0]
    assert longer[r["start_char"] : r["end_char"]] == " ".join(W[2:18])


def test_empty_and_blocks(spark):
    assert find_leaks(docs(spark, ITEM).filter("false"), items(spark)).count() == 0
    assert find_leaks(docs(spark, ITEM), items(spark).filter("false")).count() == 0
    many = [(i, "en", f"{ITEM} {i} and further words number {i} for item {i} of the long list") for i in range(30)]
    one = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(spark, many[7][2], ITEM), items(spark, *many)).collect()}
    assert one == {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(spark, many[7][2], ITEM), items(spark, *many), capacity=400).collect()} and len(one) == 60


def test_against_brute_force():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)]
    its = [(i, "en", " ".join(rng.choices(vocabulary, k=12))) for i in range(20)]
    its_ = [prepared(i, t, lang, 5, 20) for i, lang, t in its]
    a = automaton(its_)
    for _ in range(300):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 25)))
        words = text.split()
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        want = {i for i, _, t in its if any(tuple(t.split()[k : k + 5]) in runs for k in range(8))}
        assert set(scan(text, a, its_)) == want
    assert letters("Ａ-b &amp; <br/>ß") == "abss"
