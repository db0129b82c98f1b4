from pyspark.sql import functions as F

from tessella.functions.text import continuation_parts, coverage_form, has_back_reference, llm_object, sentences_of, stable_id
from tessella.operators import history as H
from tessella.operators import qa
from tessella.plans.conversation import BODIES


def history(spark, *pairs):
    return spark.createDataFrame([([{"q": q, "a": a} for q, a in pairs],)], "h array<struct<q:string,a:string>>")


def test_budgets(spark):
    df = history(spark, ("old", "x" * 50), ("new", "y" * 10))
    h = F.col("h")
    r = df.select(H.retrieval_query(h, F.lit("now?"), 60), H.retrieval_query(h, F.lit("now?"), 5), F.size(H.answer_history(h, 13)), F.size(H.answer_history(h, 12)), H.rewrite_history(h, 0)).head()
    assert r[0] == "CURRENT QUESTION\nnow?\nPRIOR DIALOGUE\nuser: new\nassistant: yyyyyyyyyy" and r[1] == "CURRENT QUESTION\nnow?"
    assert (r[2], r[3], r[4]) == (2, 0, "")
    kept = df.select(H.newest_within(h, F.lit(1000), lambda x: F.length(x["a"]))).head()[0]
    assert [x["q"] for x in kept] == ["old", "new"]


def test_pairs_and_non_answers(spark):
    df = history(spark, ("a", " i CAN'T answer this \n"), ("b", None), (None, "c"))
    r = df.select(H.answered(H.pairs(F.col("h"))), H.pairs(F.lit(None).cast("array<struct<q:string,a:string>>"))).head()
    assert [tuple(x) for x in r[0]] == [("b", ""), ("", "c")] and r[1] == []


def test_back_references(spark):
    texts = ["What should I check after that?", "How do I configure MQTT?", "Which one?", "它在哪裡", "habit", "Is ITS lamp on?", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(has_back_reference(F.col("t"))).collect()]
    assert got == [True, False, True, True, False, True, False]


def test_requests(spark):
    got = [r[0] for r in spark.createDataFrame(list(enumerate(BODIES)), "i int, b string").orderBy("i").select(qa.request_fault(F.col("b"))).collect()]
    want = ["conversation_id"] * 4 + ["context"] + ["item"] * 4 + ["question", "unknown_field", "item", "not_an_object", "not_an_object", None, None, "context"]
    assert got == want
    long = '{"conversation_id": 1, "context": [], "question": "%s"}'
    r = spark.range(1).select(qa.request_fault(F.lit(long % ("x" * 20000))), qa.request_fault(F.lit(long % ("x" * 20001)))).head()
    assert (r[0], r[1]) == (None, "question")


def test_answers(spark):
    ids = F.array(F.lit("C001"), F.lit("C002"))
    cases = {
        '{"response_type":"answer","answerable":true,"answer":"x","citation_ids":["C001"]}': [],
        '```json\n{"response_type":"clarify","answerable":false,"answer":"x","citation_ids":[]}\n```': [],
        '{"response_type":"answer","answerable":true,"answer":"x","citation_ids":[]}': ["answer_without_citation"],
        '{"response_type":"abstain","answerable":true,"answer":" ","citation_ids":["C001","C001","C9"]}': ["answer", "unknown_citation", "repeated_citation", "citation_without_answer"],
        '{"response_type":"other","answerable":1,"answer":2,"citation_ids":"C001","missing_information":[1]}': ["response_type", "answerable", "answer", "citations", "missing_information"],
        "[]": ["not_an_object", "response_type", "answerable", "answer", "citations"],
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r[0]: r[1] for r in df.select("c", qa.answer_faults(F.col("c"), ids)).collect()} == cases


def test_routes(spark):
    rows = [("Which one?", 0, "x"), ("Which one?", 1, "  "), ("Which one?", 1, "the lamp"), ("How?", 0, None)]
    df = spark.createDataFrame(rows, "q string, n int, r string").withColumn("h", F.array_repeat(F.struct(F.lit("a").alias("q"), F.lit("b").alias("a")), F.col("n")))
    assert [r[0] for r in df.select(qa.route(F.col("h"), F.col("q"), F.col("r"))).collect()] == ["clarify", "clarify", "search_with_rewrite", "search"]


def test_citations_and_sources(spark):
    results = spark.createDataFrame([(1, 10 + k, 0.5 if k in (3, 4) else 1.0 / k, k) for k in range(1, 6)], "query_id bigint, ordinal bigint, score double, rank int")
    cited = spark.createDataFrame([(1, ["C005", "C004", "C003", "C003"])], "query_id bigint, citation_ids array<string>")
    assert [r["citation_id"] for r in qa.cited_sources(results, cited).orderBy("position").collect()] == ["C003", "C004", "C005"]
    r = spark.range(1).select(qa.page_list(F.lit(2), F.lit(4)), qa.page_list(F.lit(2), F.lit(1)), qa.page_list(F.lit(2), F.lit(None).cast("int")), qa.page_list(F.lit(None).cast("int"), F.lit(4)), qa.first_filled(F.lit(""), F.lit(None), F.lit("d"))).head()
    assert tuple(r) == ([2, 3, 4], [2], [2], [], "d")


def test_small_functions(spark):
    df = spark.createDataFrame([(t,) for t in ("Setup (2/3)", "Setup 1 / 2", "Setup (3/2)", "(1/2)", "Setup", None)], "t string")
    assert [tuple(r[0]) if r[0] else None for r in df.select(continuation_parts(F.col("t"))).collect()] == [("Setup", 2, 3), ("Setup", 1, 2), None, None, None, None]
    r = spark.range(1).select(llm_object(F.lit('```json\n{"a": 1}\n```')), llm_object(F.lit("[1]")), llm_object(F.lit("{")), stable_id("sec", (F.lit('é"'), "string"), (F.lit(None).cast("string"), "string"), (F.lit(3), "number"))).head()
    import hashlib
    assert (r[0], r[1], r[2]) == ('{"a": 1}', None, None) and r[3] == "sec_" + hashlib.sha256('["é\\"",null,3]'.encode()).hexdigest()[:24]
    texts = ["See Fig. 3. It ends. 好。再見", "By J. Smith. (Yes.) 2 go", " \n ", None, "a. b? C"]
    got = [[(s["start_char"], s["end_char"]) for s in r[0]] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(sentences_of(F.col("t"))).collect()]
    assert got == [[(0, 11), (12, 20), (21, 23), (23, 25)], [(0, 19), (20, 24)], [], [], [(0, 5), (6, 7)]]
    assert coverage_form("ａ | b\n c", True) == "abc" and coverage_form("a | b", False) == "a|b" and coverage_form(None, True) is None
