"""Queries on requests, history and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.common import latest, table
from tessella.functions import text as X
from tessella.operators import history as H
from tessella.operators import qa
from tessella.plans import search

#: Bodies that must be rejected, and three that must not.
BODIES = (
    '{"context": [], "question": "a"}', '{"conversation_id": "1", "context": [], "question": "a"}', '{"conversation_id": 1.5, "context": [], "question": "a"}', '{"conversation_id": true, "context": [], "question": "a"}',
    '{"conversation_id": 1, "question": "a"}', '{"conversation_id": 1, "context": [{}], "question": "a"}', '{"conversation_id": 1, "context": [{"Q": "a"}], "question": "a"}', '{"conversation_id": 1, "context": [{"Q": " ", "A": "b"}], "question": "a"}',
    '{"conversation_id": 1, "context": [{"Q": "a", "A": ""}], "question": "a"}', '{"conversation_id": 1, "context": [], "question": "  "}', '{"conversation_id": 1, "context": [], "question": "a", "extra": 0}', '{"conversation_id": 1, "context": [{"q": "a", "a": "b"}], "question": "a"}',
    "no json", "[1]", '{"conversation_id": 1, "context": [], "question": "a"}', '{"conversation_id": -7, "context": [{"Q": "a", "A": "b"}], "question": "a"}', '{"conversation_id": 1, "context": {}, "question": "a"}',
)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = latest(table(spark, sf_dir, "qa_requests"), "request_id", "received_at", "conversation_id", "context", "question")
    return once.withColumn("history", H.pairs(F.col("context"))).withColumn("question", F.coalesce("question", F.lit("")))


def _joined(c) -> object:  # noqa: ANN001
    return F.md5(F.array_join(F.transform(c, lambda x: F.concat(x["q"], F.lit("\x01"), x["a"])), "\x02"))


def history_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = H.answered(F.col("history"))
    return _requests(spark, sf_dir).select("request_id", F.size(kept).alias("pairs"), _joined(kept).alias("pairs_md5"))


def rewrite_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    refers = X.has_back_reference(F.col("question"))
    return _requests(spark, sf_dir).select("request_id", refers.alias("refers_back"), (refers & (F.size("history") > 0)).alias("needs_rewrite"))


def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = H.newest_within(F.col("history"), F.lit(300), lambda x: F.length(x["q"]) + F.length(x["a"]))
    return _requests(spark, sf_dir).select("request_id", F.size(kept).alias("pairs"), _joined(kept).alias("pairs_md5"))


def retrieval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = H.retrieval_query(H.answered(F.col("history")), F.col("question"))
    return _requests(spark, sf_dir).select("request_id", F.length(q).alias("length"), F.md5(q).alias("query_md5"))


def rewrite_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = H.rewrite_history(H.answered(F.col("history")), 400)
    return _requests(spark, sf_dir).select("request_id", F.length(q).alias("length"), F.md5(q).alias("history_md5"))


def answer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = H.answer_history(H.answered(F.col("history")), 400)
    return _requests(spark, sf_dir).select("request_id", F.size(m).alias("messages"), F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")).alias("messages_md5"))


def request_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request as a body, and the literal bodies of BODIES."""
    item = F.transform("context", lambda x: F.struct(x["q"].alias("Q"), x["a"].alias("A")))
    body = F.to_json(F.struct("conversation_id", item.alias("context"), "question"), {"ignoreNullFields": "false"})
    rows = latest(table(spark, sf_dir, "qa_requests"), "request_id", "received_at", "conversation_id", "context", "question").select("request_id", body.alias("body"))
    literal = spark.createDataFrame([(f"literal_{i:02d}", b) for i, b in enumerate(BODIES)], "request_id string, body string")
    return rows.unionByName(literal).select("request_id", qa.request_fault(F.col("body")).alias("fault"))


def _traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = latest(table(spark, sf_dir, "pipeline_traces"), "request_id", "logged_at", "rewrite_query", "response_type", "answerable", "generated_answer", "retrieved_documents")
    return _requests(spark, sf_dir).join(t, "request_id")


def qa_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traced(spark, sf_dir).select("request_id", qa.route(H.answered(F.col("history")), F.col("question"), F.col("rewrite_query")).alias("route"))


def qa_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text each request is searched by, on the route that it takes."""
    rows = _traced(spark, sf_dir).withColumn("_h", H.answered(F.col("history")))
    r = qa.route(F.col("_h"), F.col("question"), F.col("rewrite_query"))
    text = F.when(r == "search_with_rewrite", F.concat(F.col("question"), F.lit("\n"), X.strip(F.col("rewrite_query")))).when(r == "search", F.col("question"))
    return rows.select("request_id", r.alias("route"), F.md5(F.coalesce(text, F.lit(""))).alias("search_md5"), F.md5(H.retrieval_query(F.col("_h"), F.col("question"))).alias("with_history_md5"))


def answer_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of the traces: every citation of a retrieved document, one that is unknown where the answer's length is divisible
    by 5, and the first one twice where it is divisible by 7."""
    n = F.size(F.coalesce("retrieved_documents", F.array().cast("array<string>")))
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), qa.citation_id)).otherwise(F.array().cast("array<string>"))
    size = F.length("generated_answer")
    cited = F.when(size % 5 == 0, F.concat(ids, F.array(F.lit("C999")))).when(size % 7 == 0, F.concat(F.slice(ids, 1, 1), ids)).otherwise(ids)
    reply = F.to_json(F.struct("response_type", "answerable", F.col("generated_answer").alias("answer"), cited.alias("citation_ids")), {"ignoreNullFields": "false"})
    fenced = F.concat(F.lit("```json\n"), reply, F.lit("\n```"))
    return _traced(spark, sf_dir).select("request_id", F.array_join(qa.answer_faults(fenced, ids), ",").alias("faults"))


def llm_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in a code fence; those whose answer's length is even are cut short."""
    reply = F.to_json(F.struct("request_id"))
    content = F.when(F.length(F.coalesce("generated_answer", F.lit(""))) % 2 == 0, F.concat(F.lit("```json\n"), F.substring(reply, 1, 10))).otherwise(F.concat(F.lit(" ```JSON\n"), reply, F.lit("\n``` ")))
    return _traced(spark, sf_dir).select("request_id", F.get_json_object(X.llm_object(content), "$.request_id").alias("parsed"))


def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations C005, C003 and C004 of every hybrid search."""
    r = search._two_way(spark, sf_dir, 5)
    cited = r.select("query_id").distinct().withColumn("citation_ids", F.array(*map(F.lit, ("C005", "C003", "C004"))))
    return qa.cited_sources(r, cited)


def source_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = latest(table(spark, sf_dir, "chunks"), "chunk_id", "ingested_at", "doc_id", "section_id", "text", "source_spans")
    docs = latest(table(spark, sf_dir, "bundle_documents"), "doc_id", "registered_at", "title", "source_filename")
    secs = latest(table(spark, sf_dir, "sections"), "section_id", "written_at", "title", "path")
    p = qa.public_sources(chunks, docs, secs)
    return p.select("chunk_id", "document", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.md5("excerpt").alias("excerpt_md5"), F.array_join("section_path", " > ", "").alias("section_path"))


def source_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = latest(table(spark, sf_dir, "chunks"), "chunk_id", "ingested_at", "doc_id", "section_id", "text", "source_spans")
    docs = latest(table(spark, sf_dir, "bundle_documents"), "doc_id", "registered_at", "title", "source_filename")
    secs = latest(table(spark, sf_dir, "sections"), "section_id", "written_at", "title", "path")
    p = qa.provenance(chunks, docs, secs)
    spans = F.array_join(F.transform("source_spans", lambda x: F.concat_ws(":", x["block_id"], x["page_index"].cast("string"), x["start_char"].cast("string"), x["end_char"].cast("string"))), ",")
    return p.select("chunk_id", "document_id", "document_title", "filename", "page_start", "page_end", F.array_join("section_path", " > ", "").alias("section_path"), F.md5("excerpt").alias("excerpt_md5"), spans.alias("spans"))


_REQ = """r AS (SELECT request_id, conversation_id, context, coalesce(question, '') AS question,
  list_transform(list_filter(coalesce(context, []), lambda x: x IS NOT NULL), lambda x: struct_pack(q := coalesce(x.q, ''), a := coalesce(x.a, ''))) AS history
  FROM qa_requests WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY received_at DESC, conversation_id DESC) = 1)"""
_B = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_B}]+|[{_B}]+$', '', 'g')"


_HIST = f"{_REQ}, h AS (SELECT request_id, question, history, list_filter(history, lambda x: lower({sql_strip('x.a')}) <> 'i can''t answer this') AS kept FROM r)"
_MD5 = "md5(array_to_string(list_transform({0}, lambda x: x.q || chr(1) || x.a), chr(2)))"


def _newest(items: str, cost: str, budget: str) -> str:
    """The newest items within a budget; cost is an expression in y."""
    tail = f"list_sum(list_transform({items}[len({items}) - i + 1:], lambda y: {cost}))"
    return f"(CASE WHEN {budget} > 0 THEN {items}[len({items}) - len(list_filter(range(1, len({items}) + 1), lambda i: {tail} <= {budget})) + 1:] ELSE [] END)"


_LINES = "list_transform(kept, lambda x: 'user: ' || x.q || chr(10) || 'assistant: ' || x.a)"
_RETRIEVAL = f"""rq AS (SELECT *, 'CURRENT QUESTION' || chr(10) || question AS cur, {_LINES} AS lines FROM h),
rk AS (SELECT *, {_newest('lines', 'length(y) + 1', 'greatest(0, 2400 - length(cur))')} AS dialogue FROM rq),
q AS (SELECT *, CASE WHEN len(dialogue) > 0 THEN cur || chr(10) || 'PRIOR DIALOGUE' || chr(10) || array_to_string(dialogue, chr(10)) ELSE cur END AS q FROM rk)"""
_EN = "|".join(X.BACK_REFERENCES)
_REFERS = rf"(regexp_matches(question, '(?i)(^|[^\p{{L}}\p{{N}}_])({_EN})($|[^\p{{L}}\p{{N}}_])') OR regexp_matches(question, '{X.BACK_REFERENCES_ZH}'))"
_TRACE = "t AS (SELECT * FROM pipeline_traces WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY logged_at DESC, rewrite_query DESC NULLS LAST) = 1)"
_ROUTE = f"CASE WHEN {_REFERS} AND len(kept) = 0 THEN 'clarify' WHEN {_REFERS} AND NOT coalesce(length({sql_strip('rewrite_query')}) BETWEEN 1 AND 2000, false) THEN 'clarify' WHEN {_REFERS} THEN 'search_with_rewrite' ELSE 'search' END"
_OK = lambda c: f"coalesce(length({c}) BETWEEN 1 AND 20000 AND regexp_matches({c}, '[^{_B}]'), false)"
_BODIES = ", ".join("('literal_{:02d}', '{}')".format(i, b.replace("'", "''")) for i, b in enumerate(BODIES))
_CITED = "CASE WHEN length(generated_answer) % 5 = 0 THEN list_append(ids, 'C999') WHEN length(generated_answer) % 7 = 0 THEN list_concat(ids[:1], ids) ELSE ids END"

SQL = {
    "history_filter": f"WITH {_HIST} SELECT request_id, len(kept) AS pairs, {_MD5.format('kept')} AS pairs_md5 FROM h",
    "rewrite_trigger": f"WITH {_REQ} SELECT request_id, {_REFERS} AS refers_back, {_REFERS} AND len(history) > 0 AS needs_rewrite FROM r",
    "history_budget": f"WITH {_REQ}, k AS (SELECT request_id, {_newest('history', 'length(y.q) + length(y.a)', '300')} AS kept FROM r) SELECT request_id, len(kept) AS pairs, {_MD5.format('kept')} AS pairs_md5 FROM k",
    "retrieval_query": f"WITH {_HIST}, {_RETRIEVAL} SELECT request_id, length(q) AS length, md5(q) AS query_md5 FROM q",
    "rewrite_history": f"WITH {_HIST}, l AS (SELECT request_id, {_LINES} AS lines FROM h), q AS (SELECT request_id, coalesce(array_to_string({_newest('lines', 'length(y) + 1', '400')}, chr(10)), '') AS q FROM l) SELECT request_id, length(q) AS length, md5(q) AS history_md5 FROM q",
    "answer_history": f"WITH {_HIST}, k AS (SELECT request_id, {_newest('kept', 'length(y.q) + length(y.a)', '400')} AS p FROM h) SELECT request_id, 2 * len(p) AS messages, md5(coalesce(array_to_string(list_transform(p, lambda x: 'user:' || x.q || chr(10) || 'assistant:' || x.a), chr(10)), '')) AS messages_md5 FROM k",
    "request_validate": f"""WITH {_REQ}, b AS (SELECT request_id, to_json(struct_pack(conversation_id := conversation_id, context := list_transform(context, lambda x: struct_pack(Q := x.q, A := x.a)), question := (SELECT any_value(z.question) FROM qa_requests z WHERE z.request_id = r.request_id)))::VARCHAR AS body FROM r UNION ALL FROM (VALUES {_BODIES})),
v AS (SELECT request_id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM b)
SELECT request_id, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'not_an_object'
  WHEN len(list_filter(json_keys(j), lambda k: k NOT IN ('conversation_id', 'context', 'question'))) > 0 THEN 'unknown_field'
  WHEN coalesce(json_type(j, '$.conversation_id') NOT IN ('BIGINT', 'UBIGINT'), true) THEN 'conversation_id'
  WHEN coalesce(json_type(j, '$.context') <> 'ARRAY', true) THEN 'context'
  WHEN len(list_filter(json_extract(j, '$.context[*]'), lambda x: NOT (json_type(x) = 'OBJECT' AND list_sort(json_keys(x)) = ['A', 'Q'] AND json_type(x, '$.A') = 'VARCHAR' AND json_type(x, '$.Q') = 'VARCHAR' AND {_OK("json_extract_string(x, '$.A')")} AND {_OK("json_extract_string(x, '$.Q')")}))) > 0 THEN 'item'
  WHEN coalesce(json_type(j, '$.question') <> 'VARCHAR', true) OR NOT {_OK("json_extract_string(j, '$.question')")} THEN 'question' END AS fault FROM v""",
    "qa_decision": f"WITH {_HIST}, {_TRACE} SELECT request_id, {_ROUTE} AS route FROM h JOIN t USING (request_id)",
    "qa_route": f"WITH {_HIST}, {_RETRIEVAL}, {_TRACE}, d AS (SELECT q.*, rewrite_query, {_ROUTE} AS route FROM q JOIN t USING (request_id)) SELECT request_id, route, md5(CASE route WHEN 'search_with_rewrite' THEN question || chr(10) || {sql_strip('rewrite_query')} WHEN 'search' THEN question ELSE '' END) AS search_md5, md5(q) AS with_history_md5 FROM d",
    "answer_validate": f"""WITH {_REQ}, {_TRACE}, i AS (SELECT t.*, list_transform(range(1, len(coalesce(retrieved_documents, [])) + 1), lambda k: 'C' || lpad(k::VARCHAR, 3, '0')) AS ids FROM t JOIN r USING (request_id)), c AS (SELECT *, {_CITED} AS cited FROM i)
SELECT request_id, concat_ws(',', CASE WHEN response_type IS NULL OR response_type NOT IN ('answer', 'clarify', 'abstain') THEN 'response_type' END, CASE WHEN answerable IS NULL THEN 'answerable' END,
  CASE WHEN generated_answer IS NULL OR NOT regexp_matches(generated_answer, '[^{_B}]') THEN 'answer' END, CASE WHEN list_contains(cited, 'C999') THEN 'unknown_citation' END, CASE WHEN len(list_distinct(cited)) < len(cited) THEN 'repeated_citation' END,
  CASE WHEN response_type = 'answer' AND (NOT answerable OR len(cited) = 0) THEN 'answer_without_citation' END, CASE WHEN response_type IN ('clarify', 'abstain') AND (answerable OR len(cited) > 0) THEN 'citation_without_answer' END) AS faults FROM c""",
    "llm_json_parse": f"WITH {_REQ}, {_TRACE} SELECT request_id, CASE WHEN length(coalesce(generated_answer, '')) % 2 = 1 THEN request_id END AS parsed FROM t JOIN r USING (request_id)",
    "cited_sources": search._TWO + search._sql_fused(search._W2, 5) + " SELECT query_id, 'C' || lpad(rank::VARCHAR, 3, '0') AS citation_id, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS position FROM best WHERE rank IN (3, 4, 5)",
    "source_projection": """WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1),
d AS (SELECT doc_id, title, source_filename FROM bundle_documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY registered_at DESC) = 1),
s AS (SELECT section_id, title, path FROM sections QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY written_at DESC) = 1),
p AS (SELECT c.*, coalesce(nullif(d.title, ''), nullif(d.source_filename, ''), doc_id) AS document, s.section_id IS NOT NULL AS known, s.path, s.title AS st, list_filter(list_transform(source_spans, lambda x: x.page_index + 1), lambda x: x IS NOT NULL) AS pg FROM c LEFT JOIN d USING (doc_id) LEFT JOIN s USING (section_id))
SELECT chunk_id, document, CASE WHEN list_min(pg) IS NULL THEN '' ELSE array_to_string(range(list_min(pg), list_max(pg) + 1), ',') END AS pages, md5(coalesce(text, '')) AS excerpt_md5, CASE WHEN known THEN coalesce(array_to_string(path, ' > '), st, '') ELSE '' END AS section_path FROM p""",
    "source_provenance": """WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1),
d AS (SELECT doc_id, title, source_filename FROM bundle_documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY registered_at DESC) = 1),
s AS (SELECT section_id, title, path FROM sections QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY written_at DESC) = 1)
SELECT chunk_id, doc_id AS document_id, coalesce(d.title, d.source_filename, doc_id) AS document_title, d.source_filename AS filename, list_min(list_transform(source_spans, lambda x: x.page_index + 1)) AS page_start, list_max(list_transform(source_spans, lambda x: x.page_index + 1)) AS page_end,
  CASE WHEN s.section_id IS NULL THEN '' ELSE coalesce(array_to_string(s.path, ' > '), s.title, '') END AS section_path, md5(coalesce(text, '')) AS excerpt_md5,
  coalesce(array_to_string(list_transform(source_spans, lambda x: concat_ws(':', x.block_id, x.page_index, x.source_start_char, x.source_end_char)), ','), '') AS spans FROM c LEFT JOIN d USING (doc_id) LEFT JOIN s USING (section_id)""",
}

QUERIES = {f.__name__: f for f in (source_provenance, history_filter, rewrite_trigger, history_budget, retrieval_query, rewrite_history, answer_history, request_validate, qa_decision, qa_route, answer_validate, llm_json_parse, cited_sources, source_projection)}
