"""Requests and answers as rows: strict validation, routes, citations and public sources.

Encoder and language model are callables given by the caller; nothing here talks to a network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.common import blank, strip
from tessella.functions.text import has_back_reference, let, llm_object

TEXT_LIMIT, REWRITE_LIMIT, PASSAGE_LIMIT = 20000, 2000, 5000


def _text_ok(c: Column) -> Column:
    """Between 1 and TEXT_LIMIT code points before trimming, and not blank."""
    return F.coalesce(F.length(c).between(1, TEXT_LIMIT) & ~blank(c), F.lit(False))


def request_fault(json: Column) -> Column:
    """The first fault of a request body, null if it is sound: not_an_object, unknown_field, conversation_id, context, item, question.

    Types are read from the parsed value, never by casting: true, "1" and 1.5 are no ids. Unknown and differently spelt
    fields are rejected in the body and in each item of context.
    """
    v = F.try_parse_json(json)
    kind = lambda p: F.schema_of_variant(F.variant_get(v, p, "variant"))
    keys = F.json_object_keys(json)
    items = F.try_variant_get(v, "$.context", "array<variant>")
    text = lambda x, p: F.when(F.schema_of_variant(F.variant_get(x, p, "variant")) == "STRING", F.variant_get(x, p, "string"))
    item_ok = lambda x: F.coalesce(F.schema_of_variant(x) == "OBJECT<A: STRING, Q: STRING>", F.lit(False)) & _text_ok(text(x, "$.Q")) & _text_ok(text(x, "$.A"))
    return (
        F.when(v.isNull() | keys.isNull(), "not_an_object")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, ("conversation_id", "context", "question"))))) > 0, "unknown_field")
        .when(F.coalesce(kind("$.conversation_id") != "BIGINT", F.lit(True)), "conversation_id")
        .when(F.coalesce(~kind("$.context").startswith("ARRAY"), F.lit(True)) | items.isNull(), "context")
        .when(~F.forall(items, item_ok), "item")
        .when(F.coalesce(kind("$.question") != "STRING", F.lit(True)) | ~_text_ok(text(v, "$.question")), "question")
    )


def route(history: Column, question: Column, rewrite: Column, mode: str = "conditional") -> Column:
    """clarify, search_with_history, search_with_rewrite or search.

    A question that refers back needs a history and a rewrite of 1 to REWRITE_LIMIT code points; without either the user is asked.
    """
    if mode not in ("conditional", "disabled"):
        raise ValueError("mode must be conditional or disabled")
    if mode == "disabled":
        return F.lit("search_with_history")
    refers = has_back_reference(question)
    usable = F.coalesce(F.length(strip(rewrite)).between(1, REWRITE_LIMIT), F.lit(False))
    return F.when(refers & (F.size(history) == 0), "clarify").when(refers & ~usable, "clarify").when(refers, "search_with_rewrite").otherwise("search")


def answer_faults(content: Column, citations: Column) -> Column:
    """The rules that a model's reply breaks, as an array of names; citations: array of the ids that it may cite."""
    return let(llm_object(content), lambda text: let(F.try_parse_json(text), lambda v: let(_reply(v, text), lambda r: _broken(r, citations))))


def _reply(v: Column, text: Column) -> Column:
    """The fields of a parsed reply, each null unless it has its type."""
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    typed = lambda p, t, as_: F.when(F.coalesce(kind(p).isin(*t), F.lit(False)), F.try_variant_get(v, p, as_))
    strings = ("ARRAY<STRING>", "ARRAY<VOID>")
    return F.struct(
        v.isNull().alias("broken"),
        typed("$.response_type", ("STRING",), "string").alias("type"),
        typed("$.answerable", ("BOOLEAN",), "boolean").alias("flag"),
        typed("$.answer", ("STRING",), "string").alias("answer"),
        typed("$.citation_ids", strings, "array<string>").alias("cited"),
        typed("$.missing_information", strings, "array<string>").alias("missing"),
        F.coalesce(F.array_contains(F.json_object_keys(text), "missing_information"), F.lit(False)).alias("has_missing"),
    )


def _broken(r: Column, citations: Column) -> Column:
    no = F.lit(False)
    known_type = F.coalesce(r["type"].isin("answer", "clarify", "abstain"), no)
    some = F.size(r["cited"]) > 0
    rules = (
        ("not_an_object", r["broken"]),
        ("response_type", ~known_type),
        ("answerable", r["flag"].isNull()),
        ("answer", F.coalesce(blank(r["answer"]), F.lit(True))),
        ("citations", r["cited"].isNull()),
        ("unknown_citation", F.coalesce(F.size(F.array_except(r["cited"], citations)) > 0, no)),
        ("repeated_citation", F.coalesce(F.size(F.array_distinct(r["cited"])) < F.size(r["cited"]), no)),
        ("answer_without_citation", F.coalesce((r["type"] == "answer") & (~r["flag"] | ~some), no)),
        ("citation_without_answer", F.coalesce(known_type & (r["type"] != "answer") & (r["flag"] | some), no)),
        ("missing_information", r["has_missing"] & r["missing"].isNull()),
    )
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def citation_id(rank: Column) -> Column:
    return F.format_string("C%03d", rank.cast("int"))


def cited_sources(results: DataFrame, citations: DataFrame) -> DataFrame:
    """(query_id, citation_id, ordinal, position): the cited results only, best score first, then by rank, whatever order they were
    cited in. results: query_id, ordinal, score, rank; citations: query_id, citation_ids."""
    from pyspark.sql import Window as W

    asked = citations.select("query_id", F.explode(F.array_distinct("citation_ids")).alias("citation_id"))
    hit = results.withColumn("citation_id", citation_id(F.col("rank"))).join(asked, ["query_id", "citation_id"])
    return hit.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "rank"))).select("query_id", "citation_id", "ordinal", "position")


def span_pages(spans: Column) -> Column:
    """struct(page_start, page_end), from 1, of source spans with a page_index from 0; both null if no span has one."""
    pages = F.transform(F.filter(F.transform(spans, lambda s: s["page_index"]), lambda p: p.isNotNull()), lambda p: p + 1)
    return F.struct(F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"))


def page_list(start: Column, end: Column) -> Column:
    """All pages from start to end; only the start if there is no sound end; none without a start."""
    none = F.array().cast("array<int>")
    return F.when(start.isNull(), none).when(end.isNotNull() & (end >= start), F.sequence(start, end)).otherwise(F.array(start))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def section_path(path: Column, title: Column, known: Column) -> Column:
    """The section's path, else its title alone, else nothing where there is no section."""
    return F.when(~known, F.array().cast("array<string>")).otherwise(F.coalesce(path, F.array(title)))


def public_sources(passages: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(chunk_id, document, pages, excerpt, section_path) of passages (chunk_id, doc_id, section_id, text, source_spans)."""
    d = documents.select("doc_id", F.col("title").alias("_t"), F.col("source_filename").alias("_f"))
    s = sections.select("section_id", F.col("path").alias("_p"), F.col("title").alias("_st"), F.lit(True).alias("_known"))
    j = passages.join(d, "doc_id", "left").join(s, "section_id", "left").withColumn("_pages", span_pages(F.col("source_spans")))
    return j.select("chunk_id", first_filled(F.col("_t"), F.col("_f"), F.col("doc_id")).alias("document"), page_list(F.col("_pages.page_start"), F.col("_pages.page_end")).alias("pages"), F.coalesce("text", F.lit("")).alias("excerpt"), section_path(F.col("_p"), F.col("_st"), F.coalesce("_known", F.lit(False))).alias("section_path"))


def provenance(passages: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Where each passage comes from, for internal use: chunk_id, document_id, document_title, filename, page_start, page_end,
    section_path, excerpt (the whole passage) and source_spans (block_id, page_index, start_char, end_char)."""
    d = documents.select("doc_id", F.col("title").alias("_t"), F.col("source_filename").alias("filename"))
    s = sections.select("section_id", F.col("path").alias("_p"), F.col("title").alias("_st"), F.lit(True).alias("_known"))
    j = passages.join(d, "doc_id", "left").join(s, "section_id", "left").withColumn("_pages", span_pages(F.col("source_spans")))
    spans = F.transform(F.coalesce("source_spans", F.array().cast(passages.schema["source_spans"].dataType)), lambda x: F.struct(x["block_id"].alias("block_id"), x["page_index"].alias("page_index"), x["source_start_char"].alias("start_char"), x["source_end_char"].alias("end_char")))
    return j.select("chunk_id", F.col("doc_id").alias("document_id"), F.coalesce("_t", "filename", "doc_id").alias("document_title"), "filename", "_pages.page_start", "_pages.page_end", section_path(F.col("_p"), F.col("_st"), F.coalesce("_known", F.lit(False))).alias("section_path"), F.coalesce("text", F.lit("")).alias("excerpt"), spans.alias("source_spans"))


def passage_contexts(results: DataFrame) -> DataFrame:
    """What the model is shown of each result (query_id, ordinal, rank, text): its citation id and the text's first PASSAGE_LIMIT
    code points. The cut is the feature: the public source keeps the whole text."""
    return results.select("query_id", citation_id(F.col("rank")).alias("citation_id"), "ordinal", F.substring("text", 1, PASSAGE_LIMIT).alias("text"))
