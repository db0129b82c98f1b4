"""The two whole pipelines: layout items to a corpus, and batches of requests to answers. Both are composed of the operators; the only
actions before the caller's own are the coverage gate and the counts that the search needs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella import plugins
from tessella.common import blank, durable
from tessella.functions import text as X
from tessella.operators import chunking, fusion, lexical, qa, recovery, structure
from tessella.operators import history as H


class CoverageError(ValueError):
    """Text of a block is in no passage."""


# Labels of pictures, and of items that only hold others; the kind of a block made of a native cell.
PICTURES = ("picture", "figure")
CONTAINERS = ("body", "group", "furniture")
RECOVERED = "native_pdf_text_recovery"


def _in_layout_order(items: DataFrame) -> DataFrame:
    """Items with parent_ref, numbered as the tree is walked: trees by their root's ordinal, orphans behind. An item without a layer
    has its root's. Containers are walked and left out."""
    mark = lambda ref: F.to_json(F.struct(F.col("doc_id").alias("d"), ref.alias("r")))
    marked = items.withColumn("_id", mark(F.col("ref")))
    parent = F.when(F.expr("nullif(parent_ref, '')").isNotNull(), mark(F.col("parent_ref")))
    order = structure.layout_order(marked.select(F.col("_id").alias("node_id"), parent.alias("parent_id"), "ordinal")).withColumnRenamed("node_id", "_id")
    root = marked.select(F.col("_id").alias("root_id"), F.col("ordinal").alias("_of_root"), F.col("layer").alias("_root_layer"))
    walked = marked.join(order, "_id").join(root, "root_id", "left").filter(~F.coalesce(F.col("label").isin(*CONTAINERS), F.lit(False)))
    at = W.partitionBy("doc_id").orderBy("orphan", F.col("_of_root").asc_nulls_last(), F.col("root_id"), "position", "ref")
    return walked.select(*[c for c in items.columns if c not in ("ordinal", "layer", "parent_ref")], F.coalesce("layer", "_root_layer").alias("layer"), F.row_number().over(at).cast("long").alias("ordinal"), F.col("orphan").alias("reading_order_unresolved"))


def _figures(blocks: DataFrame) -> DataFrame:
    """Pictures with the blocks of their captions, in the order in which they are stated."""
    pictures = blocks.filter(F.col("kind").isin(*PICTURES))
    stated = pictures.select("block_id", "doc_id", F.posexplode("caption_refs").alias("_at", "native_ref"))
    of = blocks.filter("not coalesce(kind = 'native_pdf_text_recovery', false)").select("doc_id", "native_ref", "ordinal", F.col("block_id").alias("_c"))
    captions = stated.join(of, ["doc_id", "native_ref"]).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("_at", "ordinal", "_c"))).alias("_cs")).select("block_id", F.transform("_cs", lambda c: c["_c"]).alias("caption_block_ids"))  # captions of one picture
    figure_id = X.stable_id("fig", (F.col("doc_id"), "string"), (F.col("native_ref"), "string"))
    return pictures.join(captions, "block_id", "left").select(figure_id.alias("figure_id"), "doc_id", "section_id", "block_id", "native_ref", "page_index", "caption_refs", F.coalesce("caption_block_ids", F.array().cast("array<string>")).alias("caption_block_ids"), F.lit("unreviewed").alias("visual_status"))


def build_corpus(documents: DataFrame, items: DataFrame, max_tokens: int = 384, encoder: plugins.Encoder | None = None, table_cells: DataFrame | None = None, native_cells: DataFrame | None = None) -> dict[str, DataFrame]:
    """documents, sections, blocks, figures, furniture, source_units, chunks and, with an encoder, vectors and, with native cells, native_cells
    (their status).

    documents: doc_id, title, source_filename. items: doc_id, ordinal, ref, label, level, text, page_index, layer, in reading order or, with
    a parent_ref, in the order of the children of one parent; further caption_refs (array<string>) and item_box (struct<l,t,r,b>), which native
    cells need. table_cells: doc_id, ref (of the table), cell_index, row, col, text; a table that has some comes as its rows. native_cells:
    doc_id, page_index, cell_ref, text, rendering_mode, cell_box; those that the layout lacks become blocks at the end of their section.
    Items and cells of a document that is not given, and table cells without their table, are errors.
    Passages never cross sections and hold every character of the content blocks; otherwise CoverageError is raised.
    """
    for name, part in (("item", items), ("table cell", table_cells), ("native cell", native_cells)):
        if part is not None and (lost := part.select("doc_id").join(documents.select("doc_id"), "doc_id", "left_anti").head()) is not None:
            raise ValueError(f"{name} of a document that is not given: {lost['doc_id']}")
    if table_cells is not None and (lost := table_cells.join(items.filter("label = 'table'").select("doc_id", "ref"), ["doc_id", "ref"], "left_anti").head()) is not None:
        raise ValueError(f"cell of a table that is not given: {lost['ref']}")
    if native_cells is not None and "item_box" not in items.columns:
        raise ValueError("native cells need the items' boxes")
    if "parent_ref" in items.columns:
        items = durable(_in_layout_order(items))
    for name, kind in (("caption_refs", "array<string>"), ("item_box", "struct<l:double,t:double,r:double,b:double>"), ("reading_order_unresolved", "boolean")):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(False if kind == "boolean" else None).cast(kind))
    items = items.join(documents.select("doc_id", F.col("title").alias("doc_title")), "doc_id")
    aside = structure.is_furniture(F.col("layer"), F.col("label"))
    body = items.filter(~aside)
    scan = durable(structure.section_scan(body))
    key = lambda ref: F.when(ref == F.col("doc_id"), X.stable_id("sec", (F.col("doc_id"), "string"))).otherwise(X.stable_id("sec", (F.col("doc_id"), "string"), (ref, "string")))
    roots = documents.select("doc_id", X.stable_id("sec", (F.col("doc_id"), "string")).alias("section_id"), F.lit(None).cast("string").alias("parent_id"), F.coalesce("title", "doc_id").alias("title"), F.array(F.coalesce("title", "doc_id")).alias("path"), F.lit(0).alias("level"), F.lit(-1).cast("long").alias("place"))
    headed = scan.filter("is_section").select("doc_id", key(F.col("ref")).alias("section_id"), key(F.col("parent_ref")).alias("parent_id"), "title", "path", "level", F.col("ordinal").alias("place"))
    sections = roots.unionByName(headed)
    placed = body.join(scan.select("doc_id", "ref", key(F.col("section_ref")).alias("section_id")), ["doc_id", "ref"])
    placed = placed.withColumn("kind", F.col("label")).withColumn("row_index", F.lit(None).cast("int")).withColumn("cell_spans", F.lit(None).cast("array<struct<cell_index:int,start_char:int,end_char:int>>"))
    if table_cells is not None:
        named = table_cells.withColumn("table_ref", F.to_json(F.struct("doc_id", "ref")))
        rows = structure.table_rows(named).join(named.select("table_ref", "doc_id", "ref").distinct(), "table_ref").select("doc_id", "ref", F.col("row_index").alias("_row"), F.col("text").alias("_text"), F.col("cell_spans").alias("_spans"))
        by_row, is_row = placed.join(rows, ["doc_id", "ref"], "left"), F.col("_row").isNotNull()
        placed = by_row.withColumns({"kind": F.when(is_row, "table_row").otherwise(F.col("kind")), "text": F.when(is_row, F.col("_text")).otherwise(F.col("text")), "row_index": F.col("_row").cast("int"), "cell_spans": F.col("_spans")}).drop("_row", "_text", "_spans")
    text_id = [(F.col("doc_id"), "string"), (F.col("ref"), "string"), (F.col("text"), "string")]
    block_id = F.when(F.col("row_index").isNull(), X.stable_id("blk", *text_id)).otherwise(X.stable_id("blk", *text_id[:2], (F.col("row_index"), "number"), text_id[2]))
    blocks = durable(placed.select(block_id.alias("block_id"), "doc_id", "section_id", "ordinal", "text", "page_index", "kind", F.col("ref").alias("native_ref"), "row_index", "cell_spans", "caption_refs", "reading_order_unresolved", "item_box"))
    if native_cells is not None:
        shown = blocks.select("doc_id", "page_index", F.col("block_id").alias("item_ref"), F.struct("ordinal", F.coalesce("row_index", F.lit(0)).alias("row")).alias("item_order"), "text", "section_id", "item_box")
        beside = items.filter(aside).select("doc_id", "page_index", F.col("ref").alias("item_ref"), F.struct("ordinal", F.lit(0).alias("row")).alias("item_order"), "text", F.lit(None).cast("string").alias("section_id"), "item_box")
        statuses = durable(recovery.cell_status(native_cells, shown.unionByName(beside)))
        found = native_cells.join(statuses.filter("status = 'recovered'").select("doc_id", "page_index", "cell_ref", "section_id"), ["doc_id", "page_index", "cell_ref"])
        made = found.select(X.stable_id("blk", (F.col("doc_id"), "string"), (F.col("page_index"), "number"), (F.col("cell_ref"), "string"), (F.col("text"), "string")).alias("block_id"), "doc_id", F.coalesce("section_id", key(F.col("doc_id"))).alias("section_id"), "text", "page_index", F.lit(RECOVERED).alias("kind"), F.col("cell_ref").alias("native_ref"), F.lit(True).alias("reading_order_unresolved"), F.col("cell_box").alias("item_box"))
        blocks = blocks.unionByName(made, allowMissingColumns=True)
    if table_cells is not None or native_cells is not None:  # rows and recovered cells have places of their own
        order = W.partitionBy("doc_id").orderBy(F.col("ordinal").asc_nulls_last(), "native_ref", "row_index", "page_index", "block_id")
        blocks = blocks.withColumn("ordinal", F.row_number().over(order).cast("long"))
    blocks = durable(blocks)
    content = blocks.filter(~blank("text"))
    whole = F.array(F.struct(F.lit(0).alias("start_char"), F.length("text").alias("end_char")))
    spans = content.select("*", F.explode(F.when(F.col("kind") == "table_row", whole).otherwise(X.sentences_of(F.col("text")))).alias("_s")).select("*", F.col("_s.start_char").alias("source_start_char"), F.col("_s.end_char").alias("source_end_char"))
    units = spans.select(X.stable_id("su", (F.col("block_id"), "string"), (F.col("source_start_char"), "number"), (F.col("source_end_char"), "number")).alias("source_unit_id"), "doc_id", "section_id", "block_id", "page_index", "source_start_char", "source_end_char", F.expr("substring(text, source_start_char + 1, source_end_char - source_start_char)").alias("text"), "kind")
    named = sections.select("section_id", "doc_id", "path")
    pieces = durable(chunking.budget_chunks(chunking.section_texts(content).join(named, "section_id"), max_tokens))
    if (bad := pieces.filter("piece < 0").head()) is not None:
        raise ValueError(f"the path of section {bad['section_id']} leaves no room for text")
    cut = pieces.join(named, "section_id")
    at = chunking.canonical_offsets(content).withColumnRenamed("start_char", "_b0").withColumnRenamed("end_char", "_b1").select("section_id", "block_id", F.col("_b0").alias("start_char"), F.col("_b1").alias("end_char"), F.col("_b0").alias("block_start"))
    sources = chunking.span_intersections(at, pieces.select("section_id", "piece", "start_char", "end_char", F.col("start_char").alias("piece_start")), "section_id").join(content.select("block_id", "page_index"), "block_id")
    span = F.struct(F.col("start_char").alias("_o"), "block_id", "page_index", (F.col("start_char") - F.col("block_start")).cast("int").alias("source_start_char"), (F.col("end_char") - F.col("block_start")).cast("int").alias("source_end_char"), (F.col("start_char") - F.col("piece_start")).cast("int").alias("chunk_start_char"), (F.col("end_char") - F.col("piece_start")).cast("int").alias("chunk_end_char"))
    of_piece = sources.groupBy("section_id", "piece").agg(F.array_sort(F.collect_list(span)).alias("_spans"))  # the blocks of one passage
    spans_of = F.transform("_spans", lambda s: s.dropFields("_o"))
    titled = cut.join(of_piece, ["section_id", "piece"]).join(documents.select("doc_id", "title", "source_filename"), "doc_id")
    chunks = titled.select(
        X.stable_id("chk", (F.col("section_id"), "string"), (F.col("piece"), "number"), (F.col("text"), "string")).alias("chunk_id"), "doc_id", "section_id", "piece", "text", X.retrieval_text(F.col("title"), F.col("source_filename"), F.col("path"), F.col("text")).alias("retrieval_text"),
        X.embedding_text(F.col("path"), F.col("text")).alias("embedding_text"), F.col("tokens").alias("token_count"), F.lit(max_tokens).alias("max_tokens"), spans_of.alias("source_spans"),
    )
    chunks = durable(chunks)
    covered = chunks.select(F.explode("source_spans").alias("s")).select(F.col("s.block_id").alias("block_id"), F.col("s.source_start_char").alias("start_char"), F.col("s.source_end_char").alias("end_char"))
    if (gap := chunking.coverage_gaps(content.select("block_id", "text"), covered).head()) is not None:
        raise CoverageError(f"block {gap['block_id']}: text from {gap['from_char']} to {gap['to_char']} is in no passage")
    out = {"documents": documents, "sections": sections, "blocks": blocks, "figures": _figures(blocks), "furniture": items.filter(aside).drop("doc_title"), "source_units": units, "chunks": chunks}
    if native_cells is not None:
        out["native_cells"] = statuses
    if encoder is not None:
        out["vectors"] = plugins.encode(chunks.select("chunk_id", "embedding_text"), "embedding_text", encoder).select("chunk_id", "vector", "vector_fault")
    return out


# What is asked back; how many of a reply's missing points are kept.
CLARIFY, MISSING = "Which unit or step do you mean?", 3
TRACE = "request_id bigint, rewrite_triggered boolean, rewrite_succeeded boolean, rewrite_query string, rewrite_calls int, answer_calls int, retrieved_documents array<string>, retrieved_chunks array<struct<rank:int,chunk_id:string,doc_id:string,score:double,component_scores:map<string,double>,text:string,source_spans:array<struct<block_id:string,page_index:int,source_start_char:int,source_end_char:int,chunk_start_char:int,chunk_end_char:int>>>>, response_type string, answerable boolean, generated_answer string, missing_information array<string>, final_k int"


def answer_batch(requests: DataFrame, corpus: Mapping[str, DataFrame] | None, encoder: plugins.Encoder | None, generator: plugins.Generator | None, rewriter: Callable[[str, str], str | None] | None = None, mode: str = "conditional", final_k: int = 5, clarify: str = CLARIFY) -> DataFrame:
    """The responses alone of answers()."""
    return answers(requests, corpus, encoder, generator, rewriter, mode, final_k, clarify)["responses"]


def answers(requests: DataFrame, corpus: Mapping[str, DataFrame] | None, encoder: plugins.Encoder | None, generator: plugins.Generator | None, rewriter: Callable[[str, str], str | None] | None = None, mode: str = "conditional", final_k: int = 5, clarify: str = CLARIFY) -> dict[str, DataFrame]:
    """responses (request_id, conversation_id, status, response_type, answer, sources) and traces of request bodies (request_id bigint, body).

    corpus: chunks with a bigint ordinal (chunk_id, doc_id, section_id, text, retrieval_text, source_spans), vectors (chunk_id, vector),
    documents and sections. status: 200, 422 for a body with a fault, 502 where the model's reply is unusable after its repair or the
    question is too long for the encoder, 503 for a sound body while corpus, encoder or generator is not there. `rewriter` gets question
    and history and gives a question, or None.

    traces has a row for each request that was answered or asked back: request_id, rewrite_triggered, rewrite_succeeded, rewrite_query,
    rewrite_calls, answer_calls, retrieved_documents (titles by rank), retrieved_chunks (rank, chunk_id, doc_id, score, component_scores, text,
    source_spans), response_type, answerable, generated_answer, missing_information (three at most) and final_k. Durations belong to a
    service and are left out of a batch.
    """
    if not 1 <= final_k <= 20:
        raise ValueError("final_k must be within 1..20")
    v = F.try_parse_json("body")
    fault = qa.request_fault(F.col("body"))
    judged = durable(requests.select("request_id", "body").withColumn("fault", fault).withColumn("conversation_id", F.when(F.col("fault").isNull(), F.try_variant_get(v, "$.conversation_id", "bigint"))))
    none = F.array().cast("array<struct<document:string,pages:array<int>,excerpt:string>>")
    row = lambda d, status, kind, text: d.select("request_id", F.lit(status).alias("status"), F.lit(kind).cast("string").alias("response_type"), text.cast("string").alias("answer"), none.alias("sources"))
    named = lambda d: d.join(judged.select("request_id", "conversation_id"), "request_id").select("request_id", "conversation_id", "status", "response_type", "answer", "sources")
    unsound = row(judged.filter("fault is not null"), 422, None, F.col("fault"))
    if corpus is None or encoder is None or generator is None:
        waiting = row(judged.filter("fault is null"), 503, None, F.lit("not_ready"))
        return {"responses": named(unsound.unionByName(waiting)), "traces": requests.sparkSession.createDataFrame([], TRACE)}
    item = F.transform(F.try_variant_get(v, "$.context", "array<variant>"), lambda x: F.struct(X.strip(F.variant_get(x, "$.Q", "string")).alias("q"), X.strip(F.variant_get(x, "$.A", "string")).alias("a")))
    sound = judged.filter("fault is null").select("request_id", X.strip(F.variant_get(v, "$.question", "string")).alias("question"), H.answered(H.pairs(item)).alias("history"))
    asks = F.lit(mode == "conditional") & X.has_back_reference(F.col("question")) & (F.size("history") > 0)
    sound = sound.withColumn("_said", F.when(asks, H.rewrite_history(F.col("history"))))
    schema = sound.select("*", F.lit(None).cast("string").alias("rewrite")).drop("history").schema
    flat = sound.drop("history")

    def rewrite(it):  # noqa: ANN001, ANN202
        for pdf in it:
            yield pdf.assign(rewrite=[rewriter(q, s) if rewriter and s is not None else None for q, s in zip(pdf["question"], pdf["_said"], strict=True)])

    routed = sound.drop("_said", "question").join(flat.mapInPandas(rewrite, schema), "request_id")
    routed = durable(routed.withColumn("route", qa.route(F.col("history"), F.col("question"), F.col("rewrite"), mode)).withColumn("rewrite", X.strip(F.col("rewrite"))))
    searched = F.when(F.col("route") == "search_with_history", H.retrieval_query(F.col("history"), F.col("question"))).otherwise(F.col("question"))
    query = lambda c, rows: rows.select(F.col("request_id").alias("query_id"), c.alias("text"))
    plain, twice = routed.filter("route in ('search', 'search_with_history')"), routed.filter("route = 'search_with_rewrite'")
    q, q1, q2 = query(searched, plain), query(F.col("question"), twice), query(F.col("rewrite"), twice)
    encoded = lambda d: durable(plugins.encode(d, "text", encoder, "query: "))
    e, e1, e2 = encoded(q), encoded(q1), encoded(q2)
    chunks = corpus["chunks"]
    terms = lexical.query_terms(q.unionByName(q1).unionByName(q2))
    index = lexical.build_index(chunks.select("ordinal", X.indexed_text(F.col("retrieval_text"), F.col("text")).alias("text")), terms)
    vectors = corpus["vectors"].join(chunks.select("chunk_id", "ordinal"), "chunk_id").select("ordinal", "vector")
    ranked = fusion.hybrid_search(index, vectors, q, e, final_k=final_k).unionByName(fusion.hybrid_search_with_rewrite(index, vectors, (q1, e1), (q2, e2), final_k=final_k))
    found = durable(ranked.join(chunks.select("ordinal", "chunk_id", "doc_id", "section_id", "text", "source_spans"), "ordinal"))
    contexts = qa.passage_contexts(found).join(found.select("query_id", "ordinal", "rank"), ["query_id", "ordinal"])
    shown = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "citation_id", "text"))).alias("_c"))  # final_k rows
    refused = e.unionByName(e1).unionByName(e2).filter("vector_fault is not null").select(F.col("query_id").alias("request_id"), F.lit(True).alias("_refused")).distinct()
    rows = routed.join(shown.withColumnRenamed("query_id", "request_id"), "request_id", "left").join(refused, "request_id", "left")
    prompt = F.to_json(F.struct("question", H.answer_history(F.col("history")).alias("history"), F.transform("_c", lambda c: F.struct(c["citation_id"], c["text"])).alias("passages")))
    asked = rows.filter("route <> 'clarify' and _refused is null").select("request_id", prompt.alias("prompt"), F.transform(F.coalesce("_c", F.array().cast("array<struct<rank:int,citation_id:string,text:string>>")), lambda c: c["citation_id"]).alias("ids"))
    replied = durable(plugins.generate(asked, "prompt", "ids", generator).withColumn("_v", X.llm_object(F.col("reply"))))
    ok = replied.filter("size(reply_faults) = 0").select("request_id", "reply_calls", F.from_json("_v", "response_type string, answerable boolean, answer string, citation_ids array<string>, missing_information array<string>").alias("r")).select("request_id", "reply_calls", "r.*")
    cited = qa.cited_sources(found, ok.filter("response_type = 'answer'").select(F.col("request_id").alias("query_id"), "citation_ids"))
    sources = qa.public_sources(found.select("chunk_id", "doc_id", "section_id", "text", "source_spans").dropDuplicates(["chunk_id"]), corpus["documents"], corpus["sections"])
    listed = cited.join(chunks.select("ordinal", "chunk_id"), "ordinal").join(sources, "chunk_id").groupBy(F.col("query_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("position", "document", "pages", "excerpt"))).alias("_s"))
    given = ok.join(listed, "request_id", "left").select("request_id", F.lit(200).alias("status"), "response_type", F.when(F.col("response_type") == "abstain", H.NON_ANSWER).otherwise(X.strip(F.col("answer"))).alias("answer"), F.coalesce(F.transform("_s", lambda s: F.struct(s["document"].alias("document"), s["pages"].alias("pages"), s["excerpt"].alias("excerpt"))), none).alias("sources"))
    asked_back = row(routed.filter("route = 'clarify'"), 200, "clarify", F.lit(clarify))
    failed = row(replied.filter("size(reply_faults) > 0"), 502, None, F.array_join("reply_faults", ","))
    too_long = row(rows.filter("_refused and route <> 'clarify'"), 502, None, F.lit("question_not_encoded"))
    responses = named(given.unionByName(asked_back).unionByName(failed).unionByName(too_long).unionByName(unsound))

    titles = corpus["documents"].select("doc_id", F.col("title").alias("_title"))
    listed = found.join(titles, "doc_id", "left").groupBy(F.col("query_id").alias("request_id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("_title", "doc_id").alias("title"), F.struct("chunk_id", "doc_id", "score", "components", "text", "source_spans").alias("c"))), lambda x, y: x["rank"] - y["rank"]).alias("_r"))  # final_k rows
    of_rank = F.coalesce("_r", F.array().cast(listed.schema["_r"].dataType))
    told = routed.select("request_id", "route", "rewrite", (F.col("route").isin("clarify", "search_with_rewrite")).alias("_refers")).join(flat.select("request_id", F.col("_said").isNotNull().alias("_asked")), "request_id")
    reply = ok.select("request_id", F.col("reply_calls").alias("answer_calls"), F.col("response_type"), "answerable", F.col("answer").alias("generated_answer"), F.slice(F.coalesce("missing_information", F.array().cast("array<string>")), 1, MISSING).alias("missing_information"))
    back = told.filter("route = 'clarify'").select("request_id", F.lit(0).alias("answer_calls"), F.lit("clarify").alias("response_type"), F.lit(False).alias("answerable"), F.lit(clarify).alias("generated_answer"), F.array().cast("array<string>").alias("missing_information"))
    every = told.join(reply.unionByName(back), "request_id").join(listed, "request_id", "left")
    succeeded = F.coalesce(F.col("rewrite") != "", F.lit(False))
    traces = every.select("request_id", F.col("_refers").alias("rewrite_triggered"), succeeded.alias("rewrite_succeeded"), F.when(succeeded, F.col("rewrite")).alias("rewrite_query"), F.when(F.col("_asked") & F.lit(rewriter is not None), 1).otherwise(0).alias("rewrite_calls"), "answer_calls", F.transform(of_rank, lambda x: x["title"]).alias("retrieved_documents"), F.transform(of_rank, lambda x: F.struct(x["rank"].alias("rank"), *(x["c"][c].alias(c) for c in ("chunk_id", "doc_id", "score")), x["c"]["components"].alias("component_scores"), x["c"]["text"].alias("text"), x["c"]["source_spans"].alias("source_spans"))).alias("retrieved_chunks"), "response_type", "answerable", "generated_answer", "missing_information", F.lit(final_k).alias("final_k"))
    return {"responses": responses, "traces": traces}
