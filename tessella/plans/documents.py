"""Queries on document structure, units and passages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.common import blank, latest, table
from tessella.functions import text as X
from tessella.operators import chunking as C
from tessella.operators import structure as S
from tessella.operators import tree
from tessella.plans.hierarchy import _VALID


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "blocks"), "block_id", "ingested_at", "doc_id", "section_id", "ordinal", "text", "page_index", "kind", "content_layer")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "source_units"), "source_unit_id", "ingested_at", "doc_id", "block_id", "source_start_char", "source_end_char")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "chunks"), "chunk_id", "ingested_at", "section_id", "text", "source_spans")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout items: the blocks in order; a heading's level is 1 to 3 by its ordinal, as blocks carry none."""
    b = _blocks(spark, sf_dir)
    docs = latest(table(spark, sf_dir, "bundle_documents"), "doc_id", "registered_at", "title").select("doc_id", F.col("title").alias("doc_title"))
    return b.join(docs, "doc_id", "left").select("doc_id", "doc_title", "ordinal", F.col("block_id").alias("ref"), F.col("kind").alias("label"), (1 + F.col("ordinal") % 3).cast("int").alias("level"), "text")


def layout_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tree.valid_sections(table(spark, sf_dir, "sections"))
    return S.layout_order(s.select(F.col("section_id").alias("node_id"), "parent_id", "ordinal"))


def furniture_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.is_furniture(F.col("content_layer"), F.col("kind"))
    return _blocks(spark, sf_dir).groupBy("doc_id").agg(F.count_if(f).alias("furniture"), F.count_if(~f).alias("body"))


def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.section_scan(_items(spark, sf_dir)).filter("is_section").select("ref", "parent_ref", "title", "level", F.size("path").alias("depth"))


def block_section_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.section_scan(_items(spark, sf_dir)).select("ref", "section_ref")


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by manual, retitled as parts of three: runs of three in order share a title."""
    h = _blocks(spark, sf_dir).filter("kind = 'heading'").select("doc_id", "block_id", "ordinal")
    return h.select("doc_id", "ordinal", F.col("block_id").alias("ref"), F.lit(1).alias("level"), F.concat(F.lit("Part "), F.floor(F.col("ordinal") / 60).cast("string"), F.lit(" ("), (1 + F.col("ordinal") % 3).cast("string"), F.lit("/3)")).alias("text"))


def continuation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _parted(spark, sf_dir).select("ref", "text").unionByName(_blocks(spark, sf_dir).filter("kind = 'heading'").select(F.concat(F.lit("own_"), "block_id").alias("ref"), "text"))
    p = X.continuation_parts(F.col("text"))
    return h.select("ref", p["base"].alias("base"), p["part"].alias("part"), p["total"].alias("total"))


def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.continuations(_parted(spark, sf_dir)).select("ref", "goes_on")


def table_row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows are taken apart into cells and put together again."""
    rows = _blocks(spark, sf_dir).filter("kind = 'table_row' and text is not null")
    cells = rows.select(F.col("block_id").alias("table_ref"), F.col("ordinal").alias("row"), F.posexplode(F.split("text", r" \| ")).alias("col", "text")).withColumn("cell_index", F.col("col"))
    t = S.table_rows(cells)
    return t.select("table_ref", "row_index", "text", F.array_join(F.transform("cell_spans", lambda x: F.concat_ws("-", x["start_char"].cast("string"), x["end_char"].cast("string"))), ",").alias("spans"))


def section_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the blocks of every sound section and of all below it."""
    sound = tree.section_trees(table(spark, sf_dir, "sections")).filter("root_id is not null")
    return S.section_pages(sound.select("section_id", "parent_id"), _blocks(spark, sf_dir).select("section_id", "page_index"))


def section_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.section_trees(table(spark, sf_dir, "sections")).filter("root_id is not null").select("section_id", "descendants")


def section_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = tree.descendant_pairs(tree.section_trees(table(spark, sf_dir, "sections")))
    return pairs.groupBy(F.col("descendant_id").alias("section_id")).agg(F.count("*").alias("ancestors"), F.min("section_id").alias("first_ancestor"))


def tree_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_kind, record_id, fault): references that do not hold."""
    s = tree.valid_sections(table(spark, sf_dir, "sections")).withColumn("parent_id", F.expr("nullif(parent_id, '')"))
    d = table(spark, sf_dir, "bundle_documents").select("doc_id").distinct()
    p = s.select(F.col("section_id").alias("parent_id"), F.col("doc_id").alias("_pdoc"), F.lit(True).alias("_known"))
    unknown = s.join(d, "doc_id", "left_anti").select(F.lit("section").alias("record_kind"), F.col("section_id").alias("record_id"), F.lit("unknown_document").alias("fault"))
    j = s.filter("parent_id is not null").join(p, "parent_id", "left")
    parent = j.select(F.lit("section").alias("record_kind"), F.col("section_id").alias("record_id"), F.when(F.col("_known").isNull(), "unknown_parent").when(~F.col("_pdoc").eqNullSafe(F.col("doc_id")), "parent_of_other_document").alias("fault"))
    c = latest(table(spark, sf_dir, "chunks"), "chunk_id", "ingested_at", "doc_id", "section_id").join(s.select("section_id", F.col("doc_id").alias("_sdoc"), F.lit(True).alias("_known")), "section_id", "left")
    chunk = c.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), F.when(F.col("_known").isNull(), "unknown_section").when(~F.col("_sdoc").eqNullSafe(F.col("doc_id")), "section_of_other_document").alias("fault"))
    return unknown.unionByName(parent).unionByName(chunk).filter("fault is not null")


def parse_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_audit(_blocks(spark, sf_dir), _units(spark, sf_dir))


def low_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.low_text_pages(_blocks(spark, sf_dir)).select("doc_id", "pages", F.array_join(F.col("low_text_pages").cast("array<string>"), ",").alias("low_text_pages"))


def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conservative sentences of every content block; a table row is one unit."""
    b = _blocks(spark, sf_dir).filter(~blank("text"))
    whole = F.array(F.struct(F.lit(0).alias("start_char"), F.length("text").alias("end_char")))
    spans = F.when(F.col("kind") == "table_row", whole).otherwise(X.sentences_of(F.col("text")))
    u = b.select("block_id", F.explode(spans).alias("s"), "text").select("block_id", F.col("s.start_char").alias("start_char"), F.col("s.end_char").alias("end_char"), "text")
    text = F.expr("substring(text, start_char + 1, end_char - start_char)")
    return u.select(X.stable_id("su", (F.col("block_id"), "string"), (F.col("start_char"), "number"), (F.col("end_char"), "number")).alias("source_unit_id"), "block_id", "start_char", "end_char", F.md5(text).alias("text_md5"))


def coverage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    return b.select("block_id", F.md5(X.coverage_text(F.col("text"), True)).alias("form_md5"))


def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.stable_id("blk", (F.col("doc_id"), "number"), (F.col("source"), "string"), (F.col("source_filename"), "string")).alias("stable_id"))


def canonical_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.canonical_offsets(_blocks(spark, sf_dir))


def span_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source units each passage holds, and what of them."""
    spans = _chunks(spark, sf_dir).select("chunk_id", F.explode("source_spans").alias("s")).select("chunk_id", F.col("s.block_id").alias("block_id"), F.col("s.source_start_char").alias("start_char"), F.col("s.source_end_char").alias("end_char"))
    units = _units(spark, sf_dir).select("source_unit_id", "block_id", F.col("source_start_char").alias("start_char"), F.col("source_end_char").alias("end_char"))
    return C.span_intersections(spans, units, "block_id").select("chunk_id", "source_unit_id", "start_char", "end_char")


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of blocks with text that no passage covers."""
    b = _blocks(spark, sf_dir).filter(C.is_content(F.lit(None).cast("string"), F.col("text"))).select("block_id", "text")
    spans = _chunks(spark, sf_dir).select(F.explode("source_spans").alias("s")).select(F.col("s.block_id").alias("block_id"), F.col("s.source_start_char").alias("start_char"), F.col("s.source_end_char").alias("end_char"))
    return C.coverage_gaps(b, spans.join(b.select("block_id"), "block_id", "left_semi"))


def budget_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the configuration's default budget; sections whose path alone fills it come out as refused (piece -1)."""
    texts = C.section_texts(_blocks(spark, sf_dir).filter(~blank("text")).select("section_id", "block_id", "ordinal", "text"))
    paths = tree.valid_sections(table(spark, sf_dir, "sections")).select("section_id", "path")
    return C.budget_chunks(texts.join(paths, "section_id", "left"), 384).drop("text")


def align_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's lines, with their blanks collapsed, found again in its text."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+", " "))
    return C.aligned(_chunks(spark, sf_dir).filter("text is not null").select(F.col("chunk_id").alias("key"), "text", lines.alias("segments"))).withColumnRenamed("key", "chunk_id")


_BL = "b AS (SELECT * FROM blocks WHERE block_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY ingested_at DESC) = 1)"
_CH = "c AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1)"
_UN = "u AS (SELECT * FROM source_units WHERE source_unit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_unit_id ORDER BY ingested_at DESC) = 1)"
_S = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_HEADS = f"{_BL}, h AS (SELECT doc_id, block_id AS ref, ordinal, 1 + ordinal % 3 AS level, coalesce(text, '') AS text FROM b WHERE kind = 'heading'), par AS (SELECT h.ref, max_by(p.ref, struct_pack(o := p.ordinal, r := p.ref)) AS parent_ref FROM h JOIN h p ON p.doc_id = h.doc_id AND (p.ordinal < h.ordinal OR p.ordinal = h.ordinal AND p.ref < h.ref) AND p.level < h.level GROUP BY 1)"
_PART = "'Part ' || floor(ordinal / 60)::INT || ' (' || (1 + ordinal % 3) || '/3)'"
_FURN = "(coalesce(content_layer = 'furniture', false) OR coalesce(kind IN ('page_header', 'page_footer'), false))"
_CONT = r"([0-9]+)\s*/\s*([0-9]+)\s*\)?$"
_SHORT = "|".join(x.replace(".", r"\.") for x in X.ABBREVIATIONS)
_MASK = rf"regexp_replace({{}}, '(^|[^\p{{{{L}}}}\p{{{{M}}}}\p{{{{N}}}}_])({_SHORT}|[A-Z])\.', '\1\2' || chr(65534), 'g')"
_WS = _S.replace(r"\x1c-\x1f", "")

SQL = {
    "sentence_units": rf"""WITH {_BL}, t AS (SELECT block_id, kind, text FROM b WHERE text IS NOT NULL AND regexp_matches(text, '[^{_S}]')),
p AS (SELECT block_id, string_split(regexp_replace({_MASK.format(_MASK.format("text"))}, '([.!?]["'')\]]*[{_WS}]+|[。！？])', '\1' || chr(65535), 'g'), chr(65535)) AS p FROM t WHERE kind IS DISTINCT FROM 'table_row'),
o AS (SELECT block_id, k, p[k] AS part, coalesce(list_sum(list_transform(p[:k - 1], lambda x: length(x))), 0) AS shift FROM p, unnest(range(1, len(p) + 1)) u(k)),
q AS (SELECT *, regexp_replace(part, '^[{_S}]+|[{_S}]+$', '', 'g') AS body, length(part) - length(regexp_replace(part, '^[{_S}]+', '')) AS skipped FROM o),
g AS (SELECT *, coalesce(lag(regexp_matches(body, '[。！？]$')) OVER w, true) OR regexp_matches(body, '^[A-Z0-9\x{{4e00}}-\x{{9fff}}]') AS begins FROM q WHERE body <> '' WINDOW w AS (PARTITION BY block_id ORDER BY k)),
n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY block_id ORDER BY k) AS n FROM g),
s AS (SELECT block_id, min(shift + skipped)::BIGINT AS start_char, max(shift + skipped + length(body))::BIGINT AS end_char FROM n GROUP BY block_id, n UNION ALL SELECT block_id, 0, length(text) FROM t WHERE kind = 'table_row')
SELECT 'su_' || substring(sha256('[' || to_json(block_id)::VARCHAR || ',' || start_char || ',' || end_char || ']'), 1, 24) AS source_unit_id, block_id, start_char, end_char, md5(text[start_char + 1:end_char]) AS text_md5 FROM s JOIN t USING (block_id)""",
    "align_segments": f"""WITH {_CH}, p AS (SELECT chunk_id, string_split(text, chr(10)) AS p FROM c WHERE text IS NOT NULL),
o AS (SELECT chunk_id, k, p[k] AS line, coalesce(list_sum(list_transform(p[:k - 1], lambda x: length(x) + 1)), 0) AS shift FROM p, unnest(range(1, len(p) + 1)) u(k)),
q AS (SELECT *, regexp_replace(line, '^[{_S}]+', '') AS left_off, regexp_replace(line, '[{_S}]+$', '') AS right_off FROM o)
SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY k) - 1 AS position, shift + length(line) - length(left_off) AS start_char, shift + length(right_off) AS end_char FROM q WHERE left_off <> ''""",
    "layout_preorder": f"""WITH RECURSIVE {_VALID}, o AS (SELECT section_id, any_value(ordinal) AS ordinal FROM (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY written_at DESC) = 1) GROUP BY 1),
w AS (SELECT v.section_id AS id, v.section_id AS root, [struct_pack(a := o.ordinal, b := v.section_id)] AS key, v.parent_id IS NOT NULL AS orphan FROM v JOIN o USING (section_id) WHERE v.parent_id IS NULL OR v.parent_id NOT IN (SELECT section_id FROM v)
  UNION ALL SELECT v.section_id, w.root, list_append(w.key, struct_pack(a := o.ordinal, b := v.section_id)), w.orphan FROM w JOIN v ON v.parent_id = w.id JOIN o ON o.section_id = v.section_id),
l AS (SELECT * FROM w UNION ALL SELECT section_id, NULL, [struct_pack(a := o.ordinal, b := section_id)], true FROM o WHERE section_id NOT IN (SELECT id FROM w))
SELECT id AS node_id, root AS root_id, row_number() OVER (PARTITION BY root ORDER BY key) - 1 AS position, orphan FROM l""",
    "furniture_split": f"WITH {_BL} SELECT doc_id, count(*) FILTER ({_FURN}) AS furniture, count(*) FILTER (NOT {_FURN}) AS body FROM b GROUP BY 1",
    "section_tree": f"""WITH RECURSIVE {_HEADS}, up AS (SELECT h.ref, h.ref AS at, 1 AS n FROM h UNION ALL SELECT up.ref, par.parent_ref, n + 1 FROM up JOIN par ON par.ref = up.at), dep AS (SELECT ref, max(n) AS n FROM up GROUP BY 1)
SELECT h.ref, coalesce(par.parent_ref, doc_id) AS parent_ref, text AS title, level::INT AS level, dep.n + 1 AS depth FROM h LEFT JOIN par USING (ref) JOIN dep USING (ref)""",
    "block_section_assign": f"WITH {_BL} SELECT block_id AS ref, coalesce(last_value(CASE WHEN kind = 'heading' THEN block_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal, block_id ROWS UNBOUNDED PRECEDING), doc_id) AS section_ref FROM b",
    "continuation_parse": f"""WITH {_BL}, h AS (SELECT block_id AS ref, {_PART} AS text FROM b WHERE kind = 'heading' UNION ALL SELECT 'own_' || block_id, text FROM b WHERE kind = 'heading'),
t AS (SELECT ref, regexp_replace(text, '^[{_S}]+|[{_S}]+$', '', 'g') AS t FROM h), q AS (SELECT ref, regexp_extract(t, '{_CONT}', ['part', 'total']) AS q, rtrim(regexp_replace(t, '{_CONT}', '')) AS rest FROM t),
p AS (SELECT ref, struct_pack(base := CASE WHEN rest LIKE '%(' THEN trim(rest[:-2]) ELSE rest END, part := q.part, total := q.total) AS p FROM q)
SELECT ref, CASE WHEN ok THEN p.base END AS base, CASE WHEN ok THEN part END AS part, CASE WHEN ok THEN total END AS total FROM (SELECT *, try_cast(p.part AS INT) AS part, try_cast(p.total AS INT) AS total, coalesce(p.base <> '' AND try_cast(p.part AS INT) BETWEEN 1 AND try_cast(p.total AS INT), false) AS ok FROM p)""",
    "continuation_merge": f"""WITH {_BL}, h AS (SELECT block_id AS ref, doc_id, floor(ordinal / 60) AS base, 1 + ordinal % 3 AS part, ordinal FROM b WHERE kind = 'heading')
SELECT ref, coalesce(base = lag(base) OVER w AND part = lag(part) OVER w + 1, false) AS goes_on FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal, ref)""",
    "table_row_text": f"""WITH {_BL}, r AS (SELECT block_id, ordinal, text, list_transform(string_split(text, ' | '), lambda x: length(x)) AS n FROM b WHERE kind = 'table_row' AND text IS NOT NULL)
SELECT block_id AS table_ref, ordinal AS row_index, text, array_to_string(list_transform(range(1, len(n) + 1), lambda i: (coalesce(list_sum(n[:i - 1]), 0) + 3 * (i - 1))::INT || '-' || (list_sum(n[:i]) + 3 * (i - 1))::INT), ',') AS spans FROM r""",
    "section_page_range": f"""WITH RECURSIVE {_VALID}, {_BL} SELECT up.at AS section_id, min(page_index) AS page_start, max(page_index) AS page_end FROM up LEFT JOIN b ON b.section_id = up.section_id WHERE up.section_id IN (SELECT section_id FROM top) GROUP BY 1""",
    "section_descendants": f"WITH RECURSIVE {_VALID} SELECT up.at AS section_id, count(*) - 1 AS descendants FROM up WHERE up.section_id IN (SELECT section_id FROM top) GROUP BY 1",
    "section_ancestors": f"WITH RECURSIVE {_VALID} SELECT up.section_id, count(*) AS ancestors, min(up.at) AS first_ancestor FROM up WHERE up.section_id IN (SELECT section_id FROM top) AND up.at <> up.section_id GROUP BY 1",
    "tree_validate": f"""WITH RECURSIVE {_VALID}, {_CH} SELECT * FROM (SELECT 'section' AS record_kind, section_id AS record_id, 'unknown_document' AS fault FROM v WHERE doc_id NOT IN (SELECT doc_id FROM bundle_documents)
UNION ALL SELECT 'section', v.section_id, CASE WHEN p.section_id IS NULL THEN 'unknown_parent' WHEN p.doc_id IS DISTINCT FROM v.doc_id THEN 'parent_of_other_document' END FROM v LEFT JOIN v p ON p.section_id = v.parent_id WHERE v.parent_id IS NOT NULL
UNION ALL SELECT 'chunk', chunk_id, CASE WHEN v.section_id IS NULL THEN 'unknown_section' WHEN v.doc_id IS DISTINCT FROM c.doc_id THEN 'section_of_other_document' END FROM c LEFT JOIN v ON v.section_id = c.section_id) WHERE fault IS NOT NULL""",
    "parse_audit": f"""WITH {_BL}, {_UN}, x AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (text IS NULL OR NOT regexp_matches(text, '[^{_S}]')) AS blank_blocks, count(*) FILTER (page_index IS NULL) AS blocks_without_page, count(*) FILTER ({_FURN}) AS furniture, count(*) FILTER (kind = 'heading') AS headings FROM b GROUP BY 1),
y AS (SELECT doc_id, count(*) AS source_units FROM u GROUP BY 1) SELECT doc_id, coalesce(blocks, 0) AS blocks, coalesce(blank_blocks, 0) AS blank_blocks, coalesce(blocks_without_page, 0) AS blocks_without_page, coalesce(furniture, 0) AS furniture, coalesce(headings, 0) AS headings, coalesce(source_units, 0) AS source_units FROM x FULL JOIN y USING (doc_id)""",
    "low_text_report": f"""WITH {_BL}, p AS (SELECT doc_id, page_index, sum(length(regexp_replace(coalesce(text, ''), '^[{_S}]+|[{_S}]+$', '', 'g'))) AS n FROM b WHERE page_index IS NOT NULL GROUP BY ALL)
SELECT doc_id, count(*) AS pages, coalesce(string_agg((page_index + 1)::VARCHAR, ',' ORDER BY page_index) FILTER (n < 80), '') AS low_text_pages FROM p GROUP BY 1""",
    "stable_id": """SELECT doc_id, 'blk_' || substring(sha256('[' || doc_id || ',' || coalesce(to_json(source)::VARCHAR, 'null') || ',' || coalesce(to_json(source_filename)::VARCHAR, 'null') || ']'), 1, 24) AS stable_id FROM documents""",
    "canonical_offsets": f"WITH {_BL} SELECT section_id, block_id, coalesce(sum(length(coalesce(text, '')) + 1) OVER w, 0)::BIGINT AS start_char, (coalesce(sum(length(coalesce(text, '')) + 1) OVER w, 0) + length(coalesce(text, '')))::BIGINT AS end_char FROM b WINDOW w AS (PARTITION BY section_id ORDER BY ordinal, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "span_intersect": f"""WITH {_CH}, {_UN}, s AS (SELECT chunk_id, unnest(source_spans) AS s FROM c)
SELECT chunk_id, source_unit_id, greatest(s.source_start_char, u.source_start_char) AS start_char, least(s.source_end_char, u.source_end_char) AS end_char FROM s JOIN u ON u.block_id = s.block_id WHERE s.source_start_char < u.source_end_char AND u.source_start_char < s.source_end_char""",
    "coverage_gaps": f"""WITH {_BL}, {_CH}, s AS (SELECT unnest(source_spans) AS s FROM c), t AS (SELECT block_id, text, length(text) AS n FROM b WHERE text IS NOT NULL AND regexp_matches(text, '[^{_S}]')),
i AS (SELECT s.block_id AS block_id, s.source_start_char::BIGINT AS a, s.source_end_char::BIGINT AS e FROM s WHERE s.block_id IN (SELECT block_id FROM t) UNION ALL SELECT block_id, n, n FROM t),
g AS (SELECT block_id, a, coalesce(max(e) OVER (PARTITION BY block_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM i)
SELECT block_id, f AS from_char, a AS to_char FROM g JOIN t USING (block_id) WHERE a > f AND f < n AND regexp_matches(text[f + 1:a], '[^{_S}]')""",
}

QUERIES = {f.__name__: f for f in (layout_preorder, furniture_split, section_tree, block_section_assign, continuation_parse, continuation_merge, table_row_text, section_page_range, section_descendants, section_ancestors, tree_validate, parse_audit, low_text_report, sentence_units, coverage_text, stable_id, canonical_offsets, span_intersect, coverage_gaps, budget_chunks, align_segments)}
