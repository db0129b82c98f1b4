"""Queries on native text recovery and the corpus store, with their SQL. Boxes are a fixture: a block's item stands in the column and line
that its ordinal gives, and each of its lines is a native cell; those of every seventh are invisible and of every fifth displaced.
Every line of a block is a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.common import latest, table
from tessella.operators import recovery as R
from tessella.operators import store
from tessella.operators.tree import valid_sections
from tessella.plans.documents import _BL, _CH, _blocks
from tessella.plans.hierarchy import _VALID

HEIGHT = 792.0


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("ordinal").cast("double")
    b = _blocks(spark, sf_dir).filter("page_index is not null and text is not null")
    left, top = (o % 3) * 150, (o % 11) * 60
    return b.withColumn("item_box", R.top_left(left, F.lit(HEIGHT) - top - 40, left + 120, F.lit(HEIGHT) - top, F.lit(None).cast("string"), F.lit(HEIGHT)))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark, sf_dir).select("doc_id", "page_index", F.col("block_id").alias("item_ref"), F.col("ordinal").alias("item_order"), "text", "section_id", "item_box")


def _cells(boxed: DataFrame) -> DataFrame:
    """A cell for every line of every block: the box of the block's cells, divided among its lines. The first has the block's name."""
    away = F.when(F.col("ordinal") % 5 == 0, 2000.0).otherwise(0.0)
    lines = boxed.select("*", F.size(F.split("text", "\n")).alias("_n"), F.posexplode(F.split("text", "\n")).alias("_k", "_line"))
    high = (F.col("item_box.b") - F.col("item_box.t") - 20) / F.col("_n")
    top = F.col("item_box.t") + 10 + F.col("_k") * high
    box = F.struct((F.col("item_box.l") + away).alias("l"), top.alias("t"), (F.col("item_box.r") + away).alias("r"), (top + high).alias("b"))
    ref = F.when(F.col("_k") == 0, F.col("block_id")).otherwise(F.concat_ws(":", "block_id", "_k"))
    return lines.select("doc_id", "page_index", ref.alias("cell_ref"), F.col("_line").alias("text"), F.when(F.col("ordinal") % 7 == 0, 3).otherwise(0).alias("rendering_mode"), box.alias("cell_box"))


def bbox_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark, sf_dir).select("block_id", *[F.col(f"item_box.{k}").alias(k) for k in R.BOX])


def cell_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(_boxed(spark, sf_dir)).select("doc_id", "page_index", "cell_ref", "cell_box")
    return R.overlapping(cells, _items(spark, sf_dir).select("doc_id", "page_index", "item_ref", "item_box")).select("cell_ref", "item_ref")


def native_cell_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cell_status(_cells(_boxed(spark, sf_dir)), _items(spark, sf_dir)).select("cell_ref", "status", "section_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bundle_documents").groupBy("doc_id").agg(F.max("page_count").alias("page_count"))


def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.missing_pages(_documents(spark, sf_dir), _blocks(spark, sf_dir).filter("page_index is not null"))


def recovery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recovery_report(R.cell_status(_cells(_boxed(spark, sf_dir)), _items(spark, sf_dir)), missing_pages(spark, sf_dir))


def scope_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of five whole trees: those of the first roots by section_id."""
    sections = table(spark, sf_dir, "sections")
    roots = valid_sections(sections).filter("nullif(parent_id, '') is null").orderBy("section_id").limit(5)  # the scope that is asked for
    documents = table(spark, sf_dir, "bundle_documents").select("doc_id").distinct()
    chunks = latest(table(spark, sf_dir, "chunks"), "chunk_id", "ingested_at", "doc_id", "section_id")
    return store.scope_chunks(chunks, sections, documents, {"section_ids": [r["section_id"] for r in roots.collect()]}).select("chunk_id", "section_id")


def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the documents as artifacts; some are changed, some missing and some not stated."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    name = F.col("doc_id").cast("string").alias("name")
    stated = d.filter("doc_id % 7 <> 0").select(name, F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return store.manifest_faults(stated, d.filter("doc_id % 11 <> 0").select(name, F.sha2("text", 256).alias("sha256")))


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return store.fingerprint(d, "doc_id", "digest")


def record_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir).select("block_id", "doc_id", F.col("ordinal").alias("place"))
    return store.dense_ordinals(b, "doc_id", "place", "block_id").select("block_id", F.col("ordinal").cast("long").alias("ordinal"))


_BOX = "x AS (SELECT *, (ordinal % 3) * 150.0::DOUBLE AS l, (ordinal % 11) * 60.0::DOUBLE AS t, (ordinal % 3) * 150.0::DOUBLE + 120 AS r, (ordinal % 11) * 60.0::DOUBLE + 40 AS bt FROM b WHERE page_index IS NOT NULL AND text IS NOT NULL)"
_MEET = "least(n.r, x.r) + 2 >= greatest(n.l, x.l) AND least(n.bt, x.bt) + 2 >= greatest(n.t, x.t)"
_STRIPPED = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Statuses of the cells of all lines. DuckDB has no compatibility form; on both sides of the comparison it is left out.
_STATUS = rf"""n AS (SELECT block_id || CASE WHEN k = 1 THEN '' ELSE ':' || (k - 1) END AS cell_ref, doc_id, page_index, ordinal, lines[k] AS text, l + away AS l, t + 10 + (k - 1) * 20.0::DOUBLE / len(lines) AS t, r + away AS r, t + 10 + k * 20.0::DOUBLE / len(lines) AS bt
  FROM (SELECT *, string_split(text, chr(10)) AS lines, CASE WHEN ordinal % 5 = 0 THEN 2000 ELSE 0 END AS away FROM x), unnest(range(1, len(lines) + 1)) u(k)),
fixed AS (SELECT *, regexp_replace(text, '{_STRIPPED}', '', 'g') AS needle, CASE WHEN ordinal % 7 = 0 THEN 'invisible' WHEN NOT (regexp_matches(text, '[\p{{L}}\p{{N}}=<>+&|]') AND regexp_replace(text, '{_STRIPPED}', '', 'g') <> '') THEN 'nonsemantic' END AS fixed FROM n),
near AS (SELECT cell_ref, max(contains(hay, needle)) AS one, contains(string_agg(hay, '' ORDER BY x.ordinal, block_id), any_value(needle)) AS every, arg_min(section_id, struct_pack(o := x.ordinal, b := block_id)) FILTER (section_id IS NOT NULL) AS s
  FROM (SELECT * FROM fixed WHERE fixed IS NULL) n JOIN (SELECT *, regexp_replace(replace(text, ' | ', ' '), '{_STRIPPED}', '', 'g') AS hay FROM x) x ON n.doc_id = x.doc_id AND n.page_index = x.page_index AND {_MEET} GROUP BY 1),
page AS (SELECT doc_id, page_index, arg_min(section_id, struct_pack(o := ordinal, b := block_id)) AS s FROM x WHERE section_id IS NOT NULL GROUP BY 1, 2),
st AS (SELECT f.doc_id, f.cell_ref, coalesce(fixed, CASE WHEN one THEN 'matched' WHEN every THEN 'matched_across' ELSE 'recovered' END) AS status, coalesce(near.s, page.s) AS s FROM fixed f LEFT JOIN near USING (cell_ref) LEFT JOIN page ON page.doc_id = f.doc_id AND page.page_index = f.page_index)"""
_GONE = "d AS (SELECT doc_id, max(page_count) AS n FROM bundle_documents GROUP BY 1), e AS (SELECT doc_id, unnest(range(n))::INT AS page_index FROM d WHERE n > 0), gone AS (SELECT * FROM e WHERE (doc_id, page_index) NOT IN (SELECT (doc_id, page_index) FROM b WHERE page_index IS NOT NULL AND doc_id IS NOT NULL))"

SQL = {
    "native_cell_status": f"WITH {_BL}, {_BOX}, {_STATUS} SELECT cell_ref, status, CASE WHEN status = 'recovered' THEN s END AS section_id FROM st",
    "recovery_stats": f"""WITH {_BL}, {_BOX}, {_STATUS}, {_GONE}, a AS (SELECT doc_id, count(*) FILTER (status IN ('matched', 'matched_across', 'recovered')) AS meaningful, count(*) FILTER (status IN ('matched', 'matched_across')) AS matched, count(*) FILTER (status = 'recovered') AS recovered FROM st GROUP BY 1),
g AS (SELECT doc_id, count(*) AS missing_pages FROM gone GROUP BY 1)
SELECT doc_id, coalesce(meaningful, 0) AS meaningful, coalesce(matched, 0) AS matched, coalesce(recovered, 0) AS recovered, coalesce(missing_pages, 0) AS missing_pages, CASE WHEN missing_pages > 0 THEN 'incomplete' WHEN recovered > 0 THEN 'recovered' ELSE 'matched' END AS status FROM a FULL JOIN g USING (doc_id)""",
    "scope_chunks": f"WITH RECURSIVE {_VALID}, {_CH} SELECT chunk_id, section_id FROM c WHERE section_id IN (SELECT up.section_id FROM up WHERE up.at IN (SELECT section_id FROM v WHERE parent_id IS NULL ORDER BY section_id LIMIT 5))",
    "bbox_normalize": f"WITH {_BL}, {_BOX} SELECT block_id, l, t, r, bt AS b FROM x",
    "cell_overlap_join": f"WITH {_BL}, {_BOX}, {_STATUS} SELECT cell_ref, block_id AS item_ref FROM n JOIN x ON n.doc_id = x.doc_id AND n.page_index = x.page_index AND {_MEET}",
    "missing_pages": f"WITH {_BL}, d AS (SELECT doc_id, max(page_count) AS n FROM bundle_documents GROUP BY 1), e AS (SELECT doc_id, unnest(range(n))::INT AS page_index FROM d WHERE n > 0) SELECT * FROM e WHERE (doc_id, page_index) NOT IN (SELECT (doc_id, page_index) FROM b WHERE page_index IS NOT NULL AND doc_id IS NOT NULL)",
    "manifest_verify": """WITH s AS (SELECT doc_id::VARCHAR AS name, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS a FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0), f AS (SELECT doc_id::VARCHAR AS name, sha256(text) AS b FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0)
SELECT * FROM (SELECT name, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'not_stated' WHEN a <> b THEN 'changed' END AS fault FROM s FULL JOIN f USING (name)) WHERE fault IS NOT NULL""",
    "corpus_fingerprint": """WITH l AS (SELECT substring(sha256(doc_id::VARCHAR), 1, 3) AS b, doc_id::VARCHAR || '=' || sha256(coalesce(text, '')) AS l FROM documents), i AS (SELECT b, sha256(string_agg(l, chr(10) ORDER BY l)) AS h, count(*) AS n FROM l GROUP BY 1)
SELECT sha256(string_agg(b || h, chr(10) ORDER BY b)) AS fingerprint, sum(n)::BIGINT AS records FROM i""",
    "record_ordinals": f"WITH {_BL} SELECT block_id, row_number() OVER (ORDER BY doc_id, ordinal, block_id) - 1 AS ordinal FROM b",
}

QUERIES = {f.__name__: f for f in (scope_chunks, bbox_normalize, cell_overlap_join, native_cell_status, missing_pages, recovery_stats, manifest_verify, corpus_fingerprint, record_ordinals)}
