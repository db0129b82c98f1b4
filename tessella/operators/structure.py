"""Document structure: layout order, headings to a section tree, blocks to sections, table rows, pages of sections.

Whatever depends on the order of a document's items is a running "last one before": items are range-partitioned by document and order,
windows work inside a document's share of a partition, and what a share ends with is carried into those behind it. So no task holds
a document, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.common import durable
from tessella.functions.text import casefold, continuation_parts
from tessella.operators import tree

# Labels of items that are headings, and of those that are page furniture.
HEADINGS = ("title", "section_header", "heading")
FURNITURE = ("page_header", "page_footer")


def layout_order(nodes: DataFrame) -> DataFrame:
    """(node_id, root_id, position, orphan): pre-order of every tree, children by (ordinal, node_id).

    nodes: node_id, parent_id, ordinal. The sort key of a node is the path of ordinals from its root, built by pointer
    doubling; sorted, these paths are the pre-order. A node whose parent is missing begins a tree of orphans. Nodes on and
    below cycles come last of all, as orphans in the order of their ordinals, with no root.
    """
    base = nodes.filter("node_id is not null").groupBy(F.col("node_id").alias("id")).agg(F.min(F.struct("ordinal", "parent_id")).alias("_n")).select("id", F.expr("nullif(_n.parent_id, '')").alias("parent"), F.col("_n.ordinal").alias("ordinal"))
    known = base.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    rows = durable(base.join(known, "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("parent"), F.col("parent").alias("_stated"), "ordinal"))
    done, lost = tree._ancestry(rows.select("id", "parent", F.struct("ordinal", "id").alias("title")))
    placed = done.select("id", "root", F.col("titles").alias("_key")).unionByName(lost.join(rows.select("id", "ordinal"), "id").select("id", F.lit(None).cast("string").alias("root"), F.array(F.struct("ordinal", "id")).alias("_key")))
    orphan = rows.select(F.col("id").alias("root"), F.col("_stated").isNotNull().alias("_o"))
    out = placed.withColumn("position", F.row_number().over(W.partitionBy("root").orderBy("_key")) - 1).join(orphan, "root", "left")
    return out.select(F.col("id").alias("node_id"), F.col("root").alias("root_id"), "position", F.coalesce("_o", F.lit(True)).alias("orphan"))


def is_furniture(layer: Column, label: Column) -> Column:
    """Headers, footers and whatever is in the furniture layer; they are kept aside, not in blocks."""
    return F.coalesce(layer == "furniture", F.lit(False)) | F.coalesce(label.isin(*FURNITURE), F.lit(False))


def in_order(items: DataFrame, *order: str) -> DataFrame:
    """`items` (doc_id, ...) with pos, which grows with the order inside each document, and _share: documents' rows in equal shares by range."""
    ranged = items.repartitionByRange("doc_id", *order).sortWithinPartitions("doc_id", *order)
    return durable(ranged.withColumn("_share", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()))


def last_before(rows: DataFrame, of: dict[str, Column], upto: int = -1) -> DataFrame:
    """`rows` of in_order() with, for each name, the last value of its expression that is not null before the row in its document
    (upto=0: or at it)."""
    inside = W.partitionBy("doc_id", "_share").orderBy("pos").rowsBetween(W.unboundedPreceding, upto)
    ends = rows.groupBy("doc_id", "_share").agg(*(F.max_by(e, F.when(e.isNotNull(), F.col("pos"))).alias(n) for n, e in of.items()))
    shares = W.partitionBy("doc_id").orderBy("_share").rowsBetween(W.unboundedPreceding, -1)  # a row a share
    carried = ends.select("doc_id", "_share", *(F.last(n, ignorenulls=True).over(shares).alias("_carried_" + n) for n in of))
    here = rows.select("*", *(F.last(e, ignorenulls=True).over(inside).alias("_here_" + n) for n, e in of.items()))
    return here.join(carried, ["doc_id", "_share"]).select(*rows.columns, *(F.coalesce("_here_" + n, "_carried_" + n).alias(n) for n in of))


def _numbered(text: Column) -> Column:
    """struct(base, part, total) by which a heading and the one before it are compared; null for a heading without part."""
    part = continuation_parts(text)
    return F.when(part.isNotNull(), F.struct(casefold(part["base"]).alias("base"), part["part"].alias("part"), part["total"].alias("total")))


def _continues(now: Column, before: Column) -> Column:
    """Whether a heading struct(level, number) is the next part of the one before it."""
    next_part = F.struct(before["number"]["base"], before["number"]["total"], before["number"]["part"] + 1, before["level"]) == F.struct(now["number"]["base"], now["number"]["total"], now["number"]["part"], now["level"])
    return F.coalesce(next_part & now["number"].isNotNull() & before["number"].isNotNull(), F.lit(False))


def section_scan(items: DataFrame) -> DataFrame:
    """Sections and the section of every item: doc_id, ordinal, ref, section_ref, is_section, parent_ref, title, level, path.

    items: doc_id, doc_title, ordinal, ref, label, level, text (the title of a heading). A heading's parent is the nearest
    heading before it of a smaller level (1 where the level is null or less), else the document's root, whose ref is the
    doc_id. A heading "Title (n/m)" goes on with the section of the heading before it if that is part n-1 of the same title,
    total and level. Any item belongs to the last heading at or before it. path begins with the document's title.

    The nearest heading of a smaller level is found level by level: of the last headings of all smaller levels, those are open behind
    which none of a still smaller level came; the innermost is the parent and all of them are the path.
    """
    heading = F.coalesce(F.col("label").isin(*HEADINGS), F.lit(False))
    level = F.greatest(F.lit(1), F.coalesce("level", F.lit(1))).cast("int")
    text = F.coalesce("text", F.lit(""))
    number = _numbered(text)
    flat = items.filter("doc_id is not null").select("doc_id", F.coalesce("doc_title", "doc_id").alias("doc_title"), F.col("ordinal").cast("long").alias("ordinal"), "ref", F.when(heading, F.struct(level.alias("level"), number.alias("number"), F.coalesce(continuation_parts(text)["base"], text).alias("title"))).alias("head"))
    rows = last_before(in_order(flat, "ordinal", "ref"), {"before": F.col("head")})
    rows = rows.withColumn("is_section", F.col("head").isNotNull() & ~_continues(F.col("head"), F.col("before"))).drop("before")
    levels = sorted(r[0] for r in rows.filter("is_section").select("head.level").distinct().collect())  # as many as there are levels of headings
    begun = F.struct("pos", "ref", F.col("head.title").alias("title"), F.col("head.level").alias("level"))
    rows = last_before(rows, {f"_{k}": F.when(F.col("is_section") & (F.col("head.level") == k), begun) for k in levels})
    none = F.array().cast("array<struct<pos:bigint,ref:string,title:string,level:int>>")
    last = F.array(*(F.col(f"_{k}") for k in levels)) if levels else none
    # of the last headings by level, those that no later heading of a smaller level has closed
    open_ = F.filter(last, lambda x, i: x.isNotNull() & ~F.exists(F.slice(last, F.lit(1), i), lambda y: F.coalesce(y["pos"] > x["pos"], F.lit(False))))
    own = F.when(F.col("is_section"), F.col("head.level"))
    rows = rows.withColumn("_open", open_).withColumn("_above", F.filter("_open", lambda x: own.isNull() | (x["level"] < own)))
    inner = F.element_at(F.col("_above"), F.when(F.size("_above") > 0, F.size("_above")).otherwise(F.lit(None)))["ref"]
    parent = F.coalesce(inner, F.col("doc_id"))
    section = F.when(F.col("is_section"), F.col("ref")).otherwise(parent)
    when = lambda c: F.when(F.col("is_section"), c)
    path = F.concat(F.array("doc_title"), F.transform("_above", lambda x: x["title"]), F.array("head.title"))
    return rows.select("doc_id", "ordinal", "ref", section.alias("section_ref"), "is_section", when(parent).alias("parent_ref"), when(F.col("head.title")).alias("title"), own.alias("level"), when(path).alias("path"))


def continuations(headings: DataFrame) -> DataFrame:
    """(doc_id, ref, goes_on) of headings (doc_id, ordinal, ref, level, text): the rule of section_scan."""
    flat = headings.select("doc_id", "ordinal", "ref", F.struct("level", _numbered(F.col("text")).alias("number")).alias("head"))
    return last_before(in_order(flat, "ordinal", "ref"), {"before": F.col("head")}).select("doc_id", "ref", _continues(F.col("head"), F.col("before")).alias("goes_on"))


def table_rows(cells: DataFrame) -> DataFrame:
    """(table_ref, row_index, text, cell_spans) of cells (table_ref, cell_index, row, col, text): cells of a row by (col, cell_index),
    joined by " | ", with each cell's half-open offsets. A cell that spans rows stands in its first; null text is empty."""
    c = F.struct(F.coalesce("col", F.lit(0)).alias("col"), "cell_index", F.coalesce("text", F.lit("")).alias("text"))
    rows = cells.groupBy("table_ref", F.coalesce("row", F.lit(0)).alias("row_index")).agg(F.array_sort(F.collect_list(c)).alias("_c"))  # a table's row
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<cell_index:int,start_char:int,end_char:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        end = s["at"] + F.length(x["text"])
        span = F.struct(x["cell_index"].cast("int").alias("cell_index"), s["at"].alias("start_char"), end.alias("end_char"))
        return F.struct((end + 3).alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    return rows.select("table_ref", "row_index", F.array_join(F.transform("_c", lambda x: x["text"]), " | ").alias("text"), F.aggregate("_c", start, step, lambda s: s["out"]).alias("cell_spans"))


def section_pages(parents: DataFrame, pages: DataFrame) -> DataFrame:
    """(section_id, page_start, page_end) over the pages of a section and of everything below it.

    parents: section_id, parent_id (sound forest); pages: section_id, page_index. Minimum and maximum are combined up the
    tree by pointer doubling: after round k a section knows all descendants nearer than 2**k. Sections without pages have nulls.
    """
    own = pages.groupBy("section_id").agg(F.min("page_index").alias("lo"), F.max("page_index").alias("hi"))
    state = durable(parents.select("section_id", F.expr("nullif(parent_id, '')").alias("jump")).join(own, "section_id", "left"))
    before = -1
    while (going := state.filter("jump is not null").count()) not in (0, before):
        before = going
        up = state.filter("jump is not null").groupBy(F.col("jump").alias("section_id")).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
        further = state.select(F.col("section_id").alias("jump"), F.col("jump").alias("_jump"))
        state = durable(state.join(up, "section_id", "left").join(further, "jump", "left").select("section_id", F.col("_jump").alias("jump"), F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi")))
    return state.select("section_id", F.col("lo").alias("page_start"), F.col("hi").alias("page_end"))


def parse_audit(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """Per document: blocks, blocks without text, without a page, of furniture, headings and source units."""
    empty = F.coalesce(F.length(F.regexp_replace("text", r"(?U)\s+", "")), F.lit(0)) == 0
    of_blocks = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(empty).alias("blank_blocks"), F.count_if(F.col("page_index").isNull()).alias("blocks_without_page"), F.count_if(is_furniture(F.col("content_layer"), F.col("kind"))).alias("furniture"), F.count_if(F.col("kind").isin(*HEADINGS)).alias("headings"))
    of_units = units.groupBy("doc_id").agg(F.count("*").alias("source_units"))
    return of_blocks.join(of_units, "doc_id", "full").na.fill(0)


def low_text_pages(blocks: DataFrame, least: int = 80) -> DataFrame:
    """(doc_id, pages, low_text_pages): number of pages with text and those, from 1, with fewer than `least` stripped characters."""
    per_page = blocks.filter("page_index is not null").groupBy("doc_id", "page_index").agg(F.sum(F.coalesce(F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")), F.lit(0))).alias("chars"))
    return per_page.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.when(F.col("chars") < least, F.col("page_index") + 1))).alias("low_text_pages"))
