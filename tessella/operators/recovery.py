"""Native page text against assembled layout: boxes, overlap, status of every native cell, and what is missing.

Cells and items meet in a join on document and page with the overlap as its condition; a nested loop over all boxes
would be the plan without that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.common import strip
from tessella.functions.text import coverage_text

TOLERANCE = 2.0
BOX = ("l", "t", "r", "b")
# Rendering modes of invisible and of clipping text.
HIDDEN_MODES = (3, 7)


def top_left(l: Column, t: Column, r: Column, b: Column, origin: Column, height: Column) -> Column:  # noqa: E741
    """struct(l, t, r, b) with the origin at the top left and sorted edges; null if an edge is. Without a stated origin the box counts
    as measured from the bottom left, so top and bottom are mirrored at the page's height."""
    lo, hi = F.least(t, b), F.greatest(t, b)
    mirrored = F.coalesce(origin, F.lit("BOTTOMLEFT")) == "BOTTOMLEFT"
    box = F.struct(F.least(l, r).alias("l"), F.when(mirrored, height - hi).otherwise(lo).alias("t"), F.greatest(l, r).alias("r"), F.when(mirrored, height - lo).otherwise(hi).alias("b"))
    return F.when(l.isNotNull() & t.isNotNull() & r.isNotNull() & b.isNotNull(), box)


def top_left_quad(x: Column, y: Column, origin: Column, height: Column) -> Column:
    """The same for the corners of a quadrilateral: arrays of four x and y."""
    return top_left(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y), origin, height)


def overlap(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two boxes meet, allowing for `tolerance` between them; a missing box meets none."""
    return F.coalesce((F.least(a["r"], b["r"]) + tolerance >= F.greatest(a["l"], b["l"])) & (F.least(a["b"], b["b"]) + tolerance >= F.greatest(a["t"], b["t"])), F.lit(False))


def overlapping(cells: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Pairs of cells (doc_id, page_index, cell_ref, cell_box, ...) and items (doc_id, page_index, item_ref, item_box, ...) that meet."""
    return cells.join(items, ["doc_id", "page_index"]).filter(overlap(F.col("cell_box"), F.col("item_box"), tolerance))


def is_meaningful(text: Column) -> Column:
    """Text with a letter, a digit or one of the signs that carry meaning of their own."""
    return F.coalesce(text.rlike(r"[\p{L}\p{N}=<>+&|]"), F.lit(False)) & F.coalesce(strip(text) != "", F.lit(False))


def cell_status(cells: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, page_index, cell_ref, status, section_id) of native cells.

    cells: doc_id, page_index, cell_ref, text, rendering_mode, cell_box. items: doc_id, page_index, item_ref, item_order, text,
    section_id, item_box. status: nonsemantic, invisible, matched (an overlapping item holds the text), matched_across (the overlapping
    items in order hold it together) or recovered. section_id, of recovered cells: that of the first overlapping item that has one, else
    of the first item of the page, else null. Texts are compared without white space, in compatibility form.
    """
    c = cells.withColumn("_needle", coverage_text(F.col("text")))
    i = items.select("doc_id", "page_index", "item_ref", "item_order", F.col("section_id").alias("_s"), "item_box", coverage_text(F.col("text"), True).alias("_hay"))
    judged = F.when(F.col("rendering_mode").isin(*HIDDEN_MODES), "invisible").when(~is_meaningful(F.col("text")), "nonsemantic")
    keyed = c.withColumn("_fixed", judged)
    near = overlapping(keyed.filter("_fixed is null"), i, tolerance).groupBy("doc_id", "page_index", "cell_ref").agg(
        F.max(F.col("_hay").contains(F.col("_needle"))).alias("_one"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_order", "item_ref", "_hay"))), lambda x: x["_hay"]), "").alias("_all"),  # the items that one cell touches
        F.min(F.when(F.col("_s").isNotNull(), F.struct("item_order", "item_ref", "_s")))["_s"].alias("_near_section"),
    )
    page = i.filter("_s is not null").groupBy("doc_id", "page_index").agg(F.min(F.struct("item_order", "item_ref", "_s"))["_s"].alias("_page_section"))
    j = keyed.join(near, ["doc_id", "page_index", "cell_ref"], "left").join(page, ["doc_id", "page_index"], "left")
    status = F.when(F.col("_fixed").isNotNull(), F.col("_fixed")).when(F.coalesce("_one", F.lit(False)), "matched").when(F.coalesce(F.col("_all").contains(F.col("_needle")), F.lit(False)), "matched_across").otherwise("recovered")
    out = j.withColumn("status", status)
    return out.select("doc_id", "page_index", "cell_ref", "status", F.when(F.col("status") == "recovered", F.coalesce("_near_section", "_page_section")).alias("section_id"))


def missing_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_index): pages from 0 below page_count that `pages` (doc_id, page_index) does not hold."""
    expected = documents.filter("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page_index"))
    return expected.join(pages.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_anti")


def recovery_report(statuses: DataFrame, missing: DataFrame) -> DataFrame:
    """Per document: meaningful, matched and recovered cells, missing pages, and incomplete, recovered or matched, whichever comes first."""
    s = F.col("status")
    per = statuses.groupBy("doc_id").agg(F.count_if(s.isin("matched", "matched_across", "recovered")).alias("meaningful"), F.count_if(s.isin("matched", "matched_across")).alias("matched"), F.count_if(s == "recovered").alias("recovered"))
    gone = missing.groupBy("doc_id").agg(F.count("*").alias("missing_pages"))
    j = per.join(gone, "doc_id", "full").na.fill(0)
    return j.withColumn("status", F.when(F.col("missing_pages") > 0, "incomplete").when(F.col("recovered") > 0, "recovered").otherwise("matched"))
