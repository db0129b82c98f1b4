"""Queries on the section tree, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.common import table
from tessella.operators.tree import descendant_pairs, faulty_sections, section_trees


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faulty_sections(table(spark, sf_dir, "sections"))


def p3_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants; the tour's interval is left out here, as it depends on the order of siblings."""
    return section_trees(table(spark, sf_dir, "sections")).select("section_id", "doc_id", "root_id", "depth", "path", "descendants")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendant_pairs(section_trees(table(spark, sf_dir, "sections")))


_VALID = """
v AS (SELECT section_id, doc_id, nullif(parent_id, '') AS parent_id, title, path FROM (
  SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY written_at DESC, ordinal DESC) AS k FROM sections WHERE section_id IS NOT NULL) WHERE k = 1),
up AS (
  SELECT section_id, section_id AS at, [section_id] AS seen, [title] AS titles FROM v
  UNION ALL
  SELECT up.section_id, p.section_id, list_append(up.seen, p.section_id), list_prepend(p.title, up.titles)
  FROM up JOIN v c ON c.section_id = up.at JOIN v p ON p.section_id = c.parent_id WHERE NOT list_contains(up.seen, p.section_id)),
top AS (SELECT u.* FROM up u JOIN v c ON c.section_id = u.at LEFT JOIN v p ON p.section_id = c.parent_id WHERE p.section_id IS NULL),
lost AS (SELECT u.section_id, u.seen, c.parent_id AS back FROM up u JOIN v c ON c.section_id = u.at WHERE c.parent_id IS NOT NULL AND list_contains(u.seen, c.parent_id))"""

SQL = {
    "p3_found": f"""WITH RECURSIVE {_VALID},
loops AS (SELECT section_id, back = section_id AS on_it, list_min(seen[list_position(seen, back):]) AS anchor FROM lost),
all_of AS (
  SELECT v.section_id, CASE WHEN l.on_it THEN 'cycle' WHEN l.section_id IS NOT NULL THEN 'below_cycle' WHEN r.parent_id IS NOT NULL THEN 'missing_parent'
    WHEN r.doc_id IS DISTINCT FROM v.doc_id THEN 'foreign_root' WHEN v.path IS DISTINCT FROM t.titles THEN 'stale_path' END AS fault, l.anchor, r.parent_id AS missing, r.section_id AS root
  FROM v LEFT JOIN loops l USING (section_id) LEFT JOIN top t USING (section_id) LEFT JOIN v r ON r.section_id = t.at)
SELECT section_id, fault, CASE WHEN anchor IS NOT NULL THEN anchor WHEN fault = 'missing_parent' THEN missing ELSE root END AS anchor_id FROM all_of WHERE fault IS NOT NULL""",
    "p3_trees": f"""WITH RECURSIVE {_VALID},
size AS (SELECT up.at AS section_id, count(*) - 1 AS descendants FROM up WHERE up.section_id IN (SELECT section_id FROM top) GROUP BY 1)
SELECT v.section_id, v.doc_id, t.at AS root_id, len(t.seen) - 1 AS depth, t.titles AS path, CASE WHEN t.at IS NOT NULL THEN s.descendants END AS descendants
FROM v LEFT JOIN top t USING (section_id) LEFT JOIN size s USING (section_id)""",
    "p3_descendants": f"""WITH RECURSIVE {_VALID}
SELECT up.at AS section_id, up.section_id AS descendant_id FROM up WHERE up.at <> up.section_id AND up.section_id IN (SELECT section_id FROM top)""",
}

QUERIES = {"p3_found": p3_found, "p3_trees": p3_trees, "p3_descendants": p3_descendants}
