"""Problem 3 over the project's tables: the hierarchies that ``overturns`` makes of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake.common import filled, keep, records, table
from anchorlake.operators.hierarchy import descendants, hierarchy


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = records(table(spark, sf_dir, "journal_changes"), "id", ["overturns"])
    child = changes.select("id", filled("overturns").alias("parent")).where(F.col("parent").isNotNull())
    return child.join(changes.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of each change that overturns an existing one."""
    return hierarchy(links(spark, sf_dir)).select("id", "root_id", "depth")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full path of each of them, root first; of those that never reach a root (depth -1) from the cycle's smallest id."""
    return hierarchy(links(spark, sf_dir)).select("id", "root_id", "depth", F.concat_ws(" > ", "path").alias("path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of each change, with their distance, on cycles and below them as well."""
    return descendants(keep(hierarchy(links(spark, sf_dir))))


def p3_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link of each cycle's smallest id, and how many changes never reach a root because of it."""
    walked = hierarchy(links(spark, sf_dir)).where("depth = -1")
    return walked.groupBy(F.col("root_id").alias("id")).agg(F.max(F.when(F.col("closes_cycle"), F.col("parent"))).alias("parent"), F.count("*").alias("changes"))


_LINKS = """
WITH RECURSIVE c AS (SELECT id, trim(arg_max(coalesce(overturns, ''), loaded_at), E' \\t\\r\\n') AS p FROM journal_changes WHERE id IS NOT NULL GROUP BY id),
e AS (SELECT a.id, a.p FROM c a JOIN c b ON a.p = b.id),
"""
_TREES = """
w AS (SELECT id, p AS root, 1 AS depth, p || ' > ' || id AS path FROM e WHERE p NOT IN (SELECT id FROM e)
      UNION ALL SELECT e.id, w.root, w.depth + 1, w.path || ' > ' || e.id FROM w JOIN e ON e.p = w.id)
"""
_RINGS = """,
u AS (SELECT id, p FROM e WHERE id NOT IN (SELECT id FROM w)),
r AS (SELECT id AS x, p AS y FROM u UNION SELECT r.x, u.p FROM r JOIN u ON r.y = u.id),
ring AS (SELECT x, min(y) AS root FROM r WHERE y IN (SELECT x FROM r WHERE x = y) GROUP BY x)
"""
SQL = {
    "p3_found": _LINKS + _TREES + _RINGS + "SELECT id, root AS root_id, depth::BIGINT AS depth FROM w UNION ALL SELECT x, root, -1 FROM ring",
    "p3_paths": _LINKS
    + _TREES
    + _RINGS
    + ", v AS (SELECT x AS id, root, x AS cur, x AS path FROM ring UNION ALL SELECT v.id, root, u.p, u.p || ' > ' || path FROM v JOIN u ON u.id = v.cur WHERE v.cur <> root) SELECT id, root AS root_id, depth::BIGINT AS depth, path FROM w UNION ALL SELECT id, root, -1, path FROM v WHERE cur = root",
    "p3_cycles": _LINKS + _TREES + _RINGS + "SELECT root AS id, max(u.p) FILTER (WHERE u.id = root) AS parent, count(*) AS changes FROM ring JOIN u ON u.id = ring.x GROUP BY root",
}
SQL["p3_descendants"] = (
    _LINKS
    + _TREES
    + """,
u AS (SELECT id, p FROM e WHERE id NOT IN (SELECT id FROM w)),
d AS (SELECT id AS x, p AS y, 1 AS n FROM e WHERE id IN (SELECT id FROM w) UNION ALL SELECT d.x, e.p, n + 1 FROM d JOIN e ON e.id = d.y),
a AS (SELECT id AS x, p AS y, 1 AS n, [id, p] AS seen FROM u WHERE p <> id UNION ALL SELECT a.x, u.p, n + 1, list_append(seen, u.p) FROM a JOIN u ON u.id = a.y WHERE NOT list_contains(seen, u.p))
SELECT y AS id, x AS descendant, n::BIGINT AS distance FROM d UNION ALL SELECT y, x, n FROM a"""
)
QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_cycles": p3_cycles}
