"""Problem 1 over the project's tables: changes, flow steps and entries that point at nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake.common import filled, records, table
from anchorlake.operators.orphans import orphan_references


def references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All references (``src_table``, ``src_id``, ``space``, ``key``, ``at``) and all valid targets (``space``, ``key``, ``at``)."""
    changes = records(table(spark, sf_dir, "journal_changes"), "id", ["overturns"])
    flows = records(table(spark, sf_dir, "flows"), "id", ["steps"])
    entries = records(table(spark, sf_dir, "remember_entries"), "entry_id", ["node_id", "based_on", "deleted_at"])
    nodes = records(table(spark, sf_dir, "nodes"), "node_id", ["lineage", "deleted_at"])

    def refs(df: DataFrame, name: str, space: str, key: str, c) -> DataFrame:
        return df.select(F.lit(name).alias("src_table"), F.col(key).alias("src_id"), F.lit(space).alias("space"), filled(c).alias("key"), F.col("arrived").alias("at"))

    asked = (
        refs(changes, "journal_changes", "change", "id", F.col("overturns"))
        .unionByName(refs(flows.select("id", "arrived", F.explode("steps.node").alias("node")), "flows", "node", "id", F.col("node")))
        .unionByName(refs(entries.select("entry_id", "arrived", F.explode("based_on").alias("ref")), "remember_entries", "entry", "entry_id", F.col("ref")))
        .where(F.col("key").isNotNull())
        .distinct()
    )
    live = nodes.where(F.col("deleted_at").isNull())
    kept = entries.where(F.col("deleted_at").isNull() & ~F.contains("entry_id", F.lit("#")))
    former = nodes.where(F.size("lineage") > 0).select("node_id", F.explode("lineage").alias("name")).where(F.col("name").isNotNull())
    ref = lambda node: F.concat(node, F.lit("#"), F.col("entry_id"))
    targets = [
        changes.select(F.lit("change").alias("space"), F.col("id").alias("key"), F.col("arrived").alias("at")),
        live.select(F.lit("node").alias("space"), F.col("node_id").alias("key"), F.col("arrived").alias("at")),
        live.select(F.lit("node").alias("space"), F.explode("lineage").alias("key"), F.col("arrived").alias("at")),
        kept.select(F.lit("entry").alias("space"), ref(F.col("node_id")).alias("key"), F.col("arrived").alias("at")),
        kept.join(former, "node_id").select(F.lit("entry").alias("space"), ref(F.col("name")).alias("key"), F.col("arrived").alias("at")),
    ]
    there = targets[0]
    for t in targets[1:]:
        there = there.unionByName(t)
    return asked, there


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a valid target that arrived no later than the record that refers."""
    return orphan_references(*references(spark, sf_dir)).select("src_table", "src_id", F.col("key").alias("ref_key")).distinct()


def p1_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references per table and month in which the referring record arrived."""
    lost = orphan_references(*references(spark, sf_dir))
    return lost.groupBy("src_table", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("dangling"), F.countDistinct("src_id").alias("records"))


_LOST = """
WITH c AS (SELECT id, arg_max(overturns, loaded_at) FILTER (WHERE true) AS x, min(loaded_at) AS a FROM (SELECT DISTINCT id, coalesce(overturns, '') AS overturns, loaded_at FROM journal_changes) GROUP BY id),
f AS (SELECT id, arg_max(s, loaded_at).steps AS steps, min(loaded_at) AS a FROM (SELECT id, {'steps': steps} AS s, loaded_at FROM flows) GROUP BY id),
n AS (SELECT node_id, arg_max(s, loaded_at).lineage AS lineage, arg_max(s, loaded_at).deleted_at AS deleted_at, min(loaded_at) AS a
      FROM (SELECT node_id, {'lineage': lineage, 'deleted_at': deleted_at} AS s, loaded_at FROM nodes) GROUP BY node_id),
e AS (SELECT entry_id, arg_max(s, loaded_at).node_id AS node_id, arg_max(s, loaded_at).based_on AS based_on, arg_max(s, loaded_at).deleted_at AS deleted_at, min(loaded_at) AS a
      FROM (SELECT entry_id, {'node_id': node_id, 'based_on': based_on, 'deleted_at': deleted_at} AS s, loaded_at FROM remember_entries) GROUP BY entry_id),
r AS (SELECT DISTINCT * FROM (
  SELECT 'journal_changes' AS src_table, id AS src_id, trim(x, E' \\t\\r\\n') AS k, a FROM c
  UNION ALL SELECT 'flows', id, trim(s.node, E' \\t\\r\\n'), a FROM (SELECT id, a, unnest(steps) AS s FROM f)
  UNION ALL SELECT 'remember_entries', entry_id, trim(b, E' \\t\\r\\n'), a FROM (SELECT entry_id, a, unnest(based_on) AS b FROM e)) WHERE k <> ''),
t AS (SELECT 'journal_changes' AS src_table, id AS k, min(a) AS a FROM c GROUP BY id
  UNION ALL SELECT 'flows', k, min(a) FROM (SELECT node_id AS k, a FROM n WHERE deleted_at IS NULL UNION ALL SELECT unnest(lineage), a FROM n WHERE deleted_at IS NULL) GROUP BY k
  UNION ALL SELECT 'remember_entries', k, min(a) FROM (SELECT node_id || '#' || entry_id AS k, a FROM e WHERE deleted_at IS NULL
     UNION ALL SELECT l.k || '#' || entry_id, e.a FROM e JOIN (SELECT node_id, unnest(lineage) AS k FROM n) l USING (node_id) WHERE e.deleted_at IS NULL) GROUP BY k),
lost AS (SELECT r.* FROM r LEFT JOIN t ON r.src_table = t.src_table AND r.k = t.k WHERE t.a IS NULL OR t.a > r.a)
"""

SQL = {
    "p1_found": _LOST + "SELECT DISTINCT src_table, src_id, k AS ref_key FROM lost",
    "p1_by_period": _LOST + "SELECT src_table, strftime(a, '%Y-%m') AS period, count(*) AS dangling, count(DISTINCT src_id) AS records FROM lost GROUP BY ALL",
}
QUERIES = {"p1_found": p1_found, "p1_by_period": p1_by_period}
