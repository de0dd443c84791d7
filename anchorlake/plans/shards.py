"""Problem 6 over the project's tables: the fields of raw shard and intent files over time."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake.common import table
from anchorlake.operators.drift import drifts, unified


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a field with the file that shows it first."""
    return drifts(table(spark, sf_dir, "shard_files")).select("file_id", "field", "drift")


def p6_changes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field changes in which way, per kind of document."""
    files = table(spark, sf_dir, "shard_files")
    kinds = files.groupBy(F.col("stream").alias("_stream")).agg(F.min("doc_kind").alias("doc_kind"))
    return drifts(files).join(kinds, F.equal_null("stream", "_stream")).groupBy("doc_kind", "field", "drift").agg(F.count("*").alias("files"))


def _unified(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(table(spark, sf_dir, "shard_files"), kind, nested=True)


_FOUND = r"""
WITH f0 AS (SELECT DISTINCT coalesce(stream, chr(1)) AS stream, written_at, file_id, raw FROM shard_files WHERE CASE WHEN json_valid(raw) THEN json_type(raw) END = 'OBJECT'),
fl AS MATERIALIZED (SELECT stream, file_id, raw, row_number() OVER (PARTITION BY stream ORDER BY written_at NULLS FIRST, file_id) AS i, count(*) OVER (PARTITION BY stream) AS n FROM f0),
tr AS (SELECT stream, i, n, regexp_replace(regexp_replace(substring(fullkey, 3), '\[[0-9]+\]', '[]', 'g'), '"', '', 'g') AS path, t.id AS id,
  CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT') THEN 'integer' WHEN t.type = 'DOUBLE' THEN 'decimal' WHEN t.type = 'VARCHAR' THEN 'string' WHEN t.type <> 'NULL' THEN lower(t.type) END AS ty
  FROM fl, json_tree(fl.raw) t WHERE fullkey <> '$' AND NOT ends_with(fullkey, ']')),
pf AS (SELECT stream, i, n, path, arg_min(ty, id) FILTER (WHERE ty IS NOT NULL) AS ty FROM tr GROUP BY ALL),
ru AS (SELECT *, i - row_number() OVER (PARTITION BY stream, path ORDER BY i) AS run FROM pf),
kn AS (SELECT *, last_value(ty IGNORE NULLS) OVER w AS before, coalesce(ty, last_value(ty IGNORE NULLS) OVER w) AS known, row_number() OVER (PARTITION BY stream, path, run ORDER BY i) AS up, row_number() OVER (PARTITION BY stream, path, run ORDER BY i DESC) AS down
  FROM ru WINDOW w AS (PARTITION BY stream, path, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ev AS (SELECT stream, i, path, 'added' AS drift, ty FROM kn WHERE up = 1 AND i > 1 UNION ALL SELECT stream, i + 1, path, 'removed', known FROM kn WHERE down = 1 AND i < n
  UNION ALL SELECT stream, i, path, 'retyped', ty FROM kn WHERE up > 1 AND ty <> before),
tp AS (SELECT *, regexp_replace(path, '\.?[^.]*$', '') AS parent FROM ev e WHERE NOT EXISTS (SELECT 1 FROM ev a WHERE a.stream = e.stream AND a.i = e.i AND (starts_with(e.path, a.path || '.') OR starts_with(e.path, a.path || '[]')))),
mv AS (SELECT stream, i, parent, count(*) FILTER (WHERE drift = 'removed') AS r, count(*) FILTER (WHERE drift = 'added') AS a, max(ty) FILTER (WHERE drift = 'removed') AS rt, max(ty) FILTER (WHERE drift = 'added') AS ct FROM tp GROUP BY ALL),
rn AS (SELECT stream, i, parent FROM mv WHERE r = 1 AND a = 1 AND rt = ct),
dr AS (SELECT stream, i, path, CASE WHEN rn.parent IS NOT NULL AND drift = 'added' THEN 'renamed' ELSE drift END AS drift FROM tp LEFT JOIN rn USING (stream, i, parent) WHERE NOT (rn.parent IS NOT NULL AND drift = 'removed'))
"""
SQL = {
    "p6_found": _FOUND + "SELECT file_id, path AS field, drift FROM dr JOIN fl USING (stream, i)",
    "p6_changes_by_kind": _FOUND + ", k AS (SELECT coalesce(stream, chr(1)) AS stream, min(doc_kind) AS doc_kind FROM shard_files GROUP BY 1) SELECT doc_kind, path AS field, drift, count(*) AS files FROM dr JOIN k USING (stream) GROUP BY ALL",
}
QUERIES = {"p6_found": p6_found, "p6_changes_by_kind": p6_changes_by_kind, "p6_flow_shards": partial(_unified, "flow_shard"), "p6_truth_intents": partial(_unified, "truth_intent")}
