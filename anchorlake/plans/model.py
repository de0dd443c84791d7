"""The engine's tables out of raw rows, in Spark and in the SQL that tests compare with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake.common import filled, records, table  # noqa: F401

#: Queries about age look from here.
NOW = "2026-07-01 00:00:00"


def now():
    return F.to_timestamp(F.lit(NOW))


def _word(c: str):
    return F.lower(filled(c))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that aren't deleted."""
    got = records(table(spark, sf_dir, "nodes"), "node_id", ["level", "status", "file", "symbol", "since", "lineage", "keywords", "deleted_at"])
    return got.where(F.col("deleted_at").isNull()).select("node_id", _word("level").alias("level"), F.coalesce(_word("status"), F.lit("undigested")).alias("status"), "file", "symbol", "since", F.coalesce("lineage", F.array().cast("array<string>")).alias("lineage"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries; ``active``: not superseded, not retired (deleted), not refuted."""
    got = records(table(spark, sf_dir, "remember_entries"), "entry_id", ["node_id", "kind", "text", "based_on", "disputes", "confidence", "superseded_by", "author", "at_ts", "deleted_at"])
    active = filled("superseded_by").isNull() & F.col("deleted_at").isNull() & (F.coalesce(_word("confidence"), F.lit("")) != "refuted")
    return got.select("entry_id", "node_id", _word("kind").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "based_on", "disputes", _word("confidence").alias("confidence"), filled("superseded_by").alias("superseded_by"), "author", F.col("at_ts").alias("at"), active.alias("active"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes; ``verified``, the evidence of a change: the table has no such field, a recorded commit stands for it."""
    got = records(table(spark, sf_dir, "journal_changes"), "id", ["nodes", "at_ts", "commit_sha", "task", "what", "why", "rejected", "overturns", "rebuttal", "reverts", "author"])
    return got.select("id", "nodes", F.col("at_ts").alias("at"), "task", "what", "why", "rejected", filled("overturns").alias("overturns"), filled("reverts").alias("reverts"), filled("commit_sha").alias("verified"), "author")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records(table(spark, sf_dir, "flows"), "id", ["title", "since", "steps", "deprecated", "author"])
    return got.select("id", "title", "since", "steps", F.coalesce("deprecated", F.lit(False)).alias("deprecated"))


def sql_word(c: str) -> str:
    return f"lower({sql_filled(c)})"


def sql_filled(c: str) -> str:
    return f"nullif(trim({c}, E' \\t\\r\\n'), '')"


def _latest(name: str, key: str, cols: list[str]) -> str:
    packed = ", ".join(f"'{c}': {c}" for c in cols)
    return f"(SELECT {key}, unnest(s), arrived FROM (SELECT {key}, arg_max(s, loaded_at) AS s, min(loaded_at) AS arrived FROM (SELECT {key}, {{{packed}}} AS s, loaded_at FROM {name}) WHERE {key} IS NOT NULL GROUP BY {key}))"


#: Tables n, e, c and f, as above.
BASE = f"""
WITH RECURSIVE n AS (SELECT node_id, {sql_word("level")} AS level, coalesce({sql_word("status")}, 'undigested') AS status, file, symbol, since, coalesce(lineage, []) AS lineage, coalesce(keywords, []) AS keywords
  FROM {_latest("nodes", "node_id", ["level", "status", "file", "symbol", "since", "lineage", "keywords", "deleted_at"])} WHERE deleted_at IS NULL),
e AS (SELECT entry_id, node_id, {sql_word("kind")} AS kind, coalesce(text, '') AS text, based_on, disputes, {sql_word("confidence")} AS confidence, {sql_filled("superseded_by")} AS superseded_by, author, at_ts AS at,
  ({sql_filled("superseded_by")} IS NULL AND deleted_at IS NULL AND coalesce({sql_word("confidence")}, '') <> 'refuted') AS active
  FROM {_latest("remember_entries", "entry_id", ["node_id", "kind", "text", "based_on", "disputes", "confidence", "superseded_by", "author", "at_ts", "deleted_at"])}),
c AS (SELECT id, nodes, at_ts AS at, task, what, why, rejected, {sql_filled("overturns")} AS overturns, {sql_filled("reverts")} AS reverts, {sql_filled("commit_sha")} AS verified, author
  FROM {_latest("journal_changes", "id", ["nodes", "at_ts", "commit_sha", "task", "what", "why", "rejected", "overturns", "reverts", "author"])}),
f AS (SELECT id, title, since, steps, coalesce(deprecated, false) AS deprecated FROM {_latest("flows", "id", ["title", "since", "steps", "deprecated"])})
"""

#: Text functions, as in ``functions.text``.
HAN = r"\p{Han}"


def sql_windows(s: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({s}) - {n - 2}, 2)), lambda i: substring({s}, i, {n}))"


def sql_parts(w: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({w}, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z])([A-Z])', '\\1_\\2', 'g')), '[_.~]+'), lambda x: x <> ''))"


def sql_tokens(t: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all({t}, '[A-Za-z0-9]+|{HAN}+'), lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z0-9]') THEN list_concat([lower(w)], {sql_parts('w')}) ELSE {sql_windows('w', 2)} END)))"


def sql_grams(t: str) -> str:
    return f"list_distinct(list_concat(list_transform(regexp_extract_all(lower(regexp_replace({t}, '{HAN}', ' ', 'g')), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: 'w:' || w), flatten(list_transform(regexp_extract_all({t}, '{HAN}+'), lambda r: {sql_windows('r', 2)}))))"


def sql_estimate(t: str) -> str:
    return f"(len(regexp_extract_all({t}, '{HAN}')) + floor(1.3::DOUBLE * len(regexp_extract_all(regexp_replace({t}, '{HAN}', ' ', 'g'), '[\\p{{L}}\\p{{Nd}}]+')) + 0.5))::BIGINT"


def quoted(sql: str) -> str:
    """``at`` is a column here and a word of the language there."""
    return re.sub(r'(?<!")\bat\b(?!")', '"at"', sql)
