"""Status, maintenance and usage queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anchorlake.common import keep, release, table
from anchorlake.functions import text as T
from anchorlake.functions import values as V
from anchorlake.operators import graph, journal, maintenance, similarity, status
from anchorlake.operators.resolve import resolve_as_of
from anchorlake.plans import model as m
from anchorlake.plans import retrieval as r
from anchorlake.plans import similar


def _ne(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return m.nodes(spark, sf_dir), m.entries(spark, sf_dir)


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, e = keep(m.nodes(spark, sf_dir)), keep(m.entries(spark, sf_dir))
    return n, e, keep(graph.rested_on_nodes(graph.entry_edges(e, n, "based_on"), e))


def status_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.census(*_ne(spark, sf_dir))


def active_entry_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries per kind and state."""
    return m.entries(spark, sf_dir).groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), "active").agg(F.count("*").alias("entries"))


def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.shares(m.entries(spark, sf_dir), "confidence")


def knowledge_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.ages(m.entries(spark, sf_dir), m.now())


def oldest_suspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suspect node that began first."""
    s = m.nodes(spark, sf_dir).where("status = 'suspect' AND since IS NOT NULL")
    return s.agg(F.min_by("node_id", F.struct("since", "node_id")).alias("node_id"), status.age_label(status.age_seconds(F.min("since"), m.now())).alias("age"))


def activity_180d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.activity(m.changes(spark, sf_dir), m.now(), 180)


def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.coverage(*_ne(spark, sf_dir))


def file_digestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.digestion(*_ne(spark, sf_dir))


def file_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _, edges = _edges(spark, sf_dir)
    return status.centrality(edges, n)


def file_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = m.nodes(spark, sf_dir)
    return status.churn(journal.history(m.changes(spark, sf_dir), n), n, m.now(), 180)


def hotspot_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, edges = _edges(spark, sf_dir)
    return status.hotspots(status.digestion(n, e), status.churn(journal.history(m.changes(spark, sf_dir), n), n, m.now(), 180), status.centrality(edges, n))


def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, edges = _edges(spark, sf_dir)
    return status.gaps(edges, n, e, 1)


def node_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a node: its first summary in force, or that there is none, and its state."""
    n, e = _ne(spark, sf_dir)
    told = e.where("active AND kind = 'summary'").groupBy("node_id").agg(F.min_by("text", F.struct("at", "entry_id")).alias("_text"))
    line = F.coalesce(T.first_line(F.col("_text")), F.lit("(undigested)"))
    return n.join(told, "node_id", "left").select("node_id", F.when(F.col("status").isin("suspect", "orphaned"), F.concat(line, F.lit(" ["), F.col("status"), F.lit("]"))).otherwise(line).alias("line"))


def entry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.importance(m.entries(spark, sf_dir)).select("node_id", "entry_id", "place")


def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each node that fit into 120 tokens, in their order."""
    e = status.importance(m.entries(spark, sf_dir)).withColumn("tokens", T.token_estimate(F.col("text")))
    return status.within_budget(e, "node_id", "place", "tokens", 120).select("node_id", "entry_id", "spent")


def _dismissed(n: DataFrame) -> DataFrame:
    """The tables have no list of dismissed debts: the reviews of nodes whose id ends in '0/' stand for it."""
    return n.where(F.col("node_id").endswith("0/")).select(T.debt_id(F.lit("review"), F.col("node_id")).alias("debt"))


def _debts(spark: SparkSession, sf_dir: str, scope: str = ".") -> DataFrame:
    """Debts of a scope; entries of one node are compared only in it.

    Changes come first, while nothing else is on disk, and leave only what debts need of nodes' histories.

    The hash of a gram set stands with its entry for both comparisons. Debts are written by kind, so what was shuffled for one kind
    goes before the next one, and then the tables that all were made of.
    """
    live = "active AND text <> '' AND node_id IS NOT NULL"
    c = keep(m.changes(spark, sf_dir).select("id", "nodes", "at", maintenance.words().alias("words"), F.when(F.col("verified").isNotNull(), True).alias("verified")))
    n = keep(m.nodes(spark, sf_dir).select("node_id", "level", "status", "file", "symbol", "since", "lineage"))
    h = keep(journal.history(c, n, ["words", "verified"]).select("node_id", "at", "words", "verified"))
    release(c)
    e = m.entries(spark, sf_dir).select("entry_id", "node_id", "kind", "text", "disputes", "confidence", "superseded_by", "at", "active")
    e = keep(e.withColumn("_set", F.when(F.expr(live), similarity.set_digest(F.col("text")))))
    members, links = similarity.classes(maintenance.in_scope(e.where(live), scope), "entry_id", ["node_id"])
    within = similarity.within_pairs(members, links, "node_id", "entry_id")
    across = similar.cross_first(e.where(live))
    era = e.where("active AND kind = 'summary'").groupBy("node_id").agg(F.max("at").alias("era_until"))
    got = maintenance.debts(n, e, None, h, graph.declared_disputes(e, n), within, across, m.now(), era, _dismissed(n), lambda some: keep(maintenance.in_scope(some, scope)))
    for df in (n, h, e, members, links):
        release(df)
    return got


def debts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All debts but those dismissed, by id."""
    return _debts(spark, sf_dir)


def debt_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The debt to see to first in a folder."""
    return maintenance.next_debt(_debts(spark, sf_dir, "pkg/"), "pkg/")


def debt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _debts(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("debts"))


def precheck_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against committing any of the files that nodes or the newest changes name."""
    n, e, c = keep(m.nodes(spark, sf_dir)), keep(m.entries(spark, sf_dir)), keep(m.changes(spark, sf_dir))
    named = journal.touched(c).select("id", F.substring_index("ref", "#", 1).alias("file"), "at")
    files = n.where("file IS NOT NULL").select("file").unionByName(named.select("file")).distinct()
    accounted = named.where(F.col("at") >= m.now() - F.expr("INTERVAL 180 DAYS")).select("file").distinct()
    live = c.join(journal.inactive(c), "id", "left_anti")
    told = similar.rejected_options(live).select("id").distinct()
    rejected = resolve_as_of(journal.touched(live).join(told, "id", "left_semi"), n).select("node_id").distinct()
    return maintenance.precheck(files, n, e, accounted, graph.open_disputes(e, n), rejected, journal.landmines(c, n, e))


def accounting_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that changes newer than the newest flow name: what the later of two journals adds."""
    c = m.changes(spark, sf_dir)
    base = c.where(F.col("at") < m.now() - F.expr("INTERVAL 365 DAYS"))
    return journal.touched(c.join(base.select("id"), "id", "left_anti").where(V.change_id(F.col("id")))).select("ref").distinct()


def journal_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw journal rows per id: distinct ones, and whether they differ."""
    raw = table(spark, sf_dir, "journal_changes").select("id", F.sha2(F.to_json(F.struct("nodes", "what", "why", "overturns", "reverts")), 256).alias("_h"))
    return raw.groupBy("id").agg(F.count("*").alias("rows"), F.countDistinct("_h").alias("versions")).where("rows > 1").select("id", "rows", (F.col("versions") > 1).alias("conflict"))


def changes_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.changes(spark, sf_dir).groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("changes"), F.count("overturns").alias("overturns"))


# Events as the log of tool calls


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, failures and time per tool."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.count_if(F.get_json_object("props", "$.k").cast("int") >= 50).alias("hits"), F.round(F.sum("value"), 2).alias("ms"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def session_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: calls with less than two hours between them."""
    from anchorlake.streaming.usage import session_numbers

    s = session_numbers(table(spark, sf_dir, "events"))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("calls"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each tool in each session."""
    from anchorlake.streaming.usage import session_numbers

    s = session_numbers(table(spark, sf_dir, "events")).groupBy("user_id", "session")
    tools = ["click", "error", "purchase", "signup", "view"]
    return s.agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in tools])


def usage_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the stream of session windows."""
    from anchorlake.streaming.usage import session_windows

    return session_windows(table(spark, sf_dir, "events")).select("user_id", F.col("first").alias("opened"), "calls")


def usage_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per hour and tool (tumbling windows)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"))


# Evaluation


def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per lane: records, how many lie in the lane expected, and the mean reciprocal rank of the first of each case."""
    rec = table(spark, sf_dir, "eval_records").select("record_id", "case_id", F.lower(m.filled("lane")).alias("lane"), F.lower(m.filled("expected_lane")).alias("expected")).where("case_id IS NOT NULL AND expected IS NOT NULL").distinct()
    place = F.row_number().over(W.partitionBy("case_id", "expected").orderBy("record_id"))
    ranked = rec.withColumn("place", place).withColumn("hit", F.coalesce(F.col("lane") == F.col("expected"), F.lit(False)))
    case = ranked.groupBy("expected", "case_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit"), F.col("place"))).alias("first"))
    return case.groupBy(F.col("expected").alias("lane")).agg(F.sum("n").alias("records"), F.sum("hits").alias("hits"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 9).alias("mrr"))


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle total of each task and mode, the upper one of two.

    By rank: groups of any size are sorted within the shuffle instead of being gathered in arrays.
    """
    got = m.records(table(spark, sf_dir, "eval_results"), "run_id", ["task", "mode", "total_tokens"]).where("total_tokens IS NOT NULL").select("task", F.lower(m.filled("mode")).alias("mode"), "total_tokens")
    per = got.groupBy("task", "mode", "total_tokens").agg(F.count("*").alias("n"))
    w = W.partitionBy("task", "mode")
    ranked = per.withColumn("upto", F.sum("n").over(w.orderBy("total_tokens").rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("total", F.sum("n").over(w))
    return ranked.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("task", "mode").agg(F.min("total_tokens").alias("median"), F.max("total").alias("runs"))


def ab_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: tasks with both modes and in how many of them mode b has the lower median."""
    med = upper_median(spark, sf_dir)
    a, b = med.where("mode = 'a'").select("task", F.col("median").alias("a")), med.where("mode = 'b'").select("task", F.col("median").alias("b"))
    return a.join(b, "task").groupBy(F.substring_index("task", "-", 1).alias("kind")).agg(F.count("*").alias("tasks"), F.count_if(F.col("b") < F.col("a")).alias("cheaper"))


_TOLD = "SELECT DISTINCT node_id FROM e WHERE active AND node_id IS NOT NULL"
_EDGES = r.HEIRS + r.ENDS + r._edges("based_on") + ", ne AS (SELECT DISTINCT a.node_id AS src, b.node_id AS dst FROM based_on_edges g JOIN e a ON a.entry_id = g.src JOIN e b ON b.entry_id = g.dst WHERE a.node_id <> b.node_id)"
_UP = "list_concat(['.'], list_transform(range(1, len(string_split(file, '/'))), lambda i: array_to_string(string_split(file, '/')[1:i], '/') || '/'))"
_SYM = f"sy AS (SELECT file, count(*) AS n, count(t.node_id) AS d FROM n LEFT JOIN ({_TOLD}) t USING (node_id) WHERE level IN ('function', 'decl') AND file IS NOT NULL GROUP BY file)"
_CHURN = f"ch AS (SELECT file, count(DISTINCT id) AS touches FROM history JOIN n USING (node_id) WHERE at >= TIMESTAMP '{m.NOW}' - INTERVAL 180 DAY AND at <= TIMESTAMP '{m.NOW}' GROUP BY file)"
_CENTRAL = "ce AS (SELECT b.file, count(*) AS callers FROM ne JOIN n a ON a.node_id = src JOIN n b ON b.node_id = dst WHERE a.file <> b.file GROUP BY b.file)"
_LABEL = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} < 3600 THEN ({0} // 60)::VARCHAR || 'm' WHEN {0} < 86400 THEN ({0} // 3600)::VARCHAR || 'h' ELSE ({0} // 86400)::VARCHAR || 'd' END"
_AGE = f"(epoch(date_trunc('second', TIMESTAMP '{m.NOW}'))::BIGINT - floor(epoch({{0}}))::BIGINT)"
_ORDER = "o AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CASE confidence WHEN 'verified' THEN 0 WHEN 'inferred' THEN 1 WHEN 'suspect' THEN 2 ELSE 3 END, at DESC NULLS LAST, entry_id)::INT AS place FROM e WHERE active AND node_id IS NOT NULL)"
_ID = "'d_' || substring(sha256(({0})::BLOB || '\\x00'::BLOB || ({1})::BLOB), 1, 8) AS debt"
_EST = m.sql_estimate("(coalesce(what, '') || coalesce(why, ''))")
_DEBTS = (
    m.BASE
    + r.HISTORY
    + r.DISPUTES.replace(r.HEIRS, "", 1)
    + similar._G
    + f""",
su AS (SELECT node_id FROM n WHERE status = 'suspect'),
words AS (SELECT id, {_EST} AS t FROM c),
eu AS (SELECT node_id, max(at) AS upto FROM e WHERE active AND kind = 'summary' GROUP BY node_id),
era AS (SELECT node_id, count(*) AS k FROM history JOIN words USING (id) LEFT JOIN eu USING (node_id) WHERE upto IS NULL OR at IS NULL OR at > upto GROUP BY node_id HAVING count(*) > 10 OR sum(t) > 600),
told AS (SELECT node_id, file, greatest(max(e.at), any_value(since)) AS upto FROM e JOIN n USING (node_id) WHERE active AND kind = 'summary' AND level = 'file' GROUP BY node_id, file),
late AS (SELECT told.node_id, count(*) AS k FROM told JOIN n ON n.file = told.file AND symbol IS NOT NULL JOIN history ON history.node_id = n.node_id WHERE history.at > upto GROUP BY told.node_id),
lag AS (SELECT node_id, count(*) AS k FROM e JOIN n USING (node_id) WHERE active AND e.confidence = 'inferred' AND status = 'fresh' AND file IS NOT NULL AND node_id IN (SELECT node_id FROM history JOIN c USING (id) WHERE verified IS NOT NULL) GROUP BY node_id),
due AS (SELECT node_id, count(*) AS k FROM e JOIN n USING (node_id) WHERE active AND file IS NULL AND (at IS NULL OR at < TIMESTAMP '{m.NOW}' - INTERVAL 90 DAY) GROUP BY node_id),
dr AS (SELECT src, ref, arg_min(last_id, {{'r': rank, 'n': node_id, 'l': last_id}}) AS dst FROM m_disputes GROUP BY src, ref),
dd AS (SELECT src, ref, e.node_id FROM dr JOIN e ON src = e.entry_id AND e.active JOIN e x ON dst = x.entry_id AND x.active),
k0 AS (SELECT *, min(entry_id) OVER (PARTITION BY node_id, list_sort(g)) AS cls FROM g WHERE len(g) > 0), r1 AS (SELECT * FROM k0 WHERE cls = entry_id),
dup AS ({similar._WITHIN.replace("FROM k WHERE", "FROM k0 WHERE")}),
xdup AS ({similar._FIRST}),
alld AS (SELECT {_ID.format("'suspect'", "node_id")}, 'suspect-reverify' AS kind, node_id, 1 AS amount FROM su WHERE (SELECT count(*) FROM su) <= 20
UNION ALL SELECT {_ID.format("'suspect-mass'", "'.'")}, 'suspect-reverify', '.', (SELECT count(*) FROM su) WHERE (SELECT count(*) FROM su) > 20
UNION ALL SELECT {_ID.format("'era'", "node_id")}, 'era-compress', node_id, k FROM era
UNION ALL SELECT {_ID.format("'summary'", "node_id")}, 'summary-stale', node_id, k FROM late
UNION ALL SELECT {_ID.format("'conflag'", "node_id")}, 'confidence-lag', node_id, k FROM lag
UNION ALL SELECT {_ID.format("'review'", "node_id")}, 'review-overdue', node_id, k FROM due
UNION ALL SELECT {_ID.format("'dispute:' || node_id || '#' || src || ':' || ref", "node_id")}, 'dispute-open', node_id, 1 FROM dd
UNION ALL SELECT {_ID.format("'dup:' || a || ':' || b", "node_id")}, 'dup-entries', node_id, 1 FROM dup
UNION ALL SELECT {_ID.format("'xdup:' || node_a || '#' || a || ':' || node_b || '#' || b", "node_a")}, 'cross-dup', node_a, 1 FROM xdup),
debts AS (SELECT debt, kind, node_id, amount::BIGINT AS amount FROM alld WHERE debt NOT IN (SELECT {_ID.format("'review'", "node_id").replace(" AS debt", "")} FROM n WHERE ends_with(node_id, '0/')))
"""
)
_SESSIONS = "s AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events))"
_MEDIAN = f"md AS (SELECT task, mode, list_sort(list(t))[len(list(t)) // 2 + 1] AS median, count(*) AS runs FROM (SELECT s.task AS task, {m.sql_word('s.mode')} AS mode, s.t AS t FROM (SELECT run_id, arg_max({{'task': task, 'mode': mode, 't': total_tokens}}, loaded_at) AS s FROM eval_results GROUP BY run_id)) WHERE t IS NOT NULL GROUP BY ALL)"
_PRE = (
    m.BASE
    + r.RESOLVED
    + r._RISKY
    + r.DISPUTES.replace(r.HEIRS, "", 1)
    + r.INACTIVE
    + f""",
nm AS (SELECT id, split_part(ref, '#', 1) AS file, at FROM t), fs AS (SELECT file FROM n WHERE file IS NOT NULL UNION SELECT file FROM nm),
kn AS (SELECT file FROM fs WHERE file IN (SELECT file FROM n)),
tl AS (SELECT DISTINCT id FROM (SELECT id, unnest(rejected) AS x FROM c) WHERE {m.sql_filled('x.option')} IS NOT NULL AND id NOT IN (SELECT id FROM off)),
at_ AS (SELECT file, node_id, status FROM n WHERE file IN (SELECT file FROM fs))
SELECT file, 'block' AS severity, 'unindexed-source' AS kind, NULL::VARCHAR AS node_id FROM fs WHERE file NOT IN (SELECT file FROM n WHERE file IS NOT NULL)
UNION SELECT file, 'block', 'unaccounted-change', NULL FROM kn WHERE file NOT IN (SELECT file FROM nm WHERE at >= TIMESTAMP '{m.NOW}' - INTERVAL 180 DAY)
UNION SELECT file, 'block', 'stale-knowledge', node_id FROM at_ WHERE status IN ('suspect', 'orphaned')
UNION SELECT file, 'block', 'open-dispute', node_id FROM at_ WHERE node_id IN (SELECT node_id FROM e WHERE entry_id IN (SELECT src FROM od UNION SELECT dst FROM od))
UNION SELECT file, 'warn', 'rejected-alternative', node_id FROM at_ WHERE node_id IN (SELECT node_id FROM r WHERE id IN (SELECT id FROM tl))
UNION SELECT file, 'warn', 'landmine', node_id FROM at_ WHERE node_id IN (SELECT node_id FROM risky)
UNION SELECT file, 'warn', 'pitfall', node_id FROM at_ WHERE node_id IN (SELECT node_id FROM e WHERE active AND kind = 'pitfall')
"""
)
SQL = {
    "status_census": m.BASE + f"SELECT count(*) AS nodes, count(t.node_id) AS digested, count(*) FILTER (WHERE status = 'suspect') AS suspect, count(*) FILTER (WHERE status = 'orphaned') AS orphaned, count(*) FILTER (WHERE status = 'undigested') AS undigested FROM n LEFT JOIN ({_TOLD}) t USING (node_id)",
    "active_entry_census": m.BASE + "SELECT coalesce(kind, 'none') AS kind, active, count(*) AS entries FROM e GROUP BY ALL",
    "confidence_distribution": m.BASE + "SELECT coalesce(confidence, 'none') AS confidence, count(*) AS entries, (count(*) * 100 // (SELECT count(*) FROM e WHERE active))::BIGINT AS percent FROM e WHERE active GROUP BY 1",
    "knowledge_age": m.BASE + f", a AS (SELECT {_AGE.format('at')} AS s FROM e WHERE active AND at IS NOT NULL) SELECT count(*) AS entries, floor(sum(s) / count(*) / 86400)::BIGINT AS mean_days, {_LABEL.format('min(s)')} AS newest FROM a",
    "oldest_suspect": m.BASE + f"SELECT arg_min(node_id, {{'s': since, 'n': node_id}}) AS node_id, {_LABEL.format(_AGE.format('min(since)'))} AS age FROM n WHERE status = 'suspect' AND since IS NOT NULL",
    "activity_180d": m.BASE + f"SELECT count(*) AS changes, count(verified) AS verified, count(overturns) AS overturns, count(reverts) AS reverts FROM c WHERE at >= TIMESTAMP '{m.NOW}' - INTERVAL 180 DAY AND at <= TIMESTAMP '{m.NOW}'",
    "coverage_rollup": m.BASE + f", {_SYM} SELECT directory, sum(n)::BIGINT AS symbols, sum(d)::BIGINT AS digested, (sum(d) * 100 // sum(n))::BIGINT AS percent FROM (SELECT unnest({_UP}) AS directory, n, d FROM sy) GROUP BY directory",
    "file_digestion": m.BASE + f", {_SYM} SELECT file, n AS symbols, d AS digested, (d * 100 // n)::BIGINT AS percent FROM sy",
    "file_centrality": m.BASE + _EDGES + f", {_CENTRAL} SELECT * FROM ce",
    "file_churn": m.BASE + r.HISTORY + f", {_CHURN} SELECT * FROM ch",
    "hotspot_heat": m.BASE + r.HISTORY + _EDGES.replace(r.HEIRS, "", 1) + f", {_SYM}, {_CHURN}, {_CENTRAL} SELECT file, (1 + coalesce(touches, 0)) * (1 + coalesce(callers, 0)) AS heat FROM sy LEFT JOIN ch USING (file) LEFT JOIN ce USING (file) WHERE d < n AND (1 + coalesce(touches, 0)) * (1 + coalesce(callers, 0)) > 1 ORDER BY heat DESC, file LIMIT 10",
    "knowledge_gaps": m.BASE + _EDGES + f"SELECT dst AS node_id, count(DISTINCT src) AS callers FROM ne WHERE dst IN (SELECT node_id FROM n WHERE level IN ('function', 'decl')) AND dst NOT IN ({_TOLD}) GROUP BY dst HAVING count(DISTINCT src) >= 1",
    "node_lines": m.BASE
    + ", t AS (SELECT node_id, split_part(arg_min(text, {'a': at, 'e': entry_id}), chr(10), 1) AS x FROM e WHERE active AND kind = 'summary' GROUP BY node_id), l AS (SELECT n.node_id, status, coalesce(CASE WHEN length(x) > 40 THEN substring(x, 1, 40) || '…' ELSE x END, '(undigested)') AS line FROM n LEFT JOIN t USING (node_id)) SELECT node_id, CASE WHEN status IN ('suspect', 'orphaned') THEN line || ' [' || status || ']' ELSE line END AS line FROM l",
    "entry_order": m.BASE + f", {_ORDER} SELECT node_id, entry_id, place FROM o",
    "token_budget_prefix": m.BASE + f", {_ORDER} SELECT node_id, entry_id, (sum({m.sql_estimate('text')}) OVER (PARTITION BY node_id ORDER BY place ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM o QUALIFY spent <= 120",
    "debts_all": _DEBTS + "SELECT * FROM debts",
    "debt_next": _DEBTS + "SELECT * FROM debts WHERE starts_with(node_id, 'pkg/') ORDER BY debt LIMIT 1",
    "debt_counts": _DEBTS + "SELECT kind, count(*) AS debts FROM debts GROUP BY kind",
    "precheck_warnings": _PRE,
    "accounting_delta": m.BASE + f"SELECT DISTINCT {m.sql_filled('x')} AS ref FROM (SELECT unnest(nodes) AS x FROM c WHERE NOT coalesce(at < TIMESTAMP '{m.NOW}' - INTERVAL 365 DAY, false) AND regexp_full_match(id, 'chg_[0-9]{{8}}T[0-9]{{6}}Z_[0-9a-f]{{16}}') AND try_strptime(substring(id, 5, 15), '%Y%m%dT%H%M%S') IS NOT NULL) WHERE {m.sql_filled('x')} IS NOT NULL",
    "journal_dedup": "SELECT id, count(*) AS rows, count(DISTINCT {'a': nodes, 'b': what, 'c': why, 'd': overturns, 'e': reverts}) > 1 AS conflict FROM journal_changes GROUP BY id HAVING count(*) > 1",
    "changes_by_month": m.BASE + "SELECT strftime(at, '%Y-%m') AS month, count(*) AS changes, count(overturns) AS overturns FROM c GROUP BY 1",
    "usage_summary": "SELECT event_type AS tool, count(*) AS calls, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE (props->>'$.k')::INT >= 50) AS hits, round(sum(value), 2) AS ms FROM events GROUP BY 1",
    "json_props": "SELECT event_id, (props->>'$.k')::INT AS k FROM events",
    "session_ledger": f"WITH {_SESSIONS} SELECT user_id, session, count(*) AS calls, min(ts) AS first, max(ts) AS last FROM s GROUP BY ALL",
    "session_summary": f"WITH {_SESSIONS} SELECT user_id, session, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM s GROUP BY ALL",
    "usage_session_windows": f"WITH {_SESSIONS} SELECT user_id, min(ts) AS opened, count(*) AS calls FROM s GROUP BY user_id, session",
    "usage_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type AS tool, count(*) AS calls FROM events GROUP BY ALL",
    "eval_recall_mrr": f"WITH r AS (SELECT DISTINCT record_id, case_id, {m.sql_word('lane')} AS lane, {m.sql_word('expected_lane')} AS expected FROM eval_records WHERE case_id IS NOT NULL AND {m.sql_word('expected_lane')} IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY case_id, expected ORDER BY record_id) AS place, coalesce(lane = expected, false) AS hit FROM r), k AS (SELECT expected, case_id, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, min(place) FILTER (WHERE hit) AS first FROM p GROUP BY ALL) SELECT expected AS lane, sum(n)::BIGINT AS records, sum(hits)::BIGINT AS hits, round(avg(coalesce(1 / first, 0)), 9) AS mrr FROM k GROUP BY 1",
    "upper_median": f"WITH {_MEDIAN} SELECT * FROM md",
    "ab_report": f"WITH {_MEDIAN} SELECT split_part(a.task, '-', 1) AS kind, count(*) AS tasks, count(*) FILTER (WHERE b.median < a.median) AS cheaper FROM md a JOIN md b ON a.task = b.task AND a.mode = 'a' AND b.mode = 'b' GROUP BY 1",
}
SQL = {name: m.quoted(s) for name, s in SQL.items()}
QUERIES = {name: globals()[name] for name in SQL}
