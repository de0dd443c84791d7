"""Composite queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake.common import filled, keep, table
from anchorlake.functions import text as T
from anchorlake.operators import composite, graph, journal, search
from anchorlake.operators.resolve import resolve_as_of
from anchorlake.plans import model as m
from anchorlake.plans import reports as rp
from anchorlake.plans import retrieval as r
from anchorlake.plans import similar

SCOPE = "pkg/"


def kb_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.tree(m.nodes(spark, sf_dir), m.entries(spark, sf_dir))


def node_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node as it is shown."""
    n, e = keep(m.nodes(spark, sf_dir)), keep(m.entries(spark, sf_dir))
    open_ = keep(graph.disputed(graph.open_disputes(e, n)))
    return composite.node_views(n, search.lanes(e, n, open_), journal.history(m.changes(spark, sf_dir), n), open_, m.now())


def kb_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page on the state of the project within 600 tokens."""
    n, e, c = keep(m.nodes(spark, sf_dir)), keep(m.entries(spark, sf_dir)), keep(m.changes(spark, sf_dir))
    suspect = n.where("status = 'suspect'").select("node_id", F.unix_timestamp("since").alias("rank")).select(F.col("node_id").alias("text"), "rank")
    risky = journal.landmines(c, n, e).select(F.concat("node_id", F.lit(" "), F.col("score").cast("string")).alias("text"), (-F.col("score")).alias("rank"))
    decided = c.where("what IS NOT NULL AND at IS NOT NULL").select(T.first_line(F.col("what"), 120).alias("text"), (-F.unix_timestamp("at")).alias("rank"))
    options = similar.rejected_options(c).where("at IS NOT NULL").select(T.first_line(F.col("option"), 120).alias("text"), (-F.unix_timestamp("at")).alias("rank"))
    return composite.brief([("suspect", 4, suspect), ("landmines", 3, risky), ("decisions", 3, decided), ("rejected", 3, options)], 200)


def file_landmines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = keep(m.nodes(spark, sf_dir))
    return composite.file_risks(n, journal.landmines(m.changes(spark, sf_dir), n, m.entries(spark, sf_dir)))


def scope_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why to take care in a folder."""
    n, e, c = keep(m.nodes(spark, sf_dir)), keep(m.entries(spark, sf_dir)), keep(m.changes(spark, sf_dir))
    live = c.join(journal.inactive(c), "id", "left_anti")
    told = similar.rejected_options(live).select("id").distinct()
    rejected = resolve_as_of(journal.touched(live).join(told, "id", "left_semi"), n).select("node_id").distinct()
    return composite.scoped_risks(n, e, graph.disputed(graph.open_disputes(e, n)), rejected, SCOPE)


def task_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bears on a task in one file."""
    n, laned = r._laned(spark, sf_dir)
    found = keep(search.search(r._index(n, laned), n, r.RISK_QUERY, 30))
    near = graph.neighbours([("flow", graph.same_flow(m.flows(spark, sf_dir), n, found))], found, laned, 20)
    return composite.task_evidence(found, near.join(found, "node_id", "left_anti"), SCOPE, n, laned)


def investigate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the library already holds on a question."""
    n, laned = r._laned(spark, sf_dir)
    question = "sticky cache eviction of the session index"
    return composite.known_answers(search.search(r._index(n, laned), n, question, 20), n, m.flows(spark, sf_dir), question)


def era_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest changes beyond each node's last summary, and how many lie before it."""
    n = keep(m.nodes(spark, sf_dir))
    era = m.entries(spark, sf_dir).where("active AND kind = 'summary'").groupBy("node_id").agg(F.max("at").alias("era_until"))
    return composite.folded_history(journal.history(m.changes(spark, sf_dir), n), era).select("node_id", "id", F.col("place").cast("long").alias("place"), "folded")


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the records of each case as a ranking, those in their expected lane being wanted."""
    rec = table(spark, sf_dir, "eval_records").select("record_id", F.col("case_id").alias("case"), F.lower(filled("lane")).alias("lane"), F.lower(filled("expected_lane")).alias("expected"), "node_id").where("record_id IS NOT NULL AND case IS NOT NULL AND lane IS NOT NULL AND node_id IS NOT NULL").distinct()
    place = F.row_number().over(composite.W.partitionBy("case", "lane").orderBy("record_id"))
    wanted = rec.where("expected IS NOT NULL").select("case", F.col("expected").alias("lane"), "node_id")
    return composite.retrieval_quality(rec.withColumn("place", place), wanted)


def symbol_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.suggestions(m.nodes(spark, sf_dir), "replay").select("node_id", "symbol", "rank")


def signature_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that only repeat their node's path and symbol."""
    n = m.nodes(spark, sf_dir).select("node_id", F.concat_ws(" ", "file", "symbol").alias("signature"))
    return composite.signature_echoes(m.entries(spark, sf_dir), n)


def doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health in one row: nodes, entries without a node, changes whose links can't be followed, flows without steps."""
    n, e, c, f = m.nodes(spark, sf_dir), m.entries(spark, sf_dir), m.changes(spark, sf_dir), m.flows(spark, sf_dir)
    parts = [
        n.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("check"), "n"),
        e.where("active").join(n.select("node_id"), "node_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("entries without node").alias("check"), "n"),
        journal.check_links(c).agg(F.count("*").alias("n")).select(F.lit("bad links").alias("check"), "n"),
        f.where("steps IS NULL OR size(steps) = 0").agg(F.count("*").alias("n")).select(F.lit("flows without steps").alias("check"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_LINE = "CASE WHEN length({0}) > 120 THEN substring({0}, 1, 120) || '…' ELSE {0} END"
_SCOPED = (
    m.BASE
    + r.RESOLVED
    + r.DISPUTES.replace(r.HEIRS, "", 1)
    + r.INACTIVE
    + f""",
tl AS (SELECT DISTINCT id FROM (SELECT id, unnest(rejected) AS x FROM c) WHERE {m.sql_filled('x.option')} IS NOT NULL AND id NOT IN (SELECT id FROM off)),
z AS (SELECT * FROM n WHERE starts_with(node_id, 'pkg/')), y AS (SELECT * FROM e WHERE active AND node_id IN (SELECT node_id FROM z))
SELECT node_id, 'suspect' AS reason FROM z WHERE status = 'suspect' UNION SELECT node_id, 'orphaned' FROM z WHERE status = 'orphaned' UNION SELECT node_id, 'pitfall' FROM y WHERE kind = 'pitfall'
UNION SELECT node_id, 'suspect-entry' FROM y WHERE confidence = 'suspect' UNION SELECT node_id, 'disputed' FROM y WHERE entry_id IN (SELECT src FROM od UNION SELECT dst FROM od)
UNION SELECT node_id, 'rejected' FROM r WHERE id IN (SELECT id FROM tl) AND node_id IN (SELECT node_id FROM z)
"""
)
SQL = {
    "kb_map": m.BASE
    + f", {rp._SYM}, cv AS (SELECT directory, sum(n)::BIGINT AS symbols, sum(d)::BIGINT AS digested, (sum(d) * 100 // sum(n))::BIGINT AS percent FROM (SELECT unnest({rp._UP}) AS directory, n, d FROM sy) GROUP BY directory), fl AS (SELECT CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*/)', 1) ELSE '.' END AS directory, count(DISTINCT file) AS files FROM n WHERE file IS NOT NULL GROUP BY 1) SELECT cv.*, coalesce(files, 0) AS files FROM cv LEFT JOIN fl USING (directory) WHERE directory = '.' OR len(string_split(directory, '/')) - 1 <= 2",
    "node_recall": m.BASE
    + r.HISTORY
    + r.DISPUTES.replace(r.HEIRS, "", 1)
    + f", {rp._ORDER.replace('FROM e WHERE active AND', 'FROM laned WHERE')}, mk AS (SELECT node_id, place, entry_id, list_filter([CASE WHEN lane = 'risk' THEN 'risk' END, CASE WHEN entry_id IN (SELECT src FROM od UNION SELECT dst FROM od) THEN 'disputed' END, CASE WHEN at < TIMESTAMP '{m.NOW}' - INTERVAL 90 DAY THEN 'overdue' END], lambda x: x IS NOT NULL) AS k FROM o), tx AS (SELECT node_id, string_agg(entry_id || CASE WHEN len(k) > 0 THEN ' [' || array_to_string(k, ',') || ']' ELSE '' END, '; ' ORDER BY place) AS entries FROM mk GROUP BY node_id), hc AS (SELECT node_id, count(*) AS changes FROM history GROUP BY node_id) SELECT node_id, status AS state, coalesce(entries, '') AS entries, coalesce(changes, 0) AS changes FROM n LEFT JOIN tx USING (node_id) LEFT JOIN hc USING (node_id)",
    "kb_brief": m.BASE
    + r.RESOLVED
    + r._RISKY
    + f""", p AS (SELECT * FROM (SELECT 0 AS no, 'suspect' AS section, epoch(since)::BIGINT AS rank, node_id AS text FROM n WHERE status = 'suspect' ORDER BY floor(epoch(since)) NULLS FIRST, text LIMIT 4)
UNION ALL SELECT * FROM (SELECT 1, 'landmines', -score AS rank, node_id || ' ' || score AS text FROM risky ORDER BY rank, text LIMIT 3)
UNION ALL SELECT * FROM (SELECT 2, 'decisions', -floor(epoch(at))::BIGINT AS rank, {_LINE.format("split_part(what, chr(10), 1)")} AS text FROM c WHERE what IS NOT NULL AND at IS NOT NULL ORDER BY rank, text LIMIT 3)
UNION ALL SELECT * FROM (SELECT 3, 'rejected', rank, {_LINE.format("split_part(op, chr(10), 1)")} AS text FROM (SELECT -floor(epoch(at))::BIGINT AS rank, {m.sql_filled('x.option')} AS op FROM (SELECT at, unnest(rejected) AS x FROM c WHERE at IS NOT NULL)) WHERE op IS NOT NULL ORDER BY rank, text LIMIT 3))
SELECT section, text, (sum({m.sql_estimate('text')}) OVER (ORDER BY no, rank, text ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM p QUALIFY spent <= 200""",
    "file_landmines": m.BASE + r.RESOLVED + r._RISKY + "SELECT file, sum(score)::BIGINT AS score FROM risky JOIN n USING (node_id) GROUP BY file HAVING sum(score) >= 3",
    "scope_risks": _SCOPED,
    "era_history": m.BASE
    + r.HISTORY
    + ", er AS (SELECT node_id, max(at) AS upto FROM e WHERE active AND kind = 'summary' GROUP BY node_id), fo AS (SELECT history.*, coalesce(at <= upto, false) AS old, count(*) FILTER (WHERE coalesce(at <= upto, false)) OVER (PARTITION BY node_id) AS folded FROM history LEFT JOIN er USING (node_id)) SELECT node_id, id, row_number() OVER (PARTITION BY node_id ORDER BY at DESC NULLS LAST, id DESC) AS place, folded FROM (SELECT * FROM fo WHERE NOT old) QUALIFY place <= 3",
    "retrieval_quality": f"WITH r AS (SELECT DISTINCT record_id, case_id AS k, {m.sql_word('lane')} AS lane, {m.sql_word('expected_lane')} AS expected, node_id FROM eval_records WHERE record_id IS NOT NULL AND case_id IS NOT NULL AND {m.sql_word('lane')} IS NOT NULL AND node_id IS NOT NULL), h AS (SELECT *, row_number() OVER (PARTITION BY k, lane ORDER BY record_id) AS place FROM r), w AS (SELECT DISTINCT k, expected AS lane, node_id, true AS yes FROM r WHERE expected IS NOT NULL), g AS (SELECT k, lane, count(*) AS hits, count(DISTINCT node_id) AS nodes, count(*) FILTER (WHERE lane = expected) AS correct, count(DISTINCT node_id) FILTER (WHERE yes) AS found, min(place) FILTER (WHERE yes) AS first FROM h LEFT JOIN w USING (k, lane, node_id) GROUP BY k, lane), c AS (SELECT * FROM (SELECT k, lane, count(*) AS need FROM w GROUP BY k, lane) LEFT JOIN g USING (k, lane)) SELECT lane, count(*) AS cases, round(avg(coalesce(found, 0) / need), 9) AS recall, round(avg(coalesce(1 / first, 0)), 9) AS mrr, round(sum(correct) / sum(hits), 9) AS lane_precision, round(sum(nodes) / sum(hits), 9) AS distinct_nodes FROM c GROUP BY lane",
    "symbol_suggestions": m.BASE
    + "SELECT node_id, symbol, (CASE WHEN lower(symbol) = 'replay' THEN 0 WHEN regexp_extract(lower(symbol), '([^.]*)$', 1) = 'replay' THEN 1 WHEN starts_with(lower(symbol), 'replay') THEN 2 WHEN contains(lower(symbol), 'replay') THEN 3 END)::INT AS rank FROM n WHERE contains(lower(symbol), 'replay') ORDER BY rank, abs(length(symbol) - 6), node_id LIMIT 5",
    "signature_echo": m.BASE
    + f", k AS (SELECT entry_id, list_filter({m.sql_tokens('text')}, lambda t: NOT regexp_matches(t, '[^\\x00-\\x7f]')) AS t, list_filter({m.sql_tokens('sg')}, lambda t: NOT regexp_matches(t, '[^\\x00-\\x7f]')) AS s FROM e JOIN (SELECT node_id, concat_ws(' ', file, symbol) AS sg FROM n) USING (node_id) WHERE active) SELECT entry_id FROM k WHERE len(t) >= 4 AND len(list_intersect(t, s)) * 10 >= len(t) * 7",
    "doctor": m.BASE + r.PROBLEMS + "SELECT 'nodes' AS \"check\", count(*) AS n FROM n UNION ALL SELECT 'entries without node', count(*) FROM e WHERE active AND (node_id IS NULL OR node_id NOT IN (SELECT node_id FROM n)) UNION ALL SELECT 'bad links', count(*) FROM problems WHERE problem IS NOT NULL UNION ALL SELECT 'flows without steps', count(*) FROM f WHERE steps IS NULL OR len(steps) = 0",
    "investigate": m.BASE + r.POSTINGS + r.found("x", "sticky cache eviction of the session index", None, 20) + f"SELECT 'flow' AS kind, id FROM f WHERE NOT deprecated AND len(list_intersect({m.sql_grams(chr(39) + 'sticky cache eviction of the session index' + chr(39))}, {m.sql_grams('coalesce(title, ' + chr(39) * 2 + ')')})) >= 2 UNION ALL SELECT 'node', node_id FROM x JOIN n USING (node_id) WHERE score >= 2 AND status = 'fresh'",
}
SQL["task_evidence"] = (
    m.BASE
    + r.POSTINGS
    + r.STEPS
    + r.found("x", r.RISK_QUERY, None, 30)
    + """, sn AS (SELECT flow, node_id FROM st JOIN n ON ref = node_id UNION SELECT flow, heir FROM st JOIN h ON ref = former WHERE ref NOT IN (SELECT node_id FROM n)),
fe AS (SELECT DISTINCT p.node_id AS a, q.node_id AS b FROM sn p JOIN sn q USING (flow) WHERE p.node_id <> q.node_id),
nb AS (SELECT b AS node_id, count(*) + CASE WHEN b IN (SELECT node_id FROM laned) THEN 2 ELSE 0 END AS score FROM fe JOIN x ON a = x.node_id WHERE b NOT IN (SELECT node_id FROM x) GROUP BY b ORDER BY score DESC, node_id LIMIT 20),
hi AS (SELECT node_id, min(place) AS place FROM (SELECT node_id, place FROM x UNION ALL SELECT node_id, 1000 FROM nb) GROUP BY node_id),
id AS (SELECT coalesce(hi.node_id, z.node_id) AS node_id, place, CASE WHEN z.node_id IS NOT NULL THEN 'exact' WHEN place = 1000 THEN 'near' ELSE 'other' END AS nearness FROM hi FULL JOIN (SELECT node_id FROM n WHERE starts_with(node_id, 'pkg/')) z ON hi.node_id = z.node_id)
SELECT node_id, entry_id, nearness, lane FROM laned JOIN id USING (node_id)
QUALIFY row_number() OVER (PARTITION BY nearness ORDER BY CASE WHEN lane = 'risk' THEN 0 ELSE 1 END, coalesce(place, 2000), entry_id) <= CASE WHEN nearness = 'exact' THEN 20 ELSE 6 END"""
)
SQL = {name: m.quoted(s) for name, s in SQL.items()}
QUERIES = {f.__name__: f for f in (kb_map, node_recall, kb_brief, file_landmines, scope_risks, task_evidence, investigate, era_history, retrieval_quality, symbol_suggestions, signature_echo, doctor)}
