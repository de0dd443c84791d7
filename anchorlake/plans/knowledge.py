"""Recall, tasks, writing and health over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake.common import keep, table
from anchorlake.functions import text as T
from anchorlake.operators import graph, health, journal, recall, search, tasks, writes
from anchorlake.operators.maintenance import in_scope
from anchorlake.operators.similarity import scored  # noqa: F401
from anchorlake.plans import code, similar
from anchorlake.plans import model as m
from anchorlake.plans import reports as rp
from anchorlake.plans import retrieval as r

SCOPE, FILE, SYMPTOM = "pkg/", "internal/session/lease_retry.go", "stale cache eviction of the session lease"


def wips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks in work: the tables have none, so each author's last change of a task stands for one (owner ``author@task``)."""
    c = m.changes(spark, sf_dir).where("task IS NOT NULL AND trim(task) <> '' AND author IS NOT NULL")
    last = c.groupBy("author", "task").agg(F.max(F.struct("at", "id", "nodes")).alias("_l"))
    return last.select(F.concat("author", F.lit("@"), "task").alias("owner"), "task", F.col("_l.nodes").alias("touching"), F.col("_l.at").alias("updated"))


def wip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and label of each task."""
    return tasks.labelled(wips(spark, sf_dir), m.now())


def wip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.counts(wips(spark, sf_dir), m.now())


def wip_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that touch a folder."""
    n = m.nodes(spark, sf_dir)
    return tasks.attached(wips(spark, sf_dir), n, in_scope(n, SCOPE))


def wip_closable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that others than their owners may close."""
    return tasks.closable(wips(spark, sf_dir), "", m.now()).select("owner", "task")


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: what their kinds and the number in their properties stand for."""
    k = F.get_json_object("props", "$.k").cast("int")
    tool = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "kb_recall", "error", "kb_recall", "click", "kb_remember", "purchase", "kb_record_change", "signup", "cli_precheck")]), F.col("event_type"))
    status = F.when(k < 20, "suspect").when(k < 40, "undigested").otherwise("fresh")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), tool.alias("tool"), (F.col("event_type") != "error").alias("ok"), (k >= 10).alias("hit"), status.alias("hitStatus"), (k % 7 == 0).cast("int").alias("stale"), (k % 3).alias("warnings"), (k > 90).alias("blocked"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.usage_totals(_usage(spark, sf_dir))


def session_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each session leaves behind."""
    open_ = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.concat(F.lit("u@s"), F.col("user_id").cast("string")).alias("owner"))
    return tasks.session_gate(_usage(spark, sf_dir), open_)


def node_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of raw node rows that several different rows have, or that leave the repository."""
    raw = table(spark, sf_dir, "nodes").select("node_id", "level", "status", "file", "symbol", "since", "lineage", "keywords").where("node_id IS NOT NULL")
    odd = raw.limit(1).select(F.explode(F.array(*map(F.lit, ("../x.go#F", "/etc/x", "a//b.go", "c:/x", "a/./b")))).alias("node_id"), "level", "status", "file", "symbol", "since", "lineage", "keywords")
    return health.quarantined(raw.unionByName(odd))[1]


def query_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three queries name: the first node's id, the first former id, the last part of the first symbol."""
    n = keep(m.nodes(spark, sf_dir))
    former = n.select(F.explode("lineage").alias("f")).join(n.select(F.col("node_id").alias("f")), "f", "left_anti").agg(F.min("f")).first()[0]
    first = n.agg(F.min("node_id"), F.min("symbol")).first()
    asked = [("exact", first[0] or ""), ("former", former or ""), ("loose", (first[1] or "").rsplit(".", 1)[-1])]
    out = None
    for name, q in asked:
        got = recall.resolve_query(n, f" {q} ").select(F.lit(name).alias("asked"), "node_id", "how")
        out = got if out is None else out.unionByName(got)
    return out


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vector records and the manifest of those that are current: the ones in the lane expected of them."""
    v = similar._records(spark, sf_dir).where("node_id IS NOT NULL AND lane IS NOT NULL AND vec IS NOT NULL").withColumn("hash", F.sha2(F.array_join(F.transform("vec", lambda x: x.cast("string")), ","), 256))
    return v, v.where("lane = expected")


def recall_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query by words, vectors and structure."""
    n, laned = r._laned(spark, sf_dir)
    e = m.entries(spark, sf_dir)
    rest = graph.rested_on_nodes(graph.entry_edges(e, n, "based_on"), e)
    back = rest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    v, manifest = _records(spark, sf_dir)
    got = recall.recall(n, r._index(n, laned), v, manifest, [("rests on", rest), ("supports", back)], e.where("active"), r.EXACT_QUERY, similar.QUERY)
    return got.select("lane", "node_id", "place", F.round("score", 9).alias("score"))


def nothing_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.nothing_found(m.nodes(spark, sf_dir), "window")


def file_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.file_suggestions(m.nodes(spark, sf_dir), FILE)


def diagnose_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, flows and rejected options that bear on a symptom."""
    n, laned = r._laned(spark, sf_dir)
    c = keep(m.changes(spark, sf_dir))
    live = similar.rejected_options(c.join(journal.inactive(c), "id", "left_anti"))
    return recall.diagnose(search.search(r._index(n, laned), n, r.RISK_QUERY, 50), laned, m.flows(spark, sf_dir), live, SYMPTOM)


def judged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be said of the entries that are no longer active, were they written again."""
    n, e = keep(m.nodes(spark, sf_dir)), keep(m.entries(spark, sf_dir))
    new = e.where("NOT active AND node_id IS NOT NULL").select("entry_id", "node_id", "kind", "text")
    return writes.judged(new, e, n).select("entry_id", "verdict", F.coalesce("reason", F.lit("")).alias("reason"))


def _refuted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, e = keep(m.nodes(spark, sf_dir)), keep(m.entries(spark, sf_dir))
    return e, keep(writes.refuted(e, n, e.where("active AND kind = 'contract'"), "chg_x"))


def refute_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What refuting all active contracts does to them and to all that rests on them."""
    return _refuted(spark, sf_dir)[1].select("entry_id", F.col("before.confidence").alias("before"), F.col("after.confidence").alias("after"))


def revert_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What undoes that once it has been done."""
    e, eff = _refuted(spark, sf_dir)
    done = e.withColumn("refuted_by", F.lit(None).cast("string")).join(eff.select("entry_id", F.col("after").alias("_a")), "entry_id", "left")
    done = done.withColumn("confidence", F.when(F.col("_a").isNotNull(), F.col("_a.confidence")).otherwise(F.col("confidence"))).withColumn("refuted_by", F.col("_a.refuted_by"))
    return writes.reverted(eff, done, ["confidence", "refuted_by"]).select("entry_id", F.col("before.confidence").alias("before"), F.col("after.confidence").alias("after"))


def overturn_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether changes that overturn others share a node with them."""
    return writes.overturned_in_scope(m.changes(spark, sf_dir), m.nodes(spark, sf_dir))


def claimed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after each orphan was claimed by the first fresh node of its file."""
    n = keep(m.nodes(spark, sf_dir))
    heir = n.where("status = 'fresh' AND file IS NOT NULL").groupBy("file").agg(F.min("node_id").alias("successor"))
    moves = n.where("status = 'orphaned'").join(heir, "file").select("node_id", "successor")
    return writes.claimed(n, moves).select("node_id", F.array_join(F.array_sort("lineage"), "|").alias("lineage"))


def reverified_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes per status after all suspect files were read again."""
    n = m.nodes(spark, sf_dir)
    return writes.reverified(n, n.where("status = 'suspect' AND level = 'file'"), m.now()).groupBy("status").agg(F.count("*").alias("nodes"), F.count_if(F.col("since") == m.now()).alias("anew"))


def flow_step_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that a flow couldn't be written with."""
    steps = graph.flow_steps(m.flows(spark, sf_dir)).select("flow", F.col("position").cast("long").alias("position"), "ref")
    return writes.step_problems(steps, m.nodes(spark, sf_dir))


def mass_suspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.mass_suspect(code.reconcile_status(spark, sf_dir))


def stale_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Things that have changed since a session last read them: views are reads, a purchase of the same thing changes it."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), F.get_json_object("props", "$.k").alias("node_id"), F.col("value").cast("string").alias("hash"), F.col("ts").alias("at"), "event_type", "event_id")
    current = e.where("event_type IN ('view', 'purchase')").groupBy("node_id").agg(F.max_by("hash", F.struct("at", "event_id")).alias("hash"))
    return health.stale_reads(e.where("event_type = 'view'"), current)


def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose text isn't what it was when they were last read."""
    old, new = code._hashed(spark, sf_dir)
    return health.stale_nodes(old.select("node_id", "hash"), new.select("node_id", "hash"))


def entries_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over all entries, whatever their order."""
    return health.fingerprint(m.entries(spark, sf_dir), ["node_id", "entry_id", "kind", "text"])


def index_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each vector when an index of the records expected in lane risk is brought up to date."""
    v, manifest = _records(spark, sf_dir)
    return health.reuse_plan(v.where("expected = 'risk'"), manifest).groupBy("action").agg(F.count("*").alias("records"))


def index_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of an index in eight situations."""
    shape = "id string, node_id string, lane string, hash string"
    a, b = spark.createDataFrame([("1", "n", "l", "x"), ("2", "n", "l", "y")], shape), spark.createDataFrame([("1", "n", "l", "x"), ("2", "n", "l", "z")], shape)
    other = spark.createDataFrame([("3", "n", "l", "x")], shape)
    on, of = {"enabled": True, "model": "a", "size": 8}, {"model": "a", "size": 8, "records": 2}
    cases = [("never set", a, a, {}, of), ("off", a, a, {"enabled": False}, of), ("no index", a, a, on, None), ("wrong count", a, a, on, of | {"records": 3}), ("other model", a, a, on, of | {"model": "b"}), ("as it is", a, a, on, of), ("one changed", a, b, on, of), ("all gone", a, other, on, of)]
    return spark.createDataFrame([(name, health.index_health(*x)) for name, *x in cases], "situation string, state string")


def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.index_size(similar._records(spark, sf_dir)).select("records", F.col("bytes").cast("long").alias("bytes"), "fits")


def patrol_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a patrol reads."""
    n, e = keep(m.nodes(spark, sf_dir)), keep(m.entries(spark, sf_dir))
    told = n.join(e.where("active").select("node_id").distinct(), "node_id", "left_semi")
    members = told.select("node_id", F.explode(F.array_distinct(F.transform("keywords", lambda w: F.lower(F.trim(w))))).alias("keyword")).where("keyword <> ''").distinct()
    return health.patrol(journal.clusters(told, e), members, e).select("keyword", "node_id", "entry_id", "place")


def maintenance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debts by kind in the best order, and the next eight."""
    return health.plan_lines(keep(rp.debts_all(spark, sf_dir)))


_WIPS = ", w AS (SELECT author || '@' || task AS owner, task, s.nodes AS touching, s.t AS updated FROM (SELECT author, task, max({'t': at, 'id': id, 'nodes': nodes}) AS s FROM c WHERE trim(task) <> '' AND author IS NOT NULL GROUP BY author, task))"
_AGE = rp._AGE.format("updated")
_STATE = f"CASE WHEN updated IS NULL THEN 'unknown' WHEN {_AGE} >= 604800 THEN 'stale' WHEN {_AGE} >= 86400 THEN 'idle' ELSE 'active' END"
_U = "WITH x AS (SELECT *, (props->>'$.k')::INT AS k FROM events), u AS (SELECT 's' || user_id AS session, CASE event_type WHEN 'click' THEN 'kb_remember' WHEN 'purchase' THEN 'kb_record_change' WHEN 'signup' THEN 'cli_precheck' ELSE 'kb_recall' END AS tool, event_type <> 'error' AS ok, k >= 10 AS hit, CASE WHEN k < 20 THEN 'suspect' WHEN k < 40 THEN 'undigested' ELSE 'fresh' END AS st, (k % 7 = 0)::INT AS stale, k % 3 AS warnings, k > 90 AS blocked FROM x)"
_NOW_IDS = r.HEIRS
_CASCADE = (
    m.BASE
    + r.HEIRS
    + r.ENDS
    + r._edges("based_on")
    + ", q AS (SELECT entry_id FROM e WHERE active AND kind = 'contract'), d AS (SELECT entry_id FROM q UNION SELECT src FROM d JOIN based_on_edges ON dst = d.entry_id), ff AS (SELECT entry_id, confidence AS before, 'refuted' AS after FROM e WHERE entry_id IN (SELECT entry_id FROM q) AND coalesce(confidence, '') <> 'refuted' UNION ALL SELECT entry_id, confidence, 'suspect' FROM e WHERE active AND coalesce(confidence, '') <> 'suspect' AND entry_id IN (SELECT entry_id FROM d) AND entry_id NOT IN (SELECT entry_id FROM q)) "
)
_LIKE = "EXISTS (SELECT 1 FROM g b WHERE b.node_id = a.node_id AND least(len(a.g), len(b.g)) * 5 > greatest(len(a.g), len(b.g)) * 4 AND len(list_intersect(a.g, b.g)) * 9 > (len(a.g) + len(b.g)) * 4)"
_BARE = "lower(regexp_replace(text, '[\\s\\x{0b}]+', '', 'g'))"


def _lint(patterns: list[str]) -> str:
    return " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p in patterns)


_TOK = m.sql_estimate("text")
_HARD = "CASE level WHEN 'project' THEN 300 WHEN 'dir' THEN 150 WHEN 'file' THEN 1000 WHEN 'stmt' THEN 50 ELSE 250 END"
_FRAME = lambda *cols: " || ".join(f"printf('%08X', strlen({c})) || {c}" for c in cols)
SQL = {
    "wip_labels": m.BASE + _WIPS + f" SELECT owner, task, {_STATE} AS state, CASE {_STATE} WHEN 'unknown' THEN 'stale age-unknown' WHEN 'active' THEN '' ELSE {_STATE} || ' ' || {rp._LABEL.format('(' + _AGE + ')')} END AS label FROM w",
    "wip_counts": m.BASE + _WIPS + f" SELECT count(*) AS tasks, count(*) FILTER (WHERE {_STATE} = 'idle') AS idle, count(*) FILTER (WHERE {_STATE} = 'stale') AS stale, count(*) FILTER (WHERE {_STATE} = 'unknown') AS unknown FROM w",
    "wip_attachments": m.BASE + r.HEIRS + _WIPS + ", t AS (SELECT owner, task, unnest(touching) AS ref FROM w) SELECT DISTINCT owner, task FROM t WHERE ref IN (SELECT node_id FROM n WHERE starts_with(node_id, 'pkg/')) OR (ref NOT IN (SELECT node_id FROM n) AND ref IN (SELECT former FROM h WHERE starts_with(heir, 'pkg/')))",
    "wip_closable": m.BASE + _WIPS + f" SELECT owner, task FROM w WHERE {_STATE} = 'stale'",
    "usage_totals": _U
    + ", a AS (SELECT count(*) FILTER (WHERE tool = 'kb_recall') AS recalls, count(*) FILTER (WHERE tool = 'kb_recall' AND hit) AS hits, count(*) FILTER (WHERE tool = 'kb_recall' AND st = 'undigested') AS undigested, count(*) FILTER (WHERE tool = 'kb_recall' AND stale > 0) AS stale, count(*) FILTER (WHERE tool = 'kb_remember' AND ok) AS remembers, count(*) FILTER (WHERE tool = 'kb_record_change' AND ok) AS changes, count(*) FILTER (WHERE tool = 'cli_precheck') AS prechecks, coalesce(sum(warnings) FILTER (WHERE tool = 'cli_precheck'), 0)::BIGINT AS warnings, count(*) FILTER (WHERE tool = 'cli_precheck' AND blocked) AS blocked FROM u) SELECT *, (hits * 100 // recalls)::BIGINT AS percent, stale > 0 AND changes < stale AS unrecorded FROM a",
    "session_gate": _U
    + ", o AS (SELECT 's' || user_id AS session, count(*) AS open_tasks FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT u.session, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE tool IN ('kb_recall', 'cli_precheck')) > 0 AND count(*) FILTER (WHERE tool NOT IN ('kb_recall', 'cli_precheck')) = 0 AS read_only, count(*) FILTER (WHERE tool = 'kb_record_change' AND ok) = 0 AS unrecorded, count(*) FILTER (WHERE tool IN ('kb_recall', 'cli_precheck') AND hit AND st = 'suspect') AS suspect, coalesce(any_value(open_tasks), 0) AS open_tasks FROM u LEFT JOIN o USING (session) GROUP BY u.session",
    "node_quarantine": "WITH d AS (SELECT DISTINCT node_id, level, status, file, symbol, since, lineage, keywords FROM nodes WHERE node_id IS NOT NULL) SELECT node_id, count(*) AS copies, 'twice' AS reason FROM d GROUP BY node_id HAVING count(*) > 1 UNION ALL SELECT * FROM (VALUES ('../x.go#F', 1, 'unsafe'), ('/etc/x', 1, 'unsafe'), ('a//b.go', 1, 'unsafe'), ('c:/x', 1, 'unsafe'), ('a/./b', 1, 'unsafe')) t(node_id, copies, reason)",
    "query_resolution": m.BASE
    + r.HEIRS
    + ", a AS (SELECT (SELECT min(node_id) FROM n) AS x, (SELECT min(former) FROM h WHERE former NOT IN (SELECT node_id FROM n)) AS y, (SELECT regexp_extract(min(symbol), '([^.]*)$', 1) FROM n) AS z) SELECT 'exact' AS asked, x AS node_id, 'exact' AS how FROM a UNION ALL SELECT 'former', heir, 'lineage' FROM h, a WHERE former = y UNION ALL SELECT 'loose', node_id, 'loose' FROM n, a WHERE regexp_extract(regexp_replace(symbol, '[()*]', '', 'g'), '([^.]*)$', 1) = z",
    "nothing_found": m.BASE + "SELECT 'symbol' AS kind, node_id AS shown FROM (SELECT node_id FROM n WHERE contains(lower(symbol), 'window') ORDER BY abs(length(symbol) - 6), node_id LIMIT 5) UNION ALL SELECT 'folder', d FROM (SELECT DISTINCT CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/', 1) ELSE '.' END AS d FROM n WHERE level = 'file' AND file IS NOT NULL ORDER BY d LIMIT 12)",
    "file_suggestions": m.BASE
    + f"SELECT node_id, (CASE WHEN l = '{FILE}' THEN 0 WHEN o = 'lease_retry.go' THEN 1 WHEN starts_with(l, '{FILE}') OR starts_with('{FILE}', l) OR starts_with(o, 'lease_retry.go') OR starts_with('lease_retry.go', o) THEN 2 WHEN contains(l, '{FILE}') OR contains('{FILE}', l) OR contains(o, 'lease_retry.go') OR contains('lease_retry.go', o) THEN 3 ELSE 4 END)::INT AS rank FROM (SELECT node_id, lower(node_id) AS l, lower(regexp_extract(node_id, '([^/]*)$', 1)) AS o FROM n WHERE level = 'file') ORDER BY rank, abs(length(node_id) - {len(FILE)}), node_id LIMIT 5",
    "diagnose_all": m.BASE
    + r.POSTINGS
    + r.INACTIVE
    + r.found("x", r.RISK_QUERY, None, 50)
    + f", nd AS (SELECT 'node' AS kind, node_id AS id, coalesce(p, 0) AS weight FROM x LEFT JOIN (SELECT node_id, count(*) AS p FROM laned WHERE kind = 'pitfall' GROUP BY node_id) USING (node_id) ORDER BY weight DESC, score DESC, node_id LIMIT 8), ro AS (SELECT DISTINCT id, at, {m.sql_filled('x.option')} AS option FROM (SELECT id, at, unnest(rejected) AS x FROM c WHERE id NOT IN (SELECT id FROM off)) WHERE {m.sql_filled('x.option')} IS NOT NULL), rj AS (SELECT 'rejected' AS kind, id, len(list_intersect({m.sql_grams('option')}, {m.sql_grams(chr(39) + SYMPTOM + chr(39))})) AS weight, at, option FROM ro) SELECT * FROM nd UNION ALL SELECT 'flow', id, w FROM (SELECT id, len(list_intersect({m.sql_grams('coalesce(title, chr(32))')}, {m.sql_grams(chr(39) + SYMPTOM + chr(39))})) AS w FROM f WHERE NOT deprecated) WHERE w >= 2 UNION ALL SELECT kind, id, weight FROM (SELECT * FROM rj WHERE weight >= 2 ORDER BY at DESC NULLS LAST, id, option LIMIT 5)",
    "judged_entries": m.BASE
    + f", g AS (SELECT node_id, {m.sql_grams('text')} AS g, {_BARE} AS k FROM e WHERE active AND node_id IS NOT NULL), a AS (SELECT entry_id, e.node_id AS node_id, text, level, {m.sql_grams('text')} AS g, {_BARE} AS k FROM e LEFT JOIN n USING (node_id) WHERE NOT active AND e.node_id IS NOT NULL), v AS (SELECT entry_id, CASE WHEN level IS NULL THEN 'no node' WHEN k = '' THEN 'no text' WHEN {_TOK} > {_HARD} THEN 'too long' WHEN ({_lint(T.INJECTIONS)}) OR (({_lint(T.ACTIONS)}) AND ({_lint(T.DIRECTIVES)})) THEN 'order' WHEN EXISTS (SELECT 1 FROM g b WHERE b.node_id = a.node_id AND b.k = a.k) THEN 'same' WHEN {_LIKE} THEN 'alike' WHEN level = 'file' AND {_TOK} > 600 THEN 'long' WHEN {_lint(T.ACTIONS)} THEN 'action' WHEN regexp_matches(text, '{T.TASK_WORDS}') THEN 'task' ELSE '' END AS reason FROM a) SELECT entry_id, CASE WHEN reason IN ('no node', 'no text', 'too long', 'order', 'same') THEN 'reject' WHEN reason <> '' THEN 'warn' ELSE 'ok' END AS verdict, reason FROM v",
    "refute_cascade": _CASCADE + "SELECT * FROM ff",
    "revert_effects": _CASCADE + "SELECT entry_id, after AS before, before AS after FROM ff",
    "overturn_scope": m.BASE
    + r.HEIRS
    + ", t AS (SELECT DISTINCT id, overturns, unnest(nodes) AS ref FROM c), o AS (SELECT id, overturns, ref AS node_id FROM t WHERE ref IN (SELECT node_id FROM n) UNION SELECT id, overturns, heir FROM t JOIN h ON ref = former WHERE ref NOT IN (SELECT node_id FROM n)), s AS (SELECT id, overturns, node_id AS x FROM o UNION SELECT id, overturns, unnest(lineage) FROM o JOIN n USING (node_id)), y AS (SELECT id, ref AS x FROM t UNION SELECT id, node_id FROM o) SELECT c.id, c.overturns, EXISTS (SELECT 1 FROM s JOIN y ON s.overturns = y.id AND s.x = y.x WHERE s.id = c.id) AS shared FROM c WHERE c.overturns IS NOT NULL",
    "claimed_nodes": m.BASE
    + ", p AS (SELECT file, min(node_id) AS successor FROM n WHERE status = 'fresh' AND file IS NOT NULL GROUP BY file), mv AS (SELECT n.node_id, successor, lineage FROM n JOIN p USING (file) WHERE status = 'orphaned'), a AS (SELECT successor AS node_id, list_distinct(flatten(list(list_concat([node_id], lineage)))) AS more FROM mv GROUP BY successor) SELECT node_id, array_to_string(list_sort(list_distinct(list_concat(lineage, coalesce(more, [])))), '|') AS lineage FROM n LEFT JOIN a USING (node_id) WHERE node_id NOT IN (SELECT node_id FROM mv)",
    "reverified_nodes": m.BASE + f", v AS (SELECT CASE WHEN status = 'suspect' AND level = 'file' THEN 'fresh' ELSE status END AS st, status = 'suspect' AND level = 'file' AS hit, since FROM n) SELECT st AS status, count(*) AS nodes, count(*) FILTER (WHERE hit OR since = TIMESTAMP '{m.NOW}') AS anew FROM v GROUP BY st",
    "flow_step_problems": m.BASE + r.HEIRS + r.STEPS + " SELECT flow, position, ref FROM st WHERE ref IS NOT NULL AND ref NOT IN (SELECT node_id FROM n) AND ref NOT IN (SELECT former FROM h)",
    "mass_suspect": code._H + ", o1 AS (SELECT o.node_id, o.hash = w.hash AS same, informed FROM o JOIN w USING (node_id)) SELECT nodes, suspects, suspects * 2 > nodes AS mass FROM (SELECT ((SELECT count(*) FROM o1) + (SELECT count(*) FROM mv) + (SELECT count(*) FROM come WHERE node_id NOT IN (SELECT b FROM mv)))::BIGINT AS nodes, (SELECT count(*) FROM o1 WHERE NOT same AND informed) AS suspects)",
    "stale_reads": "WITH x AS (SELECT 's' || user_id AS session, props->>'$.k' AS node_id, value AS h, ts, event_type, event_id FROM events), c AS (SELECT node_id, arg_max(h, {'t': ts, 'i': event_id}) AS h FROM x WHERE event_type IN ('view', 'purchase') GROUP BY node_id), l AS (SELECT session, node_id, arg_max(h, {'t': ts, 'h': h::VARCHAR}) AS h FROM x WHERE event_type = 'view' GROUP BY ALL) SELECT session, node_id FROM l JOIN c USING (node_id) WHERE l.h <> c.h",
    "stale_sources": code._H + " SELECT o.node_id, CASE WHEN w.hash IS NULL THEN 'missing' ELSE 'changed' END AS state FROM o LEFT JOIN w USING (node_id) WHERE w.hash IS NULL OR w.hash <> o.hash",
    "entries_fingerprint": m.BASE + f", y AS (SELECT sha256({_FRAME('a', 'b', 'k', 'text')}) AS h FROM (SELECT coalesce(node_id, '') AS a, entry_id AS b, coalesce(kind, '') AS k, text FROM e)), p AS (SELECT substring(h, 1, 2) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM y GROUP BY 1) SELECT sum(n)::BIGINT AS records, sha256(string_agg(d, '' ORDER BY p)) AS fingerprint FROM p",
    "index_reuse": similar._R + ", v AS (SELECT DISTINCT id, node_id, lane, expected, array_to_string(vec, ',') AS h FROM r WHERE node_id IS NOT NULL AND lane IS NOT NULL AND vec IS NOT NULL), o AS (SELECT * FROM v WHERE expected = 'risk'), w AS (SELECT * FROM v WHERE lane = expected) SELECT 'reuse' AS action, count(*) AS records FROM w WHERE expected = 'risk' HAVING count(*) > 0 UNION ALL SELECT 'embed', count(*) FROM w WHERE expected <> 'risk' HAVING count(*) > 0 UNION ALL SELECT 'drop', count(DISTINCT id) FROM o WHERE id NOT IN (SELECT id FROM w) HAVING count(*) > 0",
    "index_states": "SELECT * FROM (VALUES ('never set', 'unconfigured'), ('off', 'disabled'), ('no index', 'configured-no-index'), ('wrong count', 'corrupt'), ('other model', 'stale-provider'), ('as it is', 'ready'), ('one changed', 'partial'), ('all gone', 'stale-source')) t(situation, state)",
    "index_size": similar._R + " SELECT count(*) AS records, sum(strlen(id) + 4 * coalesce(len(vec), 0))::BIGINT AS bytes, true AS fits FROM r",
    "patrol_page": m.BASE
    + """, tn AS (SELECT * FROM n WHERE node_id IN (SELECT node_id FROM e WHERE active)), k AS (SELECT DISTINCT node_id, keyword FROM (SELECT node_id, unnest(list_transform(keywords, lambda w: lower(trim(w, ' ')))) AS keyword FROM tn) WHERE keyword <> ''),
g AS (SELECT keyword, list_sort(list(node_id)) AS members, sum(coalesce(x, 0))::BIGINT AS entries FROM k LEFT JOIN (SELECT node_id, count(*) AS x FROM e WHERE active GROUP BY node_id) USING (node_id) GROUP BY keyword HAVING count(*) >= 2),
cl AS (SELECT keyword, entries FROM g QUALIFY row_number() OVER (PARTITION BY members ORDER BY keyword) = 1),
tc AS (SELECT keyword, row_number() OVER (ORDER BY entries DESC, keyword) AS c FROM cl QUALIFY c <= 5),
er AS (SELECT node_id, entry_id, row_number() OVER (PARTITION BY node_id ORDER BY entry_id) AS r FROM e WHERE active QUALIFY r <= 3)
SELECT keyword, node_id, entry_id, row_number() OVER (ORDER BY c, node_id, r)::INT AS place FROM k JOIN tc USING (keyword) JOIN er USING (node_id) QUALIFY place <= 30""",
    "maintenance_plan": rp._DEBTS + "SELECT 'kind' AS part, list_position(['suspect-reverify', 'dispute-open', 'cross-dup', 'dup-entries', 'confidence-lag', 'summary-stale', 'era-compress', 'review-overdue'], kind)::INT AS place, kind || ': ' || count(*) AS line FROM debts GROUP BY kind UNION ALL SELECT 'next', row_number() OVER (ORDER BY debt)::INT, debt || ' [' || kind || '] ' || node_id FROM (SELECT * FROM debts ORDER BY debt LIMIT 8)",
}
SQL["recall_all"] = (
    m.BASE
    + r.POSTINGS
    + r._edges("based_on")
    + r.found("x", r.EXACT_QUERY, "current", 20)
    + r.found("y", r.EXACT_QUERY, "risk", 20)
    + similar._S.replace("WITH r AS", ", r AS", 1)
    + """, vb AS (SELECT lane, node_id, id, score FROM s WHERE node_id IS NOT NULL AND lane = expected QUALIFY row_number() OVER (PARTITION BY lane, node_id ORDER BY score DESC, id) = 1),
vt AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY score DESC, id) AS p0 FROM vb QUALIFY p0 <= 20), vl AS (SELECT lane, node_id, row_number() OVER (PARTITION BY lane ORDER BY p0) AS place FROM vt WHERE score >= 0.35),
cu AS (SELECT coalesce(x.node_id, v.node_id) AS node_id, coalesce(1 / (60 + x.place), 0) + coalesce(1 / (60 + v.place), 0) AS sc FROM x FULL JOIN (SELECT * FROM vl WHERE lane = 'current') v ON x.node_id = v.node_id),
c5 AS (SELECT node_id, sc, row_number() OVER (ORDER BY sc DESC, node_id) AS place FROM cu QUALIFY place <= 5),
rk AS (SELECT coalesce(y.node_id, v.node_id) AS node_id, least(y.place, v.place) AS p, y.node_id IS NOT NULL AS lex FROM y FULL JOIN (SELECT * FROM vl WHERE lane = 'risk') v ON y.node_id = v.node_id),
r5 AS (SELECT node_id, row_number() OVER (ORDER BY p, lex DESC, node_id) AS place FROM rk QUALIFY place <= 5),
ne AS (SELECT DISTINCT a.node_id AS src, b.node_id AS dst FROM based_on_edges g JOIN e a ON a.entry_id = g.src JOIN e b ON b.entry_id = g.dst WHERE a.node_id <> b.node_id),
ns AS (SELECT node_id, (count(*) + CASE WHEN node_id IN (SELECT node_id FROM e WHERE active) THEN 2 ELSE 0 END) AS sc FROM (SELECT dst AS node_id FROM ne JOIN c5 ON src = c5.node_id UNION ALL SELECT src FROM ne JOIN c5 ON dst = c5.node_id) WHERE node_id NOT IN (SELECT node_id FROM c5) GROUP BY node_id),
n5 AS (SELECT node_id, sc, row_number() OVER (ORDER BY sc DESC, node_id) AS place FROM ns QUALIFY place <= 5)
SELECT 'current' AS lane, node_id, place::INT AS place, round(sc, 9) AS score FROM c5 UNION ALL SELECT 'risk', node_id, place::INT, NULL FROM r5 UNION ALL SELECT 'history', node_id, place::INT, NULL FROM vl WHERE lane = 'history' AND place <= 5 UNION ALL SELECT 'near', node_id, place::INT, sc::DOUBLE FROM n5"""
)
SQL = {name: s if name in ("usage_totals", "session_gate", "stale_reads") else m.quoted(s) for name, s in SQL.items()}
QUERIES = {name: globals()[name] for name in SQL}
