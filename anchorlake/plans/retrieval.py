"""Search, resolution and graph queries over the project's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake.common import keep
from anchorlake.operators import graph, journal, resolve, search
from anchorlake.plans import model as m

EXACT_QUERY, FUZZY_QUERY, RISK_QUERY = "lease retry of the session checksum", "checkpointing", "stale cache eviction"


def _laned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, e = keep(m.nodes(spark, sf_dir)), keep(m.entries(spark, sf_dir))
    return n, keep(search.lanes(e, n, graph.disputed(graph.open_disputes(e, n))))


def _index(n: DataFrame, laned: DataFrame) -> DataFrame:
    """The stored search index, one folder per lane, so that a search of one lane reads no other; in order of tokens, so that a
    token's rows lie together and other row groups are passed over."""
    return keep(search.postings(n, laned).sortWithinPartitions("lane", "token"), "lane")


def _search(query: str, lane: str | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    n, laned = _laned(spark, sf_dir)
    post = _index(n, laned)
    return search.search(post if lane is None else post.where(F.col("lane") == lane), n, query)


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes per lane and token of the search index."""
    n, laned = _laned(spark, sf_dir)
    return search.postings(n, laned).groupBy("lane", "token").agg(F.count("*").alias("nodes"))


def entry_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lane of each entry that may be shown."""
    return _laned(spark, sf_dir)[1].select("entry_id", "lane")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexical rankings fused by reciprocal ranks."""
    n, laned = _laned(spark, sf_dir)
    post = _index(n, laned)
    out = search.fuse(search.search(post.where("lane = 'current'"), n, EXACT_QUERY, 20), search.search(post.where("lane = 'risk'"), n, RISK_QUERY, 20))
    return out.select("node_id", F.round("score", 9).alias("score"), "place")


def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of risks merged by the better place."""
    n, laned = _laned(spark, sf_dir)
    post = _index(n, laned).where("lane = 'risk'")
    return search.merge_evidence(search.search(post, n, RISK_QUERY, 20), search.search(post, n, EXACT_QUERY, 20))


def change_history_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of each current node."""
    return journal.history(m.changes(spark, sf_dir), m.nodes(spark, sf_dir)).select("node_id", "id", "via_lineage")


def lineage_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nodes that changes name mean as of the change."""
    return resolve.resolve_as_of(journal.touched(m.changes(spark, sf_dir)), m.nodes(spark, sf_dir)).select("id", "ref", "node_id", "via_lineage").distinct()


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three changes of each node."""
    return journal.recent(journal.history(m.changes(spark, sf_dir), m.nodes(spark, sf_dir))).select("node_id", "id", F.col("place").cast("long").alias("place"))


def flow_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows of each node, as of their steps."""
    steps = graph.flow_steps(m.flows(spark, sf_dir))
    return resolve.resolve_as_of(steps, m.nodes(spark, sf_dir)).select("node_id", "flow").distinct()


def flow_vanished_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of flows whose node is gone or suspect."""
    n = m.nodes(spark, sf_dir)
    steps = graph.flow_steps(m.flows(spark, sf_dir)).select("flow", "position", "ref")
    got = resolve.resolve_now(steps, n).join(n.select("node_id", "status"), "node_id")
    state = steps.join(got.select("flow", "position", "node_id", "status"), ["flow", "position"], "left")
    return state.where("status IS NULL OR status IN ('suspect', 'orphaned')").select("flow", F.col("position").cast("long").alias("position"), "ref", F.coalesce("status", F.lit("vanished")).alias("state")).distinct()


def landmine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five riskiest nodes."""
    return journal.landmines(m.changes(spark, sf_dir), m.nodes(spark, sf_dir), m.entries(spark, sf_dir)).orderBy(F.desc("score"), "node_id").limit(5)


def landmine_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all risky nodes."""
    return journal.landmines(m.changes(spark, sf_dir), m.nodes(spark, sf_dir), m.entries(spark, sf_dir))


def inactive_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes without effect."""
    return journal.inactive(m.changes(spark, sf_dir))


def journal_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of changes that can't be followed."""
    return journal.check_links(m.changes(spark, sf_dir))


def supersede_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the successors of each superseded entry end."""
    return resolve.chain_ends(m.entries(spark, sf_dir)).where("steps > 0").select("entry_id", "last_id", "steps")


def open_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disputes with both sides active, each pair once whichever side declares it."""
    d = graph.open_disputes(m.entries(spark, sf_dir), m.nodes(spark, sf_dir))
    return d.select(F.least("src", "dst").alias("entry_a"), F.greatest("src", "dst").alias("entry_b")).distinct()


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entry rests on which, after renames and successors."""
    return graph.entry_edges(m.entries(spark, sf_dir), m.nodes(spark, sf_dir), "based_on")


def dependents_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that rests, directly or not, on refuted entries."""
    e = m.entries(spark, sf_dir)
    return graph.dependents(graph.entry_edges(e, m.nodes(spark, sf_dir), "based_on"), e.where("confidence = 'refuted'"))


def structural_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes one step from the best hits of a search: entries that rest on each other, and flows."""
    n, laned = _laned(spark, sf_dir)
    e = m.entries(spark, sf_dir)
    rest = graph.rested_on_nodes(graph.entry_edges(e, n, "based_on"), e)
    back = rest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hits = keep(search.search(_index(n, laned).where("lane = 'current'"), n, EXACT_QUERY))
    return graph.neighbours([("rests on", rest), ("supports", back), ("flow", graph.same_flow(m.flows(spark, sf_dir), n, hits))], hits, e.where("active"))


def patrol_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that several nodes share."""
    return journal.clusters(m.nodes(spark, sf_dir), m.entries(spark, sf_dir))


def exact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose symbol, or its last part, is one of the searched words (loose match)."""
    want = ["RetryQuota", "Pitfall.TrimSymbolBuffer", "SealFrame", "RebuildBarrier"]
    s = F.regexp_replace("symbol", r"[()*]", "")
    return m.nodes(spark, sf_dir).where(s.isin(want) | F.substring_index(s, ".", -1).isin(want)).select("node_id")


def zero_hit_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to offer where nothing matches: five symbols that contain the word, closest in length first."""
    word = "window"
    n = m.nodes(spark, sf_dir).where(F.contains(F.lower("symbol"), F.lit(word)))
    return n.orderBy(F.abs(F.length("symbol") - len(word)), "node_id").limit(5).select("node_id", "symbol")


def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight nodes for a symptom: those with most pitfalls first, then by score."""
    n, laned = _laned(spark, sf_dir)
    found = search.search(_index(n, laned), n, RISK_QUERY, 50)
    pit = laned.where("kind = 'pitfall'").groupBy("node_id").agg(F.count("*").alias("pitfalls"))
    return found.join(pit, "node_id", "left").select("node_id", F.coalesce("pitfalls", F.lit(0)).alias("pitfalls"), "score").orderBy(F.desc("pitfalls"), F.desc("score"), "node_id").limit(8)


# The same in SQL

HEIRS = """,
h AS (SELECT DISTINCT node_id AS heir, unnest(lineage) AS former FROM n)
"""
RESOLVED = (
    HEIRS
    + f""",
t AS (SELECT DISTINCT id, at, {m.sql_filled('r')} AS ref FROM (SELECT id, at, unnest(nodes) AS r FROM c) WHERE {m.sql_filled('r')} IS NOT NULL),
s AS (SELECT t.id AS id, t.at AS at, t.ref AS ref, n.node_id AS exact, n.since AS since, t.ref IN (SELECT former FROM h) AS inherited FROM t LEFT JOIN n ON t.ref = n.node_id),
r AS (SELECT id, at, ref, exact AS node_id, false AS via_lineage FROM s WHERE exact IS NOT NULL AND (since IS NULL OR at >= since OR (at IS NULL AND NOT inherited))
  UNION ALL SELECT id, at, ref, heir, true FROM s JOIN h ON ref = former WHERE exact IS NULL OR since IS NULL OR at IS NULL OR at < since),
hist AS (SELECT r.node_id, r.id, r.at, bool_and(via_lineage) AS via_lineage FROM r JOIN n USING (node_id) GROUP BY ALL)
"""
)
HISTORY = RESOLVED + ", history AS (SELECT hist.* FROM hist JOIN n USING (node_id) WHERE via_lineage OR since IS NULL OR at >= since)"


def _edges(column: str) -> str:
    """Tables ends (entry to the last of its successors) and ``column``_edges."""
    return f""",
q_{column} AS (SELECT DISTINCT src, ref, regexp_replace(ref, '#[^#]*$', '') AS node, regexp_extract(ref, '#([^#]*)$', 1) AS entry FROM (SELECT entry_id AS src, {m.sql_filled('x')} AS ref FROM (SELECT entry_id, unnest({column}) AS x FROM e)) WHERE contains(ref, '#')),
m_{column} AS (SELECT src, ref, 0 AS rank, node_id, last_id FROM q_{column} JOIN ends ON node = node_id AND entry = entry_id
  UNION ALL SELECT src, ref, 1, node_id, last_id FROM q_{column} JOIN h ON node = former JOIN ends ON heir = node_id AND entry = entry_id),
{column}_edges AS (SELECT DISTINCT src, dst FROM (SELECT src, ref, arg_min(last_id, {{'r': rank, 'n': node_id, 'l': last_id}}) AS dst FROM m_{column} GROUP BY src, ref))
"""


ENDS = """,
walk AS (SELECT node_id, entry_id, entry_id AS last_id, superseded_by AS nxt, 0 AS steps FROM e
  UNION ALL SELECT w.node_id, w.entry_id, x.entry_id, x.superseded_by, steps + 1 FROM walk w JOIN e x ON x.node_id = w.node_id AND x.entry_id = w.nxt AND w.nxt <> w.last_id WHERE steps < 32),
ends AS (SELECT node_id, entry_id, arg_max(last_id, steps) AS last_id, max(steps) AS steps FROM walk GROUP BY node_id, entry_id)
"""
DISPUTES = (
    HEIRS
    + ENDS
    + _edges("disputes")
    + """,
od AS (SELECT src, dst FROM disputes_edges WHERE src IN (SELECT entry_id FROM e WHERE active) AND dst IN (SELECT entry_id FROM e WHERE active)),
laned AS (SELECT e.*, CASE WHEN coalesce(e.kind = 'pitfall', false) OR n.status = 'suspect' OR coalesce(e.confidence = 'suspect', false) OR entry_id IN (SELECT src FROM od UNION SELECT dst FROM od) THEN 'risk' ELSE 'current' END AS lane
  FROM e JOIN n USING (node_id) WHERE active AND n.status <> 'orphaned')
"""
)
POSTINGS = (
    DISPUTES
    + f""",
post AS (SELECT DISTINCT * FROM (
  SELECT 'current' AS lane, unnest(list_concat(list_concat(flatten(list_transform(string_split(coalesce(file, ''), '/'), lambda p: {m.sql_tokens('p')})), {m.sql_parts("coalesce(symbol, '')")}), flatten(list_transform(keywords, lambda k: {m.sql_tokens('k')})))) AS token, node_id FROM n
  UNION ALL SELECT lane, unnest({m.sql_tokens('text')}), node_id FROM laned) WHERE token <> '')
"""
)


def found(name: str, query: str, lane: str | None, limit: int = 10) -> str:
    """A table ``name`` with the result of a search."""
    q = "'" + query + "'"
    where = f"WHERE lane = '{lane}'" if lane else ""
    return f""",
{name}_p AS (SELECT DISTINCT token, node_id FROM post {where}),
{name}_q AS (SELECT unnest({m.sql_tokens(q)}) AS token),
{name}_g AS (SELECT trigram, count(*) AS times FROM (SELECT unnest({m.sql_windows('token', 3)}) AS trigram FROM {name}_q WHERE length(token) >= 3 AND NOT regexp_matches(token, '[^\\x00-\\x7f]')) GROUP BY trigram),
{name}_h AS (SELECT node_id, 2 AS points FROM {name}_p JOIN {name}_q USING (token)),
{name}_t AS (SELECT DISTINCT node_id, unnest({m.sql_windows('token', 3)}) AS trigram FROM {name}_p WHERE length(token) >= 3 AND NOT regexp_matches(token, '[^\\x00-\\x7f]') AND (SELECT count(*) FROM {name}_h) < 3),
{name}_s AS (SELECT node_id, sum(points)::BIGINT AS score FROM (SELECT * FROM {name}_h UNION ALL SELECT node_id, times FROM {name}_t JOIN {name}_g USING (trigram)) GROUP BY node_id),
{name} AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, CASE level WHEN 'function' THEN 0 WHEN 'decl' THEN 0 WHEN 'file' THEN 1 WHEN 'stmt' THEN 2 WHEN 'dir' THEN 3 ELSE 4 END, node_id)::INT AS place FROM {name}_s JOIN n USING (node_id) QUALIFY place <= {limit})
"""


_RISKY = f"""
, points AS (SELECT node_id, w AS points FROM (SELECT DISTINCT node_id, id FROM r) JOIN (SELECT id, CASE WHEN overturns IS NOT NULL OR reverts IS NOT NULL THEN 3 ELSE 1 END AS w FROM c) USING (id)
  UNION ALL SELECT node_id, 1 FROM e JOIN n USING (node_id) WHERE e.confidence = 'refuted'),
risky AS (SELECT node_id, sum(points)::BIGINT AS score FROM points GROUP BY node_id HAVING sum(points) >= 3)
"""
PROBLEMS = """, links AS (SELECT id, at, unnest([overturns, reverts]) AS target FROM c),
problems AS (SELECT DISTINCT l.id, l.target, CASE WHEN l.id = l.target THEN 'self' WHEN t.id IS NULL THEN 'missing' WHEN t.at > l.at THEN 'later' END AS problem FROM links l LEFT JOIN c t ON l.target = t.id WHERE l.target IS NOT NULL)
"""
INACTIVE = (
    PROBLEMS
    + """, bad AS (SELECT * FROM problems WHERE problem IS NOT NULL),
rv AS (SELECT id AS via, reverts AS target FROM c WHERE reverts IS NOT NULL AND (id, reverts) NOT IN (SELECT id, target FROM bad)),
ov AS (SELECT id AS via, overturns AS target FROM c WHERE overturns IS NOT NULL AND (id, overturns) NOT IN (SELECT id, target FROM bad)),
s0 AS (SELECT id, true AS applied FROM c WHERE id NOT IN (SELECT target FROM rv)),
"""
)
_levels = 12
for _k in range(1, _levels):
    INACTIVE += f"s{_k} AS (SELECT * FROM s{_k - 1} UNION ALL SELECT target, NOT bool_or(coalesce(applied, false)) FROM rv LEFT JOIN s{_k - 1} ON via = s{_k - 1}.id WHERE target NOT IN (SELECT id FROM s{_k - 1}) GROUP BY target HAVING bool_or(coalesce(applied, false)) OR bool_and(applied IS NOT NULL)),\n"
INACTIVE += f"off AS (SELECT id FROM s{_levels - 1} WHERE NOT applied UNION SELECT target FROM ov WHERE via NOT IN (SELECT id FROM s{_levels - 1} WHERE NOT applied))\n"
STEPS = f""", st AS (SELECT id AS flow, i AS position, {m.sql_filled('steps[i + 1].node')} AS ref, coalesce(steps[i + 1].since, since) AS at FROM (SELECT *, unnest(range(len(steps))) AS i FROM f WHERE NOT deprecated))"""
_NOW = HEIRS + STEPS + """, sn AS (SELECT flow, position, ref, node_id FROM st JOIN n ON ref = node_id UNION ALL SELECT flow, position, ref, heir FROM st JOIN h ON ref = former WHERE ref NOT IN (SELECT node_id FROM n))"""
_FLOWS = RESOLVED.replace("t AS (", "t0 AS (", 1).replace("FROM t LEFT", "FROM (SELECT flow AS id, at, ref FROM st WHERE ref IS NOT NULL) t LEFT")
SQL = {
    "lex_search_exact": m.BASE + POSTINGS + found("x", EXACT_QUERY, "current") + "SELECT * FROM x",
    "lex_search_trigram_fallback": m.BASE + POSTINGS + found("x", FUZZY_QUERY, "current") + "SELECT * FROM x",
    "lex_search_risk": m.BASE + POSTINGS + found("x", RISK_QUERY, "risk") + "SELECT * FROM x",
    "lex_search_all": m.BASE + POSTINGS + found("x", RISK_QUERY, None) + "SELECT * FROM x",
    "index_postings": m.BASE + POSTINGS + "SELECT lane, token, count(*) AS nodes FROM post GROUP BY ALL",
    "entry_lanes": m.BASE + DISPUTES + "SELECT entry_id, lane FROM laned",
    "rrf_fusion": m.BASE
    + POSTINGS
    + found("x", EXACT_QUERY, "current", 20)
    + found("y", RISK_QUERY, "risk", 20)
    + "SELECT node_id, round(s, 9) AS score, row_number() OVER (ORDER BY s DESC, node_id)::INT AS place FROM (SELECT coalesce(x.node_id, y.node_id) AS node_id, coalesce(1 / (60 + x.place), 0) + coalesce(1 / (60 + y.place), 0) AS s FROM x FULL JOIN y ON x.node_id = y.node_id) QUALIFY place <= 10",
    "merged_evidence": m.BASE + POSTINGS + found("x", RISK_QUERY, "risk", 20) + found("y", EXACT_QUERY, "risk", 20) + "SELECT coalesce(x.node_id, y.node_id) AS node_id, least(x.place, y.place) AS place, x.node_id IS NOT NULL AS lexical FROM x FULL JOIN y ON x.node_id = y.node_id",
    "change_history_asof": m.BASE + HISTORY + "SELECT node_id, id, via_lineage FROM history",
    "lineage_resolve": m.BASE + RESOLVED + "SELECT DISTINCT id, ref, node_id, via_lineage FROM r",
    "recent_history": m.BASE + HISTORY + "SELECT node_id, id, row_number() OVER (PARTITION BY node_id ORDER BY at DESC NULLS LAST, id DESC) AS place FROM history QUALIFY place <= 3",
    "flow_links": m.BASE + STEPS + _FLOWS + "SELECT DISTINCT node_id, id AS flow FROM r",
    "flow_vanished_steps": m.BASE + _NOW + "SELECT DISTINCT st.flow, st.position, st.ref, coalesce(status, 'vanished') AS state FROM st LEFT JOIN sn USING (flow, position) LEFT JOIN n USING (node_id) WHERE st.ref IS NOT NULL AND (status IS NULL OR status IN ('suspect', 'orphaned'))",
    "landmine_top": m.BASE + RESOLVED + _RISKY + "SELECT * FROM risky ORDER BY score DESC, node_id LIMIT 5",
    "landmine_score": m.BASE + RESOLVED + _RISKY + "SELECT * FROM risky",
    "inactive_changes": m.BASE + INACTIVE + "SELECT DISTINCT id FROM off",
    "journal_problems": m.BASE + PROBLEMS + "SELECT * FROM problems WHERE problem IS NOT NULL",
    "supersede_chain": m.BASE + ENDS + "SELECT entry_id, last_id, steps::BIGINT AS steps FROM ends WHERE steps > 0",
    "open_disputes": m.BASE + DISPUTES + "SELECT DISTINCT least(src, dst) AS entry_a, greatest(src, dst) AS entry_b FROM od",
    "reference_edges": m.BASE + HEIRS + ENDS + _edges("based_on") + "SELECT * FROM based_on_edges",
    "dependents_closure": m.BASE
    + HEIRS
    + ENDS
    + _edges("based_on")
    + ", d AS (SELECT entry_id AS root, entry_id, 0 AS depth FROM e WHERE confidence = 'refuted' UNION SELECT d.root, src, depth + 1 FROM d JOIN based_on_edges ON dst = d.entry_id WHERE depth < 40) SELECT root, entry_id, min(depth)::BIGINT AS depth FROM d WHERE entry_id <> root GROUP BY ALL",
    "structural_neighbors": m.BASE
    + POSTINGS
    + STEPS
    + _edges("based_on")
    + found("x", EXACT_QUERY, "current")
    + """, sn AS (SELECT flow, node_id FROM st JOIN n ON ref = node_id UNION SELECT flow, heir FROM st JOIN h ON ref = former WHERE ref NOT IN (SELECT node_id FROM n)),
ne AS (SELECT DISTINCT a.node_id AS src, b.node_id AS dst FROM based_on_edges g JOIN e a ON a.entry_id = g.src JOIN e b ON b.entry_id = g.dst WHERE a.node_id <> b.node_id),
st3 AS (SELECT dst FROM ne WHERE src IN (SELECT node_id FROM x) UNION ALL SELECT src FROM ne WHERE dst IN (SELECT node_id FROM x)),
all_steps AS (SELECT e1.dst AS node_id FROM (SELECT DISTINCT src, dst FROM ne) e1 JOIN x ON src = x.node_id UNION ALL SELECT e2.src FROM ne e2 JOIN x ON dst = x.node_id
  UNION ALL SELECT b FROM (SELECT DISTINCT p.node_id AS a, q.node_id AS b FROM sn p JOIN sn q USING (flow) WHERE p.node_id <> q.node_id) JOIN x ON a = x.node_id)
SELECT node_id, (count(*) + CASE WHEN node_id IN (SELECT node_id FROM e WHERE active) THEN 2 ELSE 0 END)::BIGINT AS score FROM all_steps WHERE node_id NOT IN (SELECT node_id FROM x) GROUP BY node_id ORDER BY score DESC, node_id LIMIT 5""",
    "patrol_clusters": m.BASE
    + """, k AS (SELECT DISTINCT node_id, keyword FROM (SELECT node_id, unnest(list_transform(keywords, lambda w: lower(trim(w, ' ')))) AS keyword FROM n) WHERE keyword <> ''),
g AS (SELECT keyword, list_sort(list(node_id)) AS members, sum(coalesce(x, 0))::BIGINT AS entries FROM k LEFT JOIN (SELECT node_id, count(*) AS x FROM e WHERE active GROUP BY node_id) USING (node_id) GROUP BY keyword HAVING count(*) >= 2)
SELECT keyword, len(members) AS nodes, entries FROM g QUALIFY row_number() OVER (PARTITION BY members ORDER BY keyword) = 1""",
    "exact_recall": m.BASE + "SELECT node_id FROM n WHERE regexp_replace(symbol, '[()*]', '', 'g') IN ('RetryQuota', 'Pitfall.TrimSymbolBuffer', 'SealFrame', 'RebuildBarrier') OR regexp_extract(regexp_replace(symbol, '[()*]', '', 'g'), '([^.]*)$', 1) IN ('RetryQuota', 'Pitfall.TrimSymbolBuffer', 'SealFrame', 'RebuildBarrier')",
    "zero_hit_suggestions": m.BASE + "SELECT node_id, symbol FROM n WHERE contains(lower(symbol), 'window') ORDER BY abs(length(symbol) - 6), node_id LIMIT 5",
    "diagnose": m.BASE + POSTINGS + found("x", RISK_QUERY, None, 50) + "SELECT node_id, coalesce(p, 0) AS pitfalls, score FROM x LEFT JOIN (SELECT node_id, count(*) AS p FROM laned WHERE kind = 'pitfall' GROUP BY node_id) USING (node_id) ORDER BY pitfalls DESC, score DESC, node_id LIMIT 8",
}
SQL = {name: m.quoted(s) for name, s in SQL.items()}
QUERIES = {
    "lex_search_exact": partial(_search, EXACT_QUERY, "current"),
    "lex_search_trigram_fallback": partial(_search, FUZZY_QUERY, "current"),
    "lex_search_risk": partial(_search, RISK_QUERY, "risk"),
    "lex_search_all": partial(_search, RISK_QUERY, None),
} | {f.__name__: f for f in (index_postings, entry_lanes, rrf_fusion, merged_evidence, change_history_asof, lineage_resolve, recent_history, flow_links, flow_vanished_steps, landmine_top, landmine_score, inactive_changes, journal_problems, supersede_chain, open_disputes, reference_edges, dependents_closure, structural_neighbors, patrol_clusters, exact_recall, zero_hit_suggestions, diagnose)}
