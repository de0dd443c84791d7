"""Source files, call graph, reconciliation and cards over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake.common import keep, table
from anchorlake.operators import calls, cards, graph, health, journal, search, sources
from anchorlake.plans import model as m
from anchorlake.plans import retrieval as r
from anchorlake.sources import files as io

INCLUDE, EXCLUDE = ["src/", "pkg/", "internal/", "lib/"], ["internal/parser/", "pkg/quota/*.rs"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files")


def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files after including and excluding patterns."""
    return sources.admitted(_files(spark, sf_dir).select("file").distinct(), INCLUDE, EXCLUDE)


#: Beginnings of files, and whether they say that a tool wrote them.
GENERATED = {
    "case/first.go": ("// Code generated by protoc. DO NOT EDIT.\npackage a\n", True),
    "case/later.go": ("/* licence */\n\n// source: a.proto\r\n// Code generated by x. DO NOT EDIT.\r\npackage a\n", True),
    "case/after.go": ("package a\n// Code generated by x. DO NOT EDIT.\n", False),
    "case/other.go": ("// code generated by x, do not edit\npackage a\n", False),
    "case/block.go": ("/*\n// Code generated by x. DO NOT EDIT.\n*/\npackage a\n", False),
    "case/hash.py": ("# auto-generated\nx = 1\n", False),
}


def generated_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a tool wrote, by the comments at their top; with cases, as the tables have none."""
    cases = spark.createDataFrame([(f, None, t) for f, (t, _) in GENERATED.items()], "file string, lang string, src_text string")
    return sources.generated_files(_files(spark, sf_dir).select("file", "lang", "src_text").unionByName(cases))


def symbol_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declarations of all files."""
    return sources.symbols(_files(spark, sf_dir))


def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations per language and kind."""
    return sources.symbols(_files(spark, sf_dir)).groupBy("lang", "kind").agg(F.count("*").alias("symbols"))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(sources.symbols(_files(spark, sf_dir)))


def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of Go functions that can be resolved."""
    return calls.call_graph(_files(spark, sf_dir), MODULE_NAME)[0]


#: A small module whose calls are known, as the files of the tables hardly call each other.
MODULE_NAME = "example.com/deck"
MODULE = {
    "store/disk.go": 'package store\n\nimport (\n\t"fmt"\n\tx "example.com/deck/plan"\n)\n\ntype Keeper interface {\n\tSealer\n\tPut(k string)\n}\n\ntype (\n\tSealer interface{ Seal() error }\n\tDisk struct{}\n)\n\nfunc (d *Disk) Put(k string) {\n\td.Seal() // d.Lost()\n\tnote(k)\n\tx.Chart()\n\tfmt.Println("note(", k)\n}\n\nfunc (d *Disk) Seal() error { return nil }\n\nvar start = open()\n\nfunc open() *Disk { return &Disk{} }\n',
    "store/note.go": "package store\n\nfunc note(k string) { trim(k) }\n\nfunc trim(k string) string { return k }\n",
    "store/note_test.go": 'package store_test\n\nfunc note(k string) {}\n\nfunc TestX() { note("a") }\n',
    "plan/chart.go": 'package plan\n\ntype Tape struct{}\n\nfunc (t Tape) Put(k string) {}\n\nfunc (t Tape) Seal() error { return nil }\n\nfunc Chart() {\n\tk := pick()\n\tk.Put("a")\n\tk.Trim()\n}\n\nfunc Run(s Keeper) { s.Seal() }\n\ntype Odd interface {\n\t~int | string\n\tPut(k string)\n}\n',
    "plan/pick.go": "package plan\n\nfunc pick() Tape { return Tape{} }\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"example.com/deck/plan"\n\t"example.com/deck/store"\n)\n\nfunc main() {\n\tplan.Chart()\n\ts := store.Make()\n\ts.Seal()\n\tgo run(s)\n}\n\nfunc run(s any) { main() }\n',
}
#: Its calls and implementations, found by reading it.
MODULE_CALLS = [
    ("store/disk.go#Disk.Put", "store/disk.go#Disk.Seal"),
    ("store/disk.go#Disk.Put", "store/note.go#note"),
    ("store/disk.go#Disk.Put", "plan/chart.go#Chart"),
    ("store/disk.go#start", "store/disk.go#open"),
    ("store/note.go#note", "store/note.go#trim"),
    ("store/note_test.go#TestX", "store/note_test.go#note"),
    ("plan/chart.go#Chart", "plan/pick.go#pick"),
    ("plan/chart.go#Chart", "plan/chart.go#Tape.Put"),
    ("plan/chart.go#Run", "plan/chart.go#Tape.Seal"),
    ("cmd/main.go#main", "plan/chart.go#Chart"),
    ("cmd/main.go#main", "store/disk.go#Disk.Seal"),
    ("cmd/main.go#main", "plan/chart.go#Tape.Seal"),
    ("cmd/main.go#main", "cmd/main.go#run"),
    ("cmd/main.go#run", "cmd/main.go#main"),
]
MODULE_TYPES = [("store/disk.go#Keeper", "store/disk.go#Disk"), ("store/disk.go#Keeper", "plan/chart.go#Tape")]
#: Nodes of the module that have an active entry.
MODULE_TOLD = ["plan/chart.go#Chart", "store/disk.go#Disk.Put", "cmd/main.go#main"]


def _module(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Calls, implementations, nodes and entries of the small module."""
    files = spark.createDataFrame([(f, "go", t) for f, t in MODULE.items()], "file string, lang string, src_text string")
    c, i = calls.call_graph(files, MODULE_NAME)
    ids = sorted({x for pair in MODULE_CALLS for x in pair} | {x for pair in MODULE_TYPES for x in pair})
    nodes = spark.createDataFrame([(x, "function", "fresh", x.split("#")[0]) for x in ids], "node_id string, level string, status string, file string")
    entries = spark.createDataFrame([(x, x, True) for x in MODULE_TOLD], "entry_id string, node_id string, active boolean")
    return c, i, nodes, entries


def module_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of the small module."""
    return _module(spark)[0]


def module_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its interfaces and the types that have all their methods."""
    return _module(spark)[1]


def module_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of three of its functions bears on: callers about which something is known."""
    c, _, _, e = _module(spark)
    changed = spark.createDataFrame([("store/disk.go#Disk.Seal",), ("plan/chart.go#Tape.Seal",), ("store/note.go#note",), ("plan/pick.go#pick",)], "node_id string")
    return calls.impact(c, changed, e).select("node_id", "callers", F.array_join("told", ",").alias("told"))


def module_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two or more functions of it call and nobody has described."""
    c, _, n, e = _module(spark)
    return calls.gaps(c, n, e)


def module_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often its files are called from other files."""
    return calls.centrality(_module(spark)[0])


def module_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies one step from two hits along calls, interfaces and a flow."""
    c, i, n, e = _module(spark)
    flow = spark.createDataFrame([("cmd/main.go#main", "store/note.go#trim"), ("store/note.go#trim", "cmd/main.go#main")], "src string, dst string")
    hits = spark.createDataFrame([("cmd/main.go#main",), ("store/disk.go#Keeper",)], "node_id string")
    return graph.neighbours([*calls.structure(c, i), ("flow", flow)], hits, e, 10)


def interface_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that have all keywords of another node of the folder: division as for interfaces, on the nodes' keywords."""
    n = m.nodes(spark, sf_dir).select("node_id", F.regexp_extract("file", r"^(.*)/", 1).alias("dir"), F.explode(F.array_distinct("keywords")).alias("method"))
    return calls.divide(n.select("dir", F.col("node_id").alias("interface"), "method"), n.select("dir", F.col("node_id").alias("type"), "method"), "dir")


def _hashed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new state of files as nodes: an earlier scan is the files without those of the last month, each under a former name."""
    f = _files(spark, sf_dir).where("file IS NOT NULL AND src_text IS NOT NULL").groupBy("file").agg(F.max("src_text").alias("t"), F.max("err").alias("err"), F.max("scanned_at").alias("at"), F.max("file_id").alias("k"))
    new = f.select(F.col("file").alias("node_id"), F.sha2("t", 256).alias("hash"), F.sha2(F.regexp_replace("t", "[ \t\r\n]+", " "), 256).alias("struct_hash"))
    name = F.when(F.col("k") % 7 == 0, F.concat(F.lit("old/"), F.col("file"))).otherwise(F.col("file"))
    text = F.when(F.col("k") % 5 == 0, F.concat("t", F.lit(" "))).otherwise(F.col("t"))
    old = f.where("k % 11 <> 0").select(name.alias("node_id"), F.sha2(text, 256).alias("hash"), F.sha2(F.regexp_replace(text, "[ \t\r\n]+", " "), 256).alias("struct_hash"), F.col("err").isNotNull().alias("informed"))
    return old, new


def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each node when the sources are read again."""
    return sources.reconcile(*_hashed(spark, sf_dir))


def card_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that cards are made of."""
    n, e, c = keep(m.nodes(spark, sf_dir)), keep(m.entries(spark, sf_dir)), keep(m.changes(spark, sf_dir))
    laned = search.lanes(e, n, graph.disputed(graph.open_disputes(e, n)))
    return cards.items(n, laned, c, journal.inactive(c), m.flows(spark, sf_dir))


def semantic_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.cards(card_items(spark, sf_dir))


def truth_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over all cards' items, whatever order they come in."""
    return health.fingerprint(card_items(spark, sf_dir), ["lane", "node_id", "facet", "reference", "text"])


def fake_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic vectors of the active entries' texts, and that each is of length 1."""
    return io.embed(m.entries(spark, sf_dir).where("active").select(F.col("entry_id").alias("id"), "text"), 32)


def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that differ in letter case alone, which a bundle can't hold."""
    return io.collisions(_files(spark, sf_dir).select(F.col("file").alias("path")).unionByName(m.nodes(spark, sf_dir).select(F.col("file").alias("path"))))


def path_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node ids after moving folders: the longest prefix that applies, once."""
    return io.remap(m.nodes(spark, sf_dir).select("node_id"), "node_id", {"pkg/": "core/", "pkg/fusion_": "fused/", "internal/": "pkg/"})


_H = "WITH f AS (SELECT file, max(src_text) AS t, max(err) AS err, max(file_id) AS k FROM source_files WHERE file IS NOT NULL AND src_text IS NOT NULL GROUP BY file), w AS (SELECT file AS node_id, sha256(t) AS hash, sha256(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g')) AS sh FROM f), o0 AS (SELECT CASE WHEN k % 7 = 0 THEN 'old/' || file ELSE file END AS node_id, CASE WHEN k % 5 = 0 THEN t || ' ' ELSE t END AS t, err IS NOT NULL AS informed FROM f WHERE k % 11 <> 0), o AS (SELECT node_id, sha256(t) AS hash, sha256(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g')) AS sh, informed FROM o0), gone AS (SELECT * FROM o WHERE node_id NOT IN (SELECT node_id FROM w)), come AS (SELECT * FROM w WHERE node_id NOT IN (SELECT node_id FROM o)), mv AS (SELECT g.a, c.b FROM (SELECT sh, min(node_id) AS a FROM gone GROUP BY sh HAVING count(*) = 1) g JOIN (SELECT sh, min(node_id) AS b FROM come GROUP BY sh HAVING count(*) = 1) c USING (sh))"
_ITEMS = (
    m.BASE
    + r.RESOLVED
    + r.DISPUTES.replace(r.HEIRS, "", 1)
    + r.INACTIVE
    + f""",
tx AS (SELECT id, concat_ws(chr(10), {m.sql_filled('what')}, {m.sql_filled('why')}) AS text, rejected FROM c),
op AS (SELECT DISTINCT r.id, r.node_id, {m.sql_filled('x.option')} AS o, {m.sql_filled('x.reason')} AS y FROM (SELECT id, unnest(rejected) AS x FROM c) q JOIN r USING (id) WHERE {m.sql_filled('x.option')} IS NOT NULL),
fn AS (SELECT id, {m.sql_filled('s.node')} AS ref, coalesce(s.since, since) AS at, {m.sql_filled('s.note')} AS text FROM (SELECT id, since, unnest(steps) AS s FROM f WHERE NOT deprecated)),
fs2 AS (SELECT fn.*, n.node_id AS exact, n.since AS since, ref IN (SELECT former FROM h) AS inherited FROM fn LEFT JOIN n ON ref = n.node_id WHERE ref IS NOT NULL AND text IS NOT NULL),
fr AS (SELECT id, text, exact AS node_id FROM fs2 WHERE exact IS NOT NULL AND (since IS NULL OR at >= since OR (at IS NULL AND NOT inherited)) UNION ALL SELECT id, text, heir FROM fs2 JOIN h ON ref = former WHERE exact IS NULL OR since IS NULL OR at IS NULL OR at < since),
it AS (SELECT lane, node_id, coalesce(kind, 'note') AS facet, entry_id AS reference, text FROM laned
UNION SELECT 'history', node_id, 'decision', id, text FROM r JOIN tx USING (id)
UNION SELECT CASE WHEN id IN (SELECT id FROM off) THEN 'history' ELSE 'risk' END, node_id, 'rejected', id, concat_ws(chr(10), o, y) FROM op
UNION SELECT CASE WHEN status IN ('orphaned', 'suspect') THEN 'risk' ELSE 'current' END, node_id, 'flow', id, text FROM fr JOIN n USING (node_id))
"""
)
def _values(rows: list[tuple], names: str) -> str:
    """Rows that are known, as SQL."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::BIGINT" for x in r) + ")" for r in rows) + f") t({names})"


SQL = {
    "module_calls": _values(MODULE_CALLS, "src, dst"),
    "generated_code": _values([(f,) for f, (_, yes) in GENERATED.items() if yes], "file") + " UNION SELECT file FROM source_files WHERE file IS NOT NULL AND regexp_matches(src_text, '^(\\s*(//[^\\n]*\\n)?)*// Code generated [^\\n]* DO NOT EDIT\\.\\r?(\\n|$)')",
    "module_types": _values(MODULE_TYPES, "interface, type"),
    "module_impact": _values([("store/disk.go#Disk.Seal", 2, "cmd/main.go#main,store/disk.go#Disk.Put"), ("plan/chart.go#Tape.Seal", 2, "cmd/main.go#main"), ("store/note.go#note", 1, "store/disk.go#Disk.Put"), ("plan/pick.go#pick", 1, "plan/chart.go#Chart")], "node_id, callers, told"),
    "module_gaps": _values([("plan/chart.go#Tape.Seal", 2), ("store/disk.go#Disk.Seal", 2)], "node_id, callers"),
    "module_centrality": _values([("plan/chart.go", 3), ("store/note.go", 1), ("store/disk.go", 1), ("plan/pick.go", 1)], "file, callers"),
    "module_neighbors": _values([("plan/chart.go#Chart", 3), ("cmd/main.go#run", 2), ("plan/chart.go#Tape", 1), ("plan/chart.go#Tape.Seal", 1), ("store/disk.go#Disk", 1), ("store/disk.go#Disk.Seal", 1), ("store/note.go#trim", 1)], "node_id, score"),
    "source_listing": "SELECT DISTINCT file FROM source_files WHERE regexp_matches(lower(file), '\\.(go|py|ts|tsx|js|rs|java)$') AND NOT list_has_any(string_split(file, '/'), ['vendor', 'node_modules', 'testdata', '.git']) AND regexp_matches(file, '^(src|pkg|internal|lib)/') AND NOT regexp_matches(file, '^internal/parser/') AND NOT regexp_matches(file, '^pkg/quota/[^/]*\\.rs$')",
    "interface_division": m.BASE
    + ", k AS (SELECT DISTINCT node_id, regexp_extract(file, '^(.*)/', 1) AS dir, unnest(keywords) AS w FROM n), q AS (SELECT a.dir, a.node_id AS interface, b.node_id AS type, count(*) AS have, any_value(a.need) AS need FROM (SELECT *, count(*) OVER (PARTITION BY dir, node_id) AS need FROM k) a JOIN k b ON a.dir = b.dir AND a.w = b.w GROUP BY 1, 2, 3 HAVING count(*) = any_value(a.need)) SELECT dir, interface, type FROM q QUALIFY need > 1 OR count(*) OVER (PARTITION BY dir, interface) = 1",
    "reconcile_status": _H
    + "SELECT o.node_id, CASE WHEN o.hash = w.hash THEN 'keep' WHEN informed THEN 'suspect' ELSE 'refresh' END AS action, NULL::VARCHAR AS successor FROM o JOIN w USING (node_id) UNION ALL SELECT a, 'migrate', b FROM mv UNION ALL SELECT node_id, CASE WHEN informed THEN 'orphan' ELSE 'drop' END, NULL FROM gone WHERE node_id NOT IN (SELECT a FROM mv) UNION ALL SELECT node_id, 'create', NULL FROM come WHERE node_id NOT IN (SELECT b FROM mv)",
    "card_items": m.quoted(_ITEMS + "SELECT * FROM it WHERE text <> ''"),
    "truth_fingerprint": m.quoted(_ITEMS + ", y AS (SELECT sha256(" + " || ".join(f"printf('%08X', strlen({c})) || {c}" for c in ("lane", "node_id", "facet", "reference", "text")) + ") AS hh FROM it WHERE text <> ''), pp AS (SELECT substring(hh, 1, 2) AS p, count(*) AS k, sha256(string_agg(hh, '' ORDER BY hh)) AS dg FROM y GROUP BY 1) SELECT sum(k)::BIGINT AS records, sha256(string_agg(dg, '' ORDER BY p)) AS fingerprint FROM pp"),
    "path_collisions": m.BASE + "SELECT lower(path) AS folded, count(*) AS paths FROM (SELECT file AS path FROM source_files WHERE file IS NOT NULL UNION SELECT file FROM n WHERE file IS NOT NULL) GROUP BY 1 HAVING count(*) > 1",
    "path_remap": m.BASE + "SELECT node_id, CASE WHEN starts_with(node_id, 'pkg/fusion_') THEN 'fused/' || substring(node_id, 12) WHEN starts_with(node_id, 'pkg/') THEN 'core/' || substring(node_id, 5) WHEN starts_with(node_id, 'internal/') THEN 'pkg/' || substring(node_id, 10) ELSE node_id END AS mapped FROM n",
}
QUERIES = {f.__name__: f for f in (source_listing, generated_code, symbol_extract, symbol_counts, call_graph, module_calls, module_types, module_impact, module_gaps, module_centrality, module_neighbors, interface_division, reconcile_status, card_items, semantic_cards, truth_fingerprint, fake_embeddings, path_collisions, path_remap)}
