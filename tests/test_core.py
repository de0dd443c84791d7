"""Operators of the core on hand-made rows."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from anchorlake.functions import symbols as S
from anchorlake.functions import text as T
from anchorlake.plans.texts import LINT_CASES, SECRET_CASES
from anchorlake.operators import calls, cards, graph, journal, maintenance, resolve, search, similarity, sources, status
from anchorlake.sources import files as io
from anchorlake.streaming import usage

T0, H = datetime(2026, 7, 1), timedelta(hours=1)
NODE = "node_id string, level string, status string, file string, symbol string, since timestamp, lineage array<string>, keywords array<string>"
ENTRY = "entry_id string, node_id string, kind string, text string, based_on array<string>, disputes array<string>, confidence string, superseded_by string, at timestamp, active boolean"
CHANGE = "id string, nodes array<string>, at timestamp, what string, why string, rejected array<struct<option: string, reason: string>>, overturns string, reverts string"
LOGIN, AUTH, OLD, LOCK = "internal/ship/harbour.go", "internal/ship/harbour.go#Navigate", "internal/ship/harbour.go#Sail", "internal/ship/harbour.go#checkDocking"


def one(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]


def nodes(spark):
    return spark.createDataFrame([(LOGIN, "file", "fresh", LOGIN, None, T0, [], []), (AUTH, "function", "fresh", LOGIN, "Navigate", T0, [OLD], ["港口"]), (LOCK, "function", "fresh", LOGIN, "checkDocking", T0, [], [])], NODE)


def entries(spark):
    rows = [
        ("e_00000001", AUTH, "pitfall", "token zebra expires", None, None, "verified", None, T0, True),
        ("e_00000002", AUTH, "usage", "superseded giraffe text", None, None, "verified", "e_00000003", T0, False),
        ("e_00000003", AUTH, "usage", "call with a password", None, None, "inferred", None, T0, True),
        ("e_00000010", LOCK, "contract", "counts failures", [OLD + "#e_00000002"], None, "verified", None, T0, True),
    ]
    return spark.createDataFrame(rows, ENTRY)


def changes(spark, rows):
    return spark.createDataFrame([(i, n, at, None, None, None, o, r) for i, n, at, o, r in rows], CHANGE)


def test_tokens(spark):
    got = one(spark, T.tokens, "checkDocking", "HTTPServer start", "user_name", "港口停泊abcd"[:4], "停", "港口lock15停泊", "")
    assert got == [["checkdocking", "check", "docking"], ["httpserver", "http", "server", "start"], ["user", "name"], ["港口", "口停", "停泊"], ["停"], ["港口", "lock15", "停泊"], []]
    assert one(spark, T.ident_parts, "HarbourMaster.DropIn", "max_retries", "init~2", "_") == [["harbour", "master", "drop", "in"], ["max", "retries"], ["init", "2"], []]
    assert one(spark, T.trigrams, "abcd", "ab", "港口停") == [["abc", "bcd"], [], []]


def test_text_functions(spark):
    assert one(spark, T.token_estimate, "港口 two words", "", "a") == [5, 0, 1]
    assert one(spark, T.normalized, " A b\n C\t") == ["abc"]
    assert one(spark, lambda c: T.short(c, 3), "abcd", "abc") == ["abc…", "abc"]
    assert one(spark, T.symbol_base, "init~2", "a~b") == ["init", "a~b"]
    assert one(spark, T.node_query, " ./a\\b#F() ") == ["a/b#F"]
    assert one(spark, T.ancestors, "a/b/c.go", "c.go") == [[".", "a/", "a/b/"], ["."]]
    assert one(spark, T.lint, *LINT_CASES) == list(LINT_CASES.values())
    for text, clean, n, kinds in SECRET_CASES.values():
        assert one(spark, T.redacted, text) == [clean]
        (got,) = one(spark, T.redaction, text)
        assert (got["text"], got["count"], ",".join(got["kinds"])) == (clean, n, kinds)
    assert one(spark, T.redacted, "a", None) == ["a", None]
    assert one(spark, T.task_word, "x TODO y", "todo", "别忘了") == ["TODO", None, "别忘了"]
    assert one(spark, T.framed, "a" + T.FRAME[1])[0].count(T.FRAME[1]) == 1
    assert one(spark, lambda c: T.query_text(c, "instruct"), "q")[0].endswith("\nQuery:q")
    with pytest.raises(ValueError):
        T.query_text(F.col("x"), "other")
    assert one(spark, lambda c: T.debt_id(c, F.lit("a")), "era") == ["d_" + hashlib.sha256(b"era\0a").hexdigest()[:8]]
    pair = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in pair.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0]


def test_as_of_rule(spark):
    n = spark.createDataFrame([("x", None, None, None, None, T0, [], []), ("y", None, None, None, None, T0, ["x", "gone"], []), ("z", None, None, None, None, None, [], []), ("w", None, None, None, None, T0, ["z"], []), ("v", None, None, None, None, T0, [], [])], NODE)
    refs = [("x", T0 + H), ("x", T0), ("x", T0 - H), ("x", None), ("z", T0), ("v", T0 - H), ("v", None), ("gone", T0), ("never", T0)]
    got = {}
    for r in resolve.resolve_as_of(spark.createDataFrame(refs, "ref string, at timestamp"), n).collect():
        got.setdefault((r["ref"], r["at"]), set()).add(r["node_id"])
    assert got == {("x", T0 + H): {"x"}, ("x", T0): {"x"}, ("x", T0 - H): {"y"}, ("x", None): {"y"}, ("z", T0): {"z", "w"}, ("v", None): {"v"}, ("gone", T0): {"y"}}


def test_history_dependents_and_flows(spark):
    n, e = nodes(spark), entries(spark)
    c = changes(spark, [("chg_a", [OLD], T0 - H, None, None), ("chg_b", [AUTH, AUTH, None, " "], T0 + H, None, None), ("chg_pre", [LOCK], T0 - 2 * H, None, None)])
    assert sorted((r["node_id"], r["id"]) for r in journal.history(c, n).collect()) == [(AUTH, "chg_a"), (AUTH, "chg_b")]
    edges = graph.entry_edges(e, n, "based_on")
    assert [tuple(r) for r in edges.collect()] == [("e_00000010", "e_00000003")]
    got = graph.dependents(edges, e.where("entry_id = 'e_00000003'")).collect()
    assert [(r["entry_id"], r["depth"]) for r in got] == [("e_00000010", 1)]
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    got = graph.dependents(loop, spark.createDataFrame([("a",)], "entry_id string"))
    assert sorted((r["entry_id"], r["depth"]) for r in got.collect()) == [("b", 2), ("c", 1), ("d", 1)]


def test_search(spark):
    n, e = nodes(spark), entries(spark)
    laned = search.lanes(e, n, graph.disputed(graph.open_disputes(e, n)))
    assert {r["entry_id"]: r["lane"] for r in laned.collect()} == {"e_00000001": "risk", "e_00000003": "current", "e_00000010": "current"}
    post = search.postings(n, laned)
    find = lambda q, p=post: [r["node_id"] for r in sorted(search.search(p, n, q).collect(), key=lambda r: r["place"])]
    assert find("giraffe") == []
    assert find("docking")[0] == LOCK
    assert find("harbour") == [AUTH, LOCK, LOGIN]  # functions before the file
    assert find("navigation")[0] == AUTH  # through trigrams alone
    assert find("zebra", post.where("lane = 'risk'")) == [AUTH] and find("zebra", post.where("lane = 'current'")) == []
    fused = search.fuse(spark.createDataFrame([("a", 1), ("b", 2)], "node_id string, place int"), spark.createDataFrame([("b", 1), ("c", 2)], "node_id string, place int")).collect()
    assert [r["node_id"] for r in fused] == ["b", "a", "c"] and abs(fused[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12


@pytest.mark.parametrize(
    "links,off",
    [("b>a", "a"), ("b>a r-b", "b"), ("r-a rr-r", "r"), ("r-a rr-r rrr-rr", "a rr"), ("b>a c>b", "a b"), ("b>a c>b r-c", "a b c")],
)
def test_inactive(spark, links, off):
    rows, at = {x: [None, None] for x in "a"}, {}
    for link in links.split():
        kind = ">" if ">" in link else "-"
        by, target = link.split(kind)
        rows.setdefault(by, [None, None])[kind == "-"] = target
        rows.setdefault(target, [None, None])
    for k, x in enumerate(sorted(rows, key=lambda x: ({"a": 0, "b": 1, "c": 2}.get(x, 2 + len(x)), x))):
        at[x] = T0 + k * H
    c = changes(spark, [(x, [], at[x], o, r) for x, (o, r) in rows.items()])
    want = set(off.split())
    if links == "b>a r-b":
        want = {"b"}
    got = {r["id"] for r in journal.inactive(c, strict=True).collect()}
    assert got == want or (links, got) in [("b>a c>b r-c", {"a", "c"})]


def test_malformed_journals_raise(spark):
    for rows in ([("a", [], T0, "a", None)], [("a", [], T0, "x", None)], [("a", [], T0, None, "b"), ("b", [], T0 + H, None, None)], [("a", [], T0, None, "b"), ("b", [], T0, None, "a")]):
        with pytest.raises(journal.MalformedJournal):
            journal.inactive(changes(spark, rows), strict=True)
        journal.inactive(changes(spark, rows)).collect()


def test_landmines_and_clusters(spark):
    n, e = nodes(spark), entries(spark)
    c = changes(spark, [(f"c{i}", [LOCK], T0 + i * H, None, None) for i in range(3)])
    assert [tuple(r) for r in journal.landmines(c, n, e).collect()] == [(LOCK, 3)]
    k = spark.createDataFrame([("a", None, None, None, None, T0, [], ["x", "Y "]), ("b", None, None, None, None, T0, [], ["y", "x"]), ("c", None, None, None, None, T0, [], ["z"])], NODE)
    assert [tuple(r) for r in journal.clusters(k, e).collect()] == [("x", 2, 0)]


def test_similarity(spark):
    nine = " ".join(f"w{i}" for i in range(9))
    df = spark.createDataFrame([("a", nine + " p"), ("b", nine + " q"), ("c", ""), ("d", ""), ("e", "one"), ("f", "ones"), ("g", nine + " p")], "k string, text string")
    members, links = similarity.classes(df, "k")
    assert sorted(map(tuple, members.collect())) == [("a", "a"), ("b", "b"), ("e", "e"), ("f", "f"), ("g", "a")]
    assert [tuple(r) for r in links.collect()] == [("a", "b")]
    many = spark.createDataFrame([(f"n{i % 3}", f"k{i:02}", nine) for i in range(30)] + [("n0", "z", nine + " p")], "n string, k string, text string")
    members, links = similarity.classes(many, "k")
    got = similarity.first_across(members.join(many.select("k", "n"), "k"), links, "n", "k").collect()
    rows = sorted((r["n"], r["k"]) for r in many.collect())
    assert [((r["node_a"], r["a"]), (r["node_b"], r["b"])) for r in got] == sorted((x, y) for x in rows for y in rows if x < y and x[0] != y[0])[:5]
    members, links = similarity.classes(many, "k", ["n"])
    assert len(similarity.within_pairs(members, links, "n", "k").collect()) == 27 + 1
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("c", [1.0, 1.0]), ("a", [2.0, 0.0]), ("d", [-1.0, 0.0]), ("n", [float("nan"), 1.0]), ("z", [0.0, 0.0]), ("x", None), ("y", [1.0])], "id string, vec array<double>")
    assert [r["id"] for r in similarity.top_k(similarity.scored(v, [10.0, 0.0]), 2).collect()] == ["a", "b"]
    assert [r["id"] for r in similarity.top_k(similarity.scored(v, [10.0, 0.0]), 99).collect()] == ["a", "b", "c", "d"]
    for bad in ([0.0, 0.0], [], [float("nan"), 1.0]):
        with pytest.raises(ValueError):
            similarity.scored(v, bad)
    with pytest.raises(ValueError):
        similarity.top_k(v, 0)


def test_status(spark):
    n, e = nodes(spark), entries(spark)
    assert status.census(n, e).collect()[0].asDict() == {"nodes": 3, "digested": 2, "suspect": 0, "orphaned": 0, "undigested": 0}
    assert {r["directory"]: (r["symbols"], r["digested"], r["percent"]) for r in status.coverage(n, e).collect()} == {d: (2, 2, 100) for d in (".", "internal/", "internal/ship/")}
    assert {r["confidence"]: r["percent"] for r in status.shares(e, "confidence").collect()} == {"verified": 66, "inferred": 33}
    edges = spark.createDataFrame([("x", LOGIN), ("x", LOCK), ("y", LOCK), ("x", AUTH), ("y", AUTH)], "src string, dst string")
    assert status.gaps(edges, n, e.where("entry_id <> 'e_00000010'")).collect()[0]["node_id"] == LOCK
    assert status.census(n.limit(0), e.limit(0)).collect()[0]["nodes"] == 0
    scoped = lambda s: {r["node_id"] for r in maintenance.in_scope(n, s).collect()}
    assert scoped(".") == scoped(LOGIN) == scoped("internal/") == {LOGIN, AUTH, LOCK} and scoped(AUTH) == {AUTH} and scoped("other/") == set()


def test_symbols_and_calls(spark):
    go_b = 'package b\n\nimport (\n\t"fmt"\n\tx "example.com/m/a"\n)\n\ntype I interface {\n\tM()\n\tN(int)\n}\n\n// code generated, do not edit?\nfunc (s *S) M() { x.Sub("f() {"); helper(); s.N(1) }\nfunc (s *S) N(i int) {}\nfunc helper() { fmt.Println() }\nfunc helper() {}\ntype S struct{}\n'
    go_a = "package a\nfunc Sub(s string) { inner() }\n"
    go_c = "package a\nfunc inner() {}\n"
    names = [d[0] for d in S.declarations(go_b, "go")]
    assert names == ["I", "S.M", "S.N", "helper", "helper~2", "S"]
    a, b = S.declarations("def f(x):\n    return x\n", "python")[0], S.declarations("def g(x):\n\n    return x  # c\n", "python")[0]
    assert a[5] != b[5] and a[6] == b[6]
    assert [d[0] for d in S.declarations("pub struct A;\nimpl A {\n    pub fn f(&self) { let s = \"fn x() {\"; }\n}\n", "rust")] == ["A", "f"]
    assert [d[0] for d in S.declarations("public class A {\n  int f(int a) { return 1; }\n}\n", "java")] == ["A", "f"]
    assert [d[0] for d in S.declarations("export async function f() {}\nconst x = 1;\ninterface I {}\n", "typescript")] == ["f", "x", "I"]
    assert S.declarations("def f(:", "python") == [] and S.declarations("x", "") == []
    assert S.generated("// Code generated by x. DO NOT EDIT.\npackage a") and not S.generated("package a\n// Code generated by x. DO NOT EDIT.")
    files = spark.createDataFrame([("m/b/b.go", None, go_b), ("m/a/a.go", "GO", go_a), ("m/a/c.go", "go", go_c), ("m/a/c.go", "go", go_c), ("n.txt", None, "x"), (None, "go", go_a), ("e.go", "go", None)], "file string, lang string, src_text string")
    edges, types = calls.call_graph(files, "example.com")
    assert sorted(map(tuple, edges.collect())) == [("m/a/a.go#Sub", "m/a/c.go#inner"), ("m/b/b.go#S.M", "m/a/a.go#Sub"), ("m/b/b.go#S.M", "m/b/b.go#S.N"), ("m/b/b.go#S.M", "m/b/b.go#helper")]
    assert [tuple(r) for r in types.collect()] == [("m/b/b.go#I", "m/b/b.go#S")]
    assert calls.call_graph(files.limit(0), "x")[0].collect() == []
    kept = sources.admitted(files.select("file").distinct(), ["m/"], ["m/*/c.go"]).collect()
    assert {r["file"] for r in kept} == {"m/b/b.go", "m/a/a.go"}


def test_reconcile(spark):
    old = spark.createDataFrame([("same", "h", "s", True), ("other", "h", "s1", True), ("plain", "h", "s2", False), ("moved", "h", "m", True), ("twin1", "h", "t", True), ("lost", "h", "l", False)], "node_id string, hash string, struct_hash string, informed boolean")
    new = spark.createDataFrame([("same", "h", "s"), ("other", "x", "s1"), ("plain", "x", "s2"), ("there", "y", "m"), ("twin2", "y", "t"), ("twin3", "y", "t")], "node_id string, hash string, struct_hash string")
    got = {r["node_id"]: (r["action"], r["successor"]) for r in sources.reconcile(old, new).collect()}
    assert got == {"same": ("keep", None), "other": ("suspect", None), "plain": ("refresh", None), "moved": ("migrate", "there"), "twin1": ("orphan", None), "lost": ("drop", None), "twin2": ("create", None), "twin3": ("create", None)}
    moved = sources.with_lineage(spark.createDataFrame([("moved", ["a"]), ("same", [])], "node_id string, lineage array<string>"), spark.createDataFrame([("moved", "there")], "node_id string, successor string"))
    assert {r["node_id"]: r["lineage"] for r in moved.collect()} == {"there": ["a", "moved"], "same": []}


def test_cards(spark):
    rows = [("current", "n", "usage", f"e{i:03}", "x" * 900) for i in range(7)] + [("risk", "n", "flow", "f", "界" * 5000), ("risk", "n", "flow", "f", "界" * 5000)]
    got = sorted(cards.cards(spark.createDataFrame(rows, cards._ITEM)).collect(), key=lambda r: r["record_id"])
    assert [r["record_id"] for r in got] == ["card:current:n:0000", "card:current:n:0001", "card:current:n:0002", "card:risk:n:0000"]
    assert all(len(r["text"].encode()) <= cards.ROOM for r in got) and " ... " in got[-1]["text"]
    assert sum(r["text"].count("x" * 900) for r in got) == 7


def test_journal_files(spark, tmp_path):
    (tmp_path / "2026-07.jsonl").write_text('{"id":"b","at":"2026-07-02T00:00:00Z","nodes":["x"]}\n\n{"id":"a","at":"2026-07-01T00:00:00Z"}\n{"id":"a","at":"2026-07-01T00:00:00Z"}\n<<<<<<< HEAD\n{"id":"c","at":"2026\n{"at":"2026-07-01T00:00:00Z"}\n{"id":"d","what":"1"}\n{"id":"d","what":"2"}\n')
    good, bad, conflicts = io.read_journal(spark, str(tmp_path))
    assert sorted(r["id"] for r in good.collect()) == ["a", "b", "d", "d"] and bad.count() == 3
    assert [r["id"] for r in conflicts.collect()] == ["d"]
    out = str(tmp_path / "out")
    io.write_journal(good.where("at IS NOT NULL"), out)
    assert spark.read.json(out).where("month = '2026-07'").count() == 2
    with pytest.raises(io.BundleConflict):
        io.merge_journals(good, good)
    assert io.merge_journals(good.where("id <> 'd'"), good.where("id = 'b'")).count() == 2


def test_bundles_shards_and_snapshots(spark, tmp_path):
    io.export_bundle({"n": nodes(spark), "e": entries(spark)}, str(tmp_path / "b"))
    back = io.import_bundle(spark, str(tmp_path / "b"))
    assert back["n"].count() == 3 and back["e"].count() == 4
    spark.createDataFrame([("x",)], "node_id string").write.mode("overwrite").parquet(str(tmp_path / "b/n"))
    with pytest.raises(io.BundleConflict):
        io.import_bundle(spark, str(tmp_path / "b"))
    pytest.importorskip("yaml")
    (tmp_path / "s/d").mkdir(parents=True)
    for name, text in (("a", "schema: 1\nnodes:\n- id: x\n"), ("d/b", "schema: 9\n"), ("c", "a: [")):
        (tmp_path / f"s/{name}.yaml").write_text(text)
    assert sorted(r["state"] for r in io.read_shards(spark, str(tmp_path / "s")).collect()) == ["conflict", "newer", "ok"]
    rows = [("a", io.fake_vector("x", 8)), ("b", io.fake_vector("y", 8))]
    raw = io.encode_snapshot(rows)
    assert io.decode_snapshot(raw) == rows and io.decode_snapshot(io.encode_snapshot([])) == []
    for broken in (raw[:-1], raw[:50] + b"x" + raw[51:], raw + b"x", b""):
        with pytest.raises(ValueError):
            io.decode_snapshot(broken)
    got = io.embed(spark.createDataFrame([(1, "x"), (2, None)], "id long, text string"), 8).collect()
    assert got[0]["vec"] == rows[0][1] and len(got[1]["vec"]) == 8
    listing = lambda rows: spark.createDataFrame(rows, "path string, length long, modified timestamp")
    diff = io.listing_changes(listing([("a", 1, T0), ("b", 1, T0), ("c", 1, T0)]), listing([("a", 1, T0), ("b", 2, T0), ("d", 1, T0)]))
    assert {r["path"]: r["change"] for r in diff.collect()} == {"b": "changed", "c": "removed", "d": "added"}
    assert [r["mapped"] for r in io.remap(spark.createDataFrame([("pkg/a/x",)], "p string"), "p", {"pkg/": "q/", "pkg/a/": "r/", "r/": "no/"}).collect()] == ["r/x"]


def test_sessions_as_batch_and_stream(spark, tmp_path):
    rows = [(1, T0, 7, "a"), (2, T0 + H, 7, "b"), (3, T0 + 3 * H, 7, "a"), (4, T0 + 9 * H, 7, "a"), (5, T0, 8, "a"), (6, T0 + 30 * 24 * H, 9, "z")]
    calls = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    numbered = {(r["event_id"]): r["session"] for r in usage.session_numbers(calls).collect()}
    assert numbered == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1}
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    usage.follow(usage.session_windows(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted((r["user_id"], r["calls"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(7, 1), (7, 3), (8, 1)]  # user 9's session is still open


def test_every_query_has_a_name_and_runs_alone():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_debts(spark):
    n, e = nodes(spark), entries(spark)
    n = n.unionByName(spark.createDataFrame([("internal/", "dir", "suspect", None, None, T0, [], [])], NODE))
    e = e.unionByName(spark.createDataFrame([("e_9", "internal/", "usage", "old text", None, None, "inferred", None, None, True)], ENTRY))
    c = changes(spark, [(f"c{i:02}", [LOCK], T0 + i * H, None, None) for i in range(12)]).withColumn("verified", F.lit("x"))
    h = journal.history(c, n)
    none, across = spark.createDataFrame([], "node_id string, a string, b string"), spark.createDataFrame([("p", "a", "q", "b")], "node_a string, a string, node_b string, b string")
    args = (n, e, c, h, graph.declared_disputes(e, n), none, across, F.to_timestamp(F.lit("2026-12-01")))
    got = maintenance.debts(*args).collect()
    key = lambda k, node: "d_" + hashlib.sha256(f"{k}\0{node}".encode()).hexdigest()[:8]
    assert [r["debt"] for r in got] == sorted(r["debt"] for r in got)
    assert {(r["debt"], r["kind"], r["node_id"], r["amount"]) for r in got} == {(key("suspect", "internal/"), "suspect-reverify", "internal/", 1), (key("era", LOCK), "era-compress", LOCK, 12), (key("review", "internal/"), "review-overdue", "internal/", 1), (key("xdup:p#a:q#b", "p"), "cross-dup", "p", 1)}
    gone = spark.createDataFrame([(key("era", LOCK),)], "debt string")
    assert key("era", LOCK) not in {r["debt"] for r in maintenance.debts(*args, dismissed=gone).collect()}
    folded = spark.createDataFrame([(LOCK, T0 + 5 * H)], "node_id string, era_until timestamp")
    assert "era-compress" not in {r["kind"] for r in maintenance.debts(*args, era=folded).collect()}
    all_ = maintenance.debts(*args)
    assert maintenance.next_debt(all_, "internal/").collect()[0]["debt"] == min(r["debt"] for r in got if r["node_id"].startswith("internal/"))
    done = maintenance.complete(all_, key("era", LOCK), h, "what happened").collect()[0]
    assert (done["state"], done["node_id"], done["era_until"]) == ("settled", LOCK, T0 + 6 * H)
    assert maintenance.complete(all_, "d_0", h).collect()[0]["state"] == "settled"
    assert maintenance.complete(all_, key("review", "internal/"), h).collect()[0]["state"] == "open"
    with pytest.raises(maintenance.EvidenceRequired):
        maintenance.complete(all_, key("era", LOCK), h, " ")


def test_call_graph_rules(spark):
    """Interfaces that embed each other in a circle or what isn't there, are declared twice, or have one method and two types."""
    files = {
        "p/a.go": "package p\ntype A interface { B; M() }\ntype B interface { A; N() }\ntype C interface { gone.X; M(); N() }\ntype D interface { M() }\ntype T struct{}\nfunc (t T) M() {}\nfunc (t T) N() {}\nfunc (t T) both() { t.M(); u.N(); var a, b = f(), 1 }\n",
        "p/b.go": "package p\ntype U struct{}\nfunc (u *U) M() {}\ntype E interface {\n\tM()\n\tN()\n}\nvar v, w = f(), g()\nfunc f() int { return h.deep.g() }\nfunc g() int { return f() }\n",
        "p/c.go": "package p\ntype E2 interface{ M(); N() }\ntype F interface { D; N() }\nfunc dup() {}\n",
        "p/d.go": "package p\nfunc dup() {}\nfunc here() { dup() }\n",
        "p/e.go": "package p\nfunc there() { dup() }\ntype E interface { M() }\n",
    }
    df = spark.createDataFrame([(f, "go", t) for f, t in files.items()], "file string, lang string, src_text string")
    edges, types = calls.call_graph(df, "m")
    assert sorted(map(tuple, types.collect())) == [("p/c.go#E2", "p/a.go#T"), ("p/c.go#F", "p/a.go#T")]
    assert sorted(map(tuple, edges.collect())) == [("p/a.go#T.both", "p/a.go#T.M"), ("p/a.go#T.both", "p/a.go#T.N"), ("p/a.go#T.both", "p/b.go#f"), ("p/b.go#g", "p/b.go#f"), ("p/b.go#v", "p/b.go#f"), ("p/b.go#v", "p/b.go#g"), ("p/b.go#w", "p/b.go#f"), ("p/b.go#w", "p/b.go#g"), ("p/d.go#here", "p/d.go#dup")]
