"""Tasks, recall, writing, health and files on hand-made rows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from anchorlake.operators import health, recall, tasks, writes
from anchorlake.sources import files as io

NOW = datetime(2026, 7, 1)
DAY = timedelta(days=1)
NODE = "node_id string, level string, status string, file string, symbol string, since timestamp, lineage array<string>, keywords array<string>"


def nodes(spark):
    rows = [("a.go", "file", "suspect", "a.go", None, None, [], []), ("a.go#T.Run", "function", "fresh", "a.go", "T.Run", None, ["a.go#Go"], []), ("b.go#Run", "function", "orphaned", "b.go", "Run", None, ["b.go#Old"], []), ("d/", "dir", "fresh", None, None, None, [], [])]
    return spark.createDataFrame(rows, NODE)


def test_tasks(spark):
    now = F.lit(NOW)
    rows = [("x@1", "t", ["a.go#Go"], NOW - 8 * DAY), ("y@1", "u", ["a.go"], NOW - DAY), ("z@2", "v", ["gone", None], NOW), ("w", "q", None, None), ("v", " ", [], NOW)]
    w = spark.createDataFrame([(o, t, None, None, None, None, x, u) for o, t, x, u in rows], io.WIP)
    assert {r["owner"]: (r["state"], r["label"]) for r in tasks.labelled(w, now).collect()} == {"x@1": ("stale", "stale 8d"), "y@1": ("idle", "idle 1d"), "z@2": ("active", ""), "w": ("unknown", "stale age-unknown")}
    assert tuple(tasks.counts(w, now).collect()[0]) == (4, 1, 1, 1)
    n = nodes(spark)
    assert {r["owner"] for r in tasks.attached(w, n, n.where("file = 'a.go'")).collect()} == {"x@1", "y@1"}
    assert {r["owner"] for r in tasks.closable(w, "z@2", now).collect()} == {"x@1", "z@2"}
    done = tasks.archived(w, "x@1", "done", now).collect()
    assert done[0]["what"] == "done: t" and done[0]["nodes"] == ["a.go#Go"]
    u = spark.createDataFrame([("1", "kb_recall", True, True, "suspect", 1, 0, False), ("1", "kb_map", False, None, None, None, None, None), ("2", "kb_record_change", True, None, None, None, None, None), (None, "cli_precheck", True, None, None, None, 2, True)], "session string, tool string, ok boolean, hit boolean, hitStatus string, stale int, warnings int, blocked boolean")
    assert {tuple(r) for r in tasks.session_gate(u, w).collect()} == {("1", 1, True, True, 1, 2), ("2", 0, False, False, 0, 1)}
    t = tasks.usage_totals(u).collect()[0]
    assert (t["recalls"], t["percent"], t["stale"], t["changes"], t["warnings"], t["blocked"], t["unrecorded"]) == (1, 100, 1, 1, 2, 1, False)
    assert tasks.usage_totals(u.limit(0)).collect()[0]["percent"] == 0


def test_recall(spark):
    n = nodes(spark)
    find = lambda q: sorted((r["node_id"], r["how"]) for r in recall.resolve_query(n, q).collect())
    assert find(" a.go#T.Run ") == [("a.go#T.Run", "exact")] and find("b.go#Old") == [("b.go#Run", "lineage")]
    assert find("Run") == [("a.go#T.Run", "loose"), ("b.go#Run", "loose")] and find("b.go#(*T).Run") == [("b.go#Run", "loose")]
    assert find("x y") == [] and find("") == []
    assert [(r["kind"], r["shown"]) for r in recall.nothing_found(n, "RU").collect()] == [("symbol", "b.go#Run"), ("symbol", "a.go#T.Run"), ("folder", ".")]
    assert [tuple(r) for r in recall.file_suggestions(n, "x/A.go").collect()] == [("a.go", 1)]
    v = spark.createDataFrame([("1", "a", "l", "h", [1.0, 0.0]), ("2", "a", "l", "old", [1.0, 0.1]), ("3", "b", "l", "h", [0.0, 1.0])], "id string, node_id string, lane string, hash string, vec array<double>")
    manifest = spark.createDataFrame([("1", "a", "l", "h"), ("2", "a", "l", "new"), ("3", "b", "l", "h")], "id string, node_id string, lane string, hash string")
    assert [tuple(r) for r in recall.vector_lanes(v, manifest, [1.0, 0.0], 3).collect()] == [("l", "a", 1)]


def test_judged(spark):
    n = nodes(spark)
    e = spark.createDataFrame([("e1", "a.go#T.Run", "Keeps the lease order stable across retries of one session", True)], "entry_id string, node_id string, text string, active boolean")
    texts = {"no node": ("nowhere", "x"), "no text": ("a.go", " "), "too long": ("a.go#T.Run", "word " * 300), "order": ("a.go", "You must disable the CI"), "same": ("a.go#T.Run", "keeps the LEASE order stable  across retries of one session"), "alike": ("a.go#T.Run", "Keeps the lease order stable across retries of one session too"), "long": ("a.go", "word " * 500), "action": ("a.go", "It can bypass ci"), "task": ("a.go", "TODO later"), None: ("a.go", "fine")}
    new = spark.createDataFrame([(str(k), *v, 1) for k, v in texts.items()], "entry_id string, node_id string, text string, extra int")
    got = {r["entry_id"]: (r["verdict"], r["reason"]) for r in writes.judged(new, e, n).collect()}
    assert {k: v[1] for k, v in got.items()} == {str(k): k for k in texts}
    assert {k for k, v in got.items() if v[0] == "reject"} == {"no node", "no text", "too long", "order", "same"} and got["None"][0] == "ok"


def test_effects(spark):
    n = nodes(spark)
    e = spark.createDataFrame([("e1", "a.go#T.Run", None, None, "verified", None, True), ("e2", "a.go", ["a.go#Go#e1"], None, "inferred", None, True), ("e3", "a.go", ["a.go#e2"], None, "suspect", None, True), ("e4", "a.go", ["a.go#e2"], None, None, None, True)], "entry_id string, node_id string, based_on array<string>, disputes array<string>, confidence string, superseded_by string, active boolean")
    eff = writes.refuted(e, n, e.where("entry_id = 'e1'"), "chg_1")
    assert {(r["entry_id"], r["before"]["confidence"], r["after"]["confidence"], r["after"]["refuted_by"]) for r in eff.collect()} == {("e1", "verified", "refuted", "chg_1"), ("e2", "inferred", "suspect", None), ("e4", None, "suspect", None)}
    after = e.withColumn("refuted_by", F.when(F.col("entry_id") == "e1", "chg_1")).withColumn("confidence", F.when(F.col("entry_id") == "e1", "refuted").otherwise("suspect"))
    back = writes.reverted(eff, after, ["confidence", "refuted_by"])
    assert {(r["entry_id"], r["after"]["confidence"]) for r in back.collect()} == {("e1", "verified"), ("e2", "inferred"), ("e4", None)}
    assert writes.reverted(eff, e.withColumn("refuted_by", F.lit(None).cast("string")), ["confidence", "refuted_by"]).collect() == []
    with pytest.raises(writes.RevertConflict):
        writes.reverted(eff, after.withColumn("confidence", F.lit("odd")), ["confidence", "refuted_by"])
    assert {(r["entry_id"], r["confidence"]) for r in writes.confirmed(e.withColumn("confirmed_at", F.lit(NOW)), e.where("entry_id IN ('e2', 'e3')"), F.lit(NOW)).collect()} == {("e2", "verified"), ("e3", "verified")}
    c = spark.createDataFrame([("c1", ["a.go#Go"], None), ("c2", ["a.go#T.Run"], "c1"), ("c3", ["d/"], "c1"), ("c4", None, "c1")], "id string, nodes array<string>, overturns string")
    assert {(r["id"], r["shared"]) for r in writes.overturned_in_scope(c, n).collect()} == {("c2", True), ("c3", False), ("c4", False)}


def test_moves(spark):
    n = nodes(spark)
    moves = spark.createDataFrame([("b.go#Run", "a.go#T.Run")], "node_id string, successor string")
    got = {r["node_id"]: r["lineage"] for r in writes.claimed(n, moves).collect()}
    assert "b.go#Run" not in got and set(got["a.go#T.Run"]) == {"a.go#Go", "b.go#Run", "b.go#Old"}
    e = spark.createDataFrame([("e1", "b.go#Run", "verified"), ("e2", "s", "inferred"), ("e3", "s", "verified"), ("e4", "a.go", "verified")], "entry_id string, node_id string, confidence string")
    split = moves.unionByName(spark.createDataFrame([("s", "p"), ("s", "q")], moves.schema))
    out = {tuple(r) for r in writes.moved_entries(e, split, spark.createDataFrame([("e2", "q")], "entry_id string, node_id string")).collect()}
    assert out == {("e1", "a.go#T.Run", "inferred"), ("e2", "q", "suspect"), ("e3", "s", "verified"), ("e4", "a.go", "verified")}
    fresh = {r["node_id"]: (r["status"], r["since"]) for r in writes.reverified(n, n.where("level = 'file'"), F.lit(NOW)).collect()}
    assert fresh["a.go"] == ("fresh", NOW) and fresh["b.go#Run"] == ("orphaned", None)
    steps = spark.createDataFrame([("f", 0, "b.go#Old"), ("f", 1, "zz")], "flow string, position int, ref string")
    assert [tuple(r) for r in writes.step_problems(steps, n).collect()] == [("f", 1, "zz")]
    acts = spark.createDataFrame([("keep",), ("suspect",), ("suspect",), ("drop",)], "action string")
    assert tuple(writes.mass_suspect(acts).collect()[0]) == (3, 2, True) and writes.mass_suspect(acts.limit(0)).collect()[0]["mass"] is False
    jobs = spark.createDataFrame([("j1", NOW - timedelta(minutes=29)), ("j2", NOW - timedelta(minutes=31))], "job string, begun timestamp")
    found = spark.createDataFrame([("j1", "x"), ("j2", "x"), ("j3", "x")], "job string, conclusion string")
    assert [r["job"] for r in writes.submitted(found, jobs, F.lit(NOW)).collect()] == ["j1"]
    assert writes.port_of("/a") != writes.port_of("/b") and 18_000 <= writes.port_of("/a") < 20_000
    df = spark.createDataFrame([(writes.new_change_id(NOW),)], "i string")
    from anchorlake.functions.values import change_id

    assert df.select(change_id(F.col("i"))).first()[0] and writes.new_entry_id() != writes.new_entry_id() and writes.job_id("q") == writes.job_id("q")


def test_redacted_columns(spark):
    key = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
    df = spark.createDataFrame([(key, key, [key, None, "x"]), (None, None, None)], "text string, id string, notes array<string>")
    a, b = writes.redacted(df, ["text", "notes"]).collect()
    assert a["id"] == key and a["text"] == "[REDACTED:aws-access-key]" and a["notes"] == ["[REDACTED:aws-access-key]", None, "x"] and a["redactions"] == 2
    assert tuple(b) == (None, None, None, 0)


def test_health(spark):
    n = nodes(spark)
    odd = n.limit(1).withColumn("node_id", F.lit("../x#y")).unionByName(n.where("node_id = 'd/'").withColumn("status", F.lit("suspect")))
    good, bad = health.quarantined(n.unionByName(n).unionByName(odd))
    assert {r["node_id"] for r in good.collect()} == {"a.go", "a.go#T.Run", "b.go#Run"}
    assert {(r["node_id"], r["reason"]) for r in bad.collect()} == {("../x#y", "unsafe"), ("d/", "twice")}
    reads = spark.createDataFrame([("s", "a", "1", NOW), ("s", "a", "2", NOW + DAY), ("s", "b", "1", NOW), ("s", "c", None, NOW)], "session string, node_id string, hash string, at timestamp")
    cur = spark.createDataFrame([("a", "2"), ("b", "9"), ("c", "3")], "node_id string, hash string")
    assert [tuple(r) for r in health.stale_reads(reads, cur).collect()] == [("s", "b")]
    old = spark.createDataFrame([("a", "2"), ("b", "1"), ("z", "1"), ("y", None)], "node_id string, hash string")
    assert sorted(map(tuple, health.stale_nodes(old, cur).collect())) == [("b", "changed"), ("z", "missing")]
    f = lambda rows: health.fingerprint(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).collect()[0]["fingerprint"]
    rows = [(str(i), "x") for i in range(50)]
    assert f(rows) == f(rows[::-1]) != f([*rows, ("1", "x")]) and f([("ab", "c")]) != f([("a", "bc")]) and f([("a", None)]) == f([("a", "")])
    size = health.index_size(spark.createDataFrame([("ab", [1.0, 2.0]), ("c", None)], "id string, vec array<float>"), 10).collect()[0]
    assert (size["records"], int(size["bytes"]), size["fits"]) == (2, 11, False)


def test_files(spark, tmp_path):
    root = tmp_path.as_uri()
    io.save_wip(spark, f"{root}/wip", {"owner": "a", "task": "t", "touching": ["n"], "updated": "2026-07-01T00:00:00Z"})
    io.save_wip(spark, f"{root}/wip", {"owner": "a", "task": "t2"})
    io.save_wip(spark, f"{root}/wip", {"owner": "b", "task": ""})
    assert [(r["owner"], r["task"]) for r in io.read_wips(spark, f"{root}/wip").collect()] == [("a", "t2")]
    assert io.clear_wip(spark, f"{root}/wip", "a") and not io.clear_wip(spark, f"{root}/wip", "a")
    with pytest.raises(ValueError):
        io.publish(spark, f"{root}/x/y", b"z", lambda raw: (_ for _ in ()).throw(ValueError(raw)))
    assert not (tmp_path / "x" / "y").exists()
    df = spark.createDataFrame([("c1", NOW, "x")], "id string, at timestamp, what string")
    io.append_changes(df, f"{root}/journal")
    (tmp_path / "journal" / ".2026-07.jsonl.crc").unlink(missing_ok=True)  # the local file system's own checksum
    with (tmp_path / "journal" / "2026-07.jsonl").open("a") as f:
        f.write('{"id": "torn')
    io.append_changes(df.unionByName(spark.createDataFrame([("c0", NOW, "y"), ("d", NOW - 40 * DAY, "z")], df.schema)), f"{root}/journal")
    lines = (tmp_path / "journal" / "2026-07.jsonl").read_text().splitlines()
    assert [json.loads(x)["id"] if x.endswith("}") else "torn" for x in lines] == ["c1", "torn", "c0"]
    good, bad, _ = io.read_journal(spark, f"{root}/journal/*.jsonl")
    assert [r["id"] for r in io.in_order(good).collect()] == ["d", "c0", "c1"] and bad.count() == 1
    (tmp_path / "tree" / ".git").mkdir(parents=True)
    (tmp_path / "tree" / "d").mkdir()
    for name in ("a.go", "d/b.go", ".git/c", "d/.e"):
        (tmp_path / "tree" / name).write_text("x")
    assert sorted((r["path"], r["length"]) for r in io.walk(spark, f"{root}/tree").collect()) == [("a.go", 1), ("d/b.go", 1)]
    io.replace_table(df, f"{root}/t")
    io.replace_table(df.withColumn("what", F.lit("new")), f"{root}/t")
    assert [r["what"] for r in spark.read.parquet(f"{root}/t").collect()] == ["new"]


def test_logs_and_imports(spark):
    log = spark.createDataFrame([("1", NOW, "a", None), ("2", NOW + DAY, "b", "a"), ("3", NOW + 2 * DAY, "c", "b"), ("4", NOW + 3 * DAY, "c", None), ("5", NOW, "z", None)], "commit string, at timestamp, file string, former string")
    assert sorted((r["file"], r["commit"]) for r in io.trail(log).collect()) == [("c", "2"), ("c", "3"), ("c", "4"), ("z", "5")]
    st = io.staged(spark.createDataFrame([("a", "D"), ("b", "D")], "path string, change string"), spark.createDataFrame([("a", "M"), (None, "A")], "path string, change string"))
    assert sorted(map(tuple, st.collect())) == [("a", False), ("b", True)]
    df = spark.createDataFrame([("old/x", ["old/y", "z", None], [("old/w",)], "old/keep")], "id string, nodes array<string>, steps array<struct<node: string>>, text string")
    r = io.remap_nested(df, ["id", "nodes", "steps"], {"old/": "new/", "old/y": "q"}).first()
    assert (r["id"], r["nodes"], r["steps"][0]["node"], r["text"]) == ("new/x", ["q", "z", None], "new/w", "old/keep")
    one = lambda rows: spark.createDataFrame(rows, "id string, v string")
    plan = {tuple(r) for r in io.import_plan(one([("a", "1"), ("b", "1")]), one([("a", "1"), ("b", "2"), ("c", None)]), "id").collect()}
    assert plan == {("a", "skip"), ("b", "conflict"), ("c", "import")}
    assert io.ordered_response([(1, [0.5]), (0, [1.0])], 2, 1) == [[1.0], [0.5]]
    for bad in ([(0, [1.0]), (0, [1.0])], [(0, [0.0]), (1, [1.0])], [(0, [1.0, 2.0]), (1, [1.0])]):
        with pytest.raises(ValueError):
            io.ordered_response(bad, 2, 1)
    assert io.run_within(spark, lambda: spark.range(10).count(), 60) == 10
    slow = lambda: spark.range(8).repartition(8).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L)").collect()
    with pytest.raises(TimeoutError):
        io.run_within(spark, slow, 1)
