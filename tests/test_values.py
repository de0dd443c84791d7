from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from anchorlake.functions import values as V


def test_columns(spark):
    df = spark.createDataFrame([("verified", 500, "function", "chg_20240407T093123Z_61d51402ddaee8cb", ["a#x", "b#y", "a#w"], "a", "0123456789" * 3)], "c string, t int, l string, i string, e array<string>, f string, s string")
    r = df.select(V.demoted(F.col("c")), V.over_budget(F.col("t"), F.col("l")), V.change_id(F.col("i")), V.shown_edges(F.col("e"), F.col("f"), 2), V.compact(F.col("s"), 17), V.short_id(F.col("i"))).collect()[0]
    assert tuple(r) == ("inferred", "reject", True, "w, x, total 3", "012345678 ... 789", "chg_20240407")
    bad = spark.createDataFrame([("chg_20241307T093123Z_61d51402ddaee8cb",), ("x",)], "i string")
    assert [x[0] for x in bad.select(V.change_id(F.col("i"))).collect()] == [False, False]


def test_json_and_bytes():
    assert V.canonical_json('{ "b": [1.0, 1e5, "é"], "a": {"y": null, "x": true} }') == '{"a":{"x":true,"y":null},"b":[1.0,1e5,"é"]}'
    assert V.compact_bytes("天" * 10, 15) == "天 ... 天" and V.compact_bytes("abc", 15) == "abc"
    assert V.vector_fingerprint([0.1, 0.2]) == V.vector_fingerprint([0.1000001, 0.2]) != V.vector_fingerprint([0.1, 0.3])
    old = {"id": 1, "later": 2, "gone": 3, "steps": [{"node": "a", "x": 1}, {"node": "a", "x": 2}, {"node": "b", "x": 3}]}
    new = {"id": 1, "steps": [{"node": "b"}, {"node": "a"}, {"node": "a"}, {"node": "c"}]}
    assert V.merge_unknown(old, new, frozenset({"id", "gone", "steps", "node"})) == {"id": 1, "later": 2, "steps": [{"node": "b", "x": 3}, {"node": "a", "x": 1}, {"node": "a", "x": 2}, {"node": "c"}]}


@pytest.mark.parametrize("tracked,ignored,present,state", [("", "", "", "absent"), ("", "ab", "ab", "ignored"), ("a", "b", "ab", "partly-ignored"), ("", "", "ab", "untracked"), ("a", "", "ab", "partly-tracked"), ("ab", "", "ab", "tracked")])
def test_tracking(spark, tracked, ignored, present, state):
    f = lambda s: spark.createDataFrame([(c,) for c in s], "path string")
    assert V.tracking_health(f(tracked), f(ignored), f(present)).collect()[0]["state"] == state


def test_stage(spark):
    n = spark.createDataFrame([("a", ["old"])], "node_id string, lineage array<string>")
    e = spark.createDataFrame([("e1", "a"), ("e2", "x")], "entry_id string, node_id string")
    c = spark.createDataFrame([("c1", ["old", "y"], None, "c1"), ("c2", ["a"], "zz", None)], "id string, nodes array<string>, overturns string, reverts string")
    f = spark.createDataFrame([("f", [("w",), ("a",)])], "id string, steps array<struct<node: string>>")
    assert sorted(map(tuple, V.stage_problems(n, e, c, f).collect())) == [("change", "c1", "y"), ("entry", "e2", "x"), ("link", "c2", "zz"), ("step", "f", "w")]
