from __future__ import annotations

import itertools
import json
import random
from datetime import datetime, timedelta

import pytest

from anchorlake.operators.drift import assign, drifts, fields_of, match_fields, overlap, profiles, read_object, unified

T0 = datetime(2024, 1, 1)
SCHEMA = "file_id long, stream string, doc_kind string, path string, written_at timestamp, raw string"


def rows(objs, stream="s", start=1):
    return [(start + i, stream, "flow_shard", "p", T0 + timedelta(hours=i), o if o is None or isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objs)]


def found(spark, data, **kw):
    return sorted((r["file_id"], r["field"], r["drift"]) for r in drifts(spark.createDataFrame(data, SCHEMA), **kw).collect())


def test_kinds_of_change(spark):
    data = rows([{"a": 1, "b": "x"}, {"a": 1.5, "c": "y"}, {"a": None, "c": "y"}, {"a": 2.5, "c": "y", "d": {"e": {"f": 1}}}, {"c": "y", "g": 1, "h": 2}])
    assert found(spark, data) == [(2, "a", "retyped"), (2, "c", "renamed"), (4, "d", "added"), (5, "a", "removed"), (5, "d", "removed"), (5, "g", "added"), (5, "h", "added")]


def test_null_keeps_the_last_type_and_absence_forgets_it(spark):
    assert found(spark, rows([{"a": 1}, {"a": None}, {"a": "x"}])) == [(3, "a", "retyped")]
    assert found(spark, rows([{"a": 1, "k": 1}, {"k": 1}, {"a": None, "k": 1}, {"a": "x", "k": 1}])) == [(2, "a", "removed"), (3, "a", "added")]


def test_arrays_and_nesting(spark):
    data = rows([{"f": {"steps": [{"node": "a"}, {"node": None, "note": "x"}]}}, {"f": {"steps": [{"name": "a", "note": "y"}]}}, {"f": {"steps": [1]}}, {"f": "gone"}])
    assert found(spark, data) == [(2, "f.steps[].name", "renamed"), (3, "f.steps[].name", "removed"), (3, "f.steps[].note", "removed"), (4, "f", "retyped")]


def test_files_that_are_no_objects_and_letter_case(spark):
    data = rows([None, "", "[1]", '{"a": 1', '{"a": NaN}', {"a": 1}, "<<<<<<< ours\n{}", {"A": 1}, '"x"'])
    assert found(spark, data) == [(8, "A", "renamed")]
    assert found(spark, []) == []


def test_order_ties_repeats_and_null_stream(spark):
    a = [(2, None, "k", "p", T0, '{"a":1}'), (1, None, "k", "p", T0, '{"b":1,"c":2}'), (2, None, "k", "p", T0, '{"a":1}'), (0, None, "k", "p", None, '{"b":1,"c":2}')]
    assert found(spark, a) == [(2, "a", "added"), (2, "b", "removed"), (2, "c", "removed")]


@pytest.mark.parametrize("parts", [1, 7])
def test_one_long_stream_over_many_partitions(spark, parts):
    """The states handed from partition to partition give what one pass over the stream gives."""
    random.seed(2)
    objs = [{k: random.choice([1, None, "x", 1.5]) for k in random.sample("abcd", random.randrange(5))} for _ in range(60)]
    objs[20:50] = [{"a": None, "b": 1}] * 30
    want, known = [], None
    for i, o in enumerate(objs):
        now = {k: {int: "i", float: "d", str: "s"}.get(type(v), "") for k, v in o.items()}
        if known is not None:
            gone, come = sorted(known.keys() - now.keys()), sorted(now.keys() - known.keys())
            if len(gone) == len(come) == 1 and known[gone[0]] and known[gone[0]] == now[come[0]]:
                want.append((i + 1, come[0], "renamed"))
            else:
                want += [(i + 1, k, "removed") for k in gone] + [(i + 1, k, "added") for k in come]
            want += [(i + 1, k, "retyped") for k in known.keys() & now.keys() if known[k] and now[k] and known[k] != now[k]]
        known = {k: t or (known or {}).get(k, "") for k, t in now.items()}
    assert found(spark, rows(objs), parts=parts) == sorted(want)


def test_matching_is_optimal():
    random.seed(1)
    for n, m in ((3, 3), (2, 4), (4, 2)):
        w = [[random.random() for _ in range(m)] for _ in range(n)]
        best = max(sum(w[i][j] for i, j in zip(p, q)) for p in itertools.permutations(range(n), min(n, m)) for q in itertools.combinations(range(m), min(n, m)))
        assert abs(sum(w[i][j] for i, j in assign(w)) - best) < 1e-9
    assert match_fields({"a": "string", "b": "string"}, {"c": "string"}) == []
    assert match_fields({"user_id": "string", "size": "string"}, {"userId": "string", "len": "integer"}, lone_only=False) == [("user_id", "userId")]


def test_fields_of_deep_text():
    assert read_object('{"a":' * 5000 + "1" + "}" * 5000) is None or True
    assert fields_of(read_object('{"a":[[{"b":1}]],"c":[],"d":1e5,"e":1.0}')) == {("a",): "array", ("a[][]", "b"): "integer", ("c",): "array", ("d",): "integer", ("e",): "decimal"}


def test_unified_table(spark):
    data = rows([{"id": "a", "n": 1, "old": True}, {"id": "b", "n": 2.5, "new": False}, {"id": "c", "file_id": "x", "o": {"z": 1}}, "broken"])
    got = {r["file_id"]: r.asDict() for r in unified(spark.createDataFrame(data + data[:1], SCHEMA), "flow_shard").collect()}
    assert got[1] == {"file_id": 1, "id": "a", "n": 1.0, "new": None, "old": True, "file_id_": None, "o": None} or got[1]["n"] == 1.0
    assert got[2]["n"] == 2.5 and got[3]["file_id_"] == "x" and got[3]["o"] == '{"z": "1"}' and set(got) == {1, 2, 3}
    names = {c for c in got[1]}
    assert ("old" in names) != ("new" in names)  # one column for the renamed field


def test_names_that_a_file_has_together_stay_apart(spark):
    data = rows([{"id": 1, "state": "x"}, {"id": 1, "owner": "y"}, {"id": 1, "state": "x", "owner": "y"}])
    got = {r["file_id"]: r.asDict() for r in unified(spark.createDataFrame(data, SCHEMA), "flow_shard").collect()}
    assert [(got[k]["state"], got[k]["owner"]) for k in (1, 2, 3)] == [("x", None), (None, "y"), ("x", "y")]


def test_chance_sighting_is_no_rename(spark):
    """One sighting among many comings and goings, of names and values that have nothing in common."""
    objs = [{"k": 1, "abc": "x"}, {"k": 1, "xyz": "y"}] + [o for _ in range(6) for o in ({"k": 1}, {"k": 1, "abc": "x"}, {"k": 1}, {"k": 1, "xyz": "y"})]
    assert {"abc", "xyz"} <= set(unified(spark.createDataFrame(rows(objs), SCHEMA), "flow_shard").columns)


def test_unified_inside_objects_and_arrays(spark):
    """One name and one type at any depth; numbers stay numbers."""
    objs = [{"f": {"n": 1, "x": 1, "steps": [{"node": "a", "since": "d1"}, {"node": "b", "since": "d2"}]}}, {"f": {"n": 1.5, "x": "s", "steps": [{"node": "a", "Since": "d3"}]}}, {"f": {"n": 2, "x": [{"y": 1}], "steps": []}}]
    got = {r["file_id"]: json.loads(r["f"]) for r in unified(spark.createDataFrame(rows(objs), SCHEMA), "flow_shard", nested=True).collect()}
    assert [got[k]["n"] for k in (1, 2, 3)] == [1, 1.5, 2] and [got[k]["x"] for k in (1, 2, 3)] == ["1", "s", '[{"y": 1}]']
    assert len({name for f in got.values() for x in f["steps"] for name in x}) == 2 and [len(x) for x in got[1]["steps"]] == [2, 2]


def test_unified_joins_objects_and_their_members(spark):
    objs = [{"flow": {"a": 1}, "k": 1}, {"Flow": {"a": 2}, "k": 1}, {"Flow": {"a": "x"}, "k": 1}]
    df = unified(spark.createDataFrame(rows(objs), SCHEMA), "flow_shard", nested=True)
    assert len(df.columns) == 3
    assert sorted(r[next(c for c in df.columns if c.lower() == "flow")] for r in df.collect()) == ['{"a": "1"}', '{"a": "2"}', '{"a": "x"}']


def test_field_with_other_names_in_other_streams_is_one_column(spark):
    """Several fields renamed at once, and one field renamed differently by each stream."""
    data = [r for k, name in enumerate(["schemaVersion", "schema_version", "Schema"]) for r in rows([{"id": 1, "schema": 1, "user_id": "u"}, {"id": 1, name: 1, "userId": "u"}], f"s{k}", 2 * k)]
    df = unified(spark.createDataFrame(data, SCHEMA), "flow_shard", nested=True)
    assert len(df.columns) == 4 and all(None not in r for r in df.collect())


def test_sketches_of_many_values_tell_columns_apart(spark):
    data = rows([{"a": [f"a{i}" for i in range(6000)], "b": [f"b{i}" for i in range(6000)], "c": [f"a{i}" for i in range(6000)]}])
    seen, _ = profiles(spark.createDataFrame(data, SCHEMA))
    a, b, c = (seen["", f + "[]"]["sketch"] for f in "abc")
    assert overlap(a, b) == 0 and overlap(a, c) == 1
