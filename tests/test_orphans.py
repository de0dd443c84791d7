from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np

from anchorlake.functions.bitmap import LIST_MOST, Bitmap
from anchorlake.operators.orphans import orphan_references

REF = "space string, key string, at timestamp, src string, parent_at int"
PAR = "space string, key string, at timestamp"
T0 = datetime(2024, 1, 1)


def found(spark, refs, parents, **kw):
    return sorted(r["src"] for r in orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR), **kw).collect())


def test_bitmaps_are_sets():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (10, 10), (9000, 9000), (70000, 300), (300, 70000)):
        a, b = set(rng.integers(0, 200_000, n).tolist()), set(rng.integers(0, 200_000, m).tolist())
        x, y = Bitmap.of(np.array(sorted(a), np.int64)), Bitmap.of(np.array(sorted(b), np.int64))
        assert x.minus(y).members().tolist() == sorted(a - b)
        assert x.plus(y).members().tolist() == sorted(a | b)
        assert len(x) == len(a)
    dense = Bitmap.of(np.arange(LIST_MOST + 1))
    assert dense.parts[0].dtype == np.uint8 and Bitmap.of(np.arange(LIST_MOST)).parts[0].dtype == np.uint16


def test_times_nulls_spaces_and_repeats(spark):
    h = timedelta(hours=1)
    refs = [
        ("x", "k", T0, "same time", 1),
        ("x", "k", T0 - h, "before", 1),
        ("x", "k", T0 + h, "after", 1),
        ("y", "k", T0 + h, "other space", 1),
        ("x", "k", None, "no time", 1),
        ("x", "always", T0 - 900 * h, "old parent", 1),
        ("x", None, T0, "no key", 1),
        ("x", "gone", T0, "gone", None),
        ("x", "gone", T0, "gone", None),
        ("x", "", T0, "empty", 1),
        ("x", "k" * 5000, T0, "long", 1),
    ]
    parents = [("x", "k", T0 + 5 * h), ("x", "k", T0), ("x", "always", None), (None, "k", T0), ("x", None, T0)]
    assert found(spark, refs, parents) == ["before", "empty", "gone", "gone", "long", "other space"]


def test_further_columns_come_back(spark):
    refs = spark.createDataFrame([("x", "k", T0, 1, 2, 3, "a")], "space string, key string, at timestamp, _o_at int, period int, parent_at int, is_parent string")
    got = orphan_references(refs, spark.createDataFrame([], PAR))
    assert got.columns == refs.columns and [tuple(r) for r in got.collect()] == [("x", "k", T0, 1, 2, 3, "a")]


def test_empty_sides(spark):
    assert found(spark, [], [("x", "k", T0)]) == []
    assert found(spark, [("x", "k", T0, "a", 1)], []) == ["a"]


def test_brute_force_with_a_hot_key(spark):
    random.seed(3)
    keys = [f"k{i}" for i in range(40)]
    refs = [("x", "hot" if i % 3 == 0 else random.choice(keys), T0 + timedelta(hours=random.randrange(3000)), f"s{i}", i) for i in range(900)]
    parents = [("x", k, T0 + timedelta(hours=random.randrange(3000))) for k in keys[:30] for _ in range(2)] + [("x", "hot", T0 + timedelta(hours=1500))]
    first = {}
    for _, k, t in parents:
        first[k] = min(first.get(k, t), t)
    want = sorted(s for _, k, t, s, _ in refs if k not in first or first[k] > t)
    assert found(spark, refs, parents, range_rows=7) == want == found(spark, refs, parents)
