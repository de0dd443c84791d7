from __future__ import annotations

import random

import pytest

from anchorlake.operators.hierarchy import descendants, hierarchy


def walked(spark, links, **kw):
    return {r["id"]: r for r in hierarchy(spark.createDataFrame(links, "id string, parent string"), **kw).collect()}


def brute(links):
    up = dict(links)
    out = {}
    for x in up:
        seen, at = [], x
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        if at in up:
            ring = seen[seen.index(at) :]
            out[x] = (min(ring), -1)
        else:
            out[x] = (at, len(seen))
    return out


@pytest.mark.parametrize("most", [200_000, 3])
def test_brute_force(spark, most):
    random.seed(5)
    links = [(f"n{i}", f"n{random.randrange(max(1, i))}") for i in range(1, 60)]
    links += [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("self", "self"), ("t1", "c3"), ("t2", "t1"), ("u", "self")]
    links += [(f"d{i}", f"d{i - 1}") for i in range(1, 40)]
    got = walked(spark, links, most_nodes=most)
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == brute(links)
    up = dict(links)
    for k, r in got.items():
        assert r["path"][-1] == k and all(up[b] == a for a, b in zip(r["path"], r["path"][1:]))
        assert r["path"][0] == r["root_id"]
        if r["depth"] >= 0:
            assert len(r["path"]) == r["depth"] + 1
    assert sorted(k for k, r in got.items() if r["closes_cycle"]) == ["c0", "self"]


def test_nulls_and_empty(spark):
    assert walked(spark, []) == {}
    assert set(walked(spark, [(None, "a"), ("b", None), ("c", "a")])) == {"c"}


def test_descendants(spark):
    h = hierarchy(spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x")], "id string, parent string"))
    assert sorted(map(tuple, descendants(h).collect())) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1), ("x", "y", 1), ("y", "x", 1)]


@pytest.mark.parametrize("most", [200_000, 3])
def test_descendants_on_and_below_cycles(spark, most):
    """A cycle of five with trees on it, one that is entered elsewhere than at its smallest id, one node of its own, a tree."""
    links = [(f"c{i}", f"c{(i + 2) % 5}") for i in range(5)] + [("t1", "c3"), ("t2", "t1"), ("t3", "t2"), ("u", "c0"), ("self", "self"), ("v", "self"), ("b", "a"), ("d", "b")]
    links += [(f"m{i}", f"m{(i + 1) % 5}") for i in range(5)] + [("e", "m3")]
    up, want = dict(links), set()
    for x in up:
        at, n, seen = x, 0, {x}
        while at in up and up[at] not in seen:
            at, n = up[at], n + 1
            seen.add(at)
            want.add((at, x, n))
    got = list(map(tuple, descendants(hierarchy(spark.createDataFrame(links, "id string, parent string"), most_nodes=most)).collect()))
    assert sorted(got) == sorted(want)
