from __future__ import annotations

import numpy as np
import pytest

import anchorlake.llm.vectors as V
from anchorlake.llm.vectors import most_similar, usable


def brute(x: np.ndarray, ids: list[str], k: int, floor: float) -> set:
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(ids[i], ids[j]) for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k] if s[i, j] >= floor}


def frame(spark, x, ids):
    return usable(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x)], "id string, v array<float>"), "id", "v", x.shape[1])


@pytest.mark.parametrize("block", [8192, 16])
def test_recall_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(120, 16))
    x = np.concatenate([c + rng.normal(scale=0.12, size=(rng.integers(1, 9), 16)) for c in centres] + [rng.normal(size=(200, 16))]).astype(np.float32)
    x *= rng.uniform(0.01, 50, len(x))[:, None].astype(np.float32)
    ids = [f"v{i:04}" for i in range(len(x))]
    want = brute(x.astype(np.float64), ids, 5, 0.9)
    got = {(r["id"], r["other"]) for r in most_similar(frame(spark, x, ids)).collect()}
    assert got <= want | got and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)


def test_copies_ties_and_odd_vectors(spark):
    rows = [(f"c{i:02}", [1.0, 0.0]) for i in range(12)] + [("near", [1.0, 0.1]), ("far", [-1.0, 0.0]), ("zero", [0.0, 0.0]), ("nan", [float("nan"), 1.0]), ("inf", [float("inf"), 1.0]), ("hole", [None, 1.0]), ("long", [1.0, 0.0, 0.0]), ("none", None), (None, [1.0, 0.0]), ("c00", [1.0, 0.0]), ("empty", [])]
    df = usable(spark.createDataFrame(rows, "id string, vec array<float>"), "id", "vec", 2)
    got = {}
    for r in most_similar(df).collect():
        got.setdefault(r["id"], []).append((r["place"], r["other"]))
    assert set(got) == {f"c{i:02}" for i in range(12)} | {"near"}
    assert [o for _, o in sorted(got["c11"])] == ["c00", "c01", "c02", "c03", "c04"]
    assert [o for _, o in sorted(got["c00"])] == ["c01", "c02", "c03", "c04", "c05"]
    assert [o for _, o in sorted(got["near"])] == ["c00", "c01", "c02", "c03", "c04"]


def test_empty(spark):
    assert most_similar(usable(spark.createDataFrame([], "id string, vec array<float>"), "id", "vec", 2)).collect() == []


def test_recall_with_cells_of_two_codes_and_without_a_floor(spark):
    """As in collections of millions, a cell is a prefix of two codes; the k nearest whatever their cosine, against brute force."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 16))
    x = np.concatenate([c + rng.normal(scale=0.25, size=(8, 16)) for c in centres]).astype(np.float32)
    ids = [f"v{i:04}" for i in range(len(x))]
    df = frame(spark, x, ids)
    for floor, least in ((0.9, 0.95), (-1.0, 0.9)):
        want = brute(x.astype(np.float64), ids, 5, floor)
        got = {(r["id"], r["other"]) for r in most_similar(df, 5, floor, probes=8, sizes=(32,) * 6, cell=32).collect()}
        assert len(got & want) >= least * len(want), (floor, len(got & want) / len(want))
    want = brute(x.astype(np.float64), ids, 5, 0.5)
    got = {(r["id"], r["other"]) for r in most_similar(df, 5, 0.5, probes=1024, slack=2.0, sizes=(32,) * 6, cell=32).collect()}
    assert len(got ^ want) <= 2  # all cells visited, all pairs compared: ties by rounding alone
