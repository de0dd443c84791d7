"""The first pairs of alike texts of different nodes: right ones, found without comparing or shuffling all texts where the first ones have enough."""

from __future__ import annotations

import os
import random

import pytest

from anchorlake.operators import similarity
from anchorlake.plans import registry
from tests.test_similarity_size import alike, tables, texts, written  # noqa: F401


def brute(rows, k=5):
    t = sorted((n, key, x) for key, n, x in rows)
    return sorted((a[0], a[1], b[0], b[1]) for a in t for b in t if a[0] < b[0] and alike(a[2], b[2]))[:k]


def lone(n):
    """Texts none of which is alike to another."""
    return [(f"m{i:04}", f"n{i % 7}", " ".join(f"u{i}x{j}" for j in range(6))) for i in range(n)]


@pytest.mark.parametrize("kind", ["many", "copies", "late", "few", "one node"])
def test_first_pairs_of_texts(spark, monkeypatch, kind):
    monkeypatch.setattr(similarity, "FIRST", 40)
    some = [(k, "n" + str(random.Random(k).randrange(9)), t) for k, _, t in texts(300)]
    rows = {
        "many": some,
        "copies": [(k, n, "one text that all have") for k, n, _ in some],
        "late": [(k, "a", t) for k, _, t in lone(100)] + some,
        "few": lone(100) + [("z1", "y1", "a b c d e f"), ("z2", "y2", "f e d c b a")],
        "one node": [(k, "n", t) for k, _, t in some],
    }[kind]
    got = similarity.first_pairs(spark.createDataFrame(rows, "k string, n string, text string"), "n", "k").collect()
    assert [tuple(r) for r in got] == brute(rows)


def test_first_pairs_of_copies_that_are_out_of_date(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FIRST", 40)
    now = [(k, "n" + str(random.Random(k).randrange(9)), t) for k, _, t in texts(300)]
    old = [(k, "n0", now[0][2]) for k, _, _ in now[::3]] + [(f"gone{i}", "n0", now[0][2]) for i in range(20)]
    shape = "k string, n string, text string"
    got = similarity.first_pairs(spark.createDataFrame(now, shape), "n", "k", copies=spark.createDataFrame(now + old, shape)).collect()
    assert [tuple(r) for r in got] == brute(now)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_dup_cross_first_shuffles_a_part_of_the_entries(spark, tables):  # noqa: F811
    rows, most = written(spark, lambda: registry.QUERIES["dup_cross_first"](spark, tables[0]).collect())
    assert len(rows) == 5 and most < tables[1]
