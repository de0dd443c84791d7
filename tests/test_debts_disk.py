"""Debts by kind: nothing that they were made of stays on disk."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import pytest

from anchorlake.common import shared_dir
from anchorlake.operators import maintenance, similarity
from anchorlake.plans import registry, reports

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")


def test_maintenance_plan_leaves_no_table_of_texts_or_histories(spark):
    at = urlparse(shared_dir(spark)).path + "/anchorlake"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    got = registry.QUERIES["maintenance_plan"](spark, TABLES)
    left = {c for name in set(os.listdir(at)) - before for c in spark.read.parquet(f"{at}/{name}").columns}
    assert "debt" in left and not left & {"text", "words", "nodes", "lineage"}
    assert {r["part"] for r in got.collect()} == {"kind", "next"}


def test_debt_next_compares_entries_of_one_node_only_in_its_folder(spark, monkeypatch):
    seen, classes = [], similarity.classes

    def spy(texts, key, within=(), *args, **more):
        if within:
            seen.extend(r["node_id"] for r in texts.select("node_id").distinct().collect())
        return classes(texts, key, within, *args, **more)

    monkeypatch.setattr(similarity, "classes", spy)
    got = registry.QUERIES["debt_next"](spark, TABLES).collect()
    assert seen and all(n.startswith("pkg/") for n in seen)
    monkeypatch.undo()
    assert got == maintenance.next_debt(reports.debts_all(spark, TABLES), "pkg/").collect()
