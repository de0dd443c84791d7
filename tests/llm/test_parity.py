from __future__ import annotations

import os

import pytest

from anchorlake.llm import registry
from tests.test_parity import DIR, compare


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", ["p4_found", "p5_found", "p5_classes", "p7_daily_sketches", "p7_within_bounds", "p9_share_check"])
def test_same_rows(spark, name):
    compare(spark, name, registry.QUERIES, registry.SQL)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_mixture_and_pieces_over_the_tables(spark):
    shares = {r["source"]: r for r in registry.QUERIES["p9_shares"](spark, DIR).collect()}
    mixed = registry.QUERIES["p9_mixture"](spark, DIR).collect()
    for s, r in shares.items():
        assert r["tokens"] == sum(x["tokens"] * x["copies"] for x in mixed if x["source"] == s)
        assert all(x["copies"] <= r["max_repeats"] for x in mixed if x["source"] == s)
    found = {r["doc_id"] for r in registry.QUERIES["p10_found"](spark, DIR).collect()}
    sizes = {r["doc_id"]: len(r["ids"]) for r in registry.QUERIES["p8_ids"](spark, DIR).collect()}
    assert found == {k for k, n in sizes.items() if n > 2000}
