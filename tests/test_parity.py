"""Queries of the core against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

from anchorlake.plans import registry

DIR = "/root/testdata/sf0.001"
NAMES = ["p1_found", "p1_by_period", "p3_found", "p3_descendants", "tokenize_terms", "split_ident", "change_history_asof", "landmine_score", "open_disputes", "dup_cross", "redaction_cases", "lint_cases", "debts_all", "vector_topk_by_lane", "coverage_rollup", "status_census", "session_ledger", "upper_median", "eval_recall_mrr", "reconcile_status", "interface_division", "kb_map"]


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return "\0" if v is None else repr(v) if isinstance(v, float) else str(v)


def compare(spark, name, queries, sql):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(DIR + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql[name])
    at = {c: k for k, c in enumerate(rel.columns)}
    assert sorted(at) == cols
    assert got == sorted(tuple(plain(r[at[c]]) for c in cols) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    compare(spark, name, registry.QUERIES, registry.SQL)
