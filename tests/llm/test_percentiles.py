from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from anchorlake.llm.percentiles import ERROR, merge, percentiles, sketch

AT = {"low": 0.0, "q1": 0.25, "median": 0.5, "q99": 0.99, "top": 1.0}


def test_error_bound_signs_and_merging(spark):
    random.seed(2)
    rows = [("a" if i % 3 else "b", i % 5, random.choice([-1, 1]) * int(random.paretovariate(0.4)) if i % 7 else 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, day int, v long")
    days = sketch(df, "v", ["g", "day"])
    got = {r["g"]: r for r in percentiles(merge(days, ["g"]), ["g"], AT).collect()}
    one = {r["g"]: r for r in percentiles(sketch(df, "v", ["g"]), ["g"], AT).collect()}
    assert got == one
    for g in "ab":
        v = sorted(x for k, _, x in rows if k == g)
        assert got[g]["n"] == len(v)
        for name, q in AT.items():
            true = v[math.floor(q * (len(v) - 1))]
            assert abs(got[g][name] - true) <= ERROR * abs(true) * (1 + 1e-9)


def test_nulls_nan_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), (None, 5.0), (None, float("inf")), ("b", 7.0), ("b", 7.0)], "g string, v double")
    got = {r["g"]: (r["n"], r["median"]) for r in percentiles(sketch(df, "v", ["g"]), ["g"], AT).collect()}
    assert set(got) == {None, "b"} and got["b"][0] == 2 and abs(got["b"][1] - 7) <= 0.07
    assert percentiles(sketch(df.where(F.lit(False)), "v", ["g"]), ["g"], AT).collect() == []
