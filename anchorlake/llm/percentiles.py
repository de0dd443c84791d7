"""Percentiles of very large columns, with a bounded relative error and sketches that add up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Estimates lie within this part of the true value.
ERROR = 0.01


def bucket(value: Column, error: float = ERROR) -> Column:
    """The signed logarithmic bucket of a value: 0 for 0, +-(k + 10**6) for gamma**(k-1) < |value| <= gamma**k."""
    width = math.log((1 + error) / (1 - error))
    v = value.cast("double")
    k = F.ceil(F.round(F.ln(F.abs(v)) / F.lit(width), 9)).cast("long") + 1_000_000
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, k).when(v < 0, -k)


def middle(at: Column, error: float = ERROR) -> Column:
    """The value that is within ``error`` of all values of a bucket."""
    gamma = (1 + error) / (1 - error)
    size = F.exp((F.abs(at) - 1_000_000) * F.lit(math.log(gamma))) * F.lit(2 / (1 + gamma))
    return F.when(at == 0, F.lit(0.0)).otherwise(F.signum(at.cast("double")) * size)


def sketch(df: DataFrame, value: str, by: list[str], error: float = ERROR) -> DataFrame:
    """``by``, ``bucket`` and ``n``: how many values of each group lie in each bucket. Null and NaN values aren't counted.

    Sketches of parts, days or machines add up: :func:`merge` of them is the sketch of all rows. A group has at most some
    thousand buckets however many rows it has (1,400 for all magnitudes up to a trillion at one per cent), and counting combines
    within each input partition, so no group is a hot spot.
    """
    v = F.col(value)
    df = df.where(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return df.groupBy(*by, bucket(v, error).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, by: list[str], at: dict[str, float], error: float = ERROR) -> DataFrame:
    """``by``, ``n`` and a column per name of ``at``: the value of rank floor(q * (n - 1)), within ``error`` of the true one.

    Windows and the last aggregate see buckets, not rows. Groups without values have no row.
    """
    w = W.partitionBy(*by)
    upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = sketches.withColumn("_upto", upto).withColumn("_n", F.sum("n").over(w))
    pick = [F.min(F.when(F.col("_upto") > F.floor(F.lit(q) * (F.col("_n") - 1)), F.col("bucket"))).alias(name) for name, q in at.items()]
    picked = ranked.groupBy(*by).agg(F.max("_n").alias("n"), *pick)
    return picked.select(*by, "n", *[middle(F.col(name), error).alias(name) for name in at])


def exact(df: DataFrame, value: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """As :func:`percentiles`, without error: from the counts of distinct values, so a group of equal rows is no burden.

    For checks: a group's distinct values are ranked in one sorted stream.
    """
    v = F.col(value)
    df = df.where(v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    per = df.groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_k"))
    w = W.partitionBy(*by)
    ranked = per.withColumn("_upto", F.sum("_k").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_n", F.sum("_k").over(w))
    pick = [F.min(F.when(F.col("_upto") > F.floor(F.lit(q) * (F.col("_n") - 1)), F.col("_v"))).alias(name) for name, q in at.items()]
    return ranked.groupBy(*by).agg(F.max("_n").alias("n"), *pick)
