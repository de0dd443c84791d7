"""Mixing sources to target weights by size, with capped repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anchorlake.common import keep, release

#: Ranks fall into so many buckets, of which only the one that the target falls into is sorted.
BUCKETS = 65_536
#: The chance of a document, which is no whole copy, goes with its tokens to this power.
POWER = -0.5
_UNIT = float(2**53)


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    return (F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(2**53)).cast("double") + 0.5) / F.lit(_UNIT)


def plan_shares(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """A row per target source: ``source, weight, max_repeats, available`` (its size), ``goal`` (its share of the mixture's size).

    Sources of no size can't have a share; the weights of the others are scaled to add up to 1. Without ``total`` the mixture is
    as large as it can be with every such source at its share: the least of size x max_repeats / weight decides. With ``total``
    a source whose copies don't suffice gives all of them and its shortfall shows in the report.
    """
    t = targets.where(F.col("source").isNotNull() & (F.col("weight") > 0)).groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    has = t.join(sizes.groupBy("source").agg(F.sum("tokens").alias("available")), "source", "left").fillna(0, ["available", "max_repeats"])
    can = (F.col("available") > 0) & (F.col("max_repeats") > 0)
    everything = W.partitionBy(F.lit(0))  # one row per target source
    share = F.when(can, F.col("weight")) / F.sum(F.when(can, F.col("weight"))).over(everything)
    most = F.col("available") * F.col("max_repeats")
    has = has.withColumn("_share", share).withColumn("_most", most)
    whole = F.lit(float(total)) if total is not None else F.min(F.col("_most") / F.col("_share")).over(everything)
    return has.withColumn("goal", F.coalesce(F.least(F.col("_share") * whole, F.col("_most").cast("double")), F.lit(0.0))).drop("_share", "_most")


def inclusion(docs: DataFrame, rest: DataFrame, power: float) -> DataFrame:
    """``source, factor``: a document of size t is to be included with probability min(1, factor x t**power), so that ``rest`` is the
    expected size of what is included.

    Sizes of which more would be wanted are certain. They are found from sums over the distinct sizes of a source, in the order in
    which they are wanted.
    """
    t, n = F.col("tokens").cast("double"), F.col("_n").cast("double")
    per = docs.groupBy("source", "tokens").agg(F.count("*").alias("_n")).join(rest, "source").withColumn("_w", F.pow(t, F.lit(float(power))))
    order = W.partitionBy("source").orderBy(F.desc("_w"), F.desc("tokens"))
    above = F.coalesce(F.sum(n * t).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    below = F.sum(n * t * F.col("_w")).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    sums = per.withColumn("_f", (F.col("rest") - above) / below)
    return sums.where((F.col("_f") >= 0) & (F.col("_f") * F.col("_w") <= 1 + 1e-12)).groupBy("source").agg(F.max_by("_f", F.struct("_w", "tokens")).alias("factor"))


def _take(ranked: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """Rows of each source in the order of their ranks while their tokens add up to no more than ``rest``."""
    per = ranked.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).join(rest, "source")
    upto = F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    per = per.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    at = per.where("before <= rest").select("source", "bucket", "rest", "before", F.col("upto").alias("_upto"))
    marked = ranked.join(at, ["source", "bucket"])
    run = F.sum("tokens").over(W.partitionBy("source", "bucket").orderBy("rank", key).rowsBetween(W.unboundedPreceding, W.currentRow))
    last = marked.where("_upto > rest").withColumn("_run", F.col("before") + run).where("_run <= rest")
    cols = [key, "source", "tokens"]
    return marked.where("_upto <= rest").select(*cols).unionByName(last.select(*cols))


def _fill(left: DataFrame, taken: DataFrame, rest: DataFrame, key: str) -> tuple[list[DataFrame], DataFrame]:
    """What still fits after the sample was cut: of each source the greatest document that does, again and again until none fits.

    ``rest`` is what a source lacks, less than one document of its own. Each round is one aggregate over the documents that fit;
    as the greatest is taken, few rounds do. The second result is what each source then lacks.
    """
    out = []
    left = keep(left.join(taken.select(key), key, "left_anti").join(rest, "source").where("tokens <= rest").select(key, "source", "tokens"))
    while True:
        best = keep(left.join(rest, "source").where("tokens <= rest").groupBy("source").agg(F.max(F.struct("tokens", key)).alias("_m")).select("source", "_m.*"))
        if best.isEmpty():
            release(best), release(left)
            return out, rest
        out.append(best.select(key, "source", "tokens"))
        rest = keep(rest.join(best.select("source", F.col("tokens").alias("_got")), "source", "left").select("source", (F.col("rest") - F.coalesce("_got", F.lit(0))).alias("rest")))
        nxt = keep(left.join(rest, "source").where("tokens <= rest").select(key, "source", "tokens").join(best.select(key), key, "left_anti"))
        release(left)
        left = nxt


def _exchange(ranked: DataFrame, taken: DataFrame, rest: DataFrame, key: str) -> DataFrame:
    """``source, out, into``: of each source that still lacks something, the document to be put out and the one to be taken for it.

    What comes in is the smallest document left; what goes out the smallest taken that makes room for it. So what is lacking falls
    from less than the former to about the distance between two sizes.
    """
    left = ranked.join(taken.select(key), key, "left_anti").groupBy("source").agg(F.min(F.struct("tokens", key)).alias("_b"))
    want = rest.where("rest > 0").join(left, "source").select("source", "_b", (F.col("_b.tokens") - F.col("rest")).alias("_need"))
    room = taken.join(want, "source").where("tokens >= _need AND tokens < _b.tokens").groupBy("source").agg(F.min(F.struct("tokens", key)).alias("_a"), F.first("_b").alias("_b"))
    return room.select("source", F.col(f"_a.{key}").alias("out"), F.col(f"_b.{key}").alias("into"))


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = 1, power: float = POWER) -> tuple[DataFrame, DataFrame]:
    """The mixture (``key, source, tokens, copies``; copies at least 1) and its report per target source.

    ``docs`` has ``key``, ``source`` and ``tokens``, one row per document; ``targets`` has ``source``, ``weight`` and
    ``max_repeats``. Sources that aren't targets, null sources and documents of no tokens aren't used. Each document of a source
    is taken floor(goal / available) times for certain. What then is missing is a sample of the source's documents, one more copy
    of each: the chance of a document goes with its tokens to the ``power`` (1 where that would be more). By default shorter ones
    are likelier than longer ones, so that a source's share isn't filled by a few giants; 1 makes it proportional to size, 0 equal
    for all. Documents are ranked by random odds over the odds of their inclusion (Pareto order sampling), and the sample ends where its tokens reach what
    is missing. So its size in tokens is fixed, short by less than one document; that is filled with documents that still fit,
    until none does, and then one document of a source may be exchanged for a longer one. No document is used more than ``max_repeats`` times. The same seed gives the same mixture. The report has
    ``source, weight, max_repeats, available, goal, tokens, documents, share``; sources that give nothing have share 0.

    Of a source of any size only sums per size and per bucket of ranks, and the rows of one bucket in 65,536, are sorted in one
    task.
    """
    docs = docs.select(key, "source", "tokens").where(F.col("source").isNotNull() & (F.col("tokens") > 0) & F.col(key).isNotNull())
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    plan = keep(plan_shares(sizes, targets, total))
    certain = F.floor(F.col("goal") / F.col("available"))
    few = plan.where("goal > 0").select("source", "max_repeats", certain.alias("certain"), (F.col("goal") - certain * F.col("available")).alias("rest"))
    rest = keep(few.where("rest > 0 AND certain < max_repeats").select("source", "rest"))
    factor = keep(inclusion(docs, rest, power))
    # One row per target source: the targets are a list made by hand; its size is checked by Spark's own broadcast threshold.
    u, p = uniform(F.col(key), seed), F.least(F.col("factor") * F.pow(F.col("tokens").cast("double"), F.lit(float(power))), F.lit(1.0))
    odds = F.when(p < 1, p / (1 - p))
    rank = F.when(odds.isNull(), F.lit(0.0)).otherwise((u / (1 - u)) / odds)
    ranked = keep(docs.join(factor, "source").withColumn("rank", rank).select(key, "source", "tokens", "rank", F.floor(F.col("rank") / (F.col("rank") + 1) * BUCKETS).alias("bucket")))
    taken = keep(_take(ranked, rest, key))
    lack = keep(rest.join(taken.groupBy("source").agg(F.sum("tokens").alias("_got")), "source", "left").select("source", (F.col("rest") - F.coalesce("_got", F.lit(0))).alias("rest")))
    filled, lack = _fill(ranked, taken, lack, key)
    for f in filled:
        taken = taken.unionByName(f)
    swap = keep(_exchange(ranked, taken, lack, key))
    more = taken.select(key).join(swap.select(F.col("out").alias(key)), key, "left_anti").unionByName(swap.select(F.col("into").alias(key)))
    out = docs.join(few, "source").join(more.select(key, F.lit(1).alias("more")), key, "left")
    out = out.select(key, "source", "tokens", F.least(F.col("certain") + F.coalesce("more", F.lit(0)), F.col("max_repeats")).cast("long").alias("copies")).where("copies > 0")
    got = out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"))
    report = plan.join(got, "source", "left").fillna(0, ["tokens", "documents"])
    report = report.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy(F.lit(0)))), F.lit(0.0)))
    return out, report
