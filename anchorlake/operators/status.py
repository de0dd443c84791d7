"""Counts over the knowledge base: census, coverage, age, churn, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.functions import text as T

SYMBOLS = ("function", "decl")


def informed(entries: DataFrame) -> DataFrame:
    """``node_id`` of nodes with an active entry."""
    return entries.where("active AND node_id IS NOT NULL").select("node_id").distinct()


def census(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: nodes, digested ones (with an active entry), suspect, orphaned and undigested ones."""
    d = nodes.join(informed(entries).withColumn("_d", F.lit(True)), "node_id", "left")
    when = lambda s: F.count_if(F.col("status") == s).alias(s)
    return d.agg(F.count("*").alias("nodes"), F.count_if(F.coalesce("_d", F.lit(False))).alias("digested"), when("suspect"), when("orphaned"), when("undigested"))


def shares(entries: DataFrame, by: str) -> DataFrame:
    """``by``, entries and their integer percent of all active ones (truncated)."""
    per = entries.where("active").groupBy(F.coalesce(by, F.lit("none")).alias(by)).agg(F.count("*").alias("entries"))
    total = per.agg(F.sum("entries").alias("_all"))
    return per.join(F.broadcast(total), F.lit(True)).select(by, "entries", T.percent(F.col("entries"), F.col("_all")).alias("percent"))


def coverage(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Per directory and the project: symbol nodes below, how many are digested, percent. One pass: each file counts for all above it."""
    symbols = nodes.where(F.col("level").isin(*SYMBOLS) & F.col("file").isNotNull()).join(informed(entries).withColumn("_d", F.lit(1)), "node_id", "left")
    per_file = symbols.groupBy("file").agg(F.count("*").alias("n"), F.count("_d").alias("d"))
    up = per_file.select(F.explode(T.ancestors(F.col("file"))).alias("directory"), "n", "d")
    return up.groupBy("directory").agg(F.sum("n").alias("symbols"), F.sum("d").alias("digested")).withColumn("percent", T.percent(F.col("digested"), F.col("symbols")))


def digestion(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Per file: symbol nodes, digested ones, percent."""
    symbols = nodes.where(F.col("level").isin(*SYMBOLS) & F.col("file").isNotNull()).join(informed(entries).withColumn("_d", F.lit(1)), "node_id", "left")
    return symbols.groupBy("file").agg(F.count("*").alias("symbols"), F.count("_d").alias("digested")).withColumn("percent", T.percent(F.col("digested"), F.col("symbols")))


def age_seconds(at: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(at)


def age_label(seconds: Column) -> Column:
    """m, h or d, truncated; unknown where there is no time."""
    return F.when(seconds.isNull(), "unknown").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))


def ages(entries: DataFrame, now: Column) -> DataFrame:
    """One row: active entries with a time, their mean age in whole days and that of the newest."""
    s = entries.where("active AND at IS NOT NULL").select(age_seconds(F.col("at"), now).alias("s"))
    return s.agg(F.count("*").alias("entries"), F.floor(F.sum("s") / F.count("*") / 86400).alias("mean_days"), age_label(F.min("s")).alias("newest"))


def activity(changes: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row: changes in the last days, those with evidence (``verified``), those that overturn, those that revert."""
    recent = changes.where((F.col("at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("at") <= now))
    return recent.agg(F.count("*").alias("changes"), F.count("verified").alias("verified"), F.count("overturns").alias("overturns"), F.count("reverts").alias("reverts"))


def edges_between_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src_file, dst_file`` of node edges that leave their file."""
    f = nodes.select("node_id", "file")
    a, b = f.select(F.col("node_id").alias("src"), F.col("file").alias("src_file")), f.select(F.col("node_id").alias("dst"), F.col("file").alias("dst_file"))
    return edges.join(a, "src").join(b, "dst").where("src_file <> dst_file")


def centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``file, callers``: edges from other files."""
    return edges_between_files(edges, nodes).groupBy(F.col("dst_file").alias("file")).agg(F.count("*").alias("callers"))


def churn(history: DataFrame, nodes: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """``file, touches``: changes of the file's nodes in the last days."""
    h = history.where((F.col("at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("at") <= now)).join(nodes.select("node_id", "file"), "node_id")
    return h.select("file", "id").distinct().groupBy("file").agg(F.count("*").alias("touches"))


def hotspots(digested: DataFrame, touches: DataFrame, callers: DataFrame, k: int = 10) -> DataFrame:
    """The k hottest files that aren't fully digested: heat is (1 + touches) x (1 + callers); nothing if none is above 1."""
    h = digested.where("digested < symbols").join(touches, "file", "left").join(callers, "file", "left")
    heat = (1 + F.coalesce("touches", F.lit(0))) * (1 + F.coalesce("callers", F.lit(0)))
    return h.select("file", heat.alias("heat")).where("heat > 1").orderBy(F.desc("heat"), "file").limit(k)


def gaps(edges: DataFrame, nodes: DataFrame, entries: DataFrame, least: int = 2) -> DataFrame:
    """``node_id, callers``: symbols that at least ``least`` nodes lead to and nobody has described."""
    called = edges.groupBy(F.col("dst").alias("node_id")).agg(F.countDistinct("src").alias("callers")).where(F.col("callers") >= least)
    return called.join(nodes.where(F.col("level").isin(*SYMBOLS)).select("node_id"), "node_id", "left_semi").join(informed(entries), "node_id", "left_anti")


def importance(entries: DataFrame) -> DataFrame:
    """Active entries with ``place`` in their node: verified, inferred, suspect, others; then the newest; then id."""
    from pyspark.sql import Window as W

    rank = F.when(F.col("confidence") == "verified", 0).when(F.col("confidence") == "inferred", 1).when(F.col("confidence") == "suspect", 2).otherwise(3)
    place = F.row_number().over(W.partitionBy("node_id").orderBy(rank, F.desc_nulls_last("at"), "entry_id"))
    return entries.where("active AND node_id IS NOT NULL").withColumn("place", place)


def within_budget(rows: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """The first rows of each group whose costs together stay within the budget; ``spent`` so far."""
    from pyspark.sql import Window as W

    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)
