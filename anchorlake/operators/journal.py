"""The journal of changes: history of nodes, changes no longer in effect, risky nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anchorlake.common import filled, keep, release
from anchorlake.operators.resolve import resolve_as_of


def _named(changes: DataFrame, also: list[str] = ()) -> DataFrame:
    return changes.select("id", "at", *also, F.explode("nodes").alias("_r")).select("id", "at", *also, filled("_r").alias("ref")).where("ref IS NOT NULL")


def touched(changes: DataFrame) -> DataFrame:
    """``id, at, ref`` for each node that a change names, each once."""
    return _named(changes).distinct()


def history(changes: DataFrame, nodes: DataFrame, also: list[str] = ()) -> DataFrame:
    """``node_id, id, at, via_lineage`` and a change's columns ``also``: each change of each current node once.

    A change made before a node's beginning counts only if it came through the lineage. What a change names twice is put together
    with what it names through two names, so it isn't shuffled for that before.
    """
    got = resolve_as_of(_named(changes, also), nodes).groupBy("node_id", "id", "at", *also).agg(F.min("via_lineage").alias("via_lineage"))
    got = got.join(nodes.select("node_id", "since"), "node_id")
    return got.where(F.col("via_lineage") | F.col("since").isNull() | (F.col("at") >= F.col("since"))).select("node_id", "id", "at", *also, "via_lineage")


def recent(history_: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` changes of each node, ``place`` from the newest."""
    place = F.row_number().over(W.partitionBy("node_id").orderBy(F.desc_nulls_last("at"), F.desc("id")))
    return history_.withColumn("place", place).where(F.col("place") <= n)


def landmines(changes: DataFrame, nodes: DataFrame, entries: DataFrame, least: int = 3) -> DataFrame:
    """``node_id, score``: a point per change, two more if it overturns or reverts, one per refuted entry; ``least`` and more."""
    weight = changes.select("id", F.when(F.col("overturns").isNotNull() | F.col("reverts").isNotNull(), 3).otherwise(1).alias("points"))
    by_change = resolve_as_of(touched(changes), nodes).select("node_id", "id").distinct().join(weight, "id").select("node_id", "points")
    refuted = entries.where("confidence = 'refuted'").join(nodes.select("node_id"), "node_id").select("node_id", F.lit(1).alias("points"))
    return by_change.unionByName(refuted).groupBy("node_id").agg(F.sum("points").alias("score")).where(F.col("score") >= least)


class MalformedJournal(ValueError):
    """Links that can't be followed: a missing or later target, a link to itself or a cycle."""


def check_links(changes: DataFrame) -> DataFrame:
    """``id, target, problem`` of ``overturns`` and ``reverts`` that are self-links, miss their target or point at a later change."""
    links = changes.select("id", "at", F.explode(F.array("overturns", "reverts")).alias("target")).where("target IS NOT NULL")
    t = changes.select(F.col("id").alias("target"), F.col("at").alias("_t"))
    got = links.join(t, "target", "left")
    known = changes.select(F.col("id").alias("target"), F.lit(True).alias("_there"))
    problem = F.when(F.col("id") == F.col("target"), "self").when(F.col("_there").isNull(), "missing").when(F.col("_t") > F.col("at"), "later")
    return got.join(known, "target", "left").select("id", "target", problem.alias("problem")).where("problem IS NOT NULL").distinct()


def inactive(changes: DataFrame, strict: bool = False) -> DataFrame:
    """``id`` of changes without effect: reverted by a change that is applied, or overturned by one.

    A change is applied unless an applied change reverts it. Decided by height: first those that nobody reverts, then those all of
    whose reverters are decided. Links to themselves, to missing or to later changes raise with ``strict`` and are passed over
    otherwise; changes on a cycle of reverts then stay undecided and count as applied.
    """
    changes = keep(changes.select("id", "at", "overturns", "reverts"))
    bad = keep(check_links(changes))
    if strict and (first := bad.take(1)):
        raise MalformedJournal(f"{first[0]['id']}: {first[0]['problem']} target {first[0]['target']}")
    ok = lambda c: changes.where(F.col(c).isNotNull()).select(F.col("id").alias("by"), F.col(c).alias("target")).join(bad.select(F.col("id").alias("by"), "target"), ["by", "target"], "left_anti")
    reverts = keep(ok("reverts"))
    state = keep(changes.join(reverts.select(F.col("target").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("applied")))
    todo = keep(reverts.select(F.col("target").alias("id")).distinct())
    left = todo.count()
    while left:
        by = reverts.join(state.select(F.col("id").alias("by"), "applied"), "by", "left")
        ready = by.groupBy(F.col("target").alias("id")).agg(F.max(F.coalesce(F.col("applied"), F.lit(False))).alias("_hit"), F.min(F.col("applied").isNotNull()).alias("_known")).join(todo, "id")
        decided = keep(ready.where(F.col("_hit") | F.col("_known")).select("id", (~F.col("_hit")).alias("applied")))
        n = decided.count()
        if not n:
            if strict:
                raise MalformedJournal("cycle of reverts")
            break
        nxt = keep(state.unionByName(decided))
        rest = keep(todo.join(decided.select("id"), "id", "left_anti"))
        release(state), release(todo)
        state, todo, left = nxt, rest, left - n
    undone = state.where("NOT applied").select("id")
    applied = state.where("applied").select("id").unionByName(todo)
    over = ok("overturns").join(applied.withColumnRenamed("id", "by"), "by", "left_semi").select(F.col("target").alias("id"))
    return undone.unionByName(over).distinct()


def clusters(nodes: DataFrame, entries: DataFrame, least: int = 2) -> DataFrame:
    """Keyword clusters: ``keyword, members, nodes, entries``; of keywords with the same nodes only the first.

    Sets of nodes are compared by a hash over their sorted ids, which is built from one hash per node that adds up, so a keyword
    that a third of all nodes have isn't gathered anywhere.
    """
    k = nodes.select("node_id", F.explode(F.array_distinct(F.transform("keywords", lambda w: F.lower(F.trim(w))))).alias("keyword")).where("keyword <> ''").distinct()
    n = entries.where("active").groupBy("node_id").agg(F.count("*").alias("_n"))
    part = lambda seed: F.sum(F.xxhash64("node_id", F.lit(seed)).cast("decimal(20,0)"))
    per = k.join(n, "node_id", "left").groupBy("keyword").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("_n", F.lit(0))).alias("entries"), part(1).alias("_x"), part(2).alias("_y")).where(F.col("nodes") >= least)
    first = F.row_number().over(W.partitionBy("nodes", "_x", "_y").orderBy("keyword"))
    return per.withColumn("_r", first).where("_r = 1").select("keyword", "nodes", "entries")
