"""Edges between entries and nodes: disputes, dependents, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.common import filled, keep, release
from anchorlake.operators.resolve import resolve_entries, resolve_now


def entry_edges(entries: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """``src, dst``: entries and the entries their references in ``column`` now mean, each pair once."""
    refs = entries.select(F.col("entry_id").alias("src"), F.explode(column).alias("_r")).select("src", filled("_r").alias("ref")).where("ref IS NOT NULL").distinct()
    return resolve_entries(refs, nodes, entries).where("entry_id IS NOT NULL").select("src", F.col("entry_id").alias("dst")).distinct()


def open_disputes(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst`` of disputes whose two sides are both active."""
    active = entries.where("active").select("entry_id")
    edges = entry_edges(entries, nodes, "disputes")
    return edges.join(active.withColumnRenamed("entry_id", "src"), "src", "left_semi").join(active.withColumnRenamed("entry_id", "dst"), "dst", "left_semi").select("src", "dst")


def declared_disputes(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, ref, dst`` of open disputes as declared: a row for each reference to an active entry, also if two mean the same one."""
    active = entries.where("active").select("entry_id")
    refs = entries.where("active").select(F.col("entry_id").alias("src"), F.explode("disputes").alias("_r")).select("src", filled("_r").alias("ref")).where("ref IS NOT NULL").distinct()
    got = resolve_entries(refs, nodes, entries).where("entry_id IS NOT NULL").select("src", "ref", F.col("entry_id").alias("dst"))
    return got.join(active.withColumnRenamed("entry_id", "dst"), "dst", "left_semi").select("src", "ref", "dst")


def disputed(disputes: DataFrame) -> DataFrame:
    """``entry_id`` of both sides, each once."""
    return disputes.select(F.col("src").alias("entry_id")).unionByName(disputes.select(F.col("dst").alias("entry_id"))).distinct()


def dependents(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, entry_id, depth``: all that rests on a root, directly or not, each once at its least depth; never the root itself.

    ``edges`` (``src`` rests on ``dst``) is read once per level of the closure; a level holds only pairs not seen before, so
    cycles end it.
    """
    edges = keep(edges.select("src", "dst").distinct())
    front = keep(roots.select(F.col("entry_id").alias("root"), F.col("entry_id")).distinct())
    seen = front.select("root", "entry_id", F.lit(0).cast("long").alias("depth"))
    depth = 0
    while True:
        depth += 1
        nxt = front.join(edges, front["entry_id"] == edges["dst"]).select("root", F.col("src").alias("entry_id")).distinct().join(seen.select("root", "entry_id"), ["root", "entry_id"], "left_anti")
        nxt = keep(nxt)
        if nxt.isEmpty():
            release(nxt)
            return seen.where("depth > 0")
        # One table of all that is known, so a round reads what there is once, whatever the number of rounds before.
        more = keep(seen.unionByName(nxt.select("root", "entry_id", F.lit(depth).cast("long").alias("depth"))))
        release(seen), release(front)
        seen, front = more, nxt


def flow_steps(flows: DataFrame) -> DataFrame:
    """``flow, position, ref, at`` of all steps that name a node; a step without a time of its own has the flow's."""
    s = flows.where("NOT deprecated").select("id", "since", F.posexplode("steps").alias("position", "step"))
    return s.select(F.col("id").alias("flow"), "position", filled("step.node").alias("ref"), F.coalesce("step.since", "since").alias("at")).where("ref IS NOT NULL")


def neighbours(edges: list[tuple[str, DataFrame]], hits: DataFrame, informed: DataFrame, limit: int = 5) -> DataFrame:
    """One step from ``hits`` (``node_id``) along named edges (``src, dst``), hits left out: ``node_id, score``.

    A point for each edge that leads there, two more where the node has active entries (``informed``: node_id).
    """
    h = hits.select(F.col("node_id").alias("src")).distinct()
    steps = None
    for name, e in edges:
        one = e.select("src", "dst").distinct().join(h, "src").select(F.col("dst").alias("node_id"), F.lit(name).alias("edge"))
        steps = one if steps is None else steps.unionByName(one)
    got = steps.groupBy("node_id").agg(F.count("*").alias("n")).join(hits.select("node_id"), "node_id", "left_anti")
    got = got.join(informed.select("node_id", F.lit(2).alias("_more")).distinct(), "node_id", "left")
    return got.select("node_id", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("score")).orderBy(F.desc("score"), "node_id").limit(limit)


def same_flow(flows: DataFrame, nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``src, dst`` of different nodes on one flow; ``of``: only for these ``src`` (``node_id``), so that no other flow is joined."""
    s = resolve_now(flow_steps(flows).select("flow", "ref").distinct(), nodes).select("flow", "node_id").distinct()
    a, b = s.withColumnRenamed("node_id", "src"), s.withColumnRenamed("node_id", "dst")
    if of is not None:
        a = a.join(of.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")
    return a.join(b, "flow").where("src <> dst").select("src", "dst").distinct()


def rested_on_nodes(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``src, dst`` of nodes: an entry of src rests on an entry of dst."""
    where = entries.select("entry_id", "node_id")
    a, b = where.select(F.col("entry_id").alias("src"), F.col("node_id").alias("_a")), where.select(F.col("entry_id").alias("dst"), F.col("node_id").alias("_b"))
    return edges.join(a, "src").join(b, "dst").where("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()
