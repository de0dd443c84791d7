"""What writing does to the tables: new entries, effects of changes on entries, their reversal, nodes that move or go.

Every function returns rows to be added or put in place of others; nothing is written here. Who may do what isn't decided here.
"""

from __future__ import annotations

import hashlib
import secrets
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.functions import text as T
from anchorlake.functions import values as V
from anchorlake.operators import graph, similarity
from anchorlake.operators.resolve import heirs, resolve_now

#: What of an entry a change can alter.
STATE = ["confidence", "confirmed_at", "superseded_by", "retired_by", "refuted_by"]


def new_change_id(now: datetime | None = None) -> str:
    """An id of a change: its time in UTC and 64 random bits. For drivers; a query that used it would differ each time."""
    at = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    return f"chg_{at:%Y%m%dT%H%M%SZ}_{secrets.token_hex(8)}"


def new_entry_id() -> str:
    return f"e_{secrets.token_hex(4)}"


def port_of(path: str) -> int:
    """A port between 18,000 and 19,999 that depends on a path alone (32-bit FNV-1a)."""
    h = 0x811C9DC5
    for b in path.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return 18_000 + h % 2_000


def judged(new: DataFrame, entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``new`` entries (``entry_id, node_id, kind, text``) with ``verdict`` and ``reason``, a row each.

    reject: a node that isn't there, more tokens than its level allows, a text that orders a model about, the very text (but for
    blanks and case) of an active entry of the node. warn: almost as long, alike to an active entry of the node, words of work in
    progress, a softer order. else ok.
    """
    n = nodes.select("node_id", "level")
    e = entries.where("active AND node_id IS NOT NULL").select("node_id", F.col("entry_id").alias("_id"), F.col("text").alias("_text"))
    same = new.select("entry_id", "node_id", T.normalized(F.col("text")).alias("_k")).join(e.select("node_id", T.normalized(F.col("_text")).alias("_k")).distinct(), ["node_id", "_k"], "left_semi").select("entry_id", F.lit(True).alias("_same"))
    near = new.select("entry_id", "node_id", T.grams(F.col("text")).alias("_g")).join(e.select("node_id", T.grams(F.col("_text")).alias("_h")), "node_id")
    like = near.where(similarity.sized(F.col("_g"), F.col("_h")) & similarity.alike(F.col("_g"), F.col("_h"))).select("entry_id", F.lit(True).alias("_like")).distinct()
    got = new.join(n, "node_id", "left").join(same, "entry_id", "left").join(like, "entry_id", "left")
    size, lint = V.over_budget(T.token_estimate(F.coalesce("text", F.lit(""))), F.col("level")), T.lint(F.coalesce("text", F.lit("")))
    reason = (
        F.when(F.col("level").isNull(), "no node")
        .when(T.normalized(F.coalesce("text", F.lit(""))) == "", "no text")
        .when(size == "reject", "too long")
        .when(lint == "reject", "order")
        .when(F.col("_same"), "same")
        .when(F.col("_like"), "alike")
        .when(size == "warn", "long")
        .when(lint == "warn", "action")
        .when(T.task_word(F.col("text")).isNotNull(), "task")
    )
    verdict = F.when(reason.isin("no node", "no text", "too long", "order", "same"), "reject").when(reason.isNotNull(), "warn").otherwise("ok")
    return got.select(*new.columns, verdict.alias("verdict"), reason.alias("reason"))


def redacted(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with credentials out of the named text columns, arrays of text included, and of no others; ``redactions`` counts them."""
    n, out = F.lit(0), {}
    for c in columns:
        if df.schema[c].dataType.typeName() == "array":
            r = F.transform(c, T.redaction)
            out[c] = F.transform(r, lambda x: x["text"])
            n = n + F.coalesce(F.aggregate(F.transform(r, lambda x: x["count"]), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))
        else:
            r = T.redaction(F.col(c))
            out[c] = r["text"]
            n = n + r["count"]
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns], n.cast("long").alias("redactions"))


def refuted(entries: DataFrame, nodes: DataFrame, which: DataFrame, change: str) -> DataFrame:
    """Effects of refuting entries (``which``: entry_id): ``entry_id, before, after``.

    They become refuted by the change; all active entries that rest on them, directly or not, and aren't suspect yet become so.
    """
    down = graph.dependents(graph.entry_edges(entries, nodes, "based_on"), which).select("entry_id").distinct().join(which.select("entry_id"), "entry_id", "left_anti")
    e = entries.select("entry_id", "confidence", "active")
    own = e.join(which.select("entry_id").distinct(), "entry_id", "left_semi").where("coalesce(confidence, '') <> 'refuted'").select("entry_id", F.struct("confidence", F.lit(None).cast("string").alias("refuted_by")).alias("before"), F.struct(F.lit("refuted").alias("confidence"), F.lit(change).alias("refuted_by")).alias("after"))
    fall = e.where("active AND coalesce(confidence, '') <> 'suspect'").join(down, "entry_id", "left_semi").select("entry_id", F.struct("confidence", F.lit(None).cast("string").alias("refuted_by")).alias("before"), F.struct(F.lit("suspect").alias("confidence"), F.lit(None).cast("string").alias("refuted_by")).alias("after"))
    return own.unionByName(fall)


def confirmed(entries: DataFrame, which: DataFrame, now: Column) -> DataFrame:
    """Entries that were confirmed: verified from now on (derived ones stay derived); refuted ones are left out."""
    hit = entries.join(which.select("entry_id").distinct(), "entry_id", "left_semi").where("coalesce(confidence, '') <> 'refuted'")
    return hit.withColumn("confidence", F.when(F.col("confidence") == "derived", "derived").otherwise("verified")).withColumn("confirmed_at", now)


class RevertConflict(ValueError):
    """An entry's state is neither what a change made of it nor what it was before."""


def reverted(effects: DataFrame, entries: DataFrame, columns: list[str]) -> DataFrame:
    """The effects (``entry_id, before, after``) that undo ``effects``: entries that are as the change left them go back.

    Entries that are as before already give no row; any other state raises.
    """
    now = entries.select("entry_id", F.struct(*columns).alias("_now"))
    got = effects.join(now, "entry_id", "left")
    odd = got.where(~F.equal_null("_now", "after") & ~F.equal_null("_now", "before")).take(1)
    if odd:
        raise RevertConflict(f"{odd[0]['entry_id']} has changed since")
    return got.where(F.equal_null("_now", "after") & ~F.equal_null("before", "after")).select("entry_id", F.col("after").alias("before"), F.col("before").alias("after"))


def overturned_in_scope(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, overturns, shared``: whether a change that overturns another one shares a node with it, by present or former ids."""
    n = nodes.select("node_id", "lineage")
    refs = changes.where("overturns IS NOT NULL").select("id", "overturns", F.explode("nodes").alias("ref")).where("ref IS NOT NULL").distinct()
    own = resolve_now(refs, nodes).select("id", "overturns", "node_id").distinct()
    scope = own.join(n, "node_id").select("id", "overturns", F.explode(F.array_union(F.array("node_id"), "lineage")).alias("_x")).distinct()
    t = changes.select(F.col("id").alias("overturns"), F.explode("nodes").alias("ref")).where("ref IS NOT NULL").distinct()
    means = t.select("overturns", F.col("ref").alias("_x")).unionByName(resolve_now(t, nodes).select("overturns", F.col("node_id").alias("_x"))).distinct()
    hit = scope.join(means, ["overturns", "_x"], "left_semi").select("id").distinct().withColumn("shared", F.lit(True))
    return changes.where("overturns IS NOT NULL").select("id", "overturns").join(hit, "id", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def claimed(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Nodes after orphans were claimed (``moves``: node_id, successor): a successor gets the orphan's id and its former ids into its
    lineage, the orphan goes. Several orphans may have one successor."""
    gone = moves.select("node_id", "successor").distinct()
    passed = gone.join(nodes.select("node_id", "lineage"), "node_id").select("successor", F.array_union(F.array("node_id"), "lineage").alias("_l"))
    more = passed.groupBy(F.col("successor").alias("node_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_l")))).alias("_more"))
    left = nodes.join(gone.select("node_id"), "node_id", "left_anti").join(more, "node_id", "left")
    return left.withColumn("lineage", F.array_union("lineage", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more").select(*nodes.columns)


def moved_entries(entries: DataFrame, moves: DataFrame, targets: DataFrame) -> DataFrame:
    """Entries of nodes that were moved, split or merged: each goes to its own target (``targets``: entry_id, node_id) or to its node's
    only successor (``moves``), with a confidence one step lower; without either it stays."""
    one = moves.select("node_id", "successor").distinct()
    one = one.join(one.groupBy("node_id").agg(F.count("*").alias("_k")).where("_k = 1").select("node_id"), "node_id", "left_semi")
    got = entries.join(one, "node_id", "left").join(targets.select("entry_id", F.col("node_id").alias("_own")), "entry_id", "left")
    to = F.coalesce("_own", "successor")
    return got.withColumn("confidence", F.when(to.isNotNull(), V.demoted(F.col("confidence"))).otherwise(F.col("confidence"))).withColumn("node_id", F.coalesce(to, "node_id")).select(*entries.columns)


def reverified(nodes: DataFrame, which: DataFrame, now: Column) -> DataFrame:
    """Nodes read again and found right: suspect ones are fresh, all begin anew in time (``since``)."""
    hit = which.select("node_id", F.lit(True).alias("_hit")).distinct()
    got = nodes.join(hit, "node_id", "left")
    return got.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "suspect"), "fresh").otherwise(F.col("status"))).withColumn("since", F.when(F.col("_hit"), now).otherwise(F.col("since"))).select(*nodes.columns)


def step_problems(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``flow, position, ref`` of steps (``flow, position, ref``) that name no node and no former one."""
    known = nodes.select(F.col("node_id").alias("ref")).unionByName(heirs(nodes).select(F.col("former").alias("ref"))).distinct()
    return steps.join(known, "ref", "left_anti").select("flow", "position", "ref")


def job_id(question: str) -> str:
    """The id of an investigation, from its question."""
    return "job_" + hashlib.sha256(question.encode()).hexdigest()[:12]


def submitted(findings: DataFrame, jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Findings whose job (``job, begun``) is there and no older than ``minutes``."""
    live = jobs.where(F.unix_timestamp(now) - F.unix_timestamp("begun") <= minutes * 60).select("job").distinct()
    return findings.join(live, "job", "left_semi")


def mass_suspect(actions: DataFrame) -> DataFrame:
    """One row of a reconciliation (``action``): nodes, suspects, and whether more than half of all nodes became suspect."""
    n = actions.agg(F.count_if(~F.col("action").isin("drop", "orphan")).alias("nodes"), F.count_if(F.col("action") == "suspect").alias("suspects"))
    return n.withColumn("mass", (F.col("nodes") > 0) & (F.col("suspects") * 2 > F.col("nodes")))
