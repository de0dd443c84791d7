"""Debts of the knowledge base and what speaks against committing a file."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.functions import text as T

#: Suspect nodes beyond which one row stands for all; history and tokens beyond which an era is due; days until a review.
MANY_SUSPECTS, ERA_CHANGES, ERA_TOKENS, REVIEW_DAYS = 20, 10, 600, 90


def _debt(df: DataFrame, kind: str, key: Column, node: Column, amount: Column) -> DataFrame:
    return df.select(T.debt_id(key, node).alias("debt"), F.lit(kind).alias("kind"), node.alias("node_id"), amount.cast("long").alias("amount"))


def words() -> Column:
    """How many tokens a change's ``what`` and ``why`` have, by estimate."""
    return T.token_estimate(F.concat(F.coalesce("what", F.lit("")), F.coalesce("why", F.lit(""))))


def debts(nodes: DataFrame, entries: DataFrame, changes: DataFrame | None, history: DataFrame, disputes: DataFrame, within: DataFrame, across: DataFrame, now: Column, era: DataFrame | None = None, dismissed: DataFrame | None = None, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``debt, kind, node_id, amount`` of all eight kinds, by debt.

    ``amount``: how many nodes, changes, late changes, inferred or overdue entries stand behind it, 1 otherwise. ``within`` and
    ``across``: alike entries, ``node_id, a, b`` of one node and ``node_a, a, node_b, b`` of different ones (the first five);
    ``disputes``: open ones as declared (``src, ref``); ``era``: ``node_id, era_until``, up to which changes are folded away;
    ``dismissed``: ids (``debt``) that nobody wants to see. ``changes`` has ``verified``, the evidence of a change, if any, and
    ``what`` and ``why`` or their estimate ``words``; None if ``history`` has ``words`` and ``verified`` of its changes itself.
    ``step`` is given the debts of one or few kinds at a time, such as :func:`~anchorlake.common.keep` to write them.
    A node without a file has no anchor in code.
    """
    node = F.col("node_id")
    suspect = nodes.where("status = 'suspect'").select("node_id")
    n = suspect.agg(F.count("*").alias("_n"))
    # One row: how many there are.
    each = _debt(suspect.join(F.broadcast(n.where(F.col("_n") <= MANY_SUSPECTS)), F.lit(True)), "suspect-reverify", F.lit("suspect"), node, F.lit(1))
    all_ = _debt(n.where(F.col("_n") > MANY_SUSPECTS), "suspect-reverify", F.lit("suspect-mass"), F.lit("."), F.col("_n"))
    open_ = history if era is None else history.join(era, "node_id", "left").where("era_until IS NULL OR at IS NULL OR at > era_until")
    if changes is not None:
        open_ = open_.join(changes.select("id", (F.col("words") if "words" in changes.columns else words()).alias("words")), "id")
    long = open_.groupBy("node_id").agg(F.count("*").alias("_n"), F.sum("words").alias("_s")).where((F.col("_n") > ERA_CHANGES) | (F.col("_s") > ERA_TOKENS))
    told = entries.where("active AND kind = 'summary'").groupBy("node_id").agg(F.max("at").alias("_told")).join(nodes.where("level = 'file'").select("node_id", "file", "since"), "node_id")
    below = history.join(nodes.where("symbol IS NOT NULL").select("node_id", "file"), "node_id").select("file", F.col("at").alias("_at"))
    stale = told.join(below, "file").where(F.coalesce(F.col("_at") > F.greatest("_told", "since"), F.lit(False))).groupBy("node_id").agg(F.count("*").alias("_n"))
    inferred = entries.where("active AND confidence = 'inferred'").groupBy("node_id").agg(F.count("*").alias("_n"))
    seen = history.where("verified IS NOT NULL") if changes is None else history.join(changes.where("verified IS NOT NULL").select("id"), "id", "left_semi")
    proven = seen.select("node_id").distinct()
    lag = inferred.join(nodes.where("status = 'fresh' AND file IS NOT NULL").select("node_id"), "node_id", "left_semi").join(proven, "node_id", "left_semi")
    old = F.col("at").isNull() | (F.col("at") < now - F.expr(f"INTERVAL {REVIEW_DAYS} DAYS"))
    due = entries.where("active").where(old).join(nodes.where("file IS NULL").select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("_n"))
    of = entries.select("entry_id", "node_id")
    argued = disputes.join(of.withColumnRenamed("entry_id", "src"), "src")
    one = F.lit(1)
    parts = [
        [each, all_, _debt(due, "review-overdue", F.lit("review"), node, F.col("_n"))],
        [_debt(long, "era-compress", F.lit("era"), node, F.col("_n"))],
        [_debt(stale, "summary-stale", F.lit("summary"), node, F.col("_n"))],
        [_debt(lag, "confidence-lag", F.lit("conflag"), node, F.col("_n"))],
        [_debt(argued, "dispute-open", F.concat(F.lit("dispute:"), "node_id", F.lit("#"), "src", F.lit(":"), "ref"), node, one)],
        [
            _debt(within, "dup-entries", F.concat(F.lit("dup:"), "a", F.lit(":"), "b"), node, one),
            _debt(across, "cross-dup", F.concat(F.lit("xdup:"), "node_a", F.lit("#"), "a", F.lit(":"), "node_b", F.lit("#"), "b"), F.col("node_a"), one),
        ],
    ]
    gone = None if dismissed is None else dismissed.select("debt").distinct()
    done = []
    for some in parts:
        p = reduce(DataFrame.unionByName, some)
        done.append(step(p if gone is None else p.join(gone, "debt", "left_anti")))
    out = reduce(DataFrame.unionByName, done)
    return out.orderBy("debt")


def next_debt(debts_: DataFrame, scope: str = ".") -> DataFrame:
    """The first debt of a scope, or no row."""
    return in_scope(debts_, scope).orderBy("debt").limit(1)


class EvidenceRequired(ValueError):
    """What is to be done lacks the text or the proof that it needs."""


def complete(debts_: DataFrame, debt: str, history: DataFrame, era_summary: str | None = None, kept: int = 5) -> DataFrame:
    """``debt, state`` and, for an era, ``node_id, era_summary, era_until``: what completing a debt changes.

    A debt whose cause is gone is settled. One of an era needs its summary and folds all but the newest ``kept`` changes; debts of
    other kinds stay open until their cause is gone.
    """
    mine = debts_.where(F.col("debt") == debt).take(1)
    spark = debts_.sparkSession
    shape = "debt string, state string, node_id string, era_summary string, era_until timestamp"
    if not mine:
        return spark.createDataFrame([(debt, "settled", None, None, None)], shape)
    if mine[0]["kind"] != "era-compress":
        return spark.createDataFrame([(debt, "open", mine[0]["node_id"], None, None)], shape)
    if not (era_summary or "").strip():
        raise EvidenceRequired("an era's debt needs its summary")
    h = history.where((F.col("node_id") == mine[0]["node_id"]) & F.col("at").isNotNull())
    newest = h.orderBy(F.desc("at"), F.desc("id")).limit(kept).select("id")
    until = h.join(newest, "id", "left_anti").agg(F.max("at").alias("era_until"))
    return until.select(F.lit(debt).alias("debt"), F.lit("settled").alias("state"), F.lit(mine[0]["node_id"]).alias("node_id"), F.lit(era_summary.strip()).alias("era_summary"), "era_until")


def in_scope(df: DataFrame, scope: str) -> DataFrame:
    """Rows whose ``node_id`` lies in a scope: a symbol, the project ('.'), a directory (ends in '/') or a file with all in it."""
    node = F.col("node_id")
    if scope == ".":
        return df
    if "#" in scope:
        return df.where(node == scope)
    return df.where(node.startswith(scope) if scope.endswith("/") else (node == scope) | node.startswith(scope + "#"))


def precheck(files: DataFrame, nodes: DataFrame, entries: DataFrame, accounted: DataFrame, disputes: DataFrame, rejected: DataFrame, risky: DataFrame) -> DataFrame:
    """``file, severity, kind, node_id`` of what speaks against committing ``files``, what blocks first, then by file and kind.

    A file without nodes gives only ``unindexed-source``. ``accounted``: files that a new change names; ``rejected``: node_id of
    changes in effect that rejected options; ``risky``: node_id and score.
    """
    mine = nodes.join(files.select("file").distinct(), "file", "left_semi")
    unknown = files.join(nodes.select("file").distinct(), "file", "left_anti").select("file", F.lit("block").alias("severity"), F.lit("unindexed-source").alias("kind"), F.lit(None).cast("string").alias("node_id"))
    known = files.join(mine.select("file").distinct(), "file", "left_semi")

    def row(df: DataFrame, severity: str, kind: str) -> DataFrame:
        return df.select("file", F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), "node_id").distinct()

    silent = known.join(accounted, "file", "left_anti").withColumn("node_id", F.lit(None).cast("string"))
    at = mine.select("file", "node_id")
    open_ = disputes.select(F.col("src").alias("entry_id")).unionByName(disputes.select(F.col("dst").alias("entry_id"))).join(entries.select("entry_id", "node_id"), "entry_id").select("node_id").distinct()
    pit = entries.where("active AND kind = 'pitfall'").select("node_id").distinct()
    parts = [
        row(silent, "block", "unaccounted-change"),
        row(mine.where("status IN ('suspect', 'orphaned')"), "block", "stale-knowledge"),
        row(at.join(open_, "node_id"), "block", "open-dispute"),
        row(at.join(rejected.select("node_id").distinct(), "node_id"), "warn", "rejected-alternative"),
        row(at.join(risky.select("node_id"), "node_id"), "warn", "landmine"),
        row(at.join(pit, "node_id"), "warn", "pitfall"),
    ]
    out = unknown
    for p in parts:
        out = out.unionByName(p)
    return out.orderBy("severity", "file", "kind", "node_id")
