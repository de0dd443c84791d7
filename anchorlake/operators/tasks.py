"""Work in progress: its age, where it is shown, who may close it, and what a session leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.operators.resolve import resolve_now
from anchorlake.operators.status import age_label, age_seconds

#: Hours after which a task is idle, and days after which it is stale and others may close it.
IDLE_HOURS, STALE_DAYS = 24, 7
#: Tools that write; all others read (fixed values).
WRITES = ("kb_remember", "kb_record_change", "kb_verify", "kb_revert", "kb_adopt", "kb_flow", "kb_maintain")


def state(updated: Column, now: Column) -> Column:
    """unknown (no time), stale, idle or active."""
    s = age_seconds(updated, now)
    return F.when(updated.isNull(), "unknown").when(s >= STALE_DAYS * 86_400, "stale").when(s >= IDLE_HOURS * 3_600, "idle").otherwise("active")


def label(updated: Column, now: Column) -> Column:
    """What is shown beside a task: nothing while it is active."""
    how = state(updated, now)
    return F.when(how == "unknown", "stale age-unknown").when(how == "active", "").otherwise(F.concat(how, F.lit(" "), age_label(age_seconds(updated, now))))


def labelled(wips: DataFrame, now: Column) -> DataFrame:
    """``owner, task, state, label`` of all tasks; rows without a task aren't work."""
    return wips.where("task IS NOT NULL AND trim(task) <> ''").select("owner", "task", state(F.col("updated"), now).alias("state"), label(F.col("updated"), now).alias("label"))


def counts(wips: DataFrame, now: Column) -> DataFrame:
    """One row: tasks, and how many are idle, stale or of unknown age."""
    s = labelled(wips, now)
    return s.agg(F.count("*").alias("tasks"), *[F.count_if(F.col("state") == x).alias(x) for x in ("idle", "stale", "unknown")])


def attached(wips: DataFrame, nodes: DataFrame, view: DataFrame) -> DataFrame:
    """``owner, task`` of tasks that touch a node in ``view`` (``node_id``), by its present or a former id; each task once."""
    t = wips.select("owner", "task", F.explode("touching").alias("ref")).where("ref IS NOT NULL").distinct()
    seen = view.select("node_id").distinct()
    direct = t.join(seen.withColumnRenamed("node_id", "ref"), "ref", "left_semi").select("owner", "task")
    return direct.unionByName(resolve_now(t, nodes).join(seen, "node_id", "left_semi").select("owner", "task")).distinct()


def closable(wips: DataFrame, session: str, now: Column) -> DataFrame:
    """Tasks that a session may close: its own, and others' that are known to be stale."""
    s = state(F.col("updated"), now)
    return wips.where((F.col("owner") == session) | (s == "stale"))


def archived(wips: DataFrame, owner: str, outcome: str, now: Column) -> DataFrame:
    """The change that a finished or given-up task leaves behind: ``nodes, at, task, what, why, author``."""
    mine = wips.where(F.col("owner") == owner)
    return mine.select(F.col("touching").alias("nodes"), now.alias("at"), "task", F.concat(F.lit(f"{outcome}: "), "task").alias("what"), F.concat_ws("; ", "intent", F.array_join(F.coalesce("done", F.array().cast("array<string>")), ", ")).alias("why"), F.col("owner").alias("author"))


def session_gate(usage: DataFrame, wips: DataFrame) -> DataFrame:
    """``session, failed, read_only, unrecorded, suspect, open_tasks``: what each session leaves behind.

    Failed calls; whether it read and wrote nothing; whether it recorded no change; how often it read suspect knowledge; tasks
    whose owner ends in ``@session``.
    """
    write = F.col("tool").isin(*WRITES)
    s = usage.where("session IS NOT NULL").groupBy("session").agg(
        F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"),
        ((F.count_if(~write) > 0) & (F.count_if(write) == 0)).alias("read_only"),
        (F.count_if((F.col("tool") == "kb_record_change") & F.col("ok")) == 0).alias("unrecorded"),
        F.count_if(~write & F.col("hit") & (F.col("hitStatus") == "suspect")).alias("suspect"),
    )
    open_ = wips.where("contains(owner, '@')").groupBy(F.substring_index("owner", "@", -1).alias("session")).agg(F.count("*").alias("open_tasks"))
    return s.join(open_, "session", "left").withColumn("open_tasks", F.coalesce("open_tasks", F.lit(0)))


def usage_totals(usage: DataFrame) -> DataFrame:
    """One row: recalls, hits, percent of hits, hits on bare skeletons, stale reads, writes, changes, prechecks, their warnings and
    blocks, and whether fewer changes were recorded than stale reads found (``unrecorded``)."""
    is_ = lambda t: F.col("tool") == t
    ok = F.coalesce("ok", F.lit(False))
    u = usage.agg(
        F.count_if(is_("kb_recall")).alias("recalls"),
        F.count_if(is_("kb_recall") & F.col("hit")).alias("hits"),
        F.count_if(is_("kb_recall") & (F.col("hitStatus") == "undigested")).alias("undigested"),
        F.count_if(is_("kb_recall") & (F.col("stale") > 0)).alias("stale"),
        F.count_if(is_("kb_remember") & ok).alias("remembers"),
        F.count_if(is_("kb_record_change") & ok).alias("changes"),
        F.count_if(is_("cli_precheck")).alias("prechecks"),
        F.coalesce(F.sum(F.when(is_("cli_precheck"), F.col("warnings"))), F.lit(0)).alias("warnings"),
        F.count_if(is_("cli_precheck") & F.col("blocked")).alias("blocked"),
    )
    hit = F.when(F.col("recalls") == 0, F.lit(0)).otherwise(F.floor(F.col("hits") * 100 / F.col("recalls"))).cast("long")
    return u.withColumn("percent", hit).withColumn("unrecorded", (F.col("stale") > 0) & (F.col("changes") < F.col("stale")))
