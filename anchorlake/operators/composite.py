"""What a reader of the knowledge base is shown: maps, node views, briefs, decisions for a task, evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anchorlake.functions import text as T
from anchorlake.operators import journal, status
from anchorlake.operators.maintenance import in_scope

#: Evidence for a task: rows of a class that are kept, and ranks of classes and lanes.
KEPT = {"exact": 20, "near": 6, "other": 6}


def tree(nodes: DataFrame, entries: DataFrame, depth: int = 2) -> DataFrame:
    """Directories down to a depth with their coverage and the line of each file right below: ``directory, symbols, digested, percent, files``."""
    cover = status.coverage(nodes, entries)
    level = F.when(F.col("directory") == ".", 0).otherwise(F.size(F.split("directory", "/")) - 1)
    files = nodes.where("file IS NOT NULL").select("file").distinct().select(F.when(F.contains("file", F.lit("/")), F.regexp_extract("file", r"^(.*/)", 1)).otherwise(F.lit(".")).alias("directory"))
    n = files.groupBy("directory").agg(F.count("*").alias("files"))
    return cover.where(level <= depth).join(n, "directory", "left").select("directory", "symbols", "digested", "percent", F.coalesce("files", F.lit(0)).alias("files"))


def node_views(nodes: DataFrame, laned: DataFrame, history: DataFrame, disputed: DataFrame, now, days: int = 90) -> DataFrame:
    """Of each node: ``state, entries`` in their order with marks (risk, disputed, overdue), and how many changes there are.

    One aggregate per node over its own entries and changes.
    """
    e = status.importance(laned).join(disputed.withColumn("_o", F.lit(True)), "entry_id", "left")
    marks = F.array_compact(F.array(F.when(F.col("lane") == "risk", "risk"), F.when(F.col("_o"), "disputed"), F.when(F.col("at") < now - F.expr(f"INTERVAL {days} DAYS"), "overdue")))
    line = F.concat(F.col("entry_id"), F.when(F.size(marks) > 0, F.concat(F.lit(" ["), F.array_join(marks, ","), F.lit("]"))).otherwise(F.lit("")))
    told = e.select("node_id", F.struct("place", line.alias("line")).alias("_l")).groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["line"]), "; ").alias("entries"))
    made = history.groupBy("node_id").agg(F.count("*").alias("changes"))
    return nodes.join(told, "node_id", "left").join(made, "node_id", "left").select("node_id", F.col("status").alias("state"), F.coalesce("entries", F.lit("")).alias("entries"), F.coalesce("changes", F.lit(0)).alias("changes"))


def brief(parts: list[tuple[str, int, DataFrame]], budget: int) -> DataFrame:
    """Sections (name, most rows, ``text`` and ``rank`` of rows) one after the other, as far as their estimated tokens fit the budget.

    Each section is cut to its few rows first, so the running total sees a page, not the tables behind it.
    """
    out = None
    for k, (name, most, df) in enumerate(parts):
        top = df.orderBy("rank", "text").limit(most).select(F.lit(k).alias("section_no"), F.lit(name).alias("section"), "rank", "text")
        out = top if out is None else out.unionByName(top)
    w = W.orderBy("section_no", "rank", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    return out.withColumn("spent", F.sum(T.token_estimate(F.col("text"))).over(w)).where(F.col("spent") <= budget).select("section", "text", "spent")


def file_risks(nodes: DataFrame, risky: DataFrame, least: int = 3) -> DataFrame:
    """``file, score``: risky nodes' scores added up per file, from ``least`` on."""
    return risky.join(nodes.select("node_id", "file"), "node_id").groupBy("file").agg(F.sum("score").alias("score")).where(F.col("score") >= least)


def task_evidence(found: DataFrame, near: DataFrame, scope: str, nodes: DataFrame, laned: DataFrame) -> DataFrame:
    """``node_id, entry_id, nearness, lane`` of what bears on a task in a scope, the best of each class.

    exact: in the scope; near: a neighbour of a hit; other: a hit elsewhere. Risks go before current knowledge, then the hit's
    place, then the entry id. Per class only so many rows are kept, which is the feature.
    """
    inside = in_scope(nodes.select("node_id"), scope).withColumn("_in", F.lit(True))
    hits = found.select("node_id", "place").unionByName(near.select("node_id", F.lit(1_000).alias("place"))).groupBy("node_id").agg(F.min("place").alias("place"))
    ids = hits.join(inside, "node_id", "full").withColumn("nearness", F.when(F.col("_in"), "exact").when(F.col("place") == 1_000, "near").otherwise("other"))
    got = laned.select("node_id", "entry_id", "lane").join(ids, "node_id")
    order = [F.when(F.col("lane") == "risk", 0).otherwise(1), F.coalesce("place", F.lit(2_000)), "entry_id"]
    got = got.withColumn("_r", F.row_number().over(W.partitionBy("nearness").orderBy(*order)))
    most = F.when(F.col("nearness") == "exact", KEPT["exact"]).otherwise(KEPT["other"])
    return got.where(F.col("_r") <= most).select("node_id", "entry_id", "nearness", "lane")


def scoped_risks(nodes: DataFrame, entries: DataFrame, disputed: DataFrame, rejected: DataFrame, scope: str) -> DataFrame:
    """``node_id, reason`` of all that speaks for care in a scope: suspect and orphaned nodes, pitfalls, suspect entries, open
    disputes, options rejected by changes in effect (``rejected``: node_id)."""
    n = in_scope(nodes, scope)
    e = entries.where("active").join(n.select("node_id"), "node_id", "left_semi")
    why = lambda df, r: df.select("node_id", F.lit(r).alias("reason"))
    parts = [why(n.where("status = 'suspect'"), "suspect"), why(n.where("status = 'orphaned'"), "orphaned"), why(e.where("kind = 'pitfall'"), "pitfall"), why(e.where("confidence = 'suspect'"), "suspect-entry"), why(e.join(disputed, "entry_id", "left_semi"), "disputed"), why(rejected.join(n.select("node_id"), "node_id", "left_semi"), "rejected")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def known_answers(found: DataFrame, nodes: DataFrame, flows: DataFrame, question: str) -> DataFrame:
    """Where the library already answers a question: flows whose title shares two grams with it, fresh nodes that score at least 2."""
    asked = flows.sparkSession.range(1).select(T.grams(F.lit(question)).alias("_q"))
    # One row: the question's grams.
    f = flows.where("NOT deprecated").join(F.broadcast(asked), F.lit(True)).where(F.size(F.array_intersect(T.grams(F.coalesce("title", F.lit(""))), "_q")) >= 2)
    n = found.where("score >= 2").join(nodes.where("status = 'fresh'").select("node_id"), "node_id", "left_semi")
    return f.select(F.lit("flow").alias("kind"), "id").unionByName(n.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")))


def folded_history(history: DataFrame, era_until: DataFrame, shown: int = 3) -> DataFrame:
    """The newest changes of each node that its era (``node_id, era_until``) doesn't cover, and how many it does."""
    h = history.join(era_until, "node_id", "left").withColumn("_folded", F.coalesce(F.col("at") <= F.col("era_until"), F.lit(False)))
    w = W.partitionBy("node_id")
    h = h.withColumn("folded", F.count_if("_folded").over(w)).where("NOT _folded")
    return journal.recent(h, shown).select("node_id", "id", "place", "folded")


def retrieval_quality(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per lane: cases, recall, mean reciprocal rank, share of hits in the right lane, share of distinct nodes.

    ``hits``: case, lane, node_id, place, expected (lane); ``wanted``: case, lane, node_id.
    """
    w = wanted.distinct().withColumn("_w", F.lit(True))
    got = hits.join(w, ["case", "lane", "node_id"], "left")
    per = got.groupBy("case", "lane").agg(F.count("*").alias("hits"), F.countDistinct("node_id").alias("nodes"), F.count_if(F.col("lane") == F.col("expected")).alias("right"), F.countDistinct(F.when(F.col("_w"), F.col("node_id"))).alias("found"), F.min(F.when(F.col("_w"), F.col("place"))).alias("first"))
    need = w.groupBy("case", "lane").agg(F.count("*").alias("need"))
    case = need.join(per, ["case", "lane"], "left")
    return case.groupBy("lane").agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.coalesce(F.col("found"), F.lit(0)) / F.col("need")), 9).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 9).alias("mrr"),
        F.round(F.try_divide(F.sum("right"), F.sum("hits")), 9).alias("lane_precision"),
        F.round(F.try_divide(F.sum("nodes"), F.sum("hits")), 9).alias("distinct_nodes"),
    )


def signature_echoes(entries: DataFrame, signatures: DataFrame, least: int = 4) -> DataFrame:
    """Entries that say no more than the signature of their node: at least four ASCII tokens, 70 % of them in it."""
    ascii_ = lambda c: F.filter(T.tokens(c), lambda t: ~t.rlike(r"[^\x00-\x7f]"))
    got = entries.where("active").join(signatures, "node_id").withColumn("_t", ascii_(F.col("text"))).withColumn("_s", ascii_(F.col("signature")))
    return got.where((F.size("_t") >= least) & (F.size(F.array_intersect("_t", "_s")) * 10 >= F.size("_t") * 7)).select("entry_id")


def suggestions(nodes: DataFrame, wanted: str, k: int = 5) -> DataFrame:
    """Symbols like a wanted one: equal but for case, then by prefix, then by part; closest in length, then id."""
    s, w = F.lower("symbol"), wanted.lower()
    rank = F.when(s == w, 0).when(F.lower(F.substring_index("symbol", ".", -1)) == w, 1).when(s.startswith(w), 2).when(F.contains(s, F.lit(w)), 3)
    got = nodes.select("node_id", "symbol", rank.alias("rank"), F.abs(F.length("symbol") - len(wanted)).alias("off")).where("rank IS NOT NULL")
    return got.orderBy("rank", "off", "node_id").limit(k)
