"""Health of what is derived: quarantine, staleness, fingerprints, vector indexes and what they would need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes that an index may need in memory.
MOST_BYTES = 2**30


def safe_id(node: Column) -> Column:
    """Whether a node's path stays inside the repository: relative, forward slashes, no drive, no empty, ``.`` or ``..`` step."""
    file = F.substring_index(node, "#", 1)
    path = F.regexp_replace(file, "/$", "")
    steps = F.split(path, "/")
    bad = (path == "") | path.startswith("/") | F.contains(path, F.lit("\\")) | F.contains(path, F.lit("\0")) | path.rlike("^.:") | F.exists(steps, lambda s: s.isin("", ".", ".."))
    return F.coalesce((file == ".") | ~bad, F.lit(False))


def quarantined(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose id is safe and occurs once; and of all others ``node_id, copies, reason`` (unsafe, twice). Equal rows count once.

    A twice-told node is left out with all its copies, as none is better than another.
    """
    rows = nodes.distinct()
    n = rows.groupBy("node_id").agg(F.count("*").alias("copies"))
    why = F.when(~safe_id(F.col("node_id")), "unsafe").when(F.col("copies") > 1, "twice")
    bad = n.withColumn("reason", why).where("reason IS NOT NULL")
    return rows.join(bad.select("node_id"), "node_id", "left_anti"), bad


def stale_reads(reads: DataFrame, current: DataFrame) -> DataFrame:
    """``session, node_id`` of nodes that have changed since a session last read them.

    ``reads``: ``session, node_id, hash, at``, of which the last counts; ``current``: ``node_id, hash``. Unknown hashes never differ.
    """
    last = reads.groupBy("session", "node_id").agg(F.max_by("hash", F.struct("at", "hash")).alias("_h"))
    return last.join(current.select("node_id", "hash"), "node_id").where("_h <> '' AND hash <> '' AND _h <> hash").select("session", "node_id")


def stale_nodes(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``node_id, state``: anchored nodes (``node_id, hash``) against the source's symbols (``node_id, hash``): missing or changed."""
    got = nodes.where("hash IS NOT NULL AND hash <> ''").select("node_id", F.col("hash").alias("_h")).join(symbols.select("node_id", F.col("hash").alias("_s")), "node_id", "left")
    return got.select("node_id", F.when(F.col("_s").isNull(), "missing").when(F.col("_s") != F.col("_h"), "changed").alias("state")).where("state IS NOT NULL")


def framed(*fields: Column) -> Column:
    """The fields as bytes, each after its length, so that no two rows of fields are alike."""
    part = lambda c: F.concat(F.lpad(F.hex(F.octet_length(c)), 8, "0").cast("binary"), c.cast("binary"))
    return F.concat(*[part(F.coalesce(f.cast("string"), F.lit(""))) for f in fields])


def fingerprint(rows: DataFrame, columns: list[str], parts: int = 256) -> DataFrame:
    """One row: ``records`` and a SHA-256 over all rows, whatever order they come in.

    Each row has the hash of its framed fields; rows are ordered by it within ``parts`` ranges of the hash, each range has the
    hash of its rows' hashes, and the whole that of the ranges in order. So no task ever holds more than one range.
    """
    h = rows.select(F.sha2(framed(*[F.col(c) for c in columns]), 256).alias("_h")).withColumn("_p", F.substring("_h", 1, 2))
    per = h.groupBy("_p").agg(F.count("*").alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_d"))
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("records"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"]), ""), 256).alias("fingerprint"))


def reuse_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, action`` (reuse, embed, drop) to bring an index from ``old`` to ``new`` records (``id, node_id, lane, hash``).

    A vector is taken over only if nothing of its record has changed; all that is new or changed is embedded.
    """
    key = ["id", "node_id", "lane", "hash"]
    o, n = old.select(*key).distinct(), new.select(*key).distinct()
    same = n.join(o, key, "left_semi").select("id", F.lit("reuse").alias("action"))
    fresh = n.join(o, key, "left_anti").select("id", F.lit("embed").alias("action"))
    gone = o.join(n.select("id"), "id", "left_anti").select("id", F.lit("drop").alias("action"))
    return same.unionByName(fresh).unionByName(gone).distinct()


def index_health(old: DataFrame, new: DataFrame, settings: dict, stored: dict | None) -> str:
    """The state of a vector index: unconfigured, disabled, configured-no-index, corrupt, stale-provider, stale-source, partial or ready.

    ``settings``: what is wanted (``enabled, model, size``; empty if never set); ``stored``: what the index says of itself (``model,
    size, records``), None without one. The first that holds is the state: an index whose count isn't that of its records is
    corrupt; one of another model or size can't be asked; one that has nothing of what is current is stale, one that has some of
    it partial.
    """
    if not settings:
        return "unconfigured"
    if not settings.get("enabled"):
        return "disabled"
    if stored is None:
        return "configured-no-index"
    plan = {r["action"]: r["n"] for r in reuse_plan(old, new).groupBy("action").agg(F.count("*").alias("n")).collect()}
    if stored.get("records") != old.select("id").distinct().count():
        return "corrupt"
    if (stored.get("model"), stored.get("size")) != (settings.get("model"), settings.get("size")):
        return "stale-provider"
    if not plan.get("embed") and not plan.get("drop"):
        return "ready"
    return "partial" if plan.get("reuse") else "stale-source"


def index_size(vectors: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """One row: ``records, bytes, fits``: what an index needs in memory, ids and vectors, summed without overflow."""
    b = vectors.agg(F.count("*").alias("records"), F.coalesce(F.sum((F.octet_length("id") + 4 * F.greatest(F.size("vec"), F.lit(0))).cast("decimal(38,0)")), F.lit(0)).alias("_b"))
    return b.select("records", F.col("_b").cast("decimal(38,0)").alias("bytes"), (F.col("_b") <= most).alias("fits"))


def patrol(clusters: DataFrame, members: DataFrame, entries: DataFrame, most_clusters: int = 5, most_entries: int = 30, per_node: int = 3) -> DataFrame:
    """``keyword, node_id, entry_id, place``: what a patrol reads, the greatest clusters (``keyword, entries``) first.

    Of each node of a cluster (``members``: keyword, node_id) the first ``per_node`` active entries, ``most_entries`` of all
    together. These are a page for a reader, cut before anything is put in order over all.
    """
    top = clusters.orderBy(F.desc("entries"), "keyword").limit(most_clusters).withColumn("_c", F.row_number().over(W.orderBy(F.desc("entries"), "keyword"))).select("keyword", "_c")
    e = entries.where("active").withColumn("_r", F.row_number().over(W.partitionBy("node_id").orderBy("entry_id"))).where(F.col("_r") <= per_node).select("node_id", "entry_id", "_r")
    page = members.join(top, "keyword").join(e, "node_id").orderBy("_c", "node_id", "_r").limit(most_entries)
    return page.withColumn("place", F.row_number().over(W.orderBy("_c", "node_id", "_r"))).select("keyword", "node_id", "entry_id", "place")


#: The order in which kinds of debts are best seen to (fixed values).
ROUTE = ["suspect-reverify", "dispute-open", "cross-dup", "dup-entries", "confidence-lag", "summary-stale", "era-compress", "review-overdue"]


def plan_lines(debts: DataFrame, k: int = 8) -> DataFrame:
    """``part, place, line``: how many debts there are of each kind, in the order in which they are best seen to, and the first ``k``."""
    rank = F.array_position(F.array(*map(F.lit, ROUTE)), F.col("kind"))
    kinds = debts.groupBy("kind").agg(F.count("*").alias("_n")).select(F.lit("kind").alias("part"), rank.cast("int").alias("place"), F.concat("kind", F.lit(": "), F.col("_n").cast("string")).alias("line"))
    first = debts.orderBy("debt").limit(k).withColumn("place", F.row_number().over(W.orderBy("debt"))).select(F.lit("next").alias("part"), "place", F.concat("debt", F.lit(" ["), "kind", F.lit("] "), "node_id").alias("line"))
    return kinds.unionByName(first)
