"""One recall over all ways to find knowledge: exact ids, lineage, loose names, words, vectors, structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anchorlake.common import keep
from anchorlake.functions import text as T
from anchorlake.operators import graph, search, similarity
from anchorlake.operators.resolve import heirs

#: Results and their bound; of words so many are ranked; vectors below this cosine don't count; suggestions and folders shown.
LIMIT, MOST, LEAST_WORDS, LEAST_COSINE, SUGGESTED, FOLDERS = 5, 100, 20, 0.35, 5, 12


def resolve_query(nodes: DataFrame, query: str) -> DataFrame:
    """``node_id, how`` of what a query names: the node of that id (exact), else its heirs (lineage), else symbols like it (loose).

    A query with ``#`` is loose within the file before it, one without blanks and slashes in all files. Several rows mean that
    the query isn't clear; none that it names nothing.
    """
    q = query.strip()
    exact = nodes.where(F.col("node_id") == q).select("node_id", F.lit("exact").alias("how"))
    heir = heirs(nodes).where(F.col("former") == q).select(F.col("heir").alias("node_id"), F.lit("lineage").alias("how")).distinct()
    ways = [exact, heir]
    file, _, symbol = q.partition("#")
    if "#" in q or (q and not any(c in q for c in " \t/")):
        want = (symbol if "#" in q else q).translate(str.maketrans("", "", "()*"))
        bare = F.regexp_replace("symbol", r"[()*]", "")
        like = (bare == want) | (F.substring_index(bare, ".", -1) == want) | (bare == want.rsplit(".", 1)[-1])
        ways.append(nodes.where(like & ((F.col("file") == file) if "#" in q else F.lit(True))).select("node_id", F.lit("loose").alias("how")))
    rank = F.when(F.col("how") == "exact", 0).when(F.col("how") == "lineage", 1).otherwise(2)
    out = ways[0]
    for w in ways[1:]:
        out = out.unionByName(w)
    return out.withColumn("_b", F.min(rank).over(W.partitionBy(F.lit(0)))).where(rank == F.col("_b")).select("node_id", "how")


def current_records(vectors: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records (``id, node_id, lane, hash``) that the manifest has just so; others are out of date or damaged."""
    key = ["id", "node_id", "lane", "hash"]
    return vectors.join(manifest.select(*key).distinct(), key, "left_semi")


def vector_lanes(vectors: DataFrame, manifest: DataFrame, query: list[float], k: int) -> DataFrame:
    """``lane, node_id, place`` of the k nearest nodes of each lane.

    Records that aren't current are dropped before nodes compete, too small a cosine after they are ranked; places are then
    without gaps.
    """
    best = similarity.top_k_distinct(similarity.scored(current_records(vectors, manifest), query), k, ["lane", "node_id"])
    place = F.row_number().over(W.partitionBy("lane").orderBy("place"))
    return best.where(F.col("score") >= LEAST_COSINE).withColumn("place", place).select("lane", "node_id", "place")


def recall(nodes: DataFrame, postings: DataFrame, vectors: DataFrame, manifest: DataFrame, edges: list[tuple[str, DataFrame]], informed: DataFrame, query: str, vector: list[float], limit: int = LIMIT) -> DataFrame:
    """``lane, node_id, place, score``: what a free text recalls.

    current: words and vectors fused by reciprocal ranks; risk: the better place of both, those that words have first; history:
    by vectors alone; near: one step along the ``edges`` from what current holds. Each lane has at most ``limit`` rows.
    """
    limit = min(limit if limit > 0 else LIMIT, MOST)
    words = min(MOST, max(LEAST_WORDS, 4 * limit))
    by_vector = keep(vector_lanes(vectors, manifest, vector, words))
    of = lambda lane: by_vector.where(F.col("lane") == lane).select("node_id", "place")
    current = keep(search.fuse(search.search(postings.where("lane = 'current'"), nodes, query, words), of("current"), limit))
    risk = search.merge_evidence(search.search(postings.where("lane = 'risk'"), nodes, query, words), of("risk"))
    first = W.orderBy("place", F.desc("lexical"), "node_id")
    risk = risk.orderBy("place", F.desc("lexical"), "node_id").limit(limit).withColumn("place", F.row_number().over(first))
    near = graph.neighbours(edges, current, informed, limit).withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "node_id")))
    lane = lambda df, name, score: df.select(F.lit(name).alias("lane"), "node_id", "place", score.cast("double").alias("score"))
    none = F.lit(None)
    parts = [lane(current, "current", F.col("score")), lane(risk, "risk", none), lane(of("history").where(F.col("place") <= limit), "history", none), lane(near, "near", F.col("score"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nothing_found(nodes: DataFrame, query: str) -> DataFrame:
    """``kind, shown`` where a query finds nothing: symbols that contain it, closest in length first, and the first folders."""
    q = query.lower()
    sym = nodes.where(F.contains(F.lower("symbol"), F.lit(q))).orderBy(F.abs(F.length("symbol") - len(q)), "node_id").limit(SUGGESTED)
    folder = F.when(F.contains("file", F.lit("/")), F.regexp_extract("file", r"^(.*)/", 1)).otherwise(F.lit("."))
    dirs = nodes.where("level = 'file' AND file IS NOT NULL").select(folder.alias("shown")).distinct().orderBy("shown").limit(FOLDERS)
    return sym.select(F.lit("symbol").alias("kind"), F.col("node_id").alias("shown")).unionByName(dirs.select(F.lit("folder").alias("kind"), "shown"))


def file_suggestions(nodes: DataFrame, wanted: str, k: int = SUGGESTED) -> DataFrame:
    """File nodes like a wanted path: equal, then by the name after the last slash, then by beginning, then by part; then closest in
    length, then id. Letter case doesn't count; one may be the beginning or a part of the other."""
    q = wanted.lower()
    base = q.rsplit("/", 1)[-1]
    low, own = F.lower("node_id"), F.lower(F.substring_index("node_id", "/", -1))
    begins = lambda a, b: a.startswith(b) | F.startswith(F.lit(b), a)
    holds = lambda a, b: F.contains(a, F.lit(b)) | F.contains(F.lit(b), a)
    rank = F.when(low == q, 0).when(own == base, 1).when(begins(low, q) | begins(own, base), 2).when(holds(low, q) | holds(own, base), 3).otherwise(4)
    got = nodes.where("level = 'file'").select("node_id", rank.alias("rank"), F.abs(F.length("node_id") - len(q)).alias("off"))
    return got.orderBy("rank", "off", "node_id").limit(k).select("node_id", "rank")


def diagnose(found: DataFrame, laned: DataFrame, flows: DataFrame, rejected: DataFrame, symptom: str, k: int = 8) -> DataFrame:
    """``kind, id, weight`` for a symptom: the k nodes with most pitfalls among what words found, flows whose title or what to do in
    trouble shares two grams with it, and the newest five options that were rejected and share two grams."""
    pit = laned.where("kind = 'pitfall'").groupBy("node_id").agg(F.count("*").alias("pitfalls"))
    node = found.join(pit, "node_id", "left").select("node_id", F.coalesce("pitfalls", F.lit(0)).alias("weight"), "score").orderBy(F.desc("weight"), F.desc("score"), "node_id").limit(k)
    asked = T.grams(F.lit(symptom))
    shares = lambda c: F.size(F.array_intersect(T.grams(F.coalesce(c, F.lit(""))), asked))
    flow = flows.where("NOT deprecated").select("id", shares(F.col("title")).alias("weight")).where("weight >= 2")
    option = rejected.select("id", "at", "option", shares(F.col("option")).alias("weight")).where("weight >= 2").orderBy(F.desc_nulls_last("at"), "id", "option").limit(5)
    row = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"), F.col("weight").cast("long").alias("weight"))
    return row(node, "node", "node_id").unionByName(row(flow, "flow", "id")).unionByName(row(option, "rejected", "id"))
