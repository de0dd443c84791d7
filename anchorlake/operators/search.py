"""Lexical search over nodes: exact tokens, trigrams where they find too little, fusion with other rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anchorlake.functions import text as T

#: Ranks of levels among equal scores, weight of an exact token, exact hits below which trigrams count, constant of rank fusion.
LEVELS = {"function": 0, "decl": 0, "file": 1, "stmt": 2, "dir": 3}
EXACT, FEW, RRF = 2, 3, 60


def level_rank(level: Column) -> Column:
    out = F.lit(4)
    for name, rank in LEVELS.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def lanes(entries: DataFrame, nodes: DataFrame, disputed: DataFrame) -> DataFrame:
    """Active entries of nodes that aren't orphaned, each with its ``lane``.

    risk: a pitfall, a suspect node, a suspect entry, or either side of an open dispute (``disputed``: entry_id); else current.
    """
    e = entries.where("active").join(nodes.where("status <> 'orphaned'").select("node_id", "status"), "node_id").join(disputed.select("entry_id", F.lit(True).alias("_open")).distinct(), "entry_id", "left")
    risk = (F.col("kind") == "pitfall") | (F.col("status") == "suspect") | (F.col("confidence") == "suspect") | F.col("_open")
    return e.withColumn("lane", F.when(F.coalesce(risk, F.lit(False)), "risk").otherwise("current")).drop("_open", "status")


def postings(nodes: DataFrame, laned: DataFrame) -> DataFrame:
    """``lane, token, node_id``, each once: path segments, symbol parts and keywords (always current), bodies by lane."""
    path = F.flatten(F.transform(F.split(F.coalesce("file", F.lit("")), "/"), T.tokens))
    words = F.flatten(F.transform("keywords", T.tokens))
    nav = nodes.select("node_id", F.lit("current").alias("lane"), F.explode(F.array_distinct(F.concat(path, T.ident_parts(F.coalesce("symbol", F.lit(""))), words))).alias("token"))
    body = laned.select("node_id", "lane", F.explode(T.tokens(F.col("text"))).alias("token"))
    return nav.unionByName(body).where(F.col("token").isNotNull() & (F.col("token") != "")).select("lane", "token", "node_id").distinct()


def search(post: DataFrame, nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best ``limit`` nodes: ``node_id, score, place``.

    Two points for each distinct query token that a node has. If all tokens together have fewer than three postings, each
    occurrence of a trigram of the query in a node's tokens gives one more point. Order: score, level, node id. ``post`` is a
    stored index: the query's tokens, a handful, filter its scan, and only if they find too little its tokens are cut into
    trigrams.
    """
    one = post.sparkSession.range(1)
    words = one.select(T.tokens(F.lit(query)).alias("t")).first()["t"]
    post = post.select("token", "node_id")
    hits = post.where(F.col("token").isin(words)).distinct() if words else post.limit(0)
    scores = hits.select("node_id", F.lit(EXACT).alias("points"))
    if hits.limit(FEW).count() < FEW:
        asked = one.select(F.explode(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")).alias("w")).select(F.explode(T.trigrams(F.col("w"))).alias("trigram")).groupBy("trigram").agg(F.count("*").alias("times"))
        # The query's own trigrams: bounded by its length.
        fuzzy = post.select("node_id", F.explode(T.trigrams(F.col("token"))).alias("trigram")).join(F.broadcast(asked), "trigram").select("node_id", "trigram", "times").distinct()
        scores = scores.unionByName(fuzzy.select("node_id", F.col("times").cast("int").alias("points")))
    scored = scores.groupBy("node_id").agg(F.sum("points").alias("score")).join(nodes.select("node_id", level_rank(F.col("level")).alias("_rank")), "node_id")
    top = scored.orderBy(F.desc("score"), "_rank", "node_id").limit(limit)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "_rank", "node_id"))).select("node_id", "score", "place")


def fuse(a: DataFrame, b: DataFrame, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two rankings (``node_id, place``): ``node_id, score, place``; an absent place adds nothing."""
    both = a.select("node_id", F.col("place").alias("_a")).join(b.select("node_id", F.col("place").alias("_b")), "node_id", "full")
    score = F.coalesce(1 / (RRF + F.col("_a")), F.lit(0.0)) + F.coalesce(1 / (RRF + F.col("_b")), F.lit(0.0))
    top = both.select("node_id", score.alias("score")).orderBy(F.desc("score"), "node_id").limit(limit)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "node_id")))


def merge_evidence(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Risk lanes: the better of two places; those that lexical search has first, then node id."""
    both = lexical.select("node_id", F.col("place").alias("_a")).join(semantic.select("node_id", F.col("place").alias("_b")), "node_id", "full")
    return both.select("node_id", F.least("_a", "_b").alias("place"), F.col("_a").isNotNull().alias("lexical"))
