"""Similarity of entries, rejected options and vectors over the project's tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake.common import filled, keep, table
from anchorlake.operators import similarity
from anchorlake.plans import model as m

#: A query vector: 64 components of alternating sign and falling size.
QUERY = [(-1) ** i / (1 + i % 9) for i in range(64)]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.entries(spark, sf_dir).where("active AND text <> '' AND node_id IS NOT NULL")


def dup_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active entries of one node with alike texts: classes of one gram set by their first entries, further copies with the first."""
    return similarity.within_pairs(*similarity.classes(_texts(spark, sf_dir), "entry_id", ["node_id"]), "node_id", "entry_id")


def dup_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each active entry that has alike ones: the first entry of its class, the class's entries and nodes, and how many classes are linked to it."""
    members, links = similarity.classes(_texts(spark, sf_dir), "entry_id", also=["node_id"])
    size = members.groupBy("class").agg(F.count("*").alias("entries"), F.countDistinct("node_id").alias("nodes"))
    ends = links.select(F.col("class_a").alias("class")).unionByName(links.select(F.col("class_b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    got = members.join(size, "class").join(ends, "class", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return got.where("entries > 1 OR links > 0").select("entry_id", F.col("class").alias("first_entry"), "entries", "nodes", "links")


def dup_cross_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alike classes, by their first entries."""
    return similarity.class_links(_texts(spark, sf_dir), "entry_id")


def cross_first(texts: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    return similarity.first_pairs(texts, "node_id", "entry_id", copies=copies)


def dup_cross_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five pairs of alike entries of different nodes."""
    raw = table(spark, sf_dir, "remember_entries").select("entry_id", "node_id", "text")
    return cross_first(_texts(spark, sf_dir), raw.where("entry_id IS NOT NULL AND node_id IS NOT NULL AND text <> ''"))


def rejected_options(changes: DataFrame) -> DataFrame:
    return changes.select("id", "at", F.explode("rejected").alias("_r")).select("id", "at", filled("_r.option").alias("option"), filled("_r.reason").alias("reason")).where("option IS NOT NULL")


def rejected_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that a change rejected and another change's option repeats."""
    r = keep(rejected_options(m.changes(spark, sf_dir)).select("id", "option"))
    again = r.select(F.concat_ws("|", "id", "option").alias("key"), F.col("id").alias("own"), F.col("option").alias("text")).distinct()
    hit = similarity.collides(again.select("key", "text"), "key", r)
    return hit.where(F.substring_index("key", "|", 1) != F.col("id")).select("key", "id", "option")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "eval_records").select(F.col("record_id").alias("id"), "node_id", F.lower(filled("lane")).alias("lane"), F.lower(filled("expected_lane")).alias("expected"), F.col("vector").alias("vec"))
    return r.where("id IS NOT NULL").distinct()


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten records nearest to a query vector."""
    return similarity.top_k(similarity.scored(_records(spark, sf_dir), QUERY), 10).select("id", F.round("score", 6).alias("score"))


def vector_topk_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest nodes, by their best record."""
    got = similarity.top_k_distinct(similarity.scored(_records(spark, sf_dir).where("node_id IS NOT NULL"), QUERY), 10, ["node_id"])
    return got.select("node_id", "id", F.round("score", 6).alias("score"), "place")


def vector_topk_by_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest nodes of each lane, in one pass over the records."""
    r = _records(spark, sf_dir).where("node_id IS NOT NULL AND lane IS NOT NULL")
    return similarity.top_k_distinct(similarity.scored(r, QUERY), 5, ["lane", "node_id"]).select("lane", "node_id", "id", F.round("score", 6).alias("score"), "place")


def vector_filtered_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, without records in a wrong lane: a node's next record takes the place of one that is filtered; then a least score."""
    r = _records(spark, sf_dir).where("node_id IS NOT NULL AND lane IS NOT NULL AND lane = expected")
    got = similarity.top_k_distinct(similarity.scored(r, QUERY), 5, ["lane", "node_id"]).where("score >= 0.35")
    return got.select("lane", "node_id", "id", F.round("score", 6).alias("score"))


def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vector of each label and the ten best of all labels."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    return similarity.top_k_distinct(similarity.scored(v, QUERY), 10, ["label"]).select("label", "id", F.round("score", 6).alias("score"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose vector isn't of length 1 (within 1e-4), and those that can't be normalised."""
    v = F.col("vec")
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    state = F.when(v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull()), "none").when(F.isnan(square) | (square == float("inf")), "not finite").when(square == 0, "zero").when(F.abs(square - 1) <= 1e-4, "unit").otherwise("other")
    return _records(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("records"))


def vector_reuse_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records an index built from those in their expected lane could take over, and which are new to it."""
    new = _records(spark, sf_dir).withColumn("hash", F.sha2(F.array_join(F.transform("vec", lambda x: F.format_string("%.0f", x.cast("double") * 10000)), ","), 256))
    old = new.where("lane = expected").select("id", "node_id", "lane", "hash").distinct().withColumn("_old", F.lit(True))
    got = new.join(old, ["id", "node_id", "lane", "hash"], "left")
    return got.groupBy(F.coalesce("_old", F.lit(False)).alias("reused")).agg(F.count("*").alias("records"))


_R = f"WITH r AS (SELECT DISTINCT record_id AS id, node_id, {m.sql_word('lane')} AS lane, {m.sql_word('expected_lane')} AS expected, vector AS vec FROM eval_records WHERE record_id IS NOT NULL)"
_Q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in QUERY) + "]"
_S = _R + f", s AS (SELECT *, greatest(-1.0, least(1.0, list_sum(list_transform(range(1, 65), lambda i: vec[i]::DOUBLE * {_Q}[i])) / sqrt(list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform({_Q}, lambda x: x * x))))) AS score FROM r WHERE len(vec) = 64 AND NOT list_bool_or(list_transform(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_sum(list_transform(vec, lambda x: abs(x))) > 0)"
_G = f", g AS (SELECT entry_id, node_id, {m.sql_grams('text')} AS g FROM e WHERE active AND text <> '' AND node_id IS NOT NULL)"
_ALIKE = "least(len(a.g), len(b.g)) * 5 > greatest(len(a.g), len(b.g)) * 4 AND len(list_intersect(a.g, b.g)) * 9 > (len(a.g) + len(b.g)) * 4"
_K = ", k AS (SELECT *, min(entry_id) OVER (PARTITION BY list_sort(g)) AS cls FROM g WHERE len(g) > 0), r1 AS (SELECT * FROM k WHERE cls = entry_id), l AS (SELECT a.cls AS class_a, b.cls AS class_b FROM r1 a JOIN r1 b ON a.cls < b.cls AND " + _ALIKE + ")"
_KW = ", k AS (SELECT *, min(entry_id) OVER (PARTITION BY node_id, list_sort(g)) AS cls FROM g WHERE len(g) > 0), r1 AS (SELECT * FROM k WHERE cls = entry_id)"
_WITHIN = "SELECT a.node_id, a.entry_id AS a, b.entry_id AS b FROM r1 a JOIN r1 b ON a.node_id = b.node_id AND a.entry_id < b.entry_id AND " + _ALIKE + " UNION ALL SELECT node_id, cls, entry_id FROM k WHERE cls <> entry_id"
_FIRST = "SELECT a.node_id AS node_a, a.entry_id AS a, b.node_id AS node_b, b.entry_id AS b FROM g a JOIN g b ON a.node_id < b.node_id AND " + _ALIKE + " ORDER BY 1, 2, 3, 4 LIMIT 5"
REJECTED = f", rj AS (SELECT DISTINCT id, {m.sql_filled('x.option')} AS option FROM (SELECT id, unnest(rejected) AS x FROM c) WHERE {m.sql_filled('x.option')} IS NOT NULL)"
SQL = {
    "dup_within": m.BASE + _G + _KW + _WITHIN,
    "dup_cross": m.BASE + _G + _K + ", z AS (SELECT cls, count(*) AS entries, count(DISTINCT node_id) AS nodes FROM k GROUP BY cls), d AS (SELECT cls, count(*) AS links FROM (SELECT class_a AS cls FROM l UNION ALL SELECT class_b FROM l) GROUP BY cls) SELECT entry_id, cls AS first_entry, entries, nodes, coalesce(links, 0) AS links FROM k JOIN z USING (cls) LEFT JOIN d USING (cls) WHERE entries > 1 OR links > 0",
    "dup_cross_links": m.BASE + _G + _K + "SELECT * FROM l",
    "dup_cross_first": m.BASE + _G + _FIRST,
    "rejected_collision": m.BASE + REJECTED + f", g AS (SELECT id, option, {m.sql_grams('option')} AS g FROM rj) SELECT a.id || '|' || a.option AS key, b.id, min(b.option) AS option FROM g a JOIN g b ON a.id <> b.id AND {_ALIKE} GROUP BY 1, 2",
    "vector_topk": _S + " SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10",
    "vector_topk_distinct": _S + ", o AS (SELECT * FROM s WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY score DESC, id) = 1) SELECT node_id, id, round(score, 6) AS score, row_number() OVER (ORDER BY o.score DESC, id)::INT AS place FROM o QUALIFY place <= 10",
    "vector_topk_by_lane": _S + ", o AS (SELECT * FROM s WHERE node_id IS NOT NULL AND lane IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lane, node_id ORDER BY score DESC, id) = 1) SELECT lane, node_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY lane ORDER BY o.score DESC, id)::INT AS place FROM o QUALIFY place <= 5",
    "vector_filtered_backfill": _S
    + ", o AS (SELECT * FROM s WHERE node_id IS NOT NULL AND lane = expected QUALIFY row_number() OVER (PARTITION BY lane, node_id ORDER BY score DESC, id) = 1), p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY lane ORDER BY score DESC, id) <= 5) SELECT lane, node_id, id, round(score, 6) AS score FROM p WHERE p.score >= 0.35",
    "embedding_topk": f"WITH s AS (SELECT vec_id AS id, label, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * {_Q}[i])) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform({_Q}, lambda x: x * x))) AS score FROM embeddings), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, id) = 1) SELECT label, id, round(score, 6) AS score FROM o ORDER BY o.score DESC, id LIMIT 10",
    "vector_norms": _R
    + ", q AS (SELECT *, list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE)) AS sq FROM r) SELECT CASE WHEN vec IS NULL OR len(vec) = 0 OR list_bool_or(list_transform(vec, lambda x: x IS NULL)) THEN 'none' WHEN isnan(sq) OR isinf(sq) THEN 'not finite' WHEN sq = 0 THEN 'zero' WHEN abs(sq - 1) <= 1e-4 THEN 'unit' ELSE 'other' END AS state, count(*) AS records FROM q GROUP BY 1",
    "vector_reuse_delta": _R + " SELECT vec IS NOT NULL AND node_id IS NOT NULL AND coalesce(lane = expected, false) AS reused, count(*) AS records FROM r GROUP BY 1",
}
SQL = {name: m.quoted(s) for name, s in SQL.items()}
QUERIES = {f.__name__: f for f in (dup_within, dup_cross, dup_cross_links, dup_cross_first, rejected_collision, vector_topk, vector_topk_distinct, vector_topk_by_lane, vector_filtered_backfill, embedding_topk, vector_norms, vector_reuse_delta)}
