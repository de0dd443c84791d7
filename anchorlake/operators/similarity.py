"""Exact similarity joins of gram sets, and exact nearest vectors of a query."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anchorlake.common import keep, release
from anchorlake.functions import text as T

#: Two sets are alike if 9 * both > 4 * (a + b), which is a Jaccard coefficient above 0.8 in integers.
BOTH, SIDES = 9, 4
#: Buckets of hashes by which it is counted how rare grams are. Bears on time alone.
BUCKETS = 16_384
#: First texts with which :func:`first_pairs` begins, and texts alike to them beyond which it compares all. Bear on time and disk alone.
FIRST, NEAR = 256, 10_000
#: Candidates up to which their ids are broadcast to pick their texts. Bears on time and disk alone.
SENT = 250_000


def alike(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) * BOTH > (F.size(a) + F.size(b)) * SIDES


def sized(a: Column, b: Column) -> Column:
    """What sizes must be for sets to be alike: the smaller above 4/5 of the greater."""
    return F.least(F.size(a), F.size(b)) * 5 > F.greatest(F.size(a), F.size(b)) * 4


def gram_sets(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and ``grams`` of texts that have any."""
    return texts.select(key, T.grams(F.col(text)).alias("grams")).where(F.size("grams") > 0)


def ranks(tokens: DataFrame) -> bytes:
    """One byte per bucket of token hashes (column ``_t``, arrays): how often the bucket is met, on a logarithmic scale.

    It puts rare grams first. Any order finds all alike sets, so buckets that several grams share cost time alone.
    """
    out = bytearray(BUCKETS)
    met = tokens.select(F.explode("_t").alias("_t")).groupBy(F.pmod("_t", F.lit(BUCKETS)).alias("_b")).agg(F.count("*").alias("_n"))
    for b, n in met.collect():
        out[b] = min(255, int(8 * math.log2(n)))
    return bytes(out)


def _heads(sets: DataFrame, rank: bytes) -> DataFrame:
    """Size, bits and rare grams of ``sets`` (``_id, _t``: hashes of a set's grams)."""
    rank = F.lit(rank)
    ordered = F.sort_array(F.transform("_t", lambda t: F.struct(F.substring(rank, F.pmod(t, F.lit(BUCKETS)) + 1, F.lit(1)).alias("r"), t.alias("t"))))
    flip = lambda odd: F.aggregate("_t", F.lit(0).cast("long"), lambda s, t: F.when(t.bitwiseAND(64) == odd, s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63)))).otherwise(s))
    n = F.size("_t")
    return sets.select("_id", n.alias("_n"), flip(0).alias("_x"), flip(64).alias("_y"), F.slice(ordered, F.lit(1), F.ceil(n / 5).cast("int"))["t"].alias("_p"))


def heads(sets: DataFrame) -> DataFrame:
    """What :func:`candidates` compares of ``sets``, each rare gram ranked by all of them."""
    return keep(_heads(sets, ranks(sets)))


def candidates(whole: DataFrame) -> DataFrame:
    """``_a, _b, _both`` (ids, each pair once, and the sizes' sum) among which are all pairs of ``whole`` (:func:`heads`) that are alike.

    In an order by rarity, a set's alike ones of at most its own size have one of their ceil(n / 9) first grams among its own
    ceil(n / 5) first ones. Grams in just one of two sets are less than a ninth of both sizes if they are alike; two words of bits,
    one flipped per gram, differ in no more bits than that. Sizes and bits travel with the grams, so the join itself drops what
    can't be alike and no pair but those left is written. Hashes that collide only let more pairs through.
    """
    p = whole.select("_id", "_n", "_x", "_y", F.posexplode("_p").alias("_i", "_t"))
    a, b = (p.select("_t", *[F.col(c).alias(c + side) for c in ("_id", "_n", "_i", "_x", "_y")]) for side in "ab")
    differ = F.bit_count(F.col("_xa").bitwiseXOR(F.col("_xb"))) + F.bit_count(F.col("_ya").bitwiseXOR(F.col("_yb")))
    smaller = (F.col("_na") > F.col("_nb")) | ((F.col("_na") == F.col("_nb")) & (F.col("_ida") < F.col("_idb")))
    both = F.col("_na") + F.col("_nb")
    near = (F.col("_ib") * 9 < F.col("_nb")) & (F.least(F.col("_na") - F.col("_ia"), F.col("_nb") - F.col("_ib")) * BOTH > both * SIDES) & (differ * 9 < both)
    return a.join(b, "_t").where(smaller & near).select(F.col("_ida").alias("_a"), F.col("_idb").alias("_b"), both.alias("_both")).distinct()


def _digest(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def set_digest(text: Column) -> Column:
    """The hash by which gram sets are told apart."""
    return _digest(F.array_join(F.sort_array(T.grams(text)), "\x1f"))


def _firsts(texts: DataFrame, key: str, within: list[str], text: str, also: list[str]) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Texts that have grams with ``_set``, the table made for that (none if ``texts`` has it), and one text of each class with its ``_id``."""
    own, texts = None, texts.withColumn("_text", F.col(text))
    if "_set" not in texts.columns:
        texts = own = keep(texts.select(*within, key, *also, "_text").withColumn("_set", set_digest(F.col("_text"))))
    # Those without grams are left out as they are read again: a filter below would make the grams twice.
    s = texts.where(F.col("_set") != _digest(F.lit("")))
    one = s.groupBy(*within, "_set").agg(F.min(F.struct(F.col(key).alias("k"), F.col("_text").alias("t"))).alias("_v"))
    return s, own, keep(one.select(*within, "_set", F.col("_v.k").alias("class"), F.col("_v.t").alias("_text")).withColumn("_id", F.monotonically_increasing_id()))


def _links(one: DataFrame, within: list[str]) -> DataFrame:
    """Links of classes by their first texts, of which it drops the table. Each step's table goes as soon as the next one is there."""
    sets = keep(one.select("_id", F.transform(T.grams(F.col("_text")), lambda g: F.hash(*within, g)).alias("_t")))
    whole = heads(sets)
    release(sets)
    near = keep(candidates(whole))
    release(whole)
    ids = near.select(F.col("_a").alias("_id")).unionByName(near.select(F.col("_b").alias("_id"))).distinct()
    few = keep(one.join(F.broadcast(ids) if near.count() <= SENT else ids, "_id", "left_semi"))
    release(one)
    ga, gb = (few.select(*[F.col(c).alias(c + side) for c in ("_id", *within, "class", "_text")]) for side in ("_a", "_b"))
    both = near.join(ga, F.col("_a") == F.col("_id_a")).join(gb, F.col("_b") == F.col("_id_b"))
    for c in within:
        both = both.where(F.col(c + "_a") == F.col(c + "_b"))
    links = both.where(F.size(F.array_intersect(T.grams(F.col("_text_a")), T.grams(F.col("_text_b")))) * BOTH > F.col("_both") * SIDES)
    links = keep(links.select(*[F.col(c + "_a").alias(c) for c in within], F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")))
    release(near), release(few)
    return links


def class_links(texts: DataFrame, key: str, within: list[str] = (), text: str = "text") -> DataFrame:
    """The links of :func:`classes` alone."""
    _, own, one = _firsts(texts, key, within, text, [])
    if own is not None:
        release(own)
    return _links(one, within)


def classes(texts: DataFrame, key: str, within: list[str] = (), text: str = "text", also: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Membership (``within, key, also, class``) and links (``within, class_a < class_b``) of texts with alike gram sets.

    A class is all texts of one group (``within``) with one gram set and is called by its smallest key, so a text with very many
    copies is compared once. Candidates of a group share a rare gram and are then compared exactly. Texts without grams are in no
    class. Copies aren't expanded into pairs: members of one class, and members of linked classes, are the pairs. Members keep
    the columns ``also``. Texts that come with ``_set`` (:func:`set_digest`) are read as they are and not written again.
    """
    s, own, one = _firsts(texts, key, within, text, also)
    members = keep(s.select(*within, key, *also, "_set").join(one.select(*within, "_set", "class"), [*within, "_set"]).select(*within, key, *also, "class").distinct())
    if own is not None:
        release(own)
    return members, _links(one, within)


def within_pairs(members: DataFrame, links: DataFrame, group: str, key: str) -> DataFrame:
    """``group, a, b``: linked classes of a group by their first members, and each further member of a class with its first."""
    copies = members.where(F.col(key) != F.col("class")).select(group, F.col("class").alias("a"), F.col(key).alias("b"))
    return links.select(group, F.col("class_a").alias("a"), F.col("class_b").alias("b")).unionByName(copies)


def first_across(members: DataFrame, links: DataFrame, node: str, key: str, k: int = 5) -> DataFrame:
    """``node_a, a, node_b, b``: the first ``k`` pairs of alike texts of different nodes, by node and key of both.

    Of each class only the first ``k + 1`` members of its first ``k + 1`` nodes can be in a pair among the first ``k``, so classes
    of any size are cut to these before pairs are made.
    """
    inner = F.row_number().over(W.partitionBy("class", node).orderBy(key))
    few = members.withColumn("_i", inner).where(F.col("_i") <= k + 1)
    few = few.withColumn("_j", F.dense_rank().over(W.partitionBy("class").orderBy(node))).where(F.col("_j") <= k + 1).select("class", F.col(node).alias("n"), F.col(key).alias("e"))
    a, b = few.select(F.col("class").alias("class_a"), F.struct("n", "e").alias("x")), few.select(F.col("class").alias("class_b"), F.struct("n", "e").alias("y"))
    both = links.select("class_a", "class_b").unionByName(members.select(F.col("class").alias("class_a"), F.col("class").alias("class_b")).distinct())
    pairs = both.join(a, "class_a").join(b, "class_b").where("x.n <> y.n").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return pairs.orderBy("x", "y").limit(k).select(F.col("x.n").alias("node_a"), F.col("x.e").alias("a"), F.col("y.n").alias("node_b"), F.col("y.e").alias("b"))


def near_keys(copies: DataFrame, few: DataFrame, key: str, text: str = "text", most: int = NEAR) -> list | None:
    """Keys of ``copies`` among which are those of all that are alike to one of ``few`` texts; None if there are more than ``most``.

    Each of two alike sets has one of the first ceil(n / 5) grams of the other among its own. ``few`` are broadcast, each different
    set once, and ``copies`` read in one pass that writes nothing but keys.
    """
    hashed = F.transform(T.grams(F.col(text)), lambda g: F.hash(g))
    own = keep(few.select(F.sort_array(hashed).alias("_t")).distinct().withColumn("_id", F.lit(0)))
    rank = ranks(own)
    a, b = _heads(own, rank), _heads(copies.select(F.col(key).alias("_id"), hashed.alias("_t")), rank)
    # The outer form, as the other one's filter would make the grams twice.
    a, b = (x.select("_id", *[F.col(c).alias(c + side) for c in ("_n", "_x", "_y")], F.explode_outer("_p").alias("_t")) for x, side in ((a, "a"), (b, "b")))
    differ = F.bit_count(F.col("_xa").bitwiseXOR(F.col("_xb"))) + F.bit_count(F.col("_ya").bitwiseXOR(F.col("_yb")))
    near = (F.least("_na", "_nb") * 5 > F.greatest("_na", "_nb") * 4) & (differ * 9 < F.col("_na") + F.col("_nb"))
    got = b.join(F.broadcast(a.drop("_id")), "_t").where(near).select("_id").distinct().limit(most + 1).collect()
    release(own)
    return None if len(got) > most else [r["_id"] for r in got]


def first_pairs(texts: DataFrame, node: str, key: str, k: int = 5, copies: DataFrame | None = None) -> DataFrame:
    """:func:`first_across` of all ``texts``, without comparing all of them where the first ones have enough pairs.

    Pairs are ordered by their smaller text. So all pairs that begin with one of the first :data:`FIRST` texts come before any
    other; if there are ``k`` of them, these texts and those alike to them are all that is compared. Otherwise all texts are.
    ``copies``: rows (``node, key, text``, none of them null) among which is each of ``texts`` as it stands there, for tables whose
    latest copies are costly to find.
    """
    copies = texts if copies is None else copies
    few = copies.select(node, key).orderBy(node, key).limit(FIRST).collect()
    if len(few) == FIRST:
        keys = {r[key] for r in few}
        near = near_keys(copies, texts.where(F.col(key).isin(*keys)), key)
        if near is not None:
            members, links = classes(texts.where(F.col(key).isin(*keys.union(near))), key, also=[node])
            got = keep(first_across(members, links, node, key, k))
            release(members), release(links)
            begin = [(r["node_a"], r["a"]) for r in got.collect()]
            if len(begin) == k and max(begin) <= (few[-1][node], few[-1][key]):
                return got.orderBy("node_a", "a", "node_b", "b")
            release(got)
    return first_across(*classes(texts, key, also=[node]), node, key, k)


def collides(texts: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """``key, id, option``: texts alike to an option that a change rejected, one option per text and change.

    Each different text of both sides is compared once, by its class.
    """
    left, right = keep(texts.select(key, "text").distinct()), keep(rejected.select("id", F.col("option").alias("text")).distinct())
    members, links = classes(left.select("text").union(right.select("text")).distinct(), "text")
    same = members.where(F.col("text") == F.col("class")).select(F.col("class").alias("_a"), F.col("class").alias("_b"))
    both = same.union(links.select("class_a", "class_b")).union(links.select("class_b", "class_a"))
    a = left.join(members, "text").select(key, F.col("class").alias("_a"))
    b = right.join(members, "text").select("id", F.col("text").alias("option"), F.col("class").alias("_b"))
    return a.join(both, "_a").join(b, "_b").groupBy(key, "id").agg(F.min("option").alias("option"))


# Vectors


def unit(v: Column) -> Column:
    """A vector of length 1 in doubles; null for a null, empty, zero or non-finite one."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.transform(v, lambda x: x.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scored(vectors: DataFrame, query: list[float], vector: str = "vec") -> DataFrame:
    """``vectors`` with ``score``, the cosine to the query, cut to [-1, 1]; without those that have none.

    The query is a literal in the plan: one pass over the collection, no shuffle.
    """
    norm = sum(x * x for x in query) ** 0.5
    if not query or not 0 < norm < float("inf"):
        raise ValueError("a query vector must be finite and not all zero")
    q = F.array(*[F.lit(x / norm) for x in query])
    u = unit(F.col(vector))
    raw = vectors.where(F.size(vector) == len(query)).withColumn("score", dot(u, q)).where(F.col("score").isNotNull() & ~F.isnan("score"))
    return raw.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))))


def top_k(scored_: DataFrame, k: int) -> DataFrame:
    """The k best by score, then id."""
    if k <= 0:
        raise ValueError("k must be positive")
    return scored_.orderBy(F.desc("score"), "id").limit(k)


def top_k_distinct(scored_: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Of each lane (``by[:-1]``) the k best, only the best record of each node (``by[-1]``); ``place`` from 1.

    Filters belong below this: a record that may not be shown must not stand in for its node.
    """
    best = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))
    one = scored_.withColumn("_r", best).where("_r = 1").drop("_r")
    if len(by) == 1:
        return top_k(one, k).withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    place = F.row_number().over(W.partitionBy(*by[:-1]).orderBy(F.desc("score"), "id"))
    return one.withColumn("place", place).where(F.col("place") <= k)
