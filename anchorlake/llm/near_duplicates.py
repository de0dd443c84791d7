"""Near-duplicate records: b-bit MinHash signatures, band candidates, exact check."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.common import keep, ship

#: 64 bands of 6 minima: of pairs with similarity 0.7, one in 3,000 shares no band; of 0.8, one in 10**8.
BANDS, ROWS = 64, 6
#: Low bits of a minimum that the packed signature retains. (A band's key is a hash of its whole minima in 32 bits.)
BITS = 2
#: Minima in the signature, and how far below the threshold an estimate from them may lie (four standard errors at 0.7).
FIELDS, SLACK = 128, 0.2
#: Words whose hashes a worker keeps at hand.
WORDS_KNOWN = 32_768
WORDS = re.compile("[a-z0-9]+|[一-鿿]")


def words_of(text: str) -> list[str]:
    """Runs of a-z and 0-9 and single Han characters of the lower-cased text, each once, sorted."""
    return sorted(set(WORDS.findall(text.lower())))


def shingles_of(n: int) -> Callable[[str], list[str]]:
    """Runs of n words of a text; shorter texts are one shingle."""

    def cut(text: str) -> list[str]:
        w = WORDS.findall(text.lower())
        return sorted({" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}) if w else []

    return cut


def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(7))
    return r.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, k, dtype=np.uint64)


def _sets(cut: Callable[[str], list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, within, text in zip(b["key"].to_pylist(), b["within"].to_pylist(), b["text"].to_pylist()):
                if text and (w := cut(text)):
                    rows.append((key, within, hashlib.blake2b("\x1f".join((within, *w)).encode(), digest_size=16).digest(), w))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.string()))], names=["key", "within", "digest", "words"])

    return run


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minima under all hash functions, as band keys and as packed low bits."""
    import xxhash

    mul, add = _family(BANDS * ROWS)
    per = 64 // BITS
    mix, at_bit = mul[:ROWS], np.arange(per, dtype=np.uint64) * np.uint64(BITS)
    # Hashes of the words met last, a row each: most words of most texts are among them.
    known: dict[str, int] = {}
    table = np.empty((WORDS_KNOWN, BANDS * ROWS), np.uint32)
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            lists = b["words"].to_pylist()
            low = np.full((len(lists), BANDS * ROWS), np.iinfo(np.uint32).max, np.uint32)
            for k, words in enumerate(lists):
                for x in range(0, len(words), 4096):
                    part = words[x : x + 4096]
                    fresh = [w for w in part if w not in known]
                    if fresh:
                        if len(known) + len(fresh) > WORDS_KNOWN:
                            known.clear()
                            fresh = part
                        first = len(known)
                        h = np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))
                        table[first : first + len(fresh)] = (h[:, None] * mul + add) >> np.uint64(32)
                        known.update(zip(fresh, range(first, first + len(fresh))))
                    np.minimum(low[k], table[[known[w] for w in part]].min(0), out=low[k])
            bands = ((low.reshape(len(lists), BANDS, ROWS) * mix).sum(2, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            bits = np.bitwise_or.reduce((low[:, :FIELDS].astype(np.uint64) & np.uint64(2**BITS - 1)).reshape(len(lists), -1, per) << at_bit, 2).view(np.int64)
            n = pa.array(list(map(len, lists)), pa.int32())
            yield pa.RecordBatch.from_arrays([b["within"], b["digest"], b["rep"], n, _fixed(bands, pa.int32()), _fixed(bits, pa.int64())], names=["within", "digest", "rep", "n", "bands", "signature"])


def _fixed(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1), kind))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal fields, corrected for those equal by chance."""
    ones = F.lit(int("01" * (64 // BITS), 2))

    def unequal(x: Column) -> Column:
        y = x
        for k in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(y.bitwiseAND(ones))

    other = sum((unequal(a[k].bitwiseXOR(b[k])) for k in range(FIELDS * BITS // 64)), F.lit(0))
    chance = 1 / 2**BITS
    return ((1 - other / F.lit(float(FIELDS))) - F.lit(chance)) / F.lit(1 - chance)


def near_duplicates(df: DataFrame, key: str, text: str, within: str | None = None, parts: tuple[int, int] = (8, 10), cut: Callable[[str], list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership (``key``, ``class``) and links (``class_a < class_b``, ``similarity``) of near-duplicate texts.

    A class is all rows with one set of words (by default shingles of five words) and one value of ``within``; links are pairs of
    classes of one ``within`` whose sets have at least ``parts[0] / parts[1]`` of their union in common, compared as integers.
    Rows with a null key, a null ``within`` or a text without words are in no class; a row repeated is one member. ``key`` and
    ``within`` are compared as strings; other columns are left out.

    Copies are one class before anything is compared, so a text that a third of all rows share costs one row. Candidates are
    classes that share a band, joined by band key (adaptive execution splits keys that are too frequent; no bucket is capped),
    with sizes that permit the threshold. Their packed signatures then decide by bit counts whether their words are fetched and
    compared exactly. The operator's product is membership and links, in size with the rows and the links between different
    texts; copies are expanded into pairs only by :func:`all_pairs`. Pairs below the threshold are never returned; the share of true pairs that meet in no band is at most
    (1 - t**6)**64.
    """
    ship(df.sparkSession)
    some, of = parts
    t = some / of
    base = df.select(F.col(key).cast("string").alias("key"), (F.col(within).cast("string") if within else F.lit("")).alias("within"), F.col(text).alias("text")).where("key IS NOT NULL AND within IS NOT NULL AND text IS NOT NULL")
    sets = keep(base.mapInArrow(_sets(cut or shingles_of(5)), "key string, within string, digest binary, words array<string>"))
    # A class's words stay with the row of its smallest key; what is signed is as small as it can be.
    classes = sets.groupBy("digest").agg(F.min("key").alias("rep"), F.first("within").alias("within"), F.first("words").alias("words"))
    signed = keep(classes.mapInArrow(_sign, "within string, digest binary, rep string, n int, bands array<int>, signature array<long>").withColumn("class", F.monotonically_increasing_id()))
    near = signed.select("class", "n", "within", F.posexplode("bands").alias("j", "v")).select("class", "n", F.xxhash64("within", "j", "v").alias("band"))
    a, b = near.alias("a"), near.alias("b")
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.class") < F.col("b.class")) & (small * of >= large * some)).select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b")).distinct()
    side = lambda s: signed.select(F.col("signature").alias(f"_{s}"), F.col("class").alias(f"class_{s}"))
    close = pairs.join(side("a"), "class_a").join(side("b"), "class_b").where(estimate(F.col("_a"), F.col("_b")) >= t - SLACK).select("class_a", "class_b")
    told = sets.join(signed.select(F.col("rep").alias("key"), "digest", "class"), ["key", "digest"]).groupBy("class", "within").agg(F.first("words").alias("words"))
    words = lambda s: told.select(F.col("class").alias(f"class_{s}"), F.col("words").alias(f"_{s}"), F.col("within").alias(f"within_{s}"))
    exact = keep(close).join(words("a"), "class_a").join(words("b"), "class_b").where("within_a = within_b").withColumn("both", F.size(F.array_intersect("_a", "_b"))).withColumn("all", F.size("_a") + F.size("_b") - F.col("both"))
    links = exact.where(F.col("both") * of >= F.col("all") * some).select("class_a", "class_b", (F.col("both") / F.col("all")).alias("similarity"))
    members = sets.select("key", "digest").distinct().join(signed.select("digest", "class"), "digest").select("key", "class")
    return members, links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of keys, ``a < b``, in one class or in linked classes."""
    left, right = members.select(F.col("key").alias("a"), F.col("class").alias("class_a")), members.select(F.col("key").alias("b"), F.col("class").alias("class_b"))
    across = links.join(left, "class_a").join(right, "class_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    same = left.join(right, F.col("class_a") == F.col("class_b")).where("a < b").select("a", "b")
    return across.unionByName(same)
