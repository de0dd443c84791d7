"""The most similar vectors of a collection for every vector: additive quantisation, table lookups, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anchorlake.common import keep, release, ship

#: Codebooks are fitted on at most so many vectors; all vectors are encoded and indexed.
SAMPLE = 20_000
#: Sizes of the codebooks. Each is full-dimensional and fitted to what the ones before leave.
BOOKS = (512, 256, 256, 256, 256, 256, 256, 256)
BEAM, ROUNDS = 4, 6
#: A cell is a prefix of codes, long enough that about so many vectors share one; a query visits so many cells.
CELL, PROBES = 512, 16
#: Estimates may lie so far below the wanted similarity before a vector is no longer compared exactly.
SLACK = 0.25
#: Groups of a codebook's codewords: a region is the cells of one group with one prefix before them.
REGIONS = 32
#: Vectors of a region that are compared at once, and visitors that are compared with them at once.
BLOCK, ASK = 8_192, 1_024


class Books:
    """Additive codebooks: a vector is the sum of one codeword of each."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.near: dict[int, np.ndarray] = {}
        self.squares = [(c.astype(np.float64) ** 2).sum(1).astype(np.float32) for c in books]

    @classmethod
    def fit(cls, x: np.ndarray, sizes: tuple[int, ...] = BOOKS, seed: int = 3) -> Books:
        """k-means on residuals, one codebook after the other."""
        rng, books, left = np.random.default_rng(seed), [], x.astype(np.float32).copy()
        for size in sizes:
            c = left[rng.permutation(len(left))[: min(size, len(left))]].copy()
            for _ in range(ROUNDS):
                near = _nearest(left, c)
                n = np.bincount(near, minlength=len(c))
                total = np.zeros((len(c), x.shape[1]), np.float64)
                np.add.at(total, near, left)
                some = n > 0
                c[some] = (total[some] / n[some, None]).astype(np.float32)
            books.append(c)
            left = left - c[_nearest(left, c)]
        return cls(books)

    def beam(self, x: np.ndarray, levels: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, width, levels) of the ``width`` closest sums found by beam search, the closest first; and their vectors."""
        n, d = x.shape
        codes = np.zeros((n, 1, 0), np.int32)
        left = x[:, None, :]
        for c, sq in zip(self.books[:levels], self.squares):
            w = left.shape[1]
            cost = (left**2).sum(2)[:, :, None] - 2 * (left.reshape(-1, d) @ c.T).reshape(n, w, -1) + sq
            flat = cost.reshape(n, -1)
            k = min(width, flat.shape[1])
            best = np.argpartition(flat, k - 1, 1)[:, :k] if k < flat.shape[1] else np.tile(np.arange(k), (n, 1))
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), 1, kind="stable"), 1)
            of, word = best // len(c), best % len(c)
            codes = np.concatenate([np.take_along_axis(codes, of[:, :, None], 1), word[:, :, None].astype(np.int32)], 2)
            left = np.take_along_axis(left, of[:, :, None], 1) - c[word]
        return codes, x[:, None, :] - left

    def regions(self, cells: np.ndarray, levels: int) -> np.ndarray:
        """The region of each cell: cells that differ in their last code alone are near if its codewords are, and lie together."""
        last = len(self.books[levels - 1])
        if levels not in self.near:
            c = self.books[levels - 1]
            middle = c[:: max(1, len(c) // REGIONS)][:REGIONS].copy()
            for _ in range(ROUNDS):
                at = _nearest(c, middle)
                middle = np.stack([c[at == k].mean(0) if (at == k).any() else middle[k] for k in range(len(middle))])
            self.near[levels] = _nearest(c, middle)
        return cells // last * REGIONS + self.near[levels][cells % last]

    def cells(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(codes.shape[:-1], np.int64)
        for k in range(codes.shape[-1]):
            out = out * len(self.books[k]) + codes[..., k]
        return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    sq = (c**2).sum(1)
    return np.concatenate([(sq - 2 * (x[k : k + 4096] @ c.T)).argmin(1) for k in range(0, len(x), 4096)])


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    top = np.abs(y).max(1, keepdims=True)
    y /= top
    return y / np.sqrt((y**2).sum(1, keepdims=True))


def usable(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """``id`` (string) and ``vec``: rows with a key whose vector has ``size`` components, none null, NaN or infinite, not all 0."""
    df = df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == size))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(~odd & F.exists("vec", lambda x: x != 0))


def _encode(books, levels: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = books.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                x = _unit(_matrix(b["vec"])).astype(np.float32)
                codes, sums = b_.beam(x, len(b_.books), BEAM)
                near, _ = b_.beam(x, levels, probes)
                own = b_.cells(codes[:, 0, :levels])
                region = b_.regions(own, levels)
                # Cells to visit, each once, by region: one visit holds all cells of its region.
                visits = np.sort(np.c_[b_.cells(near), own], 1)
                row = np.repeat(np.arange(len(x)), visits.shape[1])
                cell = visits.reshape(-1)
                first = np.r_[True, (np.diff(row) != 0) | (np.diff(cell) != 0)]
                row, cell = row[first], cell[first]
                of = b_.regions(cell, levels)
                order = np.lexsort((cell, of, row))
                row, cell, of = row[order], cell[order], of[order]
                new = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(of) != 0)])
                cells = pa.ListArray.from_arrays(pa.array(np.r_[new, len(cell)].astype(np.int32)), pa.array(cell))
                per_row = np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(x)))].astype(np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(per_row), values)
                norm = np.sqrt((sums[:, 0].astype(np.float64) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b["class"], b["vec"], pa.array([r.astype(np.int16).tobytes() for r in codes[:, 0]], pa.binary()), pa.array(norm.astype(np.float32)), pa.array(own), pa.array(region), lists(pa.array(of[new])), lists(cells)], names=["class", "vec", "codes", "norm", "cell", "region", "regions", "cells"])

    return run


def _search(books, k: int, floor: float, slack: float):
    """Blocks one after the other: first the vectors that lie there, by cell, then those that visit some of the cells."""

    def score(b_: Books, base: list[pa.RecordBatch], visit: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        here = pa.Table.from_batches(base).combine_chunks().to_batches()[0]
        ids, cell = here["class"].to_numpy(), here["cell"].to_numpy()
        codes = np.frombuffer(b"".join(here["codes"].to_pylist()), np.int16).reshape(len(ids), -1)
        norm, exact = here["norm"].to_numpy(), _unit(_matrix(here["vec"]))
        known, start = np.unique(cell, return_index=True)
        end = np.r_[start[1:], len(cell)]
        for at in range(0, visit.num_rows, ASK):
            part = visit.slice(at, ASK)
            mine, ask = part["class"].to_numpy(), _unit(_matrix(part["vec"]))
            q = ask.astype(np.float32)
            tables = [q @ c.T for c in b_.books[: codes.shape[1]]]
            wants = part["cells"]
            cells = wants.flatten().to_numpy()
            row = np.repeat(np.arange(len(mine)), np.diff(wants.offsets.to_numpy()))
            order = np.argsort(cells, kind="stable")
            cells, row = cells[order], row[order]
            lo, hi = np.searchsorted(cells, known, "left"), np.searchsorted(cells, known, "right")
            found_i, found_j = [], []
            for c in range(len(known)):
                rows = row[lo[c] : hi[c]]
                s, e = start[c], end[c]
                for x in range(0, len(rows), max(1, 1_000_000 // (e - s))):
                    some = rows[x : x + max(1, 1_000_000 // (e - s))]
                    guess = np.zeros((len(some), e - s), np.float32)
                    for m, t in enumerate(tables):
                        guess += t[some][:, codes[s:e, m]]
                    guess /= norm[s:e]
                    i, j = np.nonzero(guess >= floor - slack)
                    found_i.append(some[i])
                    found_j.append(j + s)
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))
            other = mine[i] != ids[j]
            i, j = i[other], j[other]
            cos = np.concatenate([np.einsum("ij,ij->i", ask[i[s : s + 20_000]], exact[j[s : s + 20_000]]) for s in range(0, len(i), 20_000)]) if len(i) else np.zeros(0)
            ok = cos >= floor
            i, j, cos = i[ok], j[ok], cos[ok]
            order = np.lexsort((ids[j], -cos, i))
            i, j, cos = i[order], j[order], cos[order]
            first = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, np.int64)
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) if len(i) else first
            top = place < k
            if top.any():
                yield pa.RecordBatch.from_arrays([pa.array(mine[i[top]]), pa.array(ids[j[top]]), pa.array(cos[top])], names=["class", "other", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_, at, base = books.value, None, []
        for batch in batches:
            region, block, asks = batch["region"].to_numpy(), batch["block"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)
            ends = np.r_[np.flatnonzero((np.diff(region) != 0) | (np.diff(block) != 0) | (asks[1:] != asks[:-1])) + 1, len(region)]
            start = 0
            for end in ends:
                if end == start:
                    continue
                now, part = (region[start], block[start]), batch.slice(start, end - start)
                if now != at:
                    at, base = now, []
                if not asks[start]:
                    base.append(part)
                elif base:
                    yield from score(b_, base, part)
                start = end

    return run


def most_similar(vectors: DataFrame, k: int = 5, floor: float = 0.9, probes: int = PROBES, slack: float = SLACK, sizes: tuple[int, ...] = BOOKS, cell: int = CELL) -> DataFrame:
    """``id, other, cos`` and ``place`` (1 to k): of each vector the k most similar others with a cosine of at least ``floor``.

    ``vectors`` has ``id`` and ``vec`` as :func:`usable` gives them; repeated rows count once. Ties go to the smaller id. The
    collection may be empty. Cosines are exact (double); the loss is in vectors that lie in no cell visited and in those whose
    estimate is too far off, see the README for the recall measured. With as many ``probes`` as there are cells and a ``slack`` of 2
    (or a ``floor`` of -1) nothing is lost.

    Equal vectors are one class, so a vector that a third of all rows share is searched once. Codes come from a beam search over
    residual codebooks of ``sizes``; a cell is a prefix of codes, long enough that about ``cell`` vectors share one. A visitor goes
    to ``probes`` cells for the first code of the prefix and four times as many for each further one, as the cells then are so much
    smaller. Cells that lie near each other make up a region, and a visitor is sent once to a region for all its cells there.
    Regions of more than ``BLOCK`` vectors are cut into blocks, so no task holds more than a block. Within a cell, sums of table
    lookups over stored norms estimate all cosines; all vectors whose estimate is within ``slack`` of the floor are compared exactly.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = keep(vectors.select("id", "vec").distinct())
    classes = keep(rows.select("vec").distinct().withColumn("class", F.monotonically_increasing_id()))
    n = classes.count()
    if not n:
        return rows.select("id", F.col("id").alias("other"), F.lit(0.0).alias("cos"), F.lit(1).alias("place"))
    sample = classes if n <= SAMPLE else classes.where(F.pmod(F.xxhash64("class"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n)).limit(SAMPLE)
    fitted = Books.fit(_unit(_matrix(sample.select("vec").toArrow()["vec"].combine_chunks())).astype(np.float32), sizes)
    levels, cells, visits = 1, len(fitted.books[0]), probes
    while cells * cell < n and levels < len(fitted.books):
        cells *= len(fitted.books[levels])
        levels, visits = levels + 1, visits * 4
    books = spark.sparkContext.broadcast(fitted)  # sum(sizes) codewords, whatever the collection
    shape = "class long, vec array<float>, codes binary, norm float, cell long, region long, regions array<long>, cells array<array<long>>"
    coded = keep(classes.mapInArrow(_encode(books, levels, visits), shape))
    blocks = coded.groupBy("region").count().select("region", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    full = blocks.where("blocks > 1")
    none = F.lit(None)
    here = coded.select("region", "cell", "class", "vec", "codes", "norm").join(full, "region", "left").select("region", F.pmod(F.xxhash64("class"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), F.lit(False).alias("asks"), "cell", none.cast("array<long>").alias("cells"), "class", "vec", "codes", "norm")
    asks = coded.select(F.explode(F.arrays_zip("regions", "cells")).alias("v"), "class", "vec").select(F.col("v.regions").alias("region"), F.col("v.cells").alias("cells"), "class", "vec")
    asks = asks.join(blocks, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), none.cast("long").alias("cell"), "cells", "class", "vec", none.cast("binary").alias("codes"), none.cast("float").alias("norm"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * probes / 400_000))
    met = here.unionByName(asks).repartition(parts, "region", "block").sortWithinPartitions("region", "block", "asks", "cell")
    best = met.mapInArrow(_search(books, k, floor, slack), "class long, other long, cos double").distinct()
    best = keep(best.withColumn("_r", F.row_number().over(W.partitionBy("class").orderBy(F.desc("cos"), "other"))).where(F.col("_r") <= k).drop("_r"))
    release(coded)
    own = rows.join(classes, "vec").select("id", "class")
    first = own.withColumn("_r", F.row_number().over(W.partitionBy("class").orderBy("id"))).where(F.col("_r") <= k + 1).select(F.col("class").alias("other"), F.col("id").alias("near"))
    self = own.select("id", F.col("class").alias("other"), F.lit(1.0).alias("cos"))
    both = own.join(best, "class").select("id", "other", "cos").unionByName(self).join(first, "other").where(F.col("id") != F.col("near"))
    ranked = both.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("cos"), "near")))
    return ranked.where(F.col("place") <= k).select("id", F.col("near").alias("other"), "cos", "place")
