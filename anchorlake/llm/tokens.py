"""Encoding with a public byte-level BPE, also of very long text without a place to split."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake.common import keep, ship

#: Texts of more code points are cut into pieces that are encoded in parallel.
LONG = 32_768
#: Code points of such a piece, and bytes of a piece of one unsplittable run.
PIECE, RUN = 16_384, 4_096
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's model splits text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed tokenizer files are."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / name)


class Bpe:
    """A vocabulary of ranks; encodes any text in time that grows little faster than its length."""

    def __init__(self, data: bytes):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.token_bytes = {i: t for t, i in self.ranks.items()}
        self.lengths = np.zeros(max(self.token_bytes) + 1, np.int64)
        for i, t in self.token_bytes.items():
            self.lengths[i] = len(t)

    def piece(self, run: bytes) -> list[int]:
        """Ids of one run that the pattern doesn't split."""
        return self.bpe._encode_single_piece(run)

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b may stand side by side: their bytes alone encode to just them."""
        return self.piece(self.token_bytes[a] + self.token_bytes[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two encoded parts of one run as if encoded as one.

        A sequence is an encoding exactly if each two neighbours are. A window around the join is encoded anew and grows until
        both its edges agree with what lies outside.
        """
        w = 2
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            mid = self.piece(b"".join(self.token_bytes[t] for t in (*left[a:], *right[:b])))
            if not mid or ((a == 0 or self.fits(left[a - 1], mid[0])) and (b == len(right) or self.fits(mid[-1], right[b]))):
                return left[:a] + mid + right[b:]
            w *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Joins neighbours pairwise, as a tree."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def cuts(self, text: str) -> list[tuple[bytes, bool, bool]]:
        """Pieces (bytes, is one unsplittable run, continues the piece before) whose ids make up those of ``text``.

        Before a blank after a non-blank the pattern always splits and nothing before it matters any more. Where a stretch has no
        such place, it is split by the pattern itself, and single runs that are too long are cut anywhere, to be joined.
        """
        out: list[tuple[bytes, bool, bool]] = []
        at, n = 0, len(text)
        while at < n:
            end = _cut_before_blank(text, at, min(n, at + PIECE))
            stretch = text[at:end]
            at = end
            if len(stretch) <= 2 * PIECE:
                out.append((stretch.encode(), False, False))
                continue
            held, size = [], 0
            for m in self.split.finditer(stretch):
                run = m.group()
                if len(run) > RUN:
                    ends = len(held)
                    while ends and held[ends - 1][-1].isspace():  # blanks at an end would be split otherwise on their own
                        ends -= 1
                    if ends:
                        out.append(("".join(held[:ends]).encode(), False, False))
                    out.extend((x.encode(), True, False) for x in held[ends:])
                    held, size = [], 0
                    raw = run.encode()
                    out.extend((raw[k : k + RUN], True, k > 0) for k in range(0, len(raw), RUN))
                    continue
                held.append(run)
                size += len(run)
                if size >= PIECE and not run[-1].isspace():
                    out.append(("".join(held).encode(), False, False))
                    held, size = [], 0
            if held:
                out.append(("".join(held).encode(), False, False))
        return out

    def encode_cut(self, raw: bytes, is_run: bool) -> list[int]:
        return self.piece(raw) if is_run else self.bpe.encode_ordinary(raw.decode())

    def glue(self, parts: list[tuple[list[int], bool]]) -> list[int]:
        """Ids of all cuts in order: parts that continue the one before are joined, all others follow it."""
        out: list[int] = []
        run: list[list[int]] = []
        for ids, continues in parts:
            if not continues:
                out.extend(self.join_all(run))
                run = []
            run.append(ids)
        out.extend(self.join_all(run))
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= LONG:
            return self.bpe.encode_ordinary(text)
        return self.glue([(self.encode_cut(raw, is_run), more) for raw, is_run, more in self.cuts(text)])


def _cut_before_blank(text: str, at: int, want: int) -> int:
    """The first place from ``want`` on (the text's end, if none) between a non-blank and a blank."""
    n = len(text)
    k = want
    while k < n:
        if _blank(text[k]) and k > at and not text[k - 1].isspace():
            return k
        k += 1
    return n


def _blank(c: str) -> bool:
    """Blanks that every definition of the pattern's white space holds."""
    return c in " \t\r\n"


@lru_cache(maxsize=2)
def _loaded(data: bytes) -> Bpe:
    return Bpe(data)


def loader(spark: SparkSession, path: str | None = None) -> Callable[[], Bpe]:
    """A function that gives the executors the vocabulary at ``path`` (a file of the driver, under 1 MB; sent once)."""
    ship(spark)
    sent = spark.sparkContext.broadcast(Path(path or vocabulary_path()).read_bytes())
    return lambda: _loaded(sent.value)


def _lists(rows: list, kind: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((x for r in rows for x in r), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat, kind))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids``, the ids of ``text`` without special tokens, a row for each row of ``df``.

    Null and empty texts get an empty list. Strings that look like special tokens are ordinary text. Repeated rows come back as
    often; other columns are left out. Each text is read once and encoded where it is read if it has up to ``LONG`` characters.
    Longer ones are cut there (see :meth:`Bpe.cuts`), their pieces are spread over all executors and encoded, and only the pieces
    that no blank or pattern separates are joined with growing windows. The ids of one text are one row, so they meet in one task
    at the end, which does no more than these joins.
    """
    return _encoded(df.select(F.col(key).alias("_k0"), F.col(text).alias("_text")), path, False).select(F.col("_k0").alias(key), "ids")


def token_counts(df: DataFrame, cols: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``cols`` and ``tokens`` (long), the number of ids of ``text``; null and empty texts have 0. As :func:`encode_corpus`, without the ids."""
    given = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)], F.col(text).alias("_text"))
    return _encoded(given, path, True).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(cols)], "tokens")


def _encoded(df: DataFrame, path: str | None, count_only: bool) -> DataFrame:
    """Columns ``_k0``, ``_k1`` ... of ``df`` with ``ids`` or ``tokens`` of ``_text``.

    One pass over the texts writes what is encoded already and, in a folder of its own, the pieces of long texts.
    """
    load = loader(df.sparkSession, path)
    keys = [c for c in df.columns if c != "_text"]
    of = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "_text")
    result = "tokens long" if count_only else "ids array<int>"

    def done(rows: list[list[int]]) -> pa.Array:
        return pa.array([len(r) for r in rows], pa.int64()) if count_only else _lists(rows, pa.int32())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, row = load(), TaskContext.get().partitionId() << 32
        encode = bpe.bpe.encode_ordinary
        empty = pa.array([0], pa.int64()) if count_only else _lists([[]], pa.int32())
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                texts = b["_text"].to_pylist()
                far = [bool(t) and len(t) > LONG for t in texts]
                out = done([encode(t) if t and not x else [] for t, x in zip(texts, far)])
                n = b.num_rows
                cols = [*(b[c] for c in keys), out, *(pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_())), pa.array([False] * n)]
                near = pa.RecordBatch.from_arrays(cols, names=[*keys, result.split()[0], "row", "seq", "raw", "run", "more", "far"])
                yield near.filter(pa.array([not x for x in far])) if any(far) else near
                for i in (i for i, x in enumerate(far) if x):
                    row += 1
                    cuts = bpe.cuts(texts[i])
                    m = len(cuts)
                    kept = [pa.array([b[c][i].as_py()] * m, b[c].type) for c in keys]
                    none = pa.array([None] * m, pa.int64()) if count_only else pa.nulls(m, empty.type)
                    yield pa.RecordBatch.from_arrays([*kept, none, pa.array([row] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([c[0] for c in cuts], pa.binary()), pa.array([c[1] for c in cuts]), pa.array([c[2] for c in cuts]), pa.array([True] * m)], names=near.schema.names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for b in batches:
            ids = [bpe.encode_cut(r, x) for r, x in zip(b["raw"].to_pylist(), b["run"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keys), b["row"], b["seq"], b["more"], _lists(ids, pa.int32())], names=[*keys, "row", "seq", "more", "ids"])

    def glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for b in batches:
            for k, parts in enumerate(b["parts"]):
                ids = bpe.glue([(p["ids"], p["more"]) for p in parts.as_py()])
                yield pa.RecordBatch.from_arrays([*(pa.array([b[c][k].as_py()], b[c].type) for c in keys), done([ids])], names=[*keys, result.split()[0]])

    read = keep(df.mapInArrow(first, f"{of}, {result}, row long, seq int, raw binary, run boolean, more boolean, far boolean"), "far")
    near = read.where("NOT far").select(*keys, result.split()[0])
    far = read.where("far").select(*keys, "row", "seq", "raw", "run", "more").repartition("row", "seq").mapInArrow(pieces, f"{of}, row long, seq int, more boolean, ids array<int>")
    far = far.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("seq", "more", "ids"))).alias("parts")).select(*keys, "parts").mapInArrow(glued, f"{of}, {result}")
    return near.unionByName(far)
