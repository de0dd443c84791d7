"""Splitting oversized texts at natural boundaries, with an overlap between consecutive pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.llm.tokens import Bpe, loader

LIMIT, OVERLAP = 2_000, 200
#: Ends of natural units, from the one liked best; matched in a text's bytes, the boundary is the match's end.
BOUNDARIES = [
    ("paragraph", re.compile(rb"\n[ \t\r]*\n[ \t\r\n]*")),
    ("line", re.compile(rb"\r?\n")),
    ("sentence", re.compile(rb"[.!?]+[\"')\]]*(?= )|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xef\xbc\x9b)+")),
    ("word", re.compile(rb"(?<=[^ \t\r\n])(?=[ \t\r\n])")),
]
#: A boundary is taken only if the piece is filled to this part of the limit; else a finer kind is tried.
FILLED = 0.5


def split(bpe: Bpe, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces (first byte, end byte, tokens, kind of its end) of a text of more than ``limit`` tokens; otherwise none.

    Each piece alone has at most ``limit`` tokens. The next begins ``overlap`` tokens before its end, moved back to the word's
    beginning where there is one among as many tokens before, otherwise at a code point. Together they hold the whole text. A
    code point that alone has more tokens than ``limit`` (possible for limits below 4) is a piece of its own.
    """
    ids = bpe.encode(text)
    if len(ids) <= limit:
        return []
    raw = text.encode()
    ends = np.cumsum(bpe.lengths[np.asarray(ids)])  # byte at which each token ends
    places = [(kind, np.unique(np.fromiter((m.end() for m in pattern.finditer(raw)), np.int64))) for kind, pattern in BOUNDARIES]
    words = places[-1][1]
    is_start = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    out, start, n = [], 0, len(raw)

    def back(at: int) -> int:
        while at > 0 and at < n and not is_start[at]:
            at -= 1
        return at

    while True:
        first = int(np.searchsorted(ends, start, "right"))  # the token that holds byte start
        room = limit
        while True:
            k = first + room - 1
            if k >= len(ends):
                end, kind = n, "end"
            else:
                most = int(ends[k])
                least = int(ends[first + max(0, int(room * FILLED) - 1)])
                end = kind = None
                for name, at in places:
                    j = int(np.searchsorted(at, most, "right")) - 1
                    if j >= 0 and at[j] > max(least, start):
                        end, kind = int(at[j]), name
                        break
                if end is None:
                    end, kind = back(most), "hard"
                    if end <= start:
                        end = start + 1
                        while end < n and not is_start[end]:
                            end += 1
            size = len(bpe.encode(raw[start:end].decode()))
            if size <= limit or end - start <= 4 and room <= 1:
                break
            room = max(1, room - max(1, size - limit))  # text cut inside a word may have more tokens than its part had
        out.append((start, end, size, kind))
        if end >= n:
            return out
        stop = int(np.searchsorted(ends, end, "left"))  # the token that ends at or after the piece's end
        wish = int(ends[stop - overlap]) if overlap and stop - overlap >= 0 else end if not overlap else 0
        wish = min(wish, end)
        j = int(np.searchsorted(words, wish, "right")) - 1
        floor = int(ends[stop - 2 * overlap]) if stop - 2 * overlap >= 0 else 0
        nxt = int(words[j]) if overlap and j >= 0 and words[j] >= floor else back(wish)
        if nxt <= start:
            nxt = back(wish)
        start = nxt if nxt > start else end


def split_oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, path: str | None = None) -> DataFrame:
    """``key, piece`` (from 0), ``first`` and ``end`` (bytes of the UTF-8 text), ``tokens, boundary`` and ``text`` of each piece.

    Only texts of more than ``limit`` tokens give rows; null and empty ones have none. Repeated rows give repeated pieces. A
    token has at least one byte, so texts of at most ``limit`` bytes are passed over unread by Python. Nothing is shuffled.
    ``overlap`` must be less than half of ``limit``.
    """
    if not 0 <= overlap * 2 < limit:
        raise ValueError("overlap must be less than half of limit")
    load = loader(df.sparkSession, path)
    df = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    of = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for b in batches:
            for k, t in zip(b["key"], b["text"].to_pylist()):
                if cut := split(bpe, t, limit, overlap):
                    n, raw = len(cut), t.encode()
                    cols = [pa.array([k.as_py()] * n, k.type), pa.array(range(n), pa.int32()), *[pa.array(c, pa.int64()) for c in list(zip(*cut))[:3]], pa.array([c[3] for c in cut])]
                    yield pa.RecordBatch.from_arrays(cols + ([pa.array([raw[c[0] : c[1]].decode() for c in cut])] if with_text else []), names=[key, "piece", "first", "end", "tokens", "boundary", *["text"] * with_text])

    return df.mapInArrow(run, f"{key} {of}, piece int, first long, end long, tokens long, boundary string" + ", text string" * with_text)
