"""Compressed bitmaps over 32-bit integers, in numpy."""

from __future__ import annotations

import numpy as np

#: Up to so many members a container holds them as a sorted list; beyond, as 65,536 bits.
LIST_MOST = 4096


class Bitmap:
    """A set of integers below 2**32. Its containers go by the upper 16 bits, each a sorted list or bits, whichever is smaller."""

    __slots__ = ("parts",)

    def __init__(self, parts: dict[int, np.ndarray] | None = None):
        self.parts = parts or {}

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= LIST_MOST:
            return low.astype(np.uint16)
        bits = np.zeros(65536, np.bool_)
        bits[low] = True
        return np.packbits(bits)

    @staticmethod
    def _members(part: np.ndarray) -> np.ndarray:
        return part if part.dtype == np.uint16 else np.flatnonzero(np.unpackbits(part)).astype(np.uint16)

    @classmethod
    def of(cls, members: np.ndarray) -> Bitmap:
        members = np.unique(np.asarray(members, np.int64))
        high = members >> 16
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(members) else []
        ends = [*starts[1:], len(members)]
        return cls({int(high[a]): cls._pack((members[a:b] & 0xFFFF).astype(np.int64)) for a, b in zip(starts, ends)})

    def minus(self, other: Bitmap) -> Bitmap:
        out = {}
        for k, a in self.parts.items():
            b = other.parts.get(k)
            if b is None:
                out[k] = a
            elif a.dtype == b.dtype == np.uint8:
                left = a & ~b
                if left.any():
                    out[k] = self._pack(self._members(left).astype(np.int64))
            else:
                left = np.setdiff1d(self._members(a), self._members(b), assume_unique=True)
                if len(left):
                    out[k] = self._pack(left.astype(np.int64))
        return Bitmap(out)

    def plus(self, other: Bitmap) -> Bitmap:
        out = dict(self.parts)
        for k, b in other.parts.items():
            a = out.get(k)
            out[k] = b if a is None else a | b if a.dtype == b.dtype == np.uint8 else self._pack(np.union1d(self._members(a), self._members(b)).astype(np.int64))
        return Bitmap(out)

    def members(self) -> np.ndarray:
        if not self.parts:
            return np.zeros(0, np.int64)
        return np.concatenate([(k << 16) + self._members(p).astype(np.int64) for k, p in sorted(self.parts.items())])

    def __len__(self) -> int:
        return sum(len(p) if p.dtype == np.uint16 else int(np.unpackbits(p).sum()) for p in self.parts.values())
