"""References to records that do not exist, found with bitmaps per key range and period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.common import ship
from anchorlake.functions.bitmap import Bitmap

#: A key range is as many neighbouring keys as have about so many rows.
RANGE_ROWS = 200_000
_FIELDS = "space string, key string, period int, parent_at timestamp"
FAR_PAST, FAR_FUTURE = "0001-01-01 00:00:00", "9999-12-31 23:59:59"


def _period(c):
    return (F.year(c) * 12 + F.month(c)).cast("int")


def _survivors(t: pa.Table) -> pa.Table:
    """One key range: reference bits of each period without the parents that were there before it.

    The range's keys become the integers 0, 1, ...; a reference's bit survives if no parent came in an earlier period.
    What a survivor's parent came with later goes along, for the exact comparison of times.
    """
    names = pc.binary_join_element_wise(t["space"], t["key"], "\x00")
    codes = pc.dictionary_encode(names).combine_chunks()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.chunk(0)
    ids = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    period = t["period"].to_numpy().astype(np.int64)
    parent = t["is_parent"].to_numpy()
    at = np.full(len(codes.dictionary), -1, np.int64)
    at[ids[parent]] = np.flatnonzero(parent)
    first = np.zeros(len(codes.dictionary), np.int64)
    first[ids] = np.arange(len(ids))

    there, before = np.unique(period[parent]), Bitmap()
    k, found, when = 0, [], []
    for p in np.unique(period[~parent]):
        while k < len(there) and there[k] < p:
            before = before.plus(Bitmap.of(ids[parent & (period == there[k])]))
            k += 1
        left = Bitmap.of(ids[~parent & (period == p)]).minus(before).members()
        found.append(left)
        when.append(np.full(len(left), p))
    if not found or not sum(map(len, found)):
        return pa.table({"space": pa.array([], pa.string()), "key": pa.array([], pa.string()), "period": pa.array([], pa.int32()), "parent_at": pa.array([], t["at"].type)})
    bits, when = np.concatenate(found), np.concatenate(when)
    rows = pa.array(first[bits])
    later = pa.array(np.where(at[bits] >= 0, at[bits], 0), mask=at[bits] < 0)
    return pa.table({"space": t["space"].take(rows), "key": t["key"].take(rows), "period": pa.array(when, pa.int32()), "parent_at": t["at"].take(later)})


def _ranges(most: int):
    """Cuts a sorted partition into key ranges, each of whole keys, and holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < most:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = t.slice(n - 1)
            same = pc.and_(pc.equal(t["key"], last["key"][0]), pc.equal(t["space"], last["space"][0]))
            cut = n - pc.sum(same).as_py()
            if cut:
                yield from _survivors(t.slice(0, cut)).to_batches()
                t = t.slice(cut)
            held, n = t.to_batches(), t.num_rows
        if n:
            yield from _survivors(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return run


def orphan_references(refs: DataFrame, parents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows of ``refs`` without a parent that arrived no later.

    ``refs`` has ``space`` (which parents it points at), ``key``, ``at`` and any further columns, all of which come back;
    ``parents`` has ``space``, ``key``, ``at``. A parent with a null ``at`` was always there, a reference with a null ``at``
    accepts any parent. References with a null key or space point nowhere and aren't rows of the result. Either side may be empty or
    repeat rows; repeated rows of ``refs`` come back as often.

    Keys are reduced to one row per period (references) or key (parents) before anything moves, so a key to which a third of all
    references point costs as much as any other. A task holds one key range at a time. The surviving keys then meet the references in an ordinary join that adaptive
    execution splits where it is skewed.
    """
    ship(refs.sparkSession)
    mark = "_"
    while any(c.lower().startswith(mark + "o_") for c in refs.columns):  # further columns keep their names, whatever these are
        mark += "_"
    o_at, o_period, o_space, o_key, o_when, o_parent = (f"{mark}o_{x}" for x in ("at", "period", "space", "key", "when", "parent"))
    refs = refs.where(F.col("key").isNotNull() & F.col("space").isNotNull()).withColumn(o_at, F.coalesce("at", F.to_timestamp(F.lit(FAR_FUTURE)))).withColumn(o_period, _period(F.col(o_at)))
    there = parents.where(F.col("key").isNotNull() & F.col("space").isNotNull()).groupBy("space", "key").agg(F.min(F.coalesce("at", F.to_timestamp(F.lit(FAR_PAST)))).alias("at"))
    asked = refs.groupBy("space", "key", F.col(o_period).alias("period")).agg(F.lit(None).cast("timestamp").alias("at"))
    shape = ["space", "key", "period", F.col("at").cast("timestamp").alias("at")]
    both = there.withColumn("period", _period(F.col("at"))).select(*shape, F.lit(True).alias("is_parent")).unionByName(asked.select(*shape, F.lit(False).alias("is_parent")))
    alone = both.repartition("space", "key").sortWithinPartitions("space", "key").mapInArrow(_ranges(range_rows), _FIELDS)
    alone = alone.select(F.col("space").alias(o_space), F.col("key").alias(o_key), F.col("period").alias(o_when), F.col("parent_at").alias(o_parent))
    hit = refs.join(alone, (F.col("space") == F.col(o_space)) & (F.col("key") == F.col(o_key)) & (F.col(o_period) == F.col(o_when)))
    return hit.where(F.col(o_parent).isNull() | (F.col(o_parent) > F.col(o_at))).drop(o_space, o_key, o_when, o_parent, o_at, o_period)
