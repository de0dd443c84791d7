"""Symbols and calls of source files as tables; nodes reconciled with them; the call graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.common import filled, ship
from anchorlake.functions import symbols as S

_SYMBOLS = "file string, lang string, name string, kind string, first_line int, last_line int, signature string, hash string, struct_hash string"


def language(lang, file):
    by_end = F.create_map(*[x for k, v in S.EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.lower(filled(lang)), F.try_element_at(by_end, F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1))))


def texts(files: DataFrame) -> DataFrame:
    """``file, lang, text`` of files with a text, repeated rows once per file (the greatest text, should they differ)."""
    got = files.select("file", language(F.col("lang"), F.col("file")).alias("lang"), F.col("src_text").alias("text")).where("file IS NOT NULL AND text IS NOT NULL")
    return got.groupBy("file").agg(F.max(F.struct("text", "lang")).alias("_m")).select("file", "_m.lang", "_m.text")


def _flat(f, shape: str):
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = [r for x in zip(*(part[c].to_pylist() for c in ("file", "lang", "text"))) for r in f(*x)]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))

    return run


def symbols(files: DataFrame) -> DataFrame:
    """All declarations of all files; files of no known language have none."""
    ship(files.sparkSession)
    kinds = {"first_line": pa.int32(), "last_line": pa.int32()}

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _flat(lambda file, lang, text: [(file, lang, *d) for d in S.declarations(text, lang or "")], _SYMBOLS)(batches):
            yield pa.RecordBatch.from_arrays([b[n].cast(kinds.get(n, pa.string())) for n in b.schema.names], names=b.schema.names)

    return texts(files).mapInArrow(cast, _SYMBOLS)


def generated_files(files: DataFrame) -> DataFrame:
    """``file`` of those that a tool wrote, by the comments at their top."""
    ship(files.sparkSession)
    return texts(files).mapInArrow(_flat(lambda file, lang, text: [(file,)] if S.generated(text) else [], "file string"), "file string")


def admitted(files: DataFrame, include: list[str], exclude: list[str], path: str = "file") -> DataFrame:
    """Files that are sources: outside excluded folders, of a known extension, included (all, if nothing is) and not excluded.

    A pattern that ends in a slash is a prefix, others match the whole path with ``*`` and ``?`` inside a segment.
    """
    at = F.col(path)

    def hit(patterns: list[str]):
        out = F.lit(False)
        for p in patterns:
            out = out | (at.startswith(p) if p.endswith("/") else at.rlike("^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/_" else "\\" + c for c in p) + "$"))
        return out

    skipped = F.arrays_overlap(F.split(at, "/"), F.array(*map(F.lit, ("vendor", "node_modules", "testdata", ".git"))))
    known = F.lower(F.regexp_extract(at, r"\.([^./]+)$", 1)).isin(*S.EXTENSIONS)
    return files.where(known & ~skipped & ~hit(exclude) & (hit(include) if include else F.lit(True)))


# Reconciling


def reconcile(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``node_id, action`` and ``successor`` of old nodes and found symbols.

    Both have ``node_id, hash, struct_hash``; ``nodes`` also ``informed``. Same id and hash: keep; same id, other hash: suspect if
    informed, else refresh. Of the rest, an old and a new node that alone have one structural hash: migrate. Then new symbols:
    create; old nodes: orphan if informed, else drop.
    """
    old = nodes.select("node_id", F.col("hash").alias("_oh"), F.col("struct_hash").alias("_os"), F.col("informed").alias("_i"))
    new = found.select("node_id", F.col("hash").alias("_nh"), F.col("struct_hash").alias("_ns"))
    both = old.join(new, "node_id", "full")
    same = both.where("_oh IS NOT NULL AND _nh IS NOT NULL").select("node_id", F.when(F.col("_oh") == F.col("_nh"), "keep").when(F.col("_i"), "suspect").otherwise("refresh").alias("action"), F.lit(None).cast("string").alias("successor"))
    gone = both.where("_nh IS NULL").select(F.col("node_id").alias("_g"), "_os", "_i")
    come = both.where("_oh IS NULL").select(F.col("node_id").alias("_c"), "_ns")
    lone = lambda df, h, k: df.groupBy(h).agg(F.min(k).alias(k), F.count("*").alias("_k")).where("_k = 1").drop("_k")
    moved = lone(gone, "_os", "_g").join(lone(come, "_ns", "_c"), F.col("_os") == F.col("_ns")).select("_g", "_c")
    left = gone.join(moved, "_g", "left_anti").select(F.col("_g").alias("node_id"), F.when(F.col("_i"), "orphan").otherwise("drop").alias("action"), F.lit(None).cast("string").alias("successor"))
    made = come.join(moved, "_c", "left_anti").select(F.col("_c").alias("node_id"), F.lit("create").alias("action"), F.lit(None).cast("string").alias("successor"))
    return same.unionByName(moved.select(F.col("_g").alias("node_id"), F.lit("migrate").alias("action"), F.col("_c").alias("successor"))).unionByName(left).unionByName(made)


def with_lineage(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """Nodes under their new ids, old ids joined to their lineage (``moved``: node_id, successor)."""
    m = moved.select("node_id", "successor")
    got = nodes.join(m, "node_id", "left")
    return got.withColumn("lineage", F.when(F.col("successor").isNotNull(), F.array_union("lineage", F.array("node_id"))).otherwise(F.col("lineage"))).withColumn("node_id", F.coalesce("successor", "node_id")).drop("successor")


def apply_effects(entries: DataFrame, effects: DataFrame, columns: list[str]) -> DataFrame:
    """Entries with the values of ``effects`` (``entry_id`` and ``columns``, one row each) where there are any."""
    e = effects.select("entry_id", F.struct(*columns).alias("_after"))
    got = entries.join(e, "entry_id", "left")
    return got.select(*[F.when(F.col("_after").isNotNull(), F.col("_after")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in entries.columns])
