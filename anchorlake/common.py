"""Helpers that every plan shares: reading tables, records out of copies, scratch tables and code shipping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
#: While set, Spark drops the shuffle files of a job as it ends. Versions before 4.1 don't know it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim(c: Column | str) -> Column:
    """Drops spaces, tabs and line ends on both sides."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def filled(c: Column | str) -> Column:
    """The trimmed text, null where nothing is left."""
    return F.nullif(trim(c), F.lit(""))


def records(df: DataFrame, key: str, cols: list[str], at: str = "loaded_at") -> DataFrame:
    """One row per key: ``cols`` of its latest copy and ``arrived``, the earliest ``at`` of its copies.

    Copies of one time that differ are ordered by their values, so the result doesn't depend on the order of rows.
    Rows without a key aren't records. A key whose copies have no time at all gets a null ``arrived``.
    The aggregate combines within each input partition first, so a key with very many copies moves as few rows.
    """
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *cols)).alias("_v"), F.min(at).alias("arrived"))
    return picked.select(key, "arrived", *[F.col("_v")[c].alias(c) for c in cols])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master, whose executors are this machine, may go without the setting. A cluster raises, as its executors would
    write to disks of their own and read back a part.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(spark, "_anchorlake_dir", None)
    if made is None:
        made = spark._anchorlake_dir = "file://" + tempfile.mkdtemp(prefix="anchorlake-")
    return made


def _path(spark: SparkSession, at: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts the lineage, survives lost executors.

    The files go when the session ends, or earlier through :func:`release`. ``by``: a column that gets a folder per value. What was
    shuffled for it goes at once, as no later plan reads that.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/anchorlake/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(at, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before)
    path, fs = _path(spark, at)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._kept_at = at
    return out


def release(df: DataFrame) -> None:
    """Drops the files behind a table of :func:`keep` that no later plan reads."""
    if at := getattr(df, "_kept_at", None):
        path, fs = _path(df.sparkSession, at)
        fs.delete(path, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for work that is heavy per row; a scan that has them stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores, key)


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_anchorlake_shipped", False):
        return
    here = Path(__file__).resolve().parent
    fd, at = tempfile.mkstemp(prefix="anchorlake-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(at)
    sc._anchorlake_shipped = True
