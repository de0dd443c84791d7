"""Readers and writers of the knowledge base's files: journals, logs, shards, bundles, vector snapshots."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from anchorlake.common import _path, keep, ship

CHANGE = "id string, nodes array<string>, at timestamp, commit string, task string, what string, why string, rejected array<struct<option: string, reason: string>>, overturns string, rebuttal string, reverts string, author string"
USAGE = "at timestamp, session string, tool string, source string, ok boolean, errCode string, hit boolean, hitStatus string, stale int, warnings int, blocked boolean, ms long"
FINDING = "job string, question string, conclusion string, locations array<string>, plan string, risks array<string>, at timestamp"


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes, bad lines and conflicting ids of a folder of JSON lines.

    Blank lines are passed over; equal lines count once; a line that isn't a JSON object with an id is bad (each distinct one
    once). Different records of one id all stay, and their id is a conflict.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''").distinct()
    got = lines.withColumn("c", F.from_json("line", CHANGE, {"mode": "PERMISSIVE"}))
    fine = F.col("line").startswith("{") & F.col("c.id").isNotNull() & F.get_json_object("line", "$").isNotNull()
    good = got.where(fine).select("c.*")
    return good, got.where(~F.coalesce(fine, F.lit(False))).select("line"), good.groupBy("id").agg(F.count("*").alias("records")).where("records > 1")


def write_journal(changes: DataFrame, path: str) -> None:
    """Adds changes as JSON lines, a folder per month."""
    changes.withColumn("month", F.date_format("at", "yyyy-MM")).write.partitionBy("month").mode("append").json(path)


def read_usage(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The log of tool calls; lines that aren't JSON are passed over."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(USAGE).option("mode", "DROPMALFORMED").json(path).where("tool IS NOT NULL")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINDING).json(path).where("job IS NOT NULL")


def read_dismissed(spark: SparkSession, path: str) -> DataFrame:
    """Ids of debts that nobody wants to see, a line each."""
    return spark.read.text(path).select(F.trim("value").alias("debt")).where("debt <> ''").distinct()


def read_shards(spark: SparkSession, path: str, known: int = 1) -> DataFrame:
    """YAML shards of a folder tree: ``path, state`` (ok, conflict, newer), ``schema`` and ``nodes`` (JSON text).

    A file that doesn't parse is in conflict, one of a later schema is set apart; neither fails the others.
    """
    ship(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for b in batches:
            rows = []
            for at, raw in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                try:
                    doc = yaml.safe_load(raw.decode())
                    version = int(doc.get("schema") or 0)
                    rows.append((at, "newer" if version > known else "ok", version, json.dumps(doc.get("nodes") or [], default=str, sort_keys=True)))
                except Exception:  # noqa: BLE001 - any damage sets the file apart
                    rows.append((at, "conflict", None, None))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["path", "state", "schema", "nodes"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yaml").load(path)
    return files.select("path", "content").mapInArrow(parse, "path string, state string, schema int, nodes string")


def flows_by_name(flows: DataFrame, name: str = "file") -> tuple[DataFrame, DataFrame]:
    """Flows whose file is called as their id and whose id occurs once; and the others with the reason."""
    stem = F.regexp_extract(name, r"([^/]+)\.yaml$", 1)
    twice = flows.groupBy("id").agg(F.count("*").alias("_n"))
    got = flows.join(twice, "id", "left").withColumn("reason", F.when(F.col("id").isNull() | (stem != F.col("id")), "name").when(F.col("_n") > 1, "twice")).drop("_n")
    return got.where("reason IS NULL").drop("reason"), got.where("reason IS NOT NULL")


def listing_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` (added, changed, removed) between two listings with ``path, length, modified``."""
    a, b = old.select("path", F.struct("length", "modified").alias("_a")), new.select("path", F.struct("length", "modified").alias("_b"))
    return a.join(b, "path", "full").select("path", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").alias("change")).where("change IS NOT NULL")


def churn_of_log(spark: SparkSession, path: str) -> DataFrame:
    """``file, touches`` from a log that names a file per line."""
    return spark.read.text(path).select(F.trim("value").alias("file")).where("file <> ''").groupBy("file").agg(F.count("*").alias("touches"))


# Bundles


def collisions(paths: DataFrame) -> DataFrame:
    """``folded, paths``: different paths that are one where letter case doesn't count."""
    return paths.where("path IS NOT NULL").distinct().groupBy(F.lower("path").alias("folded")).agg(F.count("*").alias("paths")).where("paths > 1")


def remap(df: DataFrame, column: str, prefixes: dict[str, str]) -> DataFrame:
    """``df`` with ``mapped``: the longest prefix that applies is replaced, once."""
    out = F.col(column)
    for old in sorted(prefixes, key=len):
        out = F.when(F.col(column).startswith(old), F.concat(F.lit(prefixes[old]), F.substring(column, len(old) + 1, 1_000_000))).otherwise(out)
    return df.withColumn("mapped", out)


class BundleConflict(ValueError):
    """Two journals have different records of one id, or paths collide."""


def merge_journals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both journals, equal records once. Different records of one id raise."""
    both = a.unionByName(b, allowMissingColumns=True).distinct()
    twice = both.groupBy("id").count().where("count > 1").take(1)
    if twice:
        raise BundleConflict(f"records of {twice[0]['id']} differ")
    return both


def export_bundle(tables: dict[str, DataFrame], to: str) -> None:
    """Writes tables as Parquet with a manifest of their columns and counts."""
    manifest = []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{to}/{name}")
        manifest.append((name, df.schema.json(), df.sparkSession.read.parquet(f"{to}/{name}").count()))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(manifest, "name string, schema string, rows long").coalesce(1).write.mode("overwrite").json(f"{to}/manifest")


def import_bundle(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    """The tables of a bundle; counts and columns must be those of its manifest."""
    out = {}
    for r in spark.read.schema("name string, schema string, rows long").json(f"{at}/manifest").collect():
        df = spark.read.parquet(f"{at}/{r['name']}")
        if df.count() != r["rows"] or {f["name"] for f in json.loads(r["schema"])["fields"]} != set(df.columns):
            raise BundleConflict(f"table {r['name']} isn't what the manifest says")
        out[r["name"]] = df
    return out


# Vectors


#: What the deterministic embedder's seed begins with; another one gives other vectors.
FAKE = "anchorlake-fake-v1"


def fake_vector(text: str, size: int, mode: str = "document", name: str = FAKE) -> list[float]:
    """A vector of length 1 that depends on its arguments alone.

    The seed is the SHA-256 of name, mode and text with NULs between; each block is the SHA-256 of the seed and a 64-bit counter,
    read as little-endian 16-bit integers over 32,768.
    """
    seed = hashlib.sha256(f"{name}\x00{mode}\x00{text}".encode()).digest()
    raw = b"".join(hashlib.sha256(seed + struct.pack("<Q", k)).digest() for k in range(-(-2 * size // 32)))
    v = (np.frombuffer(raw[: 2 * size], "<i2").astype(np.float32) / np.float32(32768)).astype(np.float32)
    norm = float((v.astype(np.float64) ** 2).sum())
    return (v * np.float32(1 / np.sqrt(norm))).tolist() if norm else [1.0] + [0.0] * (size - 1)


def embed(texts: DataFrame, size: int, mode: str = "document") -> DataFrame:
    """``id, vec`` of ``id, text`` with the deterministic embedder; a null text is an empty one. Checks what it returns."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fake_vector(t or "", size, mode) for t in b["text"].to_pylist()]
            if any(len(v) != size or not np.isfinite(v).all() or not any(v) for v in got):
                raise ValueError("the embedder returned an unusable vector")
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(got, pa.list_(pa.float32()))], names=["id", "vec"])

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, vec array<float>")


_HEAD = struct.Struct("<8sIIQ16x")
_MAGIC = b"ANCHVEC1"


def encode_snapshot(rows: list[tuple[str, list[float]]]) -> bytes:
    """A snapshot of (id, vector): head of 40 bytes, records, SHA-256 of all before."""
    size = len(rows[0][1]) if rows else 0
    body = _HEAD.pack(_MAGIC, 1, size, len(rows))
    for key, v in rows:
        raw = key.encode()
        body += struct.pack("<I", len(raw)) + raw + np.asarray(v, "<f4").tobytes()
    return body + hashlib.sha256(body).digest()


def decode_snapshot(raw: bytes) -> list[tuple[str, list[float]]]:
    """What :func:`encode_snapshot` wrote; raises on damage, trailing bytes and vectors that aren't of length 1 (within 1e-4)."""
    if len(raw) < _HEAD.size + 32 or hashlib.sha256(raw[:-32]).digest() != raw[-32:]:
        raise ValueError("the snapshot is damaged")
    magic, version, size, n = _HEAD.unpack_from(raw)
    if magic != _MAGIC or version != 1:
        raise ValueError("not a snapshot of this version")
    out, at = [], _HEAD.size
    for _ in range(n):
        (k,) = struct.unpack_from("<I", raw, at)
        key = raw[at + 4 : at + 4 + k].decode()
        v = np.frombuffer(raw, "<f4", size, at + 4 + k)
        if not np.isfinite(v).all() or abs(float((v.astype(np.float64) ** 2).sum()) - 1) > 1e-4:
            raise ValueError(f"the vector of {key} isn't of length 1")
        out.append((key, v.tolist()))
        at += 4 + k + 4 * size
    if at != len(raw) - 32:
        raise ValueError("bytes are left over")
    return out


def ordered_response(items: list[tuple[int, list[float]]], n: int, size: int) -> list[list[float]]:
    """The vectors of an embedder's answer (index, vector) in the order of what was asked.

    Raises unless each index from 0 to n - 1 is there once and all vectors have ``size`` finite components, not all 0.
    """
    if sorted(i for i, _ in items) != list(range(n)):
        raise ValueError("the answer's indexes aren't those that were asked for")
    if any(len(v) != size or not np.isfinite(v).all() or not any(v) for _, v in items):
        raise ValueError("the embedder returned an unusable vector")
    return [v for _, v in sorted(items, key=lambda x: x[0])]


# Working folders

WIP = "owner string, task string, intent string, plan array<string>, done array<string>, todo array<string>, touching array<string>, updated timestamp"


def read_wips(spark: SparkSession, path: str) -> DataFrame:
    """Tasks in work, a JSON file per owner; files without a task are none."""
    return spark.read.schema(WIP).option("mode", "DROPMALFORMED").json(path).where("task IS NOT NULL AND trim(task) <> ''")


def save_wip(spark: SparkSession, path: str, wip: dict) -> None:
    """Puts one owner's task in place of the one before; a reader sees the old or the new one, never a part."""
    name = hashlib.sha256(wip["owner"].encode()).hexdigest()[:24]
    publish(spark, f"{path}/{name}.json", json.dumps(wip, ensure_ascii=False, default=str).encode() + b"\n")


def clear_wip(spark: SparkSession, path: str, owner: str) -> bool:
    at, fs = _path(spark, f"{path}/{hashlib.sha256(owner.encode()).hexdigest()[:24]}.json")
    return fs.delete(at, False)


def publish(spark: SparkSession, path: str, data: bytes, check=None) -> None:
    """Writes a file beside its place, lets ``check(bytes)`` look at what can be read of it, then moves it there in one step."""
    at, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.part")
    fs.mkdirs(at.getParent())
    out = fs.create(part, True)
    out.write(data)
    out.close()
    try:
        if check is not None:
            stream = fs.open(part)
            check(bytes(stream.readAllBytes()))
            stream.close()
        fs.delete(at, False)
        if not fs.rename(part, at):
            raise OSError(f"{path} can't be put in place")
    finally:
        fs.delete(part, False)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a table beside its place and moves it there when it is whole; a failed job leaves the old one."""
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}.part"
    df.write.parquet(beside)
    at, fs = _path(spark, path)
    fs.delete(at, True)
    if not fs.rename(_path(spark, beside)[0], at):
        raise OSError(f"{path} can't be put in place")


def append_changes(changes: DataFrame, path: str) -> None:
    """Adds changes to a journal of one file per month (UTC); each month that gets any is written anew and put in place at once.

    Lines that are there already are kept once; a last line that was torn off stays a bad line of its own, as the new ones begin on
    a new line.
    """
    spark = changes.sparkSession
    lines = changes.where("at IS NOT NULL AND id IS NOT NULL").select(F.date_format("at", "yyyy-MM").alias("month"), F.to_json(F.struct(*changes.columns)).alias("value"), "at", "id")
    for month in sorted(r[0] for r in lines.select("month").distinct().collect()):
        at, fs = _path(spark, f"{path}/{month}.jsonl")
        new = lines.where(F.col("month") == month).select("value", F.lit(1).alias("_new"), "at", "id")
        if fs.exists(at):
            old = spark.read.text(str(at)).where("trim(value) <> ''").select("value", F.lit(0).alias("_new"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("id"))
            new = old.unionByName(new.join(old.select("value"), "value", "left_anti"))
        beside = f"{path}/_{month}.{uuid.uuid4().hex}"
        new.repartition(1).sortWithinPartitions("_new", "at", "id").select("value").write.text(beside)
        (part,) = [f.getPath() for f in fs.listStatus(_path(spark, beside)[0]) if f.getPath().getName().startswith("part-")]
        fs.delete(at, False)
        fs.rename(part, at)
        fs.delete(_path(spark, beside)[0], True)


def in_order(changes: DataFrame) -> DataFrame:
    """A journal by time, then id."""
    return changes.orderBy(F.asc_nulls_first("at"), "id")


def walk(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` of all files below a folder, without hidden folders and files; contents aren't read."""
    root = str(_path(spark, path)[0].toString()).rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    below = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(re.sub("^file:/+", "/", root)) + "/", "")
    return found.select(below.alias("path"), "length", "modified").where(~F.exists(F.split("path", "/"), lambda s: s.startswith(".")))


def staged(working: DataFrame, index: DataFrame) -> DataFrame:
    """``path, deleted`` of all files that the working folder or the index (``path, change``: A, M, D ...) changes, each once.

    A file that either of them has again isn't deleted.
    """
    both = working.select("path", "change").unionByName(index.select("path", "change")).where("path IS NOT NULL")
    return both.groupBy("path").agg(F.min(F.coalesce(F.col("change") == "D", F.lit(False))).alias("deleted"))


def trail(log: DataFrame, n: int = 3, hops: int = 32) -> DataFrame:
    """``file, commit, at, place``: the last ``n`` commits of each present file, those under former names included.

    ``log``: ``commit, at, file`` and ``former``, the name before a rename. Names are followed for ``hops`` renames at most.
    """
    moved = log.where("former IS NOT NULL AND former <> file").groupBy(F.col("former").alias("_f")).agg(F.max_by("file", F.struct("at", "commit")).alias("_t"))
    names = log.select(F.col("file").alias("name")).union(log.where("former IS NOT NULL").select("former")).distinct().withColumn("now", F.col("name"))
    for _ in range(max(1, hops.bit_length())):
        step = names.select(F.col("name").alias("_f"), F.col("now").alias("_n"))
        names = keep(names.join(moved, F.col("now") == F.col("_f"), "left").select("name", F.coalesce("_t", "now").alias("now")))
        moved = keep(moved.join(names.select(F.col("name").alias("_x"), F.col("now").alias("_y")), F.col("_t") == F.col("_x"), "left").select("_f", F.coalesce("_y", "_t").alias("_t")))
    got = log.join(names, F.col("file") == F.col("name")).select(F.col("now").alias("file"), "commit", "at").distinct()
    place = F.row_number().over(W.partitionBy("file").orderBy(F.desc("at"), F.desc("commit")))
    return got.withColumn("place", place).where(F.col("place") <= n)


def remap_nested(df: DataFrame, columns: list[str], prefixes: dict[str, str]) -> DataFrame:
    """``df`` with ids moved wherever they stand: in texts, in arrays of texts, in the ``node`` of arrays of structs; each value once."""

    def to(c):
        out = c
        for old in sorted(prefixes, key=len):
            out = F.when(c.startswith(old), F.concat(F.lit(prefixes[old]), F.substring(c, F.lit(len(old) + 1), F.length(c)))).otherwise(out)
        return out

    cols = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        if f.name not in columns:
            cols.append(F.col(f.name))
        elif kind == "string":
            cols.append(to(F.col(f.name)).alias(f.name))
        elif kind == "array<string>":
            cols.append(F.transform(f.name, to).alias(f.name))
        else:
            cols.append(F.transform(f.name, lambda s: s.withField("node", to(s["node"]))).alias(f.name))
    return df.select(*cols)


def import_plan(current: DataFrame, coming: DataFrame, key: str, force: bool = False) -> DataFrame:
    """``key, action`` of an import: import (not there yet), skip (equal), replace (other, with ``force``) or conflict (other).

    Nothing is written; an import with a conflict isn't carried out.
    """
    cols = sorted(c for c in coming.columns if c != key)
    row = lambda df: df.select(key, F.to_json(F.struct(*cols)).alias("_j")).distinct()
    got = row(coming).join(row(current).withColumnRenamed("_j", "_c"), key, "left")
    return got.select(key, F.when(F.col("_c").isNull(), "import").when(F.col("_c") == F.col("_j"), "skip").otherwise("replace" if force else "conflict").alias("action")).distinct()


def run_within(spark: SparkSession, action, seconds: float):
    """The result of ``action()``; its Spark jobs are cancelled after so many seconds, and TimeoutError is raised."""
    group, late = f"anchorlake-{uuid.uuid4().hex}", threading.Event()
    sc = spark.sparkContext

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "cancellable", True)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"cancelled after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(name, None)
