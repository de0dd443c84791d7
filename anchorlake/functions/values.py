"""Small functions on values: labels, budgets, compaction, canonical JSON, fingerprints, sets of files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a confidence falls to when its entry moves to another node, and tokens an entry of a level may have (fixed values).
DEMOTED = {"verified": "inferred", "inferred": "suspect", "derived": "suspect"}
HARD_TOKENS = {"project": 300, "dir": 150, "file": 1000, "function": 250, "decl": 250, "stmt": 50}
#: Beyond these a text is only warned of; other levels have no such bound, unknown levels the last hard one (fixed values).
SOFT_TOKENS = {"file": 600}
OTHER_TOKENS = 250


def demoted(confidence: Column) -> Column:
    out = confidence
    for a, b in DEMOTED.items():
        out = F.when(confidence == a, b).otherwise(out)
    return out


def over_budget(tokens: Column, level: Column) -> Column:
    """reject beyond the level's hard bound, warn beyond its soft one, else ok."""
    hard, soft = F.lit(OTHER_TOKENS), F.lit(None).cast("int")
    for name, n in HARD_TOKENS.items():
        hard = F.when(level == name, n).otherwise(hard)
    for name, n in SOFT_TOKENS.items():
        soft = F.when(level == name, n).otherwise(soft)
    return F.when(tokens > hard, "reject").when(tokens > soft, "warn").otherwise("ok")


def change_id(text: Column) -> Column:
    """Whether a text has the shape of a change's id and its time exists."""
    return text.rlike(r"^chg_\d{8}T\d{6}Z_[0-9a-f]{16}$") & F.try_to_timestamp(F.substring(text, 5, 15), F.lit("yyyyMMdd'T'HHmmss")).isNotNull()


def short_id(text: Column, n: int = 12) -> Column:
    return F.substring(text, 1, n)


def shown_edges(edges: Column, file: Column, most: int = 5) -> Column:
    """Ids for display: those of the same file first and as bare symbols, at most ``most``, then how many there are."""
    own = F.array_sort(F.filter(edges, lambda e: F.startswith(e, F.concat(file, F.lit("#")))))
    rest = F.array_sort(F.filter(edges, lambda e: ~F.startswith(e, F.concat(file, F.lit("#")))))
    names = F.concat(F.transform(own, lambda e: F.substring_index(e, "#", -1)), rest)
    tail = F.when(F.size(names) > most, F.array(F.concat(F.lit("total "), F.size(names).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(names, 1, most), tail), ", ")


def compact(text: Column, most: int, mark: str = " ... ") -> Column:
    """Three quarters from the head and a quarter from the tail of a text that is too long, in characters."""
    room = most - len(mark)
    head = room * 3 // 4
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(room - head))))


def compact_bytes(text: str, most: int, mark: str = " ... ") -> str:
    """Halves from head and tail in bytes, whole characters only."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    half = max(0, most - len(mark)) // 2
    return raw[:half].decode(errors="ignore") + mark + (raw[-half:].decode(errors="ignore") if half else "")


def canonical_json(raw: str) -> str:
    """One text for equal JSON: sorted names, no blanks, numbers as they were written."""

    class Num(str):
        pass

    def write(v) -> str:
        if isinstance(v, Num):
            return str(v)
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(write, v)) + "]"
        return json.dumps(v, ensure_ascii=False)

    return write(json.loads(raw, parse_int=Num, parse_float=Num))


def merge_unknown(old, new, known: frozenset[str]):
    """``new`` with the members of ``old`` that this version doesn't know; known members that are absent stay absent.

    Lists of objects are matched by ``id``, else by ``node`` and how often it came before, else by position.
    """
    if isinstance(old, dict) and isinstance(new, dict):
        out = {k: merge_unknown(old[k], v, known) if k in old else v for k, v in new.items()}
        out.update({k: v for k, v in old.items() if k not in new and k not in known})
        return out
    if isinstance(old, list) and isinstance(new, list):
        return [merge_unknown(a, b, known) if a is not None else b for a, b in _matched(old, new)]
    return new


def _matched(old: list, new: list) -> Iterable[tuple]:
    def keys(items: list) -> list:
        seen: dict = {}
        out = []
        for k, x in enumerate(items):
            if isinstance(x, dict) and "id" in x:
                out.append(("id", str(x["id"])))
            elif isinstance(x, dict) and "node" in x:
                n = seen[x["node"]] = seen.get(x["node"], 0) + 1
                out.append(("node", x["node"], n))
            else:
                out.append(("at", k))
        return out

    at = dict(zip(keys(old), old))
    return [(at.get(k), x) for k, x in zip(keys(new), new)]


def vector_fingerprint(v: list[float]) -> str:
    """12 bytes of a hash over the vector on a grid of 1e-4, equal for vectors that differ by rounding alone (but at a grid's edge)."""
    return hashlib.sha256(np.rint(np.asarray(v, np.float64) * 10_000).astype("<i4").tobytes()).hexdigest()[:24]


def tracking_health(tracked: DataFrame, ignored: DataFrame, present: DataFrame) -> DataFrame:
    """One row with the state of a set of files (``path`` each): absent, ignored, partly-ignored, untracked, partly-tracked or tracked."""
    p = present.select("path").distinct().join(tracked.select("path", F.lit(1).alias("_t")).distinct(), "path", "left").join(ignored.select("path", F.lit(1).alias("_i")).distinct(), "path", "left")
    n = p.agg(F.count("*").alias("files"), F.count("_t").alias("tracked"), F.count("_i").alias("ignored"))
    f, t, i = F.col("files"), F.col("tracked"), F.col("ignored")
    return n.withColumn("state", F.when(f == 0, "absent").when(i == f, "ignored").when(i > 0, "partly-ignored").when(t == 0, "untracked").when(t < f, "partly-tracked").otherwise("tracked"))


def stage_problems(nodes: DataFrame, entries: DataFrame, changes: DataFrame, flows: DataFrame) -> DataFrame:
    """``kind, id, target`` of what a staged import refers to and doesn't hold: entries' and changes' nodes, links of changes, steps."""
    known = nodes.select(F.col("node_id").alias("target")).unionByName(nodes.select(F.explode("lineage").alias("target"))).distinct()
    ids = changes.select(F.col("id").alias("target"))
    lost = lambda df, among, kind: df.where("target IS NOT NULL").join(among, "target", "left_anti").select(F.lit(kind).alias("kind"), "id", "target")
    parts = [
        lost(entries.select(F.col("entry_id").alias("id"), F.col("node_id").alias("target")), known, "entry"),
        lost(changes.select("id", F.explode("nodes").alias("target")), known, "change"),
        lost(changes.select("id", F.explode(F.array("overturns", "reverts")).alias("target")), ids, "link"),
        lost(flows.select("id", F.explode("steps.node").alias("target")), known, "step"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
