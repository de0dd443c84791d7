"""Schemas that drift between files: every change with the file that shows it first, and one consistent table."""

from __future__ import annotations

import difflib
import hashlib
import itertools
import json
import sys
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.common import keep, shared_dir, ship

#: Between the steps of a path; can't occur in a JSON text's decoded names except as an escaped control character.
_SEP = "\x1f"


class _Int(str):
    """A number written without a fraction."""


class _Dec(str):
    """A number written with a fraction."""


def _refuse(word: str):
    raise ValueError(word)


def read_object(raw: str | None) -> dict | None:
    """The JSON object that ``raw`` is, numbers as written; None for anything else."""
    if not raw:
        return None
    try:
        out = json.loads(raw, parse_int=_Int, parse_float=lambda s: _Dec(s) if "." in s else _Int(s), parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def kind_of(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, _Int):
        return "integer"
    if isinstance(v, _Dec):
        return "decimal"
    if isinstance(v, str):
        return "string"
    return "object" if isinstance(v, dict) else "array"


def fields_of(obj: dict) -> dict[tuple[str, ...], str]:
    """Path to type of all members at any depth; '' is null. Objects of an array count together: the first type that isn't null."""
    out: dict[tuple[str, ...], str] = {}
    todo: list[tuple[tuple[str, ...], dict]] = [((), obj)]
    while todo:
        at, o = todo.pop(0)
        for name, v in o.items():
            path = (*at, name)
            out[path] = out.get(path) or kind_of(v)
            while isinstance(v, list):
                path = (*path[:-1], path[-1] + "[]")
                todo.extend((path, x) for x in v if isinstance(x, dict))
                v = [y for x in v if isinstance(x, list) for y in x] or None
            if isinstance(v, dict):
                todo.append((path, v))
    return out


def match_fields(gone: dict, come: dict, lone_only: bool = True) -> list[tuple]:
    """Pairs (old, new) of one parent's fields that are renames. ``gone`` and ``come``: field to type.

    Both versions' fields are matched one to one such that the total worth of the pairs is greatest (Hungarian method). A pair
    has worth only if its types are known and equal, and the more, the more alike its names are. ``lone_only``: of the matching,
    only a pair that has no other field beside it is a rename, whatever its names; otherwise a pair that has, needs like names.
    """
    rows, cols = sorted(gone), sorted(come)
    worth = [[1 + difflib.SequenceMatcher(None, a[-1], b[-1]).ratio() if gone[a] and gone[a] == come[b] else -1.0 for b in cols] for a in rows]
    matched = [(rows[i], cols[j], worth[i][j]) for i, j in assign(worth) if worth[i][j] > 0]
    lone = len(rows) == len(cols) == 1
    return [(a, b) for a, b, w in matched if lone or (not lone_only and w >= 1.5)]


def assign(worth: list[list[float]]) -> list[tuple[int, int]]:
    """The matching of rows to columns of greatest total worth (Hungarian method)."""
    n, m = len(worth), len(worth[0]) if worth else 0
    if not n or not m:
        return []
    if n > m:
        return [(i, j) for j, i in assign([list(c) for c in zip(*worth)])]
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while owner[j0]:
            used[j0], i0, delta, j1 = True, owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = -worth[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return sorted((owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j])


def changes_between(known: dict, now: dict, lone_only: bool = True) -> Iterator[tuple[tuple, str, tuple | None]]:
    """(field, drift, old field of a rename) from a file to the next. ``known``: the fields there with their last known type."""
    moved = {p for p in known.keys() - now.keys()} | {p for p in now.keys() - known.keys()}
    retyped = {p for p in known.keys() & now.keys() if now[p] and known[p] and now[p] != known[p]}
    touched = moved | retyped

    def inside(p: tuple) -> bool:
        return any((*p[: k - 1], base) in touched for k in range(1, len(p)) for base in _names(p[k - 1]))

    at: dict[tuple, tuple[dict, dict]] = {}
    for p in touched:
        if inside(p):
            continue
        if p in retyped:
            yield p, "retyped", None
        elif p in known:
            at.setdefault(p[:-1], ({}, {}))[0][p] = known[p]
        else:
            at.setdefault(p[:-1], ({}, {}))[1][p] = now[p]
    for gone, come in at.values():
        pairs = match_fields(gone, come, lone_only)
        for a, b in pairs:
            del gone[a], come[b]
            yield b, "renamed", a
        yield from ((p, "removed", None) for p in gone)
        yield from ((p, "added", None) for p in come)


def _names(step: str) -> Iterator[str]:
    """The member behind a step of a path: ``steps[]`` lies inside ``steps``."""
    yield step
    while step.endswith("[]"):
        step = step[:-2]
        yield step


def _pack(fields: dict) -> tuple[list[str], list[str]]:
    paths = sorted(fields)
    return [_SEP.join(p) for p in paths], [fields[p] for p in paths]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [None if (o := read_object(raw)) is None else _pack(fields_of(o)) for raw in b["raw"].to_pylist()]
        ok = pa.array([x is not None for x in packed])
        rest = b.select(["stream", "written_at", "file_id"]).filter(ok)
        packed = [x for x in packed if x is not None]
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([x[0] for x in packed], pa.list_(pa.string())), pa.array([x[1] for x in packed], pa.list_(pa.string()))], names=["stream", "written_at", "file_id", "paths", "types"])


def _files(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(stream, file_id, fields) in order, each file once."""
    last = None
    for b in batches:
        for key in zip(b["stream"].to_pylist(), b["written_at"].to_pylist(), b["file_id"].to_pylist(), b["paths"].to_pylist(), b["types"].to_pylist()):
            if key[:3] != last:
                last = key[:3]
                yield key[0], key[2], {tuple(p.split(_SEP)): t for p, t in zip(key[3], key[4])}


#: The type of a field that has been null in all files of the stretch seen so far: what was known before holds.
_AS_BEFORE = "?"


def _advance(known: dict, now: dict) -> dict:
    return {p: t or known.get(p, "") for p, t in now.items()}


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition leaves to the next one: its first and last stream, and the last one's known fields at the end."""
    first = stream = None
    known, any_file, from_start = {}, False, True
    for s, _, now in _files(batches):
        if not any_file:
            first, any_file, stream = s, True, s
            known = {p: t or _AS_BEFORE for p, t in now.items()}
            continue
        if s != stream:
            stream, known, from_start = s, {}, False
        known = _advance(known, now)
    if any_file:
        paths, types = _pack(known)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first], pa.string()), "last": pa.array([stream], pa.string()), "whole": pa.array([from_start]), "paths": pa.array([paths], pa.list_(pa.string())), "types": pa.array([types], pa.list_(pa.string()))})


def _carry(ends: list) -> tuple[dict[int, tuple[str | None, int]], list[tuple]]:
    """Partition to (stream, number of its state) at its start, and the states: known fields as (paths, types), each once.

    Streams and partitions have few schemas between them, so what every task is given hardly grows with the partitions.
    """
    out, states, stream, known = {}, {}, None, None
    for r in sorted(ends, key=lambda r: r["part"]):
        if known is not None:
            paths, types = _pack(known)
            out[r["part"]] = (stream, states.setdefault((tuple(paths), tuple(types)), len(states)))
        before = known if known is not None and stream == r["first"] and r["whole"] else {}
        fields = {tuple(p.split(_SEP)): t for p, t in zip(r["paths"], r["types"])}
        stream, known = r["last"], {p: before.get(p, "") if t == _AS_BEFORE else t for p, t in fields.items()}
    return out, list(states)


def _drifts(starts: dict, states: list, lone_only: bool, between: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, at = starts.get(TaskContext.get().partitionId(), (None, None))
        known = None if at is None else {tuple(p.split(_SEP)): t for p, t in zip(*states[at])}
        out = []
        for s, file_id, now in _files(batches):
            if known is not None and s == stream:
                if known.keys() != now.keys() or any(t and known[p] and t != known[p] for p, t in now.items()):
                    out.extend((s, file_id, between.join(p), how, between.join(was) if was else None) for p, how, was in changes_between(known, now, lone_only))
                known = _advance(known, now)
            else:
                stream, known = s, _advance({}, now)
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:]]], names=["stream", "file_id", "field", "drift", "was"])


def drifts(files: DataFrame, lone_only: bool = True, parts: int | None = None, between: str = ".") -> DataFrame:
    """``stream``, ``file_id``, ``field``, ``drift`` (added, removed, retyped, renamed) and ``was``, a rename's old field.

    ``files`` has ``stream``, ``written_at``, ``file_id``, ``raw``; other columns don't matter. Files whose ``raw`` isn't a JSON
    object are no versions. Null streams are one stream, null times come first, repeated rows count once. A stream's first file
    gives no row. ``between`` stands between the steps of a path. Rows have no duplicates within a file. Names that are equal but for letter case are different fields.

    Files are reduced to their fields, sorted over all partitions by stream, time and id, and read once in that order, so a
    stream of any length spreads over many tasks. What a partition must know of the stream it continues (the fields there and
    their last known types) is put together from one summary row per partition; these are as long as a schema, not as a stream.
    """
    spark = files.sparkSession
    ship(spark)
    parsed = keep(files.select("stream", "written_at", F.col("file_id").cast("long").alias("file_id"), "raw").mapInArrow(_parse, "stream string, written_at timestamp, file_id long, paths array<string>, types array<string>"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    order = [F.col(c).asc_nulls_first() for c in ("stream", "written_at", "file_id")]
    sorted_files = parsed.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint()
    ends = sorted_files.mapInArrow(_ends, "part int, first string, last string, whole boolean, paths array<string>, types array<string>").collect()
    return sorted_files.mapInArrow(_drifts(*_carry(ends), lone_only, between), "stream string, file_id long, field string, drift string, was string")


# One consistent table


def written(v) -> str:
    """JSON text of a value, numbers as they were written, members by name."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (_Int, _Dec)):
        return str(v)
    if isinstance(v, dict):
        return "{" + ", ".join([f"{json.dumps(k, ensure_ascii=False)}: {written(v[k])}" for k in sorted(v)]) + "}"
    if isinstance(v, list):
        return "[" + ", ".join([written(x) for x in v]) + "]"
    return json.dumps(v, ensure_ascii=False)


def _text(v) -> str | None:
    """A value as text: as written, strings without quotes."""
    return None if v is None else str(v) if isinstance(v, str) else written(v)


def members_of(obj: dict, nested: bool) -> Iterator[tuple[tuple[str, ...], object]]:
    """(path, value) of all members, as in :func:`fields_of`, and of all members of arrays (``steps[]``); top level only without ``nested``."""
    todo: list[tuple[tuple[str, ...], object]] = [((name,), v) for name, v in obj.items()]
    while todo:
        path, v = todo.pop()
        yield path, v
        if nested and isinstance(v, dict):
            todo.extend(((*path, name), x) for name, x in v.items())
        elif nested and isinstance(v, list):
            todo.extend(((*path[:-1], path[-1] + "[]"), x) for x in v)


def _pack_path(path: tuple[str, ...]) -> str:
    """One text per path; that of the whole object is empty, that of a member without a name isn't."""
    return "".join([_SEP + step for step in path])


#: Values kept in a field's sketch: those of smallest hash.
SKETCH = 32
_PROFILE = "parent string, field string, other string, n long, types array<string>, sketch array<long>"


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _least(hashes: Iterable[int]) -> set[int]:
    return set(sorted(hashes)[:SKETCH])


def overlap(s: set[int], t: set[int]) -> float:
    """Estimated share of values that two fields have in common, of their union: the smallest hashes of both are a sample of it."""
    union = _least(s | t)
    return len(union & s & t) / len(union) if union else 0.0


def _profile(nested: bool, renamed: set[tuple[str, str]]):
    """One row per field and partition (types and a sketch of values), and one per two of ``renamed`` that a file has together (``other``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[tuple[str, ...], list] = {}
        pairs: set[tuple[str, str, str]] = set()
        for b in batches:
            for raw in b["raw"].to_pylist():
                here: dict[str, set[str]] = {}
                once = set()
                for path, v in members_of(read_object(raw) or {}, nested):
                    at = fields.setdefault(path, [0, set(), set()])
                    at[1].add(kind_of(v))
                    if v is not None and not isinstance(v, (dict, list)):
                        at[2].add(_hash(_text(v)))
                        if len(at[2]) > 8 * SKETCH:
                            at[2] = _least(at[2])
                    if path not in once:
                        once.add(path)
                        at[0] += 1
                        parent = _pack_path(path[:-1])
                        if (parent, path[-1]) in renamed:
                            here.setdefault(parent, set()).add(path[-1])
                for parent, names in here.items():
                    pairs.update((parent, x, y) for x, y in itertools.combinations(sorted(names), 2))
        out = [(_pack_path(p[:-1]), p[-1], None, n, sorted(types), sorted(_least(seen))) for p, (n, types, seen) in fields.items()]
        out += [(*pair, 0, [], []) for pair in sorted(pairs)]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["parent", "field", "other", "n", "types", "sketch"])

    return run


def profiles(files: DataFrame, nested: bool = True, renamed: set[tuple[str, str]] = frozenset()) -> tuple[dict, set]:
    """{(parent, field): {n, types, sketch}} and {(parent, field, field)} of ``renamed`` that a file has together.

    ``n`` counts files; the sketch has the smallest hashes of distinct values that are no objects and no arrays.
    """
    fields: dict[tuple[str, str], dict] = {}
    together = set()
    rows = files.select("raw").mapInArrow(_profile(nested, renamed), _PROFILE)
    merged = rows.groupBy("parent", "field", "other").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH).alias("sketch"))
    for r in merged.collect():
        if r["other"] is not None:
            together.add((r["parent"], r["field"], r["other"]))
        else:
            fields[r["parent"], r["field"]] = {"n": r["n"], "types": set(r["types"]), "sketch": set(r["sketch"])}
    return fields, together


def is_rename(sighted: int, gone: int, come: int, files: int, alike: float, shared: float) -> bool:
    """Whether sightings of one field in another's place are more than chance.

    ``sighted``: how often the old name went as the new one came; ``gone`` and ``come``: how often the old went and the new came
    at all; ``files``: in how many it could have happened. Names that are ``alike`` or values that are ``shared`` settle it, and
    so does a pair that only ever went and came together. Otherwise there must be clearly more sightings than fields that come
    and go independently of each other have.
    """
    if alike >= 0.6 or shared >= 0.5 or sighted == gone == come:
        return True
    chance = gone * come / max(1, files)
    return sighted > 1 and sighted > chance + 3 * chance**0.5


def canonical_names(seen: dict, moves: list, together: set[tuple[str, str, str]]) -> dict[tuple[str, str], str]:
    """(parent, field) to the name it has in the unified table; a parent is a path as one text.

    ``seen``: fields as of :func:`profiles`; ``moves``: (parent, drift, was, field, n) seen between files; ``together``:
    (parent, field, field) that some file has both. Versions of one stream were matched one to one; over streams a field may have
    many names. All pairs that :func:`is_rename` accepts are joined, those of greatest sum of sightings' share, name similarity
    and sketch overlap first, except that names that any file has together are never joined, nor groups that hold such names. A
    group has the name with most rows.
    """
    names = {k: k[1] for k in seen}
    for kind in sorted({k for k, _ in seen}):
        mine = [m[1:] for m in moves if m[0] == kind]
        pairs, gone, come = Counter(), Counter(), Counter()
        for drift, was, field, n in mine:
            if drift == "renamed" and (kind, was) in seen and (kind, field) in seen:
                pairs[was, field] += n
            if drift in ("removed", "renamed"):
                gone[was or field] += n
            if drift in ("added", "renamed"):
                come[field] += n
        if not pairs:
            continue
        files = max(seen[kind, f]["n"] for k, f in seen if k == kind)
        apart = {(a, b) for k, a, b in together if k == kind} | {(b, a) for k, a, b in together if k == kind}

        def worth(a: str, b: str) -> float:
            if a == b or (a, b) in apart:
                return -1.0
            s, t = seen[kind, a]["sketch"], seen[kind, b]["sketch"]
            shared = overlap(s, t)
            alike = difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
            # Few values, as of booleans, are shared by fields that have nothing to do with each other.
            if not is_rename(pairs[a, b], gone[a], come[b], files, alike, shared if min(len(s), len(t)) >= 8 else 0.0):
                return -1.0
            return pairs[a, b] / gone[a] + alike + shared

        groups = {f: {f} for k, f in seen if k == kind}
        ranked = sorted((-w, a, b) for a, b in pairs if (w := worth(a, b)) >= 0)
        for _, a, b in ranked:
            left, right = groups[a], groups[b]
            if left is not right and not any((x, y) in apart for x in left for y in right):
                for f in (joined := left | right):
                    groups[f] = joined
        for f, group in groups.items():
            names[kind, f] = max(group, key=lambda x: (seen[kind, x]["n"], x))
    return names


def canonical_paths(seen: dict, moves: list, together: set[tuple[str, str, str]]) -> dict[str, tuple[str, ...]]:
    """Path of each field to its path in the unified table, each path as one text. Arguments as in :func:`canonical_names`.

    Names are joined from the top down, so that members of one object under two names are joined as well.
    """
    to: dict[str, tuple[str, ...]] = {"": ()}
    for level in range(max((p.count(_SEP) for p, _ in seen), default=0) + 1):
        mine = [k for k in seen if k[0].count(_SEP) == level]
        real = [(p, f) for p, f in mine if not any((p, base) in seen for base in list(_names(f))[1:])]
        merged: dict[tuple[str, str], dict] = {}
        for p, f in real:
            at = merged.setdefault((_pack_path(to[p]), f), {"n": 0, "sketch": set()})
            at["n"] += seen[p, f]["n"]
            at["sketch"] = _least(at["sketch"] | seen[p, f]["sketch"])
        names = canonical_names(merged, [(_pack_path(to[m[0]]), *m[1:]) for m in moves if m[0].count(_SEP) == level and m[0] in to], {(_pack_path(to[p]), a, b) for p, a, b in together if p.count(_SEP) == level})
        for p, f in real:
            to[p + _SEP + f] = (*to[p], names[_pack_path(to[p]), f])
        for p, f in sorted(set(mine) - set(real), key=lambda k: len(k[1])):
            above = to[p + _SEP + f[:-2]]
            to[p + _SEP + f] = (*above[:-1], above[-1] + "[]")
    return to


def unify(v, path: str, to: dict[str, tuple[str, ...]], types: dict[tuple[str, ...], str]):
    """A value with all members under their names of the unified table; what is of a mixed type there, as text."""
    if isinstance(v, dict):
        v = {to[at][-1]: unify(x, at, to, types) for name, x in v.items() for at in [path + _SEP + name]}
    elif isinstance(v, list):
        v = [unify(x, path + "[]", to, types) for x in v]
    return _text(v) if types[to[path]] == "string" else v


def _table(to: dict[str, tuple[str, ...]] | None, types: dict[tuple[str, ...], str], at: dict[str, int], width: int):
    """Each file's top-level values as text in the columns that ``at`` gives for their fields, objects and arrays as JSON; their
    members unified if ``to`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))  # as deep as the reader goes
        for b in batches:
            ids, rows = [], []
            for file_id, raw in zip(b["file_id"].to_pylist(), b["raw"].to_pylist()):
                obj = read_object(raw)
                if not obj:
                    continue
                row: list[str | None] = [None] * width
                for name, v in obj.items():
                    if v is None:
                        continue
                    if to is not None:
                        row[at[name]] = _text(unify(v, _SEP + name, to, types))
                    else:
                        row[at[name]] = json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, (dict, list)) else _text(v)
                ids.append(file_id)
                rows.append(row)
            cols = list(zip(*rows)) or [()] * width
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.string()) for c in cols]], names=["file_id", *[f"c{k}" for k in range(width)]])

    return run


def column_type(kinds: set[str]) -> str:
    """The narrowest type that holds all values; object and array stay what they are inside JSON text."""
    kinds = kinds - {""}
    if kinds == {"integer"}:
        return "decimal(38,0)"
    if kinds and kinds <= {"integer", "decimal"}:
        return "double"
    return next(iter(kinds)) if len(kinds) == 1 else "string"


def unified(files: DataFrame, kind: str, nested: bool = False) -> DataFrame:
    """All files of one kind of document as one table: ``file_id`` and a column per top-level field after renames.

    A column's type holds all values that any file has there (integers that mix with fractions become double, other mixtures
    text; objects and arrays are JSON text). With ``nested``, the same goes for members at any depth, also of objects in arrays:
    inside JSON text each has one name and one type, numbers are written as in the file and mixtures are strings. Without it,
    JSON text has the members' own names and all its numbers are strings. Files that are no JSON objects give no row; repeated
    rows count once. Names that any file has together stay two, so no value is left out for another. A field called ``file_id``
    in the files gets a trailing underscore, and so do fields that clash but for letter case. Only schemas come to the driver.
    """
    ship(files.sparkSession)
    mine = files.where(F.col("doc_kind") == kind)
    moves = []
    for r in drifts(mine, lone_only=False, between=_SEP).groupBy("drift", "was", "field").agg(F.count("*").alias("n")).collect():
        parent, _, field = (_SEP + r["field"]).rpartition(_SEP)
        if nested or not parent:
            moves.append((parent, r["drift"], r["was"] and r["was"].rpartition(_SEP)[2], field, r["n"]))
    seen, together = profiles(mine, nested, {(m[0], f) for m in moves if m[1] == "renamed" for f in m[2:4]})
    to = canonical_paths(seen, moves, together)
    kinds: dict[tuple[str, ...], set[str]] = {}
    for (p, f), at in seen.items():
        kinds.setdefault(to[p + _SEP + f], set()).update(at["types"])
    types = {path: column_type(k) for path, k in kinds.items()}
    wanted: dict[str, list[str]] = {}
    for p, f in seen:
        if not p and not (f.endswith("[]") and (p, f[:-2]) in seen):
            wanted.setdefault(to[_SEP + f][0], []).append(f)
    order = sorted(wanted)
    at = {f: k for k, name in enumerate(order) for f in wanted[name]}
    once = mine.where("raw IS NOT NULL").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.max("raw").alias("raw"))
    shape = ", ".join(["file_id long", *[f"c{k} string" for k in range(len(order))]])
    rows = once.mapInArrow(_table(to if nested else None, types, at, len(order)), shape)
    taken, cols = {"file_id"}, [F.col("file_id")]
    for k, name in enumerate(order):
        shown = name
        while shown.lower() in taken:
            shown += "_"
        taken.add(shown.lower())
        t = types[name,]
        cols.append(F.col(f"c{k}").try_cast("string" if t in ("object", "array") else t).alias(shown))
    return rows.select(*cols)
