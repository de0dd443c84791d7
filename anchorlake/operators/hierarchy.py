"""Parent-child rows to full hierarchies: root, depth, path, descendants and cycles of every node."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.common import keep, release, ship

#: Components of up to so many nodes are walked by one task; larger ones are resolved by pointer doubling alone.
MOST_NODES = 200_000
_WALKED = pa.schema([("id", pa.string()), ("parent", pa.string()), ("root_id", pa.string()), ("depth", pa.int64()), ("path", pa.list_(pa.string())), ("closes_cycle", pa.bool_())])
_DDL = "id string, parent string, root_id string, depth long, path array<string>, closes_cycle boolean"


def _walk(rows: list[tuple[str, str]]) -> Iterator[tuple]:
    """One component, depth first with colours (absent: white, False: grey, True: black).

    ``rows`` are all (id, parent) of the component; a parent that is no id is its root. Yields (id, parent, root, depth, path,
    closes_cycle); the path runs from the root, or from the node of the cycle where the walk entered it.
    """
    up = dict(rows)
    below: dict[str, list[str]] = {}
    for child, parent in rows:
        below.setdefault(parent, []).append(child)
    for root in sorted(set(below) - set(up)):
        stack, colour, path = [(root, iter(sorted(below[root])))], {root: False}, [root]
        while stack:
            node, left = stack[-1]
            child = next(left, None)
            if child is None:
                colour[node] = True
                stack.pop()
                path.pop()
                continue
            colour[child] = False
            path.append(child)
            yield child, node, root, len(path) - 1, list(path), False
            stack.append((child, iter(sorted(below.get(child, ())))))
        for node in colour:
            up.pop(node, None)
    colour: dict[str, bool] = {}
    for start in sorted(up):
        if start in colour:
            continue
        trail, node = [], start
        while node not in colour:
            colour[node] = False
            trail.append(node)
            node = up[node]
        if not colour[node]:  # grey: the edge into it closes a cycle
            cycle = trail[trail.index(node) :]
            least = min(cycle)
            ring = set(cycle)
            at = cycle.index(least)
            order = [least, *reversed(cycle[:at]), *reversed(cycle[at + 1 :])]  # from the smallest id towards children
            place = {x: k for k, x in enumerate(order)}
            todo = [(x, order[: place[x] + 1]) for x in order]
            while todo:
                x, path = todo.pop()
                yield x, up[x], least, -1, path, x == least
                todo.extend((y, [*path, y]) for y in below.get(x, ()) if y not in ring)
        for x in trail:
            colour[x] = True


def _walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components one after the other, as the partition is sorted by component."""

    def components() -> Iterator[list[tuple[str, str]]]:
        of, rows = None, []
        for b in batches:
            for c, child, parent in zip(b["component"].to_pylist(), b["id"].to_pylist(), b["parent"].to_pylist()):
                if c != of and rows:
                    yield rows
                    rows = []
                of = c
                rows.append((child, parent))
        if rows:
            yield rows

    out: list[tuple] = []
    held = 0
    for rows in components():
        for r in _walk(rows):
            out.append(r)
            held += len(r[4])
            if held > 100_000:
                yield _batch(out)
                out, held = [], 0
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), _WALKED)], schema=_WALKED)


def components(links: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """``id``, ``parent``, ``component`` (the root, or the smallest id on the cycle) and ``depth`` (-1 where a cycle is reached).

    ``links`` has one row per ``id`` with a ``parent`` that exists. Every node has one parent, so components are found by pointer
    doubling: each round joins the nodes that haven't reached a root with the table of jumps and doubles the jump. Chains of
    depth d take log2(d) rounds. A round in which no further node reaches a root proves that the rest never will: a node at
    finite depth has an ancestor at the very next depth that would have. The rest is doubled on with the smallest id passed; if
    it is no larger than ``most_nodes``, one task can walk all of it, and it stays together as the component ''.
    """
    jumps = links.select("id", "parent", F.col("parent").alias("to"), F.lit(1).cast("long").alias("far"))
    jumps = jumps.join(links.select(F.col("id").alias("to"), F.lit(False).alias("_top")), "to", "left").select("id", "parent", "to", "far", F.coalesce("_top", F.lit(True)).alias("done"))
    kept = [now := keep(jumps)]
    open_now = now.where(~F.col("done")).count()
    while open_now:
        further = now.select(F.col("id").alias("_i"), F.col("to").alias("_t"), F.col("far").alias("_f"), F.col("done").alias("_d"))
        # Only unfinished nodes jump again; the table they jump through holds all that is known of their targets.
        nxt = now.where(~F.col("done")).join(further, F.col("to") == F.col("_i")).select("id", "parent", F.col("_t").alias("to"), (F.col("far") + F.col("_f")).alias("far"), F.col("_d").alias("done"))
        step = keep(now.where("done").unionByName(nxt))
        still = step.where(~F.col("done")).count()
        release(kept.pop())
        kept.append(step)
        now = step
        if still == open_now:
            break
        open_now = still
    done = now.where("done").select("id", "parent", F.col("to").alias("component"), F.col("far").alias("depth"))
    if not open_now:
        return done
    if open_now <= most_nodes:
        return done.unionByName(now.where(~F.col("done")).select("id", "parent", F.lit("").alias("component"), F.lit(-1).cast("long").alias("depth")))
    ring = now.where(~F.col("done")).select("id", "parent", F.col("parent").alias("to"), F.least("id", "parent").alias("low"))
    for _ in range(math.ceil(math.log2(open_now)) + 1):
        on = ring.select(F.col("id").alias("_i"), F.col("to").alias("_t"), F.col("low").alias("_l"))
        further = keep(ring.join(on, F.col("to") == F.col("_i")).select("id", "parent", F.col("_t").alias("to"), F.least("low", "_l").alias("low")))
        release(ring)
        ring = further
    # The jump now ends on the cycle for certain, and what that node passed is the whole cycle.
    on = ring.select(F.col("id").alias("_i"), F.col("low").alias("component"))
    looped = ring.join(on, F.col("to") == F.col("_i")).select("id", "parent", "component", F.lit(-1).cast("long").alias("depth"))
    return done.unionByName(looped)


def hierarchy(links: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """For each ``id`` with an existing ``parent``: ``root_id``, ``depth``, ``path`` (root first, itself last), ``closes_cycle``.

    ``links`` has one row per ``id``. A node that never reaches a root has depth -1, as root the smallest id on its cycle and as
    path the way from that id along the cycle and down; ``closes_cycle`` marks the row of that smallest id, whose link to its
    parent is the back edge. Empty input gives an empty result; rows with a null id or parent are no links and give no row.

    Components come from pointer doubling. Each component of at most ``most_nodes`` nodes is then sorted together and walked
    depth first by one task. A larger one never meets in one task: its paths are put together by doubling, too.
    """
    ship(links.sparkSession)
    known = keep(components(links.where(F.col("id").isNotNull() & F.col("parent").isNotNull()), most_nodes))
    # At most rows / most_nodes components are large.
    large = known.groupBy("component").count().where(F.col("count") > most_nodes).select("component", F.lit(True).alias("_large"))
    n_large = large.count()
    small = known if not n_large else known.join(large, "component", "left_anti")
    walked = small.select("component", "id", "parent").repartition("component").sortWithinPartitions("component").mapInArrow(_walk_all, _DDL)
    if not n_large:
        return walked
    return walked.unionByName(_long_paths(known.join(large, "component", "left_semi")))


def _long_paths(known: DataFrame) -> DataFrame:
    """Paths of large components, by doubling: a path is the path of the node jumped to and the nodes jumped over."""
    start = F.when(F.col("depth") == -1, F.col("id") == F.col("component")).otherwise(False)
    now = known.select("id", "parent", F.col("component").alias("root_id"), "depth", F.when(start, F.array("id")).otherwise(F.array("parent", "id")).alias("path"), start.alias("closes_cycle"))
    before = None
    while True:
        head = F.col("path")[0]
        now = keep(now)
        if before is not None:
            release(before)
        before = now
        todo = now.where(head != F.col("root_id"))
        if todo.isEmpty():
            return now
        above = now.select(F.col("id").alias("_i"), F.col("path").alias("_p"))
        longer = todo.join(above, F.col("path")[0] == F.col("_i")).select("id", "parent", "root_id", "depth", F.concat("_p", F.slice("path", F.lit(2), F.size("path"))).alias("path"), "closes_cycle")
        now = now.where(head == F.col("root_id")).unionByName(longer)


def descendants(walked: DataFrame) -> DataFrame:
    """``id``, ``descendant`` and ``distance`` (long) for all pairs on a path of :func:`hierarchy`.

    A row for each pair: the descendants of a root that heads a third of all nodes never meet in one array. ``walked`` is read
    several times; make it a stored table. The nodes of a cycle are each other's descendants, but not their own, and all that
    hangs off the cycle descends from each of them; the distance is the number of links on the only way there that passes no node
    twice.
    """
    up = walked.where("depth >= 0").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "id"))
    trees = up.where(F.col("at") < F.col("depth")).select("id", "descendant", (F.col("depth") - F.col("at")).cast("long").alias("distance"))
    looped = walked.where("depth = -1").select("id", "root_id", "path")
    # The path to the parent of the smallest id is the whole cycle, from the smallest id on.
    closing = walked.where("closes_cycle").select("root_id", F.col("parent").alias("id"))
    rings = looped.join(closing, ["root_id", "id"]).select("root_id", F.posexplode("path").alias("place", "id"))
    sizes = rings.groupBy("root_id").agg(F.count("*").alias("ring"))
    # Where the path leaves the cycle: its last node that is on it.
    steps = looped.join(sizes, "root_id").select("root_id", "ring", F.col("id").alias("descendant"), F.size("path").alias("length"), F.posexplode("path").alias("at", "id"))
    marked = steps.join(rings, ["root_id", "id"], "left")
    off = marked.where(F.col("place").isNull()).select("id", "descendant", (F.col("length") - 1 - F.col("at")).cast("long").alias("distance")).where("distance > 0")
    leave = marked.where(F.col("place").isNotNull()).groupBy("root_id", "ring", "descendant", "length").agg(F.max("place").alias("exit"))
    round_ = leave.join(rings, "root_id").select("id", "descendant", (F.pmod(F.col("exit") - F.col("place"), F.col("ring")) + F.col("length") - 1 - F.col("exit")).cast("long").alias("distance"))
    return trees.unionByName(off).unionByName(round_.where("id <> descendant"))
