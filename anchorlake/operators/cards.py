"""Cards: what is known of a node in each lane, as texts of bounded size for semantic search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.common import filled, ship
from anchorlake.operators.journal import touched
from anchorlake.operators.resolve import resolve_as_of

#: Bytes of a card.
ROOM = 3072
_ITEM = "lane string, node_id string, facet string, reference string, text string"


def items(nodes: DataFrame, laned: DataFrame, changes: DataFrame, off: DataFrame, flows: DataFrame) -> DataFrame:
    """``lane, node_id, facet, reference, text``, each once.

    Entries lie in their lane; decisions of changes in history; options they rejected in risk while the change is in effect, else
    in history; notes of flow steps in current, or in risk where the node is orphaned or suspect.
    """
    entry = laned.select("lane", "node_id", F.coalesce("kind", F.lit("note")).alias("facet"), F.col("entry_id").alias("reference"), "text")
    at = resolve_as_of(touched(changes), nodes).select("id", "node_id").distinct()
    said = changes.select("id", F.concat_ws("\n", filled("what"), filled("why")).alias("text"), "rejected").join(off.withColumn("_off", F.lit(True)), "id", "left")
    told = at.join(said, "id")
    decision = told.where("text <> ''").select(F.lit("history").alias("lane"), "node_id", F.lit("decision").alias("facet"), F.col("id").alias("reference"), "text")
    option = told.select("id", "node_id", F.coalesce("_off", F.lit(False)).alias("_off"), F.explode("rejected").alias("_r")).withColumn("_o", filled("_r.option")).where("_o IS NOT NULL")
    rejected = option.select(F.when(F.col("_off"), "history").otherwise("risk").alias("lane"), "node_id", F.lit("rejected").alias("facet"), F.col("id").alias("reference"), F.concat_ws("\n", "_o", filled("_r.reason")).alias("text"))
    noted = flows.where("NOT deprecated").select("id", "since", F.explode("steps").alias("_s")).select("id", filled("_s.node").alias("ref"), F.coalesce("_s.since", "since").alias("at"), filled("_s.note").alias("text")).where("ref IS NOT NULL AND text IS NOT NULL")
    step = resolve_as_of(noted, nodes).join(nodes.select("node_id", "status"), "node_id").select(F.when(F.col("status").isin("orphaned", "suspect"), "risk").otherwise("current").alias("lane"), "node_id", F.lit("flow").alias("facet"), F.col("id").alias("reference"), "text")
    return entry.unionByName(decision).unionByName(rejected).unionByName(step).where("text <> ''").distinct()


def _cut(text: str, room: int) -> str:
    """The head and the tail of a text that has more bytes than there is room for, whole characters only."""
    raw = text.encode()
    if len(raw) <= room:
        return text
    half = (room - 5) // 2
    return raw[:half].decode(errors="ignore") + " ... " + raw[-half:].decode(errors="ignore")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, n, held, size, out = None, 0, [], 0, []

    def close() -> None:
        nonlocal n, held, size
        if held:
            out.append((f"card:{at[0]}:{at[1]}:{n:04}", at[0], at[1], "\n".join(held)))
            n, held, size = n + 1, [], 0

    for b in batches:
        for lane, node, text in zip(b["lane"].to_pylist(), b["node_id"].to_pylist(), b["text"].to_pylist()):
            if (lane, node) != at:
                close()
                at, n = (lane, node), 0
            text = _cut(text, ROOM)
            more = len(text.encode()) + bool(held)
            if size + more > ROOM:
                close()
                more = len(text.encode())
            held.append(text)
            size += more
        if len(out) > 2000:
            yield pa.RecordBatch.from_pydict(dict(zip(("record_id", "lane", "node_id", "text"), map(list, zip(*out)))))
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(("record_id", "lane", "node_id", "text"), map(list, zip(*out)))))


def cards(items_: DataFrame) -> DataFrame:
    """``record_id, lane, node_id, text``: items of a lane and node in order of facet, reference and text, packed one after the
    other into cards of at most 3 KiB; an item that is longer alone keeps its head and tail.

    Packing reads a sorted partition as a stream and holds one card, so a node with very many items is no burden.
    """
    ship(items_.sparkSession)
    order = ["lane", "node_id", "facet", "reference", "text"]
    s = items_.select(*order).distinct().repartition("lane", "node_id").sortWithinPartitions(*order)
    return s.mapInArrow(_pack, "record_id string, lane string, node_id string, text string").withColumn("source_hash", F.sha2("text", 256))
