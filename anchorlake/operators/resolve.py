"""Former ids to the nodes that carry them on, as of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.common import keep, release


def heirs(nodes: DataFrame) -> DataFrame:
    """``former`` and ``heir``: a row for each id in a node's lineage."""
    return nodes.select(F.col("node_id").alias("heir"), F.explode(F.array_distinct("lineage")).alias("former"))


def resolve_as_of(refs: DataFrame, nodes: DataFrame, ref: str = "ref", at: str = "at") -> DataFrame:
    """``refs`` with ``node_id`` and ``via_lineage``, a row for each current node that ``ref`` meant at time ``at``.

    A node of that name counts if it was there by then, if its beginning is unknown, or if the time is unknown and nobody
    inherits the name. Heirs count if no node has the name, if the node's beginning is unknown, or if it began later (or the
    time is unknown). References that mean nothing give no row.
    """
    exact = nodes.select(F.col("node_id").alias("_exact"), F.col("since").alias("_since"))
    known = heirs(nodes)
    some = known.select(F.col("former").alias("_former"), F.lit(True).alias("_inherited")).distinct()
    r = refs.join(exact, F.col(ref) == F.col("_exact"), "left").join(some, F.col(ref) == F.col("_former"), "left")
    inherited = F.coalesce("_inherited", F.lit(False))
    late = F.col(at).isNull() | (F.col(at) < F.col("_since"))
    take_exact = F.col("_exact").isNotNull() & (F.col("_since").isNull() | (F.col(at) >= F.col("_since")) | (F.col(at).isNull() & ~inherited))
    take_heirs = inherited & (F.col("_exact").isNull() | F.col("_since").isNull() | late)
    r = r.withColumn("_e", F.coalesce(take_exact, F.lit(False))).withColumn("_h", F.coalesce(take_heirs, F.lit(False)))
    direct = r.where("_e").select(*refs.columns, F.col("_exact").alias("node_id"), F.lit(False).alias("via_lineage"))
    through = r.where("_h").join(known, F.col(ref) == F.col("former")).select(*refs.columns, F.col("heir").alias("node_id"), F.lit(True).alias("via_lineage"))
    return direct.unionByName(through)


def resolve_now(refs: DataFrame, nodes: DataFrame, ref: str = "ref") -> DataFrame:
    """``refs`` with ``node_id``: the node of that name, else all heirs."""
    exact = refs.join(nodes.select("node_id"), F.col(ref) == F.col("node_id"))
    gone = refs.join(nodes.select(F.col("node_id").alias(ref)), ref, "left_anti").select(*refs.columns)
    return exact.select(*refs.columns, "node_id").unionByName(gone.join(heirs(nodes), F.col(ref) == F.col("former")).select(*refs.columns, F.col("heir").alias("node_id")))


def resolve_entries(refs: DataFrame, nodes: DataFrame, entries: DataFrame, ref: str = "ref", hops: int = 32) -> DataFrame:
    """``refs`` (``node#entry``) with ``entry_id`` and ``node_id`` of the entry now in force, null where there is none.

    Candidates are the entry under the named node and under all heirs; along ``superseded_by`` inside its node an entry is
    followed for at most ``hops`` steps. The named node goes before heirs, a smaller heir before a greater one.
    """
    at = F.col(ref)
    cut = F.length(at) - F.length(F.substring_index(at, "#", -1))
    r = refs.withColumn("_node", F.substring(at, F.lit(1), F.greatest(cut - 1, F.lit(0)))).withColumn("_entry", F.substring_index(at, "#", -1)).where(F.contains(at, F.lit("#")))
    e = chain_ends(entries, hops)
    named = r.join(e, (F.col("_node") == F.col("node_id")) & (F.col("_entry") == F.col("entry_id"))).withColumn("_rank", F.lit(0))
    inherited = r.join(heirs(nodes), F.col("_node") == F.col("former")).join(e, (F.col("heir") == F.col("node_id")) & (F.col("_entry") == F.col("entry_id"))).withColumn("_rank", F.lit(1))
    keep_ = [*refs.columns, "_rank", "node_id", "last_id"]
    return named.select(*keep_).unionByName(inherited.select(*keep_)).groupBy(*refs.columns).agg(F.min(F.struct("_rank", "node_id", "last_id")).alias("_m")).select(*refs.columns, F.col("_m.last_id").alias("entry_id"), F.col("_m.node_id").alias("node_id"))


def chain_ends(entries: DataFrame, hops: int = 32) -> DataFrame:
    """``node_id, entry_id, last_id``: the entry at the end of its node's chain of successors, and ``steps`` to it.

    Pointer doubling: k joins follow 2**k steps, so ``hops`` of 32 take five at most; it ends once no chain grows. Only entries
    that have a successor take part.
    """
    e = entries.select("node_id", "entry_id", "superseded_by")
    here = e.select(F.col("node_id").alias("_n"), F.col("entry_id").alias("_e"))
    link = e.where("superseded_by IS NOT NULL AND superseded_by <> entry_id").join(here, (F.col("node_id") == F.col("_n")) & (F.col("superseded_by") == F.col("_e"))).select("node_id", "entry_id", F.col("superseded_by").alias("last_id"), F.lit(1).alias("steps"))
    link, k = keep(link), 1
    while k < hops:
        b = link.select(F.col("node_id").alias("_n"), F.col("entry_id").alias("_e"), F.col("last_id").alias("_l"), F.col("steps").alias("_s"))
        longer = link.join(b, (F.col("node_id") == F.col("_n")) & (F.col("last_id") == F.col("_e")), "left")
        longer = keep(longer.select("node_id", "entry_id", F.coalesce("_l", "last_id").alias("last_id"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), F.col("_s").isNotNull().alias("_on")))
        grew = not longer.where("_on").isEmpty()
        release(link)
        link, k = longer, k * 2
        if not grew:
            break
    ends = link.select(F.col("node_id").alias("_n"), F.col("entry_id").alias("_e"), "last_id", "steps")
    return e.join(ends, (F.col("node_id") == F.col("_n")) & (F.col("entry_id") == F.col("_e")), "left").select("node_id", "entry_id", F.coalesce("last_id", "entry_id").alias("last_id"), F.coalesce("steps", F.lit(0)).cast("long").alias("steps"))
