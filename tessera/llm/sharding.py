"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard.  At each level every child c of the node makes the draw
t = -ln(u) / w, with u in (0, 1) from a hash of (seed, c, key) and w the weight of c's subtree; the
smallest draw wins.  A draw depends on its own child alone, so a changed weight moves documents only
into or out of the subtrees whose weights change.  ``grown`` adds a shard as a region of its own: no
other weight changes, so documents move into the new shard only.

Everything is built from DataFrame functions; a topology is a small constant of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, unit_hash

#: Hex digits of a hash that split the rows of a shard into 16^3 slot ranges.
SLOT_DIGITS = 3


@dataclass(frozen=True)
class Topology:
    """Leaves as (region, rack, shard, weight); names are integers, weights are positive."""

    leaves: tuple[tuple[int, int, int, float], ...]

    def __post_init__(self):
        if not self.leaves or any(w <= 0 for *_, w in self.leaves):
            raise ValueError("a topology has at least one shard and positive weights")
        if len({s for _, _, s, _ in self.leaves}) < len(self.leaves):
            raise ValueError("a shard stands in one place")

    @staticmethod
    def grid(regions: int, racks: int, shards: int) -> Topology:
        """Equal weights: so many regions of so many racks of so many shards."""
        n = iter(range(regions * racks * shards))
        return Topology(tuple((r, k, next(n), 1.0) for r in range(regions) for k in range(racks) for _ in range(shards)))

    def grown(self, weight: float = 1.0) -> Topology:
        """With one more shard, alone in a new region."""
        return Topology((*self.leaves, (max(r for r, *_ in self.leaves) + 1, 0, max(s for _, _, s, _ in self.leaves) + 1, weight)))


def _descend(key: Column, seed: int, leaves: list[tuple], level: int, path: str) -> Column:
    """The shard that the key reaches below one node; leaves: those of the node."""
    if level == 3:
        return F.lit(leaves[0][2])
    children = sorted({leaf[level] for leaf in leaves})
    below = {c: [leaf for leaf in leaves if leaf[level] == c] for c in children}
    shard = {c: _descend(key, seed, below[c], level + 1, f"{path}/{c}") for c in children}
    if len(children) == 1:
        return shard[children[0]]
    draws = []
    for c in children:
        u = (unit_hash(seed, f"{path}/{c}", key) + F.lit(0.5)) / F.lit(2.0**52)
        draws.append(F.struct((-F.log(u) / F.lit(float(sum(w for *_, w in below[c])))).alias("t"), F.lit(c).alias("c")))
    won = F.least(*draws)["c"]
    out = F.lit(None).cast("int")
    for c in reversed(children):
        out = F.when(won == c, shard[c]).otherwise(out)
    return out


def place(key: Column, topology: Topology, seed: int = 7) -> Column:
    """The shard of a key."""
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), seed, list(topology.leaves), 0, "")


def shard(docs: DataFrame, topology: Topology, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text plus 1; a null text has size 1 and a null text_crc32.  A
    null doc_id is a key like any other.  slot numbers the rows of a shard from 0 without gaps;
    rows of a shard are ordered by a hash range of the id, then id, size and crc, so rows that are
    repeated whole get slots side by side.  An empty table gives an empty result; other columns are
    ignored.

    Slots are numbered without sorting a shard in one task: rows are ordered within (shard, range)
    and start at the number of rows in the shard's earlier ranges.  Those numbers are shards times
    4096 rows, so they are broadcast.
    """
    text, key = F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        place(F.col("doc_id"), topology, seed).alias("shard"),
        place(F.col("doc_id"), topology.grown(), seed).alias("grown_shard"),
        F.substring(F.md5(F.concat(F.lit("slot|"), key)), 1, SLOT_DIGITS).alias("part"),
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        docs.select(place(F.col("doc_id"), topology, seed).alias("shard"), F.substring(F.md5(F.concat(F.lit("slot|"), key)), 1, SLOT_DIGITS).alias("part"))
        .groupBy("shard", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("rn", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rn") - 1).alias("slot"), "grown_shard")
    )
