"""Sharding by bytes: an ordered row of groups is cut into contiguous shards of the smallest possible capacity.

Documents of equal text are one group and stay together. A document's size is the
number of its text's UTF-8 bytes plus one. Groups are ordered by their smallest id
(nulls last), then by the digest of their text.

1. Giants. A group larger than an even share of what is still to be placed gets a
   shard of its own, the largest first; there can't be more of them than shards.
   The other groups share the remaining shards.
2. Capacity. The smallest capacity for which a greedy walk needs no more than the
   remaining shards is found by binary search. The walk asks for the last group end
   at or before a place; ends are known by the largest one in each of ``CELLS`` cells
   of the byte axis. Where a cell leaves it open, the walk gives a bound from each
   side, and only the cells on which the answer still depends are cut up further,
   so a round returns at most ``CELLS`` rows, whatever the number of groups.
3. The groups are cut where the walk with that capacity ends. Documents are sorted
   over the cluster by (group, id) and numbered inside their shard.

Cases: a null text counts as empty (size 1, CRC 0) and stands with empty texts; ids
may be null and may repeat; rows equal in id and text get neighbouring slots; with
fewer groups than shards some shards stay empty; an empty table gives an empty
result. Carried columns pass through, except those named like an output column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.batches import extended, map_batches, put
from threadloom.session import cut_lineage, loose

SHARDS = 8
#: Cells of the byte axis that one round of the search looks at.
CELLS = 1 << 14
ADDED = ("size", "text_crc32", "shard", "slot")


@dataclass
class Ends:
    """What is known of the sorted group ends: cells (left, right] of the byte axis with the largest end inside (-1: none)."""

    left: np.ndarray
    right: np.ndarray
    most: np.ndarray

    def __post_init__(self):
        self.upto = np.maximum.accumulate(np.maximum(self.most, 0))

    def last(self, place: int) -> tuple[int, int]:
        """Bounds of the largest end at or before ``place``, equal if it is known."""
        i = int(np.searchsorted(self.right, place))
        if i == len(self.right):
            return (int(self.upto[-1]),) * 2
        before = int(self.upto[i - 1]) if i else 0
        if self.most[i] <= place:
            return (max(before, int(self.most[i])),) * 2
        return before, place

    def walk(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of the ends at which a greedy walk closes its shards."""
        low = high = 0
        out = []
        for _ in range(shards):
            low, high = self.last(low + capacity)[0], self.last(high + capacity)[1]
            out.append((low, high))
        return out

    def cut_up(self, chosen: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """Finer cells in the place of the chosen ones."""
        per = max(2, cells // max(1, len(chosen)))
        left, right = [], []
        for a, b in zip(self.left[chosen].tolist(), self.right[chosen].tolist()):
            n = min(per, b - a)
            edges = [a + (b - a) * i // n for i in range(n + 1)]
            left += edges[:-1]
            right += edges[1:]
        return np.array(left, np.int64), np.array(right, np.int64)

    def replaced(self, chosen: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray) -> Ends:
        stay = np.ones(len(self.left), bool)
        stay[chosen] = False
        parts = [np.concatenate(p) for p in ((self.left[stay], left), (self.right[stay], right), (self.most[stay], most))]
        order = np.argsort(parts[0])
        return Ends(*[p[order] for p in parts])


def smallest(feasible: Callable[[int], bool], low: int, high: int) -> int:
    """The smallest whole number in (low, high] that is feasible; ``high`` is."""
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle, high)
    return high


def minimax_cuts(largest_ends: Callable[[np.ndarray, np.ndarray], np.ndarray], total: int, largest: int, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """The smallest capacity with which ``shards`` contiguous shards hold all groups, and the ends where the walk cuts.

    ``largest_ends(left, right)`` gives the largest group end in each cell (left, right], -1 if there is none.
    """
    ends = Ends(*(np.array([v], np.int64) for v in (0, total, total)))
    low, high = max(-(-total // shards), largest) - 1, total
    while True:
        high = smallest(lambda c: ends.walk(c, shards)[-1][0] >= total, low, high)
        low = smallest(lambda c: ends.walk(c, shards)[-1][1] >= total, low, high) - 1
        walk = ends.walk(high, shards)
        if high - low == 1 and all(a == b for a, b in walk):
            return high, [a for a, _ in walk[:-1] if a < total]
        # cells that some walk with a capacity still in question may ask about
        starts = [(0, 0), *((a, b) for (a, _), (_, b) in zip(ends.walk(low + 1, shards), walk))]
        chosen = np.zeros(len(ends.left), bool)
        for a, b in starts[:-1]:
            i, j = np.searchsorted(ends.right, a + low + 1), np.searchsorted(ends.right, min(b + high, total))
            chosen[i : j + 1] = True
        open_ = np.flatnonzero(chosen & (ends.most > ends.left + 1) & (ends.right - ends.left > 1))
        left, right = ends.cut_up(open_, cells)
        ends = ends.replaced(open_, left, right, largest_ends(left, right))


# ---------------------------------------------------------------- groups and documents on the cluster


def _after_earlier(rows: DataFrame, totals: dict[str, str]) -> DataFrame:
    """Add to running sums per partition (``_part``) what earlier partitions hold; ``totals``: column to the name of its sum.

    The broadcast side has one row per partition.
    """
    per = rows.groupBy("_part").agg(*[F.max(c).alias(n) for c, n in totals.items()])
    before = [F.coalesce(F.sum(n).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(n) for n in totals.values()]
    placed = rows.join(F.broadcast(per.select("_part", *before)), "_part")
    return placed.withColumns({c: F.col(c) + F.col(n) for c, n in totals.items()}).drop("_part", *totals.values())


def _running(df: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Add running sums inside each partition: column to the name of its sum."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict.fromkeys(sums, 0)
        for batch in source:
            added = {}
            for column, out in sums.items():
                values = held[column] + np.cumsum(batch.column(column).to_numpy())
                held[column] = int(values[-1]) if len(values) else held[column]
                added[out] = pa.array(values, pa.int64())
            yield put(batch, added)

    return map_batches(df, run, extended(df, {out: T.LongType() for out in sums.values()}))


def placed_groups(rows: DataFrame, shards: int, cells: int = CELLS) -> DataFrame:
    """(digest, rows, place, shard) for every group of (id, digest, size) rows; places rise in the groups' order."""
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("id").alias("first"))
    groups = cut_lineage(groups)
    order = [F.col("first").isNull(), F.col("first"), F.col("digest")]
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    # Giants are among the largest few: one more can't exceed its share of what is left.
    giants: list[bytearray] = []
    left, open_, largest = total, shards, 0
    for top in groups.orderBy(F.desc("bytes"), *order).limit(shards).collect():
        if top["bytes"] * open_ <= left:
            largest = top["bytes"]
            break
        giants.append(top["digest"])
        left, open_ = left - top["bytes"], open_ - 1
    number = F.lit(None).cast("int")
    for k, digest in enumerate(giants):
        number = F.when(F.col("digest") == F.lit(bytes(digest)), F.lit(k)).otherwise(number)
    groups = groups.withColumn("giant", number)
    large = groups.where("giant is not null").select("digest", "rows", (F.col("giant") - shards).cast("long").alias("place"), F.col("giant").alias("shard"))
    ranged = groups.where("giant is null").repartitionByRange(*order).sortWithinPartitions(*order).select("digest", "rows", "bytes")
    others = cut_lineage(_running(ranged, {"bytes": "place"}).withColumn("_part", F.spark_partition_id()))
    others = cut_lineage(_after_earlier(others, {"place": "_before"}))

    def largest_ends(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = np.full(len(left), -1, np.int64)
            for batch in source:
                end = batch.column("place").to_numpy()
                i = np.searchsorted(left, end) - 1
                inside = (i >= 0) & (end <= right[i])
                np.maximum.at(most, i[inside], end[inside])
            cell = np.flatnonzero(most >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(most[cell])], ["cell", "most"])

        found = map_batches(others.select("place"), run, "cell int, most long").groupBy("cell").agg(F.max("most").alias("most"))
        out = np.full(len(left), -1, np.int64)
        for r in found.collect():  # at most one row per cell
            out[r["cell"]] = r["most"]
        return out

    cuts = minimax_cuts(largest_ends, left, largest, open_, cells)[1] if left else []
    shard = F.lit(len(giants))
    for cut in cuts:
        shard = shard + (F.col("place") > cut).cast("int")
    return large.unionByName(others.select("digest", "rows", "place", shard.alias("shard")))


def assign(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, carry: Sequence[str] | None = None, cells: int = CELLS) -> DataFrame:
    """Add size, text_crc32, shard and slot to every row. ``carry`` names the columns to keep (all, if not given)."""
    carry = [c for c in (df.columns if carry is None else carry) if c not in ADDED]
    names = [f"_{i}" for i in range(len(carry))]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        *[F.col(c).alias(n) for c, n in zip(carry, names)], F.col(doc_id).alias("id"), F.unhex(F.sha2(whole, 256)).alias("digest"),
        (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("crc"),
    )
    if text not in carry:
        rows = cut_lineage(rows)  # small rows, so that the texts are read once
    groups = cut_lineage(placed_groups(rows.select("id", "digest", "size"), shards, cells))
    counts = {r["shard"]: r["n"] for r in groups.groupBy("shard").agg(F.sum("rows").alias("n")).collect()}  # one row per shard
    told = rows.join(loose(groups.select("digest", "place", "shard")), "digest").drop("digest")
    order = [F.col("place"), F.col("id").isNull(), F.col("id")]
    ranged = told.repartitionByRange(*order).sortWithinPartitions(*order).drop("place", "id").withColumn("one", F.lit(1).cast("long"))
    numbered = cut_lineage(_running(ranged, {"one": "upto"}).withColumn("_part", F.spark_partition_id()))
    numbered = _after_earlier(numbered, {"upto": "_before"})
    start = F.lit(0).cast("long")
    for k in range(1, shards):
        start = F.when(F.col("shard") >= k, F.lit(sum(counts.get(i, 0) for i in range(k)))).otherwise(start)
    return numbered.select(
        *[F.col(n).alias(c) for n, c in zip(names, carry)], "size", F.col("crc").cast("long").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"), (F.col("upto") - 1 - start).cast("long").alias("slot"),
    )


def write(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, mode: str = "error") -> None:
    """Write one folder of Parquet files per shard, each file in slot order."""
    placed = assign(df, doc_id, text, shards)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode(mode).partitionBy("shard").parquet(path)
