"""Mixing sources to target weights with budgets fitted by subset sums of document lengths.

Targets. Sources in code point order (null last) get weights from a repeating
list; all sizes together are shared by weight. No target exceeds ``most`` times
its source's size: the excess is shared again by weight among the others until
no target is above. If every source is at its limit, what is left is not taken.

Budgets. A source is taken whole as often as its target allows; what remains of
the target is a budget smaller than the source. Documents are counted by exact
length. Of each length the same share is taken first, rounded down, so that the
mix keeps the source's lengths; then one more of as many lengths as fit, by the
share that rounding cut off. A bounded-knapsack dynamic program over the lengths still
to be had fits the small remainder: it finds the reachable sum nearest to the
budget that is not above it, together with the lengths to use.

Selection. Of the documents of one source and length the first ones in a seeded
order are taken. Large groups are ranked slice by slice of that order.

Cases: null texts and texts without words have size 0 and are never taken; a
source of size 0 has target 0; repeated rows are separate documents, which the
seeded order tells apart only by their number; null ids are allowed; an empty
table gives an empty result; other columns pass through, except those named
like an output column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.batches import extended, map_batches, put
from threadloom.llm.words import find_words, slices
from threadloom.session import cut_lineage, ship_package

WEIGHTS = (5, 2, 1)
MOST = 3
#: Stands for null where sources are grouped and joined; other sources have "=" before their name.
NO_SOURCE = ""
#: Words left to the dynamic program: this many, or ``SPAN_DOCS`` times the longest document, up to ``MOST_SPAN``.
SPAN, SPAN_DOCS, MOST_SPAN = 1 << 14, 4, 1 << 24
#: Leading bits of the seeded order that make a slice; groups are ranked slice by slice.
ORDER_BITS = 10


def with_sizes(df: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    """Add the number of words of a text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n: list[int] = []
            for _, _, data, offsets in slices(batch.column(text)):
                n += np.diff(find_words(data, offsets).first).tolist()
            yield put(batch, {out: pa.array(n, pa.int64())})

    return map_batches(df, run, extended(df, {out: T.LongType()}))


def ordered_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, place): place in code point order from 0, null last.

    The order comes from a range sort; every partition counts its own rows and
    is shifted by those before it, so no task sees all sources.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source") == NO_SOURCE, F.col("source")]
    ranged = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    # one row per partition
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_part", before.alias("_before"))
    placed = rows.withColumn("_part", part).join(F.broadcast(shifts), "_part")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select("source", "source_size", place.alias("place"))


def with_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add target (double) to (source, source_size, place).

    A level says how many words one unit of weight gets. It is a ratio of whole
    numbers found from sums alone; each round fixes the sources above their limit.
    """
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut_lineage(sources.withColumn("weight", weight.cast("long")))
    limit = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = Fraction(0), None
    while True:
        # limit <= weight * level, as whole numbers
        above = limit.cast("decimal(38,0)") * level.denominator <= F.col("weight").cast("decimal(38,0)") * level.numerator
        above = above if fixed is not None else F.lit(False)
        row = sources.agg(
            F.sum(F.when(above, limit)).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("fixed")
        ).first()
        if not row["open"] or row["fixed"] == fixed:
            break
        fixed = row["fixed"]
        level = Fraction(int(total - (row["taken"] or 0)), int(row["open"]))
    share = F.col("weight").cast("double") * level.numerator / F.lit(float(level.denominator))
    return sources.withColumn("target", F.when(F.lit(not row["open"]), limit.cast("double")).otherwise(F.least(limit.cast("double"), share)))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for a sum near ``budget``, never above it.

    ``lengths`` are distinct and above 0. A budget within the program's span gets the
    best sum there is. Of a larger one, all but the span is taken by shares first.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    span = min(max(SPAN, SPAN_DOCS * int(lengths.max())), MOST_SPAN)
    share = max(0, budget - span)
    taken = np.array([int(c) * share // total for c in counts.tolist()], np.int64)
    rest = budget - int((lengths * taken).sum())
    free = counts - taken
    cut_off = np.array([int(c) * share % total / total for c in counts.tolist()])
    for i in np.lexsort((-lengths, -cut_off)):  # short ones are left to the program where shares are equal
        if free[i] and lengths[i] <= rest - span:
            taken[i] += 1
            free[i] -= 1
            rest -= int(lengths[i])
    for i in np.argsort(-lengths):
        n = min(int(free[i]), max(0, rest - span) // int(lengths[i]))
        taken[i] += n
        free[i] -= n
        rest -= n * int(lengths[i])
    usable = lengths <= rest
    if usable.any():
        taken[usable] += knapsack(lengths[usable], free[usable], rest)
    return taken


def knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: copies of each length whose sum is the largest reachable one up to ``budget``.

    reach[s] holds the number of the length with which s was first reached, so a
    sum is unwound length by length. ``used`` counts copies of the present length.
    """
    out = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return out
    reach = np.full(budget + 1, -1, np.int32)
    reach[0] = len(lengths)
    for i in np.argsort(-lengths, kind="stable"):
        size, most = int(lengths[i]), int(min(free[i], budget // lengths[i]))
        new = reach >= 0
        for _ in range(most):
            step = np.zeros(budget + 1, bool)
            step[size:] = new[: budget + 1 - size]
            new = step & (reach < 0)
            if not new.any():
                break
            reach[new] = i
        if reach[budget] >= 0:
            break
    s = int(np.flatnonzero(reach >= 0)[-1])
    while s:
        i = reach[s]
        out[i] += 1
        s -= int(lengths[i])
    return out


def fitted(histogram: DataFrame) -> DataFrame:
    """(source, size, count, passes, chosen) from (source, size, count, source_size, target).

    A group holds one row per distinct length of a source, never documents.
    """
    ship_package(histogram.sparkSession)

    def run(group):
        group = group.sort_values("size").assign(passes=0, chosen=0)
        some = (group["size"] > 0).to_numpy()
        if some.any():
            whole, target = int(group["source_size"].iloc[0]), round(float(group["target"].iloc[0]))
            sizes, counts = (group.loc[some, c].to_numpy(np.int64) for c in ("size", "count"))
            group.loc[some, "passes"] = target // whole
            group.loc[some, "chosen"] = fit(sizes, counts, target % whole)
        return group[["source", "size", "count", "passes", "chosen"]]

    return histogram.groupBy("source").applyInPandas(run, "source string, size long, count long, passes long, chosen long")


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, weights: Sequence[int] = WEIGHTS, most: int = MOST, carry: Sequence[str] | None = None) -> DataFrame:
    """Add size, source_size, target and taken (words that the mix takes of the document) to every row.

    ``carry`` names the columns to keep (all, if not given); fewer travel less.
    """
    carry = [c for c in (df.columns if carry is None else carry) if c not in ADDED]
    names = [f"_{i}" for i in range(len(carry))]
    order = F.xxhash64(F.lit(int(seed)), doc_id, text)
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(NO_SOURCE))
    rows = df.select(key.alias("source"), order.alias("_order"), F.col(text).alias("_text"), *[F.col(c).alias(n) for c, n in zip(carry, names)])
    slice_ = F.shiftrightunsigned("_order", 64 - ORDER_BITS).alias("slice")
    counts = cut_lineage(with_sizes(rows.select("source", "_order", "_text"), "_text").groupBy("source", "size", slice_).agg(F.count("*").alias("in_slice")))
    lengths = counts.groupBy("source", "size").agg(F.sum("in_slice").alias("count"))
    by_size = F.sum(F.col("in_slice") * F.col("size")).alias("size")
    sources = with_targets(ordered_sources(counts.groupBy("source").agg(by_size)), weights, most)
    facts = sources.select("source", "source_size", "target")
    plan = fitted(lengths.join(facts, "source")).join(facts, "source")
    before = F.sum("in_slice").over(W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    # The seeded order is cut at the chosen number: earlier slices go whole, one slice is ranked.
    cuts = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(plan, ["source", "size"])
    cuts = cuts.select("source", "size", "slice", "source_size", "target", "passes", (F.col("chosen") - F.col("before")).alias("left"))
    placed = with_sizes(rows, "_text").drop("_text").withColumn("slice", slice_).join(cuts, ["source", "size", "slice"])
    rank = F.row_number().over(W.partitionBy("source", "size", "slice").orderBy("_order", *[n for n, c in zip(names, carry) if c == doc_id]))
    taken = F.col("size") * (F.col("passes") + F.when(rank <= F.col("left"), 1).otherwise(0))
    return placed.select(*[F.col(n).alias(c) for n, c in zip(names, carry)], "size", "source_size", "target", taken.alias("taken"))


ADDED = ("size", "source_size", "target", "taken")


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.where(times > 0).withColumn("_time", F.explode(F.sequence(F.lit(1), times))).select(*columns)
