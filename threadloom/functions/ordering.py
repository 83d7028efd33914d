"""Reproducible sampling order, and ranks that never need one big task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.session import cut_lineage


def sample_key(seed: int | str, *cols: Column | str) -> Column:
    """M1/M2: md5 of seed and key. Independent of row order and partitioning."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _with_offsets(df: DataFrame, bucket: str, weight: Column) -> DataFrame:
    """Attach the total weight of all earlier buckets and of the own one.

    ``bucket`` has at most a few thousand values by construction, so the
    ordered sum over buckets and its broadcast are bounded.
    """
    totals = df.groupBy(bucket).agg(F.sum(weight).alias("_in"))
    before = F.sum("_in").over(W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    totals = totals.withColumn("_before", F.coalesce(before, F.lit(0)))
    return df.join(F.broadcast(totals), bucket)


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int = 42, out: str = "rank") -> DataFrame:
    """M2: position of every row in the seeded shuffle, 1-based, over the whole table.

    The first three hex digits of the key cut the order into 4096 even slices;
    each slice is numbered on its own and shifted by what lies before it.
    """
    df = df.withColumn("_key", sample_key(seed, *keys))
    df = df.withColumn("_slice", F.substring("_key", 1, 3))
    df = _with_offsets(df, "_slice", F.lit(1))
    inside = F.row_number().over(W.partitionBy("_slice").orderBy("_key", *keys))
    return df.withColumn(out, (F.col("_before") + inside).cast("long")).drop(
        "_key", "_slice", "_in", "_before"
    )


def take_by_hash(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """M1: the first ``n`` rows of the seeded shuffle.

    Slices that start past ``n`` are dropped before anything is shuffled.
    """
    columns = df.columns
    df = df.withColumn("_key", sample_key(seed, *keys))
    df = df.withColumn("_slice", F.substring("_key", 1, 3))
    df = _with_offsets(df, "_slice", F.lit(1)).where(F.col("_before") < n)
    inside = F.row_number().over(W.partitionBy("_slice").orderBy("_key", *keys))
    return df.withColumn("_rank", F.col("_before") + inside).where(F.col("_rank") <= n).select(
        *columns
    )


def quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of a numeric column, one row per probability.

    Equal values are counted first, so a value shared by most rows is one row.
    The counts are then range-sorted: slices have bounds sampled from the values,
    so outliers don't press the rest into a few slices. Sums run slice by slice.
    """
    freq = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count("*").alias("c")
    )
    ranged = freq.repartitionByRange("v").sortWithinPartitions("v")
    freq = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))
    n = freq.agg(F.sum("c")).scalar()
    freq = _with_offsets(freq, "_slice", F.col("c"))
    upto = F.sum("c").over(
        W.partitionBy("_slice").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    freq = freq.withColumn("_upto", F.col("_before") + upto).withColumn("_n", n)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    rows = freq.select("v", "c", "_upto", "_n", wanted)
    at = F.col("prob") * (F.col("_n") - 1)
    covers = lambda pos: (F.col("_upto") > pos) & (F.col("_upto") - F.col("c") <= pos)
    low = F.max(F.when(covers(F.floor(at)), F.col("v")))
    high = F.max(F.when(covers(F.ceil(at)), F.col("v")))
    part = F.max(at - F.floor(at))
    return rows.groupBy("prob").agg((low + (high - low) * part).alias(value))


def number_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Row number inside each group, also when one group holds much of the table.

    Groups up to ``hot_rows`` rows use an ordinary window. Larger ones (at most
    rows / hot_rows of them) are range-sorted over the cluster, numbered through
    the whole range, and shifted back to start at one.
    """
    keys = list(keys)
    hot = df.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys)
    plain = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    if hot.isEmpty():
        return df.withColumn(out, plain)
    hot = cut_lineage(hot)
    cold_part = df.join(F.broadcast(hot), keys, "left_anti").withColumn(out, plain)

    ordered = df.join(F.broadcast(hot), keys, "left_semi").repartitionByRange(*keys, *order)
    ordered = ordered.sortWithinPartitions(*keys, *order)
    ordered = cut_lineage(ordered.withColumn("_id", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_slice", F.shiftright("_id", 33))
    ordered = _with_offsets(ordered, "_slice", F.lit(1))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.withColumn("_place", place)
    starts = ordered.groupBy(*keys).agg(F.min("_place").alias("_start"))
    hot_part = ordered.join(F.broadcast(starts), keys).withColumn(
        out, (F.col("_place") - F.col("_start") + 1).cast("int")
    )
    return cold_part.unionByName(hot_part.select(*cold_part.columns))
