"""Profiling of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.parsing import flag_false, flag_true, safe_long
from threadloom.functions.text import preview, strip


def _blank(name: str) -> Column:
    value = F.col(name).cast("string")
    return F.coalesce(strip(value) == "", F.lit(True))


def table_size(df: DataFrame) -> DataFrame:
    """Row count and column count."""
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "col_count", F.lit(len(df.columns))
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """Null or blank cells per column, all columns in one pass."""
    wide = df.agg(*[F.count_if(_blank(c)).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column_name", "missing")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows.

    Rows are compared by a SHA-256 of their cells (null and empty differ, as do
    shifted cells), so 32 bytes per distinct row are shuffled, not the row.
    """
    cell = lambda c: F.coalesce(
        F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"),
                 F.col(c).cast("string")),
        F.lit("n"),
    )
    digest = F.unhex(F.sha2(F.concat(*[cell(c) for c in df.columns]), 256))
    copies = df.groupBy(digest.alias("digest")).agg(F.count("*").alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count"),
    )


def distinct_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Distinct non-blank ids after trimming."""
    value = strip(F.col(id_col).cast("string"))
    return df.agg(F.countDistinct(F.nullif(value, F.lit(""))).alias("distinct_ids"))


def direction_counts(df: DataFrame, flag_col: str) -> DataFrame:
    """P5: inbound and outbound rows; cells that are neither are not counted."""
    flag = F.col(flag_col).cast("string")
    return df.agg(
        F.count_if(flag_true(flag)).alias("inbound_count"),
        F.count_if(flag_false(flag)).alias("outbound_count"),
    )


def infer_types(df: DataFrame, order_col: str, rows: int = 100, values: int = 20) -> DataFrame:
    """Type per column from the first ``values`` non-blank cells of ``rows`` rows."""
    columns = df.columns
    head = df.orderBy(order_col).limit(rows)
    cells = head.select(
        F.col(order_col).alias("_at"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(c).cast("string").alias("v"),
                    )
                    for c in columns
                ]
            )
        ).alias("cell"),
    ).select("_at", "cell.*")
    seen = cells.where(strip("v") != "")
    nth = F.row_number().over(W.partitionBy("column_name").orderBy("_at"))
    seen = seen.withColumn("nth", nth).where(F.col("nth") <= values)
    text = strip("v")
    kinds = seen.groupBy("column_name").agg(
        F.bool_and(F.lower(text).isin("true", "false")).alias("is_bool"),
        F.bool_and(safe_long("v").isNotNull()).alias("is_int"),
        F.bool_and(text.try_cast("double").isNotNull()).alias("is_float"),
    )
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "pos int, column_name string")
    kind = (
        F.when(F.col("is_bool"), "bool")
        .when(F.col("is_int"), "int")
        .when(F.col("is_float"), "float")
        .when(F.col("is_bool").isNotNull(), "str")
        .otherwise("unknown")
    )
    return names.join(kinds, "column_name", "left").select(
        "pos", "column_name", kind.alias("inferred_type")
    )


def head_rows(df: DataFrame, order_col: str, rows: int = 5, width: int = 80) -> DataFrame:
    """First rows with long cells cut."""
    head = df.orderBy(order_col).limit(rows)
    return head.select(*[preview(c, width).alias(c) for c in df.columns])


def expected_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Is each expected column there, whatever its case?"""
    have = {c.lower() for c in df.columns}
    rows = [(i, name, name.lower() in have) for i, name in enumerate(expected)]
    return df.sparkSession.createDataFrame(rows, "pos int, column_name string, present boolean")


def profile_table(df: DataFrame, id_col: str, flag_col: str | None = None) -> DataFrame:
    """P1-P5 as (metric, value) rows."""
    flag = F.col(flag_col).cast("string") if flag_col else F.lit("")
    ids = F.nullif(strip(F.col(id_col).cast("string")), F.lit(""))
    wide = df.agg(
        F.count("*").alias("row_count"),
        F.countDistinct(ids).alias("distinct_ids"),
        F.count_if(flag_true(flag)).alias("inbound_count"),
        F.count_if(flag_false(flag)).alias("outbound_count"),
        *[F.count_if(_blank(c)).alias(f"missing:{c}") for c in df.columns],
    )
    return wide.unpivot([], wide.columns, "metric", "value")
