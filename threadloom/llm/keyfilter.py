"""A filter of fixed size that keeps most rows without a partner out of a shuffle join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the bit table, at any input size. A full table lets all rows pass.
FILTER_WORDS = 1 << 17


def _word(h: str) -> Column:
    return F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS))


def mark_maybe(rows: DataFrame, wanted: DataFrame, h: str, out: str = "maybe") -> DataFrame:
    """Add a boolean: false only if no row of ``wanted`` has the 64-bit key ``h`` of this row.

    The table of at most FILTER_WORDS rows is broadcast; it says nothing about
    the result of the exact join that follows, only about what takes part in it.
    """
    bit = F.expr(f"shiftleft(1L, cast({h} & 63 as int))")
    bits = wanted.groupBy(_word(h).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_word", _word(h)).join(F.broadcast(bits), "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.withColumn(out, hit).drop("_word", "_bits")
