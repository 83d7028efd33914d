"""Typing of raw string fields (C1, C2) and of yes/no values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import strip


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_long(c: Column | str) -> Column:
    """One whole number, else null (so "2,3", "4.5" and "" are null)."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def tweet_ts(c: Column | str) -> Column:
    """``Tue Oct 31 22:10:47 +0000 2017`` to a timestamp, else null.

    The weekday is skipped: it carries no information and Spark's parser does
    not take it.
    """
    s = strip(c)
    shaped = s.rlike(
        r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) [A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4}$"
    )
    return F.when(
        shaped, F.try_to_timestamp(F.substring(s, 5, 40), F.lit("MMM d HH:mm:ss Z yyyy"))
    )


def flag_true(c: Column | str) -> Column:
    """True for true / 1 / yes in any case; everything else is false."""
    return F.coalesce(F.lower(strip(c)).isin("true", "1", "yes"), F.lit(False))


def flag_false(c: Column | str) -> Column:
    """True for false / 0 / no in any case: the profiler's third state is neither."""
    return F.coalesce(F.lower(strip(c)).isin("false", "0", "no"), F.lit(False))


#: Values of a label that mean yes and no. A boolean column reads as "true" and "false".
LABEL_YES, LABEL_NO = ("true", "Yes"), ("false", "No")


def yes_no(c: Column | str, yes: Sequence[str] = (*LABEL_YES, "True")) -> Column:
    """Yes for the values in ``yes``, else No."""
    return F.when(_col(c).cast("string").isin(*yes), "Yes").otherwise("No")


def has_error(c: Column | str = "api_error") -> Column:
    """True where a call failed; null and the empty text both mean that it didn't."""
    return F.coalesce(_col(c), F.lit("")) != ""
