"""Conversation building and analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ordering import number_in_group, quantiles
from threadloom.functions.parsing import flag_true, safe_long, tweet_ts
from threadloom.functions.text import strip

CONV = "conversation_id"
SALTS = 16
LENGTH_BUCKETS = ("1 turn", "2 turns", "3-5 turns", "6-10 turns", "11-20 turns", "21+ turns")


def type_tweets(raw: DataFrame) -> DataFrame:
    """Raw string columns to typed ones; rows without a usable id are skipped."""
    empty = lambda c: F.coalesce(strip(c), F.lit(""))
    return raw.select(
        safe_long("tweet_id").alias("tweet_id"),
        empty("author_id").alias("author_id"),
        flag_true("inbound").alias("inbound"),
        F.coalesce("text", F.lit("")).alias("text"),
        empty("created_at").alias("created_at"),
        tweet_ts("created_at").alias("ts"),
        empty("response_tweet_id").alias("response_tweet_id"),
        empty("in_response_to_tweet_id").alias("in_response_to_tweet_id"),
        safe_long("in_response_to_tweet_id").alias("parent_id"),
    ).where("tweet_id is not null")


def speaker(author: Column | str, brands: Sequence[str]) -> Column:
    """Brand when the author is one of the brands (any case), else customer."""
    author = F.col(author) if isinstance(author, str) else author
    return F.when(F.lower(author).isin([b.lower() for b in brands]), "brand").otherwise("customer")


def time_order() -> list[Column]:
    """C4: by time, unknown times last, then by tweet id."""
    return [F.col("ts").asc_nulls_last(), F.col("tweet_id")]


def _order_key() -> Column:
    return F.struct(F.col("ts").isNull().alias("late"), F.col("ts"), F.col("tweet_id"))


def number_turns(turns: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """1-based turn number by time within each conversation."""
    return number_in_group(turns, [CONV], time_order(), "turn_number", hot_rows)


def missing_parents(turns: DataFrame) -> DataFrame:
    """Replies per conversation whose parent is not in it.

    Replies are counted per parent before the anti join, so a post with a
    million replies is one row there.
    """
    replies = (
        turns.where("parent_id is not null")
        .groupBy(CONV, "parent_id")
        .agg(F.count("*").alias("replies"))
    )
    present = turns.select(CONV, F.col("tweet_id").alias("parent_id"))
    lost = replies.join(present, [CONV, "parent_id"], "left_anti")
    return lost.groupBy(CONV).agg(F.sum("replies").alias("missing"))


def structural_flags(turns: DataFrame) -> DataFrame:
    """Flag text per conversation, empty when sound."""
    shape = turns.groupBy(CONV).agg(
        F.count("*").alias("num_turns"), F.count_if(F.col("ts").isNull()).alias("bad_ts")
    )
    return shape.join(missing_parents(turns), CONV, "left").select(CONV, _flag_reason())


def _flag_reason() -> Column:
    bad = F.when(
        F.col("bad_ts") > 0,
        F.concat(F.col("bad_ts"), F.lit("/"), F.col("num_turns"), F.lit(" unparseable timestamps")),
    )
    lost = F.when(
        F.col("missing") > 0,
        F.concat(F.col("missing"), F.lit(" referenced tweet(s) outside conversation")),
    )
    return F.concat_ws("; ", bad, lost).alias("flag_reason")


def build_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation from typed turns with speaker and parent.

    One aggregation, combined before the shuffle. A customer turn directly
    followed by a brand turn exists exactly when the first customer turn lies
    before the last brand turn, so C8 needs no window.
    """
    at = _order_key()
    customer = F.col("speaker") == "customer"
    brand = F.col("speaker") == "brand"
    shape = turns.groupBy(CONV).agg(
        F.count("*").cast("int").alias("num_turns"),
        F.count_if(customer).cast("int").alias("customer_message_count"),
        F.count_if(brand).alias("n_brand"),
        F.count_if(F.col("ts").isNull()).alias("bad_ts"),
        F.min(F.when(customer, at)).alias("first_customer"),
        F.max(F.when(brand, at)).alias("last_brand"),
        F.coalesce(F.min(F.when(customer, F.col("author_id"))), F.lit("")).alias("customer_author"),
        F.coalesce(F.min(F.when(brand, F.col("author_id"))), F.lit("")).alias("brand_author"),
        F.min_by("created_at", at).alias("start_time"),
        F.max_by("created_at", at).alias("end_time"),
        F.min("ts").alias("start_ts"),
    )
    rows = shape.join(missing_parents(turns), CONV, "left").withColumn("flag_reason", _flag_reason())
    responded = (F.col("customer_message_count") > 0) & (F.col("n_brand") > 0)
    adjacent = F.coalesce(F.col("first_customer") < F.col("last_brand"), F.lit(False))
    return rows.select(
        CONV,
        "customer_author",
        "brand_author",
        "start_time",
        "end_time",
        "num_turns",
        responded.alias("brand_responded"),
        (responded & (F.col("num_turns") >= 3)).alias("is_multi_turn"),
        "customer_message_count",
        (F.col("flag_reason") != "").alias("is_flagged"),
        "flag_reason",
        (responded & (F.col("num_turns") >= 3) & adjacent & (F.col("flag_reason") == "")).alias(
            "suitable_for_resolution"
        ),
        "start_ts",
    )


def shape_of_turns(turns: DataFrame, order: str = "turn_number") -> DataFrame:
    """C7-C9 for turns that already carry a position: counts and flags only."""
    customer = F.col("speaker") == "customer"
    brand = F.col("speaker") == "brand"
    shape = turns.groupBy(CONV).agg(
        F.count("*").alias("num_turns"),
        F.count_if(customer).alias("customer_message_count"),
        F.count_if(brand).alias("n_brand"),
        F.min(F.when(customer, F.col(order))).alias("first_customer"),
        F.max(F.when(brand, F.col(order))).alias("last_brand"),
    )
    responded = (F.col("customer_message_count") > 0) & (F.col("n_brand") > 0)
    multi = responded & (F.col("num_turns") >= 3)
    adjacent = F.coalesce(F.col("first_customer") < F.col("last_brand"), F.lit(False))
    return shape.select(
        CONV,
        "num_turns",
        "customer_message_count",
        responded.alias("brand_responded"),
        multi.alias("is_multi_turn"),
        (multi & adjacent).alias("suitable_for_resolution"),
    )


def nest_turns(turns: DataFrame, max_turns_per_row: int = 10_000) -> DataFrame:
    """Ordered list of turns per (conversation, part).

    The form is the same at every size: part p holds the turns numbered from
    p * max_turns_per_row + 1 on, so no turn is lost and no row grows without bound.
    """
    fields = [
        "turn_number", "tweet_id", "author_id", "speaker", "inbound", "text", "created_at",
        "response_tweet_id", "in_response_to_tweet_id",
    ]
    part = F.floor((F.col("turn_number") - 1) / max_turns_per_row).cast("int")
    return (
        turns.groupBy(CONV, part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("turns"))
    )


def dedup_conversations(turns: DataFrame, order: str) -> DataFrame:
    """Ids of conversations whose set of tweets was not seen before.

    Sets are compared by count and two sums of 64-bit hashes of different
    families, which combine before the shuffle. The test is probabilistic: other
    sets agree in all three with a chance of about 2**-124 per pair. The smallest
    (order, id) of equal sets stays.
    """
    members = turns.select(CONV, "tweet_id").distinct()
    first = F.xxhash64("tweet_id")
    digits = F.substring(F.md5(F.col("tweet_id").cast("string")), 1, 15)
    second = F.conv(digits, 16, 10).cast("bigint")
    sets = members.groupBy(CONV).agg(
        F.count("*").alias("n"),
        F.sum(first.cast("decimal(20,0)")).alias("s1"),
        F.sum(second.cast("decimal(20,0)")).alias("s2"),
    )
    starts = turns.groupBy(CONV).agg(F.min(order).alias("_at"))
    return (
        sets.join(starts, CONV)
        .groupBy("n", "s1", "s2")
        .agg(F.min(F.struct("_at", CONV)).alias("m"))
        .select(f"m.{CONV}")
    )


def opening_and_reply(turns: DataFrame, order: str = "turn_number") -> DataFrame:
    """First customer message and the first brand turn after it.

    Conversations that open with the customer are answered by one aggregation.
    Only where the brand spoke first are brand turns looked at again, under
    (conversation, salt) so that a huge conversation is spread over tasks.
    """
    customer = F.col("speaker") == "customer"
    brand = F.col("speaker") == "brand"
    first = turns.groupBy(CONV).agg(
        F.count("*").alias("num_turns"),
        F.min(F.when(customer, F.struct(F.col(order).alias("at"), F.col("text")))).alias("c"),
        F.min(F.when(brand, F.struct(F.col(order).alias("at"), F.col("text")))).alias("b"),
    ).where("c is not null")
    simple = F.col("b.at").isNull() | (F.col("b.at") > F.col("c.at"))
    done = first.where(simple).select(
        CONV, "num_turns", F.col("c.text").alias("customer_message"),
        F.coalesce("b.text", F.lit("")).alias("brand_response"),
    )
    again = first.where(~simple).select(CONV, "num_turns", "c")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    bounds = again.select(CONV, F.col("c.at").alias("c_at"), F.explode(salts).alias("salt"))
    later = (
        turns.where(brand)
        .select(CONV, order, "text", F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int").alias("salt"))
        .join(bounds, [CONV, "salt"])
        .where(F.col(order) > F.col("c_at"))
        .groupBy(CONV, "salt")
        .agg(F.min(F.struct(F.col(order).alias("at"), F.col("text"))).alias("b"))
        .groupBy(CONV)
        .agg(F.min("b").alias("b"))
    )
    rest = again.join(later, CONV, "left").select(
        CONV, "num_turns", F.col("c.text").alias("customer_message"),
        F.coalesce("b.text", F.lit("")).alias("brand_response"),
    )
    return done.unionByName(rest)


def case_base(turns: DataFrame, ids: DataFrame | None = None, order: str = "turn_number") -> DataFrame:
    """C15 for retrieval: cases with a non-empty opening message, limited to ``ids``."""
    if ids is not None:
        turns = turns.join(ids.select(CONV), CONV, "left_semi")
    return opening_and_reply(turns, order).where("customer_message <> ''").withColumnRenamed(
        CONV, "case_id"
    )


def conversation_summary(convs: DataFrame) -> DataFrame:
    """A1: corpus totals in one row; works on C7-C9 or on full conversation rows.

    Turn counts are first reduced to one row per length, so the exact median
    runs over few values whatever the number of conversations.
    """
    has_authors = "customer_author" in convs.columns
    flagged = F.col("is_flagged") if "is_flagged" in convs.columns else F.lit(False)
    metrics = [
        F.count("*").alias("total"),
        F.count_if(~F.col("is_multi_turn")).alias("single_turn"),
        F.count_if("is_multi_turn").alias("multi_turn"),
        F.avg("num_turns").alias("avg_turns"),
        F.max("num_turns").cast("long").alias("max_turns"),
        F.count_if("brand_responded").alias("responded"),
        F.count_if(F.col("customer_message_count") >= 2).alias("customer_multi"),
        F.count_if("suitable_for_resolution").alias("suitable"),
        F.count_if(flagged).alias("flagged"),
    ]
    if has_authors:
        metrics += [
            F.countDistinct(F.nullif("customer_author", F.lit(""))).alias("unique_customers"),
            F.countDistinct(F.nullif("brand_author", F.lit(""))).alias("brand_accounts"),
        ]
    lengths = convs.groupBy("num_turns").agg(F.count("*").alias("n"))
    median = lengths.agg(F.percentile("num_turns", F.lit(0.5), F.col("n"))).scalar()
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.col("total")).alias(f"{c}_pct")
    return convs.agg(*metrics).withColumn("median_turns", median).select(
        "*", share("responded"), share("customer_multi"), share("suitable"), share("flagged")
    )


def length_histogram(convs: DataFrame) -> DataFrame:
    """A2: conversations per length bucket, empty buckets included."""
    n = F.col("num_turns")
    bucket = (
        F.when(n == 1, 0).when(n == 2, 1).when(n <= 5, 2).when(n <= 10, 3).when(n <= 20, 4)
        .otherwise(5)
    )
    counts = convs.groupBy(bucket.alias("pos")).agg(F.count("*").alias("conversations"))
    rows = list(enumerate(LENGTH_BUCKETS))
    dim = convs.sparkSession.createDataFrame(rows, "pos int, length_bucket string")
    total = counts.agg(F.sum("conversations")).scalar()
    found = F.coalesce("conversations", F.lit(0))
    return dim.join(counts, "pos", "left").select(
        "pos", "length_bucket", found.alias("conversations"),
        F.coalesce(F.try_divide(found * 100.0, total), F.lit(0.0)).alias("pct"),
    )


def length_class(n: Column | str) -> Column:
    """A3: Short / Medium / Long / Very long."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n <= 2, "Short").when(n <= 5, "Medium").when(n <= 10, "Long").otherwise(
        "Very long"
    )


def order_conversations(convs: DataFrame) -> DataFrame:
    """C14: by start time (not by the raw string, which would order by weekday)."""
    return convs.orderBy(F.col("start_ts").asc_nulls_last(), CONV)
