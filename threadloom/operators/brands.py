"""Brand statistics, ranking and verdicts.

Input is the typed tweet table with a ``thread`` column; ``conversation`` in
this module means thread.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import first_mention
from threadloom.session import loose

# -- fixed values: score weights and verdict tiers
SCORE_WEIGHTS = {"complete": 0.35, "multi": 0.25, "response": 0.20, "customers": 0.10, "length": 0.10}
TIERS = {
    "multi": (5000, 1000),
    "customers": (5000, 1000),
    "response": (0.8, 0.5),
    "length": (4, 2.5),
}
REASON_FLOORS = {"multi": 1000, "customers": 1000, "response": 0.5, "length": 3}


def infer_brands(tweets: DataFrame) -> DataFrame:
    """B1: authors of outbound tweets."""
    return tweets.where("not inbound").select(F.col("author_id").alias("brand")).distinct()


def mentioned_brands(tweets: DataFrame, brands: DataFrame) -> DataFrame:
    """(thread, brand) for first mentions in inbound tweets that name a brand.

    Mentions are made distinct per thread before the join.
    """
    names = brands.groupBy(F.lower("brand").alias("handle")).agg(F.max("brand").alias("brand"))
    said = (
        tweets.where("inbound")
        .select("thread", first_mention("text").alias("handle"))
        .where("handle is not null")
        .distinct()
    )
    return said.join(names, "handle").select("thread", "brand")


def attribute_threads(tweets: DataFrame) -> DataFrame:
    """(thread, brand, responding, own_outbound) for responding and mentioned brands.

    A thread with several brands belongs to each of them; one with none is left out.
    """
    own = (
        tweets.where("not inbound")
        .groupBy("thread", F.col("author_id").alias("brand"))
        .agg(F.count("*").alias("own_outbound"))
    )
    named = mentioned_brands(tweets, infer_brands(tweets)).withColumn("own_outbound", F.lit(0))
    return (
        own.unionByName(named)
        .groupBy("thread", "brand")
        .agg(F.sum("own_outbound").alias("own_outbound"))
        .withColumn("responding", F.col("own_outbound") > 0)
    )


def thread_totals(tweets: DataFrame) -> DataFrame:
    """Per thread inbound, outbound and linked tweets, length, both-sides and multi flags."""
    totals = tweets.groupBy("thread").agg(
        F.count_if("inbound").alias("n_in"),
        F.count_if(~F.col("inbound")).alias("n_out"),
        F.count_if(F.col("parent_id").isNotNull()).alias("n_link"),
        F.count("*").alias("conv_len"),
    )
    both = (F.col("n_in") > 0) & (F.col("n_out") > 0)
    return totals.withColumn("has_both", both).withColumn("is_multi", both & (F.col("conv_len") >= 3))


def customers_per_brand(tweets: DataFrame, attribution: DataFrame) -> DataFrame:
    """Distinct inbound authors over a brand's threads.

    Each thread carries its list of brands, and an author's equal lists are taken
    once before they are exploded. The distinct (author, brand) pairs and the count
    by brand are partial aggregates, so no author's brands come into one row.
    """
    lists = attribution.groupBy("thread").agg(F.array_sort(F.collect_set("brand")).alias("brands"))
    authors = tweets.where("inbound").select("thread", "author_id").distinct()
    pairs = authors.join(loose(lists), "thread").select("author_id", "brands").distinct()
    pairs = pairs.select("author_id", F.explode("brands").alias("brand")).distinct()
    return pairs.groupBy("brand").agg(F.count("*").alias("unique_customers"))


def brand_stats(tweets: DataFrame) -> DataFrame:
    """Roll-up per brand, 11 measures before the score."""
    attribution = attribute_threads(tweets)
    joined = attribution.join(thread_totals(tweets), "thread")
    answered = F.col("has_both") & F.col("responding")
    stats = joined.groupBy("brand").agg(
        F.sum(F.col("n_in") + F.col("own_outbound")).alias("total_tweets"),
        F.sum("n_in").alias("inbound_tweets"),
        F.sum("own_outbound").alias("outbound_tweets"),
        F.lit(1).cast("long").alias("unique_support_accounts"),
        F.sum("n_link").alias("conversation_links"),
        F.count("*").alias("conversation_count"),
        F.count_if(answered).alias("complete_conversations"),
        F.count_if(F.col("is_multi") & F.col("responding")).alias("multi_turn_conversations"),
        F.round(F.avg("conv_len"), 2).alias("avg_conversation_length"),
        F.round(F.count_if(answered) / F.count("*"), 4).alias("response_rate"),
    )
    customers = customers_per_brand(tweets, attribution)
    return stats.join(customers, "brand", "left").select(
        "brand",
        "total_tweets",
        "inbound_tweets",
        "outbound_tweets",
        F.coalesce("unique_customers", F.lit(0)).alias("unique_customers"),
        "unique_support_accounts",
        "conversation_links",
        "conversation_count",
        "complete_conversations",
        "multi_turn_conversations",
        "avg_conversation_length",
        "response_rate",
    )


def score_brands(stats: DataFrame, weights: Mapping[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """Weighted score of max-normalised measures; a maximum of zero counts as one."""
    top = stats.agg(
        F.struct(
            F.max("complete_conversations").alias("complete"),
            F.max("multi_turn_conversations").alias("multi"),
            F.max("unique_customers").alias("customers"),
        ).alias("top")
    ).scalar()
    ratio = lambda c, key: F.col(c) / F.coalesce(F.nullif(top.getField(key), F.lit(0)), F.lit(1))
    score = (
        weights["complete"] * ratio("complete_conversations", "complete")
        + weights["multi"] * ratio("multi_turn_conversations", "multi")
        + weights["response"] * F.col("response_rate")
        + weights["customers"] * ratio("unique_customers", "customers")
        + weights["length"] * F.least(F.col("avg_conversation_length") / 10.0, F.lit(1.0))
    )
    return stats.withColumn("quality_score", F.round(score, 4))


def rank_brands(scored: DataFrame, top: int = 20) -> DataFrame:
    """Best brands with their rank, name as tie-break."""
    best = scored.orderBy(F.desc("quality_score"), "brand").limit(top)
    order = W.orderBy(F.desc("quality_score"), "brand")
    return best.withColumn("rank", F.row_number().over(order))


def _tier(value: Column, bounds: tuple, names: tuple[str, str, str]) -> Column:
    return F.when(value >= bounds[0], names[0]).when(value >= bounds[1], names[1]).otherwise(names[2])


def brand_verdicts(stats: DataFrame, tiers: Mapping[str, tuple] = TIERS) -> DataFrame:
    """Tier per measure; only a low multi-turn volume makes a brand marginal."""
    multi = F.col("multi_turn_conversations")
    return stats.select(
        "brand",
        _tier(multi, tiers["multi"], ("Excellent", "Adequate", "Low")).alias("multi_turn_tier"),
        _tier(F.col("unique_customers"), tiers["customers"], ("Large", "Moderate", "Small")).alias(
            "customer_tier"
        ),
        _tier(F.col("response_rate"), tiers["response"], ("High", "Moderate", "Low")).alias(
            "response_tier"
        ),
        _tier(
            F.col("avg_conversation_length"), tiers["length"], ("Good", "Adequate", "Shallow")
        ).alias("depth_tier"),
        F.when(multi >= tiers["multi"][1], "Suitable").otherwise("Marginal").alias("verdict"),
    )


def recommend_brands(
    ranked: DataFrame, top: int = 3, floors: Mapping[str, float] = REASON_FLOORS
) -> DataFrame:
    """The best brands with the reasons whose floor they reach."""
    reasons = F.array(
        F.when(F.col("multi_turn_conversations") >= floors["multi"], "multi_turn_volume"),
        F.when(F.col("unique_customers") >= floors["customers"], "customer_breadth"),
        F.when(F.col("response_rate") >= floors["response"], "response_rate"),
        F.when(F.col("avg_conversation_length") >= floors["length"], "conversation_depth"),
    )
    kept = F.filter(reasons, lambda r: r.isNotNull())
    return ranked.where(F.col("rank") <= top).select("rank", "brand", kept.alias("reasons"))
