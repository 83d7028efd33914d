"""Joins with a reduced side are split at a hot key, and give the same rows."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import graph, sampling, vectors

SKEW = {
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def spread_out(df):
    """Many map tasks, so that a hot partition can be cut by them."""
    return df.repartition(16)


def test_large_star(skewed):
    hub = skewed.range(20_000).select((F.col("id") + 10).alias("u"), F.lit(5).cast("long").alias("v"))
    out = graph._large_star(spread_out(hub.unionByName(skewed.range(200).select((F.col("id") + 50_000).alias("u"), F.col("id").alias("v")))))
    assert "skew=true" in final_plan(out)
    assert out.count() == 20_200


def test_threads(skewed):
    tweets = spread_out(skewed.range(30_000).select(F.col("id").alias("tweet_id")))
    found = spread_out(skewed.range(30_000).select("id", F.when(F.col("id") < 29_000, 0).otherwise(F.col("id")).cast("long").alias("component")))
    out = graph.thread_of_tweets(tweets, found)
    assert "skew=true" in final_plan(out)
    assert out.where("thread = 0").count() == 29_000


def test_tfidf(skewed):
    term = F.when(F.col("id") % 10 < 8, F.lit("common")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
    tokens = spread_out(skewed.range(30_000).select((F.col("id") + 0).alias("doc_id"), term.alias("term"), F.lit(1).alias("pos"), F.lit(1).alias("doc_len")))
    counts = tokens.groupBy("doc_id", "term", "doc_len").agg(F.count("*").alias("n"))
    idf = vectors.inverse_document_frequency(counts, F.lit(30_000))
    from threadloom.session import loose

    out = spread_out(counts).join(loose(idf), "term")
    assert "skew=true" in final_plan(out)
    assert out.count() == 30_000


def test_leaking_turns(skewed):
    turns = spread_out(skewed.range(20_000).select(F.lit("customer").alias("speaker"), F.when(F.col("id") % 50 != 0, "where is my parcel today").otherwise(F.concat(F.lit("number "), F.col("id").cast("string"))).alias("text"), F.col("id")))
    golden = skewed.createDataFrame([("Where is my parcel today?",), ("other words",)], "customer_message string")
    out = sampling.leaking_turns(turns, golden)
    assert "skew=true" in final_plan(out)
    assert out.count() == 19_600


def test_quantiles_with_an_outlier(skewed):
    """One huge value doesn't press the others into one slice."""
    import numpy as np

    from threadloom.functions import ordering

    seen = []
    offsets = ordering._with_offsets

    def watched(df, bucket, weight):
        seen.append([r["n"] for r in df.groupBy(bucket).agg(F.count("*").alias("n")).collect()])
        return offsets(df, bucket, weight)

    ordering._with_offsets = watched
    try:
        df = skewed.range(20_000).select(F.when(F.col("id") == 0, 1e12).otherwise(F.col("id").cast("double")).alias("x"))
        got = {r["prob"]: r["x"] for r in ordering.quantiles(df, "x", [0.1, 0.5, 0.999]).collect()}
    finally:
        ordering._with_offsets = offsets
    values = np.array([1e12, *range(1, 20_000)])
    assert all(abs(got[p] - np.quantile(values, p)) < 1e-6 for p in got) and len(got) == 3
    assert len(seen[0]) > 4 and max(seen[0]) < 8_000


def test_no_row_per_author_in_customers_per_brand(spark):
    from threadloom.operators.brands import customers_per_brand

    tweets = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "a", True), (3, "a", True), (3, "c", False), (3, None, True)], "thread long, author_id string, inbound boolean")
    attribution = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "z")], "thread long, brand string")
    got = customers_per_brand(tweets, attribution)
    assert {r["brand"]: r["unique_customers"] for r in got.collect()} == {"x": 2, "y": 2, "z": 2}
    assert "flatten" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_of_token_counts_follow_the_text(spark, monkeypatch):
    from threadloom.functions import text as tx

    monkeypatch.setattr(vectors, "HOT_TERMS", 3)
    monkeypatch.setattr(vectors, "PART_ROWS", 500)
    docs = spark.range(800).select(F.col("id").alias("doc_id"), F.concat(F.lit("all "), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), (F.col("id") % (7 + 40 * i)).cast("string")) for i in range(9)])).alias("text"))
    whole = {(r["doc_id"], r["term"]): r["w"] for r in vectors.tfidf(tx.token_rows(docs, "doc_id", "text", ()), docs).collect()}
    assert len(whole) == 8000
    part = lambda df: df.select(F.spark_partition_id()).distinct().count()
    few = part(tx.token_rows(docs, "doc_id", "text", ()))
    monkeypatch.setattr(tx.parts_of, "__defaults__", (1000, None))
    tokens = tx.token_rows(docs, "doc_id", "text", ())
    # Spark's number of shuffle partitions is 8 here whatever the text.
    assert few <= 8 < 20 < part(vectors.term_counts(tokens))
    out = vectors.tfidf(tokens, docs)
    assert part(out) > 8
    again = {(r["doc_id"], r["term"]): r["w"] for r in out.collect()}
    assert whole.keys() == again.keys() and all(abs(whole[k] - again[k]) < 1e-12 for k in whole)
    df = {}
    for _, term in whole:
        df[term] = df.get(term, 0) + 1
    import math

    own = {t: math.log(801 / (1 + df[t])) + 1 for d, t in whole if d == 5}
    norm = math.sqrt(sum(x * x for x in own.values()))
    assert all(abs(whole[5, t] - x / norm) < 1e-12 for t, x in own.items())
