"""Reply graph and threads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.parsing import safe_long
from threadloom.session import cut_lineage, loose, ship_package

#: Edges that one task contracts at a time.
RUN_EDGES = 2_000_000
#: Ids of which more than one link hangs, up to which only their components go through rounds.
FEW_IDS = 200_000


def reply_edges(tweets: DataFrame, split_multi: bool = False) -> DataFrame:
    """G1: (src, dst) for each reply reference that is one whole number.

    ``response_tweet_id`` may hold a comma list; it is skipped unless
    ``split_multi`` asks for one edge per member. The tweets are read once.
    """
    named = F.split("response_tweet_id", ",") if split_multi else F.array(F.col("response_tweet_id").cast("string"))
    parent = F.array(F.col("in_response_to_tweet_id").cast("string"))
    others = F.concat(parent, F.coalesce(named, F.array().cast("array<string>")))
    both = tweets.select(safe_long("tweet_id").alias("src"), F.explode(others).alias("m"))
    both = both.select("src", safe_long("m").alias("dst"))
    return both.where("src is not null and dst is not null and src <> dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) for every edge end, component = smallest id in it.

    Edges are dealt by ranges of ids, since most replies are near what they answer,
    and each task replaces those it has by links to the smallest id that it can
    reach. Components that are stars by then are done, if few are not. For the others
    large-star and small-star steps alternate until only stars are left.
    The minimum per vertex is combined before the shuffle, and the join that hands
    it back matches each edge to one row and has plain exchanges on both sides,
    so AQE can split a hub. The edge
    list is checkpointed every round: the plan stays short and the loop goes on
    after the loss of an executor.
    """
    ship_package(edges.sparkSession)
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v")
    if pairs.dtypes[0][1] == "bigint":
        pairs = pairs.repartitionByRange("u").mapInArrow(contract, "u bigint, v bigint")
    else:
        pairs = pairs.distinct()
    pairs = cut_lineage(pairs)
    few = _tied(pairs).limit(FEW_IDS + 1).toArrow()
    tied, done = few.num_rows, None
    if 0 < tied <= FEW_IDS:
        ids = F.broadcast(edges.sparkSession.createDataFrame(few))
        tops = pairs.join(ids.withColumnRenamed("id", "u"), "u").select("v")
        tops = cut_lineage(tops.unionByName(ids.withColumnRenamed("id", "v")).distinct())
        if tops.count() <= 2 * FEW_IDS:
            done = pairs.join(F.broadcast(tops), "v", "left_anti").select("u", "v")
            pairs = cut_lineage(pairs.join(F.broadcast(tops), "v", "left_semi").select("u", "v"))
    for _ in range(max_rounds):
        if not tied:
            pairs = pairs if done is None else pairs.unionByName(done)
            roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                roots
            )
        large = cut_lineage(_large_star(pairs))  # read twice by the next step
        pairs = cut_lineage(_small_star(large))
        tied = _tied(pairs).count()
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def contract(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) from every vertex to the smallest one of its component in the edges of one task."""
    waiting, n = [], 0
    for batch in source:
        waiting.append(batch)
        n += batch.num_rows
        if n >= RUN_EDGES:
            yield _contracted(waiting)
            waiting, n = [], 0
    if n:
        yield _contracted(waiting)


def _contracted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    ends = [np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1)]
    ids, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = at[: len(ends[0])], at[len(ends[0]) :]
    root = np.arange(len(ids))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, up := root[root]):
            root = up
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["u", "v"])


def _tied(pairs: DataFrame) -> DataFrame:
    """Ids with a second link, or with one and a vertex linked to them; there are none if only stars are left."""
    links = pairs.select(F.col("u").alias("id"), F.lit(1).alias("n"), F.lit(0).alias("top"))
    tops = pairs.select(F.col("v").alias("id"), F.lit(0).alias("n"), F.lit(1).alias("top"))
    seen = links.unionByName(tops).groupBy("id").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    return seen.where((F.col("n") + F.col("top") > 1) & (F.col("n") > 0)).select("id")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex around it."""
    around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = around.where("v > u").join(loose(least), "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(loose(least), "u").where("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()


def latest_per_id(df: DataFrame, id_col: str, ingest_order: str) -> DataFrame:
    """Of rows that share an id, the last one taken in."""
    row = F.struct(*df.columns)
    return (
        df.groupBy(F.col(id_col).alias("_id"))
        .agg(F.max_by(row, F.col(ingest_order)).alias("r"))
        .select("r.*")
    )


def thread_of_tweets(tweet_ids: DataFrame, components: DataFrame) -> DataFrame:
    """(tweet_id, thread) for tweets in the data.

    ``thread`` is the smallest tweet id of the component that is really there;
    ids that are only referred to join tweets but name no thread. A tweet
    without edges is its own thread.
    """
    placed = tweet_ids.select("tweet_id").join(
        components.withColumnRenamed("id", "tweet_id"), "tweet_id", "left"
    )
    placed = placed.withColumn("component", F.coalesce("component", "tweet_id"))
    names = placed.groupBy("component").agg(F.min("tweet_id").alias("thread"))
    return placed.join(loose(names), "component").select("tweet_id", "thread")


def select_brand_threads(tweets: DataFrame, brands: list[str]) -> DataFrame:
    """All tweets of every thread in which one of the brands wrote.

    Expects (tweet_id, thread, author_id, ...); authors compare without case.
    """
    lowered = [b.lower() for b in brands]
    wanted = tweets.where(F.lower("author_id").isin(lowered)).select("thread").distinct()
    return tweets.join(loose(wanted), "thread", "left_semi")
