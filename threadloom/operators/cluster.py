"""Spherical k-means and cluster roll-up."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.lexicons import (
    CLUSTER_NAME_RULES,
    CONCEPT_INTENTS,
    CONFUSABLE_CONCEPT,
    CONFUSABLE_KEYWORD,
    OTHER,
)
from threadloom.functions.ordering import sample_key
from threadloom.session import cut_lineage, ship_package


# Centroid weights that may be sent to every executor; counted before each round.
BROADCAST_CELLS = 4_000_000


def spherical_kmeans(
    vectors: DataFrame, k: int, seed: int = 42, max_iters: int = 30
) -> DataFrame:
    """K1: (doc_id, cluster) for every document with a non-empty vector.

    ``vectors`` is (doc_id, term, w) with unit documents. While the weights of all
    centroids are few enough to broadcast, a document is one row of numbered terms,
    and a round is one pass in which each task places its documents in numpy and adds
    up the sums of the next centroids. With more of them, centroids are one row per
    term with an array of k weights, and the postings are joined to them.

    The first centroids are the k first documents of the seeded order. Ties and
    documents that share no term with any centroid go to the lowest cluster. An
    empty cluster restarts from the next document in that order.
    """
    names = cut_lineage(vectors.select("term").distinct())
    size = names.count()
    if 0 < size * k <= BROADCAST_CELLS:
        return _kmeans_in_passes(vectors, names, size, k, seed, max_iters)
    return _kmeans_by_joins(vectors, k, seed, max_iters)


def _kmeans_in_passes(vectors: DataFrame, names: DataFrame, size: int, k: int, seed: int, max_iters: int) -> DataFrame:
    """One job a round; the driver holds the centroids, ``size`` times k numbers."""
    spark = vectors.sparkSession
    ship_package(spark)
    # At most BROADCAST_CELLS terms, so they may be numbered in one task.
    numbered = cut_lineage(names.select("term", (F.row_number().over(W.orderBy("term")) - 1).alias("at")))
    docs = (
        vectors.join(F.broadcast(numbered), "term")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("at", "w")).alias("v"))
        .select("doc_id", F.xxhash64("doc_id").alias("h"), F.col("v.at").alias("at"), F.col("v.w").alias("w"))
    )
    docs = cut_lineage(docs)
    order = docs.select("doc_id").orderBy(sample_key(seed, "doc_id"), "doc_id")
    first = lambda n: [r["doc_id"] for r in order.limit(n).collect()]
    seeds = first(k)
    used = k = len(seeds)

    def start_from(table: np.ndarray, columns: list[int], ids: list) -> None:
        rows = {r["doc_id"]: r for r in docs.where(F.col("doc_id").isin(ids)).collect()}
        for column, doc in zip(columns, ids):
            table[:, column] = 0.0
            table[rows[doc]["at"], column] = rows[doc]["w"]

    sums = np.zeros((size, k))
    start_from(sums, list(range(k)), seeds)
    table, before = sums / np.sqrt((sums * sums).sum(axis=0)), None
    for last in range(1, max_iters + 1):
        sums, mark = _pass(docs, table)
        if mark == before or last == max_iters:
            break
        before = mark
        norms = np.sqrt((sums * sums).sum(axis=0))
        table = sums / np.where(norms > 0, norms, 1.0)
        empty = [i for i in range(k) if not norms[i]]
        if empty:
            spare = first(used + len(empty))[used:] or seeds
            used += len(empty)
            start_from(table, empty, [spare[i % len(spare)] for i in range(len(empty))])
    sent = spark.sparkContext.broadcast(table)

    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(placed(batch, sent.value)[0], pa.int32())], ["doc_id", "cluster"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    assigned = cut_lineage(docs.mapInArrow(task, f"doc_id {kind}, cluster int"))
    sent.destroy()
    return assigned


def _pass(docs: DataFrame, table: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The sums of each cluster's documents, and an order-free digest of which cluster each document is in."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cluster_sums(source, sent.value)

    k = table.shape[1]
    # Documents stream through a task, so a task for each core will do; each of them hands on a row for every term.
    few = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    found = few.mapInArrow(task, "at int, x array<double>, mark bigint").groupBy("at")
    rows = found.agg(F.bit_xor("mark").alias("mark"), *[F.sum(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(k)]).toArrow()
    sent.destroy()
    at, x = rows["at"].to_numpy(), np.stack([rows[f"x{i}"].to_numpy() for i in range(k)], axis=1)
    sums = np.zeros(table.shape)
    sums[at[at >= 0]] = x[at >= 0]
    return sums, (rows["mark"].to_numpy()[at < 0].tolist(), x[at < 0, 0].tolist())


def placed(batch: pa.RecordBatch, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster of each document of a batch; place, weight and document of each posting. Scores are rounded so equal ones stay equal."""
    at, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
    sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    scores = np.stack([np.add.reduceat(w * table[at, i], begin) for i in range(table.shape[1])], axis=1)
    return np.round(scores, 9).argmax(axis=1), at, w, np.repeat(np.arange(len(sizes)), sizes)


def cluster_sums(source: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (term, sum of weights in each cluster, 0) of one task, and (-1, documents, digest)."""
    k = table.shape[1]
    sums, mark, count = np.zeros(table.size), np.uint64(0), 0
    for batch in source:
        if not batch.num_rows:
            continue
        cluster, at, w, doc = placed(batch, table)
        sums += np.bincount(at * k + cluster[doc], w, table.size)
        h = batch.column(1).to_numpy().view(np.uint64) + (cluster.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mark ^= np.bitwise_xor.reduce(h ^ (h >> np.uint64(31)))
        count += len(cluster)
    if count:
        sums = sums.reshape(table.shape)
        terms = np.flatnonzero(sums.any(axis=1))
        total = np.zeros((1, k))
        total[0, 0] = count
        at, x, marks = np.r_[-1, terms], np.concatenate([total, sums[terms]]), np.zeros(len(terms) + 1, np.uint64)
        marks[0] = mark
        for i in range(0, len(at), 100_000):
            part = slice(i, i + 100_000)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x[part].size + 1, k), pa.int32()), pa.array(x[part].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at[part], pa.int32()), lists, pa.array(marks[part].view(np.int64))], ["at", "x", "mark"])


def _kmeans_by_joins(vectors: DataFrame, k: int, seed: int, max_iters: int) -> DataFrame:
    """Documents lie together in one partition each, so a round adds up complete sums
    inside a task; postings are shuffled when the counted centroids are too many to broadcast.
    """
    vectors = cut_lineage(vectors.select("doc_id", "term", "w").repartition("doc_id"))
    ids = vectors.select("doc_id").distinct()
    order = ids.orderBy(sample_key(seed, "doc_id"), "doc_id")
    seeds = [r["doc_id"] for r in order.limit(k).collect()]
    k = len(seeds)
    if k == 0:
        return ids.withColumn("cluster", F.lit(0))
    used = k

    place = F.array_position(F.array(*[F.lit(s) for s in seeds]), F.col("doc_id")).cast("int") - 1
    start = vectors.where(F.col("doc_id").isin(seeds)).withColumn("cluster", place)
    centroids, _ = _centroids(start, k)
    assigned = None
    for _ in range(max_iters):
        new = cut_lineage(_assign(vectors, centroids, k))
        if assigned is not None:
            moved = new.join(assigned.withColumnRenamed("cluster", "before"), "doc_id").where(
                F.col("cluster") != F.col("before")
            )
            if moved.isEmpty():
                return new
        assigned = new
        centroids, norms = _centroids(vectors.join(assigned, "doc_id"), k)
        empty = [i for i in range(k) if not norms[i]]
        if empty:
            spare = [r["doc_id"] for r in order.limit(used + len(empty)).collect()][used:] or seeds
            used += len(empty)
            fresh = [(c, spare[i % len(spare)]) for i, c in enumerate(empty)]
            centroids = _restart(centroids, vectors, fresh, k)
    return assigned


def _assign(vectors: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """Most similar centroid per document; sums are rounded so equal ones stay equal."""
    part = lambda i: F.coalesce(F.sum(F.col("w") * F.get("c", F.lit(i))), F.lit(0.0))
    scored = vectors.join(centroids, "term", "left").groupBy("doc_id").agg(
        F.array(*[F.round(part(i), 9) for i in range(k)]).alias("s")
    )
    return scored.select(
        "doc_id", (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("cluster")
    )


def _centroids(placed: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """K5: normalised sum per cluster as (term, array of k weights), and the k norms."""
    sums = placed.groupBy("term").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("cluster") == i, F.col("w"))), F.lit(0.0)).alias(f"c{i}")
            for i in range(k)
        ]
    )
    sums = cut_lineage(sums)
    squares = [F.sqrt(F.sum(F.col(f"c{i}") * F.col(f"c{i}"))) for i in range(k)]
    terms, *row = sums.agg(F.count("*"), *squares).first()
    norms = [float(v or 0.0) for v in row]
    cells = [F.col(f"c{i}") / F.lit(norms[i]) if norms[i] else F.lit(0.0) for i in range(k)]
    table = sums.select("term", F.array(*cells).alias("c"))
    return (F.broadcast(table) if terms * k <= BROADCAST_CELLS else table), norms


def _restart(centroids: DataFrame, vectors: DataFrame, fresh: list[tuple], k: int) -> DataFrame:
    """Give each empty cluster the vector of a document."""
    rows = centroids
    for cluster, doc in fresh:
        own = vectors.where(F.col("doc_id") == F.lit(doc)).select("term", F.col("w").alias("x"))
        rows = rows.join(own, "term", "full_outer").select(
            "term",
            F.transform(
                F.sequence(F.lit(0), F.lit(k - 1)),
                lambda i: F.when(i == cluster, F.coalesce(F.col("x"), F.lit(0.0))).otherwise(
                    F.coalesce(F.get("c", i), F.lit(0.0))
                ),
            ).alias("c"),
        )
    return rows


def outliers(docs: DataFrame, assignments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """K2: documents with an empty vector, which no cluster holds."""
    return docs.join(assignments.withColumnRenamed("doc_id", doc), doc, "left_anti")


def cluster_keywords(vectors: DataFrame, assignments: DataFrame, top_n: int = 5) -> DataFrame:
    """K3: (cluster, keywords), the heaviest terms by summed weight."""
    sums = (
        vectors.join(assignments, "doc_id")
        .groupBy("cluster", "term")
        .agg(F.round(F.sum("w"), 9).alias("weight"))
    )
    order = W.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    top = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    entry = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top.groupBy("cluster").agg(entry.alias("e")).select(
        "cluster", F.col("e.term").alias("keywords")
    )


def name_by_rules(
    keywords: Column | str, rules: Sequence[tuple[str, Sequence[Sequence[str]]]] = CLUSTER_NAME_RULES
) -> Column:
    """K4: first rule whose every word group hits the joined keywords, else unknown_<first>."""
    words = F.col(keywords) if isinstance(keywords, str) else keywords
    joined = F.array_join(words, " ")
    name = None
    for label, groups in rules:
        holds = F.lit(True)
        for group in groups:
            any_word = F.lit(False)
            for word in group:
                any_word = any_word | joined.contains(word)
            holds = holds & any_word
        name = F.when(holds, label) if name is None else name.when(holds, label)
    return name.otherwise(
        F.concat(F.lit("unknown_"), F.coalesce(F.get(words, F.lit(0)), F.lit("topic")))
    )


def centroids_long(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """K5: (cluster, term, w), the normalised sum of each cluster."""
    sums = (
        vectors.join(assignments, "doc_id").groupBy("cluster", "term").agg(F.sum("w").alias("x"))
    )
    norms = sums.groupBy("cluster").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return sums.join(norms, "cluster").where("norm > 0").select(
        "cluster", "term", (F.col("x") / F.col("norm")).alias("w")
    )


def name_by_centroid(
    centroids: DataFrame,
    mapping: Mapping[str, str] = CONCEPT_INTENTS,
    min_score: float = 0.2,
) -> DataFrame:
    """K6: (cluster, likely_intent_name) from the strongest concept, other when it is weak."""
    best = centroids.groupBy("cluster").agg(
        F.max(F.struct(F.round("w", 9).alias("w"), F.col("term"))).alias("m")
    )
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    named = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*pairs), lambda c, _: c == F.col("m.term"))), F.lit(0)), F.lit(OTHER))
    return best.select(
        "cluster",
        F.when(F.col("m.w") < min_score, OTHER).otherwise(named).alias("likely_intent_name"),
    )


def cluster_examples(
    docs: DataFrame, assignments: DataFrame, text: str, n: int = 5, seed: int = 42
) -> DataFrame:
    """K7: (cluster, representative_examples), n texts by seeded order."""
    rows = docs.select("doc_id", text).join(assignments, "doc_id")
    order = W.partitionBy("cluster").orderBy(sample_key(seed, "doc_id"), "doc_id")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    entry = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col(text).alias("text"))))
    return top.groupBy("cluster").agg(entry.alias("e")).select(
        "cluster", F.col("e.text").alias("representative_examples")
    )


def cluster_summary(
    docs: DataFrame,
    vectors: DataFrame,
    assignments: DataFrame,
    k: int,
    text: str = "text",
    rules: Sequence[tuple[str, Sequence[Sequence[str]]]] = CLUSTER_NAME_RULES,
) -> DataFrame:
    """K7 for keyword clusters: size, share of sample, keywords, name, confidence, examples."""
    total = docs.agg(F.count("*")).scalar()
    sizes = assignments.groupBy("cluster").agg(F.count("*").alias("num_examples"))
    rows = (
        sizes.join(cluster_keywords(vectors, assignments), "cluster")
        .join(cluster_examples(docs, assignments, text), "cluster")
    )
    return rows.select(
        F.col("cluster").alias("cluster_id"),
        "num_examples",
        (F.col("num_examples") * 100.0 / total).alias("percentage"),
        "representative_examples",
        "keywords",
        name_by_rules("keywords", rules).alias("likely_intent_name"),
        F.when(F.col("num_examples") > total / F.lit(k) * 0.5, "High").otherwise("Low").alias(
            "confidence"
        ),
    )


def concept_cluster_summary(
    docs: DataFrame,
    vectors: DataFrame,
    assignments: DataFrame,
    text: str = "text",
    mapping: Mapping[str, str] = CONCEPT_INTENTS,
) -> DataFrame:
    """K7 for concept clusters: as above with centroid and centroid name."""
    total = docs.agg(F.count("*")).scalar()
    sizes = assignments.groupBy("cluster").agg(F.count("*").alias("num_examples"))
    centroids = centroids_long(vectors, assignments)
    as_map = centroids.groupBy("cluster").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "w")))).alias("centroid")
    )
    rows = (
        sizes.join(as_map, "cluster")
        .join(name_by_centroid(centroids, mapping), "cluster")
        .join(cluster_examples(docs, assignments, text, n=10), "cluster")
    )
    return rows.select(
        F.col("cluster").alias("cluster_id"),
        "num_examples",
        (F.col("num_examples") * 100.0 / total).alias("percentage"),
        "representative_examples",
        "centroid",
        "likely_intent_name",
        F.when(F.col("likely_intent_name") == OTHER, "Low").otherwise("High").alias("confidence"),
    )


def _confusable(name: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """K9: intents that are easily confused with the given one."""
    found = F.array().cast("array<string>")
    for intent, others in table.items():
        found = F.when(name == intent, F.array(*[F.lit(o) for o in others])).otherwise(found)
    return found


def _title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def roll_up_taxonomy(
    clusters: DataFrame,
    confusable: Mapping[str, Sequence[str]] = CONFUSABLE_KEYWORD,
    examples: int = 5,
) -> DataFrame:
    """K8 for keyword clusters: merge clusters by name; unknown names become ``other``."""
    name = F.when(F.col("likely_intent_name").startswith("unknown_"), "other").otherwise(
        F.col("likely_intent_name")
    )
    grouped = clusters.groupBy(name.alias("intent_id")).agg(
        F.sum("num_examples").alias("count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("kw"),
        F.flatten(F.collect_list("representative_examples")).alias("ex"),
    )
    total = clusters.agg(F.sum("num_examples")).scalar()
    return grouped.select(
        "intent_id",
        _title(F.col("intent_id")).alias("intent_name"),
        "count",
        F.round(F.col("count") * 100.0 / total, 1).alias("estimated_percentage"),
        F.slice("kw", 1, 10).alias("common_keywords"),
        _pick(F.col("ex"), examples).alias("representative_examples"),
        _confusable(F.col("intent_id"), confusable).alias("confusable_intents"),
    )


def _pick(texts: Column, n: int, seed: int = 42) -> Column:
    """n texts of a short list in seeded order."""
    keyed = F.array_sort(F.transform(texts, lambda t: F.struct(sample_key(seed, t).alias("k"), t.alias("t"))))
    return F.slice(F.transform(keyed, lambda e: e["t"]), 1, n)


def roll_up_concepts(
    clusters: DataFrame,
    n_outliers: Column | int,
    n_sample: Column | int,
    confusable: Mapping[str, Sequence[str]] = CONFUSABLE_CONCEPT,
    examples: int = 10,
) -> DataFrame:
    """K8/K10 for concept clusters, with the unclustered messages as one more row.

    All shares use the sample as denominator. ``top_concepts`` are the three
    strongest concepts weighted by cluster size.
    """
    n_sample = F.lit(n_sample) if isinstance(n_sample, int) else n_sample
    n_outliers = F.lit(n_outliers) if isinstance(n_outliers, int) else n_outliers
    base = clusters.groupBy(F.col("likely_intent_name").alias("intent_id")).agg(
        F.sum("num_examples").alias("count"),
        F.flatten(F.collect_list("representative_examples")).alias("ex"),
    )
    weights = (
        clusters.select(
            F.col("likely_intent_name").alias("intent_id"), "num_examples", F.explode("centroid").alias("term", "w")
        )
        .groupBy("intent_id", "term")
        .agg(F.round(F.sum(F.col("w") * F.col("num_examples")), 9).alias("weight"))
    )
    order = W.partitionBy("intent_id").orderBy(F.desc("weight"), "term")
    top = (
        weights.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= 3)
        .groupBy("intent_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("e"))
        .select("intent_id", F.col("e.term").alias("top_concepts"))
    )
    rows = base.join(top, "intent_id").select(
        "intent_id",
        "count",
        "top_concepts",
        _pick(F.col("ex"), examples).alias("representative_examples"),
    )
    rest = clusters.sparkSession.range(1).select(
        F.lit(OTHER).alias("intent_id"),
        n_outliers.cast("long").alias("count"),
        F.array().cast("array<string>").alias("top_concepts"),
        F.array().cast("array<string>").alias("representative_examples"),
    ).where(F.col("count") > 0)
    return rows.unionByName(rest).select(
        "intent_id",
        _title(F.col("intent_id")).alias("intent_name"),
        "count",
        F.round(F.col("count") * 100.0 / n_sample, 1).alias("estimated_percentage"),
        "top_concepts",
        "representative_examples",
        _confusable(F.col("intent_id"), confusable).alias("confusable_intents"),
    )
