"""Sampling, splitting and leakage checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.lexicons import DIFFICULT, INTENT_HINTS, OTHER, QUOTAS
from threadloom.functions.ordering import hash_rank, sample_key, take_by_hash
from threadloom.functions.text import fingerprint, word_count
from threadloom.operators.tagging import tag_intents
from threadloom.session import cut_lineage, loose

CONV = "conversation_id"


def first_qualifying_turn(
    turns: DataFrame, min_words: int = 4, order: str = "turn_number", extra: Sequence[str] = ()
) -> DataFrame:
    """M3: first customer turn with enough words per conversation."""
    cols = [F.col(order).alias("turn_number"), F.col("text").alias("customer_message")]
    cols += [F.col(c) for c in extra]
    return (
        turns.where((F.col("speaker") == "customer") & (word_count("text") >= min_words))
        .groupBy(CONV)
        .agg(F.min(F.struct(*cols)).alias("m"))
        .select(CONV, "m.*")
    )


def one_per_text_and_author(
    rows: DataFrame, key: str, text_key: str, author: str, seed: int = 42, max_rounds: int = 200
) -> DataFrame:
    """M4: walk in seeded order and keep a row unless its text or author was kept before.

    A row that comes first in both its text group and its author group is kept
    for certain, and everything that shares a text or an author with it falls
    out. Repeating this to the end gives exactly the rows of the walk; in a
    seeded order few rounds are needed. Minima combine before the shuffle.
    """
    rank = F.struct(sample_key(seed, key).alias("h"), F.col(key).alias("k"))
    left = cut_lineage(
        rows.select(F.col(key).alias("key"), F.col(text_key).alias("t"), F.col(author).alias("a"), rank.alias("r"))
    )
    kept: DataFrame | None = None
    for _ in range(max_rounds):
        by_text = left.groupBy("t").agg(F.min(F.struct("r", "key", "a")).alias("m"))
        by_author = left.groupBy("a").agg(F.min(F.struct("r", "key", "t")).alias("m"))
        first = cut_lineage(
            by_text.select(F.col("m.key").alias("key"), "t", F.col("m.a").alias("a")).join(
                by_author.select(F.col("m.key").alias("key")), "key", "left_semi"
            )
        )
        kept = first if kept is None else kept.unionByName(first)
        left = cut_lineage(
            left.join(first.select("t"), "t", "left_anti").join(first.select("a"), "a", "left_anti")
        )
        if left.isEmpty():
            return rows.join(kept.select(F.col("key").alias(key)), key, "left_semi")
    raise RuntimeError(f"walk not finished after {max_rounds} rounds")


def stratum_of(tags: Column | str) -> Column:
    """M6: two or more hits are difficult, one is that intent, none is other."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return (
        F.when(F.size(tags) >= 2, F.lit(DIFFICULT))
        .when(F.size(tags) == 1, F.get(tags, F.lit(0)))
        .otherwise(F.lit(OTHER))
    )


def sample_quota(
    pool: DataFrame, stratum: str, key: str, quotas: Mapping[str, int] = QUOTAS, seed: int = 42
) -> DataFrame:
    """M7: per stratum the first rows of the seeded order up to its quota.

    The largest quota bounds the rank with a constant, so each task passes on at
    most that many rows of a stratum before the shuffle.
    """
    order = W.partitionBy(stratum).orderBy(sample_key(seed, key), key)
    ranked = pool.withColumn("_n", F.row_number().over(order)).where(
        F.col("_n") <= max(quotas.values())
    )
    items = [F.lit(x) for item in quotas.items() for x in item]
    quota = F.try_element_at(F.create_map(*items), F.col(stratum))
    return ranked.where(F.col("_n") <= quota).drop("_n")


def previous_turns(
    turns: DataFrame, chosen: DataFrame, order: str = "turn_number", max_turns_per_row: int = 10_000
) -> DataFrame:
    """M5: context of the chosen turns per (conversation, part): earlier texts in order and the next brand reply.

    Only conversations in ``chosen`` (a sample) are looked at. Part p holds the
    earlier turns numbered from p * max_turns_per_row + 1 on, as in ``nest_turns``, so
    no row grows without bound. Part 0 is always there and has the reply.
    """
    at = chosen.select(CONV, F.col("turn_number").alias("_at"))
    near = turns.join(loose(at), CONV)
    entry = F.struct(F.col(order).alias("n"), F.col("text").alias("x"), F.col("speaker").alias("s"))
    part = F.floor((F.col(order) - 1) / max_turns_per_row).cast("int").alias("part")
    before = near.where(F.col(order) < F.col("_at")).groupBy(CONV, part).agg(F.array_sort(F.collect_list(entry)).alias("b"))
    reply = F.min(F.when((F.col(order) > F.col("_at")) & (F.col("speaker") == "brand"), entry))
    first = near.groupBy(CONV).agg(reply.alias("r")).select(CONV, F.lit(0).alias("part"), "r")
    none = F.array().cast("array<string>")
    return first.join(before, [CONV, "part"], "full_outer").select(
        CONV,
        "part",
        F.coalesce("b.x", none).alias("previous_turns"),
        F.coalesce("b.s", none).alias("previous_speakers"),
        F.col("r.x").alias("brand_response"),
    )


def sequential_ids(
    rows: DataFrame, key: str, seed: int = 42, prefix: str = "gold_", out: str = "example_id"
) -> DataFrame:
    """M2/M8: reshuffle and number the rows gold_0001, gold_0002, ..."""
    ranked = hash_rank(rows, [key], seed, "_n")
    return ranked.withColumn(out, F.format_string(prefix + "%04d", F.col("_n"))).drop("_n")


def golden_candidates(
    turns: DataFrame,
    lexicon: Mapping[str, Sequence[str]] = INTENT_HINTS,
    quotas: Mapping[str, int] = QUOTAS,
    seed: int = 42,
    max_turns_per_row: int = 10_000,
) -> DataFrame:
    """M2-M8: stratified sample of conversations for labelling, with null label fields.

    One row per example, or one per (example, part) where the context has several parts.
    The turns are read twice: for the first messages, which are stored, and for the turns
    of the sample, which the quotas bound.
    """
    first = first_qualifying_turn(turns, extra=("author_id", "created_at"))
    first = cut_lineage(first.withColumn("_fp", fingerprint("customer_message")))
    unique = one_per_text_and_author(first, CONV, "_fp", "author_id", seed)
    tagged = unique.withColumn("candidate_intents", tag_intents("customer_message", lexicon))
    tagged = tagged.withColumn("stratum", stratum_of("candidate_intents"))
    chosen = cut_lineage(sample_quota(tagged, "stratum", CONV, quotas, seed))
    near = cut_lineage(turns.join(F.broadcast(chosen.select(CONV)), CONV, "left_semi"))
    numbered = sequential_ids(chosen, CONV, seed + 1).join(previous_turns(near, chosen, max_turns_per_row=max_turns_per_row), CONV, "left")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return numbered.select(
        "example_id",
        CONV,
        "created_at",
        "customer_message",
        "previous_turns",
        "previous_speakers",
        "brand_response",
        "candidate_intents",
        none("string", "human_intent"),
        none("boolean", "human_escalate"),
        none("string", "human_reason"),
        none("string", "annotation_notes"),
        "part",
    )


def sample_fixed(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """M1: reproducible sample of n rows."""
    return take_by_hash(rows, [key], n, seed)


def length_bucket(n: Column | str) -> Column:
    """M9: short 2, medium 3-5, long 6-10, very long 11 and more; null below 2."""
    n = F.col(n) if isinstance(n, str) else n
    return (
        F.when(n >= 11, "very_long").when(n >= 6, "long").when(n >= 3, "medium").when(n == 2, "short")
    )


def sample_buckets(convs: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """M9: n/4 sound conversations per length bucket, topped up from the rest."""
    flagged = F.col("is_flagged") if "is_flagged" in convs.columns else F.lit(False)
    pool = convs.where(F.col("brand_responded") & ~flagged & (F.col("num_turns") >= 2))
    pool = pool.withColumn("bucket", length_bucket("num_turns"))
    per_bucket = max(1, n // 4)
    order = W.partitionBy("bucket").orderBy(sample_key(seed, CONV), CONV)
    ranked = pool.withColumn("_n", F.row_number().over(order)).withColumn(
        "_first", F.col("_n") <= per_bucket
    )
    # Within a bucket at most n more rows can be needed, so n + n/4 per bucket decide.
    ranked = ranked.where(F.col("_n") <= per_bucket + n)
    best = ranked.orderBy(F.desc("_first"), sample_key(seed, CONV), CONV).limit(n)
    return best.drop("_n", "_first")


def split(
    convs: DataFrame, turns: DataFrame, golden: DataFrame, ratio: float = 0.8, seed: int = 42
) -> DataFrame:
    """(conversation_id, part) with part dev / val.

    Golden conversations and every conversation in which a customer wrote a
    golden text are left out first. The cut is exact: the first
    floor(ratio * n) of the seeded order.
    """
    rest = convs.select(CONV).distinct().join(golden.select(CONV), CONV, "left_anti")
    rest = rest.join(leaking_turns(turns, golden).select(CONV).distinct(), CONV, "left_anti")
    rest = cut_lineage(rest)
    n = rest.agg(F.count("*")).scalar()
    ranked = hash_rank(rest, [CONV], seed, "_n")
    part = F.when(F.col("_n") <= F.floor(F.lit(ratio) * n), "dev").otherwise("val")
    return ranked.select(CONV, part.alias("part"))


def leaking_turns(turns: DataFrame, golden: DataFrame) -> DataFrame:
    """Customer turns whose fingerprint is that of a golden message."""
    texts = golden.select(fingerprint("customer_message").alias("fp")).distinct()
    said = turns.where(F.col("speaker") == "customer").withColumn("fp", fingerprint("text"))
    return said.join(loose(texts), "fp", "left_semi")


def leakage_audit(turns: DataFrame, golden: DataFrame, splits: DataFrame) -> DataFrame:
    """(check_name, found): overlaps of the parts and golden texts in dev."""
    gold = golden.select(CONV).distinct()
    dev = splits.where("part = 'dev'").select(CONV).distinct()
    val = splits.where("part = 'val'").select(CONV).distinct()
    both = lambda a, b, name: a.join(b, CONV, "left_semi").agg(F.count("*").alias("found")).select(
        F.lit(name).alias("check_name"), "found"
    )
    texts = leaking_turns(turns, golden).join(dev, CONV, "left_semi")
    return (
        both(gold, dev, "golden_in_dev")
        .unionByName(both(gold, val, "golden_in_val"))
        .unionByName(both(dev, val, "dev_in_val"))
        .unionByName(
            texts.agg(F.count("*").alias("found")).select(
                F.lit("golden_text_in_dev").alias("check_name"), "found"
            )
        )
    )


def pilot_subset(rows: DataFrame, ids: Sequence[str], key: str = "example_id") -> DataFrame:
    """The listed rows in list order."""
    listed = rows.sparkSession.createDataFrame(
        list(enumerate(ids)), f"pos int, {key} string"
    )
    return rows.join(listed, key).orderBy("pos")


def sampling_audit(golden: DataFrame) -> DataFrame:
    """Rows and distinct conversations per stratum, and in total."""
    rows = golden.withColumn("stratum", stratum_of("candidate_intents"))
    sizes = [F.count("*").alias("examples"), F.countDistinct(CONV).alias("conversations")]
    per = rows.groupBy("stratum").agg(*sizes)
    return per.unionByName(rows.agg(*sizes).select(F.lit("total").alias("stratum"), "examples", "conversations"))
