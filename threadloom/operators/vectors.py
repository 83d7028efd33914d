"""Sparse vectors (V1-V4): postings in long form, one row per (doc_id, term)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.lexicons import CONCEPTS
from threadloom.functions.text import WORD
from threadloom.session import cut_lineage

#: Terms that are sent to every executor, the commonest ones.
HOT_TERMS = 131_072
#: Postings that one task joins or scales.
PART_ROWS = 1_000_000


def term_counts(tokens: DataFrame) -> DataFrame:
    """Term frequency per document from token rows: (doc_id, term, n, doc_len).

    Token rows come placed by document, so neither step shuffles again.
    """
    counts = tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return counts.withColumn("doc_len", F.sum("n").over(W.partitionBy("doc_id")))


def inverse_document_frequency(counts: DataFrame, n_docs: Column) -> DataFrame:
    """V1: (term, df, idf) with idf = ln((1+N)/(1+df)) + 1; N counts empty documents too.

    ``weight`` in the input, when there, says how many documents a row stands for.
    """
    copies = F.col("weight") if "weight" in counts.columns else F.lit(1)
    table = counts.groupBy("term").agg(F.sum(copies).cast("long").alias("df"))
    return table.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def commonest(terms: DataFrame, limit: int = HOT_TERMS) -> int:
    """The least power of two that at most ``limit`` terms have as their df."""
    power = F.floor(F.log2("df")).cast("int").alias("power")
    sizes = sorted(tuple(r) for r in terms.groupBy(power).agg(F.count("*")).collect())
    least, total = 63, 0
    for power, n in reversed(sizes):
        total += n
        if total > limit:
            break
        least = power
    return 2**least


def tfidf(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """V2: (doc_id, term, w), each document scaled to length one.

    The commonest terms, which are most postings and the only hot ones, get their
    idf where the document lies; the others are shuffled by term. Both shuffles
    have a partition for so many postings. The length of a document cancels out.
    """
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    counted = lambda rows: rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    idf = cut_lineage(inverse_document_frequency(counted(tokens), n_docs))
    postings = idf.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-postings // PART_ROWS))
    least = commonest(idf)
    common = F.broadcast(idf.where(F.col("df") >= least).select("term", "idf"))
    rare = idf.where(F.col("df") < least).select("term", "idf").repartition(parts, "term")
    weight = (F.col("n") * F.col("idf")).alias("x")
    here = counted(tokens).join(common, "term").select("doc_id", "term", weight)
    apart = counted(tokens.join(common, "term", "left_anti")).repartition(parts, "term")
    there = apart.join(rare, "term").select("doc_id", "term", weight)
    return unit_length(here.unionByName(there).repartition(parts, "doc_id"), "doc_id", "term", "x")


def unit_length(raw: DataFrame, doc: str, key: str, value: str) -> DataFrame:
    """Divide each vector by its norm: (doc, key, w). Zero vectors disappear."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(W.partitionBy(doc)))
    return (
        raw.withColumn("_norm", norm)
        .where(F.col("_norm") > 0)
        .select(doc, key, (F.col(value) / F.col("_norm")).alias("w"))
    )


def pair_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """V3: dot product for given pairs (left_id, right_id); pairs without a shared term get 0.

    Joins on a document id and on (document, term), never on a bare term.
    """
    a = left.select(F.col("doc_id").alias("left_id"), "term", F.col("w").alias("wa"))
    b = right.select(F.col("doc_id").alias("right_id"), "term", F.col("w").alias("wb"))
    wanted = pairs.select("left_id", "right_id").distinct()
    dots = (
        wanted.join(a, "left_id")
        .join(b, ["right_id", "term"])
        .groupBy("left_id", "right_id")
        .agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    )
    return wanted.join(dots, ["left_id", "right_id"], "left").select(
        "left_id", "right_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity")
    )


def concept_vectors(
    messages: DataFrame,
    text: str,
    doc: str = "doc_id",
    concepts: Mapping[str, Sequence[str]] = CONCEPTS,
) -> DataFrame:
    """V4: (doc_id, term, w) over concept axes, scaled to length one.

    A phrase that occurs adds 2; a single keyword adds its number of whole-word
    occurrences. Phrases found are put behind the words of a message (no word
    holds a space), so all axes are counted in one pass over that list and one
    row per message is shuffled.
    """
    names = list(concepts)
    phrases = {c: [k for k in concepts[c] if " " in k] for c in names}
    singles = {c: [k for k in concepts[c] if " " not in k] for c in names}
    low = F.col("_low")
    found = [F.when(low.contains(p), F.lit(p)) for c in names for p in phrases[c]]
    items = F.split(low, f"[^{WORD[1:]}+")
    if found:
        items = F.concat(items, F.array_distinct(F.array_compact(F.array(*found))))
    words = messages.select(F.col(doc).alias("doc_id"), F.lower(F.col(text)).alias("_low")).select(
        "doc_id", F.explode(items).alias("_item")
    )

    def score(c: str) -> Column:
        once = F.count_if(F.col("_item").isin(singles[c])).cast("double")
        return once + 2.0 * F.count_if(F.col("_item").isin(phrases[c])) if phrases[c] else once

    scored = words.groupBy("doc_id").agg(*[score(c).alias(c) for c in names])
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)))
    entries = F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).alias("x")) for c in names])
    return (
        scored.select("doc_id", norm.alias("_norm"), F.inline(entries))
        .where(F.col("x") > 0)
        .select("doc_id", "term", (F.col("x") / F.col("_norm")).alias("w"))
    )
