"""Exact length histogram: one row per encoded length answers every context limit.

Each text is encoded once and only its length is kept. The histogram of lengths
is summed from the long end (suffix sums), after which documents, tokens and
tokens after truncation are known for every limit, and quantiles are lookups.

Cases: null text counts as empty and has length 0; an empty table gives an
empty histogram; repeated rows count as often as they occur; columns other than
the text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.batches import map_batches
from threadloom.session import cut_lineage

#: Lengths of one slice of the suffix sums. The longest text sets the number of slices.
SLICE = 1024


@lru_cache(maxsize=2)
def _encoding(ranks_file: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(df: DataFrame, ranks_file: str, text: str = "text") -> DataFrame:
    """One row per document with its length in tokens. Special tokens' strings are ordinary text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_file).encode_ordinary
        for batch in source:
            lengths = [len(encode(x.as_py() or "")) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n_tokens"])

    return map_batches(df.select(text), run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row per length with suffix sums.

    n_docs: documents of this length. docs_at_least, tokens_at_least: documents
    of this length or longer and their tokens. tokens_total, docs_total: of all.
    tokens_truncated: tokens left when every document is cut at this length.
    rank_from, rank_to: places of these documents in ascending order of length.
    """
    counts = cut_lineage(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))  # read twice; texts are encoded once
    counts = counts.withColumn("_slice", F.floor(F.col("n_tokens") / SLICE))
    weight = F.col("n_docs") * F.col("n_tokens")
    slices = counts.groupBy("_slice").agg(F.sum("n_docs").alias("_docs"), F.sum(weight).alias("_tokens"))
    later = W.orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(
        "_slice",
        F.coalesce(F.sum("_docs").over(later), F.lit(0)).alias("_docs_later"),
        F.coalesce(F.sum("_tokens").over(later), F.lit(0)).alias("_tokens_later"),
        F.sum("_docs").over(W.partitionBy(F.lit(1))).alias("docs_total"),
        F.sum("_tokens").over(W.partitionBy(F.lit(1))).alias("tokens_total"),
    )
    own = W.partitionBy("_slice").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = counts.join(slices, "_slice").select(
        "n_tokens",
        "n_docs",
        (F.col("_docs_later") + F.sum("n_docs").over(own)).alias("docs_at_least"),
        (F.col("_tokens_later") + F.sum(weight).over(own)).alias("tokens_at_least"),
        "docs_total",
        "tokens_total",
    )
    docs_below = F.col("docs_total") - F.col("docs_at_least")
    tokens_below = F.col("tokens_total") - F.col("tokens_at_least")
    return sums.select(
        "*",
        (tokens_below + F.col("docs_at_least") * F.col("n_tokens")).alias("tokens_truncated"),
        (docs_below + 1).alias("rank_from"),
        (docs_below + F.col("n_docs")).alias("rank_to"),
    )


def at_limits(hist: DataFrame, limits: DataFrame, limit: str = "context") -> DataFrame:
    """For each limit of a table: documents and tokens that fit whole, and tokens left after truncation.

    ``limits`` is small (one row per limit) and is joined by comparison.
    """
    over = F.col("n_tokens") > F.col(limit)
    kept = F.when(over, F.col(limit)).otherwise(F.col("n_tokens")) * F.col("n_docs")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = hist.crossJoin(F.broadcast(limits.select(limit).distinct())).groupBy(limit)
    return sums.agg(
        zero(F.sum(F.when(~over, F.col("n_docs")))).alias("docs_whole"),
        zero(F.sum(F.when(~over, F.col("n_docs") * F.col("n_tokens")))).alias("tokens_whole"),
        zero(F.sum(kept)).alias("tokens_truncated"),
    )


def quantile(p: float) -> Column:
    """Aggregate over a histogram: the smallest length that at least a share ``p`` of documents do not exceed."""
    return F.min(F.when(F.col("rank_to") >= F.ceil(F.lit(p) * F.col("docs_total")), F.col("n_tokens")))
