"""The corpus pipeline: what is left of ``documents`` after each stage goes to the next.

1. language: documents in which no language is recognised go.
2. near_duplicates: one document of each group of near copies stays.
3. substrings: words of 35-word windows that come up more than once go.
4. mix: documents are dropped or repeated until sources have their target weights.
5. tokens: every text becomes SentencePiece ids with an end id.

``run`` writes every stage to the shared checkpoint folder and reads it again, so
that a lost executor costs one stage's tasks and no stage is computed twice.

Cases: documents whose text is null or has no letter go in the first stage; of
repeated rows, and of documents with equal texts, one stays (the smallest id, null
ids last); a text whose words all repeat becomes empty and is not mixed; null
languages and sources are values like others; null ids are allowed; an empty table
passes through all stages. Other columns pass through all but the last stage,
except ``_lang``, ``_score`` and ``_kept``, which are the stages' own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import forest, language, mixing, pieces, substrings
from threadloom.session import ensure_checkpoint_dir

#: A prediction below this is no better than a guess between two of many languages.
LEAST_SCORE = 0.3


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = language.predict(docs, language.train(docs), out="_lang", score="_score")
    known = (F.col("_lang") != language.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)
    return told.where(known).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return forest.keep_one(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(docs, out="_kept")
    columns = {"text": F.when(F.col("text").isNotNull(), F.col("_kept")), "n_chars": F.when(F.col("text").isNotNull(), F.length("_kept")).cast("long")}
    return cut.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(mixing.mix(docs), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("substrings", repeated_substrings),
    ("mix", mix),
    ("tokens", tokens),
]

#: The network, the signatures and the vocabulary can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
