"""Writers (S6-S12). Each commits as a job, so a lost task leaves no half file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.conversations import CONV, nest_turns
from threadloom.session import loose

# The columns of the flat form, in order.
FLAT_COLUMNS = (
    "conversation_id", "turn_number", "tweet_id", "author_id", "speaker", "inbound", "created_at",
    "text", "response_tweet_id", "in_response_to_tweet_id", "customer_author", "brand_author",
    "conversation_start", "conversation_end", "num_turns", "brand_responded", "is_multi_turn",
    "is_flagged", "flag_reason",
)


def nested_conversations(convs: DataFrame, turns: DataFrame, max_turns_per_row: int = 10_000) -> DataFrame:
    """Conversation rows with their ordered turns; (conversation, part) is the key, from part 0 on."""
    return convs.drop("start_ts").join(nest_turns(turns, max_turns_per_row), CONV)


def write_conversations(nested: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", **options: str) -> None:
    """One row (or JSON line) per conversation and part, whatever the length of conversations."""
    nested.write.format(fmt).mode(mode).options(**options).save(path)


def flatten_turns(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per turn with its conversation's metadata, 19 columns."""
    meta = convs.select(
        CONV, "customer_author", "brand_author",
        F.col("start_time").alias("conversation_start"), F.col("end_time").alias("conversation_end"),
        "num_turns", "brand_responded", "is_multi_turn", "is_flagged", "flag_reason",
    )
    return turns.join(loose(meta), CONV).select(*FLAT_COLUMNS)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header and doubled quotes; white space at the ends of a value stays."""
    df.write.mode(mode).csv(
        path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def join_lists(golden: DataFrame) -> DataFrame:
    """List columns as text, " | " between turns and ", " between intents.

    A bar that stands alone in a turn would read as the end of the turn. It gets a
    backslash, as do such bars that have backslashes already; ``read_golden`` takes it away.
    """
    rows = golden.drop("previous_speakers")
    marked = F.transform("previous_turns", lambda e: F.regexp_replace(e, r"(?<=^| )(\\*\|)(?= |$)", r"\\$1"))
    return rows.withColumns(
        {
            "previous_turns": F.array_join(marked, " | "),
            "candidate_intents": F.array_join("candidate_intents", ", "),
        }
    )


def write_ids(ids: DataFrame, path: str, name: str = CONV, mode: str = "error") -> None:
    """One id per line."""
    ids.select(F.col(name).cast("string").alias("value")).write.mode(mode).text(path)


def write_brand_stats(scored: DataFrame, path: str, mode: str = "error") -> None:
    """Brand rows by score; the sort is a range sort, so files are in order."""
    write_csv(scored.orderBy(F.desc("quality_score"), "brand"), path, mode)


def taxonomy_document(report: DataFrame, version: str = "0.1", status: str = "human_review_required") -> DataFrame:
    """One document holding the few rows of a taxonomy."""
    return report.agg(F.collect_list(F.struct(*report.columns)).alias("intents")).select(
        F.lit(version).alias("version"), F.lit(status).alias("status"), "intents"
    )


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """Cluster rows or a taxonomy document as JSON."""
    df.write.mode(mode).json(path)


def completed_ids(spark: SparkSession, path: str, key: str = "example_id") -> DataFrame | None:
    """Ids already in the output folder, or None before the first run."""
    try:
        return spark.read.parquet(path).select(key).distinct()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
