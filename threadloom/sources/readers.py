"""Readers (S1-S5). Schemas are given, so no file is scanned to infer one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.lexicons import TWEET_COLUMNS
from threadloom.functions.text import strip
from threadloom.session import spread

TURN_SCHEMA = (
    "struct<tweet_id:bigint,author_id:string,speaker:string,inbound:boolean,text:string,"
    "created_at:string,response_tweet_id:string,in_response_to_tweet_id:string,turn_number:int>"
)
CONVERSATION_SCHEMA = (
    "conversation_id string, customer_author string, brand_author string, start_time string, "
    "end_time string, num_turns int, brand_responded boolean, is_multi_turn boolean, "
    "customer_message_count int, is_flagged boolean, flag_reason string, "
    f"suitable_for_resolution boolean, part int, turns array<{TURN_SCHEMA}>"
)


def read_tweets(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Raw CSV, every column a string, quotes doubled, line breaks inside quotes allowed.

    UTF-8 files are split at any size (``csv_records``). Other encodings go through
    Spark's reader, where a quoted line break keeps a file in one task; its rows are
    dealt out again if there are fewer files than cores.
    """
    schema = ", ".join(f"{c} string" for c in TWEET_COLUMNS)
    if encoding.upper() in ("UTF-8", "UTF8"):
        rows = csv_records(spark, path).select(F.from_csv("record", schema, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    else:
        rows = spread(spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', encoding=encoding))
    return rows.na.fill("")


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(record): the records of UTF-8 CSV files with quoted line breaks, without one task a file.

    Files are read as lines, which Spark splits by bytes. A first pass counts the
    quotes of each split; sums over the splits of a file tell which of them begin
    inside quotes. A second pass joins lines to records inside each split. Only the
    pieces of records that reach over the end of a split, at most two a split, meet
    in a grouping. Blank lines between records are left out, as is the first record
    of each file with ``header``.
    """
    file, start = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", file, start)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    splits = lines.groupBy("file", "start").agg(F.sum(quotes).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    inside = splits.withColumn("before", before).where("before % 2 = 1").select(F.xxhash64("file", "start"))
    # One number per split that begins inside quotes: 8 bytes for each maxPartitionBytes of input.
    begin_inside = frozenset(r[0] for r in inside.collect())

    def join(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, held, odd, number, begun = None, ("", 0), [], False, 0, True

        def close(ended: bool) -> tuple:
            nonlocal held, number, begun
            text, held, number = "\n".join(held), [], number + 1
            row = (*place, number, begun, ended, text.removesuffix("\r") if ended else text)
            begun = True
            return row

        for batch in source:
            out = []
            for value, *now, key in zip(*(column.to_pylist() for column in batch.columns)):
                if key != split:
                    if held:
                        out.append(close(False))
                    split, place, number = key, tuple(now), 0
                    odd = key in begin_inside
                    begun = not odd
                held.append(value)
                odd ^= value.count('"') % 2 == 1
                if not odd:
                    out.append(close(True))
            yield rows_of(out)
        if held:
            yield rows_of([close(False)])

    kinds = {"file": pa.string(), "start": pa.int64(), "number": pa.int64(), "begun": pa.bool_(), "ended": pa.bool_(), "text": pa.string()}

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    found = lines.withColumn("split", F.xxhash64("file", "start")).mapInArrow(join, "file string, start long, number long, begun boolean, ended boolean, text string")
    head = (F.col("start") == 0) & (F.col("number") == 1) & F.lit(header)
    found = found.withColumn("head", head)
    whole = found.where("begun and ended and not head and text <> ''").select(F.col("text").alias("record"))
    pieces = found.where("not (begun and ended)")
    order = W.partitionBy("file").orderBy("start", "number").rowsBetween(W.unboundedPreceding, 0)
    pieces = pieces.withColumn("chain", F.sum(F.col("begun").cast("int")).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "number", "text"))), lambda x: x["text"]), "\n")
    joined = pieces.groupBy("file", "chain").agg(text.alias("record"), F.max("head").alias("head")).where("not head")
    return whole.unionByName(joined.select(F.regexp_replace("record", "\r$", "").alias("record")))


def read_conversations(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Nested JSON lines, plain or gzipped; blank lines are skipped.

    A gzip file is one split whatever its size. Rows are dealt out again where the
    scan has fewer splits than there are cores, or to ``partitions`` if that is given.
    """
    rows = spark.read.schema(CONVERSATION_SCHEMA).json(path)
    rows = rows.repartition(partitions) if partitions else spread(rows)
    return rows.where("conversation_id is not null")


def turns_of(conversations: DataFrame) -> DataFrame:
    """Long form of nested conversations."""
    return conversations.select("conversation_id", F.inline("turns"))


def read_ids(spark: SparkSession, path: str, name: str = "conversation_id") -> DataFrame:
    """One id per line, trimmed, blanks dropped, as a set."""
    rows = spark.read.text(path).select(strip("value").alias(name))
    return rows.where(F.col(name) != "").distinct()


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Labelled CSV with lists joined by " | " and ", " and a yes/no column.

    A last column tells the part of a context in several parts; without it the part is 0.
    Entries are trimmed and empty ones left out. A bar inside an earlier turn comes
    back if ``join_lists`` wrote it; intent names hold no comma with a space behind.
    """
    columns = (
        "example_id", "conversation_id", "created_at", "customer_message", "previous_turns",
        "brand_response", "candidate_intents", "human_intent", "human_escalate", "human_reason",
        "annotation_notes",
    )
    schema = ", ".join(f"{c} string" for c in columns) + ", part int"
    rows = csv_records(spark, path).select(F.from_csv("record", schema, {"quote": '"', "escape": '"'}).alias("r")).select("r.*")
    return rows.withColumns(
        {
            "previous_turns": split_bars("previous_turns"),
            "candidate_intents": _entries(F.split(F.coalesce("candidate_intents", F.lit("")), ", ")),
            "human_escalate": F.coalesce(
                F.col("human_escalate").isin("True", "Yes", "true"), F.lit(False)
            ),
            "part": F.coalesce("part", F.lit(0)),
        }
    )


def _entries(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda e: e != "")


def split_bars(joined: str) -> Column:
    """The entries of a list joined by " | "; backslashes before a bar that stands alone lose one."""
    parts = F.split(F.coalesce(joined, F.lit("")), r" \| ")
    return _entries(F.transform(parts, lambda e: F.regexp_replace(e, r"(?<=^| )\\(\\*\|)(?= |$)", "$1")))


def read_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header and their place, from 1, over all files in the order of their names.

    The files are those of one range-sorted write. Rows are numbered file by file and
    shifted by the files before, so no task holds all rows.
    """
    rows = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"').select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")
    )
    counts = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("_file").orderBy("_start", "_id"))
    placed = rows.join(counts.select("_file", before.alias("_before")), "_file")
    return placed.withColumn("position", F.col("_before") + inside).drop("_file", "_start", "_id", "_before")


def read_document(spark: SparkSession, path: str, intents: str) -> DataFrame:
    """A taxonomy document, one row per intent: version, status, place in the document and the intent's fields.

    ``intents`` is the schema of one intent. The document has a row per rule or
    cluster name, so it is small whatever was counted for it.
    """
    schema = f"version string, status string, intents array<struct<{intents}>>"
    rows = spark.read.schema(schema).json(path)
    return rows.select("version", "status", F.posexplode("intents").alias("position", "intent")).select("version", "status", "position", "intent.*")
