"""Registered queries that write files into the shared folder and read them back.

Every query writes a folder of its own under the checkpoint folder, which the
driver and all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.lexicons import TWEET_COLUMNS
from threadloom.operators import brands, tagging
from threadloom.operators import conversations as conv
from threadloom.plans import sqltext as q
from threadloom.plans import tables as t
from threadloom.plans.catalog import ATTRIBUTED, BUILT, CONV, REPORT, md5_list, plain_list, r6, register
from threadloom.session import cut_lineage, ensure_checkpoint_dir
from threadloom.sources import readers, writers
from threadloom.streaming import resume


def folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- CSV with line breaks in quotes

#: Texts with quotes, line breaks, commas and white space at their ends, as raw tweets have them.
QUOTED_TEXT = """CASE WHEN tweet_id % 3 = 0 THEN ' ' || text || chr(10) || '"quoted", ' || chr(13) || chr(10) || chr(10) || '\\"'
  WHEN tweet_id % 3 = 1 THEN '"' || text || '"' ELSE text || ', ' END"""


@register(
    f"""WITH {q.TWEETS}
SELECT tweet_id::VARCHAR AS tweet_id, author_id, CASE WHEN inbound THEN 'True' ELSE 'False' END AS inbound, created_at,
  {QUOTED_TEXT} AS text, response_tweet_id, coalesce(parent_id::VARCHAR, '') AS in_response_to_tweet_id FROM tweets"""
)
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Raw tweets written as CSV files and read by splits, all columns of all rows."""
    raw = t.raw_tweets(spark, sf)
    number = F.col("tweet_id").cast("long") % 3
    long = F.concat(F.lit(" "), "text", F.lit('\n"quoted", \r\n\n\\"'))
    text = F.when(number == 0, long).when(number == 1, F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.concat("text", F.lit(", ")))
    path = folder(spark, "tweets")
    writers.write_csv(raw.withColumn("text", text).select(*TWEET_COLUMNS).repartition(6, "author_id"), path)
    return readers.read_tweets(spark, path)


# ---------------------------------------------------------------- nested JSON lines

_TURN_SQL = """turn_number, tweet_id, author_id, speaker, inbound, text, created_at, response_tweet_id,
  coalesce(parent_id::VARCHAR, '') AS in_response_to_tweet_id"""


@register(f"WITH RECURSIVE {BUILT} SELECT conversation_id, {_TURN_SQL} FROM num")
def nested_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as nested JSON lines in parts of three turns, read back and laid out as turns."""
    turns = cut_lineage(conv.number_turns(t.brand_turns(spark, sf)))
    path = folder(spark, "nested")
    nested = writers.nested_conversations(conv.build_conversations(turns), turns, max_turns_per_row=3)
    writers.write_conversations(nested, path, "json")
    return readers.turns_of(readers.read_conversations(spark, path))


@register(
    f"""WITH RECURSIVE {BUILT}
SELECT c.*, part, string_agg(tweet_id || ':' || md5(text), ',' ORDER BY turn_number) AS turns
FROM convs c JOIN (SELECT *, ((turn_number - 1) // 2)::INT AS part FROM num) n USING (conversation_id)
GROUP BY ALL"""
)
def gzip_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """S3: gzipped JSON lines in two files, which can't be split; rows are dealt out behind the scan."""
    turns = cut_lineage(conv.number_turns(t.brand_turns(spark, sf)))
    path = folder(spark, "gzipped")
    nested = writers.nested_conversations(conv.build_conversations(turns), turns, max_turns_per_row=2)
    writers.write_conversations(nested.repartition(2, CONV), path, "json", compression="gzip")
    line = F.transform("turns", lambda e: F.concat_ws(":", e["tweet_id"], F.md5(e["text"])))
    return readers.read_conversations(spark, path).withColumn("turns", F.array_join(line, ","))


# ---------------------------------------------------------------- labelled CSV with lists

_LINES = f"list_filter(list_transform(string_split(marked, chr(10)), lambda x: {q.strip('x')}), lambda x: x <> '')"


@register(
    f"""WITH marked AS (
  SELECT doc_id, text, lang, source, n_chars, toxic, quality, {q.tags('text', t.LANG_HINTS)} AS tags,
    CASE WHEN doc_id % 3 = 0 THEN '| ' || text || ' | end \\| of | | text |' ELSE text END AS marked
  FROM documents JOIN labels USING (doc_id))
SELECT 'gold_' || doc_id AS example_id, doc_id::VARCHAR AS conversation_id, md5(text) AS customer_message,
  array_to_string(list_transform({_LINES}, lambda x: md5(x)), ',') AS previous_turns, len({_LINES}) AS n_previous,
  source AS brand_response, array_to_string(tags, ',') AS candidate_intents, lang AS human_intent, toxic = 1 AS human_escalate,
  CASE WHEN quality = 1 THEN 'reviewed, "twice"' END AS human_reason, NULL::VARCHAR AS annotation_notes, 0 AS part FROM marked"""
)
def golden_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled examples with lists in CSV cells; turns with the list's own delimiter in them come back whole."""
    rows = t.documents(spark, sf).join(t.table(spark, sf, "labels"), "doc_id")
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("| "), "text", F.lit(" | end \\| of | | text |"))).otherwise(F.col("text"))
    golden = rows.select(
        F.concat(F.lit("gold_"), "doc_id").alias("example_id"), F.col("doc_id").cast("string").alias(CONV), F.lit("").alias("created_at"),
        F.col("text").alias("customer_message"), F.split(marked, "\n").alias("previous_turns"), F.col("source").alias("brand_response"),
        tagging.tag_intents("text", t.LANG_HINTS).alias("candidate_intents"), F.col("lang").alias("human_intent"),
        F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("human_escalate"),
        F.when(F.col("quality") == 1, 'reviewed, "twice"').alias("human_reason"), F.lit(None).cast("string").alias("annotation_notes"), F.lit(0).alias("part"),
    )
    path = folder(spark, "golden")
    writers.write_csv(writers.join_lists(golden), path)
    back = readers.read_golden(spark, path)
    return back.select(
        "example_id", CONV, F.md5("customer_message").alias("customer_message"), md5_list("previous_turns"),
        F.size("previous_turns").alias("n_previous"), "brand_response", plain_list("candidate_intents"), "human_intent", "human_escalate",
        "human_reason", "annotation_notes", "part",
    )


# ---------------------------------------------------------------- id lists, ordered files, documents


@register("SELECT DISTINCT 'conv ' || conv_id AS conversation_id FROM conversations")
def id_list_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """One id per line and turn, so ids repeat, with blank lines and white space around; read as a set."""
    path = folder(spark, "ids")
    turns = t.table(spark, sf, "conversations")
    around = F.element_at(F.array(F.lit(""), F.lit("  "), F.lit("\t"), F.lit("  ")), (F.col("turn") % 4 + 1).cast("int"))
    ids = turns.select(F.concat(around, F.lit("conv "), "conv_id", around).alias(CONV))
    writers.write_ids(ids.unionByName(turns.where("turn % 5 = 0").select(around.alias(CONV))), path)
    return readers.read_ids(spark, path)


@register(
    f"""WITH RECURSIVE {ATTRIBUTED}
SELECT *, row_number() OVER (ORDER BY quality_score DESC, brand) AS position FROM scored"""
)
def ordered_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Brand statistics written in order of score over several files, and each row's place in them."""
    scored = cut_lineage(brands.score_brands(brands.brand_stats(t.brand_tweets(spark, sf))))
    path = folder(spark, "brands")
    writers.write_brand_stats(scored, path)
    return readers.read_ordered(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields))


@register(
    f"""WITH {REPORT}
SELECT '0.1' AS version, 'human_review_required' AS status, row_number() OVER (ORDER BY priority) - 1 AS position, intent_id,
  total_matches, estimated_prevalence, recommended_action, confusable_intents, coalesce(strong, '') AS representative_examples,
  coalesce(doubtful, '') AS false_positive_examples FROM report"""
)
def document_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The taxonomy report as one versioned JSON document, and its intents read back."""
    report = cut_lineage(tagging.taxonomy_report(t.documents(spark, sf), "text", "doc_id", t.LANG_RULES, "other"))
    path = folder(spark, "taxonomy")
    writers.write_json(writers.taxonomy_document(report), path)
    intents = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in report.schema.fields)
    rows = readers.read_document(spark, path, intents)
    lists = ("representative_examples", "false_positive_examples")
    return rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists}).select(
        "version", "status", "position", "intent_id", "total_matches", r6("estimated_prevalence"), "recommended_action",
        plain_list("confusable_intents"), *[md5_list(c) for c in lists],
    )


# ---------------------------------------------------------------- resumable stream


@register(
    """SELECT example_id, 1 AS times, md5(text) AS reply, CASE WHEN example_id % 7 = 0 THEN 'Failed to generate JSON' END AS api_error
FROM (SELECT conv_id * (SELECT max(turn) + 2 FROM conversations) + turn AS example_id, min(text) AS text FROM conversations GROUP BY 1) e"""
)
def resumed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Turns arrive in files; a first run meets a rate limit, files come again, a second run ends the work.

    Returns how often each result is stored: once, with lasting errors among the results.
    """
    source = t.table(spark, sf, "conversations")
    stride = source.agg(F.max("turn") + 2).scalar()
    examples = source.groupBy((F.col("conv_id") * stride + F.col("turn")).alias("example_id")).agg(F.min("text").alias("text"))
    examples = cut_lineage(examples)
    base = folder(spark, "resumed")
    arriving, stored = f"{base}/in", f"{base}/out"

    def answer(limited: bool):
        limit = F.when(F.lit(limited) & (F.col("example_id") % 5 == 0), "Error 429: rate limit reached")
        broken = F.when(F.col("example_id") % 7 == 0, "Failed to generate JSON")
        return lambda rows: rows.select("example_id", F.md5("text").alias("reply"), F.coalesce(limit, broken).alias("api_error"))

    def run(limited: bool) -> None:
        stream = spark.readStream.schema(examples.schema).option("maxFilesPerTrigger", 3).parquet(arriving)
        resume.follow(stream, answer(limited), stored, f"{base}/checkpoint").awaitTermination()

    examples.where("example_id % 2 = 0").repartition(4).write.mode("append").parquet(arriving)
    run(limited=True)
    # the other half, and some of the first once more
    examples.where("example_id % 2 = 1 or example_id % 3 = 0").repartition(4).write.mode("append").parquet(arriving)
    run(limited=False)
    rows = spark.read.parquet(stored)
    return rows.groupBy("example_id").agg(F.count("*").alias("times"), F.max("reply").alias("reply"), F.max("api_error").alias("api_error"))
