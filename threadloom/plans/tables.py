"""Inputs of the registered queries, derived by Spark from the given tables.

The given tables hold no reply links and no labelled predictions, so both are
built from their rows; all of it grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import MENTION
from threadloom.operators.conversations import CONV, number_turns, speaker, type_tweets
from threadloom.operators.graph import connected_components, reply_edges, thread_of_tweets
from threadloom.operators.predict import grounding_failures
from threadloom.operators.retrieval import band
from threadloom.operators.tagging import silver_label, tag_intents
from threadloom.session import cut_lineage, spread

# Words that occur in the given texts, as a stand-in for support keywords.
LANG_HINTS = {
    "en": (" the ", " of ", " with "),
    "de": (" der ", " und ", " die "),
    "es": (" que ", " los ", " para "),
    "fr": (" les ", " et ", " une "),
}
LANGS = (*LANG_HINTS, "other")
LANG_RULES = (
    ("en", (" the ", " with "), (" que ", " der "), ("de",), "KEEP"),
    ("es", (" que ", " los "), (" les ", " der "), ("fr",), "KEEP"),
    ("fr", (" les ", " une "), (" los ",), ("es",), "KEEP"),
    ("de", (" der ", " und "), (), ("en",), "KEEP"),
)
WORD_CONCEPTS = {
    "article": ("the", "der", "la", "el", "les"),
    "link": ("and", "und", "y", "et"),
    "place": ("in", "of", "de", "of the"),
    "verb": ("is", "be", "are", "to be"),
}
BRANDS = ("Brand0", "Brand1", "Brand2", "Brand3", "Brand4")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Documents, with text work spread over all cores."""
    return spread(table(spark, sf, "documents").select(*columns))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Dialogue turns: user is the customer, assistant the brand, system is left out."""
    rows = table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    return rows.select(
        F.col("conv_id").alias(CONV),
        (F.col("turn") + 1).alias("turn_number"),
        F.when(F.col("role") == "user", "customer").otherwise("brand").alias("speaker"),
        "text",
    )


def raw_tweets(spark: SparkSession, sf: str) -> DataFrame:
    """The seven string columns of a reply table, one row per dialogue turn.

    Every turn answers the one before and names the one after. Some names are
    lists, some dates are broken, left-out system turns are missing parents, and
    the openings of some dialogues answer one common post that is not there.
    """
    source = table(spark, sf, "conversations")
    stride = source.agg(F.max("turn") + 2).scalar()
    conv, turn = F.col("conv_id"), F.col("turn")
    me = conv * stride + turn
    customer = F.col("role") == "user"
    at = F.expr(
        "timestamp_ntz'2017-10-30 10:00:00' + make_dt_interval(0, int(conv_id % 1000), int(turn), 0)"
    )
    stamp = F.concat(
        F.date_format(at, "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(at, "yyyy")
    )
    parent = F.when(turn > 0, (me - 1).cast("string")).when(
        conv % 7 == 0, (-F.floor(conv / 21) - 1).cast("string")
    ).otherwise("")
    after = (me + 1).cast("string")
    named = F.when((conv + turn) % 4 == 3, F.concat(after, F.lit(","), (me + 2).cast("string")))
    greeting = F.when(
        customer & (turn % 3 == 0), F.concat(F.lit("@Brand"), ((conv + turn) % 7).cast("string"), F.lit(" "))
    ).otherwise("")
    return source.where(F.col("role").isin("user", "assistant")).select(
        me.cast("string").alias("tweet_id"),
        F.when(customer, F.concat(F.lit("user"), (conv % 37).cast("string")))
        .otherwise(F.concat(F.lit("Brand"), (conv % 5).cast("string")))
        .alias("author_id"),
        F.when(customer, "True").otherwise("False").alias("inbound"),
        F.when((conv % 17 == 3) & (turn == 1), "unknown").otherwise(stamp).alias("created_at"),
        F.concat(greeting, F.col("text")).alias("text"),
        named.otherwise(after).alias("response_tweet_id"),
        parent.alias("in_response_to_tweet_id"),
    )


#: What conversations are built from.
TURN_COLUMNS = ("author_id", "created_at", "ts", "parent_id")


def threaded_tweets(spark: SparkSession, sf: str, *columns: Column | str) -> DataFrame:
    """Typed tweets with the thread each belongs to.

    The rows are shuffled and stored; ``columns`` are what a query reads besides the
    id, so that no text moves that it doesn't read. All are kept if none are given.
    """
    raw = raw_tweets(spark, sf)
    typed = type_tweets(raw)
    components = connected_components(reply_edges(raw))
    kept = typed.select("tweet_id", *columns) if columns else typed
    return cut_lineage(kept.join(thread_of_tweets(typed, components), "tweet_id"))


def brand_tweets(spark: SparkSession, sf: str) -> DataFrame:
    """Threaded tweets with what brand statistics read of them: of a text only its first mention."""
    mention = F.regexp_extract("text", MENTION, 0).alias("text")
    return threaded_tweets(spark, sf, "author_id", "inbound", mention, "parent_id")


def brand_turns(spark: SparkSession, sf: str, *columns: Column | str) -> DataFrame:
    """Turns of all threads with a known brand in them, with conversation id and speaker.

    ``columns`` are as in ``threaded_tweets``; the author is always among them.
    """
    from threadloom.operators.graph import select_brand_threads

    rows = select_brand_threads(threaded_tweets(spark, sf, *columns), list(BRANDS))
    return rows.withColumn(CONV, F.concat(F.lit("conv_"), F.col("thread"))).withColumn(
        "speaker", speaker("author_id", BRANDS)
    )


def numbered_brand_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered turns of all threads with a known brand, with author, date and text.

    Threads are chosen and turns numbered without the texts, which meet their turn
    number at the end; nothing that is done before moves them.
    """
    light = number_turns(brand_turns(spark, sf, "author_id", "ts"))
    light = cut_lineage(light.select("tweet_id", CONV, "turn_number"))
    if not light.groupBy("tweet_id").count().where("count > 1").isEmpty():
        # An id of several rows doesn't tell which of them was numbered.
        return number_turns(brand_turns(spark, sf, "author_id", "created_at", "ts", "text"))
    typed = type_tweets(raw_tweets(spark, sf)).select("tweet_id", "author_id", "created_at", "text")
    return typed.withColumn("speaker", speaker("author_id", BRANDS)).join(light, "tweet_id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return text_table(spark, sf, "doc_id", "text", "lang", "source", "n_chars")


def openings(spark: SparkSession, sf: str) -> DataFrame:
    """Opening customer message per dialogue, as retrieval queries."""
    from threadloom.operators.conversations import opening_and_reply

    return opening_and_reply(turns(spark, sf)).select(
        F.col(CONV).alias("query_id"), F.col("customer_message").alias("text")
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Customer turns as documents; ids follow dialogue and turn."""
    source = table(spark, sf, "conversations")
    stride = source.agg(F.max("turn") + 2).scalar()
    return source.where(F.col("role") == "user").select(
        (F.col("conv_id") * stride + F.col("turn")).alias("doc_id"), "text"
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as predictions: language guessed by keywords, escalation by length."""
    rows = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    tagged = rows.withColumn("guess", silver_label(tag_intents("text", LANG_HINTS), "other"))
    score = (F.col("n_chars") % 100) / 100.0
    error = F.when(F.col("doc_id") % 19 == 0, "Error 429: rate limit reached").when(
        F.col("doc_id") % 23 == 0, "Failed to generate JSON"
    )
    drafted = tagged.select(
        F.col("doc_id").alias("example_id"),
        F.col("lang").alias("true_intent"),
        F.col("guess").alias("predicted_intent"),
        (F.col("toxic") == 1).alias("true_esc"),
        (F.col("n_chars") >= 2000).alias("predicted_escalate"),
        score.alias("retrieval_similarity"),
        band(score).alias("retrieval_confidence"),
        error.alias("api_error"),
        F.col("guess").alias("intent"),
        F.col("text").alias("reply"),
        (F.col("n_chars") >= 2000).alias("escalate"),
        F.when(F.col("quality") == 1, "long text").otherwise("").alias("escalation_reason"),
    )
    fails = F.when(F.col("api_error").isNotNull(), F.array(F.lit("LLM Error"))).otherwise(
        grounding_failures(F.lit(""), intents=tuple(LANG_HINTS))
    )
    return drafted.withColumn("validation_failures", fails)


def labelled_golden(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents shaped as golden rows."""
    rows = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("example_id"),
        F.col("doc_id").alias(CONV),
        F.col("text").alias("customer_message"),
        F.col("lang").alias("human_intent"),
        F.when(F.col("toxic") == 1, "Yes").when(F.col("quality") == 0, "Maybe").otherwise("No").alias(
            "human_escalate"
        ),
        F.when(F.col("quality") == 1, "reviewed").otherwise("").alias("human_reason"),
        F.when(F.col("n_chars") > 3000, " ok ").alias("annotation_notes"),
    )


def toxic_golden(spark: SparkSession, sf: str) -> DataFrame:
    """Documents labelled toxic, held out as a golden set."""
    bad = table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    return documents(spark, sf).join(bad, "doc_id", "left_semi").select(
        F.col("doc_id").alias(CONV), F.col("text").alias("customer_message")
    )


def document_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a dialogue of one customer turn."""
    return documents(spark, sf).select(
        F.col("doc_id").alias(CONV), F.lit(1).alias("turn_number"), F.lit("customer").alias("speaker"), "text"
    )
