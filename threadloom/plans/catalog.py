"""Registered queries: each operator over whole tables, with SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.lexicons import STOCK_REPLY, TWEET_COLUMNS
from threadloom.functions.ordering import hash_rank, quantiles
from threadloom.functions.parsing import safe_long, tweet_ts
from threadloom.operators import brands, cluster, evaluate, labels, predict, profile, retrieval, sampling, tagging, vectors
from threadloom.operators import conversations as conv
from threadloom.operators import graph
from threadloom.plans import sqltext as q
from threadloom.plans import tables as t
from threadloom.session import cut_lineage
from threadloom.sources.writers import flatten_turns
from threadloom.streaming.resume import pending, storable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CONV = conv.CONV


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


# ---------------------------------------------------------------- conversations

SHAPE = f"""{q.TURNS},
shape AS (
  SELECT conversation_id, count(*) AS num_turns,
         count(*) FILTER (speaker = 'customer') AS customer_message_count,
         count(*) FILTER (speaker = 'brand') AS n_brand
  FROM turns GROUP BY 1),
seq AS (
  SELECT conversation_id, speaker,
         lead(speaker) OVER (PARTITION BY conversation_id ORDER BY turn_number) AS nxt FROM turns),
adj AS (SELECT DISTINCT conversation_id FROM seq WHERE speaker = 'customer' AND nxt = 'brand'),
convs AS (
  SELECT s.conversation_id, num_turns, customer_message_count,
         customer_message_count > 0 AND n_brand > 0 AS brand_responded,
         customer_message_count > 0 AND n_brand > 0 AND num_turns >= 3 AS is_multi_turn,
         customer_message_count > 0 AND n_brand > 0 AND num_turns >= 3 AND a.conversation_id IS NOT NULL
           AS suitable_for_resolution
  FROM shape s LEFT JOIN adj a USING (conversation_id))"""


@register(
    f"""WITH {SHAPE}
SELECT count(*) AS total, count(*) FILTER (NOT is_multi_turn) AS single_turn,
  count(*) FILTER (is_multi_turn) AS multi_turn, round(avg(num_turns), 6) AS avg_turns,
  median(num_turns)::DOUBLE AS median_turns, max(num_turns) AS max_turns,
  count(*) FILTER (brand_responded) AS responded,
  count(*) FILTER (customer_message_count >= 2) AS customer_multi,
  count(*) FILTER (suitable_for_resolution) AS suitable,
  round(count(*) FILTER (brand_responded) * 100.0::DOUBLE / count(*), 6) AS responded_pct,
  round(count(*) FILTER (suitable_for_resolution) * 100.0::DOUBLE / count(*), 6) AS suitable_pct
FROM convs"""
)
def conversation_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = conv.conversation_summary(conv.shape_of_turns(t.turns(spark, sf)))
    return rows.select(
        "total", "single_turn", "multi_turn", r6("avg_turns"), "median_turns", "max_turns",
        "responded", "customer_multi", "suitable", r6("responded_pct"), r6("suitable_pct"),
    )


@register(f"WITH {SHAPE} SELECT * FROM convs")
def conversation_shape(spark: SparkSession, sf: str) -> DataFrame:
    return conv.shape_of_turns(t.turns(spark, sf))


@register(
    f"""WITH {SHAPE},
b AS (SELECT CASE WHEN num_turns = 1 THEN 0 WHEN num_turns = 2 THEN 1 WHEN num_turns <= 5 THEN 2
      WHEN num_turns <= 10 THEN 3 WHEN num_turns <= 20 THEN 4 ELSE 5 END AS pos FROM convs),
dim(pos, length_bucket) AS (VALUES (0, '1 turn'), (1, '2 turns'), (2, '3-5 turns'), (3, '6-10 turns'),
  (4, '11-20 turns'), (5, '21+ turns'))
SELECT d.pos, length_bucket, count(b.pos) AS conversations,
  round(count(b.pos) * 100.0::DOUBLE / (SELECT count(*) FROM convs), 6) AS pct
FROM dim d LEFT JOIN b ON b.pos = d.pos GROUP BY 1, 2"""
)
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = conv.length_histogram(conv.shape_of_turns(t.turns(spark, sf)))
    return rows.select("pos", "length_bucket", "conversations", r6("pct"))


@register(
    f"""WITH {SHAPE}
SELECT CASE WHEN num_turns <= 2 THEN 'Short' WHEN num_turns <= 5 THEN 'Medium'
  WHEN num_turns <= 10 THEN 'Long' ELSE 'Very long' END AS length_class, count(*) AS conversations
FROM convs GROUP BY 1"""
)
def length_classes(spark: SparkSession, sf: str) -> DataFrame:
    convs = conv.shape_of_turns(t.turns(spark, sf))
    return convs.groupBy(conv.length_class("num_turns").alias("length_class")).agg(
        F.count("*").alias("conversations")
    )


@register(f"WITH {q.TURNS}, {q.OPENINGS} SELECT * FROM cases")
def opening_and_reply(spark: SparkSession, sf: str) -> DataFrame:
    return conv.opening_and_reply(t.turns(spark, sf))


# ---------------------------------------------------------------- profiling


@register("SELECT count(*) AS row_count, 5 AS col_count FROM documents")
def table_size(spark: SparkSession, sf: str) -> DataFrame:
    return profile.table_size(t.documents(spark, sf))


@register(
    f"""SELECT 'example_id' AS column_name, count(*) FILTER (doc_id IS NULL) AS missing
FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'human_reason', count(*) FILTER (quality <> 1) FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'annotation_notes', count(*) FILTER (NOT n_chars > 3000) FROM documents JOIN labels USING (doc_id)"""
)
def profile_missing(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.labelled_golden(spark, sf).select("example_id", "human_reason", "annotation_notes")
    return profile.missing_counts(rows)


@register(
    """SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT text, lang, n_chars FROM documents))
  AS distinct_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, n_chars FROM documents))
  AS duplicate_count FROM documents"""
)
def profile_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return profile.duplicate_rows(t.documents(spark, sf).select("text", "lang", "n_chars"))


@register("SELECT count(DISTINCT nullif(trim(o_custkey::VARCHAR), '')) AS distinct_ids FROM orders")
def profile_ids(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_ids(t.table(spark, sf, "orders"), "o_custkey")


@register(
    f"""WITH {q.TWEETS} SELECT count(*) FILTER (inbound) AS inbound_count,
  count(*) FILTER (NOT inbound) AS outbound_count FROM tweets"""
)
def profile_direction(spark: SparkSession, sf: str) -> DataFrame:
    return profile.direction_counts(t.raw_tweets(spark, sf), "inbound")


@register(
    f"""WITH {q.TWEETS}
SELECT 'row_count' AS metric, count(*) AS value FROM tweets
UNION ALL SELECT 'distinct_ids', count(DISTINCT tweet_id) FROM tweets
UNION ALL SELECT 'inbound_count', count(*) FILTER (inbound) FROM tweets
UNION ALL SELECT 'outbound_count', count(*) FILTER (NOT inbound) FROM tweets
UNION ALL SELECT 'missing:' || c, CASE c WHEN 'in_response_to_tweet_id' THEN (SELECT count(*) FROM tweets WHERE parent_id IS NULL)
  WHEN 'text' THEN (SELECT count(*) FROM tweets WHERE {q.strip('text')} = '') ELSE 0 END
FROM (SELECT unnest([{q.quoted(TWEET_COLUMNS)}]) AS c) x"""
)
def profile_tweets(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile_table(t.raw_tweets(spark, sf), "tweet_id", "inbound")


@register(
    """WITH head AS (SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 100),
cells AS (
  SELECT doc_id, unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS column_name,
         unnest([0, 1, 2, 3, 4]) AS pos,
         unnest([doc_id::VARCHAR, text, lang, source, n_chars::VARCHAR]) AS v FROM head),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY doc_id) AS nth
  FROM cells WHERE trim(v) <> '')
SELECT pos, column_name,
  CASE WHEN bool_and(lower(trim(v)) IN ('true', 'false')) THEN 'bool'
       WHEN bool_and(regexp_full_match(trim(v), '[+-]?[0-9]+')) THEN 'int'
       WHEN bool_and(try_cast(v AS DOUBLE) IS NOT NULL) THEN 'float' ELSE 'str' END AS inferred_type
FROM seen WHERE nth <= 20 GROUP BY 1, 2"""
)
def inferred_types(spark: SparkSession, sf: str) -> DataFrame:
    return profile.infer_types(t.documents(spark, sf), "doc_id")


@register(
    """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END
  AS text, lang FROM documents ORDER BY documents.doc_id LIMIT 5"""
)
def head_rows(spark: SparkSession, sf: str) -> DataFrame:
    return profile.head_rows(t.documents(spark, sf).select("doc_id", "text", "lang"), "doc_id")


@register(
    f"""WITH {q.TWEETS}
SELECT i - 1 AS pos, c AS column_name, c <> 'retweets' AS present,
  CASE c WHEN 'retweets' THEN NULL WHEN 'text' THEN (SELECT count(*) FROM tweets WHERE trim(text) = '')
    WHEN 'in_response_to_tweet_id' THEN (SELECT count(*) FROM tweets WHERE parent_id IS NULL) ELSE 0 END AS missing
FROM (SELECT unnest([{q.quoted(TWEET_COLUMNS)}, 'retweets']) AS c, unnest(range(1, 9)) AS i) x"""
)
def expected_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.raw_tweets(spark, sf)
    checked = profile.expected_columns(rows, [*TWEET_COLUMNS, "retweets"])
    return checked.join(profile.missing_counts(rows), "column_name", "left")


# ---------------------------------------------------------------- reply graph and threads


@register(f"WITH {q.TWEETS} SELECT src, dst FROM edges")
def reply_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reply_edges(t.raw_tweets(spark, sf))


@register(
    f"""WITH {q.TWEETS} SELECT src, dst FROM edges
UNION SELECT tweet_id, tweet_id + 1 FROM tweets UNION SELECT tweet_id, tweet_id + 2 FROM tweets WHERE answer_id IS NULL"""
)
def reply_edges_split(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reply_edges(t.raw_tweets(spark, sf), split_multi=True)


@register(f"WITH RECURSIVE {q.THREADS} SELECT tweet_id, thread FROM threads")
def thread_components(spark: SparkSession, sf: str) -> DataFrame:
    return t.threaded_tweets(spark, sf, "inbound").select("tweet_id", "thread")


@register(
    f"""WITH RECURSIVE {q.THREADS}
SELECT tweet_id, thread FROM tt WHERE thread IN (SELECT thread FROM tt WHERE lower(author_id) IN ('brand0', 'brand3'))"""
)
def brand_threads(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.select_brand_threads(t.threaded_tweets(spark, sf), ["BRAND0", "Brand3"])
    return rows.select("tweet_id", "thread")


@register(
    """SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) e
WHERE n = 1"""
)
def latest_per_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("taken_in")
    )
    return graph.latest_per_id(rows, "user_id", "taken_in").drop("taken_in")


BUILT = f"""{q.THREADS},
num AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ts IS NULL, ts, tweet_id) AS turn_number
  FROM bt),
lost AS (
  SELECT c.conversation_id, count(*) AS missing FROM num c
  WHERE c.parent_id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM num p WHERE p.conversation_id = c.conversation_id AND p.tweet_id = c.parent_id)
  GROUP BY 1),
seq AS (
  SELECT conversation_id, speaker, lead(speaker) OVER (PARTITION BY conversation_id ORDER BY turn_number) AS nxt
  FROM num),
adj AS (SELECT DISTINCT conversation_id FROM seq WHERE speaker = 'customer' AND nxt = 'brand'),
agg AS (
  SELECT conversation_id, count(*) AS num_turns,
    count(*) FILTER (speaker = 'customer') AS customer_message_count,
    count(*) FILTER (speaker = 'brand') AS n_brand, count(*) FILTER (ts IS NULL) AS bad_ts,
    coalesce(min(author_id) FILTER (speaker = 'customer'), '') AS customer_author,
    coalesce(min(author_id) FILTER (speaker = 'brand'), '') AS brand_author,
    arg_min(created_at, turn_number) AS start_time, arg_max(created_at, turn_number) AS end_time
  FROM num GROUP BY 1),
flags AS (
  SELECT a.*, concat_ws('; ',
      CASE WHEN bad_ts > 0 THEN bad_ts || '/' || num_turns || ' unparseable timestamps' END,
      CASE WHEN missing > 0 THEN missing || ' referenced tweet(s) outside conversation' END) AS flag_reason
  FROM agg a LEFT JOIN lost USING (conversation_id)),
convs AS (
  SELECT f.conversation_id, customer_author, brand_author, start_time, end_time, num_turns,
    customer_message_count > 0 AND n_brand > 0 AS brand_responded,
    customer_message_count > 0 AND n_brand > 0 AND num_turns >= 3 AS is_multi_turn,
    customer_message_count, flag_reason <> '' AS is_flagged, flag_reason,
    customer_message_count > 0 AND n_brand > 0 AND num_turns >= 3 AND flag_reason = ''
      AND a.conversation_id IS NOT NULL AS suitable_for_resolution
  FROM flags f LEFT JOIN adj a USING (conversation_id))"""


@register(f"WITH RECURSIVE {BUILT} SELECT * FROM convs")
def brand_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conv.build_conversations(t.brand_turns(spark, sf, *t.TURN_COLUMNS)).drop("start_ts")


@register(
    f"""WITH RECURSIVE {BUILT}
SELECT count(*) AS total, count(*) FILTER (NOT is_multi_turn) AS single_turn, count(*) FILTER (is_multi_turn) AS multi_turn,
  round(avg(num_turns), 6) AS avg_turns, median(num_turns)::DOUBLE AS median_turns, max(num_turns) AS max_turns,
  count(*) FILTER (brand_responded) AS responded, count(*) FILTER (customer_message_count >= 2) AS customer_multi,
  count(*) FILTER (suitable_for_resolution) AS suitable, count(*) FILTER (is_flagged) AS flagged,
  count(DISTINCT nullif(customer_author, '')) AS unique_customers, count(DISTINCT nullif(brand_author, '')) AS brand_accounts,
  round(count(*) FILTER (brand_responded) * 100.0::DOUBLE / count(*), 6) AS responded_pct,
  round(count(*) FILTER (customer_message_count >= 2) * 100.0::DOUBLE / count(*), 6) AS customer_multi_pct,
  round(count(*) FILTER (suitable_for_resolution) * 100.0::DOUBLE / count(*), 6) AS suitable_pct,
  round(count(*) FILTER (is_flagged) * 100.0::DOUBLE / count(*), 6) AS flagged_pct
FROM convs"""
)
def corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = conv.conversation_summary(conv.build_conversations(t.brand_turns(spark, sf, *t.TURN_COLUMNS)))
    rounded = ("avg_turns", "responded_pct", "customer_multi_pct", "suitable_pct", "flagged_pct")
    return rows.select(*[r6(c) if c in rounded else c for c in rows.columns])


@register(f"WITH RECURSIVE {BUILT} SELECT conversation_id, tweet_id, turn_number, speaker FROM num")
def turn_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = conv.number_turns(t.brand_turns(spark, sf, "author_id", "ts"))
    return rows.select(CONV, "tweet_id", "turn_number", "speaker")


@register(f"WITH RECURSIVE {BUILT} SELECT conversation_id, flag_reason FROM flags")
def structural_flags(spark: SparkSession, sf: str) -> DataFrame:
    return conv.structural_flags(t.brand_turns(spark, sf, *t.TURN_COLUMNS))


@register(
    f"""WITH RECURSIVE {BUILT}
SELECT conversation_id, 0 AS part, count(*) AS turns_in_row,
  string_agg(turn_number || ':' || tweet_id || ':' || speaker, ' ' ORDER BY turn_number) AS outline
FROM num GROUP BY 1"""
)
def nested_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = conv.nest_turns(conv.number_turns(t.brand_turns(spark, sf)))
    line = F.transform("turns", lambda e: F.concat_ws(":", e["turn_number"], e["tweet_id"], e["speaker"]))
    return rows.select(
        CONV, "part", F.size("turns").alias("turns_in_row"), F.array_join(line, " ").alias("outline")
    )


@register(
    f"""WITH RECURSIVE {BUILT}
SELECT n.conversation_id, turn_number, tweet_id, author_id, speaker, inbound, created_at, text,
  response_tweet_id, coalesce(parent_id::VARCHAR, '') AS in_response_to_tweet_id, customer_author, brand_author, start_time AS conversation_start, end_time AS conversation_end, num_turns,
  brand_responded, is_multi_turn, is_flagged, flag_reason
FROM num n JOIN convs USING (conversation_id)"""
)
def flat_turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = t.brand_turns(spark, sf)
    return flatten_turns(conv.build_conversations(turns), conv.number_turns(turns))


@register(
    f"""WITH RECURSIVE {BUILT},
twice AS (
  SELECT conversation_id, turn_number, tweet_id FROM num
  UNION ALL SELECT 'copy_' || conversation_id, turn_number, tweet_id FROM num WHERE thread % 2 = 0),
sets AS (
  SELECT conversation_id, string_agg(tweet_id::VARCHAR, ',' ORDER BY tweet_id) AS ids FROM twice GROUP BY 1)
SELECT min(conversation_id) AS conversation_id FROM sets GROUP BY ids"""
)
def deduplicated_conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = t.brand_turns(spark, sf, "author_id").select(CONV, "tweet_id", "thread")
    copies = turns.where("thread % 2 = 0").withColumn(CONV, F.concat(F.lit("copy_"), CONV))
    both = turns.unionByName(copies).withColumn("seen_at", F.lit(0))
    return conv.dedup_conversations(both, "seen_at")


@register(
    f"""WITH RECURSIVE {BUILT}, first AS (SELECT conversation_id, min(ts) AS start_ts FROM num GROUP BY 1)
SELECT conversation_id FROM first ORDER BY start_ts NULLS LAST, conversation_id"""
)
def ordered_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = conv.order_conversations(conv.build_conversations(t.brand_turns(spark, sf, *t.TURN_COLUMNS)))
    return rows.select(CONV)


@register(
    f"""WITH {q.TWEETS}
SELECT tweet_id, extract(epoch FROM ts)::BIGINT AS seconds FROM tweets"""
)
def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    return t.raw_tweets(spark, sf).select(
        safe_long("tweet_id").alias("tweet_id"), F.unix_seconds(tweet_ts("created_at")).alias("seconds")
    )


# ---------------------------------------------------------------- brands

ATTRIBUTED = f"""{q.THREADS},
own AS (SELECT thread, author_id AS brand, count(*) AS n FROM tt WHERE NOT inbound GROUP BY 1, 2),
names AS (SELECT DISTINCT author_id AS brand FROM tt WHERE NOT inbound),
said AS (
  SELECT DISTINCT thread, brand FROM (
    SELECT thread, lower(regexp_extract(text, '@({q.WORD}+)', 1)) AS handle FROM tt WHERE inbound) m
  JOIN names ON lower(brand) = handle),
att AS (
  SELECT thread, brand, sum(n)::BIGINT AS own_outbound, sum(n) > 0 AS responding
  FROM (SELECT * FROM own UNION ALL SELECT thread, brand, 0 FROM said) u GROUP BY 1, 2),
tot AS (
  SELECT thread, count(*) FILTER (inbound) AS n_in, count(*) FILTER (NOT inbound) AS n_out,
    count(*) FILTER (parent_id IS NOT NULL) AS n_link, count(*) AS conv_len FROM tt GROUP BY 1),
cust AS (
  SELECT brand, count(DISTINCT author_id) AS unique_customers
  FROM att JOIN tt USING (thread) WHERE inbound GROUP BY 1),
stats AS (
  SELECT brand, sum(n_in + own_outbound)::BIGINT AS total_tweets, sum(n_in)::BIGINT AS inbound_tweets,
    sum(own_outbound)::BIGINT AS outbound_tweets, coalesce(max(unique_customers), 0) AS unique_customers,
    1 AS unique_support_accounts, sum(n_link)::BIGINT AS conversation_links, count(*) AS conversation_count,
    count(*) FILTER (n_in > 0 AND n_out > 0 AND responding) AS complete_conversations,
    count(*) FILTER (n_in > 0 AND n_out > 0 AND conv_len >= 3 AND responding) AS multi_turn_conversations,
    round(avg(conv_len), 2) AS avg_conversation_length,
    round(count(*) FILTER (n_in > 0 AND n_out > 0 AND responding)::DOUBLE / count(*), 4) AS response_rate
  FROM att JOIN tot USING (thread) LEFT JOIN cust USING (brand) GROUP BY brand),
scored AS (
  SELECT *, round(0.35::DOUBLE * complete_conversations / greatest((SELECT max(complete_conversations) FROM stats), 1)
    + 0.25::DOUBLE * multi_turn_conversations / greatest((SELECT max(multi_turn_conversations) FROM stats), 1)
    + 0.20::DOUBLE * response_rate
    + 0.10::DOUBLE * unique_customers / greatest((SELECT max(unique_customers) FROM stats), 1)
    + 0.10::DOUBLE * least(avg_conversation_length / 10.0, 1.0), 4) AS quality_score FROM stats)"""


@register(f"WITH RECURSIVE {ATTRIBUTED} SELECT thread, brand FROM said")
def mentioned_brands(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.brand_tweets(spark, sf)
    return brands.mentioned_brands(rows, brands.infer_brands(rows))


@register(f"WITH RECURSIVE {ATTRIBUTED} SELECT thread, brand, own_outbound, responding FROM att")
def brand_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return brands.attribute_threads(t.brand_tweets(spark, sf))


@register(f"WITH RECURSIVE {ATTRIBUTED} SELECT * FROM scored")
def brand_stats(spark: SparkSession, sf: str) -> DataFrame:
    return brands.score_brands(brands.brand_stats(t.brand_tweets(spark, sf)))


@register(
    f"""WITH RECURSIVE {ATTRIBUTED}
SELECT brand, quality_score, row_number() OVER (ORDER BY quality_score DESC, brand) AS rank FROM scored
QUALIFY rank <= 20"""
)
def brand_rank(spark: SparkSession, sf: str) -> DataFrame:
    ranked = brands.rank_brands(brands.score_brands(brands.brand_stats(t.brand_tweets(spark, sf))))
    return ranked.select("brand", "quality_score", "rank")


@register(
    f"""WITH RECURSIVE {ATTRIBUTED}
SELECT brand,
  CASE WHEN multi_turn_conversations >= 20 THEN 'Excellent' WHEN multi_turn_conversations >= 10 THEN 'Adequate'
    ELSE 'Low' END AS multi_turn_tier,
  CASE WHEN unique_customers >= 30 THEN 'Large' WHEN unique_customers >= 20 THEN 'Moderate' ELSE 'Small' END AS customer_tier,
  CASE WHEN response_rate >= 0.8 THEN 'High' WHEN response_rate >= 0.5 THEN 'Moderate' ELSE 'Low' END AS response_tier,
  CASE WHEN avg_conversation_length >= 7 THEN 'Good' WHEN avg_conversation_length >= 2.5 THEN 'Adequate'
    ELSE 'Shallow' END AS depth_tier,
  CASE WHEN multi_turn_conversations >= 10 THEN 'Suitable' ELSE 'Marginal' END AS verdict
FROM stats"""
)
def brand_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    tiers = {"multi": (20, 10), "customers": (30, 20), "response": (0.8, 0.5), "length": (7, 2.5)}
    return brands.brand_verdicts(brands.brand_stats(t.brand_tweets(spark, sf)), tiers)


@register(
    f"""WITH RECURSIVE {ATTRIBUTED}
SELECT rank, brand, concat_ws(',', CASE WHEN multi_turn_conversations >= 10 THEN 'multi_turn_volume' END,
  CASE WHEN unique_customers >= 20 THEN 'customer_breadth' END,
  CASE WHEN response_rate >= 0.5 THEN 'response_rate' END,
  CASE WHEN avg_conversation_length >= 3 THEN 'conversation_depth' END) AS reasons
FROM (SELECT *, row_number() OVER (ORDER BY quality_score DESC, brand) AS rank FROM scored) r WHERE rank <= 3"""
)
def brand_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    ranked = brands.rank_brands(brands.score_brands(brands.brand_stats(t.brand_tweets(spark, sf))))
    floors = {"multi": 10, "customers": 20, "response": 0.5, "length": 3}
    return brands.recommend_brands(ranked, 3, floors).withColumn("reasons", F.array_join("reasons", ","))


# ---------------------------------------------------------------- text


@register(
    f"""SELECT doc_id, length({q.bare(q.strip('text'))}) >= 15 AND {q.words(q.bare(q.strip('text')))} >= 3 AS valid,
  {q.words('text')} AS word_count FROM documents"""
)
def valid_messages(spark: SparkSession, sf: str) -> DataFrame:
    return t.documents(spark, sf).select(
        "doc_id", tx.is_valid_message("text").alias("valid"),
        tx.word_count("text").cast("long").alias("word_count"),
    )


SUPPORT_SQL = f"""SELECT conv_id, turn, c, length(c) >= 15 AND {q.words('c')} >= 4 AND NOT (
    {q.words('c')} < 60 AND {q.any_of('c', ('hat', 'que'))} AND NOT {q.any_of('c', ('und', 'les'))}) AS supported
FROM (SELECT conv_id, turn, {q.bare('lower(text)')} AS c FROM conversations) s"""


@register(f"SELECT conv_id, turn, supported FROM ({SUPPORT_SQL}) z")
def support_messages(spark: SparkSession, sf: str) -> DataFrame:
    keep = tx.is_support_message("text", ("hat", "que"), ("und", "les"), praise_below_words=60)
    return t.table(spark, sf, "conversations").select("conv_id", "turn", keep.alias("supported"))


@register(
    f"""WITH m AS (SELECT doc_id, text,
  regexp_replace({q.strip('lower(text)')}, '{q.SPACE}+', ' ', 'g') AS norm FROM documents
  WHERE length({q.bare(q.strip('text'))}) >= 15 AND {q.words(q.bare(q.strip('text')))} >= 3)
SELECT min(doc_id) AS conversation_id, arg_min(md5(text), doc_id) AS text_md5 FROM m GROUP BY norm"""
)
def distinct_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = tx.distinct_messages(t.document_turns(spark, sf), tx.is_valid_message("text"))
    return rows.select(CONV, F.md5("text").alias("text_md5"))


@register(f"WITH {q.tokens('tok', 'documents')} SELECT doc_id, term, count(*) AS n FROM tok GROUP BY 1, 2")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = tx.token_rows(t.documents(spark, sf), "doc_id", "text")
    return vectors.term_counts(rows).select("doc_id", "term", "n")


@register(f"SELECT doc_id, md5({q.fingerprint('text')}) AS fingerprint_md5 FROM documents")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return t.documents(spark, sf).select("doc_id", F.md5(tx.fingerprint("text")).alias("fingerprint_md5"))


# ---------------------------------------------------------------- vectors and retrieval


@register(f"WITH {q.vectors('v', 'documents')} SELECT term, df, round(idf, 6) AS idf FROM v_df")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.documents(spark, sf)
    counts = vectors.term_counts(tx.token_rows(docs, "doc_id", "text"))
    n_docs = docs.agg(F.count("*")).scalar()
    return vectors.inverse_document_frequency(counts, n_docs).select("term", "df", r6("idf"))


@register(f"WITH {q.vectors('v', 'documents')} SELECT doc_id, term, round(w, 6) AS w FROM v")
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.documents(spark, sf)
    return vectors.tfidf(tx.token_rows(docs, "doc_id", "text"), docs).select("doc_id", "term", r6("w"))


@register(
    f"""WITH {q.TURNS}, {q.OPENINGS},
src AS (SELECT conversation_id * 2 AS doc_id, customer_message AS text FROM cases
        UNION ALL SELECT conversation_id * 2 + 1, brand_response FROM cases),
{q.vectors('v', 'src')}
SELECT c.conversation_id, round(coalesce(sum(a.w * b.w), 0.0), 6) AS similarity
FROM cases c LEFT JOIN v a ON a.doc_id = c.conversation_id * 2
LEFT JOIN v b ON b.doc_id = c.conversation_id * 2 + 1 AND b.term = a.term GROUP BY 1"""
)
def opening_reply_similarity(spark: SparkSession, sf: str) -> DataFrame:
    cases = conv.opening_and_reply(t.turns(spark, sf))
    sides = F.array(
        F.struct((F.col(CONV) * 2).alias("doc_id"), F.col("customer_message").alias("text")),
        F.struct((F.col(CONV) * 2 + 1).alias("doc_id"), F.col("brand_response").alias("text")),
    )
    docs = cases.select(F.inline(sides))
    v = vectors.tfidf(tx.token_rows(docs, "doc_id", "text"), docs)
    pairs = cases.select((F.col(CONV) * 2).alias("left_id"), (F.col(CONV) * 2 + 1).alias("right_id"))
    rows = vectors.pair_similarity(pairs, v, v)
    return rows.select((F.col("left_id") / 2).cast("long").alias(CONV), r6("similarity"))


def _concept_sql() -> str:
    parts = []
    for name, words in t.WORD_CONCEPTS.items():
        single = ", ".join(f"'{w}'" for w in words if " " not in w)
        phrase = " + ".join(
            f"CASE WHEN contains(lower(text), '{w}') THEN 2.0 ELSE 0.0 END" for w in words if " " in w
        )
        parts.append(
            f"SELECT doc_id, '{name}' AS term, len(list_filter(regexp_extract_all(lower(text), '{q.WORD}+'), "
            f"lambda x: x IN ({single})))::DOUBLE + ({phrase or '0.0'})::DOUBLE AS x FROM {{src}}"
        )
    return " UNION ALL ".join(parts)


def concept_cte(src: str) -> str:
    return f"""axes AS ({_concept_sql().replace('{src}', src)}),
cv AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM axes WHERE x > 0)"""


@register(f"WITH {concept_cte('documents')} SELECT doc_id, term, round(w, 6) AS w FROM cv")
def concept_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors.concept_vectors(t.documents(spark, sf), "text", concepts=t.WORD_CONCEPTS)
    return rows.select("doc_id", "term", r6("w"))


def _hits(spark: SparkSession, sf: str, k: int, threshold: float, normalize: bool = True):
    queries = t.openings(spark, sf)
    index = retrieval.build_index(t.documents(spark, sf), max_k=10)
    return queries, retrieval.retrieve(queries, index, k, threshold, normalize)


@register(
    f"WITH {q.retrieval(5, 0.0)} SELECT query_id, rank, case_id, round(similarity, 6) AS similarity FROM hits"
)
def retrieve_topk(spark: SparkSession, sf: str) -> DataFrame:
    _, hits = _hits(spark, sf, 5, 0.0)
    return hits.select("query_id", "rank", "case_id", r6("similarity"))


@register(
    f"WITH {q.retrieval(2, 0.25)} SELECT query_id, rank, case_id, round(similarity, 6) AS similarity FROM hits"
)
def retrieve_threshold(spark: SparkSession, sf: str) -> DataFrame:
    _, hits = _hits(spark, sf, 2, 0.25)
    return hits.select("query_id", "rank", "case_id", r6("similarity"))


@register(
    f"WITH {q.retrieval(3, 0.5, False)} SELECT query_id, rank, case_id, round(similarity, 6) AS similarity FROM hits"
)
def retrieve_raw_weights(spark: SparkSession, sf: str) -> DataFrame:
    _, hits = _hits(spark, sf, 3, 0.5, normalize=False)
    return hits.select("query_id", "rank", "case_id", r6("similarity"))


@register(SQL["retrieve_topk"])
def retrieve_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """V7 by blocks of cases with floors that they must reach, the way for joins too large to be done directly."""
    index = retrieval.build_index(t.documents(spark, sf), max_k=10)
    hits = retrieval.retrieve(t.openings(spark, sf), index, 5, 0.0, direct_rows=0)
    return hits.select("query_id", "rank", "case_id", r6("similarity"))


BANDS = f"""{q.retrieval(2, 0.25)},
bands AS (
  SELECT o.query_id, count(h.case_id) AS cases, coalesce(max(similarity), 0.0) AS top_sim,
    coalesce(avg(similarity), 0.0) AS mean_sim,
    CASE WHEN coalesce(max(similarity), 0) >= 0.75 THEN 'strong' WHEN coalesce(max(similarity), 0) >= 0.55
      THEN 'moderate' ELSE 'weak' END AS confidence
  FROM openings o LEFT JOIN hits h USING (query_id) GROUP BY 1)"""


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    queries, hits = _hits(spark, sf, 2, 0.25)
    return retrieval.retrieval_bands(queries, hits)


@register(
    f"""WITH {BANDS} SELECT query_id, cases, round(top_sim, 6) AS top_sim, round(mean_sim, 6) AS mean_sim,
  confidence FROM bands"""
)
def retrieval_bands(spark: SparkSession, sf: str) -> DataFrame:
    return _bands(spark, sf).select("query_id", "cases", r6("top_sim"), r6("mean_sim"), "confidence")


@register(
    f"""WITH {BANDS}, dim(band) AS (VALUES ('strong'), ('moderate'), ('weak'), ('no_cases')),
b AS (SELECT CASE WHEN cases = 0 THEN 'no_cases' ELSE confidence END AS band FROM bands)
SELECT d.band, count(b.band) AS queries FROM dim d LEFT JOIN b USING (band) GROUP BY 1"""
)
def band_counts(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.band_counts(_bands(spark, sf))


@register(
    f"""WITH {BANDS}, f AS (SELECT conversation_id AS query_id, num_turns >= 5 AS escalated FROM cases),
b AS (SELECT escalated, CASE WHEN cases = 0 THEN 'no_cases' ELSE confidence END AS band FROM bands JOIN f USING (query_id))
SELECT escalated, count(*) FILTER (band = 'strong') AS strong, count(*) FILTER (band = 'moderate') AS moderate,
  count(*) FILTER (band = 'weak') AS weak, count(*) FILTER (band = 'no_cases') AS no_cases FROM b GROUP BY 1"""
)
def band_by_escalation(spark: SparkSession, sf: str) -> DataFrame:
    flags = conv.opening_and_reply(t.turns(spark, sf)).select(
        F.col(CONV).alias("query_id"), tagging.silver_escalation("num_turns").alias("escalated")
    )
    return retrieval.band_by_flag(_bands(spark, sf), flags, "escalated")


PROBS = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)


@register(
    f"""WITH {BANDS}, p(prob) AS (VALUES {', '.join(f'({p}::DOUBLE)' for p in PROBS)})
SELECT prob, round(CASE prob {' '.join(f'WHEN {p}::DOUBLE THEN (SELECT quantile_cont(top_sim, {p}) FROM bands)' for p in PROBS)} END, 6)
  AS top_sim FROM p"""
)
def similarity_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles(_bands(spark, sf), "top_sim", PROBS).select("prob", r6("top_sim"))


@register(
    f"""WITH {BANDS}, lo AS (SELECT 'lowest' AS side, * FROM bands ORDER BY top_sim, query_id LIMIT 10),
hi AS (SELECT 'highest' AS side, * FROM bands ORDER BY top_sim DESC, query_id LIMIT 10)
SELECT side, query_id, round(top_sim, 6) AS top_sim, confidence FROM (SELECT * FROM lo UNION ALL SELECT * FROM hi) u"""
)
def similarity_extremes(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.similarity_extremes(_bands(spark, sf))
    return rows.select("side", "query_id", r6("top_sim"), "confidence")


@register(
    f"""WITH {BANDS} SELECT count(*) AS queries, round(min(top_sim), 6) AS min_sim, round(max(top_sim), 6) AS max_sim,
  round(avg(top_sim), 6) AS mean_sim FROM bands"""
)
def similarity_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.similarity_summary(_bands(spark, sf))
    return rows.select("queries", r6("min_sim"), r6("max_sim"), r6("mean_sim"))


@register(
    f"""WITH {q.retrieval(2, 0.25)}
SELECT query_id, string_agg(rank || '=' || case_id || ':' || md5(d.text), ' ' ORDER BY rank) AS evidence
FROM hits h JOIN documents d ON d.doc_id = h.case_id GROUP BY 1"""
)
def evidence_pack(spark: SparkSession, sf: str) -> DataFrame:
    _, hits = _hits(spark, sf, 2, 0.25)
    cases = t.documents(spark, sf).select(
        F.col("doc_id").alias("case_id"), F.col("text").alias("customer_message"), F.col("text").alias("brand_response")
    )
    packed = retrieval.evidence_pack(hits, cases)
    line = F.transform(
        "evidence",
        lambda e: F.concat(e["rank"], F.lit("="), e["case_id"], F.lit(":"), F.md5(e["brand_response"])),
    )
    return packed.select("query_id", F.array_join(line, " ").alias("evidence"))


# ---------------------------------------------------------------- clustering

# The check writes out as many rounds as the operator may take; after the fixed point they change nothing.
K, ROUNDS = 4, 30

MESSAGES = """msgs AS (
  SELECT conv_id * (SELECT max(turn) + 2 FROM conversations) + turn AS doc_id, text
  FROM conversations WHERE role = 'user')"""


def kmeans_cte(vec: str, k: int, rounds: int) -> str:
    """The same rounds written out, one group of expressions per round."""
    parts = [
        f"""seeds AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS cluster
  FROM (SELECT DISTINCT doc_id FROM {vec}) d QUALIFY cluster < {k}),
cen0 AS MATERIALIZED (SELECT cluster, term, w FROM {vec} JOIN seeds USING (doc_id))"""
    ]
    for i in range(rounds):
        parts.append(
            f"""sim{i} AS (
  SELECT a.doc_id, g.cluster, round(coalesce(sum(a.w * c.w), 0.0), 9) AS s
  FROM {vec} a CROSS JOIN (SELECT unnest(range({k})) AS cluster) g
  LEFT JOIN cen{i} c ON c.term = a.term AND c.cluster = g.cluster GROUP BY 1, 2),
asg{i} AS MATERIALIZED (
  SELECT doc_id, cluster FROM sim{i}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, cluster) = 1),
sum{i} AS (SELECT cluster, term, sum(w) AS x FROM {vec} JOIN asg{i} USING (doc_id) GROUP BY 1, 2),
cen{i + 1} AS MATERIALIZED (
  SELECT cluster, term, x / sqrt(sum(x * x) OVER (PARTITION BY cluster)) AS w FROM sum{i})"""
        )
    parts.append(f"asg AS (SELECT doc_id, cluster FROM asg{rounds - 1})")
    return ",\n".join(parts)


CLUSTERED = f"{MESSAGES},\n{q.vectors('v', 'msgs')},\n{kmeans_cte('v', K, ROUNDS)}"
KEYWORDS = """kwsum AS (
  SELECT cluster, term, round(sum(w), 9) AS weight FROM v JOIN asg USING (doc_id) GROUP BY 1, 2),
kw AS (
  SELECT cluster, string_agg(term, ' ' ORDER BY rank) AS keywords FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS rank FROM kwsum) r
  WHERE rank <= 5 GROUP BY 1)"""


def _clustered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = t.messages(spark, sf)
    v = cut_lineage(vectors.tfidf(tx.token_rows(docs, "doc_id", "text"), docs))
    return docs, v, cluster.spherical_kmeans(v, K, max_iters=ROUNDS)


@register(f"WITH {CLUSTERED} SELECT doc_id, cluster FROM asg")
def cluster_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _clustered(spark, sf)[2]


@register(f"WITH {concept_cte('documents')} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM cv)")
def cluster_outliers(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.documents(spark, sf)
    placed = vectors.concept_vectors(docs, "text", concepts=t.WORD_CONCEPTS).select("doc_id").distinct()
    return cluster.outliers(docs.select("doc_id"), placed)


@register(f"WITH {CLUSTERED}, {KEYWORDS} SELECT cluster, keywords FROM kw")
def cluster_keywords(spark: SparkSession, sf: str) -> DataFrame:
    _, v, asg = _clustered(spark, sf)
    rows = cluster.cluster_keywords(v, asg)
    return rows.select("cluster", F.array_join("keywords", " ").alias("keywords"))


# Words of the given texts, as stand-ins for the words of support clusters.
NAME_RULES = (
    ("articles", (("der",), ("la", "die"))),
    ("th_sounds", (("th",), ("er", "on"))),
    ("word_ends", (("er", "nt"),)),
)
CONFUSABLE = {"articles": ("th_sounds",), "th_sounds": ("word_ends", "articles")}


def _name_sql(keywords: str) -> str:
    whens = []
    for name, groups in NAME_RULES:
        hits = [" OR ".join(f"contains({keywords}, '{w}')" for w in group) for group in groups]
        whens.append("WHEN " + " AND ".join(f"({h})" for h in hits) + f" THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE 'unknown_' || split_part({keywords}, ' ', 1) END"


def _confusable_sql(name: str, table: Mapping[str, Sequence[str]]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in table.items())
    return f"CASE {name} {whens} ELSE '' END"


def _title_sql(name: str) -> str:
    return f"array_to_string(list_transform(string_split({name}, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"


def _examples_sql(source: str, n: int) -> str:
    """CTE ex (cluster, text, rank): the first texts of each cluster in seeded order."""
    return f"""ex AS (
  SELECT cluster, text, rank FROM (
    SELECT cluster, text, row_number() OVER (PARTITION BY cluster ORDER BY {q.sample_key('doc_id')}, doc_id) AS rank
    FROM asg JOIN {source} USING (doc_id)) r WHERE rank <= {n})"""


SUMMARY = f"""{CLUSTERED}, {KEYWORDS}, {_examples_sql('msgs', 5)},
summary AS MATERIALIZED (
  SELECT cluster AS cluster_id, count(*) AS num_examples,
    count(*) * 100.0::DOUBLE / (SELECT count(*) FROM msgs) AS percentage, any_value(keywords) AS keywords,
    {_name_sql('any_value(keywords)')} AS likely_intent_name,
    CASE WHEN count(*) > (SELECT count(*) FROM msgs) / {K}.0 * 0.5 THEN 'High' ELSE 'Low' END AS confidence
  FROM asg JOIN kw USING (cluster) GROUP BY 1)"""
# Texts may hold any character, so lists of them are compared by their digests.
md5_list = lambda c: F.array_join(F.transform(c, F.md5), ",").alias(c)
plain_list = lambda c: F.array_join(c, ",").alias(c)


@register(
    f"""WITH {SUMMARY}
SELECT cluster_id, num_examples, round(percentage, 6) AS percentage, keywords, likely_intent_name, confidence,
  (SELECT string_agg(md5(text), ',' ORDER BY rank) FROM ex WHERE cluster = cluster_id) AS representative_examples FROM summary"""
)
def cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs, v, asg = _clustered(spark, sf)
    return cluster.cluster_summary(docs, v, asg, K, rules=NAME_RULES).select(
        "cluster_id", "num_examples", r6("percentage"), F.array_join("keywords", " ").alias("keywords"),
        "likely_intent_name", "confidence", md5_list("representative_examples"),
    )


@register(
    f"""WITH {SUMMARY},
named AS (
  SELECT *, CASE WHEN starts_with(likely_intent_name, 'unknown_') THEN 'other' ELSE likely_intent_name END AS intent_id FROM summary),
kws AS (
  SELECT intent_id, string_agg(word, ',' ORDER BY word) AS common_keywords FROM (
    SELECT intent_id, word, row_number() OVER (PARTITION BY intent_id ORDER BY word) AS n FROM (
      SELECT DISTINCT intent_id, unnest(string_split(keywords, ' ')) AS word FROM named) d) r WHERE n <= 10 GROUP BY 1),
exs AS (
  SELECT intent_id, string_agg(md5(text), ',' ORDER BY n) AS representative_examples FROM (
    SELECT intent_id, text, row_number() OVER (PARTITION BY intent_id ORDER BY {q.sample_key('text')}, text) AS n
    FROM named JOIN ex ON cluster = cluster_id) r WHERE n <= 5 GROUP BY 1)
SELECT intent_id, {_title_sql('intent_id')} AS intent_name, sum(num_examples)::BIGINT AS "count",
  round(sum(num_examples) * 100.0::DOUBLE / (SELECT sum(num_examples) FROM summary), 1) AS estimated_percentage,
  any_value(common_keywords) AS common_keywords, any_value(representative_examples) AS representative_examples,
  {_confusable_sql('intent_id', CONFUSABLE)} AS confusable_intents
FROM named JOIN kws USING (intent_id) JOIN exs USING (intent_id) GROUP BY intent_id"""
)
def cluster_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    docs, v, asg = _clustered(spark, sf)
    rows = cluster.roll_up_taxonomy(cluster.cluster_summary(docs, v, asg, K, rules=NAME_RULES), CONFUSABLE)
    return rows.select(
        "intent_id", "intent_name", "count", "estimated_percentage", plain_list("common_keywords"),
        md5_list("representative_examples"), plain_list("confusable_intents"),
    )


CONCEPT_CLUSTERED = f"{concept_cte('documents')},\n{kmeans_cte('cv', K, ROUNDS)}"
CENTROIDS = """csum AS (SELECT cluster, term, sum(w) AS x FROM cv JOIN asg USING (doc_id) GROUP BY 1, 2),
cent AS (SELECT cluster, term, x / sqrt(sum(x * x) OVER (PARTITION BY cluster)) AS w FROM csum),
named AS (
  SELECT cluster, CASE term WHEN 'article' THEN 'about_articles' WHEN 'link' THEN 'about_links'
    WHEN 'place' THEN 'about_places' ELSE 'other_or_unclear' END AS likely_intent_name
  FROM cent QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(w, 9) DESC, term DESC) = 1)"""
CONCEPT_NAMES = {"article": "about_articles", "link": "about_links", "place": "about_places"}


def _concept_clustered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = t.documents(spark, sf).select("doc_id", "text")
    v = cut_lineage(vectors.concept_vectors(docs, "text", concepts=t.WORD_CONCEPTS))
    return docs, v, cluster.spherical_kmeans(v, K, max_iters=ROUNDS)


@register(f"WITH {CONCEPT_CLUSTERED}, {CENTROIDS} SELECT cluster, term, round(w, 6) AS w FROM cent")
def concept_centroids(spark: SparkSession, sf: str) -> DataFrame:
    _, v, asg = _concept_clustered(spark, sf)
    return cluster.centroids_long(v, asg).select("cluster", "term", r6("w"))


@register(f"WITH {CONCEPT_CLUSTERED}, {CENTROIDS} SELECT cluster, likely_intent_name FROM named")
def concept_names(spark: SparkSession, sf: str) -> DataFrame:
    _, v, asg = _concept_clustered(spark, sf)
    return cluster.name_by_centroid(cluster.centroids_long(v, asg), CONCEPT_NAMES)


CONCEPT_CONFUSABLE = {"about_articles": ("about_links", "about_places"), "about_links": ("about_articles",)}


@register(
    f"""WITH {CONCEPT_CLUSTERED}, {CENTROIDS}, {_examples_sql('documents', 10)},
sizes AS (SELECT cluster, count(*) AS n FROM asg GROUP BY 1),
weights AS (
  SELECT likely_intent_name, term, round(sum(w * n), 9) AS weight FROM cent JOIN named USING (cluster) JOIN sizes USING (cluster) GROUP BY 1, 2),
tops AS (
  SELECT likely_intent_name, string_agg(term, ',' ORDER BY r) AS top_concepts FROM (
    SELECT *, row_number() OVER (PARTITION BY likely_intent_name ORDER BY weight DESC, term) AS r FROM weights) x WHERE r <= 3 GROUP BY 1),
exs AS (
  SELECT likely_intent_name, string_agg(md5(text), ',' ORDER BY r) AS representative_examples FROM (
    SELECT likely_intent_name, text, row_number() OVER (PARTITION BY likely_intent_name ORDER BY {q.sample_key('text')}, text) AS r
    FROM named JOIN ex USING (cluster)) x WHERE r <= 10 GROUP BY 1),
rolled AS (
  SELECT likely_intent_name AS intent_id, sum(n)::BIGINT AS "count", any_value(top_concepts) AS top_concepts,
    any_value(representative_examples) AS representative_examples
  FROM sizes JOIN named USING (cluster) JOIN tops USING (likely_intent_name) JOIN exs USING (likely_intent_name) GROUP BY 1
  UNION ALL
  SELECT 'other_or_unclear', n, '', '' FROM (SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM asg) AS n) o WHERE n > 0)
SELECT intent_id, {_title_sql('intent_id')} AS intent_name, "count",
  round("count" * 100.0::DOUBLE / (SELECT count(*) FROM documents), 1) AS estimated_percentage, top_concepts,
  representative_examples, {_confusable_sql('intent_id', CONCEPT_CONFUSABLE)} AS confusable_intents FROM rolled"""
)
def concept_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    docs, v, asg = _concept_clustered(spark, sf)
    summary = cluster.concept_cluster_summary(docs, v, asg, mapping=CONCEPT_NAMES)
    n_docs = docs.agg(F.count("*")).scalar()
    n_in = asg.agg(F.count("*")).scalar()
    rows = cluster.roll_up_concepts(summary, n_docs - n_in, n_docs, CONCEPT_CONFUSABLE)
    return rows.select(
        "intent_id", "intent_name", "count", "estimated_percentage", plain_list("top_concepts"),
        md5_list("representative_examples"), plain_list("confusable_intents"),
    )


# ---------------------------------------------------------------- tagging


@register(
    f"""SELECT doc_id, array_to_string(tags, ',') AS tags,
  CASE WHEN len(tags) = 1 THEN tags[1] ELSE 'other' END AS silver
FROM (SELECT doc_id, {q.tags('text', t.LANG_HINTS)} AS tags FROM documents) x"""
)
def tag_multi(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.documents(spark, sf).withColumn("tags", tagging.tag_intents("text", t.LANG_HINTS))
    return rows.select(
        "doc_id", F.array_join("tags", ",").alias("tags"), tagging.silver_label("tags", "other").alias("silver")
    )


@register(
    f"""SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(the|of)($|[^\\p{{L}}\\p{{N}}_])') AS en,
  regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(der|und)($|[^\\p{{L}}\\p{{N}}_])') AS de FROM documents"""
)
def tag_whole_words(spark: SparkSession, sf: str) -> DataFrame:
    tags = tagging.tag_intents("text", {"en": ("the", "of"), "de": ("der", "und")}, whole_word=True)
    return t.documents(spark, sf).select(
        "doc_id", F.array_contains(tags, "en").alias("en"), F.array_contains(tags, "de").alias("de")
    )


@register(f"WITH {q.TURNS} SELECT conversation_id, count(*) >= 5 AS escalated FROM turns GROUP BY 1")
def silver_escalation(spark: SparkSession, sf: str) -> DataFrame:
    convs = conv.shape_of_turns(t.turns(spark, sf))
    return convs.select(CONV, tagging.silver_escalation("num_turns").alias("escalated"))


RULE_HITS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS priority, '{r[0]}' AS intent_id, CASE WHEN {q.any_of('text', r[2])} "
    f"THEN 'false_positive' ELSE 'strong' END AS match FROM documents WHERE {q.any_of('text', r[1])}"
    for i, r in enumerate(t.LANG_RULES)
)


@register(RULE_HITS)
def rule_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = tagging.match_rules(t.documents(spark, sf).select("doc_id", "text"), "text", t.LANG_RULES)
    return rows.drop("text")


@register(f"SELECT doc_id, {q.first_rule('text', t.LANG_RULES, 'other')} AS intent_id FROM documents")
def rule_priority(spark: SparkSession, sf: str) -> DataFrame:
    return t.documents(spark, sf).select(
        "doc_id", tagging.assign_by_priority("text", t.LANG_RULES, "other").alias("intent_id")
    )


PREVALENCE = f"""a AS (SELECT {q.first_rule('text', t.LANG_RULES, 'other')} AS intent_id FROM documents),
dim(priority, intent_id) AS (VALUES {', '.join(f"({i}, '{r[0]}')" for i, r in enumerate(t.LANG_RULES))},
  ({len(t.LANG_RULES)}, 'other')),
prev AS (
  SELECT d.priority, d.intent_id, count(a.intent_id) AS total_matches,
    round(count(a.intent_id)::DOUBLE / (SELECT count(*) FROM documents), 6) AS estimated_prevalence
  FROM dim d LEFT JOIN a USING (intent_id) GROUP BY 1, 2)"""


@register(f"WITH {PREVALENCE} SELECT * FROM prev")
def rule_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    rows = tagging.prevalence(t.documents(spark, sf), "text", t.LANG_RULES, "other")
    return rows.select("priority", "intent_id", "total_matches", r6("estimated_prevalence"))


@register(
    f"""WITH {PREVALENCE} SELECT sum(total_matches)::BIGINT AS sample_size,
  (sum(total_matches) FILTER (intent_id = 'other'))::BIGINT AS other_count,
  round(1.0 - (sum(total_matches) FILTER (intent_id = 'other'))::DOUBLE / sum(total_matches), 6) AS coverage FROM prev"""
)
def rule_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = tagging.coverage(tagging.prevalence(t.documents(spark, sf), "text", t.LANG_RULES, "other"), "other")
    return rows.select("sample_size", "other_count", r6("coverage"))


@register(
    f"""WITH hits AS ({RULE_HITS}),
a AS (
  SELECT doc_id, {q.first_rule('text', t.LANG_RULES, 'other')} AS intent_id, 'strong' AS match FROM documents
  UNION ALL SELECT doc_id, intent_id, match FROM hits WHERE match = 'false_positive')
SELECT doc_id, intent_id, match, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY intent_id, match ORDER BY {q.sample_key('doc_id')}, doc_id) AS rank FROM a) r
WHERE rank <= CASE WHEN match = 'strong' THEN 15 ELSE 5 END"""
)
def rule_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = tagging.rule_examples(t.documents(spark, sf), "text", "doc_id", t.LANG_RULES, "other")
    return rows.select("doc_id", "intent_id", "match", "rank")


REPORT = f"""{PREVALENCE},
hits AS ({RULE_HITS}),
picks AS (
  SELECT intent_id, match, text, rank FROM (
    SELECT a.*, text, row_number() OVER (PARTITION BY intent_id, match ORDER BY {q.sample_key('doc_id')}, doc_id) AS rank FROM (
      SELECT doc_id, {q.first_rule('text', t.LANG_RULES, 'other')} AS intent_id, 'strong' AS match FROM documents
      UNION ALL SELECT doc_id, intent_id, match FROM hits WHERE match = 'false_positive') a JOIN documents USING (doc_id)) r
  WHERE rank <= CASE WHEN match = 'strong' THEN 15 ELSE 5 END),
report AS (
  SELECT priority, intent_id, total_matches, estimated_prevalence, 'KEEP' AS recommended_action,
    {_confusable_sql('intent_id', {r[0]: r[3] for r in t.LANG_RULES})} AS confusable_intents,
    (SELECT string_agg(md5(text), ',' ORDER BY rank) FROM picks p WHERE p.intent_id = prev.intent_id AND match = 'strong') AS strong,
    (SELECT string_agg(md5(text), ',' ORDER BY rank) FROM picks p WHERE p.intent_id = prev.intent_id AND match <> 'strong') AS doubtful
  FROM prev)"""


@register(
    f"""WITH {REPORT} SELECT priority, intent_id, total_matches, estimated_prevalence, recommended_action, confusable_intents,
  CASE WHEN strong IS NULL AND doubtful IS NULL THEN NULL ELSE coalesce(strong, '') END AS representative_examples,
  CASE WHEN strong IS NULL AND doubtful IS NULL THEN NULL ELSE coalesce(doubtful, '') END AS false_positive_examples FROM report"""
)
def taxonomy_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = tagging.taxonomy_report(t.documents(spark, sf), "text", "doc_id", t.LANG_RULES, "other")
    return rows.select(
        "priority", "intent_id", "total_matches", r6("estimated_prevalence"), "recommended_action", plain_list("confusable_intents"),
        md5_list("representative_examples"), md5_list("false_positive_examples"),
    )


# ---------------------------------------------------------------- sampling and splits


@register(f"SELECT doc_id FROM documents ORDER BY {q.sample_key('doc_id')}, doc_id LIMIT 200")
def sample_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_fixed(t.documents(spark, sf).select("doc_id"), "doc_id", 200)


@register(f"SELECT doc_id, row_number() OVER (ORDER BY {q.sample_key('doc_id')}, doc_id) AS rank FROM documents")
def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return hash_rank(t.documents(spark, sf).select("doc_id"), ["doc_id"])


QUALIFYING = f"""{q.TURNS},
qual AS (
  SELECT conversation_id, turn_number, text AS customer_message FROM (
    SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_number) AS n FROM turns
    WHERE speaker = 'customer' AND {q.words('text')} >= 20) z WHERE n = 1)"""


@register(f"WITH {QUALIFYING} SELECT * FROM qual")
def first_qualifying_turn(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.first_qualifying_turn(t.turns(spark, sf), min_words=20)


@register(
    f"""WITH {QUALIFYING},
near AS (SELECT p.*, u.turn_number AS chosen_at FROM qual u JOIN turns p USING (conversation_id)),
before AS (
  SELECT conversation_id, ((turn_number - 1) // 2)::INT AS part, string_agg(md5(text), ',' ORDER BY turn_number) AS previous_turns,
    string_agg(speaker, ',' ORDER BY turn_number) AS previous_speakers FROM near WHERE turn_number < chosen_at GROUP BY 1, 2),
reply AS (
  SELECT conversation_id, 0 AS part, arg_min(text, turn_number) FILTER (speaker = 'brand' AND turn_number > chosen_at) AS brand_response
  FROM near GROUP BY 1)
SELECT conversation_id, part, coalesce(previous_turns, '') AS previous_turns, coalesce(previous_speakers, '') AS previous_speakers,
  brand_response FROM reply FULL JOIN before USING (conversation_id, part)"""
)
def turn_context(spark: SparkSession, sf: str) -> DataFrame:
    turns = t.turns(spark, sf)
    rows = sampling.previous_turns(turns, sampling.first_qualifying_turn(turns, min_words=20), max_turns_per_row=2)
    return rows.select(CONV, "part", md5_list("previous_turns"), plain_list("previous_speakers"), "brand_response")


@register(
    """WITH RECURSIVE ord AS (
  SELECT doc_id, text AS t, source || lang AS a,
    row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS n FROM documents),
walk(n, doc_id, texts, authors) AS (
  SELECT 0::BIGINT, NULL::BIGINT, []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT o.n, CASE WHEN list_contains(w.texts, md5(o.t)) OR list_contains(w.authors, o.a) THEN NULL ELSE o.doc_id END,
    CASE WHEN list_contains(w.texts, md5(o.t)) OR list_contains(w.authors, o.a) THEN w.texts
      ELSE list_append(w.texts, md5(o.t)) END,
    CASE WHEN list_contains(w.texts, md5(o.t)) OR list_contains(w.authors, o.a) THEN w.authors
      ELSE list_append(w.authors, o.a) END
  FROM walk w JOIN ord o ON o.n = w.n + 1)
SELECT doc_id FROM walk WHERE doc_id IS NOT NULL"""
)
def one_per_text_author(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.documents(spark, sf).select("doc_id", "text", F.concat("source", "lang").alias("author"))
    return sampling.one_per_text_and_author(rows, "doc_id", "text", "author").select("doc_id")


DOC_QUOTAS = {"en": 20, "de": 15, "es": 15, "fr": 10, "other": 25, "difficult": 20}
STRATA = f"""strata AS (
  SELECT doc_id, CASE WHEN len(tags) >= 2 THEN 'difficult' WHEN len(tags) = 1 THEN tags[1]
    ELSE 'other_or_unclear' END AS stratum
  FROM (SELECT doc_id, {q.tags('text', t.LANG_HINTS)} AS tags FROM documents) x)"""
QUOTA_SQL = "CASE stratum " + " ".join(
    f"WHEN '{'other_or_unclear' if k == 'other' else k}' THEN {n}" for k, n in DOC_QUOTAS.items()
) + " ELSE 0 END"


@register(
    f"""WITH {STRATA}
SELECT doc_id, stratum FROM (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {q.sample_key('doc_id')}, doc_id) AS n FROM strata) r
WHERE n <= {QUOTA_SQL}"""
)
def sample_quota(spark: SparkSession, sf: str) -> DataFrame:
    pool = t.documents(spark, sf).select(
        "doc_id", sampling.stratum_of(tagging.tag_intents("text", t.LANG_HINTS)).alias("stratum")
    )
    quotas = {("other_or_unclear" if k == "other" else k): n for k, n in DOC_QUOTAS.items()}
    return sampling.sample_quota(pool, "stratum", "doc_id", quotas)


@register(
    f"""WITH {SHAPE},
pool AS (
  SELECT conversation_id, num_turns, CASE WHEN num_turns >= 11 THEN 'very_long' WHEN num_turns >= 6 THEN 'long'
    WHEN num_turns >= 3 THEN 'medium' ELSE 'short' END AS bucket
  FROM convs WHERE brand_responded AND num_turns >= 2),
r AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {q.sample_key('conversation_id')}, conversation_id) <= 5 AS f
  FROM pool)
SELECT conversation_id, num_turns, bucket FROM r
ORDER BY f DESC, {q.sample_key('conversation_id')}, conversation_id LIMIT 20"""
)
def sample_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = sampling.sample_buckets(conv.shape_of_turns(t.turns(spark, sf)), 20)
    return rows.select(CONV, "num_turns", "bucket")


GOLD_QUOTAS = {("other_or_unclear" if k == "other" else k): n for k, n in DOC_QUOTAS.items()}


@register(
    f"""WITH RECURSIVE {BUILT},
fq AS (
  SELECT conversation_id, turn_number, author_id, created_at, text AS customer_message, {q.fingerprint('text')} AS fp
  FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_number) AS first FROM num
        WHERE speaker = 'customer' AND {q.words('text')} >= 4) z WHERE first = 1),
ord AS (
  SELECT conversation_id, md5(fp) AS t, author_id AS a,
    row_number() OVER (ORDER BY {q.sample_key('conversation_id')}, conversation_id) AS n FROM fq),
walk(n, conversation_id, texts, authors) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT o.n, CASE WHEN list_contains(w.texts, o.t) OR list_contains(w.authors, o.a) THEN NULL ELSE o.conversation_id END,
    CASE WHEN list_contains(w.texts, o.t) OR list_contains(w.authors, o.a) THEN w.texts ELSE list_append(w.texts, o.t) END,
    CASE WHEN list_contains(w.texts, o.t) OR list_contains(w.authors, o.a) THEN w.authors ELSE list_append(w.authors, o.a) END
  FROM walk w JOIN ord o ON o.n = w.n + 1),
tagged AS (
  SELECT *, {q.tags('customer_message', t.LANG_HINTS)} AS tags FROM fq
  WHERE conversation_id IN (SELECT conversation_id FROM walk WHERE conversation_id IS NOT NULL)),
strat AS (
  SELECT *, CASE WHEN len(tags) >= 2 THEN 'difficult' WHEN len(tags) = 1 THEN tags[1] ELSE 'other_or_unclear' END AS stratum
  FROM tagged),
chosen AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {q.sample_key('conversation_id')}, conversation_id) AS place
    FROM strat) z WHERE place <= {QUOTA_SQL}),
context AS (
  SELECT c.conversation_id,
    coalesce(string_agg(p.text, ' | ' ORDER BY p.turn_number) FILTER (p.turn_number < c.turn_number), '') AS previous_turns,
    coalesce(string_agg(p.speaker, ', ' ORDER BY p.turn_number) FILTER (p.turn_number < c.turn_number), '') AS previous_speakers,
    arg_min(p.text, p.turn_number) FILTER (p.speaker = 'brand' AND p.turn_number > c.turn_number) AS brand_response
  FROM chosen c JOIN num p USING (conversation_id) GROUP BY 1)
SELECT 'gold_' || lpad((row_number() OVER (ORDER BY {q.sample_key('conversation_id', 43)}, conversation_id))::VARCHAR, 4, '0')
    AS example_id,
  conversation_id, created_at, customer_message, previous_turns, previous_speakers, brand_response,
  array_to_string(tags, ', ') AS candidate_intents, NULL::VARCHAR AS human_intent, NULL::BOOLEAN AS human_escalate,
  NULL::VARCHAR AS human_reason, NULL::VARCHAR AS annotation_notes, 0 AS part
FROM chosen JOIN context USING (conversation_id)"""
)
def golden_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = sampling.golden_candidates(t.numbered_brand_turns(spark, sf), t.LANG_HINTS, GOLD_QUOTAS)
    return rows.withColumns(
        {
            "previous_turns": F.array_join("previous_turns", " | "),
            "previous_speakers": F.array_join("previous_speakers", ", "),
            "candidate_intents": F.array_join("candidate_intents", ", "),
        }
    )


@register(
    f"""WITH tagged AS (SELECT doc_id, text, lang, {q.tags('text', t.LANG_HINTS)} AS tags FROM documents)
SELECT doc_id AS example_id, md5(text) AS customer_message, lang AS human_intent FROM tagged WHERE len(tags) > 0"""
)
def blind_annotation(spark: SparkSession, sf: str) -> DataFrame:
    """L3: what annotators get of all tagged documents: everything but the guessed intents."""
    tagged = t.documents(spark, sf).withColumn("candidate_intents", tagging.tag_intents("text", t.LANG_HINTS))
    shown = labels.blind_view(tagged.where(F.size("candidate_intents") > 0))
    # every column that the view keeps, so that a kept guess would show
    kept = [c for c in shown.columns if c not in ("source", "n_chars")]
    names = {"doc_id": "example_id", "text": "customer_message", "lang": "human_intent"}
    return shown.select(*[(F.md5(c) if c == "text" else F.col(c)).alias(names.get(c, c)) for c in kept])


SPLIT = f"""gold AS (SELECT doc_id, {q.fingerprint('text')} AS fp FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rest AS (
  SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gold)
    AND {q.fingerprint('text')} NOT IN (SELECT fp FROM gold)),
parts AS (
  SELECT doc_id AS conversation_id, CASE WHEN row_number() OVER (ORDER BY {q.sample_key('doc_id')}, doc_id)
    <= floor(0.8 * (SELECT count(*) FROM rest)) THEN 'dev' ELSE 'val' END AS part FROM rest)"""


@register(f"WITH {SPLIT} SELECT conversation_id, part FROM parts")
def split_dev_val(spark: SparkSession, sf: str) -> DataFrame:
    turns = t.document_turns(spark, sf)
    return sampling.split(turns, turns, t.toxic_golden(spark, sf))


@register(
    f"""WITH {SPLIT}, naive AS (
  SELECT doc_id AS conversation_id, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'dev' END AS part FROM documents)
SELECT 'golden_in_dev' AS check_name, count(*) AS found FROM gold WHERE doc_id IN
  (SELECT conversation_id FROM naive WHERE part = 'dev')
UNION ALL SELECT 'golden_in_val', count(*) FROM gold WHERE doc_id IN (SELECT conversation_id FROM naive WHERE part = 'val')
UNION ALL SELECT 'dev_in_val', 0
UNION ALL SELECT 'golden_text_in_dev', count(*) FROM documents d JOIN naive n ON n.conversation_id = d.doc_id
WHERE part = 'dev' AND {q.fingerprint('text')} IN (SELECT fp FROM gold)"""
)
def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    turns = t.document_turns(spark, sf)
    part = F.when(F.col(CONV) % 5 == 0, "val").otherwise("dev")
    naive = turns.select(CONV, part.alias("part"))
    return sampling.leakage_audit(turns, t.toxic_golden(spark, sf), naive)


@register(
    """SELECT pos, doc_id::VARCHAR AS example_id, lang FROM documents
JOIN (SELECT unnest(range(0, 20)) AS pos, unnest(range(19, -1, -1)) * 7 AS id) p ON documents.doc_id = p.id"""
)
def pilot_subset(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.documents(spark, sf).select(F.col("doc_id").cast("string").alias("example_id"), "lang")
    return sampling.pilot_subset(rows, [str(i * 7) for i in range(19, -1, -1)])


@register(
    f"""WITH {STRATA} SELECT stratum, count(*) AS examples, count(DISTINCT doc_id) AS conversations FROM strata GROUP BY 1
UNION ALL SELECT 'total', count(*), count(DISTINCT doc_id) FROM strata"""
)
def sampling_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.documents(spark, sf).select(
        F.col("doc_id").alias(CONV), tagging.tag_intents("text", t.LANG_HINTS).alias("candidate_intents")
    )
    return sampling.sampling_audit(rows)


# ---------------------------------------------------------------- labels

GOLD = """gold AS (
  SELECT doc_id AS example_id, text AS customer_message, lang AS human_intent,
    CASE WHEN toxic = 1 THEN 'Yes' WHEN quality = 0 THEN 'Maybe' ELSE 'No' END AS human_escalate,
    CASE WHEN quality = 1 THEN 'reviewed' ELSE '' END AS human_reason,
    CASE WHEN n_chars > 3000 THEN ' ok ' END AS annotation_notes
  FROM documents JOIN labels USING (doc_id))"""


def _annotations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as candidates; every label is saved twice, the second time for good."""
    candidates = t.documents(spark, sf).select(
        F.col("doc_id").alias("example_id"), F.array("lang").alias("candidate_intents")
    )
    saved = t.labelled_golden(spark, sf).withColumn("human_escalate", F.col("human_escalate") == "Yes")
    first = saved.withColumn("human_intent", F.lit("other")).withColumn("saved_at", F.lit(1))
    return candidates, first.unionByName(saved.withColumn("saved_at", F.lit(2)))


@register(
    """SELECT d.doc_id AS example_id, CASE WHEN l.doc_id IS NOT NULL THEN lang END AS human_intent,
  CASE WHEN l.doc_id IS NOT NULL THEN toxic = 1 END AS human_escalate, l.doc_id IS NOT NULL AS is_annotated
FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def merged_annotations(spark: SparkSession, sf: str) -> DataFrame:
    rows = labels.merge_annotations(*_annotations(spark, sf))
    return rows.select("example_id", "human_intent", "human_escalate", "is_annotated")


@register(
    """SELECT count(*) AS total, count(l.doc_id) AS completed, count(*) - count(l.doc_id) AS remaining,
  round(count(l.doc_id) * 100.0::DOUBLE / count(*), 6) AS pct, count(*) FILTER (toxic = 1) AS escalate_yes,
  count(*) FILTER (toxic = 0) AS escalate_no FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def annotation_progress(spark: SparkSession, sf: str) -> DataFrame:
    rows = labels.annotation_progress(labels.merge_annotations(*_annotations(spark, sf)))
    return rows.select("total", "completed", "remaining", r6("pct"), "escalate_yes", "escalate_no")


LANG_DIM = f"dim(label) AS (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in t.LANGS)})"


@register(
    f"""WITH {LANG_DIM}, {GOLD} SELECT label AS human_intent, count(g.example_id) AS n
FROM dim LEFT JOIN gold g ON g.human_intent = label GROUP BY 1"""
)
def intent_progress(spark: SparkSession, sf: str) -> DataFrame:
    return labels.intent_progress(labels.merge_annotations(*_annotations(spark, sf)), t.LANGS)


@register(
    f"""WITH {GOLD}, fps AS (SELECT example_id, {q.fingerprint('customer_message')} AS fp FROM gold),
firsts AS (SELECT fp, min(example_id) AS first FROM fps GROUP BY 1)
SELECT 'invalid_intent' AS rule, example_id, human_intent AS detail FROM gold WHERE human_intent NOT IN ('en', 'es')
UNION ALL SELECT 'invalid_escalate', example_id, human_escalate FROM gold WHERE human_escalate = 'Maybe'
UNION ALL SELECT 'duplicate_message', example_id, first::VARCHAR FROM fps JOIN firsts USING (fp) WHERE example_id <> first
UNION ALL SELECT 'row_count', NULL, (SELECT count(*) FROM gold)::VARCHAR WHERE (SELECT count(*) FROM gold) <> 200"""
)
def label_checks(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_violations(t.labelled_golden(spark, sf), 200, ("en", "es"))


@register(
    f"""WITH {GOLD}
SELECT example_id, 'escalate_without_reason' AS warning FROM gold WHERE human_escalate = 'Yes' AND human_reason = ''
UNION ALL SELECT example_id, 'short_notes' FROM gold WHERE length(trim(annotation_notes)) < 5
UNION ALL SELECT example_id, 'other_or_unclear' FROM gold WHERE human_intent = 'de'
UNION ALL SELECT example_id, 'short_message' FROM gold WHERE {q.words('customer_message')} < 3
UNION ALL SELECT example_id, 'long_message' FROM gold WHERE {q.words('customer_message')} > 100"""
)
def label_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_warnings(t.labelled_golden(spark, sf), other="de")


@register(
    f"""WITH {GOLD} SELECT human_intent, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM gold), 6) AS pct
FROM gold GROUP BY 1"""
)
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_distribution(t.labelled_golden(spark, sf)).select("human_intent", "n", r6("pct"))


@register(
    f"""WITH {LANG_DIM}, {GOLD} SELECT label AS human_intent, count(*) FILTER (human_escalate = 'Yes') AS escalate_yes,
  count(g.example_id) FILTER (human_escalate <> 'Yes') AS escalate_no
FROM dim LEFT JOIN gold g ON g.human_intent = label GROUP BY 1"""
)
def label_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_crosstab(t.labelled_golden(spark, sf), t.LANGS)


# ---------------------------------------------------------------- predictions and guardrails


@register(
    f"""WITH {q.TURNS}, {q.OPENINGS},
best AS (SELECT lang FROM documents GROUP BY 1 ORDER BY count(*) DESC, lang LIMIT 1)
SELECT query_id, (SELECT lang FROM best) AS intent, false AS escalate, '{STOCK_REPLY}' AS reply FROM openings"""
)
def majority_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = predict.majority_predict(t.documents(spark, sf), t.openings(spark, sf), "lang")
    return rows.drop("retrieval_similarity")


def _training(spark: SparkSession, sf: str) -> DataFrame:
    return t.documents(spark, sf).select(
        F.col("doc_id").alias("case_id"), F.col("lang").alias("intent"),
        (F.col("n_chars") >= 2000).alias("escalate"), F.col("text").alias("reply"),
    )


VOTES = f"""{q.retrieval(3, 0.0, False)},
votes AS (
  SELECT query_id, rank, similarity, lang AS intent, n_chars >= 2000 AS escalate, text AS reply
  FROM hits JOIN documents ON doc_id = case_id),
win AS (
  SELECT query_id, intent FROM (SELECT query_id, intent, count(*) AS n, min(rank) AS r FROM votes GROUP BY 1, 2) z
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, r) = 1),
near AS (
  SELECT query_id, count(*) FILTER (escalate) AS e, arg_min(reply, rank) AS reply, max(similarity) AS top
  FROM votes GROUP BY 1),
knn AS (
  SELECT query_id, CASE WHEN top < 1.5 THEN 'other_or_unclear' ELSE intent END AS intent,
    CASE WHEN top < 1.5 THEN true ELSE e >= 1.5 END AS escalate,
    CASE WHEN top < 1.5 THEN '{STOCK_REPLY}' ELSE reply END AS reply, top AS retrieval_similarity
  FROM near JOIN win USING (query_id))"""


def _knn(spark: SparkSession, sf: str) -> DataFrame:
    queries, hits = _hits(spark, sf, 3, 0.0, normalize=False)
    return predict.knn_predict(queries, hits, _training(spark, sf), 3, 1.5)


@register(
    f"""WITH {VOTES} SELECT query_id, intent, escalate, reply, round(retrieval_similarity, 6) AS retrieval_similarity FROM knn"""
)
def knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf).select("query_id", "intent", "escalate", "reply", r6("retrieval_similarity"))


@register(
    f"""WITH {q.TURNS}, {q.OPENINGS}
SELECT conversation_id AS case_id, brand_response AS reply,
  CASE WHEN len(tags) = 1 THEN tags[1] ELSE 'other' END AS intent, num_turns >= 5 AS escalate
FROM (SELECT *, {q.tags('customer_message', t.LANG_HINTS)} AS tags FROM cases WHERE customer_message <> '') c"""
)
def silver_cases(spark: SparkSession, sf: str) -> DataFrame:
    return predict.silver_cases(conv.case_base(t.turns(spark, sf)), t.LANG_HINTS, other="other")


DRAFTS = f"""{q.TURNS}, {q.OPENINGS},
drafts AS (
  SELECT conversation_id AS query_id, conversation_id,
    CASE WHEN conversation_id % 11 = 0 THEN 'sales' ELSE 'refund_request' END AS intent,
    CASE WHEN conversation_id % 13 = 0 THEN '' ELSE brand_response || ' I have refunded $'
      || num_turns || '0.50, see https://t.co/Ab' || num_turns END AS reply,
    num_turns >= 6 AS escalate, CASE WHEN num_turns >= 7 THEN 'long thread' END AS escalation_reason,
    lower(brand_response) || ' we paid $' || (num_turns // 2 * 2) || '0.50 see https://t.co/ab5'
      || CASE WHEN num_turns % 2 = 0 THEN ' i have refunded it' ELSE '' END AS evidence,
    brand_response || ' we paid $' || (num_turns // 2 * 2) || '0.50 see https://t.co/Ab5'
      || CASE WHEN num_turns % 2 = 0 THEN ' i have refunded it' ELSE '' END AS backing,
    CASE WHEN conversation_id % 9 = 4 THEN 'Failed to generate JSON' END AS api_error
  FROM cases),
parts AS (
  SELECT *, {q.words('reply')} AS n, regexp_extract_all(reply, '\\$\\d+(?:\\.\\d+)?') AS amounts,
    regexp_extract_all(evidence, '\\$\\d+(?:\\.\\d+)?') AS backed,
    regexp_extract_all(reply, 'https?://[a-zA-Z0-9$-_@.&+!*\\\\(),%]+') AS links FROM drafts),
failed AS (
  SELECT *, list_concat(
    list_filter([CASE WHEN intent = 'sales' THEN 'Invalid intent: sales' END,
      CASE WHEN n = 0 THEN 'Empty reply generated.'
           WHEN n > 150 THEN 'Reply exceeds maximum length (' || n || ' words).' END,
      CASE WHEN escalate AND escalation_reason IS NULL
           THEN 'Escalate set to true but missing escalation reason.' END], lambda x: x IS NOT NULL),
    list_transform(list_filter(amounts, lambda x: NOT list_contains(backed, x)),
      lambda x: 'Unsupported monetary amount generated: ' || x),
    CASE WHEN contains(lower(reply), 'i have refunded') AND NOT contains(evidence, 'i have refunded')
      THEN ['Unsupported claim of completed action: ''i have refunded'''] ELSE [] END,
    list_transform(list_filter(links, lambda x: NOT contains(evidence, lower(x))), lambda x: 'Unsupported URL generated: ' || x)
  ) AS failures FROM parts)"""


def _drafts(spark: SparkSession, sf: str, failed_calls: bool = False) -> DataFrame:
    """Replies with an amount, a link and a claim, and evidence that backs some of them."""
    cases = conv.opening_and_reply(t.turns(spark, sf))
    n, c = F.col("num_turns"), F.col(CONV)
    even = (F.floor(n / 2) * 2).cast("string")
    backing = F.concat(
        F.col("brand_response"), F.lit(" we paid $"), even, F.lit("0.50 see https://t.co/Ab5"),
        F.when(n % 2 == 0, " i have refunded it").otherwise(""),
    )
    reply = F.concat(
        "brand_response", F.lit(" I have refunded $"), n.cast("string"), F.lit("0.50, see https://t.co/Ab"),
        n.cast("string"),
    )
    return cases.select(
        c.cast("string").alias("query_id"),
        F.when(c % 11 == 0, "sales").otherwise("refund_request").alias("intent"),
        F.lit(0.5).alias("intent_confidence"),
        F.when(c % 13 == 0, "").otherwise(reply).alias("reply"),
        (n >= 6).alias("escalate"),
        F.when(n >= 7, "long thread").alias("escalation_reason"),
        F.array(F.struct(backing.alias("brand_response"))).alias("evidence"),
        F.when(F.lit(failed_calls) & (c % 9 == 4), "Failed to generate JSON").alias("api_error"),
    )


@register(f"WITH {DRAFTS} SELECT query_id::VARCHAR AS query_id, array_to_string(failures, '; ') AS failures FROM failed")
def guardrail_failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = _drafts(spark, sf).withColumn("failures", predict.grounding_failures(predict.evidence_text()))
    return rows.select("query_id", F.array_join("failures", "; ").alias("failures"))


@register(
    f"""WITH {DRAFTS}
SELECT query_id::VARCHAR AS query_id, intent, 0.5::DOUBLE AS intent_confidence,
  len(failures) > 0 AND api_error IS NULL AS unsafe, CASE WHEN unsafe THEN true ELSE escalate END AS escalate,
  CASE WHEN unsafe THEN concat_ws(' | ', escalation_reason,
    'Grounding Validation Failures: ' || array_to_string(failures, ', ')) ELSE escalation_reason END AS escalation_reason,
  CASE WHEN unsafe THEN 'Please wait while I connect you to a human agent to resolve this securely.'
    ELSE reply END AS reply,
  CASE WHEN unsafe THEN reply END AS original_draft, backing AS evidence,
  CASE WHEN api_error IS NOT NULL THEN 'LLM Error' ELSE array_to_string(failures, ';') END AS validation_failures, api_error FROM failed"""
)
def safety_override(spark: SparkSession, sf: str) -> DataFrame:
    rows = predict.apply_safety(_drafts(spark, sf, failed_calls=True))
    evidence = F.array_join(F.transform("evidence", lambda e: e["brand_response"]), ";").alias("evidence")
    unsafe = F.col("original_draft").isNotNull().alias("unsafe")
    return rows.select(
        "query_id", "intent", "intent_confidence", unsafe, "escalate", "escalation_reason", "reply", "original_draft", evidence,
        F.array_join("validation_failures", ";").alias("validation_failures"), "api_error",
    )


@register(
    f"""WITH {BANDS},
ev AS (
  SELECT query_id, string_agg('[' || rank || '] (sim=' || printf('%.2f', similarity) || ') Q: ' || left(d.text, 200)
    || chr(10) || 'A: ' || left(d.source, 200) || chr(10), '' ORDER BY rank) AS e
  FROM hits JOIN documents d ON doc_id = case_id GROUP BY 1)
SELECT query_id, 'CUSTOMER MESSAGE:' || chr(10) || text || chr(10) || chr(10)
  || 'CONVERSATION CONTEXT:' || chr(10) || '- CUSTOMER: ' || text || chr(10) || chr(10)
  || 'RETRIEVAL CONFIDENCE: ' || confidence || chr(10) || chr(10) || 'EVIDENCE:' || chr(10)
  || coalesce(e, 'None.' || chr(10)) AS prompt
FROM openings JOIN bands USING (query_id) LEFT JOIN ev USING (query_id)"""
)
def prompt_text(spark: SparkSession, sf: str) -> DataFrame:
    return _prompts(spark, sf).select("query_id", "prompt")


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    queries, hits = _hits(spark, sf, 2, 0.25)
    hits = cut_lineage(hits)
    cases = t.documents(spark, sf).select(
        F.col("doc_id").alias("case_id"), F.col("text").alias("customer_message"), F.col("source").alias("brand_response")
    )
    rows = (
        queries.withColumnRenamed("text", "customer_message")
        .join(retrieval.retrieval_bands(queries, hits), "query_id")
        .join(retrieval.evidence_pack(hits, cases), "query_id", "left")
    )
    context = F.array(
        F.struct(F.lit("customer").alias("speaker"), F.col("customer_message").alias("text"))
    )
    return rows.withColumn("context", context).withColumn("prompt", predict.prompt_text())


@register(
    f"""WITH {q.TURNS}, {q.OPENINGS}
SELECT query_id::VARCHAR AS query_id, 'other_or_unclear' AS intent, CASE WHEN odd THEN 0.0 ELSE 0.5 END::DOUBLE AS intent_confidence,
  CASE WHEN odd THEN '{predict.OUTAGE_REPLY.replace("'", "''")}' ELSE left(text, 40) END AS reply, odd OR length(text) % 4 = 0 AS escalate,
  CASE WHEN odd THEN 'LLM Generation/Parsing Error: odd length' WHEN length(text) % 4 = 0 THEN 'long' END AS escalation_reason,
  CASE WHEN odd THEN 'odd length' END AS api_error FROM (SELECT *, length(text) % 2 = 1 AS odd FROM openings) o"""
)
def drafted_replies(spark: SparkSession, sf: str) -> DataFrame:
    def drafter(prompt: str) -> dict:
        if len(prompt) % 2:
            raise ValueError("odd length")
        some = {"intent": "other_or_unclear", "intent_confidence": 0.5, "reply": prompt[:40], "escalate": len(prompt) % 4 == 0}
        return some | ({"escalation_reason": "long"} if some["escalate"] else {})

    return predict.draft(t.openings(spark, sf).withColumnRenamed("text", "prompt"), drafter)


# ---------------------------------------------------------------- evaluation

PREDS = f"""preds AS (
  SELECT doc_id AS example_id, lang AS true_intent, toxic = 1 AS true_esc, n_chars >= 2000 AS predicted_escalate,
    CASE WHEN len(tags) = 1 THEN tags[1] ELSE 'other' END AS predicted_intent,
    (n_chars % 100) / 100.0::DOUBLE AS sim, text, quality, n_chars,
    CASE WHEN doc_id % 19 = 0 THEN 'Error 429: rate limit reached' WHEN doc_id % 23 = 0
      THEN 'Failed to generate JSON' END AS api_error
  FROM (SELECT *, {q.tags('text', t.LANG_HINTS)} AS tags FROM documents) d JOIN labels USING (doc_id)),
ok AS (SELECT * FROM preds WHERE api_error IS NULL),
{LANG_DIM},
per AS (
  SELECT label, count(*) FILTER (true_intent = label AND predicted_intent = label) AS tp,
    count(*) FILTER (true_intent <> label AND predicted_intent = label) AS fp,
    count(*) FILTER (true_intent = label AND predicted_intent <> label) AS fn FROM dim CROSS JOIN ok GROUP BY 1),
pr AS (SELECT label, {q.ratio('tp', 'tp + fp')} AS p, {q.ratio('tp', 'tp + fn')} AS r, tp + fn AS support FROM per),
cm AS (SELECT label, p, r, {q.ratio('2.0 * p * r', 'p + r')} AS f1, support FROM pr),
bin AS (
  SELECT count(*) FILTER (true_esc AND predicted_escalate) AS tp,
    count(*) FILTER (NOT true_esc AND NOT predicted_escalate) AS tn,
    count(*) FILTER (NOT true_esc AND predicted_escalate) AS fp,
    count(*) FILTER (true_esc AND NOT predicted_escalate) AS fn FROM ok),
fails AS (
  SELECT example_id, unnest(list_filter([
    CASE WHEN predicted_intent = 'other' THEN 'intent' END,
    CASE WHEN {q.words('text')} > 150 THEN 'length' END,
    CASE WHEN predicted_escalate AND quality <> 1 THEN 'reason' END], lambda x: x IS NOT NULL)) AS kind FROM ok
  UNION ALL SELECT example_id, 'amount' FROM (SELECT example_id, unnest(regexp_extract_all(text, '\\$\\d+(?:\\.\\d+)?')) FROM ok) a
  UNION ALL SELECT example_id, 'url' FROM (SELECT example_id, unnest(regexp_extract_all(text,
    'https?://[a-zA-Z0-9$-_@.&+!*\\\\(),%]+')) AS u FROM ok) b WHERE NOT contains(lower(u), 'amazon'))"""


def _ok(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.successful(t.predictions(spark, sf))


@register(
    f"""WITH {PREDS} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM cm"""
)
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.class_metrics(_ok(spark, sf), t.LANGS)
    return rows.select("label", r6("precision"), r6("recall"), r6("f1"), "support")


@register(
    f"""WITH {PREDS} SELECT (SELECT count(*) FROM ok) AS n,
  round((SELECT count(*) FILTER (true_intent = predicted_intent)::DOUBLE / count(*) FROM ok), 6) AS accuracy,
  round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM cm"""
)
def overall_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.overall_metrics(_ok(spark, sf), t.LANGS)
    return rows.select("n", r6("accuracy"), r6("macro_f1"), r6("weighted_f1"))


BIN_COLS = f"""tp, tn, fp, fn, round({q.ratio('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy,
  round({q.ratio('tp', 'tp + fp')}, 6) AS precision, round({q.ratio('tp', 'tp + fn')}, 6) AS recall,
  round({q.ratio('2.0 * tp', '2.0 * tp + fp + fn')}, 6) AS f1, round({q.ratio('fp', 'fp + tn')}, 6) AS fpr,
  round({q.ratio('fn', 'fn + tp')}, 6) AS fnr"""


@register(f"WITH {PREDS} SELECT {BIN_COLS} FROM bin")
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.binary_metrics(_ok(spark, sf))
    rates = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")
    return rows.select("tp", "tn", "fp", "fn", *[r6(c) for c in rates])


@register(
    f"""WITH {PREDS} SELECT count(*) AS predictions, count(api_error) AS api_errors,
  count(*) - count(api_error) AS evaluated, (SELECT count(DISTINCT example_id) FROM fails) AS guardrail_overrides FROM preds"""
)
def error_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.error_counts(t.predictions(spark, sf))


@register(
    f"""WITH {PREDS}, cdim(retrieval_confidence) AS (VALUES ('strong'), ('moderate'), ('weak')),
c AS (SELECT CASE WHEN sim >= 0.75 THEN 'strong' WHEN sim >= 0.55 THEN 'moderate' ELSE 'weak' END AS retrieval_confidence FROM ok)
SELECT retrieval_confidence, count(*) AS n FROM cdim JOIN c USING (retrieval_confidence) GROUP BY 1"""
)
def confidence_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confidence_distribution(t.predictions(spark, sf))


@register(
    f"""WITH {PREDS} SELECT true_intent AS true_label, predicted_intent AS pred_label, count(*) AS n FROM ok
WHERE true_intent <> predicted_intent GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20"""
)
def confusion_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion_pairs(_ok(spark, sf))


@register(
    f"""WITH {PREDS}, k AS (
  SELECT *, example_id IN (SELECT example_id FROM fails) AS failed FROM ok),
u AS (
  SELECT example_id, true_intent, predicted_intent, 'success' AS kind FROM k WHERE true_intent = predicted_intent AND NOT failed
  UNION ALL SELECT example_id, true_intent, predicted_intent, 'intent_failure' FROM k WHERE true_intent <> predicted_intent
  UNION ALL SELECT example_id, true_intent, predicted_intent, 'missed_escalation' FROM k WHERE true_esc AND NOT predicted_escalate
  UNION ALL SELECT example_id, true_intent, predicted_intent, 'guardrail_failure' FROM k WHERE failed)
SELECT example_id, true_intent, predicted_intent, kind, row_number() OVER (PARTITION BY kind ORDER BY example_id) AS nth FROM u
QUALIFY nth <= 3"""
)
def example_pulls(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.example_pulls(t.predictions(spark, sf))


def _systems_sql() -> str:
    rows = """sys AS (
  SELECT 'keywords' AS system, true_intent, predicted_intent, true_esc, predicted_escalate FROM ok
  UNION ALL SELECT 'majority', true_intent, (SELECT lang FROM documents GROUP BY 1 ORDER BY count(*) DESC, lang LIMIT 1),
    true_esc, false FROM ok)"""
    return f"""WITH {PREDS}, {rows},
sper AS (
  SELECT system, label, count(*) FILTER (true_intent = label AND predicted_intent = label) AS tp,
    count(*) FILTER (true_intent <> label AND predicted_intent = label) AS fp,
    count(*) FILTER (true_intent = label AND predicted_intent <> label) AS fn FROM dim CROSS JOIN sys GROUP BY 1, 2),
sf1 AS (SELECT system, {q.ratio('2.0 * tp', '2.0 * tp + fp + fn')} AS f1, tp + fn AS support FROM sper),
sm AS (SELECT system, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM sf1 GROUP BY 1),
sb AS (
  SELECT system, count(*) AS n, count(*) FILTER (true_intent = predicted_intent)::DOUBLE / count(*) AS accuracy,
    count(*) FILTER (true_esc AND predicted_escalate) AS tp, count(*) FILTER (NOT true_esc AND predicted_escalate) AS fp,
    count(*) FILTER (true_esc AND NOT predicted_escalate) AS fn FROM sys GROUP BY 1)
SELECT system, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1,
  round({q.ratio('tp', 'tp + fp')}, 6) AS esc_precision, round({q.ratio('tp', 'tp + fn')}, 6) AS esc_recall,
  round({q.ratio('2.0 * tp', '2.0 * tp + fp + fn')}, 6) AS esc_f1 FROM sb JOIN sm USING (system)"""


@register(_systems_sql())
def system_compare(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("system", "true_intent", "predicted_intent", "true_esc", "predicted_escalate")
    own = _ok(spark, sf).withColumn("system", F.lit("keywords")).select(*cols)
    best = predict.majority_label(t.documents(spark, sf), "lang").select("lang").scalar()
    plain = own.withColumns(
        {"system": F.lit("majority"), "predicted_intent": best, "predicted_escalate": F.lit(False)}
    )
    rows = evaluate.system_compare(own.unionByName(plain.select(*cols)), t.LANGS)
    rates = ("accuracy", "macro_f1", "weighted_f1", "esc_precision", "esc_recall", "esc_f1")
    return rows.select("system", "n", *[r6(c) for c in rates])


@register(
    f"""WITH {PREDS} SELECT count(*) AS n, count(*) FILTER (sim < 0.1) AS below_threshold,
  round(count(*) FILTER (sim < 0.1) * 100.0::DOUBLE / count(*), 6) AS below_pct,
  count(*) FILTER (true_intent <> predicted_intent) AS wrong_intent,
  round(count(*) FILTER (true_intent <> predicted_intent) * 100.0::DOUBLE / count(*), 6) AS wrong_pct FROM ok"""
)
def retrieval_error_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.retrieval_error_rates(_ok(spark, sf))
    return rows.select("n", "below_threshold", r6("below_pct"), "wrong_intent", r6("wrong_pct"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "labels")
    return rows.select(
        F.col("doc_id").alias("example_id"),
        F.struct(
            (F.col("doc_id") % 5 + 1).cast("int").alias("empathy_score"),
            F.when(F.col("quality") == 1, "Pass").otherwise("Fail").alias("evidence_correctness"),
            F.when(F.col("toxic") == 1, "pass").otherwise("Pass").alias("safety_adherence"),
            F.lit("").alias("reasoning"),
        ).alias("evaluation"),
    )


@register(
    """SELECT count(*) AS n, round(avg(doc_id % 5 + 1), 6) AS avg_empathy, count(*) FILTER (quality = 1) AS evidence_pass,
  round(count(*) FILTER (quality = 1) * 100.0::DOUBLE / count(*), 6) AS evidence_pass_pct,
  count(*) FILTER (toxic = 0) AS safety_pass,
  round(count(*) FILTER (toxic = 0) * 100.0::DOUBLE / count(*), 6) AS safety_pass_pct FROM labels"""
)
def judge_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.judge_summary(_judged(spark, sf))
    return rows.select(
        "n", r6("avg_empathy"), "evidence_pass", r6("evidence_pass_pct"), "safety_pass", r6("safety_pass_pct")
    )


@register(
    f"""WITH {PREDS} SELECT example_id, '{evaluate.REVIEW_REQUEST}Customer intent: ' || predicted_intent || chr(10) || 'Evidence:' || chr(10)
  || CASE WHEN quality = 1 THEN '- ' || text ELSE 'None' END || chr(10) || chr(10) || 'Reply:' || chr(10)
  || text || chr(10) || chr(10) || 'Escalated: ' || predicted_escalate || chr(10) || 'Reason: None' || chr(10) AS request
FROM ok"""
)
def judge_requests(spark: SparkSession, sf: str) -> DataFrame:
    known = F.array(F.struct(F.col("reply").alias("reason")))
    none = F.array().cast("array<struct<reason:string>>")
    rows = _ok(spark, sf).withColumns(
        {
            "evidence": F.when(F.col("escalation_reason") != "", known).otherwise(none),
            "predicted_reply": F.col("reply"),
            "predicted_escalation_reason": F.lit(None).cast("string"),
        }
    )
    return rows.select("example_id", evaluate.judge_prompt().alias("request"))


@register(
    f"""WITH {PREDS} SELECT (SELECT count(*) FROM documents) AS golden,
  count(*) FILTER (api_error IS NULL OR NOT contains(api_error, '429')) AS predicted,
  count(*) FILTER (contains(api_error, '429')) AS rate_limited, false AS is_complete FROM preds"""
)
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    golden = t.documents(spark, sf).select(F.col("doc_id").alias("example_id"))
    return evaluate.completeness(t.predictions(spark, sf), golden)


@register(
    """SELECT count(*) AS examples, sum(ceil(length(text) / 4.0) + 1100)::BIGINT AS total_tokens,
  round(avg(ceil(length(text) / 4.0) + 1100), 6) AS tokens_per_example,
  floor(200000 / avg(ceil(length(text) / 4.0) + 1100))::BIGINT AS examples_per_day,
  ceil(sum(ceil(length(text) / 4.0) + 1100) / 200000.0)::BIGINT AS days_needed,
  sum(ceil(length(text) / 4.0) + 1100) <= 200000 AS fits_in_a_day FROM documents"""
)
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.token_budget(t.documents(spark, sf), "text", overhead=900, output=200)
    return rows.withColumn("tokens_per_example", F.round("tokens_per_example", 6))


@register(
    f"""WITH {PREDS} SELECT 'guardrail' AS source, kind, count(*) AS n FROM fails GROUP BY 2
UNION ALL SELECT 'api', CASE WHEN contains(api_error, '429') THEN 'rate_limit' ELSE 'invalid_json' END, count(*)
FROM preds WHERE api_error IS NOT NULL GROUP BY 2"""
)
def failure_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.failure_breakdown(t.predictions(spark, sf))


@register(
    f"""WITH {PREDS} SELECT predicted_intent AS pred_label, count(*) AS n, predicted_intent = 'en' AS is_correct
FROM ok WHERE true_intent = 'en' GROUP BY 1"""
)
def class_drilldown(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.class_drilldown(_ok(spark, sf), "en")


@register(
    f"""WITH {PREDS} SELECT doc_id AS example_id FROM documents WHERE doc_id NOT IN
  (SELECT example_id FROM preds WHERE api_error IS NULL OR NOT contains(api_error, '429'))"""
)
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    inputs = t.documents(spark, sf).select(F.col("doc_id").alias("example_id"))
    return pending(inputs, storable(t.predictions(spark, sf)))


@register(
    f"""WITH {PREDS} SELECT example_id, true_intent, 2 AS run_at FROM preds"""
)
def latest_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.predictions(spark, sf).select("example_id", "true_intent")
    old = rows.withColumns({"true_intent": F.lit("stale"), "run_at": F.lit(1)})
    return evaluate.latest_predictions(old.unionByName(rows.withColumn("run_at", F.lit(2))))


@register(
    f"""WITH {CLUSTERED}, {concept_cte('documents')}
SELECT 'keywords' AS run, (SELECT count(*) FROM msgs) AS sample_size, {K} AS clusters, (SELECT count(*) FROM asg) AS clustered,
  100.0::DOUBLE AS unclear_pct"""
)
def clustering_compare(spark: SparkSession, sf: str) -> DataFrame:
    docs, v, asg = _clustered(spark, sf)
    runs = cluster.cluster_summary(docs, v, asg, K).select(
        F.lit("keywords").alias("run"), "num_examples", "likely_intent_name",
        docs.agg(F.count("*")).scalar().alias("sample_size"),
    )
    return evaluate.clustering_compare(runs)
