"""Reply graph, thread building and brand statistics."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions.ordering import number_in_group
from threadloom.functions.parsing import flag_true, safe_long, tweet_ts
from threadloom.operators import brands, conversations as conv, graph

RAW = (
    "tweet_id string, author_id string, inbound string, created_at string, text string, "
    "response_tweet_id string, in_response_to_tweet_id string"
)
DAY = "Mon Oct 30 10:{:02d}:00 +0000 2017"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def tweet(i, author, minute, parent="", answers="", text="hi", stamp=None):
    inbound = "False" if author.lower().startswith("acme") else "True"
    return (str(i), author, inbound, stamp or DAY.format(minute), text, answers, str(parent))


def build(spark, rows, brand=("AcmeHelp",)):
    table = raw(spark, rows)
    typed = conv.type_tweets(table)
    comps = graph.connected_components(graph.reply_edges(table))
    placed = typed.join(graph.thread_of_tweets(typed, comps), "tweet_id")
    return placed.withColumn("conversation_id", F.concat(F.lit("conv_"), "thread")).withColumn(
        "speaker", conv.speaker("author_id", brand)
    )


def threads(spark, rows):
    return {r["tweet_id"]: r["thread"] for r in build(spark, rows).collect()}


def closure(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_parsing(spark):
    values = ["12", " 7 ", "-3", "2,3", "4.5", "", "x", None]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(safe_long("v")).collect()
    assert [r[0] for r in got] == [12, 7, -3, None, None, None, None, None]
    dates = ["Tue Oct 31 22:10:47 +0000 2017", "Tue Oct 31 22:10:47 +0200 2017", "bad", "", None]
    got = (
        spark.createDataFrame([(v,) for v in dates], "v string")
        .select(F.unix_seconds(tweet_ts("v")).alias("s"))
        .collect()
    )
    assert [r["s"] for r in got] == [1509487847, 1509480647, None, None, None]
    flags = spark.createDataFrame([(v,) for v in ("True", "1", "yes", "no", "", None)], "v string")
    assert [r[0] for r in flags.select(flag_true("v")).collect()] == [True, True, True, False, False, False]


def test_chain_branch_and_strangers(spark):
    got = threads(
        spark,
        [
            tweet(1, "u1", 0), tweet(2, "AcmeHelp", 1, 1), tweet(3, "u1", 2, 2), tweet(4, "AcmeHelp", 3, 3),
            tweet(10, "u2", 0), tweet(11, "AcmeHelp", 1, 10), tweet(12, "AcmeHelp", 2, 10), tweet(20, "u3", 0),
        ],
    )
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20}


def test_missing_post_joins_its_answers_and_names_nothing(spark):
    assert threads(spark, [tweet(5, "u1", 0, 1), tweet(6, "u2", 1, 1)]) == {5: 5, 6: 5}


def test_reference_lists_are_skipped_or_split(spark):
    table = raw(spark, [tweet(1, "u1", 0, "", "2,3"), tweet(2, "u2", 1), tweet(3, "u3", 1)])
    assert graph.reply_edges(table).count() == 0
    assert {tuple(r) for r in graph.reply_edges(table, split_multi=True).collect()} == {(1, 2), (1, 3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_closure(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(448)]  # a long chain
    edges += [(5000, 5001 + i) for i in range(300)]  # a hub
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == closure(edges)


def test_latest_row_of_an_id_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "tweet_id long, text string, at int")
    rows = graph.latest_per_id(df, "tweet_id", "at").collect()
    assert {(r["tweet_id"], r["text"]) for r in rows} == {(1, "b"), (2, "c")}


def test_three_turn_thread(spark):
    rows = [tweet(10, "user1", 0, "", "11"), tweet(11, "AcmeHelp", 5, 10, "12"), tweet(12, "user1", 10, 11)]
    turns = build(spark, rows, ("acmehelp",))
    c = conv.build_conversations(turns).collect()[0]
    assert (c["num_turns"], c["brand_responded"], c["is_multi_turn"]) == (3, True, True)
    assert c["suitable_for_resolution"] and not c["is_flagged"] and c["customer_message_count"] == 2
    assert (c["customer_author"], c["brand_author"]) == ("user1", "AcmeHelp")
    assert (c["start_time"], c["end_time"]) == (DAY.format(0), DAY.format(10))
    order = conv.number_turns(turns).orderBy("turn_number").collect()
    assert [r["speaker"] for r in order] == ["customer", "brand", "customer"]


def test_order_ties_and_broken_dates(spark):
    rows = [
        tweet(3, "u", 5), tweet(2, "u", 5, 3), tweet(9, "u", 0, 3, stamp="never"), tweet(4, "u", 1, 3),
    ]
    turns = conv.number_turns(build(spark, rows))
    assert [r["tweet_id"] for r in turns.orderBy("turn_number").collect()] == [4, 2, 3, 9]
    c = conv.build_conversations(turns).collect()[0]
    assert c["flag_reason"] == "1/4 unparseable timestamps" and not c["brand_responded"]
    assert c["start_time"] == DAY.format(1) and c["end_time"] == "never" and c["brand_author"] == ""


def test_missing_parent_is_flagged_and_other_brand_is_customer(spark):
    rows = [tweet(1, "u", 0, 999), tweet(2, "AcmeHelp", 1, 1), tweet(3, "OtherBrand", 2, 2)]
    turns = build(spark, rows)
    c = conv.build_conversations(turns).collect()[0]
    assert c["flag_reason"] == "1 referenced tweet(s) outside conversation"
    assert not c["suitable_for_resolution"] and c["customer_message_count"] == 2
    assert conv.structural_flags(turns).collect()[0]["flag_reason"] == c["flag_reason"]


def test_adjacency_needs_customer_before_brand(spark):
    rows = [tweet(1, "AcmeHelp", 0), tweet(2, "AcmeHelp", 1, 1), tweet(3, "u", 2, 2)]
    assert not conv.build_conversations(build(spark, rows)).collect()[0]["suitable_for_resolution"]


def test_opening_and_reply_also_when_the_brand_speaks_first(spark):
    rows = [
        (1, 1, "brand", "b0"), (1, 2, "customer", "c1"), (1, 3, "brand", "b1"), (1, 4, "brand", "b2"),
        (2, 1, "customer", "c1"), (2, 2, "customer", "c2"), (2, 3, "brand", "b1"),
        (3, 1, "brand", "b0"), (3, 2, "customer", "c1"), (4, 1, "brand", "b0"), (5, 1, "customer", "c1"),
    ]
    turns = spark.createDataFrame(rows, "conversation_id long, turn_number int, speaker string, text string")
    got = {r["conversation_id"]: (r["customer_message"], r["brand_response"]) for r in conv.opening_and_reply(turns).collect()}
    assert got == {1: ("c1", "b1"), 2: ("c1", "b1"), 3: ("c1", ""), 5: ("c1", "")}


def test_long_conversations_go_on_in_further_rows(spark):
    turns = conv.number_turns(build(spark, [tweet(i, "u", i, i - 1 if i > 1 else "") for i in range(1, 8)]))
    rows = conv.nest_turns(turns, max_turns_per_row=3).orderBy("part").collect()
    assert [len(r["turns"]) for r in rows] == [3, 3, 1]
    assert [t["turn_number"] for r in rows for t in r["turns"]] == list(range(1, 8))


def test_numbering_of_a_huge_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50 + 1).alias("g"),
        F.when(F.col("id") % 5 != 0, (F.col("id") * 7919) % 1000).alias("v"), "id",
    )
    order = [F.col("v").asc_nulls_last(), F.col("id")]
    plain = {(r["id"], r["n"]) for r in number_in_group(df, ["g"], order, "n").collect()}
    hot = {(r["id"], r["n"]) for r in number_in_group(df, ["g"], order, "n", hot_rows=500).collect()}
    assert plain == hot


def test_dedup_by_tweet_set(spark):
    rows = [("a", 1, 5), ("a", 2, 5), ("b", 2, 1), ("b", 1, 1), ("c", 1, 0)]
    df = spark.createDataFrame(rows, "conversation_id string, tweet_id long, at int")
    assert {r[0] for r in conv.dedup_conversations(df, "at").collect()} == {"b", "c"}


def test_summary_and_histogram(spark):
    rows = [tweet(10, "user1", 0), tweet(11, "AcmeHelp", 5, 10), tweet(12, "user1", 10, 11), tweet(20, "u2", 0)]
    convs = conv.build_conversations(build(spark, rows))
    s = conv.conversation_summary(convs).collect()[0]
    assert (s["total"], s["multi_turn"], s["median_turns"], s["unique_customers"], s["brand_accounts"]) == (2, 1, 2.0, 2, 1)
    hist = {r["length_bucket"]: r["conversations"] for r in conv.length_histogram(convs).collect()}
    assert hist == {"1 turn": 1, "2 turns": 0, "3-5 turns": 1, "6-10 turns": 0, "11-20 turns": 0, "21+ turns": 0}


def test_brand_statistics(spark):
    rows = [
        tweet(1, "u1", 0, text="@AcmeHelp broken"), tweet(2, "AcmeHelp", 1, 1), tweet(3, "u1", 2, 2),
        tweet(4, "u2", 0, text="dear @acmeHELP and @AcmeAir"), tweet(5, "u3", 0, text="@nobody"),
        tweet(6, "u2", 0), tweet(7, "AcmeAir", 1, 6),
    ]
    tweets = build(spark, rows)
    stats = {r["brand"]: r for r in brands.score_brands(brands.brand_stats(tweets)).collect()}
    a = stats["AcmeHelp"]
    assert (a["conversation_count"], a["complete_conversations"], a["multi_turn_conversations"]) == (2, 1, 1)
    assert (a["inbound_tweets"], a["outbound_tweets"], a["total_tweets"], a["unique_customers"]) == (3, 1, 4, 2)
    assert (a["avg_conversation_length"], a["response_rate"], a["conversation_links"]) == (2.0, 0.5, 2)
    assert a["quality_score"] == pytest.approx(0.35 + 0.25 + 0.1 + 0.1 + 0.02)
    assert stats["AcmeAir"]["multi_turn_conversations"] == 0
    ranked = brands.rank_brands(brands.score_brands(brands.brand_stats(tweets)))
    assert [r["brand"] for r in ranked.orderBy("rank").collect()] == ["AcmeHelp", "AcmeAir"]
    assert brands.recommend_brands(ranked).orderBy("rank").collect()[0]["reasons"] == ["response_rate"]
    assert {r["verdict"] for r in brands.brand_verdicts(brands.brand_stats(tweets)).collect()} == {"Marginal"}


def test_near_replies_settle_without_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, real=graph.cut_lineage: cuts.append(1) or real(df))
    # Chains of 400 messages; before, each doubling of a chain took a round of two checkpoints.
    edges = spark.range(4000).where("id % 400 <> 0").selectExpr("id as src", "id - 1 as dst")
    got = {r["id"]: r["component"] for r in graph.connected_components(edges.coalesce(1)).collect()}
    assert got == {i: i // 400 * 400 for i in range(4000)}
    assert len(cuts) <= 5


def test_edges_of_a_task_are_contracted(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(2)
    ends = [(rnd.randint(-50, 300), rnd.randint(-50, 300)) for _ in range(180)]
    ends = [(max(e), min(e)) for e in ends if e[0] != e[1]]
    batch = pa.RecordBatch.from_arrays([pa.array([u for u, _ in ends]), pa.array([v for _, v in ends])], ["u", "v"])
    least = {x: x for e in ends for x in e}
    while any(least[u] != least[v] for u, v in ends):
        for u, v in ends:
            least[u] = least[v] = min(least[u], least[v])
    got = {r["u"]: r["v"] for b in graph.contract(iter([batch.slice(0, 70), batch.slice(70)])) for r in b.to_pylist()}
    assert got == {x: m for x, m in least.items() if x != m}
    monkeypatch.setattr(graph, "RUN_EDGES", 50)
    rows = [r for b in graph.contract(iter([batch.slice(0, 70), batch.slice(70)])) for r in b.to_pylist()]
    assert all(least[r["u"]] == least[r["v"]] for r in rows) and {r["u"] for r in rows} | {r["v"] for r in rows} == set(least)


def test_edges_read_tweets_once_and_brand_queries_store_no_text(spark, monkeypatch):
    from threadloom.plans import catalog, tables

    sf = "/root/testdata/sf0.001"
    null = spark.createDataFrame([("1", None, "2"), ("3", "4,5", None), ("6", None, None)], "tweet_id string, response_tweet_id string, in_response_to_tweet_id string")
    for split in (False, True):
        plan = graph.reply_edges(null, split)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan ExistingRDD") == 1
    assert {tuple(r) for r in graph.reply_edges(null).collect()} == {(1, 2)}
    assert {tuple(r) for r in graph.reply_edges(null, True).collect()} == {(1, 2), (3, 4), (3, 5)}

    stored = []
    monkeypatch.setattr(tables, "cut_lineage", lambda df, real=tables.cut_lineage: stored.append(df) or real(df))
    longest = tables.raw_tweets(spark, sf).selectExpr("max(length(text))").first()[0]
    for name in ("brand_conversations", "brand_verdicts", "brand_attribution"):
        catalog.QUERIES[name](spark, sf)
        kept = stored.pop()
        most = kept.selectExpr("max(length(text))").first()[0] if "text" in kept.columns else 0
        assert most < 10 < longest and "response_tweet_id" not in kept.columns


def test_golden_candidates_number_turns_without_texts(spark, monkeypatch, tmp_path):
    from threadloom.operators import conversations as conv
    from threadloom.plans import catalog, tables

    sf = "/root/testdata/sf0.001"
    stored = []
    monkeypatch.setattr(tables, "cut_lineage", lambda df, real=tables.cut_lineage: stored.append(df) or real(df))
    catalog.QUERIES["golden_candidates"](spark, sf)
    assert stored and not any("text" in df.columns for df in stored)

    # A conversation that is there twice has two rows of each id.
    table = tables.table(spark, sf, "conversations")
    table.unionByName(table.where("conv_id % 5 = 2")).write.parquet(f"{tmp_path}/conversations.parquet")
    for path in (sf, str(tmp_path)):
        got = tables.numbered_brand_turns(spark, path)
        want = conv.number_turns(tables.brand_turns(spark, path))
        columns = [conv.CONV, "turn_number", "tweet_id", "author_id", "created_at", "text", "speaker"]
        rows = [sorted(map(tuple, df.select(*columns).collect())) for df in (got, want)]
        assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("few", [0, 3, 200_000])
def test_components_that_are_stars_go_through_no_rounds(spark, monkeypatch, few):
    sizes = []

    def starred(pairs, real=graph._large_star):
        sizes.append(pairs.count())
        return real(pairs)

    monkeypatch.setattr(graph, "_large_star", starred)
    monkeypatch.setattr(graph, "FEW_IDS", few, raising=False)
    # Strings are not contracted first, so what isn't a star of ten goes through rounds.
    edges = [(i, i // 10 * 10) for i in range(1, 4000) if i % 10] + [(3999, 5), (3000, 1005), (3000, 2001)]
    edges = [(f"{a:04d}", f"{b:04d}") for a, b in edges]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r["id"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == closure(edges)
    assert sizes and (few < 200_000 or max(sizes) < len(edges) / 4)
