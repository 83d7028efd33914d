"""Text cleaning, vectors, retrieval and clustering."""

import math
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.lexicons import PRAISE_WORDS_SHORT, STOP_WORDS
from threadloom.functions.ordering import hash_rank, quantiles, take_by_hash
from threadloom.operators import cluster, retrieval, vectors


def one(spark, value, *exprs):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*exprs).collect()[0])


@pytest.mark.parametrize("text", ["", "Hi", "Thanks Shop!", "https://t.co/123456789012345", "@shop http://t.co/abcdefghij"])
def test_noise_is_not_a_message(spark, text):
    assert one(spark, text, tx.is_valid_message("t")) == (False,)


def test_support_message_filters(spark):
    assert one(spark, "Where is my package? It was supposed to be here yesterday.", tx.is_valid_message("t")) == (True,)
    keep = tx.is_support_message("t")
    assert one(spark, "Thank you so much for the great help!", keep) == (False,)
    assert one(spark, "Thanks but my package is still not here", keep) == (True,)
    assert one(spark, "big kudos to all of you folks", keep, tx.is_support_message("t", PRAISE_WORDS_SHORT)) == (False, True)


def test_tokenize(spark):
    text = "Hello @AmazonHelp! My package (123) is late. http://link.com"
    assert one(spark, text, tx.tokenize("t")) == (["package", "late"],)
    df = spark.createDataFrame([(1, text), (2, "can't été ١٢ straße straße")], "doc_id long, text string")
    rows = {(r["doc_id"], r["term"]) for r in tx.token_rows(df, "doc_id", "text").collect()}
    assert rows == {(1, "package"), (1, "late"), (2, "cant"), (2, "été"), (2, "straße")}
    assert len(STOP_WORDS) == len(set(STOP_WORDS))


def test_fingerprint_word_count_mention(spark):
    assert one(spark, "@AmazonHelp Hello! http://link.com", tx.fingerprint("t")) == ("hello",)
    assert one(spark, " a b\n\tc ", tx.word_count("t")) == (3,)
    assert one(spark, "", tx.word_count("t")) == (0,)
    assert one(spark, "see @Ümit_9, @x", tx.first_mention("t")) == ("ümit_9",)
    assert one(spark, "none", tx.first_mention("t")) == (None,)


def test_first_copy_of_a_message_is_kept(spark):
    rows = [
        (1, 1, "customer", "My Package is  late today"), (1, 2, "customer", "my package is late today "),
        (2, 1, "brand", "we are sorry for this delay"), (2, 2, "customer", "a different question here"),
    ]
    df = spark.createDataFrame(rows, "conversation_id long, turn_number int, speaker string, text string")
    got = tx.distinct_messages(df, tx.is_valid_message("text")).collect()
    assert {(r["conversation_id"], r["turn_number"]) for r in got} == {(1, 1), (2, 2)}


def docs_df(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")


def weights(spark, docs, stop=()):
    df = docs_df(spark, docs)
    return vectors.tfidf(tx.token_rows(df, "doc_id", "text", stop), df)


def brute_tfidf(docs):
    n = len(docs)
    df = {}
    for d in docs:
        for t in set(d.split()):
            df[t] = df.get(t, 0) + 1
    out = []
    for d in docs:
        words = d.split()
        v = {t: words.count(t) / len(words) * (math.log((1 + n) / (1 + df[t])) + 1) for t in set(words)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def test_tfidf_and_pair_similarity(spark):
    docs = ["package late", "package missing", "account password", ""]
    v = weights(spark, docs)
    got = {(r["doc_id"], r["term"]): r["w"] for r in v.collect()}
    want = {(i, t): w for i, vec in enumerate(brute_tfidf(docs)) for t, w in vec.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 0)], "left_id long, right_id long")
    sims = {(r[0], r[1]): r[2] for r in vectors.pair_similarity(pairs, v, v).collect()}
    assert 0 < sims[0, 1] < 1 and sims[0, 2] == 0 and sims[0, 0] == pytest.approx(1)


def test_concept_vectors(spark):
    df = docs_df(spark, ["My package was stolen from my porch!", "My order is late, I want a refund now.", "zzz", "please send back, SEND BACK"])
    rows = vectors.concept_vectors(df, "text").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], {})[r["term"]] = r["w"]
    assert got[0] == {"missing": 1.0} and set(got[1]) == {"delay", "refund"} and 2 not in got
    assert got[3] == {"return": 1.0}


def brute_top(queries, docs, k, threshold, normalize=True):
    vecs = brute_tfidf(docs)
    vocab = {t for v in vecs for t in v}
    out = set()
    for qid, text in enumerate(queries):
        terms = set(text.split()) & vocab
        w = 1 / math.sqrt(len(terms)) if terms and normalize else 1.0
        sims = [(-round(sum(w * v.get(t, 0) for t in sorted(terms)), 9), i) for i, v in enumerate(vecs)]
        best = sorted(s for s in sims if -s[0] >= threshold)[:k]
        out |= {(qid, rank, i, round(-s + 0.0, 6)) for rank, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("k,threshold,normalize", [(5, 0.0, True), (2, 0.3, True), (3, 0.2, False), (1, 0.55, True)])
@pytest.mark.parametrize("direct", [10**9, -1])
def test_retrieval_equals_brute_force(spark, k, threshold, normalize, direct):
    rng = random.Random(7)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    docs = [" ".join(rng.choices(vocab, k=rng.randint(1, 12))) for _ in range(120)]
    docs += ["w1 w2 w3"] * 60 + ["w1"] * 40  # copies and one very common term
    queries = [" ".join(rng.choices(vocab, k=rng.randint(1, 6))) for _ in range(25)] + ["w1", "w1", "zz", "zz w7"]
    index = retrieval.build_index(docs_df(spark, docs), stop_words=(), max_k=5)
    asked = docs_df(spark, queries).withColumnRenamed("doc_id", "query_id")
    hits = retrieval.retrieve(asked, index, k, threshold, normalize, direct_rows=direct)
    got = {(r["query_id"], r["rank"], r["case_id"], round(r["similarity"], 6)) for r in hits.collect()}
    assert got == brute_top(queries, docs, k, threshold, normalize)


def test_retrieval_bands(spark):
    index = retrieval.build_index(docs_df(spark, ["test word", "other thing"]), stop_words=())
    asked = spark.createDataFrame([(1, "test word"), (2, "nothing here")], "query_id long, text string")
    hits = retrieval.retrieve(asked, index, 1, 0.55)
    bands = {r["query_id"]: r for r in retrieval.retrieval_bands(asked, hits).collect()}
    assert bands[1]["top_sim"] == pytest.approx(1.0) and bands[1]["confidence"] == "strong"
    assert bands[2]["cases"] == 0 and bands[2]["confidence"] == "weak" and bands[2]["mean_sim"] == 0
    with pytest.raises(ValueError):
        retrieval.retrieve(asked, index, 99)


def test_kmeans_groups_and_names(spark):
    docs = [
        "package late", "package missing", "package late missing", "account password login", "account locked login", "",
    ]
    v = weights(spark, docs)
    first = cluster.spherical_kmeans(v, 2)
    got = {r["doc_id"]: r["cluster"] for r in first.collect()}
    again = {r["doc_id"]: r["cluster"] for r in cluster.spherical_kmeans(v.repartition(3), 2).collect()}
    assert got == again and set(got) == {0, 1, 2, 3, 4}
    assert cluster.outliers(docs_df(spark, docs), first).collect()[0]["doc_id"] == 5
    assert {r["doc_id"]: r["cluster"] for r in cluster.spherical_kmeans(v, 99).collect()}.keys() == got.keys()
    summary = cluster.cluster_summary(docs_df(spark, docs), v, first, 2)
    assert sum(r["num_examples"] for r in summary.collect()) == 5
    merged = cluster.roll_up_taxonomy(summary).collect()
    assert sum(r["count"] for r in merged) == 5


def test_empty_cluster_restarts(spark):
    # Three equal documents seed the same centroid; the lowest takes all, the rest restart.
    v = weights(spark, ["a a", "a", "a a a", "b", "c", "d"])
    got = {r["doc_id"]: r["cluster"] for r in cluster.spherical_kmeans(v, 5).collect()}
    assert len(got) == 6 and got[0] == got[1] == got[2]


@pytest.mark.parametrize(
    "words,name",
    [
        (["package", "late", "delivery"], "delivery_delay"), (["package", "missing", "delivery"], "missing_delivery"),
        (["cancel", "prime", "membership"], "prime_cancellation_or_charge"), (["return", "item", "refund"], "returns_and_refunds"),
        (["account", "password", "login"], "account_issue"), (["random", "stuff"], "unknown_random"), ([], "unknown_topic"),
    ],
)
def test_cluster_names(spark, words, name):
    df = spark.createDataFrame([(words,)], "keywords array<string>")
    assert df.select(cluster.name_by_rules("keywords")).collect()[0][0] == name


def test_centroid_names(spark):
    df = spark.createDataFrame([(0, "missing", 0.1), (1, "missing", 0.8), (1, "delay", 0.2)], "cluster int, term string, w double")
    got = {r[0]: r[1] for r in cluster.name_by_centroid(df).collect()}
    assert got == {0: "other_or_unclear", 1: "missing_delivery"}


def test_concept_roll_up(spark):
    docs = docs_df(spark, ["my parcel is late", "late again", "refund me", "money back please", "zzz"])
    v = vectors.concept_vectors(docs, "text")
    asg = cluster.spherical_kmeans(v, 2)
    rows = cluster.roll_up_concepts(cluster.concept_cluster_summary(docs, v, asg), 1, 5).collect()
    assert sum(r["count"] for r in rows) == 5
    assert sum(r["estimated_percentage"] for r in rows) == pytest.approx(100.0)


def test_seeded_order_ignores_layout(spark):
    df = spark.range(5000)
    a = {r["id"]: r["rank"] for r in hash_rank(df, ["id"]).collect()}
    b = {r["id"]: r["rank"] for r in hash_rank(df.repartition(5).orderBy(F.desc("id")), ["id"]).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 5001))
    taken = {r["id"] for r in take_by_hash(df, ["id"], 700).collect()}
    assert taken == {i for i, rank in a.items() if rank <= 700}
    assert take_by_hash(spark.range(10), ["id"], 700).count() == 10


def test_quantiles_with_a_dominant_value(spark):
    values = [0.0] * 500 + [i / 97 for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["prob"]: r["x"] for r in quantiles(df, "x", (0.0, 0.5, 0.8, 0.95, 1.0)).collect()}
    ordered = sorted(values)
    for p, x in got.items():
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert x == pytest.approx(low + (high - low) * (at - math.floor(at)))


def test_blocks_with_floors_equal_brute_force(spark, monkeypatch):
    # Many blocks of cases and several turns of queries.
    monkeypatch.setattr(retrieval, "BLOCK_CHARS", 60)
    monkeypatch.setattr(retrieval, "FIRST", 4)
    monkeypatch.setattr(retrieval, "SLAB_TERMS", 20)
    rng = random.Random(3)
    docs = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 9))) for _ in range(90)]
    queries = [" ".join(f"w{rng.randint(0, 33)}" for _ in range(4)) for _ in range(12)]
    rows = docs_df(spark, docs)
    index = retrieval.build_index(rows, stop_words=(), max_k=3)
    asked = docs_df(spark, queries).withColumnRenamed("doc_id", "query_id")
    hits = retrieval.retrieve(asked, index, 3, 0.0, direct_rows=-1)
    got = {(r["query_id"], r["rank"], r["case_id"], round(r["similarity"], 6)) for r in hits.collect()}
    assert got == brute_top(queries, docs, 3, 0.0)


def test_a_block_hands_on_k_scores_a_query():
    # One term that all 5000 cases share: pairs don't leave the task.
    import numpy as np
    import pyarrow as pa

    slab = retrieval.Slab(pa.array([7, 8]), np.array([0, 1, 2]), np.array([0, 0]), np.array([5]), np.ones(2), np.zeros(2))
    rows = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([5] * 5000), pa.array([0.5] * 4999 + [0.75])], ["bag", "h", "x"])
    out = [r for b in retrieval.block_scores(iter([rows]), slab, 2) for r in b.to_pylist()]
    assert [(r["qkey"], r["bag"], r["similarity"]) for r in out] == [(q, b, s) for q in (7, 8) for b, s in ((4999, 0.75), (0, 0.5))]


def test_norms_and_frequencies_move_no_text(spark, monkeypatch):
    plans = []

    def kept(df, real=retrieval.cut_lineage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(retrieval, "cut_lineage", kept)
    monkeypatch.setattr(retrieval, "NORM_TERMS", 9)  # the others are joined by their hash
    monkeypatch.setattr(retrieval, "RUN_WORDS", 7)
    rng = random.Random(11)
    docs = [" ".join(f"w{int(rng.paretovariate(0.8)) % 80}" for _ in range(rng.randint(0, 30))) for _ in range(80)] + ["w1 w1 w90", "", "w91"]
    index = retrieval.build_index(docs_df(spark, docs), stop_words=(), max_k=3)
    assert plans and not any("REPARTITION_BY" in plan for plan in plans)
    vecs = brute_tfidf(docs)
    for r in index.norms.join(index.texts, "doc_id").collect():
        words = r["_text"].split()
        idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d.split() for d in docs))) + 1 for w in words}
        assert r["norm"] == pytest.approx(math.sqrt(sum((words.count(w) * idf[w]) ** 2 for w in idf)))
    assert index.norms.count() == len({d for v, d in zip(vecs, docs) if v})


def test_no_turn_takes_more_than_half_of_the_cases(spark, monkeypatch):
    taken = []

    def watched(index, wanted, begin=0, end=None, real=retrieval._occurrences):
        taken.append((begin, end))
        return real(index, wanted, begin, end)

    monkeypatch.setattr(retrieval, "BLOCK_CHARS", 60)
    monkeypatch.setattr(retrieval, "_occurrences", watched)
    rng = random.Random(5)
    docs = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 9))) for _ in range(90)]
    queries = [" ".join(f"w{rng.randint(0, 33)}" for _ in range(4)) for _ in range(12)]
    index = retrieval.build_index(docs_df(spark, docs), stop_words=(), max_k=3)
    asked = docs_df(spark, queries).withColumnRenamed("doc_id", "query_id")
    hits = retrieval.retrieve(asked, index, 3, 0.0, direct_rows=-1)
    got = {(r["query_id"], r["rank"], r["case_id"], round(r["similarity"], 6)) for r in hits.collect()}
    assert got == brute_top(queries, docs, 3, 0.0)
    assert taken == [(0, 1), (1, 4), (4, 16), (16, 32)]


@pytest.mark.parametrize("sent,words", [(10**6, 10**6), (7, 5)])
def test_no_turn_shuffles_texts(spark, monkeypatch, sent, words):
    plans = []

    def watched(index, wanted, begin=0, end=None, real=retrieval._occurrences):
        rows = real(index, wanted, begin, end)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(retrieval, "BLOCK_CHARS", 60)
    monkeypatch.setattr(retrieval, "_occurrences", watched)
    monkeypatch.setattr(retrieval, "SENT_NORMS", sent, raising=False)
    monkeypatch.setattr(retrieval, "BLOCK_WORDS", words, raising=False)
    rng = random.Random(6)
    docs = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 9))) for _ in range(90)] + ["w1 w2 w2"] * 9
    queries = [" ".join(f"w{rng.randint(0, 33)}" for _ in range(4)) for _ in range(12)]
    rows = docs_df(spark, docs).coalesce(2)
    index = retrieval.build_index(rows, stop_words=(), max_k=3)
    asked = docs_df(spark, queries).withColumnRenamed("doc_id", "query_id")
    hits = retrieval.retrieve(asked, index, 3, 0.0, direct_rows=-1)
    got = {(r["query_id"], r["rank"], r["case_id"], round(r["similarity"], 6)) for r in hits.collect()}
    assert got == brute_top(queries, docs, 3, 0.0)
    assert not any("Exchange hashpartitioning" in plan or "REPARTITION" in plan for plan in plans)
    assert len(plans) == 4 if sent > 90 else len(plans) > 10


def test_a_case_lies_in_one_block():
    import pyarrow as pa

    bags = [3, 3, 1, 1, 1, 1, 1, 8, 2, 2, 2]
    for size in (1, 2, 4, 11):
        batches = [pa.RecordBatch.from_arrays([pa.array(bags[i : i + size])], ["bag"]) for i in range(0, 11, size)]
        out = [[b for part in block for b in part.column(0).to_pylist()] for block in retrieval.blocks(batches, 2)]
        assert sum(out, []) == bags and sum(len(set(x)) for x in out) == 4
        assert len(out) > 1 or size == 11


def test_kmeans_in_passes_equals_joins(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"{g}{i}" for g in "abcd" for i in range(12)]
    docs = [" ".join(rng.choices(words[g * 12 : g * 12 + 14] if g < 3 else words[36:], k=rng.randint(2, 9))) for g in range(4) for _ in range(30)]
    v = weights(spark, docs + ["zz"] * 3)
    cuts = []
    monkeypatch.setattr(cluster, "cut_lineage", lambda df, real=cluster.cut_lineage: cuts.append(1) or real(df))
    few = {r["doc_id"]: r["cluster"] for r in cluster.spherical_kmeans(v, 6).collect()}
    assert len(few) == len(docs) + 3 and len(set(few.values())) > 1
    assert len(cuts) == 4  # none in a round
    monkeypatch.setattr(cluster, "BROADCAST_CELLS", 0)
    assert few == {r["doc_id"]: r["cluster"] for r in cluster.spherical_kmeans(v, 6).collect()}


def test_only_found_cases_move(spark, monkeypatch):
    # No exchange by case holds texts, whatever the planner knows of the hits; several turns give the same rows.
    from threadloom.operators import predict

    texts = [f"text {i}" for i in range(60)]
    cases = spark.createDataFrame([(i, t, t, "en" if i % 3 else "de", i % 2 == 0, t) for i, t in enumerate(texts)], "case_id long, customer_message string, brand_response string, intent string, escalate boolean, reply string")
    found = [(q, r, 0 if r == 1 else (q * 7 + r) % 60, 2.0 / r - q % 4) for q in range(40) for r in (1, 2, 3)]
    hits = spark.createDataFrame(found, "query_id long, rank int, case_id long, similarity double")
    queries = spark.range(42).withColumnRenamed("id", "query_id")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        results = []
        for most in (10, 500_000):
            monkeypatch.setattr(retrieval, "SENT_HITS", most, raising=False)
            frames = [retrieval.evidence_pack(hits, cases), predict.knn_predict(queries, hits, cases, 3, 0.5)]
            for df in frames:
                plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
                moved = [b for b in plan.split("\n\n") if "hashpartitioning(case_id" in b]
                assert not any(c in b for b in moved for c in ("customer_message", "brand_response", "reply"))
            results.append([sorted(map(str, df.collect())) for df in frames])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert results[0] == results[1]
    evidence = {r["query_id"]: [(e["rank"], e["case_id"], e["brand_response"]) for e in r["evidence"]] for r in frames[0].collect()}
    assert evidence == {q: [(r, c, texts[c]) for p, r, c, _ in found if p == q] for q in range(40)}
    votes = {r["query_id"]: r["reply"] for r in frames[1].collect()}
    assert len(votes) == 42 and all(votes[q] == texts[0] for q in range(40) if q % 4 < 2)
