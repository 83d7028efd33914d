"""Tagging, sampling, splits and label checks."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions.lexicons import BOUNDARY_RULES, INTENTS, QUOTAS
from threadloom.functions.ordering import sample_key
from threadloom.operators import labels, sampling, tagging

TURNS = "conversation_id string, turn_number int, speaker string, author_id string, created_at string, text string"


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def test_multi_label_tags(spark):
    df = texts(spark, "my order is LATE and I want a refund", "hello", "a happy plate")
    got = [r[0] for r in df.select(tagging.tag_intents("text")).collect()]
    assert got == [["refund_request", "delivery_delay"], [], ["technical_issue", "delivery_delay"]]
    whole = [r[0] for r in df.select(tagging.tag_intents("text", whole_word=True)).collect()]
    assert whole == [["refund_request", "delivery_delay"], [], []]
    labels_ = df.select(tagging.silver_label(tagging.tag_intents("text", whole_word=True))).collect()
    assert [r[0] for r in labels_] == ["other_or_unclear"] * 3


def test_keyword_with_negation(spark):
    df = texts(
        spark, "my package is late", "there is a delay", "it is late but says delivered", "how do i return this",
        "not what I ordered", "?",
    )
    rows = tagging.match_rules(df, "text").where("intent_id = 'delivery_delay'").collect()
    assert sorted((r["id"], r["match"]) for r in rows) == [(0, "strong"), (1, "strong"), (2, "false_positive")]
    got = [r[0] for r in df.select(tagging.assign_by_priority("text")).collect()]
    assert got == ["delivery_delay", "delivery_delay", "other_or_unclear", "return_request", "wrong_item", "other_or_unclear"]
    prev = tagging.prevalence(df, "text")
    assert prev.count() == len(BOUNDARY_RULES) + 1
    assert tagging.coverage(prev).collect()[0]["coverage"] == pytest.approx(4 / 6)
    report = {r["intent_id"]: r for r in tagging.taxonomy_report(df, "text", "id").collect()}
    assert report["delivery_delay"]["false_positive_examples"] == ["it is late but says delivered"]
    assert len(report["delivery_delay"]["representative_examples"]) == 2


def greedy(rows, seed=42):
    import hashlib

    key = lambda r: (hashlib.md5(f"{seed}|{r[0]}".encode()).hexdigest(), r[0])
    seen_t, seen_a, kept = set(), set(), set()
    for i, t, a in sorted(rows, key=key):
        if t in seen_t or a in seen_a:
            continue
        seen_t.add(t), seen_a.add(a), kept.add(i)
    return kept


@pytest.mark.parametrize("n,n_texts,n_authors", [(300, 120, 90), (200, 3, 150), (120, 120, 1)])
def test_one_per_text_and_author_equals_the_walk(spark, n, n_texts, n_authors):
    rng = random.Random(n)
    rows = [(i, f"t{rng.randrange(n_texts)}", f"a{rng.randrange(n_authors)}") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, t string, a string").repartition(7)
    got = {r["id"] for r in sampling.one_per_text_and_author(df, "id", "t", "a").collect()}
    assert got == greedy(rows)


def dialogues(spark):
    rows = []
    for i in range(60):
        word = ["refund", "late", "nothing", "refund late"][i % 4]
        rows += [
            (f"c{i}", 1, "customer", f"u{i % 50}", "d", "hi"),
            (f"c{i}", 2, "brand", "b", "d", f"hello {i}"),
            (f"c{i}", 3, "customer", f"u{i % 50}", "d", f"please look at {word} number {i % 55} @x"),
            (f"c{i}", 4, "brand", "b", "d", f"answer {i}"),
        ]
    return spark.createDataFrame(rows, TURNS)


def test_golden_candidates(spark):
    quotas = {**QUOTAS, "refund_request": 3, "delivery_delay": 4, "difficult": 5, "other_or_unclear": 100}
    gold = sampling.golden_candidates(dialogues(spark), quotas=quotas).collect()
    sizes = {}
    for g in gold:
        tags = g["candidate_intents"]
        stratum = "difficult" if len(tags) > 1 else tags[0] if tags else "other_or_unclear"
        sizes[stratum] = sizes.get(stratum, 0) + 1
        assert g["previous_turns"][0] == "hi" and len(g["previous_turns"]) == 2
        assert g["previous_speakers"] == ["customer", "brand"]
        assert g["brand_response"].startswith("answer")
    assert (sizes["refund_request"], sizes["delivery_delay"], sizes["difficult"]) == (3, 4, 5)
    assert sizes["other_or_unclear"] <= 15
    assert sorted(g["example_id"] for g in gold) == [f"gold_{i:04d}" for i in range(1, len(gold) + 1)]


def test_bucket_sample(spark):
    rows = [(f"c{i}", n, True, False) for n, many in ((2, 30), (4, 30), (8, 2), (12, 1)) for i in [f"{n}_{j}" for j in range(many)]]
    rows += [("bad", 4, True, True), ("alone", 3, False, False), ("one", 1, True, False)]
    df = spark.createDataFrame(rows, "conversation_id string, num_turns int, brand_responded boolean, is_flagged boolean")
    got = sampling.sample_buckets(df, 20).collect()
    sizes = {}
    for r in got:
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + 1
    assert len(got) == 20 and sizes["long"] == 2 and sizes["very_long"] == 1
    assert sizes["short"] >= 5 and sizes["medium"] >= 5
    assert not {"bad", "alone", "one"} & {r["conversation_id"] for r in got}


def test_split_and_leakage(spark):
    turns = dialogues(spark)
    convs = turns.select("conversation_id").distinct()
    golden = spark.createDataFrame([("c0", "Please look at REFUND number 0"), ("c7", "xyz")], "conversation_id string, customer_message string")
    parts = sampling.split(convs, turns, golden)
    rows = {r["conversation_id"]: r["part"] for r in parts.collect()}
    again = {r["conversation_id"]: r["part"] for r in sampling.split(convs.repartition(5), turns, golden).collect()}
    assert rows == again and "c0" not in rows and "c7" not in rows
    assert sum(p == "dev" for p in rows.values()) == int(0.8 * len(rows))
    audit = {r[0]: r[1] for r in sampling.leakage_audit(turns, golden, parts).collect()}
    assert set(audit.values()) == {0}
    leaky = convs.withColumn("part", F.lit("dev")).unionByName(convs.limit(3).withColumn("part", F.lit("val")))
    audit = {r[0]: r[1] for r in sampling.leakage_audit(turns, golden, leaky).collect()}
    assert audit["golden_in_dev"] == 2 and audit["dev_in_val"] == 3 and audit["golden_text_in_dev"] == 1


def test_pilot_keeps_list_order(spark):
    df = spark.createDataFrame([(f"gold_{i:04d}",) for i in range(9)], "example_id string")
    got = [r["example_id"] for r in sampling.pilot_subset(df, ["gold_0005", "gold_0001", "missing"]).collect()]
    assert got == ["gold_0005", "gold_0001"]


LABELS = "example_id string, conversation_id string, customer_message string, human_intent string, human_escalate string, human_reason string, annotation_notes string"


def good(i):
    return [f"gold_{i:04d}", f"conv_{i}", f"This is a valid test message {i}", "technical_issue", "false", None, "Tested"]


def rules_broken(spark, rows):
    return {r["rule"] for r in labels.label_violations(spark.createDataFrame(rows, LABELS)).collect()}


def test_hard_label_checks(spark):
    rows = [good(i) for i in range(200)]
    assert rules_broken(spark, rows) == set()
    labels.check_labels(spark.createDataFrame(rows, LABELS))
    assert rules_broken(spark, rows[:199]) == {"row_count"}
    cases = {
        "duplicate_id": (1, 0, "gold_0000"), "duplicate_message": (1, 2, "THIS is a valid test message 0!"),
        "invalid_intent": (0, 3, "magic_pizza"), "invalid_escalate": (0, 4, "Maybe"), "missing_field": (0, 3, None),
    }
    for rule, (row, column, value) in cases.items():
        broken = [list(r) for r in rows]
        broken[row][column] = value
        assert rules_broken(spark, broken) == {rule}
    no_column = spark.createDataFrame(rows, LABELS).drop("human_intent")
    assert {r["detail"] for r in labels.label_violations(no_column).collect()} == {"human_intent"}
    with pytest.raises(ValueError, match="row_count"):
        labels.check_labels(spark.createDataFrame(rows[:199], LABELS))


def test_label_warnings_and_tables(spark):
    rows = [good(i) for i in range(5)]
    rows[0][2] = "hi"
    rows[1][3] = "other_or_unclear"
    rows[2][4], rows[2][5] = "true", ""
    rows[3][6] = " x "
    rows[4][2] = "word " * 101
    df = spark.createDataFrame(rows, LABELS)
    got = {(r[0][-1], r[1]) for r in labels.label_warnings(df).collect()}
    assert got == {("0", "short_message"), ("1", "other_or_unclear"), ("2", "escalate_without_reason"), ("3", "short_notes"), ("4", "long_message")}
    cross = {r[0]: (r[1], r[2]) for r in labels.label_crosstab(df).collect()}
    assert cross["technical_issue"] == (1, 3) and cross["cancel_order"] == (0, 0) and len(cross) == len(INTENTS)
    assert {r["human_intent"]: r["pct"] for r in labels.label_distribution(df).collect()}["technical_issue"] == 80.0


def test_annotations(spark):
    cands = spark.createDataFrame([(f"g{i}", ["x"]) for i in range(4)], "example_id string, candidate_intents array<string>")
    ann = spark.createDataFrame(
        [("g0", "cancel_order", False, "", "", 1), ("g0", "refund_request", True, "money", "", 2), ("g1", "refund_request", False, "", "", 1)],
        "example_id string, human_intent string, human_escalate boolean, human_reason string, annotation_notes string, saved_at int",
    )
    merged = labels.merge_annotations(cands, ann)
    rows = {r["example_id"]: r for r in merged.collect()}
    assert rows["g0"]["human_intent"] == "refund_request" and rows["g3"]["human_intent"] is None
    p = labels.annotation_progress(merged).collect()[0]
    assert (p["total"], p["completed"], p["remaining"], p["pct"], p["escalate_yes"], p["escalate_no"]) == (4, 2, 2, 50.0, 1, 1)
    per = labels.intent_progress(merged).collect()
    assert per[0]["human_intent"] == "refund_request" and per[0]["n"] == 2 and len(per) == 11
    assert labels.blind_view(cands).columns == ["example_id"]
