"""Predictions, guardrails, metrics, files and resumable runs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions.lexicons import HANDOVER_REPLY, SHORT_STOCK_REPLY, STOCK_REPLY
from threadloom.operators import conversations as conv
from threadloom.operators import evaluate, predict, tagging
from threadloom.sources import readers, writers
from threadloom.streaming import resume


def draft(spark, reply, evidence="We will refund you.", intent="refund_request", escalate=False, reason=None, error=None):
    return spark.createDataFrame(
        [("1", intent, 0.9, reply, escalate, reason, error, [(evidence,)])],
        "query_id string, intent string, intent_confidence double, reply string, escalate boolean, "
        "escalation_reason string, api_error string, evidence array<struct<brand_response:string>>",
    )


def failures(spark, reply, **kw):
    rules = kw.pop("rules", {})
    return predict.apply_safety(draft(spark, reply, **kw), **rules).collect()[0]["validation_failures"]


def test_unbacked_amount_is_overridden(spark):
    row = predict.apply_safety(draft(spark, "I will refund you $50.00 immediately.")).collect()[0]
    assert row["validation_failures"] == ["Unsupported monetary amount generated: $50.00"]
    assert row["escalate"] and row["reply"] == HANDOVER_REPLY
    assert row["original_draft"] == "I will refund you $50.00 immediately." and row["api_error"] is None
    assert row["escalation_reason"].startswith("Grounding Validation Failures: Unsupported")


def test_amounts_links_claims(spark):
    assert failures(spark, "take $5", evidence="it was $50") == ["Unsupported monetary amount generated: $5"]
    assert failures(spark, "take $5", evidence="it was $50", rules={"substring_amounts": True}) == []
    link = "see https://t.co/AbC1"
    assert failures(spark, link, evidence=link) == []
    assert len(failures(spark, link, evidence=link, rules={"strict_case": True})) == 1
    assert failures(spark, link) == ["Unsupported URL generated: https://t.co/AbC1"]
    assert failures(spark, "see https://www.amazon.com/x") == []
    assert failures(spark, "I have refunded it") == ["Unsupported claim of completed action: 'i have refunded'"]
    assert failures(spark, "I have refunded it", evidence="yes i have refunded that") == []


def test_shape_of_reply(spark):
    assert failures(spark, "ok", intent="sales") == ["Invalid intent: sales"]
    assert failures(spark, "  ") == ["Empty reply generated."]
    assert failures(spark, "w " * 151) == ["Reply exceeds maximum length (151 words)."]
    assert failures(spark, "w " * 150) == []
    assert failures(spark, "ok", escalate=True) == ["Escalate set to true but missing escalation reason."]
    row = predict.apply_safety(draft(spark, "", escalate=True, reason="angry")).collect()[0]
    assert row["escalation_reason"] == "angry | Grounding Validation Failures: Empty reply generated."
    row = predict.apply_safety(draft(spark, "fallback $9", error="boom")).collect()[0]
    assert row["validation_failures"] == ["LLM Error"] and row["reply"] == "fallback $9"


def test_drafter_errors_become_records(spark):
    def drafter(prompt):
        if prompt == "bad":
            raise ValueError("invalid JSON")
        return {"intent": "cancel_order", "intent_confidence": 1, "reply": prompt, "escalate": False}

    df = spark.createDataFrame([("a", "good"), ("b", "bad")], "query_id string, prompt string")
    rows = {r["query_id"]: r for r in predict.draft(df, drafter).collect()}
    assert rows["a"]["reply"] == "good" and rows["a"]["api_error"] is None
    assert rows["b"]["api_error"] == "invalid JSON" and rows["b"]["escalate"] and rows["b"]["intent_confidence"] == 0


def test_prompt(spark):
    df = spark.createDataFrame(
        [("m", [("customer", "before")], "weak", [("q" * 300, "a", 0.5)]), ("n", None, "weak", None)],
        "customer_message string, context array<struct<speaker:string,text:string>>, confidence string, "
        "evidence array<struct<customer_message:string,brand_response:string,similarity:double>>",
    )
    a, b = [r[0] for r in df.select(predict.prompt_text()).collect()]
    assert a == (
        "CUSTOMER MESSAGE:\nm\n\nCONVERSATION CONTEXT:\n- CUSTOMER: before\n\nRETRIEVAL CONFIDENCE: weak\n\n"
        f"EVIDENCE:\n[1] (sim=0.50) Q: {'q' * 200}\nA: a\n"
    )
    assert b.endswith("EVIDENCE:\nNone.\n") and "CONTEXT" not in b


def test_votes(spark):
    asked = spark.createDataFrame([(i,) for i in range(4)], "query_id long")
    train = spark.createDataFrame(
        [(1, "a", True, "r1"), (2, "b", False, ""), (3, "b", False, "r3"), (4, "c", True, "r4")],
        "case_id long, intent string, escalate boolean, reply string",
    )
    hits = spark.createDataFrame(
        [(0, 1, 1, .9), (0, 2, 2, .8), (0, 3, 3, .7), (1, 1, 2, .9), (1, 2, 1, .8), (1, 3, 4, .7), (2, 1, 1, .05)],
        "query_id long, rank int, case_id long, similarity double",
    )
    rows = {r["query_id"]: r for r in predict.knn_predict(asked, hits, train).collect()}
    assert (rows[0]["intent"], rows[0]["escalate"], rows[0]["reply"]) == ("b", False, "r1")
    assert (rows[1]["intent"], rows[1]["escalate"], rows[1]["reply"]) == ("b", True, SHORT_STOCK_REPLY)
    for far in (2, 3):
        assert (rows[far]["intent"], rows[far]["escalate"], rows[far]["reply"]) == ("other_or_unclear", True, STOCK_REPLY)
    assert {r["intent"] for r in predict.majority_predict(train, asked).collect()} == {"b"}
    assert {r["escalate"] for r in predict.unfitted_predict(asked).collect()} == {False}


def preds(spark):
    rows = [
        ("e1", "a", "a", True, True, [], None, "strong"), ("e2", "a", "b", True, False, ["Invalid intent: b"], None, "weak"),
        ("e3", "b", "b", False, True, [], None, "weak"), ("e4", "b", "b", False, False, ["Unsupported URL generated: x"], None, "weak"),
        ("e5", "a", "c", False, True, ["LLM Error"], "Error 429: slow down", "weak"),
        ("e6", "a", "c", False, True, ["LLM Error"], "bad JSON", "weak"),
    ]
    return spark.createDataFrame(
        rows,
        "example_id string, true_intent string, predicted_intent string, true_esc boolean, predicted_escalate boolean, "
        "validation_failures array<string>, api_error string, retrieval_confidence string",
    )


def test_metrics(spark):
    ok = evaluate.successful(preds(spark))
    per = {r["label"]: r for r in evaluate.class_metrics(ok, ("a", "b", "c")).collect()}
    assert (per["a"]["precision"], per["a"]["recall"], per["a"]["support"]) == (1.0, 0.5, 2)
    assert per["b"]["f1"] == pytest.approx(0.8) and per["c"]["f1"] == 0 and per["c"]["support"] == 0
    total = evaluate.overall_metrics(ok, ("a", "b", "c")).collect()[0]
    assert total["accuracy"] == 0.75 and total["macro_f1"] == pytest.approx((2 / 3 + 0.8) / 3)
    assert total["weighted_f1"] == pytest.approx((2 / 3 + 0.8) / 2)
    b = evaluate.binary_metrics(ok).collect()[0]
    assert (b["tp"], b["tn"], b["fp"], b["fn"], b["fpr"], b["fnr"], b["f1"]) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    none = evaluate.binary_metrics(ok.where("false")).collect()[0]
    assert none["accuracy"] == 0 and none["f1"] == 0
    errors = evaluate.error_counts(preds(spark)).collect()[0]
    assert tuple(errors) == (6, 2, 4, 2)
    conf = {r[0]: r[1] for r in evaluate.confidence_distribution(preds(spark)).collect()}
    assert conf == {"strong": 1, "moderate": 0, "weak": 3}
    pairs = [tuple(r) for r in evaluate.confusion_pairs(ok).collect()]
    assert pairs == [("a", "b", 1)]
    kinds = {(r["kind"], r["example_id"]) for r in evaluate.example_pulls(preds(spark)).collect()}
    assert ("success", "e1") in kinds and ("missed_escalation", "e2") in kinds and ("guardrail_failure", "e4") in kinds
    broken = {(r["source"], r["kind"]): r["n"] for r in evaluate.failure_breakdown(preds(spark)).collect()}
    assert broken == {("guardrail", "intent"): 1, ("guardrail", "url"): 1, ("api", "rate_limit"): 1, ("api", "invalid_json"): 1}
    golden = preds(spark).select("example_id")
    assert not evaluate.completeness(preds(spark), golden).collect()[0]["is_complete"]
    assert evaluate.completeness(ok, ok.select("example_id")).collect()[0]["is_complete"]


def test_judge_and_budget(spark):
    df = spark.createDataFrame(
        [("e1", (4, "Pass", "Pass", "")), ("e2", (5, "pass", "Pass", ""))],
        "example_id string, evaluation struct<empathy_score:int,evidence_correctness:string,safety_adherence:string,reasoning:string>",
    )
    row = evaluate.judge_summary(df).collect()[0]
    assert (row["avg_empathy"], row["evidence_pass"], row["safety_pass_pct"]) == (4.5, 1, 100.0)
    prompts = spark.range(200).select(F.lit("x" * 400).alias("p"))
    row = evaluate.token_budget(prompts, "p", overhead=1400, output=200).collect()[0]
    assert (row["total_tokens"], row["examples_per_day"], row["days_needed"], row["fits_in_a_day"]) == (340000, 117, 2, False)


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "tweets.csv"
    path.write_text(
        "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
        '1,u1,True,Mon Oct 30 10:00:00 +0000 2017,"say ""hi"",\nback\\slash",2,\n'
        "2,AcmeHelp,False,Mon Oct 30 10:01:00 +0000 2017,ok,,1\nx,u9,True,,skipped,,\n",
        encoding="utf-8",
    )
    rows = readers.read_tweets(spark, str(path))
    assert rows.count() == 3 and rows.orderBy("tweet_id").first()["text"] == 'say "hi",\nback\\slash'
    turns = conv.type_tweets(rows).withColumn("conversation_id", F.lit("conv_1"))
    turns = conv.number_turns(turns.withColumn("speaker", conv.speaker("author_id", ["acmehelp"])))
    convs = conv.build_conversations(turns)
    nested = writers.nested_conversations(convs, turns)
    writers.write_conversations(nested, str(tmp_path / "nested"), "json")
    back = readers.read_conversations(spark, str(tmp_path / "nested"))
    assert readers.turns_of(back).count() == 2 and back.first()["num_turns"] == 2
    flat = writers.flatten_turns(convs, turns)
    assert len(flat.columns) == 19
    writers.write_csv(flat, str(tmp_path / "flat"))
    again = spark.read.csv(str(tmp_path / "flat"), header=True, multiLine=True, escape='"')
    assert {r["text"] for r in again.collect()} == {'say "hi",\nback\\slash', "ok"}


def test_gz_ids_golden_and_documents(spark, tmp_path):
    line = json.dumps({"conversation_id": "c1", "turns": [{"speaker": "customer", "text": "hi", "turn_number": 1}]})
    with gzip.open(tmp_path / "dev.jsonl.gz", "wt") as f:
        f.write(line + "\n\n" + line.replace("c1", "c2") + "\n")
    rows = readers.read_conversations(spark, str(tmp_path / "dev.jsonl.gz"), partitions=3)
    assert {r["conversation_id"] for r in rows.collect()} == {"c1", "c2"}
    (tmp_path / "ids.txt").write_text(" c1 \n\nc1\nc2\n")
    ids = readers.read_ids(spark, str(tmp_path / "ids.txt"))
    assert ids.count() == 2
    writers.write_ids(ids, str(tmp_path / "ids_out"))
    assert readers.read_ids(spark, str(tmp_path / "ids_out")).count() == 2
    gold = spark.createDataFrame(
        [("g1", "c1", "d", "msg", ["a", "b"], None, ["x", "y"], "cancel_order", True, None, None)],
        "example_id string, conversation_id string, created_at string, customer_message string, previous_turns array<string>, "
        "brand_response string, candidate_intents array<string>, human_intent string, human_escalate boolean, human_reason string, annotation_notes string",
    )
    writers.write_csv(writers.join_lists(gold), str(tmp_path / "gold"))
    back = readers.read_golden(spark, str(tmp_path / "gold")).first()
    assert back["previous_turns"] == ["a", "b"] and back["candidate_intents"] == ["x", "y"] and back["human_escalate"]
    report = tagging.taxonomy_report(spark.createDataFrame([(1, "late")], "id long, text string"), "text", "id")
    writers.write_json(writers.taxonomy_document(report), str(tmp_path / "doc"))
    doc = spark.read.json(str(tmp_path / "doc")).first()
    assert doc["version"] == "0.1" and len(doc["intents"]) == 12


def test_resume(spark, tmp_path):
    inputs = spark.createDataFrame([(f"g{i}",) for i in range(5)], "example_id string")
    out = str(tmp_path / "out")

    def limited(df):
        error = F.when(F.col("example_id") >= "g2", "Error 429").when(F.col("example_id") == "g1", "other error")
        return df.withColumn("api_error", error)

    resume.append_results(inputs, limited, out)
    assert {r["example_id"] for r in spark.read.parquet(out).collect()} == {"g0", "g1"}
    fine = lambda df: df.withColumn("api_error", F.lit(None).cast("string"))
    resume.append_results(inputs, fine, out)
    resume.append_results(inputs, fine, out)
    rows = {r["example_id"]: r["api_error"] for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 5 and rows["g1"] == "other error"


def test_follow_a_folder(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    fine = lambda df: resume.with_run_config(df.withColumn("api_error", F.lit(None).cast("string")), model="m1")
    for ids in (("g0", "g1"), ("g1", "g2")):
        spark.createDataFrame([(i,) for i in ids], "example_id string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("example_id string").parquet(source)
        resume.follow(stream, fine, out, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted(r["example_id"] for r in rows.collect()) == ["g0", "g1", "g2"]
    assert resume.config_mismatch(rows, model="m2").collect()[0]["n"] == 3
    assert resume.config_mismatch(rows, model="m1").count() == 0
