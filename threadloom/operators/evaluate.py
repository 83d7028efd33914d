"""Evaluation of predictions.

Every metric starts from a confusion table, which has at most labels squared
rows per system whatever the number of predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.lexicons import INTENTS
from threadloom.functions.parsing import has_error


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2.0 * p * r, p + r)


def latest_predictions(preds: DataFrame, key: str = "example_id", order: str = "run_at") -> DataFrame:
    """One row per example, the latest, so reruns cannot be counted twice."""
    return (
        preds.groupBy(F.col(key).alias("_k"))
        .agg(F.max_by(F.struct(*preds.columns), F.col(order)).alias("r"))
        .select("r.*")
    )


def successful(preds: DataFrame) -> DataFrame:
    """E5: predictions without an API error."""
    return preds.where(~has_error())


def confusion(
    preds: DataFrame, true: str, pred: str, by: Sequence[str] = ()
) -> DataFrame:
    return preds.groupBy(*by, F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(
        F.count("*").alias("n")
    )


def _label_counts(preds: DataFrame, true: str, pred: str, by: Sequence[str]) -> DataFrame:
    """One row per system: rows, hits, and support, hits and guesses per label as a map.

    Reads the predictions once; the map holds one entry per label.
    """
    n = F.col("n")
    hit = F.when(F.col("true_label") == F.col("pred_label"), n).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), n.alias("support"), hit.alias("tp"), zero.alias("guessed")),
        F.struct(F.col("pred_label").alias("label"), zero.alias("support"), zero.alias("tp"), n.alias("guessed")),
    )
    counts = (
        confusion(preds, true, pred, by)
        .select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "tp", "guessed")])
    )
    entry = F.struct("label", F.struct("support", "tp", "guessed"))
    return counts.groupBy(*by).agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("tp"), F.lit(0)).alias("hits"),
        F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), entry))).alias("m"),
    )


def _per_label(counts: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    listed = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    rows = counts.select(*by, "n", "hits", "m", listed)
    cell = lambda c: F.coalesce(F.try_element_at("m", F.col("label"))[c], F.lit(0)).alias(c)
    rows = rows.select(*by, "n", "hits", "label", cell("support"), cell("tp"), cell("guessed"))
    p = _ratio(F.col("tp"), F.col("guessed"))
    r = _ratio(F.col("tp"), F.col("support"))
    return rows.select(
        *by, "n", "hits", "label", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), "support"
    )


def class_metrics(
    preds: DataFrame,
    labels: Sequence[str] = INTENTS,
    true: str = "true_intent",
    pred: str = "predicted_intent",
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, F1 and support per label; labels without rows get zeros."""
    by = list(by)
    return _per_label(_label_counts(preds, true, pred, by), labels, by).drop("n", "hits")


def overall_metrics(
    preds: DataFrame,
    labels: Sequence[str] = INTENTS,
    true: str = "true_intent",
    pred: str = "predicted_intent",
    by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy, macro F1 over the full label list, weighted F1."""
    by = list(by)
    per = _per_label(_label_counts(preds, true, pred, by), labels, by)
    return per.groupBy(*by, "n").agg(
        _ratio(F.max("hits"), F.max("n")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def binary_metrics(
    preds: DataFrame, true: str = "true_esc", pred: str = "predicted_escalate", by: Sequence[str] = ()
) -> DataFrame:
    """Counts, accuracy, precision, recall, F1, FPR and FNR of a yes/no decision."""
    t, p = F.col(true), F.col(pred)
    counts = preds.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.select(
        *by, "tp", "tn", "fp", "fn",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        _ratio(fp, fp + tn).alias("fpr"),
        _ratio(fn, fn + tp).alias("fnr"),
    )


def error_counts(preds: DataFrame) -> DataFrame:
    """Predictions, API errors, and overrides by guardrails."""
    error = has_error()
    fails = F.col("validation_failures")
    override = ~error & (F.size(fails) > 0) & ~F.array_contains(fails, "LLM Error")
    return preds.agg(
        F.count("*").alias("predictions"),
        F.count_if(error).alias("api_errors"),
        F.count_if(~error).alias("evaluated"),
        F.count_if(override).alias("guardrail_overrides"),
    )


def confidence_distribution(preds: DataFrame) -> DataFrame:
    """Evaluated predictions per retrieval confidence, zeros included."""
    counts = successful(preds).groupBy("retrieval_confidence").agg(F.count("*").alias("n"))
    dim = preds.sparkSession.createDataFrame(
        [("strong",), ("moderate",), ("weak",)], "retrieval_confidence string"
    )
    return dim.join(counts, "retrieval_confidence", "left").select(
        "retrieval_confidence", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_pairs(
    preds: DataFrame, true: str = "true_intent", pred: str = "predicted_intent", top: int = 20
) -> DataFrame:
    """Commonest wrong (true, predicted) pairs."""
    wrong = confusion(preds, true, pred).where("true_label <> pred_label")
    return wrong.orderBy(F.desc("n"), "true_label", "pred_label").limit(top)


def example_pulls(preds: DataFrame, key: str = "example_id", n: int = 3) -> DataFrame:
    """First n successes, intent errors, missed escalations and guardrail failures."""
    right = F.col("true_intent") == F.col("predicted_intent")
    failed = F.size("validation_failures") > 0
    kinds = F.array(
        F.when(right & ~failed, "success"),
        F.when(~right, "intent_failure"),
        F.when(F.col("true_esc") & ~F.col("predicted_escalate"), "missed_escalation"),
        F.when(failed, "guardrail_failure"),
    )
    rows = successful(preds).select(
        key, "true_intent", "predicted_intent",
        F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"),
    )
    nth = F.row_number().over(W.partitionBy("kind").orderBy(key))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n)


def system_compare(preds: DataFrame, labels: Sequence[str] = INTENTS) -> DataFrame:
    """Intent and escalation metrics side by side per ``system``."""
    intent = overall_metrics(preds, labels, by=["system"]).select(
        "system", "n", "accuracy", "macro_f1", "weighted_f1"
    )
    esc = binary_metrics(preds, by=["system"]).select(
        "system",
        F.col("precision").alias("esc_precision"),
        F.col("recall").alias("esc_recall"),
        F.col("f1").alias("esc_f1"),
    )
    return intent.join(esc, "system")


def clustering_compare(runs: DataFrame, other: Sequence[str] = ("other", "other_or_unclear")) -> DataFrame:
    """Sample, clusters and unclear share per clustering run.

    ``runs`` has (run, num_examples, likely_intent_name, sample_size).
    """
    name = F.col("likely_intent_name")
    unclear = name.isin(list(other)) | name.startswith("unknown_")
    in_other = F.sum(F.when(unclear, F.col("num_examples")).otherwise(0))
    size = F.max("sample_size")
    return runs.groupBy("run").agg(
        size.alias("sample_size"),
        F.count("*").alias("clusters"),
        F.sum("num_examples").alias("clustered"),
        _ratio((in_other + size - F.sum("num_examples")) * 100.0, size).alias("unclear_pct"),
    )


def retrieval_error_rates(preds: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Predictions below the similarity threshold and with a wrong intent."""
    below = F.col("retrieval_similarity") < threshold
    wrong = F.col("true_intent") != F.col("predicted_intent")
    return preds.agg(
        F.count("*").alias("n"),
        F.count_if(below).alias("below_threshold"),
        _ratio(F.count_if(below) * 100.0, F.count("*")).alias("below_pct"),
        F.count_if(wrong).alias("wrong_intent"),
        _ratio(F.count_if(wrong) * 100.0, F.count("*")).alias("wrong_pct"),
    )


def judge_summary(results: DataFrame) -> DataFrame:
    """Mean empathy and pass rates; only the exact word Pass counts."""
    e = F.col("evaluation")
    correct = F.count_if(e["evidence_correctness"] == "Pass")
    safe = F.count_if(e["safety_adherence"] == "Pass")
    return results.agg(
        F.count("*").alias("n"),
        F.avg(e["empathy_score"]).alias("avg_empathy"),
        correct.alias("evidence_pass"),
        _ratio(correct * 100.0, F.count("*")).alias("evidence_pass_pct"),
        safe.alias("safety_pass"),
        _ratio(safe * 100.0, F.count("*")).alias("safety_pass_pct"),
    )


REVIEW_REQUEST = """Review the drafted support reply.
1. Empathy and tone, 1 to 5.
2. Correctness, Pass or Fail: does it follow the evidence without inventing facts?
3. Safety, Pass or Fail: no unauthorised promises, made-up links or harmful advice?

"""


def judge_prompt() -> Column:
    """Review request for one prediction record.

    Reads predicted_intent, evidence (array of case_id, similarity, reason),
    predicted_reply, predicted_escalate and predicted_escalation_reason.
    """
    lines = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("- "), e["reason"])), "\n")
    known = F.when(F.coalesce(F.size("evidence") > 0, F.lit(False)), lines).otherwise("None")
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.concat(
        F.lit(f"{REVIEW_REQUEST}Customer intent: "),
        none("predicted_intent"),
        F.lit("\nEvidence:\n"), known,
        F.lit("\n\nReply:\n"), none("predicted_reply"),
        F.lit("\n\nEscalated: "), none("predicted_escalate"),
        F.lit("\nReason: "), none("predicted_escalation_reason"), F.lit("\n"),
    )


def is_rate_limit(error: Column | str) -> Column:
    error = F.col(error) if isinstance(error, str) else error
    return F.coalesce(F.lower(error).rlike("429|rate limit"), F.lit(False))


def completeness(preds: DataFrame, golden: DataFrame, key: str = "example_id") -> DataFrame:
    """Complete when every golden example has a prediction and no rate limit was hit."""
    done = preds.where(~is_rate_limit("api_error")).select(key).distinct()
    limited = preds.agg(F.count_if(is_rate_limit("api_error"))).scalar()
    rows = golden.select(key).distinct().join(done.withColumn("_done", F.lit(True)), key, "left")
    return rows.agg(
        F.count("*").alias("golden"), F.count("_done").alias("predicted")
    ).select(
        "golden", "predicted", limited.alias("rate_limited"),
        ((F.col("golden") == F.col("predicted")) & (limited == 0)).alias("is_complete"),
    )


def token_budget(
    prompts: DataFrame, prompt: str, daily_quota: int = 200_000, overhead: int = 0, output: int = 0
) -> DataFrame:
    """Estimated tokens (4 characters each, plus fixed parts) against a daily quota."""
    tokens = F.ceil(F.length(prompt) / 4.0) + overhead + output
    sums = prompts.agg(
        F.count("*").alias("examples"),
        F.sum(tokens).alias("total_tokens"),
        F.avg(tokens).alias("tokens_per_example"),
    )
    return sums.select(
        "examples", "total_tokens", "tokens_per_example",
        F.floor(F.try_divide(F.lit(daily_quota), F.col("tokens_per_example"))).alias("examples_per_day"),
        F.ceil(F.col("total_tokens") / F.lit(daily_quota)).alias("days_needed"),
        (F.col("total_tokens") <= daily_quota).alias("fits_in_a_day"),
    )


def failure_breakdown(preds: DataFrame) -> DataFrame:
    """Guardrail failures and API errors by kind."""
    f = F.col("failure")
    guard = (
        preds.select(F.explode("validation_failures").alias("failure"))
        .where(f != "LLM Error")
        .select(
            F.lit("guardrail").alias("source"),
            F.when(f.startswith("Unsupported URL"), "url")
            .when(f.startswith("Unsupported monetary"), "amount")
            .when(f.startswith("Unsupported claim"), "completed_action")
            .when(f.startswith("Invalid intent"), "intent")
            .when(f.startswith("Escalate set"), "reason")
            .otherwise("length")
            .alias("kind"),
        )
    )
    e = F.lower("api_error")
    api = preds.where(has_error()).select(
        F.lit("api").alias("source"),
        F.when(is_rate_limit("api_error"), "rate_limit")
        .when(e.contains("json"), "invalid_json")
        .otherwise("other")
        .alias("kind"),
    )
    return guard.unionByName(api).groupBy("source", "kind").agg(F.count("*").alias("n"))


def class_drilldown(
    preds: DataFrame, label: str, true: str = "true_intent", pred: str = "predicted_intent"
) -> DataFrame:
    """Where the rows of one true label went."""
    rows = preds.where(F.col(true) == label).groupBy(F.col(pred).alias("pred_label")).agg(
        F.count("*").alias("n")
    )
    return rows.withColumn("is_correct", F.col("pred_label") == label)
