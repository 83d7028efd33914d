"""Baseline predictions, drafting and guardrails (Q1-Q16)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.lexicons import (
    ALLOWED_LINK_WORDS,
    AMOUNT_PATTERN,
    COMPLETED_ACTIONS,
    HANDOVER_REPLY,
    INTENT_HINTS,
    INTENTS,
    LINK_PATTERN,
    OTHER,
    OUTAGE_REPLY,
    SHORT_STOCK_REPLY,
    STOCK_REPLY,
)
from threadloom.functions.parsing import has_error
from threadloom.functions.text import word_count
from threadloom.operators.retrieval import found_cases
from threadloom.operators.tagging import silver_escalation, silver_label, tag_intents
from threadloom.session import cut_lineage

DRAFT_SCHEMA = (
    "query_id string, intent string, intent_confidence double, reply string, escalate boolean, "
    "escalation_reason string, api_error string"
)


def majority_label(labels: DataFrame, label: str = "intent") -> DataFrame:
    """Most common label, name as tie-break: one row."""
    counts = labels.groupBy(label).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), label).limit(1)


def silver_cases(
    cases: DataFrame,
    lexicon: Mapping[str, Sequence[str]] = INTENT_HINTS,
    escalate_turns: int = 5,
    other: str = OTHER,
) -> DataFrame:
    """R7/R8 on the case base: (case_id, reply, intent, escalate)."""
    return cases.select(
        "case_id",
        F.col("brand_response").alias("reply"),
        silver_label(tag_intents("customer_message", lexicon), other).alias("intent"),
        silver_escalation("num_turns", escalate_turns).alias("escalate"),
    )


def majority_predict(train: DataFrame, queries: DataFrame, label: str = "intent") -> DataFrame:
    """Q1: the commonest training label for every query, never escalated."""
    best = majority_label(train, label).select(label).scalar()
    return queries.select(
        "query_id",
        F.coalesce(best, F.lit(OTHER)).alias("intent"),
        F.lit(False).alias("escalate"),
        F.lit(STOCK_REPLY).alias("reply"),
        F.lit(0.0).alias("retrieval_similarity"),
    )


def knn_predict(
    queries: DataFrame,
    hits: DataFrame,
    train: DataFrame,
    k: int = 3,
    threshold: float = 0.1,
    other: str = OTHER,
) -> DataFrame:
    """Q2-Q5: vote of the retrieved cases.

    ``hits`` is the output of retrieval, ``train`` (case_id, intent, escalate,
    reply). The intent with most votes wins, the one of the nearest case on a
    tie. Escalation needs votes from half of k, also when fewer cases exist.
    Votes are counted without texts; the reply is fetched for the nearest case alone.
    """
    votes = cut_lineage(hits.join(train.select("case_id", "intent", "escalate"), "case_id"))
    per_intent = votes.groupBy("query_id", "intent").agg(
        F.count("*").alias("votes"), F.min("rank").alias("nearest")
    )
    winner = per_intent.groupBy("query_id").agg(
        F.max_by("intent", F.struct(F.col("votes"), -F.col("nearest"))).alias("voted")
    )
    near = votes.groupBy("query_id").agg(
        F.sum(F.col("escalate").cast("int")).alias("escalations"),
        F.min_by("case_id", "rank").alias("case_id"),
        F.max("similarity").alias("top"),
    )
    near_enough = near.where(F.col("top") >= threshold).select("query_id", "case_id")
    replies = found_cases(near_enough, train.select("case_id", "reply"))
    replies = replies.groupBy("query_id").agg(F.min("reply").alias("best_reply"))
    near = near.join(replies, "query_id", "left")
    rows = queries.select("query_id").join(near.join(winner, "query_id"), "query_id", "left")
    top = F.coalesce("top", F.lit(0.0))
    far = top < threshold
    reply = F.coalesce(F.nullif("best_reply", F.lit("")), F.lit(SHORT_STOCK_REPLY))
    return rows.select(
        "query_id",
        F.when(far, F.lit(other)).otherwise(F.col("voted")).alias("intent"),
        F.when(far, F.lit(True)).otherwise(F.col("escalations") >= k / 2.0).alias("escalate"),
        F.when(far, F.lit(STOCK_REPLY)).otherwise(reply).alias("reply"),
        top.alias("retrieval_similarity"),
    )


def unfitted_predict(queries: DataFrame, other: str = OTHER) -> DataFrame:
    """Q5 without any training case: other, not escalated, empty reply."""
    return queries.select(
        "query_id",
        F.lit(other).alias("intent"),
        F.lit(False).alias("escalate"),
        F.lit("").alias("reply"),
        F.lit(0.0).alias("retrieval_similarity"),
    )


def prompt_text(width: int = 200) -> Column:
    """Q6: prompt from columns customer_message, context, confidence, evidence.

    ``context`` is an array of (speaker, text), ``evidence`` the ordered cases.
    """
    lines = F.transform(
        "context", lambda t: F.concat(F.lit("- "), F.upper(t["speaker"]), F.lit(": "), t["text"], F.lit("\n"))
    )
    has_context = F.coalesce(F.size("context") > 0, F.lit(False))
    context = F.when(
        has_context,
        F.concat(F.lit("CONVERSATION CONTEXT:\n"), F.array_join(lines, ""), F.lit("\n")),
    ).otherwise("")
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(width))
    cases = F.transform(
        "evidence",
        lambda e, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] (sim="),
            F.format_string("%.2f", e["similarity"]), F.lit(") Q: "), cut(e["customer_message"]),
            F.lit("\nA: "), cut(e["brand_response"]), F.lit("\n"),
        ),
    )
    has_evidence = F.coalesce(F.size("evidence") > 0, F.lit(False))
    evidence = F.when(has_evidence, F.array_join(cases, "")).otherwise("None.\n")
    return F.concat(
        F.lit("CUSTOMER MESSAGE:\n"), F.col("customer_message"), F.lit("\n\n"), context,
        F.lit("RETRIEVAL CONFIDENCE: "), F.col("confidence"), F.lit("\n\nEVIDENCE:\n"), evidence,
    )


def draft(
    prompts: DataFrame, drafter: Callable[[str], Mapping[str, object]], columns: str = "prompt"
) -> DataFrame:
    """Q7: call ``drafter`` on every prompt, in Arrow batches on the executors.

    The drafter returns intent, intent_confidence, reply, escalate and
    escalation_reason. When it raises, the row becomes a fallback record that
    escalates and carries the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        names = [f.split()[0] for f in DRAFT_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for query_id, prompt in zip(batch["query_id"], batch[columns]):
                try:
                    got = drafter(prompt)
                    rows.append(
                        (str(query_id), got["intent"], float(got["intent_confidence"]), got["reply"],
                         bool(got["escalate"]), got.get("escalation_reason"), None)
                    )
                except Exception as error:  # any failure of the callable is data here
                    reason = f"LLM Generation/Parsing Error: {error}"
                    rows.append((str(query_id), OTHER, 0.0, OUTAGE_REPLY, True, reason, str(error)))
            yield pd.DataFrame(rows, columns=names)

    return prompts.select("query_id", columns).mapInPandas(run, DRAFT_SCHEMA)


def extractive_draft(predictions: DataFrame) -> DataFrame:
    """Q4/Q7 default drafter: the nearest reply, as a draft table without Python."""
    return predictions.select(
        "query_id",
        "intent",
        F.col("retrieval_similarity").alias("intent_confidence"),
        "reply",
        "escalate",
        F.when(F.col("escalate"), "similar past cases were long").alias("escalation_reason"),
        F.lit(None).cast("string").alias("api_error"),
    )


def evidence_text(evidence: Column | str = "evidence") -> Column:
    """All retrieved replies, joined and lower-cased."""
    evidence = F.col(evidence) if isinstance(evidence, str) else evidence
    replies = F.transform(evidence, lambda e: F.lower(F.coalesce(e["brand_response"], F.lit(""))))
    return F.coalesce(F.array_join(replies, " "), F.lit(""))


def grounding_failures(
    evidence: Column,
    intents: Sequence[str] = INTENTS,
    max_words: int = 150,
    actions: Sequence[str] = COMPLETED_ACTIONS,
    allowed_links: Sequence[str] = ALLOWED_LINK_WORDS,
    strict_case: bool = False,
    substring_amounts: bool = False,
) -> Column:
    """Q8-Q14: ordered list of failure messages for a drafted reply.

    Reads columns intent, reply, escalate, escalation_reason; ``evidence`` is
    lower-cased text. Amounts are compared as whole amounts, so $5 is not backed
    by $50; ``substring_amounts`` restores the looser test. Links are compared
    without case; ``strict_case`` restores the case-sensitive test, under which
    a mixed-case link never matches.
    """
    reply = F.coalesce(F.col("reply"), F.lit(""))
    low = F.lower(reply)
    words = word_count(reply)
    known = F.coalesce(F.col("intent").isin(list(intents)), F.lit(False))
    no_reason = F.coalesce(F.col("escalation_reason"), F.lit("")) == ""
    # The failure messages.
    single = F.array(
        F.when(~known, F.concat(F.lit("Invalid intent: "), F.coalesce("intent", F.lit("")))),
        F.when(words == 0, F.lit("Empty reply generated.")).when(
            words > max_words,
            F.concat(F.lit("Reply exceeds maximum length ("), words, F.lit(" words).")),
        ),
        F.when(
            F.col("escalate") & no_reason,
            F.lit("Escalate set to true but missing escalation reason."),
        ),
    )
    amounts = F.regexp_extract_all(reply, F.lit(f"({AMOUNT_PATTERN})"), 1)
    backed = F.regexp_extract_all(evidence, F.lit(f"({AMOUNT_PATTERN})"), 1)
    if substring_amounts:
        loose = F.filter(amounts, lambda a: ~F.contains(evidence, a))
    else:
        loose = F.filter(amounts, lambda a: ~F.array_contains(backed, a))
    money = F.transform(loose, lambda a: F.concat(F.lit("Unsupported monetary amount generated: "), a))
    phrases = F.array(*[F.lit(p) for p in actions])
    claims = F.transform(
        F.filter(phrases, lambda p: F.contains(low, p) & ~F.contains(evidence, p)),
        lambda p: F.concat(F.lit("Unsupported claim of completed action: '"), p, F.lit("'")),
    )
    links = F.regexp_extract_all(reply, F.lit(f"({LINK_PATTERN})"), 1)

    def unbacked(url: Column) -> Column:
        allowed = F.lit(False)
        for word in allowed_links:
            allowed = allowed | F.contains(F.lower(url), F.lit(word))
        return ~allowed & ~F.contains(evidence, url if strict_case else F.lower(url))

    urls = F.transform(
        F.filter(links, unbacked), lambda u: F.concat(F.lit("Unsupported URL generated: "), u)
    )
    return F.concat(F.filter(single, lambda m: m.isNotNull()), money, claims, urls)


def apply_safety(drafts: DataFrame, **rules: object) -> DataFrame:
    """Q8-Q16: check drafts against their evidence and override the unsafe ones.

    ``drafts`` has the draft columns and ``evidence``, which is always what was
    retrieved. Failed calls keep their fallback record, marked "LLM Error".
    """
    checked = drafts.withColumn("_text", evidence_text())
    failures = F.when(
        has_error(), F.array(F.lit("LLM Error"))
    ).otherwise(grounding_failures(F.col("_text"), **rules))
    checked = checked.withColumn("validation_failures", failures)
    unsafe = ~has_error() & (F.size("validation_failures") > 0)
    reason = F.concat(
        F.lit("Grounding Validation Failures: "), F.array_join("validation_failures", ", ")
    )
    prior = F.nullif("escalation_reason", F.lit(""))
    return checked.select(
        "query_id",
        "intent",
        "intent_confidence",
        F.when(unsafe, F.lit(HANDOVER_REPLY)).otherwise(F.col("reply")).alias("reply"),
        F.when(unsafe, F.lit(True)).otherwise(F.col("escalate")).alias("escalate"),
        F.when(unsafe, F.concat_ws(" | ", prior, reason))
        .otherwise(F.col("escalation_reason"))
        .alias("escalation_reason"),
        "evidence",
        "validation_failures",
        F.when(unsafe, F.col("reply")).alias("original_draft"),
        "api_error",
    )
