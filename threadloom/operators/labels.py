"""Labels and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.lexicons import INTENTS, OTHER
from threadloom.functions.parsing import LABEL_NO, LABEL_YES, yes_no
from threadloom.functions.text import fingerprint, strip, word_count
from threadloom.session import loose

LABEL_FIELDS = ("human_intent", "human_escalate", "human_reason", "annotation_notes")
REQUIRED_FIELDS = (
    "example_id", "conversation_id", "customer_message", "human_intent", "human_escalate",
)


def merge_annotations(
    candidates: DataFrame, annotations: DataFrame, saved_at: str = "saved_at"
) -> DataFrame:
    """L1: candidates with their latest annotation; rows without one stay."""
    latest = annotations.groupBy("example_id").agg(
        F.max_by(F.struct(*LABEL_FIELDS), F.col(saved_at)).alias("label")
    )
    own = [c for c in candidates.columns if c not in LABEL_FIELDS]
    have = [c for c in LABEL_FIELDS if c in candidates.columns]
    joined = candidates.join(latest, "example_id", "left")
    pick = lambda c: (
        F.when(F.col("label").isNotNull(), F.col(f"label.{c}")).otherwise(F.col(c))
        if c in have
        else F.col(f"label.{c}")
    ).alias(c)
    return joined.select(
        *own, *[pick(c) for c in LABEL_FIELDS], F.col("label").isNotNull().alias("is_annotated")
    )


def annotation_progress(merged: DataFrame) -> DataFrame:
    """L2: total, completed, remaining, percent, escalation counts."""
    done = F.col("is_annotated")
    return merged.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("completed"),
        F.count_if(~done).alias("remaining"),
        F.coalesce(F.try_divide(F.count_if(done) * 100.0, F.count("*")), F.lit(0.0)).alias("pct"),
        F.count_if(done & F.coalesce("human_escalate", F.lit(False))).alias("escalate_yes"),
        F.count_if(done & ~F.coalesce("human_escalate", F.lit(True))).alias("escalate_no"),
    )


def intent_progress(merged: DataFrame, intents: Sequence[str] = INTENTS) -> DataFrame:
    """L2: annotated rows per intent, zero counts included, largest first."""
    counts = merged.where("is_annotated").groupBy("human_intent").agg(F.count("*").alias("n"))
    dim = merged.sparkSession.createDataFrame([(i,) for i in intents], "human_intent string")
    return dim.join(counts, "human_intent", "left").select(
        "human_intent", F.coalesce("n", F.lit(0)).alias("n")
    ).orderBy(F.desc("n"), "human_intent")


def blind_view(candidates: DataFrame) -> DataFrame:
    """L3: what an annotator sees: no guessed intents."""
    return candidates.drop("candidate_intents")


def label_violations(
    rows: DataFrame, expected: int | None = 200, intents: Sequence[str] = INTENTS,
    escalate_values: Sequence[str] = (*LABEL_YES, *LABEL_NO),
) -> DataFrame:
    """L4: (rule, example_id, detail) for every broken hard rule.

    ``escalate_values`` are the accepted texts; a boolean column reads as "true" and "false".

    Duplicates name every copy after the first in id order; rules on single
    rows are checked in one pass.
    """
    absent = [c for c in REQUIRED_FIELDS if c not in rows.columns]
    for c in absent:
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    entry = lambda rule, detail: F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))
    checks = [
        F.when(F.col(c).isNull(), entry("missing_field", F.lit(c)))
        for c in REQUIRED_FIELDS
    ]
    intent, escalate = F.col("human_intent"), F.col("human_escalate").cast("string")
    checks.append(
        F.when(~intent.isin(list(intents)), entry("invalid_intent", intent))
    )
    checks.append(
        F.when(
            ~escalate.isin(*escalate_values),
            entry("invalid_escalate", escalate),
        )
    )
    found = F.filter(F.array(*checks), lambda c: c.isNotNull())
    single = rows.select("example_id", F.inline(found)).select("rule", "example_id", "detail")

    ids = rows.groupBy("example_id").agg(F.count("*").alias("n")).where("n > 1")
    same_id = ids.select(
        F.lit("duplicate_id").alias("rule"), "example_id", F.col("n").cast("string").alias("detail")
    )
    keyed = rows.where("customer_message is not null").select(
        "example_id", fingerprint("customer_message").alias("fp")
    )
    firsts = keyed.groupBy("fp").agg(F.min("example_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    same_text = keyed.join(loose(firsts), "fp").where(F.col("example_id") != F.col("first")).select(
        F.lit("duplicate_message").alias("rule"), "example_id", F.col("first").cast("string").alias("detail")
    )
    out = single.unionByName(same_id).unionByName(same_text)
    if expected is not None:
        size = rows.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(
            F.lit("row_count").alias("rule"),
            F.lit(None).cast(rows.schema["example_id"].dataType).alias("example_id"),
            F.col("n").cast("string").alias("detail"),
        )
        out = out.unionByName(size)
    return out


def check_labels(rows: DataFrame, expected: int | None = 200) -> None:
    """L4: raise on the first violations found."""
    broken = label_violations(rows, expected).limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']} {r['example_id']}: {r['detail']}" for r in broken))


def label_warnings(rows: DataFrame, other: str = OTHER) -> DataFrame:
    """(example_id, warning) for rows a person should look at."""
    words = word_count("customer_message")
    notes = strip("annotation_notes")
    no_reason = F.coalesce(F.col("human_reason"), F.lit("")) == ""
    marks = F.array(
        F.when((yes_no("human_escalate", LABEL_YES) == "Yes") & no_reason, "escalate_without_reason"),
        F.when((F.coalesce("annotation_notes", F.lit("")) != "") & (F.length(notes) < 5), "short_notes"),
        F.when(F.col("human_intent") == other, "other_or_unclear"),
        F.when(words < 3, "short_message").when(words > 100, "long_message"),
    )
    return rows.select(
        "example_id", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("warning")
    )


def label_distribution(rows: DataFrame, label: str = "human_intent") -> DataFrame:
    """Count and share per label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(label, "n", (F.col("n") * 100.0 / total).alias("pct"))


def label_crosstab(
    rows: DataFrame,
    intents: Sequence[str] = INTENTS,
    label: str = "human_intent",
    flag: str = "human_escalate",
) -> DataFrame:
    """Escalated and not escalated rows per label, all labels shown."""
    counts = rows.groupBy(label).agg(
        F.count_if(yes_no(flag) == "Yes").alias("escalate_yes"),
        F.count_if(yes_no(flag) == "No").alias("escalate_no"),
    )
    dim = rows.sparkSession.createDataFrame([(i,) for i in sorted(intents)], f"{label} string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return dim.join(counts, label, "left").select(label, zero("escalate_yes"), zero("escalate_no"))
