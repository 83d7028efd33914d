"""Rule-based intent tagging (R1-R8). Rules are columns, so text is read once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.lexicons import BOUNDARY_RULES, INTENT_HINTS, OTHER
from threadloom.functions.ordering import sample_key
from threadloom.functions.text import WORD, bind, contains_any

#: (intent, keywords, negations, confusable intents, action)
Rule = tuple[str, Sequence[str], Sequence[str], Sequence[str], str]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mentions(text: Column, words: Sequence[str], whole_word: bool) -> Column:
    """Substring hit as in the default rules, or a hit on word borders."""
    lowered = [w.lower() for w in words if w]
    if not whole_word:
        return contains_any(text, lowered)
    hit = F.lit(False)
    for w in lowered:
        quoted = "".join("\\" + ch if not (ch.isalnum() or ch == " ") else ch for ch in w)
        hit = hit | text.rlike(f"(?<!{WORD}){quoted}(?!{WORD})")
    return hit


def tag_intents(
    text: Column | str,
    lexicon: Mapping[str, Sequence[str]] = INTENT_HINTS,
    whole_word: bool = False,
) -> Column:
    """Array of every intent with a keyword in the text, in lexicon order."""

    def hits(low: Column) -> Column:
        marks = [F.when(_mentions(low, words, whole_word), F.lit(i)) for i, words in lexicon.items()]
        return F.array_compact(F.array(*marks))

    return bind(F.lower(_col(text)), hits)


def silver_label(tags: Column | str, other: str = OTHER) -> Column:
    """The only hit, else other."""
    tags = _col(tags)
    return F.when(F.size(tags) == 1, F.get(tags, F.lit(0))).otherwise(F.lit(other))


def silver_escalation(num_turns: Column | str, at_least: int = 5) -> Column:
    """Long conversations count as escalated."""
    return _col(num_turns) >= at_least


def rule_classes(
    low: Column, rules: Sequence[Rule] = BOUNDARY_RULES
) -> tuple[list[Column], list[Column]]:
    """R2 per rule on lower-cased text: (strong, false positive). A negation turns a hit
    into the latter."""
    strong, doubtful = [], []
    for rule in rules:
        hit = _mentions(low, rule[1], False)
        negated = _mentions(low, rule[2], False)
        strong.append(hit & ~negated)
        doubtful.append(hit & negated)
    return strong, doubtful


def match_rules(
    messages: DataFrame, text: str, rules: Sequence[Rule] = BOUNDARY_RULES
) -> DataFrame:
    """R2: one row per (message, rule hit) with its class and the rule's priority."""

    def classes(low: Column) -> Column:
        strong, doubtful = rule_classes(low, rules)
        marks = [
            F.when(
                s | d,
                F.struct(
                    F.lit(i).alias("priority"),
                    F.lit(rule[0]).alias("intent_id"),
                    F.when(s, "strong").otherwise("false_positive").alias("match"),
                ),
            )
            for i, (rule, s, d) in enumerate(zip(rules, strong, doubtful))
        ]
        return F.array_compact(F.array(*marks))

    hits = bind(F.lower(_col(text)), classes)
    return messages.withColumn("_hits", hits).select(*messages.columns, F.inline("_hits"))


def assign_by_priority(
    text: Column | str, rules: Sequence[Rule] = BOUNDARY_RULES, other: str = OTHER
) -> Column:
    """The first rule in order that matches strongly, else other."""

    def first(low: Column) -> Column:
        strong, _ = rule_classes(low, rules)
        marks = [F.when(s, F.lit(rule[0])) for rule, s in zip(rules, strong)]
        return F.coalesce(*marks, F.lit(other))

    return bind(F.lower(_col(text)), first)


def prevalence(
    messages: DataFrame, text: str, rules: Sequence[Rule] = BOUNDARY_RULES, other: str = OTHER
) -> DataFrame:
    """Messages and share per intent, intents without any included."""
    counts = messages.groupBy(assign_by_priority(text, rules, other).alias("intent_id")).agg(
        F.count("*").alias("total_matches")
    )
    dim = messages.sparkSession.createDataFrame(
        [(i, name) for i, name in enumerate([*[r[0] for r in rules], other])],
        "priority int, intent_id string",
    )
    total = counts.agg(F.sum("total_matches")).scalar()
    found = F.coalesce("total_matches", F.lit(0))
    return dim.join(counts, "intent_id", "left").select(
        "priority",
        "intent_id",
        found.alias("total_matches"),
        F.coalesce(F.try_divide(found.cast("double"), total), F.lit(0.0)).alias(
            "estimated_prevalence"
        ),
    )


def coverage(prevalences: DataFrame, other: str = OTHER) -> DataFrame:
    """Share of messages that some rule takes, and the rest."""
    rest = F.sum(F.when(F.col("intent_id") == other, F.col("total_matches")))
    total = F.sum("total_matches")
    return prevalences.agg(total.alias("sample_size"), rest.alias("other_count")).select(
        "sample_size",
        "other_count",
        (1.0 - F.try_divide(F.col("other_count").cast("double"), F.col("sample_size"))).alias(
            "coverage"
        ),
    )


def rule_examples(
    messages: DataFrame,
    text: str,
    key: str,
    rules: Sequence[Rule] = BOUNDARY_RULES,
    other: str = OTHER,
    strong: int = 15,
    doubtful: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Seeded example picks per intent: assigned messages and false positives."""
    assigned = messages.select(
        key, text, assign_by_priority(text, rules, other).alias("intent_id"), F.lit("strong").alias("match")
    )
    wrong = (
        match_rules(messages.select(key, text), text, rules)
        .where(F.col("match") == "false_positive")
        .select(key, text, "intent_id", "match")
    )
    order = W.partitionBy("intent_id", "match").orderBy(sample_key(seed, key), key)
    ranked = assigned.unionByName(wrong).withColumn("rank", F.row_number().over(order))
    quota = F.when(F.col("match") == "strong", strong).otherwise(doubtful)
    return ranked.where(F.col("rank") <= max(strong, doubtful)).where(F.col("rank") <= quota)


def taxonomy_report(
    messages: DataFrame,
    text: str,
    key: str,
    rules: Sequence[Rule] = BOUNDARY_RULES,
    other: str = OTHER,
) -> DataFrame:
    """One row per intent with prevalence, action, confusable intents and examples."""
    info = messages.sparkSession.createDataFrame(
        [(r[0], list(r[3]), r[4]) for r in rules] + [(other, [], "KEEP")],
        "intent_id string, confusable_intents array<string>, recommended_action string",
    )
    picks = rule_examples(messages, text, key, rules, other)
    entry = F.struct("rank", F.col(text).alias("text"))
    listed = lambda kind: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("match") == kind, entry))), lambda e: e["text"]
    )
    examples = picks.groupBy("intent_id").agg(
        listed("strong").alias("representative_examples"),
        listed("false_positive").alias("false_positive_examples"),
    )
    return (
        prevalence(messages, text, rules, other)
        .join(info, "intent_id")
        .join(examples, "intent_id", "left")
        .orderBy("priority")
    )
