"""Quality rules: plain text rules and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Words and neighbouring word pairs are hashed to ``BUCKETS`` buckets. Two multinomials
are counted over whole corpora: one from trusted documents, one from all. A
document's score is the mean of log p_trusted - log p_all over its n-grams, so
its length doesn't matter.

Trusted documents are counted in two halves by a hash of the id, and every document,
trusted or not, is scored with the half that its own id is not in. So no document
meets its own n-grams among the trusted ones, and scores are comparable.

The threshold is the score that all but a share of ``BELOW`` of the trusted documents
reach. It moves with the scores: the more n-grams share a bucket, the nearer all
scores are to 0. A document is kept if no rule fails and its score reaches the
threshold. Nothing is drawn at random: equal texts with equal ids get equal verdicts.

The table of log ratios has one row per bucket, whatever the corpus holds, and
is broadcast. A document's n-grams are summed in the task that reads it.

Cases: null texts count as empty: no words, so the rules fail; without trusted
documents there is no threshold and the rules alone decide; repeated rows are judged
alike; null ids are allowed and never trusted; an empty table gives an empty result;
``judge`` returns the id and its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.keyfilter import mark_maybe
from threadloom.session import cut_lineage

BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Share of the trusted documents that may score below the threshold.
BELOW = 0.01
#: Decimals of the scores from which the threshold is taken.
DECIMALS = 4
LEAST_WORDS = 10
MOST_REPEATED = 20
GRAM = 5
_WORD = "[^\\x20\\x09-\\x0D]+"
_SYMBOLS = "[#*$%&|<>]"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _pairs(left: str, right: str, shift: int) -> Column:
    """Hashes of elements ``shift`` apart. The last ``shift`` have no partner; the caller leaves them out."""
    behind = F.slice(right, shift + 1, F.size(right))
    return F.zip_with(left, behind, lambda a, b: F.xxhash64(a, b))


def with_words(docs: DataFrame, text: str) -> DataFrame:
    """Add n_words and the hashes of words (_h1) and of word pairs (_h2, one too many at the end)."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(_WORD), F.lit(0)))
    rows = rows.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    return rows.withColumn("n_words", F.size("_words").cast("long")).withColumn("_h2", _pairs("_h1", "_h1", 1))


def ngrams() -> Column:
    """Word and pair hashes of a row of ``with_words``."""
    return F.concat("_h1", F.slice("_h2", F.lit(1), F.greatest(F.lit(0), F.size("_h1") - 1)))


def with_rules(rows: DataFrame) -> DataFrame:
    """Add the counts that the rules use to rows of ``with_words``."""
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumn("_lines", lines).withColumn("_h4", _pairs("_h2", "_h2", 2))
    grams = F.slice(_pairs("_h4", "_h1", GRAM - 1), F.lit(1), F.greatest(F.lit(0), F.size("_h1") - GRAM + 1))
    rows = rows.withColumn("_grams", grams)
    # Most texts have no gram twice, and for them the count is over here.
    twice = F.size(F.array_distinct("_grams")) < F.size("_grams")
    placed = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("_placed", F.when(twice, placed))
    near = lambda i: F.get("_placed", i).getField("g")
    same = lambda x, i: F.coalesce(near(i - 1) == x["g"], F.lit(False)) | F.coalesce(near(i + 1) == x["g"], F.lit(False))
    rows = rows.withColumn("_starts", F.sort_array(F.transform(F.filter("_placed", same), lambda x: x["i"])))
    covers = F.transform("_starts", lambda p, i: F.least(F.lit(GRAM), F.coalesce(F.get("_starts", i + 1) - p, F.lit(GRAM))))
    repeated = F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", _SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(repeated, F.lit(0).cast("long")),
        }
    )


def _fold(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2)).cast("int")


def _counts(rows: DataFrame, text: str, **counts: Column) -> DataFrame:
    """(bucket, ...): n-grams per bucket; each named column counts those of the rows for which it holds."""
    grams = with_words(rows, text).select(F.explode(ngrams()).alias("g"), *[c.alias(n) for n, c in counts.items()])
    return grams.groupBy(F.pmod("g", F.lit(BUCKETS)).alias("bucket")).agg(*[F.count_if(n).alias(n) for n in counts])


def _ids(trusted: DataFrame, doc_id: str) -> DataFrame:
    return trusted.select(F.col(doc_id).alias("_id")).where("_id is not null").distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, ratio_0, ratio_1) for every bucket that any document has; ratio_k is for documents of half k. ``trusted`` holds ids."""
    key = _ids(trusted, doc_id).withColumn("_k", F.xxhash64("_id"))
    rows = docs.select(doc_id, text)
    some = mark_maybe(rows.withColumn("_k", F.xxhash64(doc_id)), key, "_k", "_maybe").where("_maybe")
    # The ids grow with the labels, so they are merged at every size and never broadcast.
    some = some.join(key.select("_id").hint("merge"), F.col(doc_id) == F.col("_id"), "left_semi")
    # A document of half 0 is scored with the trusted ones of half 1.
    halves = _counts(some, text, n_0=_fold(doc_id) == 1, n_1=_fold(doc_id) == 0)
    both = _counts(rows, text, n_all=F.lit(True)).join(halves, "bucket", "left")
    both = cut_lineage(both.select("bucket", "n_all", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_0", "n_1")]))  # read for the sums and for the ratios
    sums = both.agg(F.struct(*[F.sum(c).alias(c) for c in ("n_all", "n_0", "n_1")]).alias("s")).scalar()
    share = lambda c: F.log((F.col(c) + SMOOTHING) / (sums.getField(c) + SMOOTHING * BUCKETS))
    return both.select("bucket", *[(share(f"n_{k}") - share("n_all")).alias(f"ratio_{k}") for k in (0, 1)])


def judge(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", below: float = BELOW) -> DataFrame:
    """(id, counts, score, threshold, base_failed, kept) for every document."""
    ratios = log_ratios(docs, trusted, doc_id, text)
    rows = with_rules(with_words(docs.select(doc_id, text), text))
    # The row number tells repeated rows apart; it doesn't come into any result.
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), doc_id, *BASE, _fold(doc_id).alias("_half"), ngrams().alias("_ngrams"))
    grams = rows.select("_row", doc_id, *BASE, "_half", F.explode_outer("_ngrams").alias("_g")).withColumn("bucket", F.pmod("_g", F.lit(BUCKETS)))
    ratio = F.when(F.col("_half") == 0, F.col("ratio_0")).otherwise(F.col("ratio_1"))
    told = grams.join(F.broadcast(ratios), "bucket", "left").groupBy("_row", doc_id, *BASE).agg(F.avg(ratio).alias("score"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    told = cut_lineage(told.withColumn("base_failed", failed))  # small rows, read for the threshold and for the verdicts
    good = told.where("not base_failed").join(_ids(trusted, doc_id).hint("merge"), F.col(doc_id) == F.col("_id"), "left_semi")
    # Scores are counted by value first, so the quantile runs over at most some ten thousand of them.
    counted = good.groupBy(F.round("score", DECIMALS).alias("score")).agg(F.count("*").alias("n"))
    threshold = counted.agg(F.percentile("score", F.lit(below), F.col("n"))).scalar()
    told = told.withColumn("threshold", threshold)
    reached = F.coalesce(F.round("score", DECIMALS) >= F.col("threshold"), F.lit(True))
    return told.select(doc_id, *BASE, "score", "threshold", "base_failed", (~F.col("base_failed") & reached).alias("kept"))
