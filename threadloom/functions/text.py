"""Text cleaning as Column expressions (T1-T7), all inside the JVM.

Character classes are written out so that a word character and white space
mean the Unicode sets, not the ASCII ones that ``\\w`` and ``\\s`` stand for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.lexicons import CONTRAST_WORDS, PRAISE_WORDS, STOP_WORDS

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
SPACES = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SOLID = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
MENTION = "@" + WORD + "+"
URL = "http" + SOLID + "+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters of text whose tokens one task counts.
PART_CHARS = 8 * 1024 * 1024
DIGITS_ONLY = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop white space of any kind from both ends."""
    return F.trim(_col(c), F.lit(SPACES))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_words(c: Column, n: int) -> Column:
    """At least ``n`` words; stops reading after the n-th."""
    return c.rlike(f"{SOLID}+(?:{SPACE}+{SOLID}+){{{n - 1}}}")


def word_count(c: Column | str) -> Column:
    """Number of runs of non-space characters."""
    return F.regexp_count(_col(c), F.lit(SOLID + "+"))


def drop_links(c: Column | str) -> Column:
    """Drop mentions, then links, then outer white space."""
    bare = F.regexp_replace(_col(c), MENTION, "")
    return strip(F.regexp_replace(bare, URL, ""))


def is_valid_message(c: Column | str, min_chars: int = 15, min_words: int = 3) -> Column:
    """Enough characters and words once mentions and links are gone."""
    return bind(
        drop_links(strip(c)), lambda s: (F.length(s) >= min_chars) & has_words(s, min_words)
    )


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True when the text contains any of the words as a substring."""
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def is_support_message(
    c: Column | str,
    praise: Iterable[str] = PRAISE_WORDS,
    contrast: Iterable[str] = CONTRAST_WORDS,
    min_chars: int = 15,
    min_words: int = 4,
    praise_below_words: int = 10,
) -> Column:
    """As T1, and short pure praise is dropped too."""

    def keep(clean: Column) -> Column:
        short = ~has_words(clean, praise_below_words)
        pure_praise = short & contains_any(clean, praise) & ~contains_any(clean, contrast)
        return (F.length(clean) >= min_chars) & has_words(clean, min_words) & ~pure_praise

    return bind(drop_links(F.lower(_col(c))), keep)


def norm_key(c: Column | str) -> Column:
    """Lower, strip, collapse white space: the key of T4."""
    return F.regexp_replace(strip(F.lower(_col(c))), SPACE + "+", " ")


def distinct_messages(
    turns: DataFrame,
    predicate: Column,
    conv: str = "conversation_id",
    order: str = "turn_number",
    text: str = "text",
    speaker: str | None = "speaker",
) -> DataFrame:
    """T4: valid customer messages, the first of each normalised text.

    The minimum of a struct is combined before the shuffle, so one text that
    fills a third of the table costs one row per task.
    """
    rows = turns if speaker is None else turns.where(F.col(speaker) == "customer")
    first = F.min(F.struct(F.col(conv), F.col(order), F.col(text))).alias("m")
    return (
        rows.where(predicate)
        .groupBy(norm_key(text).alias("norm"))
        .agg(first)
        .select(f"m.{conv}", f"m.{order}", f"m.{text}", "norm")
    )


def plain_words(c: Column | str) -> Column:
    """Lower-cased text without links, mentions and ASCII punctuation."""
    bare = F.regexp_replace(F.lower(_col(c)), URL, "")
    return F.translate(F.regexp_replace(bare, MENTION, ""), PUNCTUATION, "")


def tokenize(c: Column | str, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """T5: words with links, mentions, punctuation, stop words, digits removed."""
    words = F.split(plain_words(c), SPACE + "+")
    stop = list(stop_words)
    kept = F.filter(words, lambda w: (w != "") & ~w.rlike(DIGITS_ONLY))
    return F.filter(kept, lambda w: ~w.isin(stop)) if stop else kept


def parts_of(spark: SparkSession, chars: int, of: int = PART_CHARS, least: int | None = None) -> int:
    """Partitions for text of so many characters, one per core at least: a task's share doesn't grow with the text."""
    return max(spark.sparkContext.defaultParallelism if least is None else least, -(-chars // of))


def token_rows(
    docs: DataFrame,
    doc: str,
    text: Column | str,
    stop_words: Iterable[str] = STOP_WORDS,
    also: Iterable[str] = (),
) -> DataFrame:
    """T5 in long form, one row per kept token: (doc_id, *also, term).

    The text is hashed by document before it is split: raw text is smaller
    than its tokens, and every later step per document reuses this placement.
    Its length is added up first, so that partitions are as many as it asks for.
    """
    stop = sorted(set(stop_words))
    texts = docs.select(F.col(doc).alias("doc_id"), *also, _col(text).alias("_text"))
    chars = texts.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]
    rows = (
        texts.repartition(parts_of(docs.sparkSession, chars), "doc_id")
        .select("doc_id", *also, F.explode(F.split(plain_words("_text"), SPACE + "+")).alias("term"))
        .where((F.col("term") != "") & ~F.col("term").rlike(DIGITS_ONLY))
    )
    return rows.where(~F.col("term").isin(stop)) if stop else rows


def fingerprint(c: Column | str) -> Column:
    """Lower, drop mentions and links, keep only a-z and 0-9."""
    bare = F.regexp_replace(F.lower(_col(c)), MENTION, "")
    return F.regexp_replace(F.regexp_replace(bare, URL, ""), "[^a-z0-9]", "")


def first_mention(c: Column | str) -> Column:
    """B2: first @name, lower-cased; null when there is none."""
    return F.nullif(
        F.lower(F.regexp_extract(_col(c), f"@({WORD}+)", 1)), F.lit("")
    )


def preview(c: Column | str, width: int = 80) -> Column:
    """Cut long cells and mark the cut."""
    cell = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.when(
        F.length(cell) > width, F.concat(F.left(cell, F.lit(width - 3)), F.lit("..."))
    ).otherwise(cell)
