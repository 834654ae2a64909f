"""Text expressions built only from built-in Spark functions.

All of them return ``Column`` objects, so they stay inside whole-stage
codegen and are re-usable in ``select``/``where`` of any operator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (word = run of Unicode letters or digits).
WORD_SPLIT = r"[^\p{L}\p{N}]+"
NON_LETTER = r"[^\p{L}]"
PUNCT = r"\p{P}"
SENTENCE_END = r"[.!?]+"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(text) -> Column:
    """Lower-cased word tokens; empty text gives an empty array."""
    t = F.lower(F.regexp_replace(F.coalesce(_c(text), F.lit("")), WORD_SPLIT, " "))
    return F.filter(F.split(t, " "), lambda x: x != "")


def letter_count(text) -> Column:
    return F.length(F.regexp_replace(F.coalesce(_c(text), F.lit("")), NON_LETTER, ""))


def space_words(text) -> Column:
    """Words split on single spaces (the split used for length cuts)."""
    return F.split(F.coalesce(_c(text), F.lit("")), " ")


def head_words(text, n: int) -> Column:
    """First ``n`` space-separated words of ``text``."""
    return F.array_join(F.slice(space_words(text), 1, n), " ")


def sentence_count(text) -> Column:
    pieces = F.split(F.coalesce(_c(text), F.lit("")), SENTENCE_END)
    return F.size(F.filter(pieces, lambda s: F.trim(s) != ""))


def url_host(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), HOST, 1))


def safe_div(num, den) -> Column:
    """num / den as double, 0 when den = 0 (ANSI mode raises otherwise)."""
    den = _c(den)
    return F.when(den == 0, F.lit(0.0)).otherwise(_c(num).cast("double") / den)


def with_term_counts(df, tokens: str, out: str = "terms"):
    """Add ``out`` = array<struct<tok, tf>>: the distinct tokens of each row
    with their counts, computed inside the row (sort, then run lengths), so
    no shuffle is needed to count terms of a document.  Each step is its own
    projection: lambdas only index materialised columns (linear work)."""
    s = df.withColumn("_srt", F.sort_array(F.col(tokens)))
    s = s.withColumn("_st", F.when(F.size("_srt") == 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(1), F.size("_srt")),
                 lambda i: (i == 1) | (F.element_at("_srt", i) != F.element_at("_srt", F.greatest(i - 1, F.lit(1)))))))
    s = s.withColumn(out, F.transform("_st", lambda st, j: F.struct(
        F.element_at("_srt", st).alias("tok"),
        (F.coalesce(F.try_element_at("_st", j + 2), F.size("_srt") + 1) - st).cast("long").alias("tf"))))
    return s.drop("_srt", "_st")
