"""Corpus cleaning rules (§2.3).  Each rule is a *keep* condition.

Rules that look only at the row are ``Column`` builders (native, codegen);
rules that need another table (sites, labels, perplexity) are semi-joins.
``clean`` applies a preset in cost order (cheap filters first, joins next,
the perplexity join last); ``funnel`` counts what each rule removes in one
aggregation pass.  Thresholds without a published value have no default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankshift.functions.text import (PUNCT, letter_count, safe_div, sentence_count, url_host,
                                      word_tokens)

# Fixed values stated by the reference (prepare_data notes): token limit,
# letter minimum, target-language word share, and site markup markers.
MAX_TOKENS = 1000
MIN_LETTERS = 200
MIN_WORD_SHARE = 0.7
MARKUP_MARKERS = ("Мне нравится:", "Комментарии:", "Оценивайте пожалуйста:", "Дата обращения:")
RUSSIAN_WORD = "^[а-яё]+$"

# Our word patterns for the four test languages (letters of each alphabet).
LANG_WORD = {
    "en": "^[a-z]+$",
    "de": "^[a-zäöüß]+$",
    "fr": "^[a-zàâæçéèêëîïôœùûüÿ]+$",
    "es": "^[a-záéíñóúü]+$",
    "ru": RUSSIAN_WORD,
}


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Tokenize once; every token rule reads this column.

    The column comes out of a one-element ``inline_outer``: filters are not pushed
    below it and its expression is not copied into each rule."""
    return df.drop(out).select("*", F.inline_outer(F.array(F.struct(word_tokens(text).alias(out)))))


# --------------------------------------------------------------- row rules

def max_tokens(n: int = MAX_TOKENS, tokens: str = "tokens") -> Column:
    """CLN1: token count < n."""
    return F.size(tokens) < n


def min_letters(n: int = MIN_LETTERS, text: str = "text") -> Column:
    """CLN2: letter count > n."""
    return letter_count(text) > n


def word_share_value(patterns: str | dict, tokens: str = "tokens", lang: str = "lang") -> Column:
    t = F.col(tokens)

    def n_matching(pat: str) -> Column:
        return F.size(F.filter(t, lambda x: x.rlike(pat)))

    if isinstance(patterns, str):
        hits = n_matching(patterns)
    else:
        hits = F.lit(0)
        for code, pat in patterns.items():
            hits = F.when(F.col(lang) == code, n_matching(pat)).otherwise(hits)
    return safe_div(hits, F.size(t))


def word_share(patterns: str | dict = RUSSIAN_WORD, t: float = MIN_WORD_SHARE,
               tokens: str = "tokens", lang: str = "lang") -> Column:
    """CLN3: share of target-language words >= t (empty text: share 0)."""
    return word_share_value(patterns, tokens, lang) >= t


_META = set("\\.^$|?*+()[]{}")


def _rx_escape(text: str) -> str:
    return "".join("\\" + ch if ch in _META else ch for ch in text)


def markup_regex(markers: Sequence[str]) -> str:
    return "(" + "|".join(_rx_escape(m) for m in markers) + ")"


def cut_markup(df: DataFrame, markers: Sequence[str] = MARKUP_MARKERS, mode: str = "cut",
               text: str = "text") -> DataFrame:
    """CLN5: remove site markup found by marker phrases.  ``cut`` keeps the
    text before the first marker; ``line`` drops every line holding one."""
    rx = markup_regex(markers)
    if mode == "cut":
        return df.withColumn(text, F.regexp_replace(F.col(text), "(?s)" + rx + ".*$", ""))
    if mode == "line":
        lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
        return df.withColumn(text, F.array_join(F.filter(lines, lambda l: ~l.rlike(rx)), "\n"))
    raise ValueError(mode)


def not_query_copy(max_dist: int, query: str = "query", text: str = "text") -> Column:
    """CLN8: drop texts equal to the query or within ``max_dist`` edits.

    Edit distance is at least the length difference, so it is computed only
    when lengths are within ``max_dist``; levenshtein with a threshold stops
    early (-1 above it)."""
    q, t = F.coalesce(F.col(query), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    close = F.abs(F.length(q) - F.length(t)) <= max_dist
    copy = (q == t) | (close & (F.levenshtein(q, t, max_dist) >= 0))
    return ~copy


def unique_share_value(tokens: str = "tokens", denominator: str = "words", text: str = "text") -> Column:
    den = F.size(tokens) if denominator == "words" else F.length(F.col(text))
    return safe_div(F.size(F.array_distinct(F.col(tokens))), den)


def min_unique_share(t: float, tokens: str = "tokens", denominator: str = "words") -> Column:
    """CLN9: unique words / length >= t."""
    return unique_share_value(tokens, denominator) >= t


def longest_word(tokens: str = "tokens") -> Column:
    return F.coalesce(F.array_max(F.transform(F.col(tokens), lambda x: F.length(x))), F.lit(0))


def max_word_len(t: int, tokens: str = "tokens") -> Column:
    """CLN10: longest word <= t."""
    return longest_word(tokens) <= t


def min_sentences(t: int, text: str = "text") -> Column:
    """CLN11: at least t sentences."""
    return sentence_count(text) >= t


def has_punctuation(text: str = "text") -> Column:
    """CLN12: some punctuation present."""
    return F.coalesce(F.col(text), F.lit("")).rlike(PUNCT)


def non_letter_share_value(text: str = "text") -> Column:
    t = F.coalesce(F.col(text), F.lit(""))
    return F.lit(1.0) - safe_div(letter_count(text), F.length(t))


def non_letter_share(t: float, op: str = "<", text: str = "text") -> Column:
    """CLN13: drop rows whose non-letter share is ``op`` t (printed as "<")."""
    v = non_letter_share_value(text)
    return ~(v < t) if op == "<" else ~(v > t)


# -------------------------------------------------------------- join rules

def site_match(hosts: Sequence[str], url: str = "url") -> Column:
    """Host equals one of ``hosts`` or is a subdomain of one (literal list)."""
    h = url_host(url)
    cond = F.lit(False)
    for site in hosts:
        site = site.lower()
        cond = cond | (h == site) | h.endswith("." + site)
    return cond


def on_sites(df: DataFrame, hosts: Sequence[str] | DataFrame, url: str = "url", key: str | None = None) -> DataFrame:
    """CLN4: keep rows whose URL host is one of ``hosts`` or a subdomain.

    A literal host list is a native condition.  A host *table* of any size is
    matched by exploding every suffix of the host (a.b.c -> a.b.c, b.c, c)
    and semi-joining, keyed by a row id, so no broadcast guess is needed
    (AQE broadcasts the host table when it is small)."""
    if not isinstance(hosts, DataFrame):
        return df.where(site_match(hosts, url))
    parts = F.split(url_host(url), r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                           lambda i: F.array_join(F.slice(parts, i, n), "."))
    if key is not None:
        keyed, rid = df, key
    else:
        # row ids must be identical on both sides of the semi-join: write them once
        from rankshift.session import materialize
        keyed, rid = materialize(df.withColumn("_rid", F.monotonically_increasing_id()), "site_rows"), "_rid"
    hits = (keyed.select(rid, F.explode(suffixes).alias("site"))
            .join(hosts.select(F.lower("site").alias("site")).distinct(), "site").select(rid))
    out = keyed.join(hits, rid, "left_semi")
    return out.drop("_rid") if key is None else out


def with_label(df: DataFrame, labels: DataFrame, value: int = 3, key: str = "doc_id",
               label: str = "label") -> DataFrame:
    """CLN6: keep rows whose assessor label equals ``value``."""
    good = labels.where(F.col(label) == value).select(key).distinct()
    return df.join(good, key, "left_semi")


# ---------------------------------------------------------------- presets

def row_rules(preset: str, params: dict) -> list[tuple[str, Column]]:
    """Native keep-conditions of a preset, cheapest first."""
    common = [
        ("min_letters", min_letters(params.get("min_letters", MIN_LETTERS))),
        ("max_tokens", max_tokens(params.get("max_tokens", MAX_TOKENS))),
        ("word_share", word_share(params.get("word_patterns", RUSSIAN_WORD),
                                  params.get("word_share", MIN_WORD_SHARE))),
    ]
    extra = {
        "max_word_len": lambda v: max_word_len(v),
        "min_unique_share": lambda v: min_unique_share(v),
        "min_sentences": lambda v: min_sentences(v),
        "has_punctuation": lambda v: has_punctuation() if v else F.lit(True),
        "non_letter_share": lambda v: non_letter_share(v),
        "not_query_copy": lambda v: not_query_copy(v),
    }
    if preset not in ("ds1", "ds2", "common"):
        raise NotImplementedError(f"unknown preset {preset!r}")
    return common + [(k, fn(params[k])) for k, fn in extra.items() if k in params]


def clean(df: DataFrame, preset: str, params: dict | None = None, labels: DataFrame | None = None,
          ppl_keep: DataFrame | None = None) -> DataFrame:
    """CLN14: DS 1 = common + sites (+ markup cut); DS 2 = common + label
    (+ perplexity keep-list, a DataFrame of kept keys from CLN7)."""
    params = dict(params or {})
    d = df
    if preset == "ds1" and "sites" in params:
        d = on_sites(d, params["sites"])  # cheapest, most selective: first
    if preset == "ds1" and "markers" in params:
        d = with_tokens(cut_markup(d, params["markers"], params.get("markup_mode", "cut")))
    elif "tokens" not in d.columns:
        d = with_tokens(d)
    if preset == "ds2" and labels is not None:
        d = with_label(d, labels, params.get("label_value", 3), params.get("key", "doc_id"),
                       params.get("label_col", "label"))
    for _, cond in row_rules(preset, params):
        d = d.where(cond)
    if preset == "ds2" and ppl_keep is not None:
        d = d.join(ppl_keep, params.get("key", "doc_id"), "left_semi")
    return d


def funnel(df: DataFrame, preset: str, params: dict) -> DataFrame:
    """Rows entering and rows removed by each native rule, in order, in one
    aggregation pass (a row is charged to the first rule it fails)."""
    d = df if "tokens" in df.columns else with_tokens(df)
    rules = row_rules(preset, params)
    first = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        first = F.when(~cond, name).otherwise(first)
    # its own column, so that a row's rules run once and only up to the first failure
    charged = d.select(F.inline_outer(F.array(F.struct(first.alias("rule")))))
    return charged.agg(F.count(F.lit(1)).alias("n_in"),
                       *[F.count_if(F.col("rule") == name).alias(f"removed_{name}") for name, _ in rules],
                       F.count_if(F.col("rule").isNull()).alias("n_out"))
