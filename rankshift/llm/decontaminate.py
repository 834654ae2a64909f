"""Benchmark decontamination by winnowing, in built-in DataFrame functions only.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.
The fingerprints of a text are the smallest ``GRAM``-gram hash of every run of
``SPAN - GRAM + 1`` neighbouring grams (leftmost on ties), each kept once.
Equal spans of ``SPAN`` words have the same smallest gram at the same place,
so both sides keep it: every shared span of ``SPAN`` words or more is found.
Fingerprints of documents join those of the benchmark on the hash; each hit
is then checked word by word and extended to both sides, so hash collisions
cannot add hits.  Items shorter than ``SPAN`` words match as a whole: for
each such length (at most ``SPAN - 1`` of them) documents also emit the hash
of every run of that many words.

A fingerprint carries the words that its check can touch and no others: the
gram with ``SPAN - GRAM`` words to each side, or the run itself for a short
length.  So rows are small however long the text, and work and shuffle grow
with its words.  The benchmark side is broadcast only if its measured bytes
are at most ``BROADCAST_BYTES``; a larger one joins by shuffle.  Documents are
read and split once; with a broadcast, only hits and one marker row a document
are shuffled, pre-aggregated.

Defined results: a null or empty text has no words and is not contaminated;
null and empty items have no windows; items without id hit and contaminate
like others but have no place in the list of ids (n_items, items); equal items
all count; very long texts and items are taken whole; rows sharing (doc_id,
text) give equal rows; an empty table of documents gives no rows, an empty
benchmark no hits.  Other columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.llm.common import ascii_lower, fresh

SPAN = 10           # words of a window
GRAM = 5            # words of a gram
AROUND = SPAN - GRAM
BROADCAST_BYTES = 16 << 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Add ``w`` (words), ``n`` (their number), ``h`` (their hashes) and ``g`` (hashes of all grams)."""
    w = F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD), lambda x: x != "")
    df = df.withColumn("w", w).withColumn("n", F.size("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - GRAM), lambda i: _run_hash(i, GRAM))
    return df.withColumn("g", F.when(F.col("n") >= GRAM, grams).otherwise(F.array().cast("array<bigint>")))


def _run_hash(at, size: int):
    """Hash of ``size`` words from 0-based ``at``."""
    return F.xxhash64(*[F.get("h", at + j) for j in range(size)])


def fingerprints(df: DataFrame, keep: list[str], short: list[int], marker: bool = False) -> DataFrame:
    """One row a fingerprint: ``keep``, n, m (length it stands for), g (hash), at (word position), c (the words
    around) and off (place of ``at`` in them).

    ``short``: lengths below SPAN for which every run of words is emitted.
    ``marker``: also one row without a hash for each input row."""
    i, many = F.col("i"), AROUND + 1
    rows = df.select(*keep, "n", "h", "g", "w", F.explode(F.sequence(F.lit(-1), F.greatest("n", F.lit(1)) - 1)).alias("i"))
    ok = (i >= 0) & (i + SPAN <= F.col("n"))
    rows = rows.select(*keep, "n", "h", "w", "i", F.when(ok, F.slice("g", i + 1, many)).alias("now"),
                       F.when(ok & (i > 0), F.slice("g", F.greatest(i, F.lit(1)), many)).alias("before"))
    place = F.array_position("now", F.array_min("now"))  # leftmost, from 1
    # the window before had its smallest gram at the same word: kept already
    seen = F.coalesce(F.array_position("before", F.array_min("before")) == place + 1, F.lit(False))
    own = F.struct(F.lit(SPAN).alias("m"), F.when(~seen, F.array_min("now")).alias("g"),
                   (i + place.cast("int") - 1).alias("at"))
    lead = F.lit(True)
    if short:
        runs = [F.struct(F.lit(m).alias("m"), F.when((i >= 0) & (i + m <= F.col("n")), _run_hash(i, m)).alias("g"),
                         i.alias("at")) for m in short]
        rows = rows.withColumn("f", F.explode(F.array(own, *runs)))
        lead = F.col("f.m") == SPAN
    else:
        rows = rows.withColumn("f", own)
    kept = F.col("f.g").isNotNull()
    if marker:
        kept = kept | ((i < 0) & lead)
    at, long_ = F.col("f.at"), F.col("f.m") == SPAN
    first = F.when(long_, F.greatest(at - AROUND, F.lit(0))).otherwise(at)
    words = F.slice("w", first + 1, F.when(long_, at - first + SPAN).otherwise(F.col("f.m")))
    return rows.where(kept).select(*keep, "n", "f.m", "f.g", F.when(i >= 0, at).alias("at"),
                                   F.when(i >= 0, words).alias("c"), F.when(i >= 0, at - first).alias("off"))


def _same(count: int, a, b):
    """Length of the common start of two runs of words, at most ``count``."""
    step = lambda n, j: F.when((n == j) & F.coalesce(a(j) == b(j), F.lit(False)), n + 1).otherwise(n)
    return F.aggregate(F.sequence(F.lit(0), F.lit(count - 1)), F.lit(0), step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text",
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, row (hash of the text), n_words, n_hit, n_items, items (array of strings, sorted), contaminated."""
    b = with_words(benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("t")), "t")
    b = b.where(F.col("n") > 0)
    short = sorted(r["n"] for r in b.where(F.col("n") < SPAN).select("n").distinct().collect())  # below SPAN values
    long_, few = b.where(F.col("n") >= SPAN), b.where(F.col("n") < SPAN)
    marks = fingerprints(long_, ["item"], [])
    if short:
        marks = marks.unionByName(fingerprints(few, ["item"], short).where(F.col("m") == F.col("n")))
    marks = marks.select(F.col("m").alias("b_m"), F.col("g").alias("b_g"), "item", F.col("c").alias("b_c"),
                         F.col("off").alias("b_off"))
    width = F.octet_length(F.array_join("b_c", "")) + 16 * F.size("b_c") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64
    size = marks.agg(F.sum(width.cast("long"))).first()[0] or 0
    marks = F.broadcast(marks) if size <= broadcast_bytes else marks

    d = with_words(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), "t")
    d = d.withColumn("row", F.xxhash64("t"))
    found = fingerprints(d, ["doc_id", "row"], short, marker=True).withColumnRenamed("n", "d_n")
    hits = found.join(marks, (F.col("m") == F.col("b_m")) & (F.col("g") == F.col("b_g")), "left")
    hits = hits.where(F.col("b_g").isNotNull() | F.col("at").isNull())
    at, off, b_off = F.col("at"), F.col("off"), F.col("b_off")

    def same(count, shift):
        return _same(count, lambda j: F.get("c", off + shift(j)), lambda j: F.get("b_c", b_off + shift(j)))

    hits = hits.select("doc_id", "row", "d_n", "m", "item", "b_g", at, same(SPAN - 1, lambda j: j).alias("whole"),
                       same(AROUND, lambda j: -1 - j).alias("l"), same(AROUND, lambda j: GRAM + j).alias("r"),
                       same(GRAM, lambda j: j).alias("same"))
    is_long = F.col("m") == SPAN
    real = F.when(is_long, (F.col("same") == GRAM) & (F.col("l") + F.col("r") >= AROUND)).otherwise(
        F.col("whole") >= F.col("m"))
    start = F.when(is_long, at - F.col("l")).otherwise(at)
    end = F.when(is_long, at + GRAM + F.col("r")).otherwise(at + F.col("m"))
    hits = hits.withColumn("real", F.col("b_g").isNotNull() & F.coalesce(real, F.lit(False)))
    spans = F.collect_set(F.when(F.col("real"), F.struct(start.alias("s"), end.alias("e"))))
    per_doc = hits.groupBy("doc_id", "row").agg(
        F.max("d_n").cast("long").alias("n_words"), F.count(F.when(F.col("at").isNull(), 1)).alias("copies"),
        spans.alias("spans"), F.array_sort(F.collect_set(F.when(F.col("real"), F.col("item")))).alias("items"))
    # words under the union of the spans: one fold over the sorted spans
    covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")),
                          lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"),
                                                (a["sum"] + F.greatest(x["e"] - F.greatest(a["end"], x["s"]), F.lit(0)))
                                                .cast("long").alias("sum")))
    per_doc = per_doc.withColumn("n_hit", covered["sum"])
    per_doc = per_doc.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return per_doc.select("doc_id", "row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                          (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text and any others) that hold no window of the benchmark."""
    key, row = fresh(docs, "key"), fresh(docs, "row")
    bad = (decontaminate(docs, benchmark).where("contaminated")
           .select(F.col("doc_id").alias(key), F.col("row").alias(row)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(row))
    return docs.join(bad, same, "left_anti")


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    r = decontaminate(docs, benchmark)
    return r.select("doc_id", "n_words", "n_hit", "n_items",
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {docs}),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {benchmark}),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i + 1 : i + m], ' ') AS win FROM (
         SELECT item_id, w, least(len(w), 10) AS m, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, m, i, array_to_string(w[i + 1 : i + m], ' ') AS win FROM (
         SELECT rid, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT rid, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM h) GROUP BY rid),
hi AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR) FILTER (WHERE item_id IS NOT NULL)) AS items FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
