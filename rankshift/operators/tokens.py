"""Tokenization and training-table building (§2.4).

The built-in tokenizer is the native word tokenizer; ids come from a
vocabulary table joined on the token.  Whole texts are looked up as packed
chunks: the distinct words of a chunk are joined, not the words of each text.
Texts cut to some words are regrouped after the join by their own key only, so
a group never holds more than one document.
With a vocabulary of bounded size (built with ``size``) the lookup is a
broadcast join on input pre-partitioned by the key: one shuffle (the text),
no shuffle of exploded tokens.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankshift.functions.hashing import h32, unit_hash
from rankshift.functions.text import word_tokens
from rankshift.operators import packed
from rankshift.operators.order import prefix_offsets
from rankshift.session import materialize, written

IGNORE = -100
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class SpecialTokens:
    """TOK2: reserved ids 0..k-1 of every vocabulary; ``side`` is the padding
    side (left for the GPT family)."""
    pad: str = "<pad>"
    bos: str = "<bos>"
    s: str = "<s>"
    eos: str = "</s>"
    sep: str = "<sep>"
    unk: str = "<unk>"
    mask: str = "<mask>"
    side: str = "right"

    @property
    def tokens(self) -> list[str]:
        return [self.pad, self.bos, self.s, self.eos, self.sep, self.unk, self.mask]

    def id(self, name: str) -> int:
        return self.tokens.index(getattr(self, name))


SPECIAL = SpecialTokens()
GPT_SPECIAL = SpecialTokens(side="left")


def build_vocab(df: DataFrame, tokens: str = "tokens", min_count: int = 1, size: int | None = None,
                special: SpecialTokens = SPECIAL) -> DataFrame:
    """TOK3: (tok, id, cnt); ids after the special tokens by count desc, then
    token.  Dense ids come from the bucketed prefix sum (buckets = count and
    the token's first five characters, in runs of count and first two, which
    all follow the same order)."""
    spark = df.sparkSession
    counts = (df.select(F.explode(tokens).alias("tok")).groupBy("tok")
              .agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count))
    counts = written(counts, "word_counts")  # the ranking reads it twice
    keyed = counts.withColumn("_ord", F.struct((-F.col("cnt")).alias("c"), F.col("tok").alias("t")))
    bucket, run = (F.struct((-F.col("cnt")).alias("c"), F.substring("tok", 1, n).alias("p")) for n in (5, 2))
    ranked = prefix_offsets(keyed, "_ord", None, "_r", bucket=bucket, run=run)
    if size is not None:
        ranked = ranked.where(F.col("_r") < size)
    n_sp = len(special.tokens)
    words = ranked.select("tok", (F.col("_r") + n_sp).cast("int").alias("id"), "cnt")
    sp = spark.createDataFrame([(t, i, 0) for i, t in enumerate(special.tokens)], "tok string, id int, cnt long")
    return sp.unionByName(words)


def _regroup(exploded: DataFrame, key: str, val: str, out: str, elem: str) -> DataFrame:
    """Rows (key, pos, val) back to one ordered array per key.  Rows with a
    null ``pos`` (from ``posexplode_outer`` of an empty array) keep the key
    with an empty array, so no join with the input is needed."""
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", val))
    g = exploded.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    return g.select(key, F.coalesce(F.transform("_s", lambda x: x[val]), F.array().cast(f"array<{elem}>")).alias(out))


def fit_length(ids: Column, max_len: int | None, pad: bool, pad_id: int, side: str) -> Column:
    if max_len is None:
        return ids
    ids = F.slice(ids, 1, max_len)
    if not pad:
        return ids
    fill = F.array_repeat(F.lit(pad_id), F.lit(max_len) - F.size(ids))
    return F.concat(fill, ids) if side == "left" else F.concat(ids, fill)


def encode(df: DataFrame, vocab: DataFrame, key: str = "ord", text: str = "text", out: str = "input_ids",
           max_len: int | None = None, pad: bool = False, special: SpecialTokens = SPECIAL,
           add_eos: bool = False, bounded_vocab: bool = False, partitions: int | None = None) -> DataFrame:
    """TOK1: text -> ids (unknown words -> <unk>), truncated to ``max_len`` and
    optionally padded on ``special.side``.  Returns key, ``out``.

    ``bounded_vocab=True`` (the vocabulary was built with a ``size``) writes it
    and broadcasts it if it has at most ``BROADCAST_ROWS`` rows; otherwise the
    lookup is a shuffle join keyed by token.  Words past ``max_len`` are cut
    before the lookup (one id a word)."""
    unk = special.id("unk")
    words = word_tokens(text)
    base = df.select(key, (words if max_len is None else F.slice(words, 1, max_len)).alias("_t"))
    v = vocab.select("tok", "id")
    if bounded_vocab:
        v = materialize(v, "vocab")
        if v.count() <= BROADCAST_ROWS:
            base = base.repartition(partitions, key) if partitions else base.repartition(key)
            v = F.broadcast(v)
    if max_len is None and not bounded_vocab:
        coded = packed.coded_texts(df, key, (), text)
        ids_col = F.transform("_ids", lambda x: F.coalesce(x, F.lit(unk)))
        res = packed.looked_up(coded, v.withColumnRenamed("tok", "word"), "id", key, "_ids").select(key, ids_col.alias("_ids"))
        return res.select(key, (F.concat("_ids", F.array(F.lit(special.id("eos")))) if add_eos else F.col("_ids")).alias(out))
    e = base.select(key, F.posexplode_outer("_t").alias("pos", "tok"))
    ids = e.join(v, "tok", "left").select(key, "pos", F.coalesce("id", F.lit(unk)).alias("id"))
    res = _regroup(ids, key, "id", "_ids", "int")
    ids_col = F.col("_ids")
    if add_eos:
        ids_col = F.concat(ids_col, F.array(F.lit(special.id("eos"))))
    return res.select(key, fit_length(ids_col, max_len, pad, special.id("pad"), special.side).alias(out))


def decode(df: DataFrame, vocab: DataFrame, key: str = "ord", ids: str = "input_ids", out: str = "text",
           special: SpecialTokens = SPECIAL) -> DataFrame:
    """TOK4: ids -> text (space-joined words), special tokens and -100 skipped."""
    words = vocab.where(F.col("id") >= len(special.tokens)).select(F.col("id").alias("word"), "tok")
    g = packed.looked_up(packed.coded_ids(df, key, ids), words, "tok", key, "_w")
    return g.select(key, F.array_join("_w", " ").alias(out))


def clm_text_passages(df: DataFrame, out: str = "text") -> DataFrame:
    """TOK5: for each passage in order: if selected, the query first; then the
    passage; no separators."""
    z = F.arrays_zip(F.col("passages.is_selected").alias("s"), F.col("passages.passage_text").alias("p"))
    q = F.coalesce(F.col("query"), F.lit(""))
    parts = F.transform(z, lambda x: F.when(x["s"] == 1, F.concat(q, F.coalesce(x["p"], F.lit(""))))
                        .otherwise(F.coalesce(x["p"], F.lit(""))))
    return df.withColumn(out, F.array_join(F.coalesce(parts, F.array().cast("array<string>")), ""))


def clm_text_pairs(df: DataFrame, eos: str = "</s>", out: str = "text") -> DataFrame:
    """TOK6: ``query + " " + body + eos``."""
    return df.withColumn(out, F.concat(F.coalesce("query", F.lit("")), F.lit(" "),
                                       F.coalesce("body", F.lit("")), F.lit(eos)))


def block_starts(n: Column, size: int, end: str = "exclusive") -> Column:
    """Starts of the blocks cut from a sequence of length n.  ``exclusive``
    follows the reference (starts in range(0, n - B, B): n = B gives no
    block); ``inclusive`` gives n div B blocks."""
    stop = n - size - 1 if end == "exclusive" else n - size
    return F.when(stop >= 0, F.sequence(F.lit(0), stop, F.lit(size))).otherwise(F.array().cast("array<int>"))


def cut_blocks(df: DataFrame, size: int, ids: str = "input_ids", key: str = "ord",
               end: str = "exclusive", out: str = "input_ids") -> DataFrame:
    """TOK7: blocks of ``size`` inside each document; the tail is dropped.
    Pieces are sliced before the explode, so no row carries the whole doc."""
    pieces = F.transform(block_starts(F.size(ids), size, end),
                         lambda s, i: F.struct(i.alias("block"), F.slice(ids, s + 1, size).alias("piece")))
    e = df.select(key, F.explode(pieces).alias("_b"))
    return e.select(key, F.col("_b.block").alias("block"), F.col("_b.piece").alias(out))


def pack_corpus(df: DataFrame, size: int, ids: str = "input_ids", ord_col: str = "ord",
                width: int = 100_000, out: str = "input_ids") -> DataFrame:
    """TOK8: the whole corpus in ``ord`` order cut into blocks of ``size``
    across document borders; the last short block is dropped.

    Global token offsets come from the bucketed prefix sum; each document is
    split into its per-block pieces before the explode; a block regroups at
    most ``size`` tokens.  Output: block (dense from 0), ``out``."""
    d = df.select(ord_col, F.col(ids).alias("_ids")).withColumn("_n", F.size("_ids"))
    d = prefix_offsets(d, ord_col, "_n", "_off", width).where(F.col("_n") > 0)
    first = F.floor(F.col("_off") / size)
    last = F.floor((F.col("_off") + F.col("_n") - 1) / size)

    def piece(b):
        start = F.greatest(F.col("_off"), b * size)
        stop = F.least(F.col("_off") + F.col("_n"), (b + 1) * size)
        return F.struct(b.alias("block"), start.alias("start"),
                        F.slice("_ids", (start - F.col("_off") + 1).cast("int"), (stop - start).cast("int")).alias("p"))

    e = d.select(F.explode(F.transform(F.sequence(first, last), piece)).alias("_x"))
    g = (e.select(F.col("_x.block").alias("block"), F.col("_x.start").alias("start"), F.col("_x.p").alias("p"))
         .groupBy("block").agg(F.array_sort(F.collect_list(F.struct("start", "p"))).alias("_ps")))
    flat = F.flatten(F.transform("_ps", lambda x: x["p"]))
    return g.select(F.col("block").cast("long").alias("block"), flat.alias(out)).where(F.size(out) == size)


def lm_labels(df: DataFrame, ids: str = "input_ids", out: str = "labels") -> DataFrame:
    """TOK10: labels are a copy of the inputs for causal LM."""
    return df.withColumn(out, F.col(ids))


def collate(df: DataFrame, batch: str = "batch_id", labels: str = "labels", fill: int = IGNORE) -> DataFrame:
    """TOK11: pad labels to the longest in their batch with ``fill`` (-100)."""
    longest = df.groupBy(batch).agg(F.max(F.size(labels)).alias("_m"))
    j = df.join(longest, batch)
    pad = F.array_repeat(F.lit(fill), F.col("_m") - F.size(labels))
    return j.withColumn(labels, F.concat(F.col(labels), pad)).drop("_m")


def restore_pad(col: str, pad_id: int = 0, fill: int = IGNORE) -> Column:
    """-100 -> pad id before decoding."""
    return F.transform(F.col(col), lambda x: F.when(x == fill, F.lit(pad_id)).otherwise(x))


def mask_tokens(df: DataFrame, key: str = "ord", ids: str = "input_ids", p: float = 0.15, seed: int = 0,
                vocab_size: int | None = None, special: SpecialTokens = SPECIAL) -> DataFrame:
    """TOK12: masked-LM inputs.  A position is picked when hash(1, seed, key, i)
    < p; picked positions become <mask> (80%), a random id (10%) or stay
    (10%); labels keep the original id there and -100 elsewhere.  Special
    ids are never picked."""
    n_sp = len(special.tokens)
    mask_id = special.id("mask")

    def parts(salt: int, i):
        return salt, ":", seed, ":", F.col(key), ":", i

    def u(salt: int, i):
        return unit_hash(*parts(salt, i))

    def new_id(x, i):
        r = u(2, i)
        rand_id = (h32(*parts(3, i)) % max((vocab_size or n_sp + 1) - n_sp, 1) + n_sp).cast("int")
        return F.when(r < 0.8, F.lit(mask_id)).when(r < 0.9, rand_id).otherwise(x)

    picked = lambda x, i: (x >= n_sp) & (u(1, i) < p)
    inputs = F.transform(ids, lambda x, i: F.when(picked(x, i), new_id(x, i)).otherwise(x))
    labels = F.transform(ids, lambda x, i: F.when(picked(x, i), x).otherwise(F.lit(IGNORE)))
    return df.withColumn("labels", labels).withColumn(ids, inputs)


def training_table(df: DataFrame, vocab: DataFrame, kind: str, mode: str = "clm", block: int = 128,
                   max_len: int = 128, key: str = "ord", special: SpecialTokens = SPECIAL,
                   bounded_vocab: bool = False, family: str = "gpt", split: str = "train", target_len: int | None = None,
                   prefix: str = "<LM>", context: int = 0, limit: int = 0) -> DataFrame:
    """TOK13: the table a trainer reads, by dataset kind, mode and model family.

    * ``teacher``: (key, input_ids = query ids, labels = target ids), target
      = all passages joined (nested kinds) or ``body`` (labelled kind).
      ``gpt``: query padded (left) and cut to ``max_len``; target cut to
      ``target_len``, without eos or padding; ``pos_label`` kept.
      ``t5``: ``prefix`` + query, padded (right) and cut; target + eos, cut
      and padded.  ``t5`` with split ``validation``: the inputs only.
    * ``clm``, nested kinds: TOK5 text -> ids, cut to ``limit`` (the tokenizer's own; 0: none) -> per-document
      blocks -> labels.
    * ``clm``, labelled kind: TOK6 text -> ids, padded up to ``context`` on ``special.side`` and never cut, so texts
      shorter than a block still give one -> per-document blocks -> labels.
    * ``full_data`` (any mode): the raw records in ``key`` order, packed into blocks across records -> labels; the
      key of the result is ``block``."""
    nested = kind in ("part_data", "made_valid_data")
    if kind == "full_data":
        raw = F.concat_ws("\t", *(c for c in ("url", "query", "body", "text") if c in df.columns))
        ids = encode(df.select(key, raw.alias("text")), vocab, key, "text", "input_ids", special=special,
                     bounded_vocab=bounded_vocab)
        return lm_labels(pack_corpus(ids, block, "input_ids", key))
    if kind not in ("part_data", "made_valid_data", "made_data"):
        raise NotImplementedError(f"unknown dataset kind {kind!r}")
    if mode == "teacher":
        tgt = (F.array_join(F.col("passages.passage_text"), "") if nested else F.col("body"))
        # PRJ5: relevance kept next to the tokens
        pos_label = F.col("passages.is_selected") if nested else F.array(F.col("label").cast("int"))
        if family not in ("gpt", "t5"):
            raise NotImplementedError(f"unknown model family {family!r}")
        gpt, cut = family == "gpt", target_len or max_len
        padding = replace(special, side="left" if gpt else "right")
        question = F.col("query") if gpt else F.concat(F.lit(prefix), "query")
        src = df.select(key, question.alias("_query"), tgt.alias("_target"), pos_label.alias("pos_label"))
        q = encode(src, vocab, key, "_query", "input_ids", max_len, True, padding, bounded_vocab=bounded_vocab)
        if not gpt and split == "validation":
            return q
        t = encode(src, vocab, key, "_target", "labels", cut, not gpt, padding, add_eos=not gpt,
                   bounded_vocab=bounded_vocab)
        return q.join(t, key).join(src.select(key, "pos_label"), key) if gpt else q.join(t, key)
    if mode != "clm":
        raise NotImplementedError(f"unknown training mode {mode!r}")
    text = clm_text_passages(df) if nested else clm_text_pairs(df, special.eos)
    ids = encode(text.select(key, "text"), vocab, key, "text", "input_ids", (limit or None) if nested else None,
                 special=special, bounded_vocab=bounded_vocab)
    if not nested and context:
        fill = F.array_repeat(F.lit(special.id("pad")), F.greatest(F.lit(context) - F.size("input_ids"), F.lit(0)))
        ids = ids.withColumn("input_ids", F.concat(*((fill, "input_ids") if special.side == "left" else ("input_ids", fill))))
    return lm_labels(cut_blocks(ids, block, "input_ids", key))


def encode_external(df: DataFrame, encode_batch, key: str = "ord", text: str = "text", out: str = "input_ids",
                    max_len: int | None = None, pad: bool = False, special: SpecialTokens = SPECIAL) -> DataFrame:
    """TOK1 with a pre-trained tokenizer (BPE / SentencePiece): ``encode_batch``
    maps a list of texts to a list of id lists and runs in an Arrow-batched
    pandas UDF (build the tokenizer once per worker inside it).  Truncation
    and padding stay native."""
    import pandas as pd

    def _enc(s):
        return pd.Series([list(map(int, ids)) for ids in encode_batch(s.fillna("").tolist())])

    _enc.__annotations__ = {"s": pd.Series, "return": pd.Series}
    ids = F.pandas_udf(_enc, "array<int>")(F.col(text))
    return df.select(key, fit_length(ids, max_len, pad, special.id("pad"), special.side).alias(out))
