"""Counts of n-grams for texts kept as packed chunks (GEN5, MET9).

``coded_texts`` reads and tokenizes texts once: a chunk of about ``TOKENS``
words of one group holds its distinct words and the texts as places in that
list.  ``identified`` gives every word of a group a number.  From then on a
gram is some numbers: a chunk sends each of its distinct grams once, sorted and
compressed, to the bucket of the gram's head (all words but the last), and the
bucket sends back, in the same order, the gram's count over all chunks and what
follows the head.  No gram is ever a row.

Counts are exact.  A bucket holds about ``GRAMS`` grams; a head that occurs over
``HOT`` times is dealt to several buckets by the word after it, and its sums are
added up again where they are read.  Texts of a null group are in no model.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from rankshift.functions.text import WORD_SPLIT
from rankshift.session import written

TOKENS = 1_000_000  # words of a chunk; a longer text is a chunk of its own
GRAMS = 2_000_000   # words of all texts for each bucket
HOT = 1_000_000     # occurrences of a head that one bucket counts
EOS_ID, BOS_ID, FIRST_ID = 0, 1, 2
ID_LIMIT = 1 << 31  # two numbers must fit a long
INT, LONG, DATA, WORDS = IntegerType(), LongType(), BinaryType(), ArrayType(StringType())


def _fields(first: Sequence[StructField], **others) -> StructType:
    return StructType([*first, *(StructField(name, kind) for name, kind in others.items())])


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers >= 0 as compressed planes of bytes."""
    heads, planes = [], []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<u8")
        n = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        heads.append(struct.pack("<QB", len(a), n))
        planes.append(a.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes())
    raw = b"".join(planes)
    return b"".join([struct.pack("<BQ", len(arrays), len(raw)), *heads, pa.Codec("zstd").compress(raw, asbytes=True)])


def unpack(data: bytes) -> list[np.ndarray]:
    k, size = struct.unpack_from("<BQ", data)
    raw = pa.Codec("zstd").decompress(data[9 + 9 * k:], size, asbytes=True)
    out, at = [], 0
    for i in range(k):
        rows, n = struct.unpack_from("<QB", data, 9 + 9 * i)
        a = np.zeros((rows, 8), np.uint8)
        a[:, :n] = np.frombuffer(raw, np.uint8, rows * n, at).reshape(n, rows).T
        at += rows * n
        out.append(a.view("<i8").ravel())
    return out


def ranges(starts, lengths):
    """Places of all ranges one after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _mixed(columns: Sequence[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(1)).astype(np.int64)


def distinct(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(place of each row in the distinct rows, their columns), in the order of the columns."""
    values, code = np.unique(columns[0], return_inverse=True)
    out = [values]
    for c in columns[1:]:
        m = int(c.max(initial=0)) + 1
        pairs, code = np.unique(code * m + c, return_inverse=True)
        out = [o[pairs // m] for o in out] + [pairs % m]
    return code, out


def _one(table: pa.Table, column: str):
    return table[column][0].as_py()


# ------------------------------------------------------------------ texts as chunks

def coded_texts(df: DataFrame, key: str = "doc_id", by: Sequence[str] = ("lang",), text: str = "text",
                tokens: int = TOKENS) -> DataFrame:
    """(by, chunk, keys, sizes, words, codes), written: the texts of a chunk by key and number of words, the chunk's
    distinct words, frequent ones first, and the texts' words as places in them (``pack``)."""
    cleaned = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORD_SPLIT, " "))
    return _coded(df.select(F.col(key).alias("_key"), *by, cleaned.alias("_t")), list(by), tokens)


def coded_ids(df: DataFrame, key: str, ids: str, tokens: int = TOKENS) -> DataFrame:
    """The same of arrays of numbers; null is -1."""
    return _coded(df.select(F.col(key).alias("_key"), F.col(ids).cast("array<int>").alias("_t")), [], tokens)


def _coded(rows: DataFrame, by: list[str], tokens: int) -> DataFrame:
    texts = rows.schema["_t"].dataType == StringType()
    schema = _fields([rows.schema[b] for b in by], chunk=LONG, keys=ArrayType(rows.schema["_key"].dataType), sizes=ArrayType(INT),
                     words=WORDS if texts else ArrayType(INT), codes=DATA)
    arrow = to_arrow_schema(schema)
    word = arrow.field("words").type.value_type

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, made = {}, {}, [TaskContext.get().partitionId() << 32]

        def flush(group) -> pa.RecordBatch:
            parts = held.pop(group)
            sizes.pop(group)
            flat = pa.chunked_array([p[2] for p in parts], word).dictionary_encode().unify_dictionaries().combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            places = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(-np.bincount(places, minlength=len(flat.dictionary)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            made[0] += 1
            lists = [pa.concat_arrays([p[i] for p in parts]) for i in (0, 1)]
            lists.append(flat.dictionary.take(pa.array(order)))
            columns = [pa.array([g], arrow.field(b).type) for b, g in zip(by, group)] + [pa.array([made[0]], pa.int64())]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in lists]
            columns = [c.cast(f.type) for c, f in zip([*columns, pa.array([pack(rank[places])], pa.binary())], arrow)]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = pc.split_pattern(batch["_t"], " ") if texts else batch["_t"]
            rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            if texts:
                real = pc.not_equal(flat, "")
                flat, rows = flat.filter(real), rows[real.to_numpy(zero_copy_only=False)]
            else:
                flat = pc.fill_null(flat, -1)
            n = np.bincount(rows, minlength=batch.num_rows)
            groups = list(zip(*(batch[b].to_pylist() for b in by))) if by else [()] * batch.num_rows
            of = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            group = np.array([of[g] for g in groups])
            start = np.cumsum(n) - n
            for g, i in of.items():
                at = np.flatnonzero(group == i)
                held.setdefault(g, []).append((batch["_key"].take(pa.array(at)), pa.array(n[at].astype(np.int32)),
                                               flat.take(pa.array(ranges(start[at], n[at])))))
                sizes[g] = sizes.get(g, 0) + int(n[at].sum()) + len(at)
            while sum(sizes.values()) > tokens:
                yield flush(max(sizes, key=sizes.get))
        for g in list(held):
            yield flush(g)

    return written(rows.mapInArrow(code, schema), "coded_texts", rows=256)


def looked_up(coded: DataFrame, found: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """(key, out): each text of the chunks as the array of what its words have in ``found`` (word, value), else null.
    The distinct words of a chunk are joined, not the words of texts.  Texts that share their key are merged by place."""
    kind = coded.schema["keys"].dataType.elementType, found.schema[value].dataType
    schema = StructType([StructField(key, kind[0]), StructField("_v", ArrayType(kind[1]))])
    arrow = to_arrow_schema(schema)
    asked = coded.select("chunk", F.posexplode("words").alias("pos", "word"))
    got = asked.join(found.select("word", F.col(value).alias("v")), "word").select(F.col("chunk").alias("of"), "pos", "v")

    def join(row: pa.Table, got: pa.Table) -> pa.Table:
        if not row.num_rows:
            return arrow.empty_table()
        codes, = unpack(_one(row, "codes"))
        place = np.full(int(codes.max(initial=-1)) + 1, -1)
        place[got["pos"].to_numpy()] = np.arange(got.num_rows)
        at = place[codes]
        values = pa.concat_arrays([pa.array([], got["v"].type), *got["v"].chunks]).take(pa.array(at, mask=at < 0))
        ends = np.append(0, np.cumsum(row["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
        keys = row["keys"].combine_chunks().flatten()
        return pa.table([keys.cast(arrow.field(0).type), lists.cast(arrow.field(1).type)], schema=arrow)

    t = coded.select("chunk", "keys", "sizes", "codes").groupBy("chunk").cogroup(got.groupBy("of")).applyInArrow(join, schema)
    t = t.groupBy(key).agg(F.collect_list("_v").alias("_v"))
    placed = F.flatten(F.transform("_v", lambda v: F.transform(v, lambda x, i: F.struct(i.alias("pos"), x.alias("v")))))
    merged = F.transform(F.array_sort(placed), lambda x: x["v"])
    return t.select(key, F.when(F.size("_v") == 1, F.element_at("_v", 1)).otherwise(merged).alias(out))


class Texts:
    """Chunks with numbered words, the parameters of their buckets and the fields of their groups."""

    def __init__(self, rows: DataFrame, by: list[str], buckets: int, hot: int):
        self.rows, self.by, self.buckets, self.hot, self.schema = rows, by, buckets, hot, rows.schema


def identified(trained: DataFrame, asked: DataFrame | None, by: Sequence[str], buckets: int | None = None,
               hot: int | None = None) -> Texts:
    """Both ``coded_texts`` tables (``asked`` None: the same) as (by, chunk, trained, asked, keys, sizes, codes, ids,
    counts, docs, tokens, kinds): the number and the count in the trained texts of each word of a chunk, and the
    group's trained texts, words and distinct words."""
    by, spark = list(by), trained.sparkSession
    known = F.lit(True)
    for b in by:
        known = known & F.col(b).isNotNull()
    rows = trained.withColumn("trained", known).withColumn("asked", F.lit(asked is None))
    if asked is not None:
        other = asked.withColumn("chunk", -1 - F.col("chunk")).withColumn("trained", F.lit(False)).withColumn("asked", F.lit(True))
        rows = rows.unionByName(other)
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    sizes = written(rows.where("trained").groupBy(*by).agg(F.sum(F.size("sizes")).cast("long").alias("docs"),
                                                           F.sum(total).alias("tokens")), "group_sizes")
    words = rows.agg(F.sum(total)).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    few, many = max(cores, -(-words // (GRAMS * 8))), buckets or max(cores, -(-words // GRAMS))

    group = [rows.schema[b] for b in by]
    sent = _fields(group, b=INT, chunk=LONG, trained=BooleanType(), words=WORDS, data=DATA)
    sent_arrow = to_arrow_schema(sent)

    def deal(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if any(row[b][0].as_py() is None for b in by):
                    continue
                own = row["words"].flatten()
                place, = unpack(row["codes"][0].as_py())
                times = np.bincount(place, minlength=len(own))
                to = (pd.util.hash_array(own.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(few)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(few + 1))
                for b in range(few):
                    at = order[cut[b]:cut[b + 1]]
                    if len(at):
                        mine = own.take(pa.array(at))
                        columns = [row[c].cast(sent_arrow.field(c).type) for c in by] + [
                            pa.array([b], pa.int32()), row["chunk"], row["trained"],
                            pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), mine), pa.array([pack(at, times[at])], pa.binary())]
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, sent_arrow)], schema=sent_arrow)

    got = _fields(group, b=INT, chunk=LONG, kinds=LONG, data=DATA)
    got_arrow = to_arrow_schema(got)

    def number(table: pa.Table) -> pa.Table:
        lists = table["words"].combine_chunks()
        flat = lists.flatten().dictionary_encode()
        place = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        data = [unpack(x.as_py()) for x in table["data"]]
        counted = table["trained"].to_numpy()
        times = np.concatenate([t * c for (_, t), c in zip(data, counted)])
        count = np.bincount(place, times, len(flat.dictionary)).astype(np.int64)
        order = np.argsort(-count, kind="stable")
        ids = np.empty(len(order), np.int64)
        ids[order] = np.arange(len(order)) * few + _one(table, "b") + FIRST_ID
        if ids.max(initial=0) >= ID_LIMIT:
            raise OverflowError("a group has more distinct words than numbers")
        out, start = [], 0
        for at, _ in data:
            mine = place[start:start + len(at)]
            start += len(at)
            out.append(pack(at, ids[mine], count[mine]))
        n = table.num_rows
        columns = [*(table[b] for b in by), table["b"], table["chunk"], pa.array([int((count > 0).sum())] * n), pa.array(out, pa.binary())]
        return pa.table([c.cast(f.type) for c, f in zip(columns, got_arrow)], schema=got_arrow)

    dealt = rows.select(*by, "chunk", "trained", "words", "codes").mapInArrow(deal, sent)
    numbers = written(dealt.groupBy(*by, "b").applyInArrow(number, got), "word_numbers", rows=1)
    kinds = numbers.groupBy(*by, "b").agg(F.max("kinds").alias("k")).groupBy(*by).agg(F.sum("k").alias("kinds"))
    stats = written(sizes.join(kinds, by, "left") if by else sizes.crossJoin(kinds), "group_stats")

    kept = ["trained", "asked", "keys", "sizes", "codes"]
    schema = _fields([*group, *(rows.schema[c] for c in ["chunk", *kept])], ids=DATA)
    arrow = to_arrow_schema(schema)

    def join(row: pa.Table, replies: pa.Table) -> pa.Table:
        if not row.num_rows:
            return arrow.empty_table()
        ids, count = np.zeros((2, _one(row, "n")), np.int64)
        for x in replies["data"]:
            at, i, c = unpack(x.as_py())
            ids[at], count[at] = i, c
        if not replies.num_rows:
            ids[:] = np.arange(len(ids)) + FIRST_ID  # a null group
        columns = [*(row[c] for c in [*by, "chunk", *kept]), pa.array([pack(ids, count)], pa.binary())]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    chunks = rows.select(*by, "chunk", *kept, F.size("words").alias("n"))
    own = chunks.groupBy("chunk").cogroup(numbers.select("chunk", "data").groupBy("chunk")).applyInArrow(join, schema)
    own = own.join(F.broadcast(stats), by, "left") if by else own.crossJoin(F.broadcast(stats))
    own = own.fillna(0, ["docs", "tokens", "kinds"])
    return Texts(written(own, "numbered_texts", rows=16), by, many, hot or HOT)


# ------------------------------------------------------------------ grams of a chunk

class Chunk:
    """The texts of one row of ``Texts`` as numbers, each after ``pads`` start marks and before an end mark."""

    def __init__(self, row: pa.Table, replies: pa.Table | None, pads: int, buckets: int, hot: int):
        self.row, self.buckets, self.hot = row, buckets, hot
        self.docs, self.tokens, self.kinds = (int(_one(row, c)) for c in ("docs", "tokens", "kinds"))
        codes, = unpack(_one(row, "codes"))
        ids, counts = unpack(_one(row, "ids"))
        self.sizes = row["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = self.sizes + pads + 1
        end = np.cumsum(n)
        self.x = np.full(int(end[-1]) if len(end) else 0, BOS_ID, np.int64)
        self.count = np.full(len(self.x), self.docs, np.int64)  # of the word in the trained texts
        at = ranges(end - n + pads, self.sizes)
        self.x[at], self.count[at] = ids[codes], counts[codes]
        self.x[end - 1] = EOS_ID
        self.t = ranges(end - n + pads, self.sizes + 1)  # places of the words that follow others
        self.starts = np.cumsum(self.sizes + 1) - (self.sizes + 1)  # of the texts in t
        self.replies = {}
        if replies is not None:
            for k, b, data in zip(replies["level"].to_pylist(), replies["b"].to_pylist(), replies["data"]):
                self.replies[k, b] = data

    def heads(self, k: int) -> list[np.ndarray]:
        """The k - 1 words before each predicted one."""
        return [self.x[self.t - j] for j in range(k - 1, 0, -1)]


class Grams:
    """The distinct (head, word) of some places, dealt to buckets.  ``often``: how often the head of each place occurs,
    or more; ``value``: what a gram counts for at each place if not once."""

    def __init__(self, chunk: Chunk, heads: list[np.ndarray], ext: np.ndarray, often: np.ndarray, value: np.ndarray | None = None):
        self.chunk, buckets = chunk, chunk.buckets
        self.head_at, self.columns = distinct(heads)
        m = int(ext.max(initial=0)) + 1
        u, self.at, self.n = np.unique(self.head_at * m + ext, return_inverse=True, return_counts=True)
        self.head, self.ext = np.divmod(u, m)
        if value is not None:
            self.n[self.at] = value
        parts = np.ones(len(self.columns[0]), np.int64)
        parts[self.head_at] = np.minimum(1 + often // chunk.hot, buckets)
        base = _mixed(self.columns) % buckets
        to = (base[self.head] + _mixed([self.ext]) % parts[self.head]) % buckets
        self.grams = np.argsort(to, kind="stable")
        self.gram_cut = np.searchsorted(to[self.grams], np.arange(buckets + 1))
        each = np.repeat(np.arange(len(parts)), parts)  # a head asks all its buckets
        to = (base[each] + ranges(np.zeros(len(parts), np.int64), parts)) % buckets
        order = np.argsort(to, kind="stable")
        self.head_cut = np.searchsorted(to[order], np.arange(buckets + 1))
        self.heads = each[order]

    def sent(self) -> Iterator[tuple[int, bytes]]:
        for b in range(self.chunk.buckets):
            heads = self.heads[self.head_cut[b]:self.head_cut[b + 1]]
            if len(heads):
                grams = self.grams[self.gram_cut[b]:self.gram_cut[b + 1]]
                m = np.bincount(np.searchsorted(heads, self.head[grams]), minlength=len(heads))
                first = self.columns[0][heads]
                yield b, pack(np.diff(first, prepend=0), *(c[heads] for c in self.columns[1:]), m, self.ext[grams], self.n[grams])

    def answers(self, level: int) -> tuple[np.ndarray, ...]:
        """(count of each gram, then of each head: total of its grams, their number, those of count 1 and of count 2)
        in the trained texts."""
        c, sums = np.zeros(len(self.head), np.int64), np.zeros((4, len(self.columns[0])), np.int64)
        for b in range(self.chunk.buckets):
            if (data := self.chunk.replies.get((level, b))) is not None:
                heads = self.heads[self.head_cut[b]:self.head_cut[b + 1]]
                c[self.grams[self.gram_cut[b]:self.gram_cut[b + 1]]], *more = unpack(data.as_py())
                for i, s in enumerate(more):
                    sums[i][heads] += s  # a head is in a bucket once
        return c, *sums


def by_chunk(texts: Texts, replies: DataFrame | None, one: Callable[[pa.Table, pa.Table | None], Iterator[pa.Table]],
             schema: StructType) -> DataFrame:
    """``one`` over every chunk and the replies to it."""
    arrow = to_arrow_schema(schema)

    def joined(row: pa.Table, got: pa.Table) -> pa.Table:
        return pa.concat_tables([arrow.empty_table(), *(one(row, got) if row.num_rows else ())])

    def alone(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for out in one(pa.Table.from_batches([batch.slice(i, 1)]), None):
                    yield from out.to_batches()

    if replies is None:
        return texts.rows.mapInArrow(alone, schema)
    replies = replies.where("chunk is not null").select("chunk", "level", "b", "data")
    return texts.rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(joined, schema)


def ask(texts: Texts, replies: DataFrame | None, level: int, pads: int, grams: Callable[[Chunk], Grams],
        once: bool = False, ones: bool = False) -> DataFrame:
    """(by, chunk, level, b, few, data), written: what the buckets know of the ``grams`` of each chunk.  ``once``: chunks
    give the count of a gram and not their part of it; ``ones``: heads are told their grams of count 1 and 2, and a row
    without a chunk has a bucket's numbers of grams of count 1, 2, 3 and 4."""
    by, buckets, hot = texts.by, texts.buckets, texts.hot
    reply_schema = _fields([texts.schema[b] for b in by], chunk=LONG, level=INT, b=INT, few=ArrayType(LONG), data=DATA)
    sent = _fields([texts.schema[c] for c in [*by, "chunk", "trained"]], b=INT, data=DATA)
    arrow, reply = to_arrow_schema(sent), to_arrow_schema(reply_schema)

    def send(row: pa.Table, got: pa.Table | None):
        if any(_one(row, b) is None for b in by):
            return
        for b, data in grams(Chunk(row, got, pads, buckets, hot)).sent():
            columns = [*(row[c] for c in arrow.names[:-2]), pa.array([b], pa.int32()), pa.array([data], pa.binary())]
            yield pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def tally(table: pa.Table) -> pa.Table:
        data = [unpack(x.as_py()) for x in table["data"]]
        for d in data:
            d[0] = np.cumsum(d[0])
        size = np.array([len(d[0]) for d in data])
        head, columns = distinct([np.concatenate([d[i] for d in data]) for i in range(len(data[0]) - 3)])
        many, ext, n = (np.concatenate([d[i] for d in data]) for i in (-3, -2, -1))
        own = np.array([len(d[-1]) for d in data])
        counted = np.repeat(table["trained"].to_numpy(), own)
        m = int(ext.max(initial=0)) + 1
        u, at = np.unique(np.repeat(head, many) * m + ext, return_inverse=True)
        if once:
            c = np.zeros(len(u), np.int64)
            c[at[counted]] = n[counted]
        else:
            c = np.bincount(at, n * counted, len(u)).astype(np.int64)
        of = u // m
        sums = [np.bincount(of, v, len(columns[0])).astype(np.int64) for v in (c, c > 0, *((c == i for i in (1, 2)) if ones else ()))]
        out, h, g = [], 0, 0
        for i in range(len(data)):
            heads, mine = head[h:h + size[i]], at[g:g + own[i]]
            h, g = h + size[i], g + own[i]
            out.append(pack(c[mine], *(v[heads] for v in sums)))  # a later level of trained texts goes by it too
        n = len(out)
        columns = [*(table[b] for b in by), table["chunk"], pa.array([level] * n), table["b"], pa.nulls(n), pa.array(out, pa.binary())]
        t = pa.table([v.cast(f.type) for v, f in zip(columns, reply)], schema=reply)
        if ones:
            few = [int((c == i).sum()) for i in range(1, 5)]
            columns = [*(table[b].slice(0, 1) for b in by), pa.nulls(1), pa.array([level]), table["b"].slice(0, 1), pa.array([few]), pa.nulls(1)]
            t = pa.concat_tables([t, pa.table([v.cast(f.type) for v, f in zip(columns, reply)], schema=reply)])
        return t

    answered = by_chunk(texts, replies, send, sent).groupBy(*by, "b").applyInArrow(tally, reply_schema)
    return written(answered, f"grams_{level}", rows=8)


def scored(texts: Texts, replies: DataFrame | None, key: str, pads: int, digits: int,
           logs: Callable[[Chunk], np.ndarray | None]) -> DataFrame:
    """(key, by, perplexity) of the asked texts from the log-probability of each predicted word of a chunk; None: null."""
    by, buckets, hot = texts.by, texts.buckets, texts.hot
    kind = texts.schema["keys"].dataType.elementType
    schema = _fields([StructField(key, kind), *(texts.schema[b] for b in by)], _l=DoubleType(), _n=LONG)
    arrow = to_arrow_schema(schema)

    def one(row: pa.Table, got: pa.Table | None):
        if not _one(row, "asked"):
            return
        chunk = Chunk(row, got, pads, buckets, hot)
        if len(chunk.sizes):
            n, lp = len(chunk.sizes), logs(chunk)
            sums = pa.nulls(n) if lp is None else pa.array(np.add.reduceat(lp, chunk.starts))
            columns = [row["keys"].combine_chunks().flatten(), *(pa.array([_one(row, b)] * n, arrow.field(b).type) for b in by),
                       sums, pa.array(chunk.sizes + 1)]
            yield pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    sums = written(by_chunk(texts, replies, one, schema), "perplexity_sums", rows=16)
    return (sums.groupBy(key, *by).agg((F.sum("_l") / F.sum("_n")).alias("_l"))
            .select(key, *by, F.round(F.exp(-F.col("_l")), digits).alias("perplexity")))


# ------------------------------------------------------------------ models

def bigram_perplexity(texts: Texts, k: float, key: str, digits: int) -> DataFrame:
    """Under the add-k bigram model."""
    def pairs(chunk: Chunk) -> Grams:
        return Grams(chunk, chunk.heads(2), chunk.x[chunk.t], chunk.count[chunk.t - 1])

    def logs(chunk: Chunk) -> np.ndarray:
        g = pairs(chunk)
        c, total, *_ = g.answers(2)
        v = chunk.kinds + 2 if chunk.docs else 1  # the end mark and the unknown word
        return np.log((c + k) / (total[g.head] + k * v))[g.at]

    return scored(texts, ask(texts, None, 2, 1, pairs), key, 1, digits, logs)


def _orders(chunk: Chunk, upto: int) -> Iterator[tuple[int, Grams]]:
    """(k, grams of k words) for k = 2, 3, ..., the heads of each dealt by their counts."""
    count = chunk.count
    for k in range(2, upto + 1):
        g = Grams(chunk, chunk.heads(k), chunk.x[chunk.t], count[chunk.t - 1])
        yield k, g
        if k < upto:
            count = np.full(len(chunk.x), chunk.docs, np.int64)
            count[chunk.t] = g.answers(k)[0][g.at]


def ngram_perplexity(texts: Texts, order: int, discount: float, key: str, digits: int) -> DataFrame:
    """Under the order-N interpolated model (``ngram.perplexity_ngram``)."""
    pads, replies = order - 1, None

    def last(k: int) -> Callable[[Chunk], Grams]:
        def grams(chunk: Chunk) -> Grams:
            for _, g in _orders(chunk, k):
                pass
            return g
        return grams

    def logs(chunk: Chunk) -> np.ndarray:
        p = np.full(len(chunk.t), 1.0 / (chunk.kinds + 2 if chunk.docs else 1))
        if chunk.docs:
            all_, words = chunk.tokens + chunk.docs, chunk.kinds + 1
            p = np.maximum(chunk.count[chunk.t] - discount, 0.0) / all_ + discount * words / all_ * p
        for k, g in _orders(chunk, order):
            c, total, kinds, *_ = g.answers(k)
            known = total[g.head] > 0
            all_ = np.where(known, total[g.head], 1)
            a = np.where(known, np.maximum(c - discount, 0.0) / all_, 0.0)
            b = np.where(known, discount * kinds[g.head] / all_, 1.0)
            p = a[g.at] + b[g.at] * p
        return np.log(p)

    for k in range(2, order + 1):
        got = ask(texts, replies, k, pads, last(k))
        replies = got if replies is None else replies.unionByName(got)
    return scored(texts, replies, key, pads, digits, logs)


#: Levels of ``kneser_ney_perplexity``: k has the grams of k words, LEFT + k what stands left of them.
LEFT = 10


def _kn_places(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices in chunk.t, places) of the words that end a gram of k words, the start mark included."""
    inside = np.arange(len(chunk.t)) - np.repeat(chunk.starts, chunk.sizes + 1)
    own = np.flatnonzero(inside >= k - 2)
    return own, chunk.t[own]


def _kn_left(chunk: Chunk, k: int) -> Grams:
    """Grams of k words as heads of the words left of them; a gram that starts its text has none (0)."""
    _, t = _kn_places(chunk, k)
    gram = [chunk.x[t - j] for j in range(k - 1, -1, -1)]
    often = np.min([chunk.count[t - j] for j in range(k)], axis=0)
    return Grams(chunk, gram, np.where(gram[0] == BOS_ID, 0, chunk.x[np.maximum(t - k, 0)]), often)


def _kn_adjusted(chunk: Chunk, k: int) -> np.ndarray:
    """The adjusted count of the gram of k words at each of its places: the words left of it, occurrences at a start."""
    g = _kn_left(chunk, k)
    _, total, kinds, *_ = g.answers(LEFT + k)
    return np.where(g.columns[0] == BOS_ID, total, kinds)[g.head_at]


def _kn_grams(chunk: Chunk, k: int, order: int) -> Grams:
    """Grams of k words with their adjusted counts; those of one word have one head in all buckets."""
    _, t = _kn_places(chunk, k)
    value = None if k == order else _kn_adjusted(chunk, k)
    if k == 1:
        return Grams(chunk, [np.zeros(len(t), np.int64)], chunk.x[t], np.full(len(t), chunk.hot * chunk.buckets), value)
    often = np.min([chunk.count[t - j] for j in range(1, k)], axis=0)
    return Grams(chunk, [chunk.x[t - j] for j in range(k - 1, 0, -1)], chunk.x[t], often, value)


def kneser_ney_perplexity(texts: Texts, order: int, key: str, digits: int,
                          discounts: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Under the modified Kneser-Ney model (``kneser_ney``); texts of a group without a model get null.

    ``discounts``: (by, level, d1, d2, d3) from the counts of counts (by, level, t1, ..., t4)."""
    replies, by = None, texts.by

    def get(level: int, grams: Callable[[Chunk], Grams], **how) -> None:
        nonlocal replies
        got = ask(texts, replies, level, 1, grams, **how)
        replies = got if replies is None else replies.unionByName(got)

    get(order, lambda chunk: _kn_grams(chunk, order, order), ones=True)
    for k in range(order - 1, 0, -1):
        get(LEFT + k, lambda chunk, k=k: _kn_left(chunk, k))
        get(k, lambda chunk, k=k: _kn_grams(chunk, k, order), once=True, ones=True)
    few = replies.where("chunk is null").groupBy(*by, "level").agg(*(F.sum(F.col("few")[i]).alias(f"t{i + 1}") for i in range(4)))
    d = discounts(few, [*by, "level"]).groupBy(*by).agg(F.collect_list(F.struct("level", "d1", "d2", "d3")).alias("discounts"))
    d = F.broadcast(written(d, "kn_discounts"))
    rows = texts.rows.join(d, by, "left") if by else texts.rows.crossJoin(d)

    def logs(chunk: Chunk) -> np.ndarray | None:
        if not chunk.docs:
            return None
        cuts = {d["level"]: np.array([0.0, d["d1"], d["d2"], d["d3"]]) for d in _one(chunk.row, "discounts")}
        p = np.zeros(len(chunk.t))
        for k in range(1, order + 1):
            own, _ = _kn_places(chunk, k)
            g = _kn_grams(chunk, k, order)
            c, total, kinds, one, two = g.answers(k)
            d, known = cuts.get(k, np.zeros(4)), total > 0  # no text of the group may be so long
            all_ = np.where(known, total, 1)
            handed = np.where(known, (d[1] * one + d[2] * two + d[3] * (kinds - one - two)) / all_, 1.0)
            mine = (c - d[np.minimum(c, 3)]) / all_[g.head]
            below = 1.0 / (kinds[g.head_at] + 1) if k == 1 else p[own]
            p[own] = mine[g.at] + handed[g.head_at] * below
        return np.log(p)

    return scored(Texts(rows, by, texts.buckets, texts.hot), replies, key, 1, digits, logs)
