"""Removal of repeated 200-byte strings with a sparse suffix array.

Sorting every suffix would move about 200 bytes of key for each byte of text,
so only sampled suffixes are sorted, and the sample is exact: a suffix is an
anchor if the hash of its first ``GRAM`` bytes is the smallest of some
``WIDTH``-byte window.  Equal windows have their anchors at equal places, so
a window can repeat only where an anchor's gram repeats.

1. Anchors of every text (about one in 65 bytes), as (gram hash, hash of the
   whole context that windows around this anchor can reach, place).
2. Aggregation by gram hash: grams met once are dropped.  Where all contexts
   of a gram agree, every window around it repeats.  Contexts that are met
   twice are settled the same way; what is left are contexts met once whose
   gram occurs elsewhere in other contexts.
3. For these grams one suffix a distinct context is fetched from the text.
   Sampled splitters range-partition the suffixes by their leading bytes (the
   gram), and each bucket is sorted.  Runs of suffixes with the same gram are
   ordered by multikey quicksort over 8-byte tokens, to the right and to the
   left; the common prefix lengths of neighbours give the classes of equal
   strings of every length, and a window repeats if another suffix of the run
   is in both of its classes.  Splitters are whole grams, so equal leading
   bytes never lie on both sides of a boundary.
4. Grams with more than ``HOT_RUN`` distinct contexts are not sorted in one
   bucket: their windows are compared by 128-bit hashes in an aggregation
   that spreads them over all tasks (the comparison across buckets).
5. The repeated windows of each text are united and cut out.

The text is shuffled (compressed) once, and once more only for texts with
unsettled suffixes.  Nothing is broadcast; no step gathers a gram's rows in
one task before its copies are collapsed.

Defined results: null is an empty text; texts below 200 bytes keep all their
bytes; rows that repeat (same id and text) count as two texts, so their
200-byte strings repeat.  Documents without id are treated like any other.
Hash equality (64 bits for grams, 128 for contexts) stands for equality of
settled contexts; runs are compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.llm.common import materialize, row_chunks

WIDTH = 200
GRAM = 72
SIDE = WIDTH - GRAM    # bytes a window can reach beyond the gram, to both sides together
SLICE = 1 << 20        # bytes hashed at a time
HOT_RUN = 50_000       # distinct contexts of one gram that are still sorted in one task
SLAB = 20_000          # suffixes taken together in one sort, at least

_U = np.uint64
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class Roller:
    """Hashes of substrings from prefix sums (polynomials over random byte values, mod 2**64)."""

    def __init__(self, base: int, room: int):
        rng = np.random.default_rng(base % 1_000_003)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.power, self.back = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(room, b, _U)]))
                                 for b in (base, pow(base, -1, 2**64)))

    def sums(self, part: np.ndarray) -> np.ndarray:
        out = np.zeros(len(part) + 1, _U)
        np.cumsum(self.value[part] * self.power[:len(part)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((sums[hi] - sums[lo]) * self.back[lo])


def _sliding(best, x: np.ndarray, width: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return best(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, start: np.ndarray, end: np.ndarray, one: Roller, two: Roller):
    """Anchors of the texts data[start[i]:end[i]] laid end to end: (place in data, text number, gram hash, context hash)."""
    n, found = len(data), []
    for a in range(0, max(0, n - WIDTH + 1), SLICE):
        b = min(a + SLICE, n - WIDTH + 1)          # window starts of this slice
        lo, hi = max(0, a - SIDE), min(n, b + WIDTH + SIDE)
        part = data[lo:hi]
        s1 = one.sums(part)
        grams = len(part) - GRAM + 1
        h = _mix((s1[GRAM:] - s1[:-GRAM]) * one.back[:grams])
        least = _sliding(np.minimum, h[a - lo:b - lo + SIDE], SIDE + 1)      # one value a window
        ok = np.zeros(b - a + 1, np.int64)         # windows that lie in one text
        first, last = np.clip(start - a, 0, b - a), np.clip(end - WIDTH + 1 - a, 0, b - a)
        np.add.at(ok, first, 1)
        np.add.at(ok, np.maximum(last, first), -1)
        least = np.where(np.cumsum(ok)[:-1] > 0, least, _U(0))
        pad = np.zeros(SIDE, _U)
        most = _sliding(np.maximum, np.concatenate([pad, least, pad]), SIDE + 1)
        own = h[a - lo:a - lo + len(most)]
        p = np.flatnonzero((own == most) & (own > 0)) + a
        if not len(p):
            continue
        t = np.searchsorted(start, p, side="right") - 1
        left, right = np.maximum(p - SIDE, start[t]), np.minimum(p + WIDTH, end[t])
        c = one.between(s1, left - lo, right - lo) ^ _mix(two.between(two.sums(part), left - lo, right - lo)
                                                          + (p - left).astype(_U) * _U(_BASE))
        found.append((p, t, h[p - lo], c))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))
    p, t, h, c = (np.concatenate(x) for x in zip(*found))
    _, at = np.unique(p, return_index=True)        # slices can find the same anchor
    return p[at], t[at], h[at], c[at]


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the text column laid end to end, with the start and end of each row."""
    raw = [x.as_buffer() if x.is_valid else None for x in batch.column("text").cast(pa.large_binary())]
    size = np.array([len(x) if x is not None else 0 for x in raw], dtype=np.int64)
    end = np.cumsum(size)
    data = np.concatenate([np.frombuffer(x, np.uint8) for x in raw if x is not None and len(x)] or [np.zeros(0, np.uint8)])
    return data, end - size, end


def _ids(batch: pa.RecordBatch, data, start, end) -> tuple[list, list]:
    import xxhash

    k1 = [-1 if x is None else x for x in batch.column("doc_id").to_pylist()]
    view = memoryview(data)
    k2 = [xxhash.xxh64_intdigest(view[a:b]) - 2**63 for a, b in zip(start.tolist(), end.tolist())]
    return k1, k2


def _anchor_rows(batches):
    one, two = Roller(_BASE, SLICE + 4 * WIDTH), Roller(_BASE2, SLICE + 4 * WIDTH)
    for whole in batches:
        for b in row_chunks(whole, "text", SLICE):
            data, start, end = _texts(b)
            k1, k2 = (np.array(k, dtype=np.int64) for k in _ids(b, data, start, end))
            p, t, h, c = anchors(data, start, end, one, two)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (k1[t], k2[t], p - start[t], h.view(np.int64), c.view(np.int64))],
                names=["k1", "k2", "pos", "h", "c"])


def _packed(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        for b in row_chunks(whole, "text", SLICE):
            data, start, end = _texts(b)
            k1, k2 = _ids(b, data, start, end)
            view = memoryview(data)
            z = [pack.compress(view[s:e]) for s, e in zip(start.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                              pa.array(z, pa.binary())], names=["doc_id", "k1", "k2", "z"])


def _unpack(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, maximal runs removed, sha256 of the rest) for the union of [lo, hi)."""
    if not len(lo):
        return 0, 0, hashlib.sha256(text).hexdigest()
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    a, b = lo[new], hi[np.r_[new[1:] - 1, len(hi) - 1]]
    rest, at = hashlib.sha256(), 0
    for x, y in zip(a.tolist(), b.tolist()):
        rest.update(text[at:x])
        at = y
    rest.update(text[at:])
    return int((b - a).sum()), len(a), rest.hexdigest()


def _settled(text: bytes, full: list) -> tuple[np.ndarray, np.ndarray]:
    p = np.array(full or [], dtype=np.int64)
    return np.maximum(p - SIDE, 0), np.minimum(p + WIDTH, len(text))


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_CONTEXT = "array<struct<pos:long,h:long,single:boolean,gram:binary,right:binary,left:binary>>"


def _first_cut(batches):
    """Result of texts without unsettled suffixes; the others keep their text.  Contexts asked for."""
    kinds = pa.list_(pa.struct([("pos", pa.int64()), ("h", pa.int64()), ("single", pa.bool_()),
                                ("gram", pa.binary()), ("right", pa.binary()), ("left", pa.binary())]))
    for b in batches:
        rows = []
        for z, full, asked in zip(*(b.column(x).to_pylist() for x in ("z", "full_at", "asked"))):
            text = _unpack(z)
            context = [{"pos": q["pos"], "h": q["h"], "single": q["single"], "gram": text[q["pos"]:q["pos"] + GRAM],
                        "right": text[q["pos"] + GRAM:q["pos"] + WIDTH],
                        "left": text[max(0, q["pos"] - SIDE):q["pos"]][::-1]} for q in asked or []]
            later = any(q["single"] for q in asked or [])
            done = (None, None, None) if later else cut(text, *_settled(text, full))
            rows.append((len(text), *done, z if later else None, full if later else None, context))
        made = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), kinds]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(x) for x in ("doc_id", "k1", "k2")), *(pa.array(list(v), t) for v, t in zip(made, types))],
            names=["doc_id", "k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "z", "full_at", "context"])


def _last_cut(batches):
    for b in batches:
        rows = []
        for z, full, lo, hi in zip(*(b.column(x).to_pylist() for x in ("z", "full_at", "lo", "hi"))):
            text = _unpack(z)
            a, e = _settled(text, full)
            rows.append(cut(text, np.r_[a, np.array(lo or [], np.int64)], np.r_[e, np.array(hi or [], np.int64)]))
        made = list(zip(*rows)) if rows else [[]] * 3
        types = [pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_bytes"), *(pa.array(list(v), t) for v, t in zip(made, types))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def multikey_order(group: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order by (group, text, size) through multikey quicksort: rows that tie on one 8-byte token
    are parted by the next token; settled rows are not touched again."""
    token = np.ascontiguousarray(text).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    part = np.cumsum(np.r_[0, np.diff(group[order]) != 0])
    open_ = np.arange(len(order))
    for j in range(token.shape[1] + 1):
        key = token[:, j] if j < token.shape[1] else size.astype(np.uint64)
        rows = order[open_]
        by = np.lexsort((key[rows], part[open_]))
        rows = rows[by]
        order[open_] = rows
        k = key[rows]
        new = np.r_[True, (k[1:] != k[:-1]) | (part[open_][1:] != part[open_][:-1])]
        run = np.cumsum(new) - 1
        part[open_] = open_[np.flatnonzero(new)][run]      # a part is named by its first place
        tied = np.bincount(run)[run] > 1
        open_ = open_[tied]
        if not len(open_):
            break
    return order


def _common(order: np.ndarray, group: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix length with the row before in ``order`` (-1: other group)."""
    a, b = order[:-1], order[1:]
    differ = text[a] != text[b]
    same = np.where(differ.any(1), differ.argmax(1), text.shape[1])
    same = np.minimum(same, np.minimum(size[a], size[b]))
    return np.r_[-1, np.where(group[a] == group[b], same, -1)]


def repeated_windows(group: np.ndarray, right: np.ndarray, r_size: np.ndarray, left: np.ndarray, l_size: np.ndarray):
    """For every x (bytes left of the gram): rows whose window repeats in another row of their group."""
    by_right, by_left = multikey_order(group, right, r_size), multikey_order(group, left, l_size)
    r_same, l_same = _common(by_right, group, right, r_size), _common(by_left, group, left, l_size)
    m = len(group)
    r_class, l_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for x in range(SIDE + 1):
        r_class[by_right] = np.cumsum(r_same < SIDE - x)
        l_class[by_left] = np.cumsum(l_same < x)
        rows = np.flatnonzero((l_size >= x) & (r_size >= SIDE - x))
        if len(rows) < 2:
            continue
        key = r_class[rows] * (m + 1) + l_class[rows]
        order = np.argsort(key, kind="stable")
        k = key[order]
        twin = np.r_[False, k[1:] == k[:-1]]
        twin |= np.r_[twin[1:], False]
        yield x, rows[order[twin]]


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width), size


def _windows(batches):
    """Repeated windows of the unsettled suffixes of one bucket, as (k1, k2, lo, hi) byte ranges."""

    def of(table: pa.Table):
        gram = table.column("gram").combine_chunks().dictionary_encode()
        group = gram.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        right, r_size = _matrix(table.column("right").to_pylist(), SIDE)
        left, l_size = _matrix(table.column("left").to_pylist(), SIDE)
        single = table.column("single").to_numpy()
        hit = np.zeros((len(group), SIDE + 3), bool)
        for x, rows in repeated_windows(group, right, r_size, left, l_size):
            hit[rows, x + 1] = True
        hit &= single[:, None]
        edge = np.diff(hit.astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)          # runs of x: first .. last
        _, after = np.nonzero(edge == -1)
        k1, k2, pos = (table.column(c).to_numpy()[row] for c in ("k1", "k2", "pos"))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (k1, k2, pos - (after - 1), pos - first + WIDTH)],
                                          names=["k1", "k2", "lo", "hi"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= SLAB:
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_pylist()
            last = len(gram)
            while last and gram[last - 1] == gram[-1]:  # the last run may go on
                last -= 1
            if last:
                yield of(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
    if held and sum(x.num_rows for x in held):
        yield of(pa.Table.from_batches(held))


def _hot_windows(batches):
    """Every window of the suffixes of hot grams, as 128-bit hashes."""
    one, two = Roller(_BASE, 4 * WIDTH), Roller(_BASE2, 4 * WIDTH)
    names = ["k1", "k2", "pos", "h", "single", "x", "f1", "f2"]
    for b in batches:
        for r in b.to_pylist():
            part = np.frombuffer(r["left"][::-1] + r["gram"] + r["right"], np.uint8)
            n_left = len(r["left"])
            x = np.arange(max(0, SIDE - len(r["right"])), min(SIDE, n_left) + 1)
            lo = n_left - x
            f1, f2 = (q.between(q.sums(part), lo, lo + WIDTH).view(np.int64) for q in (one, two))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[c]] * len(x), t) for c, t in zip(names, (pa.int64(),) * 4 + (pa.bool_(),))),
                 pa.array(x), pa.array(f1), pa.array(f2)], names=names)


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_run: int = HOT_RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (see the module text)."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = d.mapInArrow(_anchor_rows, "k1 long, k2 long, pos long, h long, c long")
    grams = (rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c_min"), F.max("c").alias("c_max"))
             .where("n > 1").select("h", (F.col("c_min") == F.col("c_max")).alias("even")))
    grams = materialize(grams, "suffix-grams")  # a plain table, so that the join can split a hot gram
    hits = materialize(rows.join(grams, "h"), "suffix-hits")
    uneven = hits.where(~F.col("even"))
    contexts = uneven.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("r"))
    contexts = materialize(contexts.select("h", "c", "n", "r.*"), "suffix-contexts")
    settled = hits.where("even").select("k1", "k2", "pos").unionByName(
        uneven.join(contexts.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("k1", "k2", "pos"))
    wanted = settled.select("k1", "k2", F.col("pos").alias("full"), F.lit(None).cast("struct<pos:long,h:long,single:boolean>").alias("q"))
    wanted = wanted.unionByName(contexts.select(
        "k1", "k2", F.lit(None).cast("long").alias("full"),
        F.struct("pos", "h", (F.col("n") == 1).alias("single")).alias("q")))
    lists = wanted.groupBy("k1", "k2").agg(F.collect_set("full").alias("full_at"), F.collect_set("q").alias("asked"))

    packed = d.mapInArrow(_packed, "doc_id long, k1 long, k2 long, z binary")
    first = packed.join(lists, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "z", "full_at", "asked").mapInArrow(
        _first_cut, f"doc_id long, k1 long, k2 long, {_RESULT}, z binary, full_at array<long>, context {_CONTEXT}")
    first = materialize(first, "suffix-first")

    suffixes = first.select("k1", "k2", F.explode("context").alias("s")).select("k1", "k2", "s.*")
    suffixes = suffixes.dropDuplicates(["k1", "k2", "pos"])  # repeated rows ask twice
    hot = materialize(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_run).select("h"),
                      "suffix-hot")
    found = (suffixes.join(hot, "h", "left_anti").repartitionByRange("gram").sortWithinPartitions("gram")
             .mapInArrow(_windows, "k1 long, k2 long, lo long, hi long"))
    if not hot.isEmpty():
        each = suffixes.join(hot, "h", "left_semi").select("k1", "k2", "pos", "h", "single", "gram", "right", "left")
        each = materialize(each.mapInArrow(
            _hot_windows, "k1 long, k2 long, pos long, h long, single boolean, x long, f1 long, f2 long"), "suffix-windows")
        key = ["h", "x", "f1", "f2"]
        many = each.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
        same = each.where("single").join(many, key, "left_semi")
        found = found.unionByName(same.select("k1", "k2", (F.col("pos") - F.col("x")).alias("lo"),
                                              (F.col("pos") - F.col("x") + WIDTH).alias("hi")))
    spans = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("at"))
    spans = spans.select("k1", "k2", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))
    open_ = (first.where(F.col("z").isNotNull()).select("doc_id", "k1", "k2", "n_bytes", "z", "full_at")
             .join(spans, ["k1", "k2"], "left").select("doc_id", "n_bytes", "z", "full_at", "lo", "hi")
             .mapInArrow(_last_cut, f"doc_id long, {_RESULT}"))
    done = first.where(F.col("z").isNull()).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.unionByName(open_)


def op3(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs)
