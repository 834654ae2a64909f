"""SimHash near-duplicates through pigeonhole blocks.

A fingerprint is the bitwise majority of the XXH64 values (seed 42) of the
word shingles.  Equal fingerprints are collapsed first, so a group of copies
is one node however large it is.  Fingerprints at most ``max_bits`` apart
share at least one of ``max_bits + 1`` blocks of bits, so they meet in the
bucket of that block.  A bucket above ``bucket_rows`` is not compared as a
whole: its members agree on the block, so the same argument holds for the
bits that are left, which are cut into ``max_bits + 1`` finer blocks; this
repeats until buckets are small.  It always ends: members of a bucket differ
in the bits left, of which there are fewer at each step.  Nothing is capped.

Inside a bucket all distances are computed in numpy, and only a spanning
forest of the links leaves the task, never all pairs.  Components follow by
star contraction.

Defined results: null and empty texts have fingerprint zero and link like any
other; fewer words than the shingle give one shingle of the whole sequence;
rows without id keep their fingerprint, and their component is the smallest
id they reach (null if none); repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.llm.common import add_columns, fresh, materialize
from rankshift.llm.components import components

BUCKET_ROWS = 4096


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit majority fingerprint of one text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return int(np.uint64(h64(b" ".join(words), 42)).astype(np.int64))
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    stop = end[shingle - 1:].tolist()
    h = np.fromiter((h64(line[a:b], 42) for a, b in zip(start, stop)), np.uint64, len(start))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at:at + (1 << 14)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    def make():
        return lambda texts: [[fingerprint(t, shingle) for t in texts]]

    return add_columns(docs, make, [(out, "long")], text)


def _split(width: list[int], parts: int) -> list[list[int]]:
    """Cut a list of bit numbers into ``parts`` runs of nearly equal length."""
    edge = [len(width) * i // parts for i in range(parts + 1)]
    return [width[a:b] for a, b in zip(edge, edge[1:])]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _forest(u: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of one bucket: each member in turn meets those not reached yet."""
    found, left, front = [], np.arange(1, len(u)), [0]
    while len(left) or front:
        if not front:
            front, left = [left[0]], left[1:]
        i = front.pop()
        near = np.bitwise_count(u[left] ^ u[i]) <= max_bits
        if near.any():
            new = left[near]
            found.append((np.full(len(new), i), new))
            left = left[~near]
            front += new.tolist()
        if not len(left):
            break
    return found


def _bucket_links(max_bits: int, small: int = 16):
    """Links inside the buckets of one partition, whose rows come sorted by bucket."""

    def of(fp, key):
        u = fp.view(np.uint64)
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(edge)
        own = np.repeat(size, size)
        pairs = []
        for d in range(1, min(small, int(size.max(initial=1)))):  # small buckets: neighbours at each distance
            i = np.flatnonzero((key[d:] == key[:-d]) & (own[d:] <= small))
            i = i[np.bitwise_count(u[i] ^ u[i + d]) <= max_bits]
            pairs.append((i, i + d))
        for g in np.flatnonzero(size > small):
            pairs += [(edge[g] + a, edge[g] + b) for a, b in _forest(u[edge[g]:edge[g + 1]], max_bits)]
        a = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in pairs]) if pairs else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["u", "v"])

    def run(batches):
        fp, key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x in batches:
            fp = np.r_[fp, x.column("fp").to_numpy(zero_copy_only=False)]
            key = np.r_[key, x.column("bucket").to_numpy(zero_copy_only=False)]
            if not len(key):
                continue
            done = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1  # the last bucket may go on
            if done:
                yield of(fp[:done], key[:done])
                fp, key = fp[done:], key[done:]
        if len(fp):
            yield of(fp, key)

    return run


def links(fps: DataFrame, max_bits: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) that connect all fingerprints at most ``max_bits`` apart (``fps``: distinct ``fp``)."""
    parts = max_bits + 1
    fp = F.col("fp")
    # path: the blocks chosen so far, written as one string; mask: the bits they fix
    choices = [("", list(range(64)))]
    todo = fps.withColumn("path", F.lit(""))
    found = None
    level = 0
    while True:
        level += 1
        narrower = []
        cells = []
        for path, left in choices:
            for n, block in enumerate(_split(left, parts)):
                rest = [b for b in left if b not in block]
                new = f"{path}{n}"
                fixed = [b for b in range(64) if b not in rest]
                narrower.append((new, rest))
                cells.append((path, new, _mask(fixed)))
        table = F.create_map(*[x for path in dict.fromkeys(c[0] for c in cells) for x in (
            F.lit(path), F.array(*[F.struct(F.lit(n).alias("path"), F.lit(m).alias("mask")) for p, n, m in cells if p == path]))])
        keyed = (todo.withColumn("cell", F.explode(F.element_at(table, F.col("path"))))
                 .select("fp", F.col("cell.path").alias("path"), fp.bitwiseAND(F.col("cell.mask")).alias("part")))
        keyed = materialize(keyed, "simhash-keys")
        sizes = keyed.groupBy("path", "part").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        sizes = materialize(sizes, "simhash-sizes")
        last = not any(len(rest) >= parts for _, rest in narrower) or level >= 12
        small = sizes if last else sizes.where(F.col("rows") <= bucket_rows)
        bucket = F.xxhash64("path", "part")  # buckets that collide are compared together, which adds no wrong link
        made = (keyed.join(small.drop("rows"), ["path", "part"]).select("fp", bucket.alias("bucket"))
                .repartition("bucket").sortWithinPartitions("bucket")
                .mapInArrow(_bucket_links(max_bits), "u long, v long"))
        found = made if found is None else found.unionByName(made)
        hot = sizes.where(F.col("rows") > bucket_rows)
        if last or hot.isEmpty():
            return found
        todo = keyed.join(hot.drop("rows"), ["path", "part"], "left_semi").select("fp", "path").distinct()
        used = {r["path"] for r in hot.select("path").distinct().collect()}  # at most parts ** level names
        choices = [c for c in narrower if c[0] in used]


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, bucket_rows: int = BUCKET_ROWS,
                    doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (long), component_id, root (a fingerprint that names the component), and the columns of ``carry``."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry)
    d = materialize(with_fingerprint(d, shingle).drop("text"), "simhash-fingerprints")
    groups = materialize(d.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    tree = components(links(groups.select("fp"), max_bits, bucket_rows))
    roots = groups.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.select("fp", "root").join(least, "root").select("fp", "component_id", "root")
    return d.join(named, "fp").select("doc_id", "fp", "component_id", "root", *carry)


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs`` (columns doc_id, text and any others) without near-duplicates: of each component
    the row with the smallest id stays (rows without id come last; of repeated rows one stays)."""
    row = fresh(docs, "row_hash")
    d = docs.withColumn(row, F.xxhash64("text"))
    key, same_row = fresh(d, "kept_id"), fresh(d, "kept_row")
    found = near_duplicates(d.select("doc_id", "text", row), shingle, max_bits, bucket_rows, carry=(row,))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    kept = found.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias(key), F.col(f"k.{row}").alias(same_row))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(row) == F.col(same_row))
    return (d.join(materialize(kept, "simhash-kept"), same, "left_semi")
            .dropDuplicates(["doc_id", row]).drop(row))


def op7(docs: DataFrame) -> DataFrame:
    r = near_duplicates(docs)
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
