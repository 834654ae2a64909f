"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankshift.session import materialize

__all__ = ["add_columns", "ascii_lower", "doc_crc", "fresh", "materialize", "pick_sample", "row_chunks"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is the cheap form of it when every character is ASCII."""
    return (F.when(F.length(text) == F.octet_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not got (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def doc_crc(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod`` (null id: crc32 of the empty string, 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def row_chunks(batch: pa.RecordBatch, text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut one Arrow batch into runs of rows of about ``max_bytes`` of text, so a
    batch of very long texts does not become one huge set of Python objects."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def add_columns(df: DataFrame, make: Callable[[], Callable[[list], list[list]]], fields: list[tuple[str, str]],
                text: str = "text") -> DataFrame:
    """Append ``fields`` (name, DDL type) computed from the ``text`` column, batch by batch.

    ``make()`` runs once per task and returns ``f(list of texts) -> one list per field``.
    All other columns pass through as Arrow data.  Field names must be new."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
             "array<string>": pa.list_(pa.string())}
    names, types = [n for n, _ in fields], [kinds[t] for _, t in fields]

    def run(batches):
        f = make()
        for whole in batches:
            for b in row_chunks(whole, text):
                made = f(b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, t) for v, t in zip(made, types))],
                                                 names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def pick_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, chosen by the smallest hash of ``key`` (the same rows on every run).
    A top-n by hash: each task keeps ``bound`` narrow rows at most."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(bound)
