"""The dataset kinds as one Spark data source (SRC8).

``spark.read.format("ranking_dataset").option("kind", k).option("split", s).load(folder)``

Every kind comes back in one shape (``SCHEMA``), so later steps do not ask
which kind they read: nested kinds fill ``passages``/``is_selected``, labelled
and raw kinds fill ``body`` (and ``url``, ``title``, ``label`` if they have
them).  ``ord`` follows file order: file number, then the first byte of the
record's block plus its number in the block, so it is unique and known without
counting rows first.

Partitions are planned from file sizes: line formats are cut into byte ranges
of ``block_bytes`` that meet at line ends; quoted CSV (line breaks inside
fields), a JSON array and gzip cannot be cut and are one partition a file, read
in bounded batches (a JSON array whole).  Rows are parsed by Arrow, never one
by one.  Unknown kinds, splits a kind has not got and missing files raise when
the read is planned; records that do not parse fail the read.
"""

from __future__ import annotations

import gzip
import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rankshift.sources.readers import KINDS

NAME = "ranking_dataset"
SCHEMA = ("ord long, query string, passages array<string>, is_selected array<int>, body string, url string, "
          "title string, label int")
BLOCK = 64 << 20
FORMATS = {"part_data": "jsonl", "made_valid_data": "json", "made_data": "csv", "full_data": "tsv"}

_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_QA = pa.schema([("query", _TEXT), ("passages", pa.struct([("is_selected", pa.list_(pa.int32())), ("passage_text", _TEXTS)]))])
_OUT = pa.schema([("ord", pa.int64()), ("query", _TEXT), ("passages", _TEXTS), ("is_selected", pa.list_(pa.int32())),
                  ("body", _TEXT), ("url", _TEXT), ("title", _TEXT), ("label", pa.int32())])


def open_file(path: str):
    """(file system, path inside it) of a local path or a URI that the executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Block(InputPartition):
    """Bytes [start, end) of a file; ``end`` None: the whole file, which cannot be cut."""
    path: str
    number: int
    start: int
    end: int | None


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a data file or of the part files of a folder, by name."""
    from pyarrow import fs

    system, inner = open_file(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner, recursive=False))
        parts = sorted((i.path, i.size) for i in found if i.is_file and not i.base_name.startswith(("_", ".")))
        head = path[:len(path) - len(inner)] if path.endswith(inner) else ""
        return [(head + p, n) for p, n in parts]
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return [(path, info.size)]


def whole_lines(source, start: int, end: int) -> bytes:
    """The lines that begin in [start, end)."""
    source.seek(max(0, start - 1))
    data = source.read(end - max(0, start - 1))
    if start > 0:  # the line that the range before began
        cut = data.find(b"\n")
        if cut < 0:
            return b""
        data = data[cut + 1:]
    if data and not data.endswith(b"\n"):
        rest = []
        while piece := source.read(1 << 20):
            cut = piece.find(b"\n")
            rest.append(piece if cut < 0 else piece[:cut])
            if cut >= 0:
                break
        data = b"".join([data, *rest])
    return data


def parse(fmt: str, data: bytes) -> pa.Table:
    """Records of one block."""
    from pyarrow import csv, json as pj

    if not data.strip():
        return pa.table({"query": pa.array([], _TEXT)})
    if fmt == "jsonl":
        return pj.read_json(io.BytesIO(data), read_options=pj.ReadOptions(use_threads=False, block_size=max(1 << 20, len(data) + 1)),
                            parse_options=pj.ParseOptions(explicit_schema=_QA, unexpected_field_behavior="ignore"))
    return csv.read_csv(  # tab-separated, nothing quoted
        io.BytesIO(data), read_options=csv.ReadOptions(use_threads=False, column_names=["url", "query", "body"]),
        parse_options=csv.ParseOptions(delimiter="\t", quote_char=False),
        convert_options=csv.ConvertOptions(column_types=dict.fromkeys(("url", "query", "body"), _TEXT)))


def shaped(t: pa.Table, first: int) -> Iterator[pa.RecordBatch]:
    """``t`` in the common shape; the first record has ``ord`` = ``first``."""
    import pyarrow.compute as pc

    n, columns = t.num_rows, {"ord": pa.array(range(first, first + t.num_rows), pa.int64())}
    if "passages" in t.column_names and n:
        nested = t.column("passages").combine_chunks()
        columns |= {"passages": pc.struct_field(nested, "passage_text"), "is_selected": pc.struct_field(nested, "is_selected")}
        t = t.drop_columns(["passages"])
    for f in _OUT:
        if f.name not in columns:
            columns[f.name] = t.column(f.name).cast(f.type) if f.name in t.column_names else pa.nulls(n, f.type)
    yield from pa.table(columns).select(_OUT.names).cast(_OUT).to_batches(max_chunksize=10_000)


class DatasetReader(DataSourceReader):
    def __init__(self, kind: str, split: str, folder: str, block: int):
        if kind not in KINDS:
            raise NotImplementedError(f"unknown dataset kind {kind!r}")
        if split not in KINDS[kind]:
            raise NotImplementedError(f"{kind} has no {split!r} split")
        self.fmt, self.block = FORMATS[kind], block
        self.path = os.path.join(folder, KINDS[kind][split])

    def partitions(self) -> list[Block]:
        plan = []
        for number, (path, size) in enumerate(files_of(self.path)):
            if path.endswith(".gz") or self.fmt in ("csv", "json"):
                plan.append(Block(path, number, 0, None))
            else:
                plan += [Block(path, number, at, min(size, at + self.block)) for at in range(0, size, self.block)]
        return plan or [Block("", 0, 0, None)]

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, inner = open_file(part.path)
        base = part.number << 44
        if part.end is not None:
            with system.open_input_file(inner) as source:
                yield from shaped(parse(self.fmt, whole_lines(source, part.start, part.end)), base + part.start)
            return
        with system.open_input_stream(inner, compression=None) as raw:
            stream = gzip.GzipFile(fileobj=raw) if part.path.endswith(".gz") else raw
            yield from {"csv": self._csv, "json": self._json}.get(self.fmt, self._lines)(stream, base)

    def _lines(self, stream, at: int) -> Iterator[pa.RecordBatch]:
        rest = b""
        while data := stream.read(self.block):
            cut = data.rfind(b"\n") + 1
            if not cut:
                rest += data
                continue
            rows = parse(self.fmt, rest + data[:cut])
            rest = data[cut:]
            yield from shaped(rows, at)
            at += rows.num_rows
        yield from shaped(parse(self.fmt, rest), at)

    def _csv(self, stream, at: int) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv

        if isinstance(stream, gzip.GzipFile):
            stream = pa.PythonFile(stream)
        texts = dict.fromkeys(("query", "url", "title", "meta", "body", "qlinks"), _TEXT) | {"label": pa.int32()}
        options = csv.ConvertOptions(column_types=texts, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""])
        for batch in csv.open_csv(stream, parse_options=csv.ParseOptions(newlines_in_values=True), convert_options=options,
                                  read_options=csv.ReadOptions(use_threads=False, block_size=min(self.block, 1 << 30))):
            yield from shaped(pa.Table.from_batches([batch]), at)
            at += batch.num_rows

    def _json(self, stream, at: int) -> Iterator[pa.RecordBatch]:
        data = stream.read()
        if not data.lstrip().startswith(b"["):  # one record a line
            yield from shaped(parse("jsonl", data), at)
            return
        rows = json.loads(data)
        keep = [{"query": r.get("query"), "passages": r.get("passages")} for r in rows]
        yield from shaped(pa.Table.from_pylist(keep, schema=_QA), at)


class RankingDataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DatasetReader:
        o = self.options
        return DatasetReader(o.get("kind", ""), o.get("split", "train"), o.get("path", ""), int(o.get("block_bytes", BLOCK)))


def read_dataset(spark: SparkSession, kind: str, folder: str, split: str = "train", block_bytes: int = BLOCK) -> DataFrame:
    """SRC8 in one shape for every kind."""
    spark.dataSource.register(RankingDataset)
    return (spark.read.format(NAME).option("kind", kind).option("split", split).option("block_bytes", block_bytes)
            .load(folder))
