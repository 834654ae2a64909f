"""Readers for the reference's input formats (SRC1-SRC8).

Every reader declares its schema (no inference pass) and adds an ``ord``
column that follows file order, because the reference takes "the first N
rows" and packs text in file order.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rankshift.operators.order import file_order

PASSAGES = T.StructType([
    T.StructField("is_selected", T.ArrayType(T.IntegerType())),
    T.StructField("passage_text", T.ArrayType(T.StringType())),
])
QA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("query_id", T.LongType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("answers", T.ArrayType(T.StringType())),
    T.StructField("wellFormedAnswers", T.ArrayType(T.StringType())),
    T.StructField("passages", PASSAGES),
])
LABELLED = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("meta", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("qlinks", T.StringType()),
    T.StructField("label", T.IntegerType()),
])
TSV_NAMES = ("url", "query", "text")
TOKENIZED = T.StructType([
    T.StructField("ord", T.LongType()),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    T.StructField("labels", T.ArrayType(T.IntegerType())),
])

# Dataset kinds and their files (SRC8).
KINDS = {
    "part_data": {"train": "train.jsonl", "test": "test.jsonl", "validation": "val.jsonl"},
    "made_data": {"train": "filtred_df.csv", "validation": "filtred_df.csv"},
    "made_valid_data": {"validation": "val.json"},
    "full_data": {"train": "dataset.tsv.gz"},
}


def _ordered(df: DataFrame) -> DataFrame:
    return file_order(df, "ord")


def read_qa_jsonl(spark: SparkSession, paths: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """SRC1: nested query/passages JSON Lines (``multiline`` for files that hold one JSON array).
    A record that does not parse fails the read instead of giving a row of nulls."""
    r = spark.read.schema(QA).option("multiLine", str(multiline).lower()).option("mode", "FAILFAST")
    return _ordered(r.json(paths if isinstance(paths, str) else list(paths)))


def read_qa_json(spark: SparkSession, path: str, split: str = "validation", multiline: bool = True) -> DataFrame:
    """SRC2: validation-only JSON; any other split raises.  ``multiline=False`` for JSON Lines."""
    if split != "validation":
        raise NotImplementedError("this dataset holds only a validation split")
    return read_qa_jsonl(spark, path, multiline)


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: CSV with header; quoted fields may hold newlines.  ``multiLine``
    makes the file unsplittable: convert to Parquet once and work from that."""
    r = (spark.read.schema(LABELLED).option("header", "true").option("quote", '"')
         .option("escape", '"').option("multiLine", "true"))
    return _ordered(r.csv(path))


def read_tsv(spark: SparkSession, path: str, names: Sequence[str] = TSV_NAMES,
             partitions: int | None = None) -> DataFrame:
    """SRC4: headerless TSV (``.gz`` read directly; gzip is unsplittable, so
    the result is re-partitioned right after the ordered read; without
    ``partitions`` the number follows the session's shuffle setting)."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    r = (spark.read.schema(schema).option("sep", "\t").option("header", "false")
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false"))
    df = _ordered(r.csv(path))
    return df.repartition(partitions) if partitions else df.repartition("ord")


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: a corpus as ordered lines (never ``wholetext``)."""
    return _ordered(spark.read.text(path)).withColumnRenamed("value", "text")


def queries_from_list(spark: SparkSession, items: Sequence[str]) -> DataFrame:
    """SRC6: a fixed in-memory list of queries."""
    return spark.createDataFrame([(i, q) for i, q in enumerate(items)], "ord long, query string")


def read_tokenized(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: reload a prepared tokenized table."""
    return spark.read.parquet(path)


def load(spark: SparkSession, kind: str, folder: str, split: str = "train") -> DataFrame:
    """SRC8: dataset kind -> reader; unknown kinds or splits raise."""
    if kind not in KINDS:
        raise NotImplementedError(f"unknown dataset kind {kind!r}")
    files = KINDS[kind]
    if split not in files:
        raise NotImplementedError(f"{kind} has no {split!r} split")
    path = os.path.join(folder, files[split])
    if kind == "part_data":
        return read_qa_jsonl(spark, path)
    if kind == "made_valid_data":
        return read_qa_json(spark, path, split)
    if kind == "made_data":
        return read_labelled_csv(spark, path)
    return read_tsv(spark, path)

