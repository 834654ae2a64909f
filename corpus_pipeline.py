"""Corpus pipeline: language ID, near-dedup, decontamination, secret redaction, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the docs of the next stage.  All stages but the
last return the columns of ``documents`` (extra columns pass through).  All
take empty tables, null and empty texts, repeated rows and null columns.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankshift.llm import decontaminate, language, mixing, secrets, simhash
from rankshift.llm.common import materialize


def prefix(docs: DataFrame) -> str:
    """A start that no column name of ``docs`` has."""
    p = "found_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p = "_" + p
    return p


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of its input; texts without a language (``und``) and texts whose two
    nearest codewords tie (ambiguous) go.  With nothing to learn from, texts with a letter stay.  ``lang`` stays
    as given."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    if not model["names"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    p = prefix(docs)
    found = language.identify(docs, model, prefix=p)
    return found.where((F.col(p + "lang_pred") != "und") & ~F.col(p + "ambiguous")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (3-word shingles, at most 3 bits)."""
    return simhash.one_of_each(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    items = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    return decontaminate.without_contaminated(docs, items).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays.  ``n_chars`` follows the new text."""
    p = prefix(docs)
    found = secrets.secret_scan(docs, prefix=p)
    new = {"text": F.col(p + "redacted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(p + "spans") != "", F.length(p + "redacted").cast(docs.schema["n_chars"].dataType)
                                ).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row a document that the mix takes words from (columns of ``op2``)."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: Language ID learns a model and the fingerprints need XXH64: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
