"""Projections, filters and sampling on query/passage tables (§2.2).

Nested rows: ``ord, query, passages struct<is_selected array<int>,
passage_text array<string>>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.functions.hashing import U32, h32
from rankshift.operators.order import dense_index

# Columns each dataset kind keeps for modelling (PRJ4).
MODEL_COLUMNS = {
    "part_data": ("ord", "query", "passages"),
    "made_valid_data": ("ord", "query", "passages"),
    "made_data": ("ord", "query", "body", "label"),
    "full_data": ("ord", "query", "text"),
}


def explode_passages(df: DataFrame, keep: Sequence[str] = ("ord", "query")) -> DataFrame:
    """PRJ1: one row per passage with its 0-based position."""
    z = F.arrays_zip(F.col("passages.is_selected").alias("is_selected"),
                     F.col("passages.passage_text").alias("passage_text"))
    e = df.select(*keep, F.posexplode(z).alias("pos", "_p"))
    return e.select(*keep, "pos", F.col("_p.is_selected").alias("is_selected"),
                    F.col("_p.passage_text").alias("passage_text"))


def concat_passages(df: DataFrame, out: str = "target") -> DataFrame:
    """PRJ2: all passages of a query joined with an empty separator."""
    return df.withColumn(out, F.array_join(F.col("passages.passage_text"), ""))


def with_prompt(df: DataFrame, source: str = "query", target: str | None = None,
                prefix: str = "<LM>", eos: str = "</s>") -> DataFrame:
    """PRJ3: prefix the model input, suffix the target with eos."""
    out = df.withColumn(source, F.concat(F.lit(prefix), F.coalesce(F.col(source), F.lit(""))))
    if target:
        out = out.withColumn(target, F.concat(F.coalesce(F.col(target), F.lit("")), F.lit(eos)))
    return out


def model_columns(df: DataFrame, kind: str) -> DataFrame:
    """PRJ4: keep only the columns a dataset kind feeds to the model."""
    if kind not in MODEL_COLUMNS:
        raise NotImplementedError(f"unknown dataset kind {kind!r}")
    return df.select(*[c for c in MODEL_COLUMNS[kind] if c in df.columns])


def drop_non_text(df: DataFrame, cols: Sequence[str] = ("query", "text")) -> DataFrame:
    """FLT1: keep rows whose text columns are real strings (not null)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def selected_only(exploded: DataFrame) -> DataFrame:
    """FLT2: keep selected passages only."""
    return exploded.where(F.col("is_selected") == 1)


def head_n(df: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    """SMP1: first min(n, size) rows in file order: a dense index by the
    bucketed prefix sum and a plain filter, so nothing funnels through one
    task whatever ``n`` is."""
    return dense_index(df, ord_col, "_ri").where(F.col("_ri") < n).drop("_ri")


def hash_split(df: DataFrame, key: str, frac: float = 0.85, seed: int = 123,
               out: str = "split") -> DataFrame:
    """SMP2: deterministic train/test assignment from md5(seed || key);
    stable under re-partitioning and retries."""
    h = h32(F.lit(str(seed)), F.col(key))
    return df.withColumn(out, F.when(h < F.lit(int(frac * U32)), F.lit("train")).otherwise(F.lit("test")))


def with_batch_id(df: DataFrame, size: int, ord_col: str = "ord", out: str = "batch_id") -> DataFrame:
    """TOK9: fixed-size batches in order (last may be short)."""
    return (dense_index(df, ord_col, "_ri")
            .withColumn(out, F.floor(F.col("_ri") / size).cast("long")).drop("_ri"))


def sample_batches(df: DataFrame, k: int, size: int, seed: int = 0, ord_col: str = "ord") -> DataFrame:
    """SMP3: K batch draws with replacement; all rows of the drawn batches.

    Draw j picks batch ``floor(u_j * n_batches)`` with u_j = md5(seed|j) in
    [0, 1): seeded, reproducible on retries, and nothing reaches the driver
    (the batch count is a lazy scalar subquery).  Repeated draws collapse,
    as in the reference."""
    b = with_batch_id(df, size, ord_col)
    n_batches = b.select(F.max("batch_id") + 1).scalar()
    u = h32(F.lit(str(seed)), F.lit("|"), F.col("id")) / F.lit(float(U32))
    draws = (df.sparkSession.range(k)
             .select(F.floor(u * n_batches).cast("long").alias("batch_id")).distinct())
    return b.join(draws, "batch_id", "left_semi")
