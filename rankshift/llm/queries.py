"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from rankshift.llm import (decontaminate, language, mixing, negatives, pii, quality, secrets, simhash, suffix_dedup,
                           token_counts, topk, toxicity, whitening)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES = {
    "op1_topk_search": lambda s, d: topk.op1(_table(s, d, "embeddings")),
    "op2_mixing": lambda s, d: mixing.op2(_table(s, d, "documents")),
    "op3_suffix_dedup": lambda s, d: suffix_dedup.op3(_table(s, d, "documents")),
    "op4_decontaminate": lambda s, d: decontaminate.op4(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op5_secrets": lambda s, d: secrets.op5(_table(s, d, "documents")),
    "op6_toxicity": lambda s, d: toxicity.op6(_table(s, d, "documents"), _table(s, d, "labels")),
    "op7_simhash": lambda s, d: simhash.op7(_table(s, d, "documents")),
    "op8_language": lambda s, d: language.op8(_table(s, d, "documents")),
    "op9_quality": lambda s, d: quality.op9(_table(s, d, "documents"), _table(s, d, "labels")),
    "op10_token_counts": lambda s, d: token_counts.op10(_table(s, d, "documents"), vocabulary()),
    "op11_hard_negatives": lambda s, d: negatives.op11(_table(s, d, "embeddings")),
    "op12_pii": lambda s, d: pii.op12(_table(s, d, "documents")),
    "op13_whitening": lambda s, d: whitening.op13(_table(s, d, "embeddings")),
}

ORACLE = {
    "op1_topk_search": topk.SQL.format(vectors="embeddings"),
    "op2_mixing": mixing.SQL.format(docs="documents"),
    "op4_decontaminate": decontaminate.SQL.format(docs="documents", benchmark="benchmark"),
    "op11_hard_negatives": negatives.SQL.format(vectors="embeddings"),
}
