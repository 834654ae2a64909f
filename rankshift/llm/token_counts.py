"""Token counts: batch encoding inside Arrow functions, returning lengths only.

The vocabulary file is a parameter; a task loads it once.  Arrow batches are
cut into runs of about equal bytes and long texts are split at safe
boundaries, so no call ever holds more than one run of pieces.

Safe boundary (piece models with the space marker U+2581): a single space
between two characters that are neither a space nor the marker.  No piece of
the vocabulary holds the marker after another character (checked when the
file is loaded), so no merge crosses such a boundary, and the model's own
leading marker stands for the removed space.  Equal pieces are encoded once
per cache generation; the cache is emptied when it is full, which only costs
time.  For ``.json`` vocabularies a text is encoded whole.

Null and empty texts have 0 bytes and 0 tokens.  Every input row gives one
output row, repeated rows included; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.llm.common import add_columns

MARK = "▁"
_SAFE = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")
CACHE_PIECES = 200_000
LONG_PIECE = 4096  # longer pieces are not kept in the cache


def safe_pieces(text: str) -> list[str]:
    """Pieces whose token counts add up to the count of the whole text."""
    if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
        return _SAFE.split(text)
    return text.split(" ")


def _piece_counter(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    splits = not any(MARK in p.lstrip(MARK) for p in pieces)
    cache: dict[str, int] = {}

    def count(texts: list) -> list[int]:
        out = []
        for t in texts:
            if not t:
                out.append(0)
                continue
            pieces = safe_pieces(t) if splits else [t]
            new = list(set(pieces).difference(cache))
            if new:
                if len(cache) + len(new) > CACHE_PIECES:
                    cache.clear()
                    new = list(set(pieces))
                cache.update(zip(new, map(len, model.encode(new, num_threads=1))))
            out.append(sum(map(cache.__getitem__, pieces)))
            for p in new:
                if len(p) > LONG_PIECE:
                    del cache[p]
        return out

    return count


def _json_counter(path: str):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def count(texts: list) -> list[int]:
        return [len(e) for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    return count


def token_counts(docs: DataFrame, vocab_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` plus ``out`` (long): tokens of the whole text under the vocabulary file."""

    def make():
        counter = (_json_counter if vocab_path.endswith(".json") else _piece_counter)(vocab_path)
        return lambda texts: [counter(texts)]

    return add_columns(docs, make, [(out, "long")], text)


def op10(docs: DataFrame, vocab_path: str, limit: int = 4096) -> DataFrame:
    rows = token_counts(docs.select("doc_id", "text"), vocab_path)
    return rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                       "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
