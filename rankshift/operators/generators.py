"""Small models for the pluggable slots: generators, pair scorers and embedders that run inside Python workers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import regex

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def py_tokens(text: str) -> list[str]:
    """Same tokens as ``functions.text.word_tokens`` (for prompts)."""
    return [t.lower() for t in _WORD.findall(text or "")]


def overlap_scorer(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """RNK4 built-in pair scorer: Jaccard overlap of word sets."""
    vals = []
    for q, t in zip(queries, texts):
        a, b = set(py_tokens(q)), set(py_tokens(t))
        vals.append(len(a & b) / len(a | b) if (a or b) else 0.0)
    return pd.Series(vals, dtype="float64")


def hashing_embedder(dim: int = 256):
    """Built-in embedder for ``rank.embed_with``: L2-normalised hashed bag of
    words (md5 of the token, so it is stable across processes)."""
    import hashlib

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts.fillna(""):
            v = np.zeros(dim, dtype="float32")
            for tok in py_tokens(t):
                v[int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % dim] += 1.0
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


class CycleGenerator:
    """Small stand-in for a served model: the prompt's words, turned by ``turn``, repeated up to ``max_length`` words."""

    def __init__(self, turn: int = 0):
        self.turn = turn

    def generate(self, prompts: Sequence[str], seeds: Sequence[int], p: dict) -> list[str]:
        out = []
        for prompt in prompts:
            w = prompt.split()
            t = self.turn % len(w) if w else 0
            w = w[t:] + w[:t]
            n = int(p.get("max_length", 50))
            out.append(" ".join((w * (n // len(w) + 1))[:n]) if w else "")
        return out
