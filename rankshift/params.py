"""Frozen parameter objects passed to jobs (instead of a config framework)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class GenParams:
    """GEN2: sampling controls of a generator."""
    do_sample: bool = True
    num_beams: int = 1
    temperature: float = 1.0
    top_p: float = 0.9
    top_k: int = 0
    max_length: int = 150
    max_input: int = 0  # words of the prompt that are read; 0: all
    seed: int = 123

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class BM25Params:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class EvalParams:
    """One evaluation run (SNK7 keeps a copy of what was really used)."""
    launch_description: str = "eval"
    generator: str = "echo"     # echo, extractive or ngram (from bigram counts)
    total_samples: int = 500    # queries, in order
    max_words: int = 150        # words that echo and extractive take from a candidate
    batch_size: int = 8
    number_examples_batch: int = 3  # batches of examples that are kept; 0: none
    seed: int = 123
    ks: tuple = (1, 3, 5)
    quartile: float = 0.75
    strip_prompt: bool = False
    gen: GenParams = field(default_factory=GenParams)
    bm25: BM25Params = field(default_factory=BM25Params)

    def to_dict(self) -> dict:
        return asdict(self)
