"""Batch text generation (GEN1-GEN7).

Native generators (``echo``, ``extractive``) are column expressions.  Model
based generators run in ``mapInPandas``: the generator object is built once
per Python worker and every row gets a seed derived from its keys, so a
retried task writes the same text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankshift.functions.hashing import h32
from rankshift.functions.text import head_words
from rankshift.params import GenParams


def echo_texts(queries: DataFrame, cands: DataFrame, max_words: int = 150,
               keys: Sequence[str] = ("qid",)) -> DataFrame:
    """GEN6 ``echo``: query, a space, then the first ``max_words`` words of
    the list's first candidate (smallest idx).  -> keys, text."""
    keys = list(keys)
    first = cands.groupBy(*keys).agg(F.min_by(F.coalesce("text", F.lit("")), "idx").alias("_first"))
    return (queries.join(first, keys, "left")
            .select(*keys, F.concat_ws(" ", F.coalesce("query", F.lit("")),
                                       head_words(F.coalesce("_first", F.lit("")), max_words)).alias("text")))


def extractive_texts(queries: DataFrame, cands: DataFrame, max_words: int = 150,
                     keys: Sequence[str] = ("qid",)) -> DataFrame:
    """GEN6 ``extractive``: first ``max_words`` words of the longest candidate
    (ties: smallest idx).  -> keys, text."""
    keys = list(keys)
    t = F.coalesce("text", F.lit(""))
    best = cands.groupBy(*keys).agg(
        F.max_by(t, F.struct(F.length(t), -F.col("idx"))).alias("_best"))
    return (queries.select(*keys).join(best, keys, "left")
            .select(*keys, head_words(F.coalesce("_best", F.lit("")), max_words).alias("text")))


def strip_prompt(gen: DataFrame, query: str = "query", text: str = "text",
                 check: bool = False) -> DataFrame:
    """GEN3: cut ``length(query)`` characters from the front of the text.
    ``check=False`` cuts blindly (as the reference); ``check=True`` only when
    the text really starts with the query."""
    q = F.coalesce(F.col(query), F.lit(""))
    cut = F.substring(F.col(text), F.length(q) + 1, 1 << 30)
    cond = F.lit(True) if not check else F.startswith(F.col(text), q)
    return gen.withColumn(text, F.when(cond, cut).otherwise(F.col(text)))


def variants(queries: DataFrame, cands: DataFrame, lengths: Sequence[int] = (50, 150, 300),
             strip: Sequence[bool] = (False, True), generator: str = "echo",
             keys: Sequence[str] = ("qid",)) -> DataFrame:
    """GEN7: one generated text per (query, length, strip) -> keys, run, text.

    The longest text is generated once; shorter lengths are word cuts of it,
    and the variant grid is a literal array exploded per row (no join)."""
    keys = list(keys)
    gen_fn = {"echo": echo_texts, "extractive": extractive_texts}[generator]
    longest = max(lengths)
    base = gen_fn(queries, cands, longest, keys).join(queries.select(*keys, "query"), keys)
    grid = F.array(*[F.struct(F.lit(n).alias("len"), F.lit(s).alias("strip"),
                              F.lit(f"{generator}_len{n}_{'stripped' if s else 'kept'}").alias("run"))
                     for n in lengths for s in strip])
    g = base.select(*keys, "query", "text", F.explode(grid).alias("_v"))
    if generator == "echo":
        # echo = query + " " + head: keep all query words plus ``len`` words
        keep = F.size(F.split(F.coalesce(F.col("query"), F.lit("")), " ")) + F.col("_v.len")
    else:
        keep = F.col("_v.len")
    cut = F.array_join(F.slice(F.split(F.col("text"), " "), F.lit(1), keep), " ")
    g = g.select(*keys, "query", F.col("_v.run").alias("run"), F.col("_v.strip").alias("_strip"),
                 cut.alias("text"))
    stripped = F.substring(F.col("text"), F.length(F.coalesce("query", F.lit(""))) + 1, 1 << 30)
    return g.select(*keys, "run", F.when(F.col("_strip"), stripped).otherwise(F.col("text")).alias("text"))


# ----------------------------------------------------------------- GEN1 / GEN4

def _separated(keys: Sequence[str]) -> list:
    """Key columns with a mark between them, so that (1, 23) and (12, 3) differ."""
    return [x for k in keys for x in (F.col(k), F.lit("|"))]


def generate(df: DataFrame, make_generator: Callable[[], object], params: GenParams,
             keys: Sequence[str] = ("qid",), prompt: str = "query", extra: Sequence[str] = (),
             out: str = "generated_text", batch_rows: int = 64, partitions: int | None = None) -> DataFrame:
    """GEN1: one text per row via ``generator.generate(prompts, seeds, params)``.

    ``make_generator`` is called once per task.
    Rows are fed in chunks of ``batch_rows`` (the reference's batch size);
    ``partitions`` re-spreads the input first so each task's share fits.
    Output: keys + extra + prompt + ``out``; write it before scoring so the
    generation is not repeated by later actions."""
    keys, extra = list(keys), list(extra)
    dtypes = dict(df.dtypes)
    cols = keys + [c for c in extra if c not in keys] + [prompt]
    schema = ", ".join(f"`{c}` {dtypes[c]}" for c in cols) + f", `{out}` string"
    pd_params = params.to_dict()
    src = df.repartition(partitions) if partitions else df
    seeded = src.select(*cols, h32(F.lit(params.seed), F.lit("|"), *_separated(keys + extra)).alias("_seed"))

    def run(batches):
        gen = make_generator()
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                chunk = pdf.iloc[start:start + batch_rows]
                texts = gen.generate(chunk[prompt].fillna("").tolist(), chunk["_seed"].tolist(), pd_params)
                res = chunk[cols].copy()
                res[out] = texts
                yield res

    return seeded.mapInPandas(run, schema)
