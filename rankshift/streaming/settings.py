"""Per-chat settings state (STR1), request answering (STR2), batch forms (STR3).

Event mapping of the ``events`` table (one chat = one ``user_id``):
signup = start, purchase = model choice (``floor(value) % 6`` picks the
model), click = "word_count" button (mode -> settings), view = a text
message whose text is ``floor(value)``, error = the generation finished.

The fold of one chat is a small finite-state machine.  Streaming keeps its
state per key in the RocksDB state store (``transformWithStateInPandas``);
the batch form needs no state: every field of it is a last value of some kind
of earlier event, found by windows over pieces of a chat's history.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the chat front end: model keys -> model names, start
# state, accepted word-count range.
MODEL_CHOICES = {
    "gpt2": "gpt2",
    "sber-large": "ai-forever/rugpt3large_based_on_gpt2",
    "sber-medium": "ai-forever/rugpt3medium_based_on_gpt2",
    "fred": "ai-forever/FRED-T5-large",
    "t5-small": "flan-t5-small",
    "t5-big": "flan-t5-large",
}
START = ("gpt2", 100, "input")
WORD_MIN, WORD_MAX = 10, 1023
_INT = re.compile(r"^\s*[+-]?[0-9]+\s*$")

OUT_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("outcome", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("word_count", T.IntegerType()),
    T.StructField("mode", T.StringType()),
])
OUT_COLS = [f.name for f in OUT_SCHEMA.fields]


def parse_word_count(text: str) -> int | None:
    """Optional sign and digits only (no underscores, no decimals)."""
    return int(text) if text is not None and _INT.match(text) else None


def event_text(kind: str, value: float) -> str | None:
    if kind == "view":
        return str(int(math.floor(value))) if value is not None else ""
    if kind == "purchase":
        keys = list(MODEL_CHOICES)
        return keys[int(math.floor(value or 0)) % len(keys)]
    return None


def step(state: tuple, kind: str, text: str | None) -> tuple[tuple, str]:
    """One event: (model, word_count, mode) -> new state, outcome."""
    model, wc, mode = state
    if kind == "signup":
        return state, "start"
    if kind == "purchase":
        return (MODEL_CHOICES[text], wc, "input"), "set_model"
    if kind == "click":
        return (model, wc, "settings"), "settings"
    if kind == "view":
        if mode == "settings":
            n = parse_word_count(text)
            if n is not None and WORD_MIN <= n <= WORD_MAX:
                return (model, n, "input"), "set"
            return state, "rejected"
        if mode == "input":
            return (model, wc, "wait"), "request"
        return state, "busy"
    if kind == "error":
        if mode == "wait":
            return (model, wc, "input"), "done"
        return state, "ignored"
    return state, "unknown"


def fold(state: tuple, pdf: pd.DataFrame, last_ts=None) -> tuple[tuple, list, object]:
    """Fold events (already sorted by ts, event_id) from ``state``; events
    older than ``last_ts`` are late and leave the state unchanged."""
    out = []
    for r in pdf.itertuples(index=False):
        text = event_text(r.event_type, r.value)
        if last_ts is not None and r.ts < last_ts:
            out.append((r.user_id, r.event_id, r.ts, r.event_type, text, "late", *state))
            continue
        state, outcome = step(state, r.event_type, text)
        last_ts = r.ts
        out.append((r.user_id, r.event_id, r.ts, r.event_type, text, outcome, *state))
    return state, out, last_ts


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=OUT_COLS)


# ----------------------------------------------------------------- streaming

def settings_stream(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """STR1 on a streaming DataFrame of events -> per-event outcomes.

    Rows of one key inside a micro-batch are sorted by (ts, event_id)
    before folding; the micro-batch size (``maxFilesPerTrigger`` /
    ``maxBytesPerTrigger`` of the source) bounds that work.  ``ttl_ms``
    expires the state of chats idle that long (a returning chat starts over,
    as after a restart of the reference's process)."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    state_schema = T.StructType([
        T.StructField("model", T.StringType()), T.StructField("word_count", T.IntegerType()),
        T.StructField("mode", T.StringType()), T.StructField("last_ts", T.TimestampNTZType()),
    ])

    class SettingsProcessor(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("settings", state_schema, ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
            if self.state.exists():
                m, wc, mode, last = self.state.get()
                st = (m, int(wc), mode)
            else:
                st, last = START, None
            st, out, last = fold(st, pdf, last)
            self.state.update((st[0], int(st[1]), st[2], last))
            yield _frame(out)

        def close(self) -> None:
            pass

    cols = events.select("user_id", "event_id", "ts", "event_type", "value")
    return cols.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=SettingsProcessor(), outputStructType=OUT_SCHEMA,
        outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


# -------------------------------------------------------------- batch forms

def _last_before(df: DataFrame, values: dict[str, Column], through: bool = False) -> DataFrame:
    """Add, for each name, the last non-null value among the chat's earlier events (``through``: this one included).

    Taking the last value is associative, so a chat is never held whole: last values inside a (chat, chunk) piece by
    a window over the piece, last values of earlier pieces by a window over one row a piece."""
    order = F.struct("ts", "event_id")
    made = df.withColumns({f"_{n}": v for n, v in values.items()})
    ends = made.groupBy("user_id", "chunk").agg(*(
        F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), order)).alias(n) for n in values))
    earlier = Window.partitionBy("user_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("user_id", "chunk", *(F.last(n, ignorenulls=True).over(earlier).alias(f"_{n}_in") for n in values))
    inside = Window.partitionBy("user_id", "chunk").orderBy("ts", "event_id").rowsBetween(
        Window.unboundedPreceding, 0 if through else -1)
    made = made.join(ends, ["user_id", "chunk"]).withColumns({
        n: F.coalesce(F.last(f"_{n}", ignorenulls=True).over(inside), f"_{n}_in") for n in values})
    return made.drop(*(f"_{n}" for n in values), *(f"_{n}_in" for n in values))


def settings_fold(events: DataFrame, chunk_seconds: int = 86400) -> DataFrame:
    """STR1 batch form in built-in functions; events of a chat count in (ts, event_id) order.

    The mode before an event follows from two "last value" look-backs:

    - it is ``settings`` if the last click, model choice or accepted number was a click: a number is accepted in
      that mode only, and each of the three sets the mode whatever it was;
    - otherwise it is ``wait`` if the last event but starts was a text that was not an accepted setting, and
      ``input`` after anything else (a text leads to ``wait``, all others to ``input``).

    Model and word count are the last chosen and the last accepted ones."""
    kind, value = F.col("event_type"), F.col("value")
    number = F.floor("value")
    fits = (kind == "view") & F.coalesce(number.between(WORD_MIN, WORD_MAX), F.lit(False))
    keys = F.array(*map(F.lit, MODEL_CHOICES))
    choice = F.when(kind == "purchase", F.get(keys, F.pmod(F.floor(F.coalesce(value, F.lit(0.0))), F.lit(len(MODEL_CHOICES))).cast("int")))
    ev = events.select("user_id", "event_id", "ts", "event_type", "value").withColumns({
        "chunk": F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / chunk_seconds).cast("long"), "choice": choice})
    ev = _last_before(ev, {"gate": F.when(kind.isin("click", "purchase") | fits, kind)})
    open_ = F.coalesce(F.col("gate") == "click", F.lit(False))
    ev = ev.withColumns({"open": open_, "accepted": open_ & fits})
    known = F.col("event_type").isin("purchase", "click", "view", "error")
    ev = _last_before(ev, {"prior": F.when(known, F.concat_ws(":", "event_type", F.col("accepted").cast("string")))})
    names = F.create_map(*(F.lit(x) for kv in MODEL_CHOICES.items() for x in kv))
    ev = _last_before(ev, {"model": F.element_at(names, F.col("choice")),
                           "word_count": F.when(F.col("accepted"), number.cast("int"))}, through=True)
    before = (F.when(F.col("open"), "settings").when(F.col("prior") == "view:false", "wait").otherwise("input"))
    ev = ev.withColumn("before", before)
    b = F.col("before")
    outcome = (F.when(kind == "signup", "start").when(kind == "purchase", "set_model").when(kind == "click", "settings")
               .when(kind == "view", F.when(b == "input", "request").when(b == "wait", "busy")
                     .when(F.col("accepted"), "set").otherwise("rejected"))
               .when(kind == "error", F.when(b == "wait", "done").otherwise("ignored")).otherwise("unknown"))
    mode = (F.when(kind == "purchase", "input").when(kind == "click", "settings")
            .when(kind == "view", F.when(F.col("accepted"), "input").when(b == "settings", "settings").otherwise("wait"))
            .when((kind == "error") & (b == "wait"), "input").otherwise(b))
    text = F.when(kind == "view", F.coalesce(number.cast("string"), F.lit(""))).when(kind == "purchase", F.col("choice"))
    return ev.select("user_id", "event_id", "ts", kind.alias("kind"), text.alias("text"), outcome.alias("outcome"),
                     F.coalesce("model", F.lit(START[0])).alias("model"),
                     F.coalesce("word_count", F.lit(START[1])).alias("word_count"), mode.alias("mode"))


def latest_valid_setting(events: DataFrame) -> DataFrame:
    """STR3: per chat, the latest message that passes the word-count rule
    (``floor(value)`` within range), by (ts, event_id)."""
    v = events.where((F.col("event_type") == "view") & F.floor("value").between(WORD_MIN, WORD_MAX))
    return v.groupBy("user_id").agg(
        F.max_by(F.floor("value").cast("int"), F.struct("ts", "event_id")).alias("word_count"),
        F.count(F.lit(1)).alias("n_valid"))


def respond(requests: DataFrame, make_generator, seed: int = 0) -> DataFrame:
    """STR2: answer each ``request`` outcome with the chat's own model and
    word count (works on streaming and batch DataFrames)."""
    from rankshift.functions.hashing import h32

    req = requests.where(F.col("outcome") == "request").select(
        "user_id", "event_id", "model", "word_count", "text",
        h32(F.lit(seed), F.lit("|"), F.col("user_id"), F.lit("|"), F.col("event_id")).alias("seed"))

    def run(batches):
        models = {}  # built once per task and model
        for pdf in batches:
            res = pdf[["user_id", "event_id", "model", "word_count"]].copy()
            texts = []
            for r in pdf.itertuples(index=False):
                if r.model not in models:
                    models[r.model] = make_generator(r.model)
                texts.append(models[r.model].generate([r.text or ""], [r.seed], {"max_length": int(r.word_count)})[0])
            res["generated_text"] = texts
            yield res

    return req.mapInPandas(run, "user_id long, event_id long, model string, word_count int, generated_text string")
