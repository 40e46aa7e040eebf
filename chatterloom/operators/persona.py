"""Answers in a person's voice: retrieval first, a caller's generator on top if there is one.

Nothing here calls out by itself. ``generator`` is any callable from a list of role/content
messages to a text; it runs on the executors, batch by batch, and its failures fall back to
retrieval.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chatterloom.functions.chars import WS, utrim
from chatterloom.functions.text import clean_reply, first_chars, strip_echo
from chatterloom.operators import bm25, ngram

EXAMPLES, HISTORY, CONTEXT, COMPLETION_WORDS, ANCHORS = 5, 12, 4, 12, 14
Generator = Callable[[list[dict[str, str]]], str]


def last_n(array: Column, n: int) -> Column:
    """The last ``n`` entries of an array; null is empty."""
    size = F.size(array)
    return F.when(array.isNull(), F.slice(array, 1, 0)).otherwise(F.slice(array, F.greatest(size - n + 1, F.lit(1)), n))


def context_of(history: Column) -> Column:
    """Texts of the last four turns that have any, oldest first."""
    recent = F.transform(last_n(history, CONTEXT), lambda t: t["text"])
    return F.coalesce(F.filter(recent, lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def build_messages(system: Column, history: Column, message: Column) -> Column:
    """The instruction, the last twelve turns with text, the message; an unknown role is the user."""
    turns = F.filter(last_n(history, HISTORY), lambda t: F.coalesce(t["text"], F.lit("")) != "")
    turns = F.transform(
        turns, lambda t: F.struct(F.when(t["role"] == "assistant", "assistant").otherwise("user").alias("role"), t["text"].alias("content"))
    )
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.concat(one("system", system), F.coalesce(turns, F.slice(one("user", message), 1, 0)), one("user", message))


def chat_prompt(identity: str, traits: Column, median: Column, p90: Column, n_messages: Column, examples: Column) -> Column:
    """Instruction for a generator that answers as ``identity``; at most three times the usual
    long message, and never under 25 words."""
    habits = F.array_join(F.transform(traits, lambda t: F.concat(F.lit("* "), t["label"], F.lit(" = "), t["value"])), "\n")
    shown = F.array_join(F.transform(examples, lambda e: F.concat(e["who"], F.lit(": "), e["prompt"], F.lit(f"\n{identity}: "), e["reply"])), "\n\n")
    return F.concat(
        F.lit(f"Write the next chat message of {identity}.\nMeasured habits over "), n_messages.cast("string"), F.lit(" messages:\n"), habits,
        F.when(F.size(examples) > 0, F.concat(F.lit("\n\nOlder exchanges, for tone only; do not copy words or topics:\n"), shown)).otherwise(""),
        F.lit("\n\nKeep to about "), median.cast("string"), F.lit(" words, up to "), p90.cast("string"), F.lit(" for a real question and "),
        F.greatest(F.lit(25), p90 * 3).cast("string"), F.lit(" at most. Same spelling, case and emoji habits. Stay with what this conversation is about. Output the message alone."),
    )


def completion_prompt(identity: str, samples: Column, median: Column) -> Column:
    """Instruction for a generator that ends a half-written message, with up to 14 fixed samples."""
    lines = F.array_join(F.slice(samples, 1, ANCHORS), "\n")
    return F.concat(
        F.lit(f"Continue the message {identity} is typing."), F.when(F.size(samples) > 0, F.concat(F.lit(" Real messages, for tone only:\n"), lines)).otherwise(""),
        F.lit(f"\nGive only what follows, at most {COMPLETION_WORDS} words; the usual length is "), median.cast("string"),
        F.lit(" words. Do not say again what is already there."),
    )


def generate(rows: DataFrame, messages: str, out: str, generator: Generator) -> DataFrame:
    """``rows`` with the generator's answer; null where it fails."""
    fields = StructType([*rows.schema.fields, StructField(out, StringType())])
    spot = rows.columns.index(messages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = []
            for turns in pdf.iloc[:, spot]:
                try:
                    said.append(generator([{"role": t["role"], "content": t["content"]} for t in turns]))
                except Exception:  # any failure of a caller's generator means no answer
                    said.append(None)
            pdf[out] = pd.Series(said, dtype="object", index=pdf.index)
            yield pdf

    return rows.mapInPandas(run, fields)


def reply(
    queries: DataFrame, index: bm25.Index, identity: str, profile: DataFrame | None = None, generator: Generator | None = None
) -> DataFrame:
    """``q_id, reply, source, match, matched_prompt, examples`` for ``q_id, text, history``.

    ``source`` is ``model`` where the generator gives text, ``retrieval`` where the best prompt
    scores 0.21 or more (its reply comes back verbatim), else ``none`` with an empty reply.
    ``profile`` is one row ``traits, median, p90, messages``; a generator needs it.
    """
    asked = queries.withColumn("context", context_of(F.col("history")))
    hits = bm25.search(index, asked.select("q_id", "text", "context"), EXAMPLES)
    full = hits.join(index.pairs.select("pair_id", "prompt", "reply", "who"), "pair_id")
    cut = F.struct("rank", first_chars(F.col("prompt"), 160).alias("prompt"), first_chars(F.col("reply"), 160).alias("reply"), "who", F.round("score", 2).alias("score"))
    got = full.groupBy("q_id").agg(
        F.transform(F.array_sort(F.collect_list(cut)), lambda e: e.dropFields("rank")).alias("examples"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"),
        F.max(F.when(F.col("rank") == 1, F.col("reply"))).alias("top_reply"),
    )
    rows = queries.join(got, "q_id", "left")
    empty = F.array().cast("array<struct<prompt:string,reply:string,who:string,score:double>>")
    rows = rows.withColumn("examples", F.coalesce("examples", empty))
    rows = rows.withColumn("said", F.lit(None).cast("string"))
    if generator is not None and profile is not None:
        p = F.broadcast(profile)
        system = chat_prompt(identity, F.col("traits"), F.col("median"), F.col("p90"), F.col("messages"), F.col("examples"))
        ready = rows.drop("said").crossJoin(p).withColumn("turns", build_messages(system, F.col("history"), F.col("text"))).drop(*profile.columns)
        rows = generate(ready, "turns", "said", generator).withColumn("said", clean_reply(F.col("said"), identity))
    spoken = F.coalesce(F.col("said"), F.lit("")) != ""
    found = ~spoken & (F.coalesce("top", F.lit(0.0)) >= bm25.MIN_SCORE)
    return rows.select(
        "q_id", F.when(spoken, F.col("said")).when(found, F.col("top_reply")).otherwise("").alias("reply"),
        F.when(spoken, "model").when(found, "retrieval").otherwise("none").alias("source"),
        F.when(found, F.round("top", 2)).alias("match"), F.when(found, F.col("examples")[0]["prompt"]).alias("matched_prompt"), "examples",
    )


def finish_completion(typed: Column, said: Column, identity: str, mid_word: Column) -> Column:
    """A generator's continuation made ready to append: cleaned, echo removed, first line, at most
    twelve words, with the blank that joins it to ``typed``."""
    out = strip_echo(typed, clean_reply(said, identity))
    out = utrim(F.get(F.split(out, "\n"), F.lit(0)))
    words = F.filter(F.split(out, f"[{WS}]+"), lambda w: w != "")
    out = F.when(F.size(words) > COMPLETION_WORDS, F.array_join(F.slice(words, 1, COMPLETION_WORDS), " ")).otherwise(out)
    gap = ~mid_word & (typed != "") & ~typed.rlike(f"[{WS}]$")
    return F.when(F.coalesce(out, F.lit("")) == "", "").when(gap, F.concat(F.lit(" "), out)).otherwise(out)


def completion_source(text: Column, prefix: Column, has_generator: bool, enabled: bool = True) -> Column:
    """Why a completion is or is not asked for: ``disabled``, ``none``, ``midword`` or ``model``."""
    if not enabled:
        return F.lit("disabled")
    quiet = utrim(F.coalesce(text, F.lit(""))) == ""
    return F.when(quiet | F.lit(not has_generator), "none").when(prefix != "", "midword").otherwise("model")


def complete(queries: DataFrame, model: ngram.Model, profile: DataFrame, identity: str, generator: Generator) -> DataFrame:
    """``q_id, completion, source`` of ``q_id, text``: the prompt of :func:`completion_prompt` through
    the generator and :func:`finish_completion`.

    ``source`` says why there is none: ``none`` for a blank text, ``midword`` for a half-typed word
    (the predictor's work), ``failed`` where the generator gave nothing. ``profile`` is one row with
    ``samples`` and ``median``.
    """
    state = ngram.resolve(model, queries).select("q_id", "text", "prefix")
    state = state.withColumn("source", completion_source(F.col("text"), F.col("prefix"), True))
    p = F.broadcast(profile.select("samples", "median"))
    system = completion_prompt(identity, F.col("samples"), F.col("median"))
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    live = state.where("source = 'model'").crossJoin(p).select("q_id", "text", F.concat(one("system", system), one("user", F.col("text"))).alias("turns"))
    said = generate(live, "turns", "said", generator).select("q_id", finish_completion(F.col("text"), F.col("said"), identity, F.lit(False)).alias("made"))
    both = state.join(said, "q_id", "left")
    made = F.coalesce("made", F.lit(""))
    source = F.when((F.col("source") == "model") & (made == ""), "failed").otherwise(F.col("source"))
    return both.select("q_id", made.alias("completion"), source.alias("source"))


def status(generator: Generator | None) -> str:
    """``ready``, ``failing`` or ``absent``: what a generator makes of one short message."""
    if generator is None:
        return "absent"
    try:
        return "ready" if generator([{"role": "user", "content": "hi"}]) else "failing"
    except Exception:  # any failure of a caller's generator means it cannot answer
        return "failing"
