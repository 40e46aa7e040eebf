"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.functions.plan import spread
from chatterloom.llm import aliases, conversations, encoding, lookalike, packing, privacy, splitting, tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.garbled_found(table(spark, sf, "messages")).select("msg_id", "field")


@query("p2_restored")
def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.garbled_found(table(spark, sf, "messages"))


@query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.dropped(table(spark, sf, "messages"), table(spark, sf, "files"))


@query("p3_conversations")
def p3_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.rebuild(table(spark, sf, "messages"), table(spark, sf, "files"))


@query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.same_look_found(table(spark, sf, "messages"))


@query("p4_canonical")
def p4_canonical(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "messages").select("msg_id", "sender", "text")
    m = lookalike.with_form(lookalike.with_form(m, "sender", "sender_form", "canonical"), "text", "text_form", "canonical")
    return m.select("msg_id", "sender_form", "text_form")


@query("p8_ids")
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"))


@query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return aliases.aliases_found(table(spark, sf, "messages"), table(spark, sf, "pairs"))


@query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.personal_found(table(spark, sf, "messages"), table(spark, sf, "pairs"))


@query("p1_redacted")
def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.redacted(table(spark, sf, "messages"), table(spark, sf, "pairs"))


@query("p9_pack")
def p9_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in containers of each ``pack`` capacity; the last line of a transcript is its answer
    and bears loss, what stands before it does not; other texts bear loss as a whole."""
    docs = table(spark, sf, "documents")
    caps = [(r.limit_id, r.max_tokens) for r in table(spark, sf, "limits").where("purpose = 'pack'").collect()]
    answer = F.substring_index("text", "\n", -1)
    asked = F.when((F.col("kind") == "transcript") & F.contains("text", F.lit("\n")), F.substring("text", F.lit(1), F.length("text") - F.length(answer))).otherwise(F.lit(""))
    sized = spread(docs.select("doc_id", "text", "kind")).select("doc_id", tokens.counts_of([F.col("text"), asked]).alias("n"))
    whole, free = F.col("n")[0].cast("bigint"), F.col("n")[1].cast("bigint")
    items = sized.select("doc_id", whole.alias("n_tokens"), F.greatest(whole - free, F.lit(0).cast("bigint")).alias("n_loss"))
    return packing.pack(items, caps, docs.count())


@query("p10_split")
def p10_split(spark: SparkSession, sf: str) -> DataFrame:
    limits = [(r.limit_id, r.max_tokens, r.overlap_tokens) for r in table(spark, sf, "limits").where("purpose = 'split'").collect()]
    return splitting.split_corpus(table(spark, sf, "documents"), limits)
