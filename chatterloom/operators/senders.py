"""Who wrote how much, in which export. Input: ``file_ord, file, seq, sender, text, at``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENOUGH = 300


def union_files(parts: Iterable[DataFrame]) -> DataFrame:
    """Messages of several uploads as one table, in upload order by ``(file_ord, seq)``."""
    first, *rest = list(parts)
    for p in rest:
        first = first.unionByName(p, allowMissingColumns=True)
    return first


def sender_counts(chat: DataFrame) -> DataFrame:
    """``sender, cnt, rank``: most talkative first, ties by first appearance."""
    # a hot sender is pre-aggregated on the map side; ranking sorts one row a sender
    per = chat.groupBy("sender").agg(F.count("*").alias("cnt"), F.min(F.struct("file_ord", "seq")).alias("first"))
    return per.orderBy(F.desc("cnt"), "first").select("sender", "cnt", "first")


def sender_payload(chat: DataFrame) -> DataFrame:
    """Per sender: count, whether it is enough to learn from, and its files in upload order."""
    per_file = chat.groupBy("sender", "file").agg(F.count("*").alias("n"), F.min("file_ord").alias("file_ord"), F.min("seq").alias("seq"))
    files = F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "file"))), lambda x: x["file"])
    return per_file.groupBy("sender").agg(
        F.sum("n").alias("cnt"), (F.sum("n") >= ENOUGH).alias("enough"), files.alias("files"), F.count("*").alias("n_files")
    )


def file_counts(chat: DataFrame, files: DataFrame) -> DataFrame:
    """Messages per file with its format; files without messages count zero."""
    n = chat.groupBy("file").agg(F.count("*").alias("cnt"))
    return files.select("file_ord", "file", "format").join(n, "file", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("bigint")))


def identity_split(chat: DataFrame, me: Iterable[str]) -> DataFrame:
    """``chat`` with ``mine``: whether the sender is one of the chosen labels, merged exactly."""
    return chat.withColumn("mine", F.col("sender").isin(*me))


def messages_of(chat: DataFrame, sender: str) -> DataFrame:
    return chat.where(F.col("sender") == sender).select("file_ord", "file", "seq", "text")


def without_file(chat: DataFrame, file: str) -> DataFrame:
    return chat.where(F.col("file") != file)
