"""Conversations rebuilt from message rows.

Rows are partitioned by conversation and brought into order of their sequence number, and a
finite-state automaton reads them: nothing written yet, someone else has written, the owner
has answered. A conversation may hold a third of all rows, so no task ever reads a whole
one: the rows of a block of consecutive numbers are folded in order into the transition the
automaton makes over that block, and the transitions of the blocks are composed in order,
level by level. Each level holds at most ``BLOCK`` entries of a conversation in one group.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from chatterloom.llm.encoding import restore
from chatterloom.llm.lookalike import skeleton, written

BLOCK = 4096
#: Levels of composition: enough for BLOCK ** LEVELS rows of one conversation.
LEVELS = 4


def shows(label: str | None, owner: str | None) -> bool:
    """Whether a stored label shows the owner's, its characters damaged or look-alike."""
    if not label or not owner:
        return False
    if label == owner:
        return True
    a, b = skeleton(restore(label)[0]), skeleton(restore(owner)[0])
    if a == b:
        return True
    if "�" in a:
        pattern = "".join(".{1,%d}" % len(p) if p[0] == "�" else re.escape(p) for p in re.findall("�+|[^�]+", a))
        return bool(re.sub("[�\\W]", "", a)) and re.fullmatch(pattern, b) is not None
    return False


@F.pandas_udf(BooleanType())
def _shows_udf(label: pd.Series, owner: pd.Series) -> pd.Series:
    return pd.Series([shows(a, b) for a, b in zip(label, owner)])


def _owned(messages: DataFrame, files: DataFrame) -> DataFrame:
    """Labels of each file that are its owner's: ``ofile, osender``."""
    owners = files.select(F.col("file").alias("ofile"), "owner").where("owner is not null").distinct()
    labels = messages.select("file", "sender").where("sender <> ''").distinct()
    pairs = labels.join(owners, F.col("file") == F.col("ofile"))
    near = F.col("sender").rlike("[^\\x{20}-\\x{7e}]") | F.col("owner").rlike("[^\\x{20}-\\x{7e}]")
    hit = F.when(F.col("sender") == F.col("owner"), True).when(near, _shows_udf("sender", "owner")).otherwise(False)
    return pairs.where(hit).select("ofile", F.col("sender").alias("osender")).distinct()


def _key(sender: str) -> Column:
    """A label as a number; a null one is as an empty one."""
    return F.xxhash64(F.coalesce(sender, F.lit("")))


# A transition is (has_user, has_owner, answered): whether the stretch holds a written text of
# someone else, one of the owner, and one of the owner after one of someone else.
_IDENTITY = "named_struct('u', false, 'a', false, 'r', false)"
_COMPOSE = "(acc, x) -> named_struct('u', acc.u or x.t.u, 'a', acc.a or x.t.a, 'r', acc.r or x.t.r or (acc.u and x.t.a))"


def _fold() -> Column:
    return F.expr(f"aggregate(array_sort(collect_list(named_struct('k', k, 't', t))), {_IDENTITY}, {_COMPOSE})")


def judge(messages: DataFrame, files: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``file, reason`` of every conversation; ``reason`` is null for one to keep.

    The first that holds: ``empty`` (no written text), ``broken`` (a null or empty sender, a
    sequence number with differing senders or texts, numbers that are not 1 to n), ``no_reply``
    (no written text of the owner after one of someone else; always so where the file has no
    owner). Rows stored again change nothing. Rows with a null file belong to no
    conversation; a null ``msg_seq`` makes a conversation broken. Senders and texts are compared
    by 64-bit hashes, so that rows are aggregated by hashing and no text is shuffled.
    """
    m = messages.where("file is not null").select("file", "msg_seq", "sender", "text", written(F.col("text")).alias("w"))
    # one row per sequence number; a null text differs from an empty one
    m = m.select("file", "msg_seq", "w", _key("sender").alias("hs"), F.xxhash64(F.col("text").isNull(), "text").alias("ht"), (F.coalesce("sender", F.lit("")) == "").alias("nobody"))
    at = m.groupBy("file", "msg_seq").agg(
        F.max("hs").alias("hs"), F.max("w").alias("w"), (F.min("hs") != F.max("hs")).alias("differ_s"), (F.min("ht") != F.max("ht")).alias("differ_t"),
        F.max(F.col("nobody").cast("int")).alias("nobody"),
    )
    own = (_owned(messages, files) if own is None else own).select("ofile", _key("osender").alias("os")).distinct()
    seen = at.join(own, (F.col("file") == F.col("ofile")) & (F.col("hs") == F.col("os")), "left")
    mine = F.col("os").isNotNull()
    symbol = F.struct((F.col("w") & ~mine).alias("u"), (F.col("w") & mine).alias("a"), F.lit(False).alias("r"))
    level = seen.select(
        "file", F.coalesce("msg_seq", F.lit(-1)).alias("k"), symbol.alias("t"),
        (F.col("differ_s") | F.col("differ_t") | (F.col("nobody") == 1) | F.col("msg_seq").isNull()).alias("bad"),
        F.lit(1).cast("bigint").alias("n"), F.col("msg_seq").alias("lo"), F.col("msg_seq").alias("hi"),
    )
    for _ in range(LEVELS):
        level = level.groupBy("file", F.floor(F.col("k") / BLOCK).alias("b")).agg(
            _fold().alias("t"), F.max("bad").alias("bad"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        ).withColumnRenamed("b", "k")
    done = level.groupBy("file").agg(
        _fold().alias("t"), F.max("bad").alias("bad"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    whole = ~F.col("bad") & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))
    reason = (
        F.when(~(F.col("t.u") | F.col("t.a")), "empty")
        .when(~F.coalesce(whole, F.lit(False)), "broken")
        .when(~F.col("t.r"), "no_reply")
    )
    return done.select("file", reason.alias("reason"))


def dropped(messages: DataFrame, files: DataFrame) -> DataFrame:
    """``file, reason`` of the conversations to drop."""
    return judge(messages, files).where("reason is not null")


def rebuild(messages: DataFrame, files: DataFrame) -> DataFrame:
    """The kept conversations as rows in order: ``file, turn, role, sender, text, at``.

    ``turn`` counts the written messages of a conversation from 1; the owner is the
    ``assistant``, everyone else the ``user``. Numbers come from counts per block, so no
    window spans a conversation.
    """
    own = _owned(messages, files)
    keep = judge(messages, files, own).where("reason is null").select(F.col("file").alias("kfile"))
    # dropped conversations go first: only kept texts are shuffled, and each once
    m = messages.where(written(F.col("text"))).join(keep, F.col("file") == F.col("kfile"), "left_semi")
    m = m.groupBy("file", "msg_seq").agg(F.min(F.struct("msg_id", "sender", "text", "at")).alias("m")).withColumn("block", F.floor(F.col("msg_seq") / BLOCK))
    counts = m.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offset = counts.select(F.col("file").alias("bfile"), F.col("block").alias("bblock"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("msg_seq"))
    rows = m.withColumn("i", inside).join(offset, (F.col("file") == F.col("bfile")) & (F.col("block") == F.col("bblock")))
    rows = rows.select("file", (F.col("before") + F.col("i")).alias("turn"), "m.sender", "m.text", "m.at")
    rows = rows.join(own, (F.col("file") == F.col("ofile")) & (F.col("sender") == F.col("osender")), "left")
    role = F.when(F.col("osender").isNotNull(), "assistant").otherwise("user")
    return rows.select("file", "turn", role.alias("role"), "sender", "text", "at")
