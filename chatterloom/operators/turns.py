"""Runs of one sender as turns, and what was answered to what."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.functions.chars import utrim
from chatterloom.functions.clock import wall_us
from chatterloom.functions.text import INDEX_WORD, all_matches

MAX_GAP_MINUTES, MAX_TURN_CHARS, MAX_REPLY_CHARS, MIN_PROMPT_WORDS = 30, 400, 300, 2


#: Sequence numbers of a file that one window may hold.
BLOCK = 4096


def number_runs(chat: DataFrame) -> DataFrame:
    """``chat`` with ``turn``: runs of one sender in a file, counted from 1.

    Runs are found inside blocks of ``BLOCK`` sequence numbers; only one summary row a block
    (its first and last sender and its number of changes) is read in order per file, so a
    file with very many rows never meets in one task.
    """
    keys = ["file_ord", "file"]
    c = chat.withColumn("__b", F.floor(F.col("seq") / BLOCK))
    w = Window.partitionBy(*keys, "__b").orderBy("seq")
    change = (~F.col("sender").eqNullSafe(F.lag("sender").over(w)) & (F.row_number().over(w) > 1)).cast("int")
    c = c.withColumn("__change", change).withColumn("__local", F.sum("__change").over(w))
    ends = c.groupBy(*keys, "__b").agg(
        F.min_by(F.struct("sender"), "seq").alias("head"), F.max_by(F.struct("sender"), "seq").alias("tail"), F.sum("__change").alias("n")
    )
    order = Window.partitionBy(*keys).orderBy("__b")
    opens = (~F.col("head").eqNullSafe(F.lag("tail").over(order))).cast("int")
    ends = ends.withColumn("opens", opens)
    upto = F.sum(F.col("opens") + F.col("n")).over(order) - F.col("n")
    starts = ends.select(*[F.col(k).alias("s_" + k) for k in keys], F.col("__b").alias("s_b"), upto.alias("__start"))
    on = (F.col("file_ord") == F.col("s_file_ord")) & (F.col("file") == F.col("s_file")) & (F.col("__b") == F.col("s_b"))
    return c.join(starts, on).withColumn("turn", F.col("__start") + F.col("__local")).drop(
        "__change", "__local", "__start", "s_file_ord", "s_file", "s_b"
    )


def turns(chat: DataFrame) -> DataFrame:
    """``file_ord, file, turn, sender, text, at``: consecutive messages of one sender joined.

    ``at`` is the first message's. A message joins while the turn so far is shorter than 400
    characters; later ones of the run are left out. Texts are trimmed, a null text is empty.
    Null senders form runs of their own. ``seq`` must be unique in a file.
    """
    keys = ["file_ord", "file", "turn"]
    c = number_runs(chat).withColumn("text", F.coalesce(utrim(F.col("text")), F.lit("")))
    before = F.sum(F.length("text") + 1)
    # a message that is too late in its own block is too late in its run: few rows of a long run go on
    block = Window.partitionBy(*keys, "__b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__near", F.coalesce(before.over(block) - 1, F.lit(-1))).where(F.col("__near") < MAX_TURN_CHARS)
    run = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__before", F.coalesce(before.over(run) - 1, F.lit(-1))).where(F.col("__before") < MAX_TURN_CHARS)
    line = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return c.groupBy(*keys).agg(
        F.first("sender").alias("sender"),
        utrim(F.array_join(F.transform(line, lambda x: x["text"]), " ")).alias("text"),
        F.min_by("at", "seq").alias("at"),
    )


def reply_pairs(made: DataFrame, me: Iterable[str]) -> DataFrame:
    """``file_ord, file, turn, prompt, reply, who``: a turn of someone else answered by one of
    ``me`` within 30 minutes.

    A missing time on either side does not rule a pair out. Prompts need two words, replies at
    most 300 characters; pairs never cross files.
    """
    me = list(me)
    asked = made.select(
        F.col("file_ord").alias("p_ord"), F.col("file").alias("p_file"), (F.col("turn") + 1).alias("p_turn"),
        F.col("sender").alias("who"), F.col("text").alias("prompt"), F.col("at").alias("asked_at"),
    ).where(~F.col("who").isin(*me))
    answered = made.where(F.col("sender").isin(*me)).select("file_ord", "file", "turn", "sender", F.col("text").alias("reply"), "at")
    # neighbours meet by number, an equi-join, instead of a window over the file
    on = (F.col("file_ord") == F.col("p_ord")) & (F.col("file") == F.col("p_file")) & (F.col("turn") == F.col("p_turn"))
    p = answered.join(asked, on)
    gap = wall_us(F.col("at")) - wall_us(F.col("asked_at"))
    soon = F.coalesce(gap.between(0, MAX_GAP_MINUTES * 60_000_000), F.lit(True))
    return p.where(
        (F.col("prompt") != "") & (F.col("reply") != "")
        & (F.length("reply") <= MAX_REPLY_CHARS) & soon
        & (F.size(all_matches(F.lower("prompt"), INDEX_WORD)) >= MIN_PROMPT_WORDS)
    ).select("file_ord", "file", "turn", F.substring("prompt", 1, MAX_TURN_CHARS).alias("prompt"), "reply", "who")


def numbered(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``pair_id``: 1, 2, ... in order of file and turn, without gaps or repeats.

    Pairs are counted per block of turns; one row a block is read in order, and numbers inside a
    block by a window of at most ``BLOCK`` rows.
    """
    keys = ["file_ord", "file"]
    p = pairs.withColumn("__b", F.floor(F.col("turn") / BLOCK))
    counts = p.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    # blocks before it: those of its file in order, and all of the files before it
    inside = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("__n")
    files = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    before = files.select(*[F.col(k).alias("s_" + k) for k in keys], (F.sum("__all").over(Window.orderBy(*keys)) - F.col("__all")).alias("__before"))
    starts = counts.withColumn("__inside", inside).join(before, (F.col("file_ord") == F.col("s_file_ord")) & (F.col("file") == F.col("s_file")))
    starts = starts.select(*[F.col(k).alias("t_" + k) for k in keys], F.col("__b").alias("t_b"), (F.col("__before") + F.col("__inside")).alias("__start"))
    on = (F.col("file_ord") == F.col("t_file_ord")) & (F.col("file") == F.col("t_file")) & (F.col("__b") == F.col("t_b"))
    local = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("turn"))
    return p.withColumn("__i", local).join(starts, on).withColumn("pair_id", F.col("__start") + F.col("__i")).drop(
        "__b", "__i", "__start", "t_file_ord", "t_file", "t_b"
    )
