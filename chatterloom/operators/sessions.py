"""Activity sessions separated by gaps of inactivity.

Window lag flags gaps, a running sum numbers the sessions, an aggregation closes them.
Before the window, rows are folded into buckets as wide as the gap: two rows of one bucket
are always in one session, so the fold loses nothing, combines on the map side, and leaves
at most one row per user and gap width (17,520 a year for 30 minutes) however many rows a
hot user has. The window therefore never holds a user's raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.functions.clock import wall_us

GAP_SECONDS = 30 * 60


def sessionize(
    rows: DataFrame,
    users: Sequence[str],
    at: str = "at",
    seq: str = "msg_seq",
    gap_seconds: int = GAP_SECONDS,
    distinct: bool = True,
) -> DataFrame:
    """Sessions of each user in order of (``at``, ``seq``).

    Returns the user columns, ``session_no`` (from 1), ``first_seq, last_seq, start_at,
    end_at, duration_s, n_events``.

    - Null ``at`` and a null or empty user column: the row does not count.
    - ``distinct``: rows equal in user, ``seq`` and ``at`` count once.
    - Ties in ``at`` are ordered by ``seq``, null ``seq`` first; exactly ``gap_seconds``
      apart is the same session.
    - Other columns of the input are ignored, so clashing names do no harm.
    - An empty table gives no sessions.
    """
    ok = F.col("__at").isNotNull()
    cols = [f"__u{i}" for i in range(len(users))]
    for c in cols:
        ok &= F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    base = rows.select(
        *[rows[u].alias(c) for u, c in zip(users, cols)],
        rows[at].cast("timestamp_ntz").alias("__at"),
        rows[seq].cast("bigint").alias("__seq"),
    ).where(ok)
    if distinct:
        base = base.distinct()
    gap_us = gap_seconds * 1_000_000
    point = F.struct(F.col("__at").alias("at"), F.col("__seq").alias("seq"))
    folded = base.groupBy(*cols, F.floor(wall_us(F.col("__at")) / gap_us).alias("__bucket")).agg(
        F.min(point).alias("lo"), F.max(point).alias("hi"), F.count("*").alias("n")
    )
    order = Window.partitionBy(*cols).orderBy("__bucket")
    gap = wall_us(F.col("lo.at")) - wall_us(F.lag("hi.at").over(order))
    flagged = folded.withColumn("__new", F.coalesce((gap > gap_us).cast("int"), F.lit(1)))
    numbered = flagged.withColumn("session_no", F.sum("__new").over(order))
    closed = numbered.groupBy(*cols, "session_no").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n_events")
    )
    return closed.select(
        *[F.col(c).alias(u) for u, c in zip(users, cols)],
        "session_no",
        F.col("lo.seq").alias("first_seq"),
        F.col("hi.seq").alias("last_seq"),
        F.col("lo.at").alias("start_at"),
        F.col("hi.at").alias("end_at"),
        ((wall_us(F.col("hi.at")) - wall_us(F.col("lo.at"))) / 1_000_000).alias("duration_s"),
        "n_events",
    )
