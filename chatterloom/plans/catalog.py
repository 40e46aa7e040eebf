"""Named queries over the tables of a data folder, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.operators.instants import to_instants
from chatterloom.operators.sessions import sessionize

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


@query(
    "p5_found",
    """
    WITH d AS (SELECT DISTINCT file, sender, msg_seq, "at" FROM messages
               WHERE "at" IS NOT NULL AND file <> '' AND sender <> ''),
    g AS (SELECT *, lag("at") OVER (PARTITION BY file, sender ORDER BY "at", msg_seq) AS before FROM d),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR "at" - before > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                    OVER (PARTITION BY file, sender ORDER BY "at", msg_seq ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT file, sender, arg_min(msg_seq, ("at", msg_seq)) AS first_seq, arg_max(msg_seq, ("at", msg_seq)) AS last_seq
    FROM s GROUP BY file, sender, n
    """,
)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    made = sessionize(table(spark, sf, "messages"), ["file", "sender"], "at", "msg_seq")
    return made.select("file", "sender", "first_seq", "last_seq")


@query(
    "p5_sessions_devices",
    """
    WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
    SELECT user_id, session_no::BIGINT AS session_no, min(ts) AS start_at, max(ts) AS end_at, count(*) AS n_events
    FROM s GROUP BY user_id, session_no
    """,
)
def p5_sessions_devices(spark: SparkSession, sf: str) -> DataFrame:
    made = sessionize(table(spark, sf, "events"), ["user_id"], "ts", "event_id")
    return made.select("user_id", "session_no", "start_at", "end_at", "n_events")


@query("p7_found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps that fix an instant. A stamp without zone in a file without one is no case here, so
    nothing is estimated; that is ``p7_estimated``."""
    made = to_instants(table(spark, sf, "raw_messages"), table(spark, sf, "files"), estimate=False)
    return made.where("utc_us is not null").select("raw_id", "utc_us")


@query("p7_estimated")
def p7_estimated(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps that fix an instant only by the zone estimated for their export."""
    made = to_instants(table(spark, sf, "raw_messages"), table(spark, sf, "files"))
    return made.where(F.col("zone_from") == "estimated").select("raw_id", "utc_us")


@query("p7_estimate_measured")
def p7_estimate_measured(spark: SparkSession, sf: str) -> DataFrame:
    """The estimate where the answer is known: the zones of all files that state one are hidden.

    ``stamps`` without zone in such files that also have a zoned stamp to align with, how many of
    them were ``estimated``, and for how many the instant is ``right`` to the microsecond.
    """
    raw, files = table(spark, sf, "raw_messages"), table(spark, sf, "files").where("zone is not null")
    raw = raw.join(files.select("file"), "file", "left_semi")
    true = to_instants(raw, files, estimate=False).select("raw_id", F.col("utc_us").alias("true_us"), F.col("zone_from").alias("source"))
    hidden = files.withColumn("zone", F.lit(None).cast("string"))
    guess = to_instants(raw, hidden).select(F.col("raw_id").alias("gid"), F.col("utc_us").alias("guess_us"), "zone_from")
    both = true.join(guess, F.col("raw_id") == F.col("gid")).join(raw.select(F.col("raw_id").alias("rid"), "file"), F.col("raw_id") == F.col("rid"))
    anchored = both.where("source = 'stamp'").select(F.col("file").alias("afile")).distinct()
    asked = both.where("source = 'file'").join(anchored, F.col("file") == F.col("afile"), "left_semi")
    return asked.agg(
        F.count("*").alias("stamps"), F.count_if(F.col("zone_from") == "estimated").alias("estimated"),
        F.count_if((F.col("zone_from") == "estimated") & (F.col("guess_us") == F.col("true_us"))).alias("right"),
    )
