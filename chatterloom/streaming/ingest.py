"""Messages and events as they arrive. The batch operators stay the reference for results; these
are the incremental forms whose state is bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file or a folder of them as a stream, with the schema of what lies there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    return reader.parquet(path)


def activity(events: DataFrame, user: str, at: str, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user as event-time windows: ``user, start_at, end_at, n_events``.

    State of a session is dropped once the watermark passes its end.
    """
    e = events.select(F.col(user).alias("user"), F.col(at).cast("timestamp").alias("at")).where("user is not null and at is not null")
    s = e.withWatermark("at", late).groupBy("user", F.session_window("at", gap).alias("w"))
    return s.agg(F.min("at").alias("start_at"), F.max("at").alias("end_at"), F.count("*").alias("n_events")).drop("w")


def per_window(events: DataFrame, kind: str, at: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per kind and tumbling window: ``kind, start_at, n_events``."""
    e = events.select(F.col(kind).alias("kind"), F.col(at).cast("timestamp").alias("at"))
    w = e.withWatermark("at", late).groupBy("kind", F.window("at", width).alias("w")).agg(F.count("*").alias("n_events"))
    return w.select("kind", F.col("w.start").alias("start_at"), "n_events")


def to_folder(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, through the streaming engine into a folder. Each batch writes what
    it changed into a folder of its own and writes the same again when it is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What :func:`to_folder` wrote last for each key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows appended to a folder, exactly once."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).start()
