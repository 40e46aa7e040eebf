"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bind(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with columns that are computed once.

    Chained ``withColumn`` calls are collapsed into one projection, which repeats each
    expression at each use and can outgrow a generated method; a one-element generator
    between them keeps every value single and the generated code small.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, which a cluster
    names. Where it is unset and the master is local (tests, a single machine) it is a folder in
    the warehouse; a cluster without one is an error, as a machine's own folder is no place."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in :func:`shared_folder`."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than there are cores.

    For costly per-row Python work on small or unsplittable files; an input that already
    fills the cluster is left as it is and pays no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
