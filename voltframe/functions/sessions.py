"""Checkpoints, bounded collections, and small session matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession

#: Graphs of at most so many edges may be handled by a local kernel; larger ones go the distributed way.
LOCAL_EDGES = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); one of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        import tempfile

        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")

        where = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: lineage ends there and no lost executor takes rows along."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, *columns: str) -> DataFrame:
    """cut(), dealt by columns in a way that later joins on them make use of: a plan that adapts itself would forget how rows lie."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key, "true")
    conf.set(key, "false")
    try:
        return cut(df.repartition(*columns))
    finally:
        conf.set(key, before)


def bounded(df: DataFrame, most: int = LOCAL_EDGES) -> list[Row] | None:
    """The rows of df, or None if there are more than most. They are counted first: none come to the driver from a larger table."""
    if df.count() > most:
        return None
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None
