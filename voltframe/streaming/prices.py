"""Tumbling price bins as a stream: late values are waited for, and each bin comes out once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_prices(spark: SparkSession, path: str, schema: str = "node long, ts timestamp, lmp double") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def binned_prices(prices: DataFrame, minutes: int = 5, late: str = "1 hour") -> DataFrame:
    """(node, ts, points, mean) of bins of so many minutes; values later than the watermark are left out."""
    w = F.window("ts", f"{int(minutes)} minutes")
    g = prices.withWatermark("ts", late).groupBy("node", w).agg(F.count("lmp").alias("points"), F.avg("lmp").alias("mean"))
    return g.select("node", F.col("window.start").alias("ts"), "points", "mean")
