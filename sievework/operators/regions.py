"""Interval joins: which region holds a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Regions are filed under every bucket of so many lines that they touch, so that the join has an equality.
BUCKET = 64


def contain(points: DataFrame, regions: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """points (keys, line, ...) with region: the least lo of the regions (keys, lo, hi) with lo <= line <= hi, or null. An equality
    join on keys and buckets, so neither side is paired as a whole."""
    spread = regions.select(*keys, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))).alias("bucket"))
    rows = points.withColumn("bucket", F.floor(F.col("line") / bucket))
    inside = rows.select(*keys, "bucket", "line").distinct().join(spread, [*keys, "bucket"]).where("line BETWEEN lo AND hi")
    first = inside.groupBy(*keys, "line").agg(F.min("lo").alias("region"))
    return points.join(first, [*keys, "line"], "left")
