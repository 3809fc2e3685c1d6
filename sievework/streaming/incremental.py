"""Incremental scan: files that arrive in a folder are matched as they come, each finding is kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators.match import match_rules
from sievework.plans.catalog import Rule

FILES = "package string, path string, content string, at timestamp"


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files of rows (package, path, content, at)."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def scan(stream: DataFrame, rules: tuple[Rule, ...], out: str, checkpoint: str):
    """Findings of each batch, appended to `out` unless their fingerprint is there already. A batch that is run again after a
    failure writes the folder of its number again, so nothing is doubled."""

    def each(batch: DataFrame, number: int) -> None:
        found = match_rules(batch, rules)
        found = found.withColumn("fingerprint", T.fingerprint(F.col("rule_id"), F.col("path"), F.lit(None), F.lit(None), F.col("matched"))).dropDuplicates(["fingerprint"])
        spark = batch.sparkSession
        try:
            before = spark.read.option("basePath", out).parquet(out).where(F.col("batch") != number).select("fingerprint")
            found = found.join(before, "fingerprint", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, rules: tuple[Rule, ...], width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Files with a hit per window of arrival and rule; rows later than the watermark are left out. Append mode closes a window
    when the watermark has passed it."""
    hits = F.array_compact(F.array(*(F.when(F.col("content").rlike(p[0]), F.lit(r.id)) for r in rules for p in (r.lines + r.contents))))
    rows = stream.withWatermark("at", late).select("at", "path", F.explode(F.array_distinct(hits)).alias("rule_id"))
    return rows.groupBy(F.window("at", width), "rule_id").agg(F.count(F.lit(1)).alias("files"))
