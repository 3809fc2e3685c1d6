"""From findings to verdicts: suppression, statistics, scores, order, fingerprints and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import text as T
from sievework.plans.catalog import CONTEXT_CAP, SUPPRESSED_BY, rank, verdict, weight


def suppress(findings: DataFrame, pairs: tuple = SUPPRESSED_BY) -> DataFrame:
    """suppressed: a generic finding is, where the specific one of its pair stands at the same package, path and line. One
    window gathers a place's rules; nothing is joined."""
    place = Window.partitionBy("package", "path", "line")
    there = F.collect_set("rule_id").over(place)
    by = F.lit(False)
    for specific, generic in pairs:
        by = by | ((F.col("rule_id") == generic) & F.array_contains("there", specific))
    return findings.withColumn("there", there).withColumn("suppressed", by).drop("there")


def with_context(findings: DataFrame, reachable: DataFrame | None = None) -> DataFrame:
    """context, by path; paths in reachable (package, path) are source."""
    if reachable is None:
        return findings.withColumn("context", T.context(F.col("path")))
    marked = findings.join(reachable.select("package", "path").distinct().withColumn("hit", F.lit(True)), ["package", "path"], "left")
    return marked.withColumn("context", T.context(F.col("path"), F.coalesce("hit", F.lit(False)))).drop("hit")


def scored(severity: Column, context: Column, confidence: Column | None = None) -> Column:
    """Rank after downgrades: one level outside source, one for low confidence."""
    down = F.when(context != "source", 1).otherwise(0)
    if confidence is not None:
        down = down + F.when(confidence == "low", 1).otherwise(0)
    return F.least(rank(severity) + down, F.lit(4))


def raw_scores(findings: DataFrame) -> DataFrame:
    """package, context, findings, raw: saved findings count unless suppressed; unsaved ones count whatever they are."""
    counts = ~F.col("saved") | ~F.col("suppressed")
    value = F.when(counts, weight(scored(F.col("severity"), F.col("context")))).otherwise(0)
    return findings.groupBy("package", "context").agg(F.count(F.lit(1)).alias("findings"), F.sum(value).cast("long").alias("raw"))


def package_scores(raw: DataFrame) -> DataFrame:
    """package, findings, score: source in full, tests and development up to a cap each, 100 at most."""
    part = lambda c: F.coalesce(F.sum(F.when(F.col("context") == c, F.col("raw"))), F.lit(0))
    score = F.least(F.lit(100), part("source") + F.least(F.lit(CONTEXT_CAP), part("test")) + F.least(F.lit(CONTEXT_CAP), part("development")))
    return raw.groupBy("package").agg(F.sum("findings").alias("findings"), score.cast("int").alias("score"))


def verdicts(scores: DataFrame, packages: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """verdict of every package, those without findings too; an incomplete scan is never safe: its score is 20 at least."""
    out = packages.select("package").distinct().join(scores, "package", "left").select("package", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.coalesce("score", F.lit(0)).alias("score"))
    if complete is not None:
        out = out.join(complete.select("package", "complete"), "package", "left")
        out = out.withColumn("score", F.when(~F.coalesce("complete", F.lit(False)), F.greatest("score", F.lit(20))).otherwise(F.col("score"))).drop("complete")
    return out.withColumn("verdict", verdict(F.col("score")))


def deduplicate(findings: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first of each key in `order`, which must be total."""
    return findings.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("k = 1").drop("k")


def report_order(collate: bool = True) -> list[Column]:
    """Severity, file in locale order, line."""
    path = F.col("path").collate("UNICODE") if collate else F.col("path")
    return [rank(F.col("severity")), path, F.col("line"), F.col("rule_id")]


def top(findings: DataFrame, most: int, collate: bool = True) -> DataFrame:
    return findings.orderBy(*report_order(collate)).limit(most)


def occurrences(findings: DataFrame, order: list) -> DataFrame:
    """Findings with one fingerprint are numbered in order; from the second on the number is hashed in."""
    n = F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order))
    again = F.substring(F.sha2(F.concat_ws("|", "fingerprint", F.concat(F.lit("occurrence:"), F.col("occurrence"))), 256), 1, 24)
    return findings.withColumn("occurrence", n).withColumn("fingerprint", F.when(F.col("occurrence") > 1, again).otherwise(F.col("fingerprint")))


def baseline(now: DataFrame, before: DataFrame) -> DataFrame:
    """fingerprint and state: new, resolved or existing. One full join."""
    a, b = now.select("fingerprint").distinct().withColumn("now", F.lit(1)), before.select("fingerprint").distinct().withColumn("before", F.lit(1))
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("existing")
    return a.join(b, "fingerprint", "full").select("fingerprint", state.alias("state"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def bounded(findings: DataFrame, most: int, key: str = "package", seq: str = "seq") -> DataFrame:
    """What a buffer of `most` findings holds after all of a package's have come in order of seq: a finding that comes when it is
    full takes the place of the oldest one of the lowest severity there, if its own is higher.

    Severities above one, the last that fits in part, are kept whole; of that one those count that came while findings of it or
    above were fewer than `most`, and the latest of these stay. So windows tell it without going through the rows."""
    rows = findings.withColumn("r", rank(F.col("severity")))
    counts = rows.groupBy(key, "r").agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(key).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    edge = counts.withColumn("upto", F.sum("c").over(up)).withColumn("above", F.col("upto") - F.col("c"))
    edge = edge.where(F.col("above") < most).select(key, "r", "above", (F.col("upto") <= most).alias("whole"))
    met = rows.join(edge, [key, "r"])
    whole = met.where("whole").select(*findings.columns)
    last = edge.where("NOT whole").select(key, F.col("r").alias("edge"), "above")
    near = rows.join(last, key).where("r <= edge")
    came = near.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(seq))).where((F.col("r") == F.col("edge")) & (F.col("k") <= most))
    late = came.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where(F.col("k") <= most - F.col("above"))
    return whole.unionByName(late.select(*findings.columns))
