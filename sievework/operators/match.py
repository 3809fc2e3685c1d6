"""Rule matching: rules x files, as one projection of literal patterns, a generator for those that hit, and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import text as T
from sievework.plans.catalog import COMMENT_LINE, LITE_RULES, MATCH_GUARD, MAX_FULL_BYTES, MAX_LITE_BYTES, SAVED_HITS, Rule


def size_class(size: Column, full: int = MAX_FULL_BYTES, lite: int = MAX_LITE_BYTES) -> Column:
    return F.when(size <= full, "full").when(size <= lite, "lite").otherwise("hard")


def _candidates(rules: tuple[Rule, ...], lite: bool) -> Column:
    """An array of the patterns that hit a file at all. Cheap tests of the path come before the content's; every regex is a
    literal, so each is compiled once."""
    out = []
    for i, r in enumerate(rules):
        gate = F.lit(True) if r.files is None else F.col("path").rlike(r.files)
        if lite and r.id not in LITE_RULES:
            gate = gate & (F.col("klass") != "lite")
        patterns = [(0, *p) for p in r.lines] + [(1, *p) for p in r.contents]
        for k, (kind, regex, note, module) in enumerate(patterns):
            hit = gate & F.col("content").rlike(regex)
            if module:
                hit = gate & F.col("content").rlike(T.import_gate(module)) & F.col("content").rlike(regex)
            one = F.struct(
                F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(i).alias("rule_no"), F.lit(kind).alias("kind"),
                F.lit(k).alias("pattern_no"), F.lit(regex).alias("regex"), F.lit(note or "").alias("note"), F.lit(r.ignore_comments).alias("ignore_comments"),
            )
            out.append(F.when(hit, one))
    return F.array_compact(F.array(*out))


def _found() -> Column:
    """(line, matched) of the first MATCH_GUARD matches (one for content patterns): what lies between matches and the matches
    themselves are read off in one pass."""
    most = F.when(F.col("kind") == 1, 1).otherwise(MATCH_GUARD)
    matches = F.slice(F.regexp_extract_all("content", F.col("regex"), F.lit(0)), 1, most)
    between = F.slice(F.split("content", F.col("regex"), -1), 1, F.size(matches))
    pairs = F.arrays_zip(between.alias("b"), matches.alias("m"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<line:int,matched:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        line = acc["at"] + T.newlines(x["b"])
        return F.struct((line + T.newlines(x["m"])).alias("at"), F.array_append(acc["out"], F.struct(line.alias("line"), x["m"].alias("matched"))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def match_rules(files: DataFrame, rules: tuple[Rule, ...], saved: int = SAVED_HITS, lite: bool = False) -> DataFrame:
    """files (package, path, content[, klass]) -> one row per finding: package, path, rule_id, severity, category, pattern_no,
    line, matched, note, n (its number within rule and file) and saved.

    A pattern is sought over the whole content, its line counted from newlines. Matches on a line that an exclude of the rule
    or, where the rule says so, a comment matches do not count. Of a rule's matches on one line the first pattern's counts.
    Null content matches nothing."""
    hits = files.where(F.col("content").isNotNull()).select("package", "path", "content", F.explode(_candidates(rules, lite)).alias("p")).select("package", "path", "content", "p.*")
    found = hits.select("*", F.posexplode(_found()).alias("at", "f")).select("*", F.col("f.line").alias("line"), F.col("f.matched").alias("matched"))
    if any(r.ignore_comments or r.excludes for r in rules):
        found = found.withColumn("text", F.get(F.split("content", "\n", -1), F.col("line") - 1))
        comment = F.col("ignore_comments") & F.col("text").rlike(COMMENT_LINE)
        found = found.where(~comment & ~_excluded(rules))
    place = ["package", "path", "rule_id"]
    order = ["kind", "pattern_no", "at"]
    first = found.withColumn("k", F.row_number().over(Window.partitionBy(*place, "line").orderBy(*order))).where("k = 1")
    out = first.withColumn("n", F.row_number().over(Window.partitionBy(*place).orderBy(*order)))
    return out.select("package", "path", "rule_id", "severity", "category", "pattern_no", "line", "matched", "note", "n", (F.col("n") <= saved).alias("saved"))


def _excluded(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(False)
    for r in rules:
        for x in r.excludes:
            out = out | ((F.col("rule_id") == r.id) & F.col("text").rlike(x))
    return out
