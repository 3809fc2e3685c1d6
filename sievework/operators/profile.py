"""Profiles: which installed packages are scanned in full, which by their metadata only, and what comes of all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators.match import match_rules
from sievework.operators.packages import BUNDLE_KEY, PATCH_KEY, escapes, patch_rows
from sievework.plans.catalog import audit_pack

#: Packages scanned in full, and by their metadata, at most.
MAX_PLUGINS, MAX_TRANSITIVE = 12, 500
#: What a package is named by, in the order that decides; `discovered` counts for packages that look like plugins only.
SOURCES = ("direct", "bundle", "patch", "discovered")
#: Categories that the pass of regular expressions leaves to other operators, and those that metadata are judged by.
NOT_BY_REGEX, METADATA = ("manifest", "hygiene", "agent", "taint"), ("install", "supplychain")


def trusted(name: Column, scopes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in scopes:
        out = out | (name == s) | F.startswith(name, F.lit(f"{s}/"))
    return out


def is_plugin(files: DataFrame) -> DataFrame:
    """package and plugin: whether its manifest declares a bundle, or it has a patch file or a folder of plugins."""
    declared = (F.col("path") == "package.json") & F.get_json_object("content", BUNDLE_KEY).isNotNull()
    there = (F.col("path") == "cordis.patch.yml") | F.startswith("path", F.lit("plugin/"))
    return files.groupBy("package").agg(F.bool_or(F.coalesce(declared, F.lit(False)) | there).alias("plugin"))


def plan(named: DataFrame, installed: DataFrame, scopes: tuple[str, ...] = (), own: str | None = None, most: int = MAX_PLUGINS) -> DataFrame:
    """name, source and decision for all names: named (name, source, seq) by a profile, and installed (name, plugin) ones that
    nothing names. A name counts by its first source. Decisions: full, or the reason against it, the first that holds:
    trusted-scope, self, not-installed, not-a-plugin, or, beyond `most` in order of source and seq, over-limit."""
    place = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    found = installed.select("name", F.lit("discovered").alias("source"), F.lit(None).cast("long").alias("seq"))
    both = named.select("name", "source", F.col("seq").cast("long").alias("seq")).unionByName(found).where(F.coalesce("name", F.lit("")) != "")
    first = both.groupBy("name").agg(F.min(F.struct(place.alias("place"), F.col("seq"), F.col("source"))).alias("x")).select("name", "x.*")
    met = first.join(installed.select("name", F.col("plugin"), F.lit(True).alias("here")), "name", "left")
    why = F.when(trusted(F.col("name"), scopes), "trusted-scope").when(F.col("name") == F.lit(own), "self").when(F.col("here").isNull(), "not-installed")
    met = met.withColumn("why", why.when((F.col("source") == "discovered") & ~F.col("plugin"), "not-a-plugin"))
    # only names that nothing speaks against are numbered: the first `most` of them by a sort that ends there
    chosen = met.where("why IS NULL").orderBy("place", "seq", "name").limit(most).select("name", F.lit(True).alias("full"))
    out = met.join(F.broadcast(chosen), "name", "left")
    return out.select("name", "source", F.coalesce("why", F.when(F.col("full"), "full").otherwise("over-limit")).alias("decision"))


def roles(graph: DataFrame, planned: DataFrame, most: int = MAX_TRANSITIVE) -> DataFrame:
    """name, parent of the packages of a dependency graph (name, parent) that are not planned, the first `most` by name: they are
    judged by their metadata only."""
    return graph.join(planned.select("name"), "name", "left_anti").groupBy("name").agg(F.min("parent").alias("parent")).orderBy("name").limit(most)


def runtime_entries(files: DataFrame) -> DataFrame:
    """package, path: the files that package.json names to be run (main, exports, bin, and what its patch names), if inside the
    package. Names of modules of the host are left out."""
    m = files.where("path = 'package.json'").select("package", "content", F.get_json_object("content", "$.name").alias("name"), F.get_json_object("content", PATCH_KEY).alias("patch"))
    get = lambda p: F.get_json_object("content", p)
    values = lambda p: F.map_values(F.from_json(get(p), "map<string,string>"))
    target = lambda v: F.when(v.startswith("{"), F.get_json_object(v, "$.default")).otherwise(v)
    exports = F.when(get("$.exports").startswith("{"), F.filter(F.transform(values("$.exports"), target), lambda v: v.startswith(".")))
    bins = F.when(get("$.bin").startswith("{"), values("$.bin")).otherwise(F.array(get("$.bin")))
    none = F.array().cast("array<string>")
    named = m.select("package", F.explode(F.concat(F.array(get("$.main")), F.coalesce(exports, none), F.coalesce(bins, none))).alias("rel"))
    patched = m.where(F.col("patch").isNotNull() & ~escapes(F.col("patch"))).select("package", "name", F.regexp_replace("patch", r"^\./", "").alias("path"))
    rows = patch_rows(files.join(patched.select("package", "path"), ["package", "path"], "left_semi")).join(patched.select("package", F.col("name").alias("own")), "package")
    rows = rows.where("name IS NOT NULL AND NOT startswith(name, 'cordis:') AND NOT startswith(name, '@deepseek-ai/')")
    rel = F.when(F.startswith("name", F.concat("own", F.lit("/"))), F.expr("substring(name, length(own) + 2)")).otherwise(F.col("name"))
    out = named.unionByName(rows.select("package", rel.alias("rel"))).where(F.coalesce("rel", F.lit("")) != "")
    out = out.where(~escapes(F.col("rel"))).select("package", F.regexp_replace("rel", r"^(?:\./)+", "").alias("path")).distinct()
    return out.join(files.select("package", "path"), ["package", "path"], "left_semi")


def metadata_findings(files: DataFrame) -> DataFrame:
    """Findings of the rules about installing and supply in package.json alone."""
    return match_rules(files.where("path = 'package.json'"), tuple(r for r in audit_pack() if r.category in METADATA))


def regex_findings(files: DataFrame) -> DataFrame:
    """Findings of all rules with patterns but those whose category other operators see to."""
    return match_rules(files, tuple(r for r in audit_pack() if r.category not in NOT_BY_REGEX))


def roll_up(results: DataFrame, languages: DataFrame) -> DataFrame:
    """One row for all packages of each profile: results (profile, package, findings, files, complete) summed, complete if all are,
    and the files by language (profile, package, language, files) as a map."""
    total = results.groupBy("profile").agg(F.count(F.lit(1)).alias("packages"), F.sum("findings").alias("findings"), F.sum("files").alias("files"), F.bool_and("complete").alias("complete"))
    by = languages.groupBy("profile", "language").agg(F.sum("files").alias("n"))
    maps = by.groupBy("profile").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    return total.join(maps, "profile", "left")


def summary(findings: DataFrame, verdicts: DataFrame, most: int = 6) -> DataFrame:
    """package, score, verdict, total, counts by context and the first `most` serious findings of the source (id@file:line), the
    highest score first."""
    serious = findings.where((F.col("context") == "source") & F.col("severity").isin("critical", "high"))
    order = Window.partitionBy("package").orderBy("path", "line", "rule_id")
    label = F.concat("rule_id", F.lit("@"), "path", F.lit(":"), F.col("line").cast("string"))
    top = serious.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).groupBy("package").agg(F.array_sort(F.collect_list(F.struct("k", label.alias("x")))).alias("top"))
    counts = findings.groupBy("package").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("context") == c).alias(c) for c in ("source", "test", "development")))
    out = verdicts.select("package", "score", "verdict").join(counts, "package", "left").join(top, "package", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "source", "test", "development")]
    return out.select("package", "score", "verdict", *zero, F.coalesce(F.array_join(F.col("top.x"), ";"), F.lit("")).alias("top")).orderBy(F.desc_nulls_last("score"), "package")


def best_candidate(found: DataFrame, ecosystem: tuple[str, ...]) -> DataFrame:
    """Of search results (query, seq, name, description) the most relevant one of each query, none where nothing speaks for any:
    3 for the query in the name (dashes apart too), 2 for the ecosystem in the description, 1 in the name; ties by seq."""
    low, bare = F.lower("name"), lambda x: F.regexp_replace(F.lower(x), "[-_]", "")
    has = lambda x: F.coalesce(x.rlike("(?i)" + "|".join(ecosystem)), F.lit(False))
    score = F.when(F.contains(low, F.lower("query")) | F.contains(bare("name"), bare("query")), 3).otherwise(0) + F.when(has(F.col("description")), 2).otherwise(0) + F.when(has(F.col("name")), 1).otherwise(0)
    best = found.withColumn("score", score).groupBy("query").agg(F.max_by(F.struct("name", "score"), F.struct("score", -F.col("seq"))).alias("x"))
    return best.where("x.score > 0").select("query", "x.name", "x.score")
