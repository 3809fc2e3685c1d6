"""Supply-chain comparisons: drift, scripts, provenance, integrity, dependencies and bills of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift(source: DataFrame, package: DataFrame) -> DataFrame:
    """path and state of files (path, size, hash) that differ: extra (only in the package), missing (only in the source) or
    modified. One full join."""
    a, b = source.select("path", F.col("size").alias("s1"), F.col("hash").alias("h1")), package.select("path", F.col("size").alias("s2"), F.col("hash").alias("h2"))
    state = F.when(F.col("s1").isNull(), "extra").when(F.col("s2").isNull(), "missing").when((F.col("s1") != F.col("s2")) | (F.col("h1") != F.col("h2")), "modified")
    return a.join(b, "path", "full").select("path", state.alias("state")).where("state IS NOT NULL")


def value_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, before, after where the values of (key, value) differ, null-safe."""
    a, b = before.select("key", F.col("value").alias("before")), after.select("key", F.col("value").alias("after"))
    return a.join(b, "key", "full").where(~F.col("before").eqNullSafe(F.col("after")))


def reasons(*checks: tuple[Column, str]) -> Column:
    """The names of the checks that hold, in their order, comma-joined."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks))), ",")


def integrity(declared: Column, content: Column) -> Column:
    """ok, mismatch, no-integrity-field or unsupported-integrity-format for a declared sha512-<base64> and bytes."""
    made = F.concat(F.lit("sha512-"), F.regexp_replace(F.base64(F.unhex(F.sha2(content, 512))), r"\s", ""))
    return F.when(declared.isNull() | (declared == ""), "no-integrity-field").when(~declared.startswith("sha512-"), "unsupported-integrity-format").when(declared == made, "ok").otherwise("mismatch")


def lock_packages(locks: DataFrame) -> DataFrame:
    """package, path, name, version, dev, optional, integrity, install_script of every entry of npm lockfiles (package, content)
    of version 2 or 3; the root entry has path ''."""
    schema = "struct<lockfileVersion:int,packages:map<string,struct<version:string,resolved:string,integrity:string,dev:boolean,optional:boolean,hasInstallScript:boolean,dependencies:map<string,string>,devDependencies:map<string,string>,optionalDependencies:map<string,string>,peerDependencies:map<string,string>>>>"
    read = locks.select("package", F.from_json("content", schema).alias("j")).where(F.col("j.lockfileVersion").isin(2, 3))
    rows = read.select("package", F.explode("j.packages").alias("path", "e"))
    kinds = ("dependencies", "optionalDependencies", "peerDependencies", "devDependencies")
    names = lambda k: F.coalesce(F.when((F.col("path") == "") | F.lit(k != "devDependencies"), F.map_keys(f"e.{k}")), F.array().cast("array<string>"))
    name = F.regexp_extract("path", r"(?:^|.*/)node_modules/((?:@[^/]+/)?[^/]+)$", 1)
    return rows.select("package", "path", name.alias("name"), "e.version", "e.integrity", "e.resolved", F.coalesce("e.dev", F.lit(False)).alias("dev"), F.coalesce("e.optional", F.lit(False)).alias("optional"), F.coalesce("e.hasInstallScript", F.lit(False)).alias("install_script"), F.col("e.dependencies").alias("dependencies"), F.array_distinct(F.concat(*(names(k) for k in kinds))).alias("wanted"))


def lock_edges(packages: DataFrame) -> DataFrame:
    """package, parent, child (lock paths), name: what a package depends on (the root also for development) is a copy nested in a
    top one, or beside a nested one, else the top one; null where none is there."""
    from sievework.operators.graphs import first_existing

    wanted = packages.select("package", F.col("path").alias("parent"), F.explode("wanted").alias("name"))
    beside = F.regexp_extract("parent", r"^(.*/node_modules/)", 1)
    nested = F.when(F.col("parent") == "", F.lit(None)).when(beside != "", F.concat(beside, "name")).otherwise(F.concat("parent", F.lit("/node_modules/"), "name"))
    key = lambda p: F.concat("package", F.lit("|"), p)
    wanted = wanted.withColumn("c", F.array_compact(F.array(key(nested), key(F.concat(F.lit("node_modules/"), "name")))))
    there = packages.select(F.concat("package", F.lit("|"), "path").alias("path"))
    found = first_existing(wanted, "c", there)
    return found.select("package", "parent", "name", F.substring_index("found", "|", -1).alias("child"))


# Names of lockfiles, the first that is there counts.
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb")


def detect_lockfile(files: DataFrame) -> DataFrame:
    """package and the name of its lockfile, from its files (package, path); packages without one do not appear."""
    place = F.array_position(F.array(*map(F.lit, LOCKFILES)), F.col("path"))
    return files.where(F.col("path").isin(*LOCKFILES)).groupBy("package").agg(F.min_by("path", place).alias("lockfile"))


def dependency_counts(files: DataFrame) -> DataFrame:
    """package, lockfile, direct and transitive dependencies: exact for npm's files, the number of entries for the other texts, 0
    where nothing can be read."""
    first = detect_lockfile(files)
    rows = first.join(files.select("package", F.col("path").alias("lockfile"), "content"), ["package", "lockfile"])
    packages = F.from_json(F.get_json_object("content", "$.packages"), "map<string,string>")
    sizes = [F.coalesce(F.size(F.from_json(F.get_json_object(F.element_at(packages, ""), f"$.{k}"), "map<string,string>")), F.lit(0)) for k in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")]
    direct = sum((F.greatest(s, F.lit(0)) for s in sizes[1:]), F.greatest(sizes[0], F.lit(0)))
    total = F.coalesce(F.size(F.filter(F.map_keys(packages), lambda k: k != "")), F.lit(0))
    entries = lambda p: F.coalesce(F.regexp_count("content", F.lit(p)), F.lit(0))
    npm = F.col("lockfile").isin("package-lock.json", "npm-shrinkwrap.json")
    other = F.when(F.col("lockfile") == "yarn.lock", entries(r"(?m)^[^\s#][^:]*:$")).when(F.col("lockfile") == "pnpm-lock.yaml", entries(r"(?m)^\s{2}[^\s/][^:]*:")).when(F.col("lockfile") == "bun.lock", entries(r'(?m)^[^\s#"][^:]*\{')).otherwise(0)
    return rows.select("package", "lockfile", F.when(npm, direct).otherwise(0).cast("int").alias("direct"), F.when(npm, F.greatest(F.lit(0), total - direct)).otherwise(other).cast("int").alias("transitive"))


def drift_findings(drifted: DataFrame, scripts: DataFrame, most: int = 10) -> DataFrame:
    """Findings of SEN-SUPPLY-003 from drift (package, path, state, binary) and scripts (package, key, before, after): one for all
    extra files, one for all modified ones, one for extra binaries, and one for each changed script. detail names the first
    `most` files (all binaries), in order of path."""
    order = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("path"))))
    kinds = {"extra": F.col("state") == "extra", "modified": F.col("state") == "modified", "binary": (F.col("state") == "extra") & F.col("binary")}
    by = drifted.groupBy("package").agg(*(order(c).alias(k) for k, c in kinds.items()))
    one = F.array(*(F.struct(F.lit(k).alias("kind"), F.size(k).alias("n"), F.array_join(F.slice(k, 1, most) if k != "binary" else F.col(k), ", ").alias("detail")) for k in kinds))
    files = by.select("package", F.explode(one).alias("x")).select("package", "x.*").where("n > 0")
    changed = scripts.where(F.col("after").isNotNull() & ~F.col("before").eqNullSafe(F.col("after")))
    told = F.concat(F.lit("source="), F.coalesce("before", F.lit("-")), F.lit(" package="), "after")
    both = files.unionByName(changed.select("package", F.concat(F.lit("script:"), "key").alias("kind"), F.lit(1).alias("n"), told.alias("detail")))
    return both.select("package", F.lit("SEN-SUPPLY-003").alias("rule_id"), F.lit("high").alias("severity"), F.lit("supplychain").alias("category"), "kind", "n", "detail")


def advisories(packages: DataFrame, known: DataFrame) -> DataFrame:
    """Findings of SEN-OSV-001: packages (package, name, version) met with a table of advisories (name, version, id, summary)."""
    met = packages.select("package", "name", "version").distinct().join(known, ["name", "version"])
    return met.select("package", F.lit("package.json").alias("path"), F.lit("SEN-OSV-001").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("supplychain").alias("category"), F.lit(1).alias("line"), F.concat_ws(" ", "id", "summary").alias("detail"))


def provenance(declared: DataFrame, expected: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key and reasons: the fields that differ, in order, comma-joined; a field that is not expected (null) is not compared, a
    declared null differs from any expected value."""
    met = declared.alias("d").join(expected.alias("e"), key)
    return met.select(key, reasons(*((F.col(f"e.{f}").isNotNull() & ~F.col(f"d.{f}").eqNullSafe(F.col(f"e.{f}")), f) for f in fields)).alias("reasons"))


# How the body of a failed transfer begins.
TRANSPORT_ERROR = (
    r"(?i)^Couldn't find the requested file(?![A-Za-z0-9_])",
    r"(?i)^Package size exceeded the configured limit(?![A-Za-z0-9_])",
    r"(?i)^Failed to fetch(?![A-Za-z0-9_])",
    r"(?i)^Invalid URL(?![A-Za-z0-9_])",
    r"(?i)^<!doctype html(?![A-Za-z0-9_])",
    r"(?i)^<html(?:\s|>)",
)
SOURCE_FILE = r"(?i)\.(?:[cm]?js|jsx|ts|tsx|mts|cts)\z"


def payload_states(files: DataFrame) -> DataFrame:
    """package and state of fetched trees: ok, or the first reason against one: no-manifest, transport-error (a file that is an
    error page), bad-manifest (not an object), no-source."""
    start, error = F.regexp_replace("content", r"^\s+", ""), F.lit(False)
    for p in TRANSPORT_ERROR:
        error = error | F.coalesce(start.rlike(p), F.lit(False))
    manifest = F.col("path") == "package.json"
    object_ = F.coalesce(F.try_parse_json("content").isNotNull() & start.startswith("{"), F.lit(False))
    by = files.groupBy("package").agg(F.bool_or(manifest).alias("m"), F.bool_or(error).alias("e"), F.bool_or(manifest & object_).alias("o"), F.bool_or(F.col("path").rlike(SOURCE_FILE)).alias("s"))
    return by.select("package", F.when(~F.col("m"), "no-manifest").when(F.col("e"), "transport-error").when(~F.col("o"), "bad-manifest").when(~F.col("s"), "no-source").otherwise("ok").alias("state"))
