"""Package metadata: manifests, patches, entries, modules, and the findings they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators.graphs import first_existing
from sievework.plans.catalog import audit_pack

#: The declaration of a bundle in package.json, a fixed value of the format.
PATCH_KEY = "$.dsh.bundle.patch"
BUNDLE_KEY = "$.dsh.bundle"
FINDING = ["package", "path", "rule_id", "severity", "category", "line", "detail"]


def escapes(path: Column) -> Column:
    """Whether a relative path leaves its root: absolute, with a drive, or with more steps up than down at any place."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc: Column, p: Column) -> Column:
        d = acc["d"] + F.when(p == "..", -1).otherwise(1)
        return F.struct(d.alias("d"), F.least(acc["m"], d).alias("m"))

    return path.rlike(r"^([\\/]|[A-Za-z]:)") | (F.aggregate(parts, start, step, lambda acc: acc["m"]) < 0)


def patch_rows(files: DataFrame) -> DataFrame:
    """package, path, row, id, name, disabled of patch texts: "- id:" opens a row, "- name:" does where none is open by an id
    alone; "name:" and "disabled:" fill the open one."""
    lines = files.select("package", "path", F.posexplode(F.split("content", "\n", -1)).alias("line", "text"))
    value = lambda k: F.nullif(F.trim(F.regexp_extract("text", rf"^\s*(?:-\s*)?{k}:\s*['\"]?([^'\"#]*)['\"]?", 1)), F.lit(""))
    order = Window.partitionBy("package", "path").orderBy("line")
    opens = F.col("text").rlike(r"^\s*-\s*(id|name):")
    rows = lines.withColumn("row", F.sum(opens.cast("int")).over(order)).where("row > 0")
    return rows.groupBy("package", "path", "row").agg(F.max(value("id")).alias("id"), F.max(value("name")).alias("name"), F.bool_or(F.coalesce(value("disabled") == "true", F.lit(False))).alias("disabled"))


def export_contract(content: Column) -> Column:
    """Whether a module exports a name and an apply function, or a class, in one of the usual forms."""
    named = lambda n: content.rlike(rf"export\s+(?:(?:const|let|class|default)\s+{n}(?![\w$])|(?:async\s+)?function\s+{n}(?![\w$]))")
    listed = F.transform(F.split(F.array_join(F.regexp_extract_all(content, F.lit(r"export\s*\{([^}]*)\}"), F.lit(1)), ","), ","), lambda x: F.trim(F.regexp_replace(x, r"^.*\sas\s+", "")))
    both = lambda x: x.rlike(r"(?<![\w$])name\s*:") & x.rlike(r"(?<![\w$])apply\s*[:(]")
    default = F.regexp_extract(content, r"(?s)export\s+default\s*(\{.*)", 1)
    common = F.regexp_extract(content, r"(?s)(?:module\.exports|exports\.default)\s*=\s*\{(.*?)\n?\}", 1)
    ident = F.regexp_extract(content, r"export\s+default\s+([A-Za-z_$][\w$]*)\s*;?", 1)
    klass = content.rlike(r"export\s+default\s+class(?:\s+[A-Za-z_$][\w$]*)?\s*(?:extends\s+[\w$.]+\s*)?\{") | ((ident != "") & F.contains(content, F.concat(F.lit("class "), ident)))
    return (named("name") & named("apply")) | (F.array_contains(listed, "name") & F.array_contains(listed, "apply")) | both(default) | klass | both(common)


def _finding(df: DataFrame, rule: str, path: Column, detail: Column) -> DataFrame:
    r = next(r for r in audit_pack() if r.id == rule)
    return df.select("package", path.alias("path"), F.lit(rule).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(1).alias("line"), detail.cast("string").alias("detail"))


def manifest_findings(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Findings about the manifest of each package, from its files (package, path, content): none or unreadable, no bundle,
    patch missing, empty or outside the root, entries that cannot be found or do not export what they should, no license,
    no description."""
    m = packages.select("package").distinct().join(files.where("path = 'package.json'").select("package", "content"), "package", "left")
    get = lambda p: F.get_json_object("content", p)
    ok = F.try_parse_json("content").isNotNull()
    m = m.select("package", F.coalesce(ok, F.lit(False)).alias("ok"), get("$.name").alias("name"), get(BUNDLE_KEY).isNotNull().alias("bundle"), get(PATCH_KEY).alias("patch"), get("$.license").alias("license"), get("$.description").alias("description"))
    here = F.lit("package.json")
    good = m.where("ok")
    out = _finding(m.where("NOT ok"), "SEN-MAN-001", here, F.lit("missing or unreadable"))
    out = out.unionByName(_finding(good.where("NOT bundle"), "SEN-MAN-002", here, F.lit("no bundle declaration")))
    out = out.unionByName(_finding(good.where("coalesce(license, '') = ''"), "SEN-MAN-007", here, F.lit("")))
    out = out.unionByName(_finding(good.where("coalesce(description, '') = ''"), "SEN-MAN-008", here, F.lit("")))
    patched = good.where("coalesce(patch, '') <> ''").withColumn("away", escapes(F.col("patch"))).withColumn("at", F.regexp_replace("patch", r"^\./", ""))
    out = out.unionByName(_finding(patched.where("away"), "SEN-MAN-009", here, F.col("patch")))
    inside = patched.where("NOT away").join(files.select("package", F.col("path").alias("at"), F.col("content").alias("text")), ["package", "at"], "left")
    out = out.unionByName(_finding(inside.where("text IS NULL"), "SEN-MAN-003", here, F.col("patch")))
    texts = inside.where("text IS NOT NULL").select("package", "name", F.col("at").alias("path"), F.col("text").alias("content"))
    rows = patch_rows(texts)
    none = texts.join(rows.select("package").distinct(), "package", "left_anti")
    out = out.unionByName(_finding(none, "SEN-MAN-004", F.col("path"), F.lit("no rows")))
    out = out.unionByName(_finding(rows.where("id IS NULL AND name IS NULL"), "SEN-MAN-004", F.col("path"), F.lit("a row without id and name")))
    own = rows.where("name IS NOT NULL AND NOT startswith(name, 'cordis:') AND NOT startswith(name, '@deepseek-ai/')").join(texts.select("package", F.col("name").alias("own")), "package")
    rel = F.when(F.col("name") == F.col("own"), F.lit(".")).when(F.startswith("name", F.concat("own", F.lit("/"))), F.expr("substring(name, length(own) + 2)")).otherwise(F.regexp_replace("name", r"^\./", ""))
    own = own.withColumn("rel", rel)
    out = out.unionByName(_finding(own.where(escapes(F.col("rel"))), "SEN-MAN-009", F.col("path"), F.col("name")))
    tails = ("", ".js", ".mjs", ".cjs", ".ts", "/index.js", "/index.mjs", "/index.ts")
    base = F.when(F.col("rel") == ".", F.lit("index")).otherwise(F.col("rel"))
    seek = own.where(~escapes(F.col("rel"))).withColumn("c", F.array(*(F.concat("package", F.lit("|"), base, F.lit(t)) for t in tails)))
    there = files.select(F.concat("package", F.lit("|"), "path").alias("path"))
    met = first_existing(seek.select("package", "path", "name", "c"), "c", there)
    out = out.unionByName(_finding(met.where("found IS NULL"), "SEN-MAN-005", F.col("path"), F.col("name")))
    entry = met.where("found IS NOT NULL").select("package", "name", F.substring_index("found", "|", -1).alias("path")).join(files.select("package", "path", "content"), ["package", "path"])
    return out.unionByName(_finding(entry.where(~export_contract(F.col("content"))), "SEN-MAN-006", F.col("path"), F.col("name")))


IMPORT = r"(?:import\s+(?:[^'\";]*?\sfrom\s+)?|export\s+[^'\";]*?\sfrom\s+|require\s*\(\s*|import\s*\(\s*)['\"]([^'\"]+)['\"]"


def module_edges(files: DataFrame) -> DataFrame:
    """package, source, specifier, target, kind of every import in code files: resolved, unresolved (a relative one that no
    candidate file answers) or external. Comments are taken out first."""
    bare = F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"(?<![:'\"`])//[^\n]*", "")
    found = files.where(F.col("content").isNotNull()).select("package", F.col("path").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(IMPORT), F.lit(1)))).alias("specifier"))
    folder = F.regexp_extract("source", r"^(.*/)?[^/]*$", 1)
    parts = F.split(F.concat(folder, F.col("specifier")), "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    local = found.where(F.col("specifier").startswith(".")).withColumn("base", F.array_join(walked, "/"))
    ends = ("", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".json", "/index.js", "/index.ts")
    typed = F.concat(F.regexp_replace("base", r"\.[cm]?js$", ""), F.lit(".ts"))
    local = local.withColumn("c", F.transform(F.array(*(F.concat("base", F.lit(e)) for e in ends), typed), lambda x: F.concat("package", F.lit("|"), x)))
    met = first_existing(local.select("package", "source", "specifier", "c"), "c", files.select(F.concat("package", F.lit("|"), "path").alias("path")))
    inner = met.select("package", "source", "specifier", F.substring_index("found", "|", -1).alias("target"), F.when(F.col("found").isNull(), "unresolved").otherwise("resolved").alias("kind"))
    outer = found.where(~F.col("specifier").startswith(".")).select("package", "source", "specifier", F.lit(None).cast("string").alias("target"), F.lit("external").alias("kind"))
    return inner.unionByName(outer)


def reachable(files: DataFrame) -> DataFrame:
    """package, path, level: the files that a package's runtime entries reach over its imports, breadth first."""
    from sievework.operators.graphs import held, let_go, levels
    from sievework.operators.profile import runtime_entries

    key = lambda c: F.concat("package", F.lit("|"), c)
    files = held(files)
    edges = module_edges(files).where("target IS NOT NULL").select(key("source").alias("u"), key("target").alias("v"))
    out = levels(edges, runtime_entries(files).select(key("path").alias("node")))
    let_go(files)
    return out.select(F.substring_index("node", "|", 1).alias("package"), F.substring_index("node", "|", -1).alias("path"), "level")
