"""Reports: one document a package, and the formats it is exchanged in. Secrets are redacted before anything leaves."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators.findings import report_order, sarif_level
from sievework.plans.catalog import SEVERITIES

MAX_FINDINGS = 300
EXIT = {"safe": 0, "review": 0, "risky": 1, "dangerous": 1}


def report(findings: DataFrame, verdicts: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """package, report (JSON): verdict and score, counts by severity, and the findings in order, at most `most`, redacted, with
    fingerprints. Counts are of all findings. Packages without findings have one too."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("package").orderBy(*report_order(collate=False))
    ranked = findings.withColumn("k", F.row_number().over(order))
    shown = ranked.where(F.col("k") <= most).withColumn("matched", T.redact(F.col("matched"))).withColumn("fingerprint", T.fingerprint(F.col("rule_id"), F.col("path"), F.lit(None), F.lit(None), F.col("matched")))
    one = F.struct("k", F.col("rule_id").alias("id"), "severity", "category", F.col("path").alias("file"), "line", T.snippet(F.col("matched")).alias("snippet"), "fingerprint")
    listed = shown.groupBy("package").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("k")).alias("findings"))
    counts = findings.groupBy("package").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.count(F.lit(1)).alias("total"))
    whole = verdicts.select("package", "score", "verdict").join(counts, "package", "left").join(listed, "package", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    summary = F.struct("score", "verdict", *(number(s) for s in SEVERITIES), number("total"), (F.coalesce("total", F.lit(0)) > most).alias("truncated"))
    return whole.select("package", F.to_json(F.struct(F.lit(2).alias("schemaVersion"), "package", summary.alias("summary"), F.coalesce("findings", F.array()).alias("findings")), {"ignoreNullFields": "false"}).alias("report"))


def sarif(findings: DataFrame, tool: str = "findings-on-spark") -> DataFrame:
    """package, sarif (2.1.0): the rules met, and all findings as results."""
    level = sarif_level(F.col("severity"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(level.alias("level")).alias("defaultConfiguration"), F.struct("category", "severity").alias("properties"))
    place = F.struct(F.struct(F.struct(F.replace("path", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(T.redact(F.col("matched")).alias("text")).alias("message"), F.array(place).alias("locations"))
    both = findings.groupBy("package").agg(F.array_sort(F.collect_set(rule)).alias("rules"), F.array_sort(F.collect_list(result)).alias("results"))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver"))
    run = F.struct(driver.alias("tool"), "results")
    return both.select("package", F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def to_html(report_json: str) -> str:
    """One report as a page by itself, everything escaped."""
    r = json.loads(report_json)
    e = lambda x: html.escape(str(x), quote=True)
    rows = "".join(f"<tr><td>{e(f['severity'])}<td>{e(f['id'])}<td>{e(f['file'])}:{e(f['line'])}<td><code>{e(f['snippet'])}</code></tr>" for f in r["findings"])
    return f"<!doctype html><meta charset=utf-8><title>{e(r['package'])}</title><h1>{e(r['package'])}</h1><p>{e(r['summary']['verdict'])}, {e(r['summary']['score'])} of 100</p><table><tr><th>severity<th>rule<th>place<th>match</tr>{rows}</table>"


def to_text(report_json: str, most: int = 12) -> str:
    """Verdict, counts and the first serious findings."""
    r = json.loads(report_json)
    s = r["summary"]
    serious = [f for f in r["findings"] if f["severity"] in ("critical", "high")][:most]
    head = f"{r['package']}: {s['verdict']} ({s['score']}/100), " + ", ".join(f"{s[k]} {k}" for k in SEVERITIES)
    return "\n".join([head, *(f"  [{f['severity']}] {f['id']} {f['file']}:{f['line']} {f['snippet']}" for f in serious)])


def exit_code(summary: dict, fail_on: str | None = None, fail_on_incomplete: bool = False, complete: bool = True) -> int:
    """1 where a severity at or above fail_on occurs, or without one where the verdict is risky or worse; else 3 for an incomplete
    scan if that counts, else 0."""
    if fail_on:
        failed = any(summary.get(s, 0) for s in SEVERITIES[: SEVERITIES.index(fail_on) + 1])
    else:
        failed = bool(EXIT[summary["verdict"]])
    return 1 if failed else 3 if fail_on_incomplete and not complete else 0


def cyclonedx(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """package, bom (CycloneDX 1.6) from lock packages and edges, sorted, with a serial number from its own content."""
    named = packages.where("path <> ''").withColumn("purl", T.purl(F.col("name"), F.coalesce("version", F.lit(""))))
    prop = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value"))
    component = F.struct(F.lit("library").alias("type"), F.col("purl").alias("bom-ref"), "name", "version", "purl", F.array(prop("dev", "dev"), prop("optional", "optional"), prop("hasInstallScript", "install_script")).alias("properties"))
    ref = named.select("package", "path", "purl")
    up = ref.select("package", F.col("path").alias("parent"), F.col("purl").alias("ref"))
    down = ref.select("package", F.col("path").alias("child"), F.col("purl").alias("on"))
    deps = edges.join(up, ["package", "parent"]).join(down, ["package", "child"]).groupBy("package", "ref").agg(F.array_sort(F.collect_set("on")).alias("dependsOn"))
    deps = deps.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("ref", "dependsOn"))).alias("dependencies"))
    whole = named.groupBy("package").agg(F.sort_array(F.collect_list(component)).alias("components")).join(deps, "package", "left").withColumn("dependencies", F.coalesce("dependencies", F.array()))
    d = F.sha2(F.to_json(F.struct("components", "dependencies")), 256)
    cut = lambda a, n: F.substring(d, a, n)
    serial = F.concat(F.lit("urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(13, 3)), F.concat(F.lit("8"), cut(16, 3)), cut(19, 12)))
    return whole.select("package", F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), serial.alias("serialNumber"), F.lit(1).alias("version"), "components", "dependencies")).alias("bom"))


def spdx(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """package, document (SPDX 2.3): packages, what the document describes, and what depends on what."""
    ident = lambda p: F.concat(F.lit("SPDXRef-"), F.substring(F.sha2(p, 256), 1, 16))
    item = F.struct(ident(F.col("path")).alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.coalesce("resolved", F.lit("NOASSERTION")).alias("downloadLocation"))
    listed = packages.where("path <> ''").groupBy("package").agg(F.sort_array(F.collect_list(item)).alias("packages"))
    link = F.struct(F.when(F.col("parent") == "", F.lit("SPDXRef-DOCUMENT")).otherwise(ident(F.col("parent"))).alias("spdxElementId"), F.when(F.col("parent") == "", "DESCRIBES").otherwise("DEPENDS_ON").alias("relationshipType"), ident(F.col("child")).alias("relatedSpdxElement"))
    links = edges.where("child IS NOT NULL").groupBy("package").agg(F.sort_array(F.collect_list(link)).alias("relationships"))
    whole = listed.join(links, "package", "left")
    return whole.select("package", F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.col("package").alias("name"), "packages", F.coalesce("relationships", F.array()).alias("relationships"))).alias("document"))


def relative(path: Column, base: Column) -> Column:
    """Paths for reports that are passed on: what lies below base is relative to it, the rest stays."""
    root = F.concat(F.regexp_replace(base, r"/+\z", ""), F.lit("/"))
    return F.when(F.startswith(path, root), path.substr(F.length(root) + 1, F.length(path))).otherwise(path)


def workspace(path: Column) -> Column:
    """A target's own path as <workspace>/its last part."""
    parts = F.filter(F.split(path, r"[\\/]"), lambda p: p != "")
    return F.concat(F.lit("<workspace>/"), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("target")))


def rules_document(rules: tuple) -> str:
    """The rule catalog as Markdown, by category."""
    out = ["# Rules"]
    for category in dict.fromkeys(r.category for r in rules):
        out += ["", f"## {category}", "", "| id | name | severity |", "|---|---|---|"]
        out += [f"| {r.id} | {r.name} | {r.severity} |" for r in rules if r.category == category]
    return "\n".join(out) + "\n"
