"""What tools say and what they do: poisoned phrases, capabilities that a description does not tell of, targets inside a network."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators.flows import closing, find_flows
from sievework.plans.catalog import CODE_FILE

# Phrases, targets, words of harmless descriptions, and what shows a capability.
POISON_PHRASES = (
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior)\s+(?:instructions|prompts?|directions)",
    r"(?i)do\s+not\s+(?:tell|inform|notify|warn)\s+(?:the\s+)?user",
    r"(?i)don'?t\s+(?:tell|let)\s+(?:the\s+)?user",
    r"(?i)conceal|hide\s+this|secretly|stealth",
    r"(?i)always\s+(?:call|use|invoke)\s+",
    r"(?i)send\s+(?:files|data|logs|content|everything)\s+to",
    r"(?i)exfiltrat|upload\s+(?:to|the)\s+(?:remote|server|endpoint)",
    r"(?i)never\s+(?:mention|reveal|disclose)",
)
INSIDE_TARGETS = (
    r"(?i)localhost|127\.0\.0\.1|0\.0\.0\.0|169\.254\.169\.254",
    r"(?i)\[?::1\]?",
    r"(?i)\[?::ffff:127\.",
    r"(?i)\[?::ffff:169\.254\.169\.254\]?",
    r"(?i)\[?(?:fc|fd)[0-9a-f]{2}::\]?",
    r"(?i)\[?fe[89ab][0-9a-f]::\]?",
    r"(?i)\[?::ffff:(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)\]?",
    r"(?i)file://|gopher://|ftp://",
    r"(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)\d{1,3}\.\d{1,3}",
)
METADATA = r"169\.254\.169\.254"
CONTAINMENT = r"(?:resolve|join|normalize)\s*\(\s*(?:workspace|WORKSPACE|root|ROOT|cwd|__dirname)"
BENIGN = re.compile(r"weather|greeting|hello|translate|quote|joke|fact|time|date|unit|convert|dictionary|calculator|poll", re.I)
CAPABILITIES = (
    ("shell", re.compile(r"(?:exec|execSync|spawn|spawnSync|fork|eval)\s*\(")),
    ("filesystem-read", re.compile(r"(?:readFile|readFileSync|createReadStream|openSync)\s*\(")),
    ("filesystem-write", re.compile(r"(?:writeFile|writeFileSync|appendFile|createWriteStream)\s*\(")),
    ("network", re.compile(r"(?:fetch|axios|XMLHttpRequest|WebSocket|sendBeacon|https?\.request|net\.connect)\s*\(")),
    ("env-access", re.compile(r"process\.env")),
    ("credential-path-access", re.compile(r"(?:\.ssh|\.aws|\.npmrc|kubeconfig|id_rsa)")),
)
_SENSITIVE = re.compile(r"(?:exec|spawn|readFile|writeFile|fetch|axios|WebSocket|sendBeacon|https?\.request)\s*\(")
_TOOL = re.compile(r"(?<![A-Za-z0-9_])defineTool\s*\(\s*\{")
_DESCRIPTION = re.compile(r"description\s*:\s*[\"'`]([^\"'`]{0,400})")
_SHORT = re.compile(r"description\s*:\s*[\"'`]([^\"'`]{0,200})")

REGIONS = "package string, path string, lo int, hi int, described_lo int, described_hi int, sensitive boolean, description string, observed string"
FINDING = ("package", "path", "rule_id", "severity", "category", "line", "confidence", "detail")


def regions(code: str) -> list[tuple]:
    """Tools of a file: first and last line, those of the description, whether something sensitive is called, the description
    if it is close by, and the capabilities seen in the next 2,000 characters, comma-joined."""
    out = []
    for m in _TOOL.finditer(code):
        end = closing(code, m.end() - 1)
        near = _SHORT.search(code[m.start() : m.start() + 800])
        window = code[m.start() : m.start() + 2000]
        observed = ",".join(name for name, p in CAPABILITIES if p.search(window))
        lo, hi, dlo, dhi, sensitive = code.count("\n", 0, m.start()) + 1, -1, -1, -1, False
        if end < len(code):
            body = code[m.start() : end + 1]
            hi, sensitive = lo + body.count("\n") + 1, bool(_SENSITIVE.search(body))
            if d := _DESCRIPTION.search(body):
                dlo, dhi = lo + body.count("\n", 0, d.start()), lo + body.count("\n", 0, d.end())
        out.append((lo, hi, dlo, dhi, sensitive, near[1] if near else "", observed))
    return out


def tool_regions(files: DataFrame) -> DataFrame:
    """One row a tool of files (package, path, content); a file is one row and one call. Null content has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in REGIONS.split(", ")]
        for b in batches:
            yield pd.DataFrame([(p, f, *r) for p, f, c in zip(b["package"], b["path"], b["content"], strict=True) for r in regions(c)], columns=columns)

    return files.where(F.contains("content", F.lit("defineTool"))).select("package", "path", "content").mapInPandas(run, REGIONS)


def poisoned(files: DataFrame) -> DataFrame:
    """A finding for each line with one of the phrases: low confidence, medium within a tool's description, high if that tool
    also calls something sensitive. Of tools that hold a line the first counts. Lines meet tools by an interval join."""
    from sievework.operators.regions import contain

    phrase = F.lit(False)
    for p in POISON_PHRASES:
        phrase = phrase | F.col("text").rlike(p)
    some = files.where(F.col("content").rlike("|".join(f"(?:{p})" for p in POISON_PHRASES)))
    lines = some.select("package", "path", F.posexplode(F.split("content", "\n", -1)).alias("i", "text")).where(phrase).select("package", "path", (F.col("i") + 1).alias("line"), "text")
    tools = tool_regions(some).where("hi > 0")
    met = contain(lines, tools, ["package", "path"])
    one = tools.groupBy("package", "path", F.col("lo").alias("region")).agg(F.min_by(F.struct("described_lo", "described_hi", "sensitive"), "hi").alias("t"))
    met = met.join(one, ["package", "path", "region"], "left")
    told = F.coalesce(F.col("line").between(F.col("t.described_lo"), F.col("t.described_hi")), F.lit(False))
    confidence = F.when(told & F.col("t.sensitive"), "high").when(told, "medium").otherwise("low")
    return met.select("package", "path", F.lit("SEN-AGENT-005").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("agent").alias("category"), F.col("line").cast("int"), confidence.alias("confidence"), T.snippet(F.col("text")).alias("detail"))


def mismatched(files: DataFrame) -> DataFrame:
    """A finding for each tool whose description speaks of something harmless while capabilities are seen; detail names them."""
    t = tool_regions(files).where((F.col("description") != "") & F.col("description").rlike(f"(?i){BENIGN.pattern}") & (F.col("observed") != ""))
    return t.select("package", "path", F.lit("SEN-AGENT-006").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("agent").alias("category"), F.col("lo").alias("line"), F.lit("low").alias("confidence"), F.col("observed").alias("detail"))


def enriched(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Flow findings with detail: network targets are judged by their line and the next one (inside; a cloud's metadata address
    makes them critical), file targets by whether the file has a call that keeps paths inside a root."""
    code = files.select("package", "path", "content")
    rows = findings.join(code, ["package", "path"])
    lines = F.split("content", "\n", -1)
    two = F.concat(F.coalesce(F.get(lines, F.col("line") - 1), F.lit("")), F.lit("\n"), F.coalesce(F.get(lines, F.col("line")), F.lit("")))
    rows = rows.withColumn("two", two)
    inside = F.lit(False)
    for p in INSIDE_TARGETS:
        inside = inside | F.col("two").rlike(p)
    net, file = F.col("rule_id") == "SEN-AGENT-004", F.col("rule_id").isin("SEN-AGENT-002", "SEN-AGENT-003")
    critical = net & inside & F.col("two").rlike(METADATA)
    detail = F.when(critical, "metadata-target").when(net & inside, "inside-target").when(file & F.col("content").rlike(CONTAINMENT), "containment-seen").when(file, "no-containment")
    return rows.withColumn("severity", F.when(critical, "critical").otherwise(F.col("severity"))).withColumn("detail", detail).drop("two", "content")


def semantic_findings(files: DataFrame) -> DataFrame:
    """Everything that is read off a file's meaning, in one table: flows (enriched), poisoned phrases and mismatches."""
    code = files.where(F.col("path").rlike(CODE_FILE))
    flows = enriched(find_flows(code), code).select(*FINDING)
    return flows.unionByName(poisoned(code).select(*FINDING)).unionByName(mismatched(code).select(*FINDING))
