"""Views of the driver's tables as packages, files and findings, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import findings as fd
from sievework.operators.match import match_rules
from sievework.plans.catalog import MATCH_GUARD, SAVED_HITS, SEVERITIES, WEIGHTS, corpus_pack


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a package is a source's run of 200 ids."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("/", "source", F.floor(F.col("doc_id") / 200).cast("string")).alias("package"),
        F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 7 == 3, "test/").when(F.col("doc_id") % 7 == 5, "examples/").when(F.col("doc_id") % 7 == 6, "scripts/check-").otherwise(""), F.col("doc_id").cast("string"), F.lit("."), F.coalesce("lang", F.lit("txt"))).alias("path"),
        F.coalesce("text", F.lit("")).alias("content"), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_rules(files(spark, sf_dir), corpus_pack())


def scored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.suppress(fd.with_context(hits(spark, sf_dir)))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line (from 1), text."""
    f = read(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return f.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("line"), "text")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path of a page's URL without its query."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", T.host(F.col("url")).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/]*/([^?#]*)", 1).alias("path"))


# The same for DuckDB.
FILES = """files AS (SELECT source || '/' || (doc_id // 200) AS package,
  source || '/' || CASE doc_id % 7 WHEN 3 THEN 'test/' WHEN 5 THEN 'examples/' WHEN 6 THEN 'scripts/check-' ELSE '' END || doc_id || '.' || coalesce(lang, 'txt') AS path,
  coalesce(text, '') AS content, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents)"""


def _pack_sql() -> str:
    rows = []
    for i, r in enumerate(corpus_pack()):
        for k, (p, _, _) in enumerate(r.lines):
            rows.append(f"({i}, '{r.id}', '{r.severity}', '{r.category}', {k}, '{p.replace(chr(39), chr(39) * 2)}')")
    return f"pack(rule_no, rule_id, severity, category, pattern_no, re) AS (VALUES {', '.join(rows)})"


_RANK = "CASE {s} " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES)) + " ELSE 4 END"
_WEIGHT = "CASE {r} " + " ".join(f"WHEN {i} THEN {WEIGHTS[s]}" for i, s in enumerate(SEVERITIES)) + " END"


def rank_sql(severity: str) -> str:
    return _RANK.format(s=severity)


def weight_sql(rank: str) -> str:
    return _WEIGHT.format(r=rank)


CONTEXT = r"CASE WHEN regexp_matches(path, '(?i)(^|[\\/])(?:test|tests|__tests__|spec|e2e)([\\/]|\.)|\.(?:spec|test|e2e)\.') THEN 'test' WHEN regexp_matches(path, '(?i)(^|[\\/])(?:evals?|bench|benchmark|benchmarks|examples?|fixtures)([\\/]|$)|(^|[\\/])(?:scripts[\\/])?(?:release|live-e2e|check|check-package|dev-run|docs-list)(?:[.\\/-]|$)') THEN 'development' ELSE 'source' END"

HITS = f"""{FILES}, {_pack_sql()},
m AS (SELECT package, path, rule_id, severity, category, pattern_no, regexp_extract_all(content, re)[1:{MATCH_GUARD}] AS ms, string_split_regex(content, re) AS sp
      FROM files, pack WHERE regexp_matches(content, re)),
e AS (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM m),
l AS (SELECT package, path, rule_id, severity, category, pattern_no, i, ms[i] AS matched,
             CAST(1 + len(string_split(array_to_string(sp[1:i], '') || array_to_string(ms[1:i - 1], ''), chr(10))) - 1 AS INTEGER) AS line FROM e),
u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY package, path, rule_id, line ORDER BY pattern_no, i) = 1),
h AS (SELECT *, row_number() OVER (PARTITION BY package, path, rule_id ORDER BY pattern_no, i) AS n FROM u),
hits AS (SELECT *, n <= {SAVED_HITS} AS saved, {CONTEXT} AS context,
                rule_id = 'CORP-OBF-001' AND bool_or(rule_id = 'CORP-SECRET-001') OVER (PARTITION BY package, path, line) AS suppressed FROM h)"""
LINES = "lines AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS line, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))"
PAGES = r"pp AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '') AS host, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path FROM pages)"
