"""Queries of the findings pipeline: matching, suppression, statistics, scores, reports, fingerprints and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import findings as fd
from sievework.operators.match import size_class
from sievework.plans import base as b
from sievework.plans.base import CONTEXT, FILES, HITS, LINES, PAGES, rank_sql, weight_sql
from sievework.plans.catalog import COMMENT_LINE, LITE_RULES, corpus_pack

QUERIES, ORACLE = {}, {}
#: Limits scaled to documents of a few kilobytes.
FULL, LITE, LONG_LINE = 4 << 10, 16 << 10, 300


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {FILES} SELECT regexp_extract(lower(path), '(\\.[^.]*)$', 1) AS ext, CASE WHEN size <= {FULL} THEN 'full' WHEN size <= {LITE} THEN 'lite' ELSE 'hard' END AS klass, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY ALL")
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    f = b.files(spark, sf).withColumn("ext", T.extension(F.col("path"))).withColumn("klass", size_class(F.col("size"), FULL, LITE))
    return f.groupBy("ext", "klass").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"WITH {FILES} SELECT path, {CONTEXT} AS context, regexp_matches(path, '(?i)(^|[\\\\/])(?:dist|build|out|bundle)([\\\\/]|$)') AS build FROM files")
def path_context(spark: SparkSession, sf: str) -> DataFrame:
    return b.files(spark, sf).select("path", T.context(F.col("path")).alias("context"), F.col("path").rlike(T.BUILD_PATH).alias("build"))


@query(f"WITH {HITS} SELECT rule_id, count(*) AS total, count(DISTINCT path) AS files FROM hits GROUP BY rule_id")
def rule_hits_total(spark: SparkSession, sf: str) -> DataFrame:
    return b.hits(spark, sf).groupBy("rule_id").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("path").alias("files"))


@query(f"WITH {HITS} SELECT path, rule_id, pattern_no, line FROM hits")
def rule_hits_lines(spark: SparkSession, sf: str) -> DataFrame:
    return b.hits(spark, sf).select("path", "rule_id", "pattern_no", "line")


@query(f"WITH {HITS} SELECT path, rule_id, line, matched FROM hits WHERE saved")
def rule_hits_capped(spark: SparkSession, sf: str) -> DataFrame:
    return b.hits(spark, sf).where("saved").select("path", "rule_id", "line", "matched")


@query(r"WITH l AS (SELECT page_id, unnest(string_split(html, '>')) AS text FROM pages) SELECT page_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(text, '^\s*(//|\*|/\*)')) AS n_comment, count(*) FILTER (NOT regexp_matches(text, '^\s*(//|\*|/\*)') AND regexp_matches(text, '[a-z]')) AS n_kept FROM l GROUP BY page_id")
def comment_filter(spark: SparkSession, sf: str) -> DataFrame:
    l = b.read(spark, sf, "pages").select("page_id", F.explode(F.split("html", ">", -1)).alias("text"))  # noqa: E741
    comment = F.col("text").rlike(COMMENT_LINE)
    return l.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(comment).alias("n_comment"), F.count_if(~comment & F.col("text").rlike("[a-z]")).alias("n_kept"))


@query(f"WITH {HITS}, {LINES} SELECT h.path, h.line FROM hits h JOIN files f USING (path) JOIN lines t ON t.doc_id = f.doc_id AND t.line = h.line WHERE rule_id = 'CORP-LIC-001' AND NOT regexp_matches(t.text, 'Version [0-9]')")
def exclude_filter(spark: SparkSession, sf: str) -> DataFrame:
    from dataclasses import replace

    from sievework.operators.match import match_rules

    rules = tuple(replace(r, excludes=(r"Version [0-9]",)) for r in corpus_pack() if r.id == "CORP-LIC-001")
    return match_rules(b.files(spark, sf), rules).select("path", "line")


@query(r"SELECT page_id, len(regexp_extract_all(html, 'track\([0-9]+\)')) AS calls FROM pages WHERE regexp_matches(html, '<script') AND regexp_matches(html, 'track\([0-9]+\)')")
def needs_gate(spark: SparkSession, sf: str) -> DataFrame:
    p = b.read(spark, sf, "pages").where(F.col("html").rlike("<script") & F.col("html").rlike(r"track\([0-9]+\)"))
    return p.select("page_id", F.regexp_count("html", F.lit(r"track\([0-9]+\)")).cast("long").alias("calls"))


@query(r"WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS y FROM documents) SELECT doc_id, CASE WHEN length(y) > 240 THEN substr(y, 1, 239) || '…' ELSE y END AS snippet FROM s")
def snippet_projection(spark: SparkSession, sf: str) -> DataFrame:
    return b.read(spark, sf, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(f"WITH {LINES} SELECT doc_id, bool_or(length(text) > {LONG_LINE}) AS minified, CAST(max(length(text)) AS BIGINT) AS longest FROM lines GROUP BY doc_id")
def minified_flag(spark: SparkSession, sf: str) -> DataFrame:
    sizes = F.transform(F.split("text", "\n", -1), lambda x: F.length(x))
    d = b.read(spark, sf, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.exists(sizes, lambda n: n > LONG_LINE).alias("minified"), F.array_max(sizes).cast("long").alias("longest"))


GLOBS = ("fr/**", "**/1*", "de/?", "en/*5*")


@query(f"WITH {PAGES}, g AS (SELECT CASE WHEN regexp_matches(path, '^fr/.*$') THEN 'fr/**' WHEN regexp_matches(path, '^(?:.*/)?1[^/]*$') THEN '**/1*' WHEN regexp_matches(path, '^de/[^/]$') THEN 'de/?' WHEN regexp_matches(path, '^en/[^/]*5[^/]*$') THEN 'en/*5*' ELSE '(kept)' END AS ignored_by FROM pp) SELECT ignored_by, count(*) AS paths FROM g GROUP BY ignored_by")
def glob_ignore(spark: SparkSession, sf: str) -> DataFrame:
    first = F.lit("(kept)")
    for g in reversed(GLOBS):
        first = F.when(F.col("path").rlike(T.glob_pattern(g)), g).otherwise(first)
    return b.page_paths(spark, sf).groupBy(first.alias("ignored_by")).agg(F.count(F.lit(1)).alias("paths"))


@query(f"WITH {HITS} SELECT path, rule_id, line, suppressed FROM hits")
def suppression_flag(spark: SparkSession, sf: str) -> DataFrame:
    return fd.suppress(b.hits(spark, sf)).select("path", "rule_id", "line", "suppressed")


def _stats(column: str):
    @query(f"WITH {HITS} SELECT {column}, count(*) AS findings, count(*) FILTER (saved) AS saved, count(*) FILTER (suppressed) AS suppressed FROM hits GROUP BY {column}")
    def stats(spark: SparkSession, sf: str) -> DataFrame:
        return b.scored_hits(spark, sf).groupBy(column).agg(F.count(F.lit(1)).alias("findings"), F.count_if("saved").alias("saved"), F.count_if("suppressed").alias("suppressed"))

    QUERIES[f"stats_{column}"], ORACLE[f"stats_{column}"] = QUERIES.pop("stats"), ORACLE.pop("stats")


for _c in ("severity", "category", "context"):
    _stats(_c)


@query(f"WITH {HITS} SELECT severity, category, context, count(*) AS findings FROM hits GROUP BY GROUPING SETS ((severity), (category), (context), ())")
def stats_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    h = b.scored_hits(spark, sf)
    return h.groupingSets([["severity"], ["category"], ["context"], []], "severity", "category", "context").agg(F.count(F.lit(1)).alias("findings"))


@query(f"WITH {HITS}, p AS (SELECT package, context, count(*) AS findings FROM hits GROUP BY ALL) SELECT package, CAST(sum(findings) AS BIGINT) AS findings, count(*) AS contexts FROM p GROUP BY package")
def stats_merge(spark: SparkSession, sf: str) -> DataFrame:
    part = b.scored_hits(spark, sf).groupBy("package", "context").agg(F.count(F.lit(1)).alias("findings"))
    return part.groupBy("package").agg(F.sum("findings").alias("findings"), F.count(F.lit(1)).alias("contexts"))


RAW = f"""raw AS (SELECT package, context, count(*) AS findings,
  CAST(sum(CASE WHEN NOT saved OR NOT suppressed THEN {weight_sql("least(" + rank_sql("severity") + " + CASE WHEN context <> 'source' THEN 1 ELSE 0 END, 4)")} ELSE 0 END) AS BIGINT) AS raw FROM hits GROUP BY ALL),
sc AS (SELECT package, CAST(sum(findings) AS BIGINT) AS findings,
  CAST(least(100, coalesce(sum(raw) FILTER (context = 'source'), 0) + least(20, coalesce(sum(raw) FILTER (context = 'test'), 0)) + least(20, coalesce(sum(raw) FILTER (context = 'development'), 0))) AS INTEGER) AS score FROM raw GROUP BY package)"""
VERDICT = "CASE WHEN score >= 80 THEN 'dangerous' WHEN score >= 50 THEN 'risky' WHEN score >= 20 THEN 'review' ELSE 'safe' END"


@query(f"WITH {HITS}, {RAW} SELECT * FROM sc")
def package_score(spark: SparkSession, sf: str) -> DataFrame:
    return fd.package_scores(fd.raw_scores(b.scored_hits(spark, sf)))


@query(f"WITH {HITS}, {RAW}, v AS (SELECT package, coalesce(sc.findings, 0) AS findings, coalesce(score, 0) AS score FROM (SELECT DISTINCT package FROM files) LEFT JOIN sc USING (package)) SELECT *, {VERDICT} AS verdict FROM v")
def package_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return fd.verdicts(package_score(spark, sf), b.files(spark, sf))


@query(f"""WITH {HITS}, {RAW}, c AS (SELECT package, count(*) AS files, count(*) FILTER (size > {LITE}) AS hard, count(*) FILTER (size = 0) AS unread, bool_and(size <= {LITE} AND size > 0) AS complete FROM files GROUP BY package),
v AS (SELECT package, files, hard, unread, complete, CASE WHEN complete THEN coalesce(score, 0) ELSE greatest(coalesce(score, 0), 20) END AS score FROM c LEFT JOIN sc USING (package)) SELECT *, {VERDICT} AS verdict FROM v""")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    f = b.files(spark, sf).withColumn("klass", size_class(F.col("size"), FULL, LITE))
    whole = F.bool_and((F.col("klass") != "hard") & (F.col("size") > 0))
    c = f.groupBy("package").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("klass") == "hard").alias("hard"), F.count_if(F.col("size") == 0).alias("unread"), whole.alias("complete"))
    v = fd.verdicts(package_score(spark, sf), c, c)
    return c.join(v, "package").select("package", "files", "hard", "unread", "complete", "score", "verdict")


@query(f"WITH {HITS} SELECT package, rule_id, matched, path, line FROM hits WHERE saved QUALIFY row_number() OVER (PARTITION BY package, rule_id, matched ORDER BY path, line) = 1")
def report_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return fd.deduplicate(b.hits(spark, sf).where("saved"), ["package", "rule_id", "matched"], ["path", "line"]).select("package", "rule_id", "matched", "path", "line")


@query(f"WITH {HITS} SELECT path, rule_id, severity, line FROM hits WHERE saved ORDER BY {rank_sql('severity')}, path, line, rule_id LIMIT 50")
def report_topk(spark: SparkSession, sf: str) -> DataFrame:
    return fd.top(b.hits(spark, sf).where("saved"), 50, collate=False).select("path", "rule_id", "severity", "line")


@query(f"WITH {HITS} SELECT package, path, rule_id, line FROM hits WHERE saved QUALIFY row_number() OVER (PARTITION BY package ORDER BY {rank_sql('severity')}, path, line, rule_id) <= 5")
def priority_buffer(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("package").orderBy(*fd.report_order(False))
    return b.hits(spark, sf).where("saved").withColumn("k", F.row_number().over(order)).where("k <= 5").select("package", "path", "rule_id", "line")


@query(f"WITH {FILES} SELECT path, size FROM files ORDER BY size DESC, path LIMIT 5")
def largest_files(spark: SparkSession, sf: str) -> DataFrame:
    return b.files(spark, sf).select("path", "size").orderBy(F.desc("size"), "path").limit(5)


TOKEN = r"[0-9a-f]{40}"
CARD = r"[0-9]{16}"


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([0-9a-f]{6})[0-9a-f]{30}([0-9a-f]{4})', '\1****\2', 'g'), '([0-9]{6})[0-9]{6}([0-9]{4})', '\1****\2', 'g')) AS redacted_md5, regexp_matches(text, '[0-9a-f]{40}|[0-9]{16}') AS redacted FROM documents")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    d = b.read(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.redact(F.col("text"), (TOKEN, CARD))).alias("redacted_md5"), F.col("text").rlike(f"{TOKEN}|{CARD}").alias("redacted"))


@query(f"WITH s AS (SELECT doc_id, (regexp_extract_all(text, '{TOKEN}') || regexp_extract_all(text, '{CARD}'))[1:5] AS ms FROM documents) SELECT doc_id, array_to_string(list_transform(ms, lambda m: substr(sha256(m), 1, 24)), ',') AS fingerprints FROM s WHERE len(ms) > 0")
def secret_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    d = b.read(spark, sf, "documents").select("doc_id", T.secret_fingerprints(F.col("text"), (TOKEN, CARD)).alias("f"))
    return d.where(F.size("f") > 0).select("doc_id", F.array_join("f", ",").alias("fingerprints"))


_PRINT = r"substr(sha256(rule_id || '|' || lower(replace(path, '\', '/')) || '|||' || substr(trim(regexp_replace(matched, '\s+', ' ', 'g')), 1, 240)), 1, 24)"


def _printed(spark: SparkSession, sf: str) -> DataFrame:
    h = b.hits(spark, sf).where("saved")
    return h.withColumn("fingerprint", T.fingerprint(F.col("rule_id"), F.col("path"), F.lit(None), F.lit(None), F.col("matched")))


@query(f"WITH {HITS} SELECT path, rule_id, line, {_PRINT} AS fingerprint FROM hits WHERE saved")
def finding_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return _printed(spark, sf).select("path", "rule_id", "line", "fingerprint")


@query(f"WITH {HITS}, f AS (SELECT path, rule_id, line, {_PRINT} AS base FROM hits WHERE saved), o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path, line) AS k FROM f) SELECT path, rule_id, line, CAST(k AS INTEGER) AS occurrence, CASE WHEN k > 1 THEN substr(sha256(base || '|occurrence:' || k), 1, 24) ELSE base END AS fingerprint FROM o")
def fingerprint_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return fd.occurrences(_printed(spark, sf), ["path", "line"]).select("path", "rule_id", "line", "occurrence", "fingerprint")


_HALF = "substr(sha256(rule_id || '|' || matched), 1, 24)"


def _baseline(state: str):
    @query(f"WITH {HITS}, x AS (SELECT DISTINCT {_HALF} AS fingerprint FROM hits WHERE saved AND NOT ends_with(path, '.en')), y AS (SELECT DISTINCT {_HALF} AS fingerprint FROM hits WHERE saved AND ends_with(path, '.en')), j AS (SELECT coalesce(x.fingerprint, y.fingerprint) AS fingerprint, CASE WHEN y.fingerprint IS NULL THEN 'new' WHEN x.fingerprint IS NULL THEN 'resolved' ELSE 'existing' END AS state FROM x FULL JOIN y ON x.fingerprint = y.fingerprint) SELECT fingerprint FROM j WHERE state = '{state}'")
    def one(spark: SparkSession, sf: str) -> DataFrame:
        h = b.hits(spark, sf).where("saved").select("path", F.substring(F.sha2(F.concat_ws("|", "rule_id", "matched"), 256), 1, 24).alias("fingerprint"))
        english = F.col("path").endswith(".en")
        return fd.baseline(h.where(~english), h.where(english)).where(F.col("state") == state).select("fingerprint")

    QUERIES[f"baseline_{state}"], ORACLE[f"baseline_{state}"] = QUERIES.pop("one"), ORACLE.pop("one")


for _s in ("new", "resolved", "existing"):
    _baseline(_s)


@query(f"WITH {HITS} SELECT CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS results, count(DISTINCT rule_id) AS rules FROM hits WHERE saved GROUP BY level")
def sarif_levels(spark: SparkSession, sf: str) -> DataFrame:
    h = b.hits(spark, sf).where("saved").withColumn("level", fd.sarif_level(F.col("severity")))
    return h.groupBy("level").agg(F.count(F.lit(1)).alias("results"), F.countDistinct("rule_id").alias("rules"))


LIGHT = ("CORP-SECRET-001", "CORP-PII-002", "CORP-OBF-001")


@query(f"WITH {HITS} SELECT rule_id, count(*) AS findings FROM hits JOIN files USING (package, path) WHERE size <= {FULL} OR (size <= {LITE} AND rule_id IN {LIGHT}) GROUP BY rule_id")
def lite_subset(spark: SparkSession, sf: str) -> DataFrame:
    from sievework.operators.match import match_rules

    f = b.files(spark, sf).withColumn("klass", size_class(F.col("size"), FULL, LITE)).where(F.col("klass") != "hard")
    out = None
    for klass, rules in (("full", corpus_pack()), ("lite", tuple(r for r in corpus_pack() if r.id in (*LIGHT, *LITE_RULES)))):
        part = match_rules(f.where(F.col("klass") == klass), rules)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


@query(f"WITH {HITS}, p AS (SELECT doc_id, bool_or(rule_id = 'CORP-DEC-001') AS flagged FROM files JOIN hits USING (package, path) GROUP BY doc_id), j AS (SELECT toxic, quality, coalesce(flagged, FALSE) AS flagged FROM labels LEFT JOIN p USING (doc_id)), c AS (SELECT toxic, count(*) FILTER (flagged AND quality = 0) AS tp, count(*) FILTER (flagged AND quality = 1) AS fp, count(*) FILTER (NOT flagged AND quality = 0) AS fn FROM j GROUP BY toxic) SELECT toxic, tp, fp, fn, round(tp / nullif(tp + fp, 0), 3) AS precision_, round(tp / nullif(tp + fn, 0), 3) AS recall FROM c")
def label_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from sievework.operators.labels import metrics

    h = b.hits(spark, sf).where(F.col("rule_id") == "CORP-DEC-001").select("path").distinct()
    flagged = b.files(spark, sf).join(h, "path").select("doc_id", F.lit(True).alias("flagged"))
    j = b.read(spark, sf, "labels").join(flagged, "doc_id", "left").select("toxic", (F.col("quality") == 0).alias("expected"), F.coalesce("flagged", F.lit(False)).alias("found"))
    return metrics(j, ["toxic"]).select("toxic", "tp", "fp", "fn", F.col("precision").alias("precision_"), "recall")
