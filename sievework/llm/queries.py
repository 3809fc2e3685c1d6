"""The queries opN_<name> over the driver's tables, with production parameters, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontaminate, jaccard_join, jpeg, langid, line_dedup, mixing, quality, substring_dedup, suffix_dedup, toxicity
from sievework.llm.common import documents, remainder


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.decontaminate(documents(spark, sf_dir), bench))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    return langid.predict(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir), words=4, similar=(85, 100)).select("doc_id", "n_shingles", "component_id")


def op9_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.digest(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, net).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "windows", "worst_word")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language": op7_language,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_media_jpeg": op9_media_jpeg,
    "op10_toxicity": op10_toxicity,
}

_OP2 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS p FROM i WHERE len(ws) > 0)),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (
  SELECT doc_id, p, l, array_to_string(ws[p:p + l - 1], ' ') AS k
  FROM (SELECT doc_id, ws, l, unnest(generate_series(1, len(ws) - l + 1)) AS p FROM w, ls WHERE len(ws) >= l)),
h AS (SELECT dw.doc_id, dw.p, iw.l, iw.item_id FROM dw JOIN iw USING (l, k)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + l - 1)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

_OP1 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS p FROM d),
w AS (
  SELECT doc_id, p, 3 AS k, array_to_string(ls[p:p + 2], chr(10)) AS v FROM l WHERE p + 2 <= len(ls)
  UNION ALL SELECT doc_id, p, 1, ls[p] FROM l WHERE length(ls[p]) >= 200),
r AS (SELECT doc_id, p, k, row_number() OVER (PARTITION BY k, v ORDER BY doc_id, p) AS i FROM w),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + k - 1)) AS p FROM r WHERE i > 1),
s AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (p - 1 <> coalesce(b, -1)) AS n_runs
      FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM g) GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(ls[l.p], chr(10) ORDER BY l.p) AS kept FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: Windows of 20 words, each but the first of its words removed.
_OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS v FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS p FROM d)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY v ORDER BY doc_id, p) AS i FROM w),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 19)) AS p FROM r WHERE i > 1),
k AS (SELECT l.doc_id, string_agg(l.v, ' ' ORDER BY l.p) AS kept, count(*) AS n
      FROM (SELECT doc_id, unnest(ws) AS v, unnest(generate_series(1, len(ws))) AS p FROM d) l ANTI JOIN g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def _op4() -> str:
    """Six rounds of 32 sections each, then quotas and permuted blocks."""
    rounds = ["b0 AS (SELECT CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, FALSE AS flattest)"]
    for i in range(mixing.ROUNDS):
        rounds.append(f"""
x{i} AS (SELECT k, p, pow(p, lo + k * ((hi - lo) / 32)) AS x FROM sh, b{i}, (SELECT unnest(generate_series(0, 32)) AS k)),
j{i} AS (SELECT max(k) AS l FROM (SELECT k FROM x{i}, n GROUP BY k, c
         HAVING ln(sum(x)) - sum(x * ln(x)) / sum(x) > {mixing.ENTROPY} * ln(c) OR max(x / p) / sum(x) * {mixing.BUDGET} > {mixing.REPEATS})),
b{i + 1} AS (SELECT lo + least(coalesce(l, -1), 31) * ((hi - lo) / 32) AS lo, lo + (least(coalesce(l, -1), 31) + 1) * ((hi - lo) / 32) AS hi,
         {"l IS NULL" if i == 0 else "flattest"} AS flattest FROM b{i}, j{i})""")
    h = lambda x: f"CAST('0x' || substr(md5({x}), 1, 13) AS BIGINT)"
    return f"""
WITH tok AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') AS name, coalesce('s' || source, '') AS key,
                    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS t FROM documents),
st AS (SELECT key, count(*) AS docs, CAST(sum(t) AS BIGINT) AS tokens FROM tok GROUP BY key),
n AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) FILTER (tokens > 0) AS c FROM st),
sh AS (SELECT tokens / total AS p FROM st, n WHERE tokens > 0),
{",".join(rounds)},
a AS (SELECT CASE WHEN c < 2 THEN 1.0 WHEN flattest THEN 0.0 ELSE round(hi, 6) END AS a FROM b{mixing.ROUNDS}, n),
z AS (SELECT sum(pow(p, a)) AS z FROM sh, a),
w AS (SELECT *, CASE WHEN tokens > 0 THEN pow(tokens / total, a) / z ELSE 0.0 END AS weight FROM st, n, a, z),
q AS (SELECT *, CAST(least(floor(weight * (total * {mixing.BUDGET})), tokens * {mixing.REPEATS}) AS BIGINT) AS quota FROM w),
f AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS full_, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest,
             CAST(ceil(docs / greatest({float(mixing.LEAST_BLOCK)}, sqrt(docs))) AS BIGINT) AS blocks FROM q),
e AS (SELECT doc_id, source, name, key, t, weight, full_, rest, {h("concat_ws('|', name, 'b')")} % blocks AS b,
             unnest(generate_series(0, full_ - CASE WHEN rest > 0 THEN 0 ELSE 1 END)) AS epoch FROM tok JOIN f USING (key)),
g AS (SELECT *, epoch >= full_ AND t > rest AS aside, CASE WHEN epoch >= full_ AND t > rest THEN 0 ELSE t END AS fits,
             {h("concat_ws('|', name, CAST(epoch AS VARCHAR))")} AS hd FROM e),
k AS (SELECT *, row_number() OVER o AS rank, sum(fits) OVER (o ROWS UNBOUNDED PRECEDING) AS upto FROM g WINDOW o AS (PARTITION BY key, epoch, b ORDER BY hd, doc_id, t)),
bs AS (SELECT key, epoch, b, sum(fits) AS size, {h("concat_ws('|', key, CAST(epoch AS VARCHAR), CAST(b AS VARCHAR))")} AS o FROM g GROUP BY key, epoch, b),
bo AS (SELECT key, epoch, b, row_number() OVER o AS block, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS before_ FROM bs WINDOW o AS (PARTITION BY key, epoch ORDER BY o, b))
SELECT doc_id, source, t AS n_tokens, round(weight, 6) AS weight, CAST(epoch AS INTEGER) AS epoch, block, rank
FROM k JOIN bo USING (key, epoch, b) WHERE epoch < full_ OR (NOT aside AND before_ + upto <= rest)
"""


#: Windows of 100 bytes as hex digits; all but the first of each, put together to runs.
_OP3 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p - 1, 200)) AS v FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 99)) AS p FROM d)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY v ORDER BY doc_id, p) AS i FROM w),
f AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM r WHERE i > 1),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM f),
s AS (SELECT doc_id, run, min(p) AS lo, max(p) + 99 AS hi FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before_ FROM s),
k AS (SELECT d.doc_id, sum(hi - lo + 1) AS n, count(*) AS spans, string_agg(substr(h, 2 * before_ + 1, 2 * (lo - before_ - 1)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM e JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

#: Every pair of documents that share a shingle, those that are similar, and what they reach.
_OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + 3], ' ')) AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.v, r.root FROM r JOIN e ON r.node = e.u)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.root), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""


ORACLE = {"op1_line_dedup": _OP1, "op2_decontaminate": _OP2, "op3_suffix_dedup": _OP3, "op4_mixing": _op4(), "op6_substring_dedup": _OP6, "op8_jaccard_join": _OP8}
