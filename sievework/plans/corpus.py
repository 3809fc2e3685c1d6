"""Queries of graphs, supply chain, bytes, regions and properties over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import text as T
from sievework.operators import binary, graphs, labels, regions, supply
from sievework.plans import base as b
from sievework.plans.base import LINES, PAGES

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Drift: the package holds documents with a changed text (every 11th) and lacks every 13th.
@query("WITH s AS (SELECT doc_id, text FROM documents WHERE doc_id % 17 <> 0), p AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 0) SELECT CAST(coalesce(s.doc_id, p.doc_id) AS VARCHAR) AS path, CASE WHEN s.doc_id IS NULL THEN 'extra' WHEN p.doc_id IS NULL THEN 'missing' ELSE 'modified' END AS state FROM s FULL JOIN p ON s.doc_id = p.doc_id WHERE s.doc_id IS NULL OR p.doc_id IS NULL OR s.text <> p.text")
def drift_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    d = b.read(spark, sf, "documents")
    side = lambda x, t: x.select(F.col("doc_id").cast("string").alias("path"), F.octet_length(t).alias("size"), F.substring(F.sha2(t, 256), 1, 16).alias("hash"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return supply.drift(side(d.where("doc_id % 17 <> 0"), F.col("text")), side(d.where("doc_id % 13 <> 0"), changed))


@query("""WITH k AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts FROM events), a AS (SELECT event_type AS key, max(k) AS v FROM k WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), z AS (SELECT event_type AS key, max(k) AS v FROM k WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1) SELECT coalesce(a.key, z.key) AS key, a.v AS before, z.v AS after FROM a FULL JOIN z ON a.key = z.key WHERE a.v IS DISTINCT FROM z.v""")
def script_diff(spark: SparkSession, sf: str) -> DataFrame:
    e = b.read(spark, sf, "events").select(F.col("event_type").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("k"), "ts")
    half = lambda x: x.groupBy("key").agg(F.max("k").alias("value"))
    early = F.col("ts") < F.lit("2024-01-10").cast("timestamp")
    return supply.value_diff(half(e.where(early)), half(e.where(~early))).select("key", "before", "after")


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = b.read(spark, sf, "documents").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("digest"), "doc_id")
    return d.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


_HREF = r"""hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages)"""


def _hrefs(spark: SparkSession, sf: str) -> DataFrame:
    return b.read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1))).alias("target"))


@query(f"WITH {_HREF} SELECT page_id, target, count(*) AS links FROM hrefs GROUP BY ALL")
def link_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _hrefs(spark, sf).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("links"))


@query("""WITH w AS (SELECT p_partkey, p_name, [p_name || ' xl', 'large ' || split_part(p_name, ' ', 2), 'small ' || split_part(p_name, ' ', 2), split_part(p_name, ' ', 1) || ' ring'] AS c FROM part), e AS (SELECT p_partkey, unnest(generate_series(1, 4)) AS pos, unnest(c) AS name FROM w), m AS (SELECT p_partkey, arg_min(name, pos) AS found FROM e JOIN (SELECT DISTINCT p_name AS name FROM part) USING (name) GROUP BY p_partkey) SELECT p_partkey, found FROM w LEFT JOIN m USING (p_partkey)""")
def candidate_join(spark: SparkSession, sf: str) -> DataFrame:
    p = b.read(spark, sf, "part")
    first, second = F.substring_index("p_name", " ", 1), F.coalesce(F.get(F.split("p_name", " "), F.lit(1)), F.lit(""))
    names = F.array(F.concat("p_name", F.lit(" xl")), F.concat(F.lit("large "), second), F.concat(F.lit("small "), second), F.concat(first, F.lit(" ring")))
    return graphs.first_existing(p.select("p_partkey", names.alias("c")), "c", p.select(F.col("p_name").alias("path"))).select("p_partkey", "found")


# Levels from the regions through nations to customers.
@query("WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS u, 'n' || n_nationkey AS v FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), w(node, level, parent) AS (SELECT 'r' || r_regionkey, 0, CAST(NULL AS VARCHAR) FROM region UNION ALL SELECT e.v, w.level + 1, e.u FROM w JOIN e ON w.node = e.u) SELECT node, CAST(min(level) AS INTEGER) AS level, min(parent) AS parent FROM w GROUP BY node")
def bfs_levels(spark: SparkSession, sf: str) -> DataFrame:
    n, c = b.read(spark, sf, "nation"), b.read(spark, sf, "customer")
    s = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    edges = n.select(s("r", "n_regionkey").alias("u"), s("n", "n_nationkey").alias("v")).unionByName(c.select(s("n", "c_nationkey").alias("u"), s("c", "c_custkey").alias("v")))
    return graphs.levels(edges, b.read(spark, sf, "region").select(s("r", "r_regionkey").alias("node")))


@query("SELECT c_custkey AS target, 'c' || c_custkey || '<n' || n_nationkey || '<r' || n_regionkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey")
def reverse_paths(spark: SparkSession, sf: str) -> DataFrame:
    n, c = b.read(spark, sf, "nation"), b.read(spark, sf, "customer")
    s = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    edges = n.select(s("n", "n_nationkey").alias("u"), s("r", "n_regionkey").alias("v"))
    node = s("n", "c_nationkey")
    starts = c.select(F.col("c_custkey").alias("target"), node.alias("node"), F.array(s("c", "c_custkey"), node).alias("path"))
    walked = graphs.paths(edges, starts).where(F.col("node").startswith("r"))
    return walked.select("target", F.array_join("path", "<").alias("path"))


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'direct' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'transitive' ELSE 'none' END AS kind FROM customer")
def dependency_kinds(spark: SparkSession, sf: str) -> DataFrame:
    o = b.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    kind = F.when(F.col("urgent"), "direct").when(F.col("urgent").isNotNull(), "transitive").otherwise("none")
    return b.read(spark, sf, "customer").join(o, "c_custkey", "left").select("c_custkey", kind.alias("kind"))


@query("SELECT user_id AS tool, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS capabilities, count(*) AS findings FROM events GROUP BY 1")
def capability_agg(spark: SparkSession, sf: str) -> DataFrame:
    e = b.read(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("tool")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("capabilities"), F.count(F.lit(1)).alias("findings"))


@query("WITH t AS (SELECT user_id AS tool, list(DISTINCT event_type) AS seen FROM events GROUP BY 1), x AS (SELECT tool, list_sort(list_filter(seen, lambda c: NOT list_contains(CASE tool % 3 WHEN 0 THEN ['click', 'view'] WHEN 1 THEN ['purchase', 'error'] ELSE ['click', 'view', 'purchase', 'error', 'signup'] END, c))) AS extra FROM t) SELECT tool, array_to_string(extra, ',') AS undeclared FROM x WHERE len(extra) > 0")
def capability_policy(spark: SparkSession, sf: str) -> DataFrame:
    seen = b.read(spark, sf, "events").groupBy(F.col("user_id").alias("tool")).agg(F.collect_set("event_type").alias("seen"))
    lit = lambda *x: F.array(*map(F.lit, x))
    declared = F.when(F.col("tool") % 3 == 0, lit("click", "view")).when(F.col("tool") % 3 == 1, lit("purchase", "error")).otherwise(lit("click", "view", "purchase", "error", "signup"))
    out = seen.select("tool", F.array_sort(F.array_except("seen", declared)).alias("extra"))
    return out.where(F.size("extra") > 0).select("tool", F.array_join("extra", ",").alias("undeclared"))


# Regions: a user's turn opens a region that holds up to the next two turns; phrases are looked up in all turns.


@query("""WITH p AS (SELECT conv_id, turn, role FROM conversations WHERE regexp_matches(text, '(?i)(^|[^a-z])(?:les|the|der) ')), r AS (SELECT conv_id, turn AS lo, turn + 2 AS hi FROM conversations WHERE role = 'user') SELECT p.conv_id, p.turn, CAST(coalesce(min(r.lo), -1) AS BIGINT) AS region, CASE WHEN min(r.lo) IS NULL THEN 'low' WHEN any_value(p.role) = 'assistant' THEN 'high' ELSE 'medium' END AS confidence FROM p LEFT JOIN r ON p.conv_id = r.conv_id AND p.turn BETWEEN r.lo AND r.hi GROUP BY p.conv_id, p.turn""")
def poison_regions(spark: SparkSession, sf: str) -> DataFrame:
    c = b.read(spark, sf, "conversations")
    p = c.where(F.col("text").rlike(r"(?i)(^|[^a-z])(?:les|the|der) ")).select(F.col("conv_id").alias("item"), F.col("turn").alias("line"), "role")
    r = c.where(F.col("role") == "user").select(F.col("conv_id").alias("item"), F.col("turn").alias("lo"), (F.col("turn") + 2).alias("hi"))
    out = regions.contain(p, r, ["item"])
    confidence = F.when(F.col("region").isNull(), "low").when(F.col("role") == "assistant", "high").otherwise("medium")
    return out.select(F.col("item").alias("conv_id"), F.col("line").alias("turn"), F.coalesce("region", F.lit(-1)).alias("region"), confidence.alias("confidence"))


@query(r"""SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(html, '<script') THEN 'script' END, CASE WHEN regexp_matches(html, '<style') THEN 'style' END, CASE WHEN regexp_matches(html, 'href="http') THEN 'external' END, CASE WHEN regexp_matches(html, 'token\s*=') THEN 'secret' END) AS observed FROM pages WHERE regexp_matches(html, '<title>[^<]*[a-z]')""")
def mismatch_flags(spark: SparkSession, sf: str) -> DataFrame:
    p = b.read(spark, sf, "pages").where(F.col("html").rlike("<title>[^<]*[a-z]"))
    checks = [(F.col("html").rlike(x), n) for x, n in (("<script", "script"), ("<style", "style"), ('href="http', "external"), (r"token\s*=", "secret"))]
    return p.select("page_id", supply.reasons(*checks).alias("observed"))


@query(r"""WITH i AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS ip FROM documents), o AS (SELECT doc_id, ip, CAST(split_part(ip, '.', 1) AS INT) AS a, CAST(split_part(ip, '.', 2) AS INT) AS b, CAST(split_part(ip, '.', 3) AS INT) AS c, CAST(split_part(ip, '.', 4) AS INT) AS d FROM i) SELECT doc_id, ip, a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) AS private FROM o""")
def private_ip_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = b.read(spark, sf, "documents")
    ips = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0))).alias("ip"))
    return ips.select("doc_id", "ip", T.private_ip(F.col("ip")).alias("private"))


#: Names of secrets by language, and the hosts they may go to.
DESTINATIONS = (("^FR_.*KEY$", "ththre.example.com"), ("^EN_.*", "the.example.com"), ("^DE_.*KEY$", "der.example.com"))


@query(f"""WITH {PAGES}, s AS (SELECT page_id, host, upper(split_part(path, '/', 1)) || '_API_KEY' AS secret FROM pp) SELECT page_id, host, secret FROM s WHERE NOT EXISTS (SELECT 1 FROM (VALUES {", ".join(f"('{p}', '{h}')" for p, h in DESTINATIONS)}) d(p, h) WHERE regexp_matches(secret, p) AND host = h)""")
def credential_destination(spark: SparkSession, sf: str) -> DataFrame:
    s = b.page_paths(spark, sf).select("page_id", "host", F.concat(F.upper(F.substring_index("path", "/", 1)), F.lit("_API_KEY")).alias("secret"))
    d = spark.createDataFrame(DESTINATIONS, "pattern string, host string")
    return s.join(F.broadcast(d), (s["host"] == d["host"]) & F.expr("secret rlike pattern"), "left_anti")


@query(f"WITH {PAGES} SELECT page_id, host FROM pp")
def host_extract(spark: SparkSession, sf: str) -> DataFrame:
    return b.page_paths(spark, sf).select("page_id", "host")


@query()
def taint_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All line items are edges and all parts seeds; too much for SQL that has no bound on a round. Tests hold it against brute force."""
    return _closure(b.read(spark, sf, "lineitem"), b.read(spark, sf, "part"))


def _closure(lines: DataFrame, parts: DataFrame) -> DataFrame:
    edges = lines.select(F.col("l_partkey").alias("u"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 500).alias("v"))
    seeds = parts.select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("source"))
    return graphs.bounded_closure(edges, seeds)


@query("SELECT doc_id, CASE WHEN starts_with(h, '7F454C46') THEN 'elf' WHEN starts_with(h, '4D5A') THEN 'pe' WHEN starts_with(h, '0061736D') THEN 'wasm' WHEN starts_with(h, '504B0304') THEN 'zip' WHEN starts_with(h, '1F8B') THEN 'gzip' ELSE 'unknown' END AS kind, h AS head FROM (SELECT doc_id, substr(hex(encode(CASE doc_id % 5 WHEN 0 THEN 'MZ' WHEN 1 THEN 'PK' || chr(3) || chr(4) ELSE '' END || coalesce(text, ''))), 1, 16) AS h FROM documents)")
def magic_kind(spark: SparkSession, sf: str) -> DataFrame:
    lead = F.when(F.col("doc_id") % 5 == 0, "MZ").when(F.col("doc_id") % 5 == 1, F.concat(F.lit("PK"), F.char(F.lit(3)), F.char(F.lit(4)))).otherwise("")
    d = b.read(spark, sf, "documents").select("doc_id", F.encode(F.concat(lead, F.coalesce("text", F.lit(""))), "UTF-8").alias("x"))
    return d.select("doc_id", binary.kind(F.col("x")).alias("kind"), F.hex(F.substring("x", 1, 8)).alias("head"))


@query("""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS b FROM documents), c AS (SELECT doc_id, b, count(*) AS c FROM x GROUP BY ALL) SELECT doc_id, CAST(sum(c) AS BIGINT) AS bytes, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 3) AS entropy FROM c GROUP BY doc_id""")
def entropy(spark: SparkSession, sf: str) -> DataFrame:
    d = b.read(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("x"))
    return binary.entropy(d, "doc_id", "x")


@query(r"SELECT doc_id, CAST(len(s) AS BIGINT) AS strings, coalesce(s[1], '') AS first FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\x20-\x7e\t]{4,}') AS s FROM documents)")
def printable_strings(spark: SparkSession, sf: str) -> DataFrame:
    d = b.read(spark, sf, "documents").select("doc_id", binary.printable(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("strings"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"))


@query(r"SELECT doc_id, contains(substr(text, 1, 4096), chr(0)) AS is_binary, CAST(least(len(regexp_extract_all(text, '[a-z]+\.example\.com')), 5) AS INTEGER) AS urls, regexp_matches(text, '(?i)eval|exec|spawn') AS keywords, regexp_matches(text, '[A-Za-z0-9+/]{40}') AS blob, sha256(text) AS digest FROM documents WHERE strlen(text) > 8192")
def hardskip_hints(spark: SparkSession, sf: str) -> DataFrame:
    d = b.read(spark, sf, "documents").where(F.octet_length("text") > 8192)
    urls = F.least(F.size(F.regexp_extract_all("text", F.lit(r"[a-z]+\.example\.com"), F.lit(0))), F.lit(5))
    return d.select("doc_id", F.contains(F.substring("text", 1, 4096), F.char(F.lit(0))).alias("is_binary"), urls.alias("urls"), F.col("text").rlike("(?i)eval|exec|spawn").alias("keywords"), F.col("text").rlike("[A-Za-z0-9+/]{40}").alias("blob"), F.sha2("text", 256).alias("digest"))


@query("SELECT event_type AS rule_id, user_id AS item FROM events WHERE ts < TIMESTAMP '2024-01-10' INTERSECT SELECT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def expected_and_found(spark: SparkSession, sf: str) -> DataFrame:
    """What the first days have is expected, what the others have is found."""
    e = b.read(spark, sf, "events").select(F.col("event_type").alias("rule_id"), F.col("user_id").alias("item"), "ts")
    early = F.col("ts") < F.lit("2024-01-10").cast("timestamp")
    return labels.detected(e.where(early), e.where(~early), ["rule_id", "item"])


@query()
def band_match(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy one-to-one matches are order-dependent; SQL cannot express them."""
    e = b.read(spark, sf, "events").select((F.col("user_id")).alias("item"), F.col("event_type").alias("rule_id"), (F.unix_timestamp("ts") / 60).cast("long").alias("line"))
    return labels.band_match(e.where("line % 2 = 0"), e.where("line % 2 = 1"), 30)


@query("SELECT name, min(priority) AS priority FROM (SELECT 'NATION_' || (c_nationkey % 30) AS name, 1 AS priority FROM customer UNION ALL SELECT n_name, 2 FROM nation UNION ALL SELECT 'NATION_' || (s_nationkey + 3), 3 FROM supplier) GROUP BY name")
def profile_union(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda x: F.concat(F.lit("NATION_"), x.cast("string"))
    parts = (b.read(spark, sf, "customer").select(name(F.col("c_nationkey") % 30).alias("name"), F.lit(1).alias("priority")), b.read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit(2).alias("priority")), b.read(spark, sf, "supplier").select(name(F.col("s_nationkey") + 3).alias("name"), F.lit(3).alias("priority")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("name").agg(F.min("priority").alias("priority"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def role_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    o = b.read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return b.read(spark, sf, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("SELECT o_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_shipdate < o_orderdate THEN 'early' END, CASE WHEN l_quantity > 45 THEN 'bulk' END, CASE WHEN o_orderstatus <> l_linestatus THEN 'status' END) AS reasons FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def provenance_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _provenance(b.read(spark, sf, "orders"), b.read(spark, sf, "lineitem"))


def _provenance(o: DataFrame, l: DataFrame) -> DataFrame:  # noqa: E741
    checks = ((F.col("l_shipdate") < F.col("o_orderdate"), "early"), (F.col("l_quantity") > 45, "bulk"), (F.col("o_orderstatus") != F.col("l_linestatus"), "status"))
    return o.join(l, o["o_orderkey"] == l["l_orderkey"]).select("o_orderkey", "l_linenumber", supply.reasons(*checks).alias("reasons"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(DISTINCT json_extract_string(props, '$.k')) AS values FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = b.read(spark, sf, "events").select("event_type", F.from_json("props", "k long").getField("k").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.countDistinct("k").alias("values"))


_PURL = "'pkg:generic/' || replace(p_name, '@', '%40') || '@' || p_partkey"


@query(f"SELECT {_PURL} AS purl, p_name AS name, CAST(p_partkey AS VARCHAR) AS version FROM part")
def sbom_components(spark: SparkSession, sf: str) -> DataFrame:
    version = F.col("p_partkey").cast("string")
    return b.read(spark, sf, "part").select(T.purl(F.col("p_name"), version, "generic").alias("purl"), F.col("p_name").alias("name"), version.alias("version"))


@query(f"WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT l_suppkey AS ref, array_to_string(list_sort(list({_PURL})), ';') AS depends_on FROM e JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def sbom_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return _dependencies(b.read(spark, sf, "lineitem"), b.read(spark, sf, "part"))


def _dependencies(lines: DataFrame, parts: DataFrame) -> DataFrame:
    e = lines.select("l_suppkey", "l_partkey").distinct()
    p = parts.select(F.col("p_partkey").alias("l_partkey"), T.purl(F.col("p_name"), F.col("p_partkey").cast("string"), "generic").alias("purl"))
    return e.join(p, "l_partkey").groupBy(F.col("l_suppkey").alias("ref")).agg(F.array_join(F.sort_array(F.collect_list("purl")), ";").alias("depends_on"))


@query(f"SELECT p_brand, sha256(array_to_string(list_sort(list({_PURL})), ';')) AS digest, count(*) AS components FROM part GROUP BY p_brand")
def sbom_digest(spark: SparkSession, sf: str) -> DataFrame:
    p = b.read(spark, sf, "part").select("p_brand", T.purl(F.col("p_name"), F.col("p_partkey").cast("string"), "generic").alias("purl"))
    return p.groupBy("p_brand").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("purl")), ";"), 256).alias("digest"), F.count(F.lit(1)).alias("components"))


@query(f"WITH {LINES} SELECT doc_id, count(*) FILTER (regexp_matches(text, '^[A-Z][a-z]+')) AS direct, count(*) FILTER (regexp_matches(text, '^[A-Za-z]+ [a-z]+ [a-z]+')) AS transitive FROM lines GROUP BY doc_id")
def lockfile_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = b.read(spark, sf, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.regexp_count("text", F.lit(r"(?<![^\n])[A-Z][a-z]+")).cast("long").alias("direct"), F.regexp_count("text", F.lit(r"(?<![^\n])[A-Za-z]+ [a-z]+ [a-z]+")).cast("long").alias("transitive"))


@query(f"WITH {LINES}, g AS (SELECT doc_id, line, text, sum(CASE WHEN starts_with(text, 'Th') OR line = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS row_no FROM lines) SELECT doc_id, CAST(row_no AS BIGINT) AS row_no, count(*) AS lines, min(line) AS first_line FROM g GROUP BY doc_id, row_no")
def patch_rows(spark: SparkSession, sf: str) -> DataFrame:
    l = b.lines(spark, sf)  # noqa: E741
    start = (F.col("text").startswith("Th") | (F.col("line") == 1)).cast("long")
    numbered = l.withColumn("row_no", F.sum(start).over(Window.partitionBy("doc_id").orderBy("line")))
    return numbered.groupBy("doc_id", "row_no").agg(F.count(F.lit(1)).alias("lines"), F.min("line").cast("long").alias("first_line"))


@query("SELECT spec, CASE WHEN strpos(substr(spec, 2), '@') > 0 THEN regexp_extract(spec, '^(.+)@[^@]*$', 1) ELSE spec END AS name, CASE WHEN strpos(substr(spec, 2), '@') > 0 THEN nullif(regexp_extract(spec, '@([^@]*)$', 1), '') END AS version FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN '@scope/' || replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '-') END || CASE p_partkey % 4 WHEN 0 THEN '' ELSE '@' || p_size || '.0' END AS spec FROM part)")
def spec_parse(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("-"))
    spec = F.concat(F.when(k % 3 == 0, F.concat(F.lit("@scope/"), name)).otherwise(name), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("@"), F.col("p_size").cast("string"), F.lit(".0"))))
    d = b.read(spark, sf, "part").select(spec.alias("spec"))
    found = T.package_spec(F.col("spec"))
    return d.select("spec", found[0].alias("name"), found[1].alias("version"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER o AS total, row_number() OVER o AS entry FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)) SELECT l_orderkey, CAST(min(entry) AS INTEGER) AS entry FROM r WHERE total > 100 OR entry > 6 GROUP BY l_orderkey")
def tar_limits(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    l = b.read(spark, sf, "lineitem").withColumn("total", F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("entry", F.row_number().over(order))  # noqa: E741
    return l.where("total > 100 OR entry > 6").groupBy("l_orderkey").agg(F.min("entry").alias("entry"))
