import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import binary, findings, flows, profile, reports, supply
from sievework.plans.catalog import SEVERITIES, audit_pack


@pytest.mark.parametrize("most", [1, 3, 7, 40])
def test_bounded_is_the_buffer(spark, most):
    """What the windows tell is what going through the findings one by one leaves."""
    rng = random.Random(most)
    rows = [(f"p{i % 7}", i, rng.choice(SEVERITIES[i % 3 :])) for i in range(220)]
    want = set()
    for p in {r[0] for r in rows}:
        held = {s: [] for s in SEVERITIES}
        for _, seq, s in (r for r in rows if r[0] == p):
            if sum(map(len, held.values())) < most:
                held[s].append(seq)
            else:
                lowest = next(x for x in reversed(SEVERITIES) if held[x])
                if SEVERITIES.index(s) < SEVERITIES.index(lowest):
                    held[lowest].pop(0)
                    held[s].append(seq)
        want |= {(p, x) for v in held.values() for x in v}
    df = spark.createDataFrame(rows, "package string, seq long, severity string")
    assert {(r.package, r.seq) for r in findings.bounded(df, most).collect()} == want


def test_plan(spark):
    named = spark.createDataFrame([("@s/a", "direct", 0), ("b", "direct", 1), ("b", "patch", 0), ("gone", "bundle", 0), ("me", "patch", 1), ("c", "patch", 2), (None, "patch", 3)], "name string, source string, seq long")
    there = spark.createDataFrame([("@s/a", True), ("b", False), ("me", True), ("c", False), ("d", True), ("e", False)], "name string, plugin boolean")
    got = {r.name: (r.source, r.decision) for r in profile.plan(named, there, ("@s",), "me", 2).collect()}
    assert got == {"@s/a": ("direct", "trusted-scope"), "b": ("direct", "full"), "gone": ("bundle", "not-installed"), "me": ("patch", "self"), "c": ("patch", "full"), "d": ("discovered", "over-limit"), "e": ("discovered", "not-a-plugin")}


def test_is_plugin(spark):
    files = spark.createDataFrame([("a", "package.json", '{"dsh": {"bundle": {}}}'), ("b", "cordis.patch.yml", ""), ("c", "plugin/x.js", ""), ("d", "package.json", "{")], "package string, path string, content string")
    assert {r.package: r.plugin for r in profile.is_plugin(files).collect()} == {"a": True, "b": True, "c": True, "d": False}


def test_binaries(spark):
    rows = [("p", "a", b"\x7fELF curl it", 7.5), ("p", "b", b"\x00asm", 1.0), ("p", "c", b"MZ ghp_x", 1.0)]
    df = spark.createDataFrame(rows, "package string, path string, data binary, entropy double")
    got = {(r.path, r.rule_id, r.severity) for r in binary.binary_findings(df).collect()}
    assert got == {("a", "SEN-BIN-001", "info"), ("a", "SEN-BIN-003", "medium"), ("a", "SEN-BIN-002", "medium"), ("b", "SEN-WASM-001", "info"), ("c", "SEN-BIN-001", "info"), ("c", "SEN-BIN-002", "high")}
    assert {r.path for r in binary.binary_findings(df, 1).collect()} == {"a"} and binary.skipped(df, 1).first().skipped == 2


def test_lockfiles(spark):
    rows = [("a", "yarn.lock", "x@1:\n  v\n# c:\n"), ("a", "bun.lockb", ""), ("b", "pnpm-lock.yaml", "a:\n  b:\n  /c:\n"), ("c", "package-lock.json", "{"), ("d", "x.js", "")]
    got = {r.package: (r.lockfile, r.direct, r.transitive) for r in supply.dependency_counts(spark.createDataFrame(rows, "package string, path string, content string")).collect()}
    assert got == {"a": ("yarn.lock", 0, 1), "b": ("pnpm-lock.yaml", 0, 1), "c": ("package-lock.json", 0, 0)}


def test_payloads(spark):
    rows = [("a", "package.json", "{}"), ("a", "x.js", ""), ("b", "x.js", ""), ("c", "package.json", "[]"), ("c", "x.js", ""), ("d", "package.json", "{}"), ("e", "package.json", "{}"), ("e", "x.ts", " <html >"), ("e", "y.js", None)]
    got = {r.package: r.state for r in supply.payload_states(spark.createDataFrame(rows, "package string, path string, content string")).collect()}
    assert got == {"a": "ok", "b": "no-manifest", "c": "bad-manifest", "d": "no-source", "e": "transport-error"}


def test_provenance(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, "x", "y")], "k int, repo string, tag string")
    e = spark.createDataFrame([(1, "x", "t"), (2, "z", None), (3, "x", "y")], "k int, repo string, tag string")
    assert {r.k: r.reasons for r in supply.provenance(a, e, "k", ("repo", "tag")).collect()} == {1: "tag", 2: "repo", 3: ""}


def test_sinks_by_last_member():
    assert {f[0] for f in flows.flows("defineTool({ execute(args) {\nwindow.eval(args.x)\n} })")} == {"SEN-AGENT-001"}
    assert flows.flows("defineTool({ execute(args) {\nx.request(args.x)\n} })") == []


def test_documents(spark):
    text = reports.rules_document(audit_pack())
    assert text.count("\n| SEN-") == len(audit_pack())
    df = spark.createDataFrame([("/w/a/b.js",), ("/other",), ("",)], "p string")
    assert [(r.x, r.y) for r in df.select(reports.relative(F.col("p"), F.lit("/w")).alias("x"), reports.workspace(F.col("p")).alias("y")).collect()] == [("a/b.js", "<workspace>/b.js"), ("/other", "<workspace>/other"), ("", "<workspace>/target")]
