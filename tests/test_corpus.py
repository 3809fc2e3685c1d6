import datetime

import pytest

from sievework.plans import registry

PARTS = {1: "red nut", 2: "blue @bolt", 3: "green cog", 4: "lone pin", 700: "far cap"}
#: l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_linestatus
LINES = [(1, 1, 1, 3, 50.0, 5, "O"), (1, 2, 2, 3, 46.0, 1, "F"), (1, 3, 2, 25, 50.0, 9, "O"), (2, 1, 3, 25, 1.0, 1, "F"), (2, 2, 3, 25, 2.0, 3, "O"), (2, 4, 700, 19, 7.0, 3, "F"), (2, 5, 1, 400, 3.0, 9, "O")]
ORDERS = [(1, 4, "O"), (2, 2, "F"), (3, 1, "F")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder, day = tmp_path_factory.mktemp("small"), lambda n: datetime.date(2024, 1, n)
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    save("part", list(PARTS.items()), "p_partkey long, p_name string")
    save("lineitem", [(*x[:5], day(x[5]), x[6]) for x in LINES], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_shipdate date, l_linestatus string")
    save("orders", [(k, day(d), s) for k, d, s in ORDERS], "o_orderkey long, o_orderdate date, o_orderstatus string")
    return str(folder)


def test_dependencies_of_all_suppliers(spark, small):
    want = {}
    for _, _, part, supplier, *_ in LINES:
        want.setdefault(supplier, set()).add(f"pkg:generic/{PARTS[part].replace('@', '%40')}@{part}")
    got = registry.QUERIES["sbom_dependencies"](spark, small).collect()
    assert {r.ref: r.depends_on for r in got} == {k: ";".join(sorted(v)) for k, v in want.items()} and len(got) == 4


def test_provenance_of_all_line_items(spark, small):
    of = {k: (d, s) for k, d, s in ORDERS}
    want = []
    for order, number, _, _, quantity, shipped, status in LINES:
        checks = ((shipped < of[order][0], "early"), (quantity > 45, "bulk"), (of[order][1] != status, "status"))
        want.append((order, number, ",".join(n for hit, n in checks if hit)))
    got = registry.QUERIES["provenance_reasons"](spark, small).collect()
    assert sorted((r.o_orderkey, r.l_linenumber, r.reasons) for r in got) == sorted(want)


def test_closure_over_all_line_items_and_parts(spark, small):
    edges = {(part, (part * 7 + supplier) % 500) for _, _, part, supplier, *_ in LINES}
    want, front = {(p, p): 0 for p in PARTS}, {(p, p) for p in PARTS}
    for i in range(1, 7):
        front = {(v, source) for node, source in front for u, v in edges if u == node}
        for x in front:
            want.setdefault(x, i)
    got = registry.QUERIES["taint_closure"](spark, small).collect()
    assert {(r.node, r.source): r.round for r in got} == want and len(got) == len(want)
    assert {s for n, s in want if n != s} == {1, 2, 3, 700}
