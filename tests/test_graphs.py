import random
from pathlib import Path

from sievework.operators import graphs, packages


def _counted(spark, df, total):
    """df, and in the accumulator how many of its rows are made, again and again."""

    def run(batches):
        for batch in batches:
            total.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_levels_read_edges_and_roots_once(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(10)], "u string, v string")
    read, begun = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = graphs.levels(_counted(spark, edges, read), _counted(spark, spark.createDataFrame([("n0",)], "node string"), begun)).collect()
    assert {r.node: r.level for r in got} == {f"n{i}": i for i in range(11)}
    assert (read.value, begun.value) == (10, 1)


def test_reachable_reads_files_once(spark):
    rows = [("p", "package.json", '{"main": "a.js"}'), ("p", "a.js", "import './b.js'"), ("p", "b.js", "import './c.js'"), ("p", "c.js", ""), ("p", "d.js", "")]
    read = spark.sparkContext.accumulator(0)
    got = packages.reachable(_counted(spark, spark.createDataFrame(rows, "package string, path string, content string"), read)).collect()
    assert {r.path: r.level for r in got} == {"a.js": 0, "b.js": 1, "c.js": 2}
    assert read.value == len(rows)


def _closed(edges, seeds, rounds):
    want, front = {x: 0 for x in seeds}, set(seeds)
    for i in range(1, rounds + 1):
        front = {(v, source) for node, source in front for u, v in edges if u == node is not None} - set(want)
        want.update(dict.fromkeys(front, i))
    return want


def test_closure_by_distances_and_by_steps(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(150)}", f"n{rng.randrange(70)}") for _ in range(160)] + [("n3", None), (None, "n5"), ("n149", "n3")]
    seeds = [(f"n{rng.randrange(150)}", rng.randrange(40)) for _ in range(60)] + [("n3", None), (None, 7), ("n149", None)]
    u, s = spark.createDataFrame(edges, "u string, v string"), spark.createDataFrame(seeds, "node string, source int")
    for rounds, most in ((1, 2048), (6, 2048), (2, 4)):
        got = graphs.bounded_closure(u, s, rounds, most).collect()
        want = _closed(edges, seeds, rounds)
        assert {(r.node, r.source): r.round for r in got} == want and len(got) == len(want)


def test_closure_does_not_store_its_pairs(spark, tmp_path):
    """Every source gets to every one of 80 targets; what is written on the way is less than a byte a pair."""
    size = lambda: sum(f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if f.is_file())
    edges = spark.range(20000).selectExpr("id + 1000 AS u", "id % 80 AS v").union(spark.range(80).selectExpr("id AS u", "(id + 1) % 80 AS v")).union(spark.range(80).selectExpr("id AS u", "(id * 9) % 80 AS v"))
    before = size()
    out = graphs.bounded_closure(edges, spark.range(20000).selectExpr("id + 1000 AS node", "id AS source"), 40)
    assert out.count() == 20000 * 81
    assert size() - before < 20000 * 80
