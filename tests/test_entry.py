import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SMALL = Path("/root/testdata/sf0.001")


def test_registered():
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 60


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
def test_flagship(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns == ["package", "findings", "score", "verdict"] and got.count() > 0


def test_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO / "sievework", tmp_path / "sievework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [k for k in q if k.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
def test_queries_match_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    from sievework.plans import registry

    con = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    for name, sql in registry.ORACLE.items():
        got = registry.QUERIES[name](spark, str(SMALL))
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        want = sorted(str([row[names.index(c)] for c in sorted(names)]) for row in result.fetchall())
        assert sorted(names) == sorted(got.columns), name
        assert sorted(str([row[c] for c in sorted(names)]) for row in got.collect()) == want, name
