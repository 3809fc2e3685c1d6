import random

import pytest
from brute import WORD
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm.common import written


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A small corpus with toxic documents, a repeated block of lines, copies, near copies and benchmark passages."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    line = lambda: " ".join(rng.choice(words) for _ in range(12)) + "."
    text = lambda k=6: "\n".join(line() for _ in range(k))
    docs = {i: text() for i in range(300)}
    toxic = set(range(0, 300, 6))
    for i in toxic:
        docs[i] += "\n" + " ".join([rng.choice(words), "schuft", rng.choice(words), "grobian"])
    block = text(4)
    holders = list(range(301, 306))
    for i in holders:
        docs[i] = f"{text(3)}\n{block}\n{text(3)}"
    item = " ".join(rng.choice(words) for _ in range(15))
    docs[310] = f"{text(2)}\n{line()} {item} {line()}"
    docs[320] = docs[1]
    near = docs[2].split()
    near[30] = "changed"
    docs[321] = " ".join(near)
    docs[330], docs[331] = "", None
    folder = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, toxic, holders, block


def test_stages(spark, planted):
    folder, docs, toxic, holders, block = planted
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = rows.columns, []
    for name, stage in corpus_pipeline.STAGES:
        rows = written(stage(spark, rows, folder), name)
        kept.append({r.doc_id: r.text for r in rows.collect()})
        assert rows.columns[:5] == columns and (rows.columns == columns or name == "mix")
    first, lines, near, clean, mixed = kept
    assert not toxic & set(first) and len(first) == len(docs) - len(toxic)
    assert lines[holders[0]] == docs[holders[0]]
    for i in holders[1:]:
        assert block not in lines[i] and lines[i] == docs[i].replace(block + "\n", "")
    assert 320 not in lines  # nothing is left of an exact copy
    assert set(lines) - set(near) == {321}
    assert set(near) - set(clean) == {310}
    assert set(mixed) <= set(clean)
    assert all(r.n_chars == len(r.text or "") or r.n_chars is None or r.text is None for r in rows.collect())


def test_passages_on_two_lines_are_cut(spark):
    line = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    passage, short = f"{line('a')}\n{line('b')}", f"{line('c', 20)}\n{line('d', 20)}"
    docs = [(1, f"{line('e')}\n{passage}"), (2, f"{passage}\n{line('f')}"), (3, passage), (4, short), (5, short)]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_lines(spark, docs, "").collect()}
    assert got == {1: docs.where("doc_id = 1").first().text, 2: line("f"), 4: short, 5: short}


def test_run(spark, planted):
    folder, *_ = planted
    out = corpus_pipeline.run(spark, folder)
    total = sum(len(WORD.findall(r.text or "")) for r in out.collect())
    assert out.agg(F.sum("mix_tokens")).first()[0] == total > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_table(spark, planted):
    folder, *_ = planted
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
