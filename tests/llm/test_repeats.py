import hashlib

import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, later

from sievework.llm import bwt, line_dedup, repeats, substring_dedup, suffix_dedup


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def runs(covered):
    return sum(1 for i in covered if i - 1 not in covered)


def test_bytes(frame, corpus):
    def windows(t):
        b = (t or "").encode()
        return [(i, i + 100, b[i : i + 100]) for i in range(len(b) - 99)]

    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(frame).collect()}
    assert len(got) == len(corpus)
    for d, t, covered in later(corpus, windows):
        b = (t or "").encode()
        assert got[d] == (len(b), len(covered), runs(covered), sha(bytes(c for i, c in enumerate(b) if i not in covered))), d


def test_bytes_of_crowded_anchors(frame, corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 2)
    monkeypatch.setattr(suffix_dedup, "GROUP", 1 << 10)
    test_bytes(frame, corpus)


def test_words(frame, corpus):
    def windows(t):
        w = WORD.findall(t or "")
        return [(i, i + 20, tuple(w[i : i + 20])) for i in range(len(w) - 19)]

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(frame).collect()}
    assert len(got) == len(corpus)
    for d, t, covered in later(corpus, windows):
        w = WORD.findall(t or "")
        assert got[d] == (len(w), len(covered), sha(" ".join(x for i, x in enumerate(w) if i not in covered))), d


@pytest.mark.parametrize("k,chars", [(3, 200), (2, 60), (5, 10**6), (1, 1)])
def test_lines(frame, corpus, k, chars):
    def windows(t):
        ls = t.split("\n") if t is not None else []
        return [(i, i + k, (k, *ls[i : i + k])) for i in range(len(ls) - k + 1)] + [(i, i + 1, (0, x)) for i, x in enumerate(ls) if len(x) >= chars]

    got = {r.doc_id: (r.text, {i for run in r.dedup_runs for i in range(run.start, run.stop)}) for r in line_dedup.line_dedup(frame, k, chars).collect()}
    for d, t, covered in later(corpus, windows):
        want = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in covered)
        assert got[d] == (want, covered), d


@pytest.mark.parametrize("k,words", [(3, 51), (3, 24), (5, 33), (6, 40), (1, 51)])
def test_passages_of_few_lines(spark, corpus, k, words):
    """A repeat of fewer lines than k goes if it has enough words, on however many lines."""
    word = iter(range(10**6))
    line = lambda n: " ".join(f"w{next(word)}" for _ in range(n))
    passages = [f"{line(30)}\n{line(30)}", f"{line(25)}\n{line(25)}", line(55).replace("w", ""), f"{line(11)}\n{line(12)}\n{line(12)}", "\n".join(line(9) for _ in range(5))]
    docs = corpus + [(1000 + i, f"{line(4)}\n{p}\n{line(4)}") for i, p in enumerate(passages * 2)] + [(2000 + i, passages[0]) for i in (0, 0, 1)]

    def windows(t):
        ls = t.split("\n") if t is not None else []
        size = [len(WORD.findall(x)) for x in ls]
        return [(i, i + h, tuple(ls[i : i + h])) for h in range(1, k + 1) for i in range(len(ls) - h + 1) if h == k or sum(size[i : i + h]) >= words]

    got = {}
    for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), k, 10**6, words).collect():
        got.setdefault(r.doc_id, set()).add((r.text, frozenset(i for run in r.dedup_runs for i in range(run.start, run.stop))))
    for d, t, covered in later(sorted(set(docs), key=lambda x: x[0]), windows):
        assert got[d] == {(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in covered), frozenset(covered))}, d


@pytest.mark.parametrize("digest", [suffix_dedup.digest, substring_dedup.digest, line_dedup.digest])
def test_edges(digest, empty, odd):
    assert digest(empty).count() == 0
    got = digest(odd).collect()
    assert len(got) == 8 and all(r.n_removed == 0 for r in got)


def test_other_columns_stay(frame):
    out = line_dedup.line_dedup(frame)
    assert out.columns == [*frame.columns, "dedup_runs"]
    assert sorted(r.n_chars for r in out.collect()) == sorted(r.n_chars for r in frame.collect())


def test_merged_transforms_find_what_sorting_finds():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, rng.integers(1, 60), dtype=np.uint8)) for _ in range(40)] + [b"abab" * 9] * 3
    depth = 6
    shards = []
    for k in range(0, len(strings), 9):
        some = strings[k : k + 9]
        ends = np.cumsum([len(s) + 1 for s in some]) - 1
        symbols = np.full(int(ends[-1]) + 1, 256, np.uint16)
        for e, s in zip(ends, some):
            symbols[e - len(s) : e] = np.frombuffer(s, np.uint8)
        shards.append((symbols, ends))
    (shard, at), interval = bwt.repeats(shards, depth)
    found = {}
    for s, a, i in zip(shard, at, interval):
        found.setdefault(int(i), set()).add((int(s), int(a)))
    want = {}
    for s, (symbols, ends) in enumerate(shards):
        for a in range(len(symbols)):
            x = symbols[a : a + depth]
            if len(x) == depth and 256 not in x:
                want.setdefault(x.tobytes(), set()).add((s, a))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("depth", [1, 2, 7, 9, 16])
def test_merge_of_transforms_by_brute_force(depth):
    rng = np.random.default_rng(depth)
    for _ in range(30):
        texts = [rng.integers(0, rng.choice([1, 2, 256]), rng.integers(0, 40)).tolist() for _ in range(6)]
        texts += [x[: rng.integers(0, len(x) + 1)] for x in texts]
        shards, want = [], {}
        for k in range(0, 12, 5):
            symbols = np.array([c for x in texts[k : k + 5] for c in (*x, 256)], np.uint16)
            for i in range(len(symbols) - depth):
                if 256 not in symbols[i : i + depth]:
                    want.setdefault(tuple(symbols[i : i + depth].tolist()), set()).add((k // 5, i))
            shards.append((symbols, np.flatnonzero(symbols == 256)))
        (shard, at), interval = bwt.repeats(shards, depth)
        got = {}
        for k, i, n in zip(shard.tolist(), at.tolist(), interval.tolist(), strict=True):
            got.setdefault(n, set()).add((k, i))
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_merge_takes_two_symbols_a_round(monkeypatch):
    sorts, sort = [], np.argsort
    monkeypatch.setattr(bwt.np, "argsort", lambda *a, **b: sorts.append(1) or sort(*a, **b))
    symbols = np.array([*range(200), 256] * 2, np.uint16)
    (_, at), _ = bwt.repeats([(symbols, np.flatnonzero(symbols == 256))], 100)
    assert sorted(at.tolist()) == [*range(101), *range(201, 302)]
    assert len(sorts) <= 60


def test_blocks_are_hashed_once_a_slice(spark):
    asked = spark.sparkContext.accumulator(0)

    def tokens(data, offsets):
        t = suffix_dedup.byte_tokens(data, offsets)
        return repeats.Tokens(t.before, lambda a, b, seed: asked.add(1) or t.hash(a, b, seed))

    docs = spark.createDataFrame([(1, "a" * 300), (2, "b" * 300)], "doc_id long, text string").coalesce(1)
    repeats.live_blocks(docs, repeats.Scheme(tokens, 100, 40, False, 8))
    assert asked.value == 1


def stretches_of(strings):
    n = len(strings)
    ids = {"doc_id": pa.array(range(n), pa.int64()), "th": pa.array(range(n), pa.int64()), "start": pa.array([7] * n, pa.int64())}
    return pa.table(ids | {"content": pa.array(strings, pa.binary()), "crowded": pa.array([False] * n)})


def test_merge_gives_runs_and_not_windows():
    common = bytes(range(32, 192))
    got = suffix_dedup._merge(100)(stretches_of([b"x" + common, b"y" + common, bytes(range(150))[::-1]])).to_pylist()
    assert [(r["doc_id"], r["start"], r["stop"]) for r in got] == [(1, 8, 168)]


def test_only_first_stretches_are_fetched(spark, monkeypatch):
    """Copies of a stretch stay where they are when an anchor's different stretches are compared."""
    rng = np.random.default_rng(5)
    common = "".join(map(chr, rng.integers(97, 123, 130)))
    texts = ["a" * 30 + common + "b" * 30, "c" * 30 + common + "d" * 30]
    docs = spark.createDataFrame([(i, texts[i % 2]) for i in range(200)], "doc_id long, text string")
    found, contents = [], repeats.contents
    monkeypatch.setattr(repeats, "contents", lambda *a: found.append(contents(*a)) or found[0])
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert removed == {0: 0, 1: 130} | dict.fromkeys(range(2, 200), 190)
    assert found[0].count() <= 40


def test_crowded_anchors_are_dealt_and_meet(spark, monkeypatch):
    """One passage in many different surroundings: exact over groups, and no join by content."""
    monkeypatch.setattr(suffix_dedup, "CROWDED", 8)
    monkeypatch.setattr(suffix_dedup, "GROUP", 1 << 11)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    common = word(110)
    docs = [(i, word(60) + common[: 110 - i % 7] + word(60)) for i in range(120)]
    plans, written = [], suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: plans.append(df._jdf.queryExecution().analyzed().toString()) or written(df, name))
    windows = lambda t: [(i, i + 100, t[i : i + 100]) for i in range(len(t) - 99)]
    got = {r.doc_id: (r.n_removed, r.kept) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t, covered in later(docs, windows):
        assert got[d] == (len(covered), "".join(c for i, c in enumerate(t) if i not in covered).encode()), d
    assert len(plans) == 2 and not any("Generate" in p for p in plans)
