import hashlib
import re
import zlib

import numpy as np
import pytest
from brute import FOLD, WORD
from pyspark.sql import functions as F

from sievework.llm import decontaminate, jaccard_join, langid, mixing, quality, toxicity

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 40])
def test_decontaminate(spark, frame, corpus, block):
    items = [(1, corpus[5][1][:200]), (2, corpus[70][1][10:120]), (10, "One, TWO three; four"), (3, "a b"), (4, None), (5, "..."), (None, corpus[6][1][:90]), (2, corpus[8][1][:80])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = ITEM.findall((t or "").translate(FOLD))
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add(i)
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame, bench, block_bytes=block).collect()}
    digests = {r.doc_id: r for r in decontaminate.digest(decontaminate.decontaminate(frame, bench, block_bytes=block)).collect()}
    for d, t in corpus:
        w = ITEM.findall((t or "").translate(FOLD))
        hit, ids = set(), set()
        for p in range(len(w)):
            for n in {len(k) for k in windows}:
                if p + n <= len(w) and tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    ids |= windows[tuple(w[p : p + n])] - {None}
        assert (got[d].n_words, sorted(hit), sorted(ids, key=str)) == (len(w), sorted(got[d].word_hits), got[d].item_ids), d
        x = digests[d]
        assert (x.n_hit, x.n_items, x.items_sha256, x.contaminated) == (len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))
        assert sum(len(ITEM.findall(t[s.start : s.end].translate(FOLD))) for s in got[d].spans) == len(hit)
    kept = decontaminate.clean(frame, bench, block_bytes=block)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d in got if not got[d].word_hits}


def test_runs_do_not_depend_on_blocks(spark):
    """Runs of different blocks that overlap or touch are one, as within one block."""
    words = [f"wörd{i}" for i in range(120)]
    items = [(i, " ".join(words[k : k + 12])) for i, k in enumerate(range(0, 36, 6))] + [(50 + i, " ".join(words[k : k + 3])) for i, k in enumerate(range(60, 90, 3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, ", ".join(words)), (2, "none of these"), (3, ", ".join(words[20:75]))], "doc_id long, text string")
    one, many = ({r.doc_id: (r.word_hits, r.spans, r.words) for r in decontaminate.decontaminate(docs, bench, block_bytes=x).collect()} for x in (decontaminate.BLOCK_BYTES, 40))
    assert [tuple(x) for x in one[1][2]] == [(0, 42), (60, 90)]
    assert one == many


def test_decontaminate_edges(spark, empty, odd, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty, none).count() == 0
    assert decontaminate.digest(decontaminate.decontaminate(frame, none)).where("contaminated").count() == 0
    one = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.digest(decontaminate.decontaminate(odd, one)).collect()].count(3) == 2


def sets(corpus, k):
    out = {}
    for d, t in corpus:
        w = WORD.findall((t or "").translate(FOLD))
        out[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


@pytest.mark.parametrize("k,similar,long", [(4, (85, 100), 32), (5, (80, 100), 32), (1, (60, 100), 4), (4, (85, 100), 2)])
def test_jaccard_join(frame, corpus, k, similar, long, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LONG", long)
    s = sets(corpus, k)
    root = {d: d for d in s}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and similar[1] * len(s[a] & s[b]) >= similar[0] * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame, k, similar).collect()}
    assert got == {d: (len(s[d]), find(d)) for d in s}


def test_light_sets_meet():
    """Any two small sets that are similar have a subset key in common."""
    rng = np.random.default_rng(1)
    for t in ((85, 100), (80, 100), (60, 100)):
        most = 8 if t[0] == 60 else 12
        for _ in range(200):
            n = int(rng.integers(1, most))
            a = rng.choice(1000, n, replace=False).astype(np.uint64)
            b = np.unique(np.concatenate((a[rng.random(n) < 0.9], rng.choice(1000, int(rng.integers(0, 3))).astype(np.uint64))))
            if len(b) and len(b) <= most and t[1] * len(np.intersect1d(a, b)) >= t[0] * len(np.union1d(a, b)):
                keys = [set(np.concatenate([k.ravel() for k in jaccard_join._light(np.sort(x)[None, :], t)]).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]


def test_jaccard_edges(empty, odd, spark):
    assert jaccard_join.near_duplicates(empty).count() == 0
    got = sorted(jaccard_join.near_duplicates(odd).select("doc_id", "n_shingles", "component_id").collect(), key=str)
    assert len(got) == 8
    assert jaccard_join.deduplicate(empty).count() == 0
    kept = jaccard_join.deduplicate(odd).collect()
    assert sorted(str(r.text) for r in kept) == ["", "None", "None", "a b c d e f g h", "other words here", "x y z"]


def test_deduplicate_keeps_one_of_each(frame, corpus):
    found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(frame).collect()}
    kept = jaccard_join.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values()))


def test_mixing(spark, frame, odd, empty):
    out = mixing.mix_sources(frame)
    assert out.columns[: len(frame.columns)] == frame.columns
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_sources(odd).count() == 8
    docs = [(i, " ".join(["w"] * (i % 5 + 1)), None, f"s{min(i, 399) // 100 if i < 400 else 9}", 0) for i in range(3000)]
    df = spark.createDataFrame(docs, frame.select("doc_id", "text", "lang", "source", "n_chars").schema)
    rows = mixing.mix_sources(df, entropy=0.9, repeats=3).collect()
    tokens = {}
    for r in rows:
        tokens[r.source] = tokens.get(r.source, 0) + r.mix_tokens
    total = sum(i % 5 + 1 for i in range(3000))
    weight = {r.source: r.mix_weight for r in rows}
    assert abs(sum(weight.values()) - 1) < 1e-9 and weight["s9"] < 2600 / 3000
    for s, w in weight.items():
        assert w * total * 0.97 - 10 <= tokens[s] <= w * total + 1
    assert max(r.mix_epoch for r in rows) <= 3
    # the small sources repeat as often as they may, which keeps the entropy below its target
    assert max(weight[s] * total / sum(i % 5 + 1 for i, _, _, source, _ in docs if source == s) for s in weight) == pytest.approx(3, rel=1e-3)
    p = np.array(list({r.source: r.mix_weight for r in mixing.mix_sources(df, entropy=0.9, repeats=100).collect()}.values()))
    assert -(p * np.log(p)).sum() == pytest.approx(0.9 * np.log(len(p)), abs=1e-3)


SYLLABLES = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["ße", "än", "öt", "ud"]}


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    rng = random.Random(9)
    rows, labels = [], []
    for i in range(700):
        lang = rng.choice(["xx", "yy"])
        word = lambda: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))  # noqa: B023, E731
        words = [word() for _ in range(rng.randint(5, 150))]
        toxic, junk = rng.random() < 0.25, rng.random() < 0.25
        if junk:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "schuft"]))
        rows.append((i, " ".join(words), lang if i % 11 else None, "s", 0))
        labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def held(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language(labelled, empty, odd, spark):
    docs, _, _ = labelled
    train = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = langid.fit(train)
    langs = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    mine = [i for i in langs if held(i, 3) == 1 and langs[i]]
    assert np.mean([got[i][0] == langs[i] for i in mine]) > 0.97
    assert all(0 <= s <= 1 for _, s in got.values())
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "ka𝒳")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(blank, model).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    assert langid.predict(odd, model).count() == 8


def test_quality(labelled, empty, odd):
    docs, labels, truth = labelled
    model = quality.fit(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, model).collect()}
    mine = [i for i in truth if held(i, 5) == 0]
    assert np.mean([got[i][1] == truth[i][0] for i in mine]) > 0.95
    assert all(0 <= s <= 1 for s, _ in got.values())
    again = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs.repartition(2), labels)).collect()}
    assert max(abs(again[i] - got[i][0]) for i in got) < 1e-6
    assert quality.score(odd, model).count() == 8
    assert {r.score for r in quality.score(odd, quality.fit(empty, labels)).collect()} <= {0.5}


def test_toxicity(labelled, empty, odd):
    docs, labels, truth = labelled
    net = toxicity.fit(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, net).collect()}
    mine = [i for i in truth if held(i, 5) == 0]
    assert np.mean([got[i][1] == truth[i][1] for i in mine]) > 0.95
    assert all(0 <= s <= 1 for s, _ in got.values())
    kept = toxicity.reject(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i][1]}
    assert toxicity.score(odd, net).count() == 8
    assert toxicity.score(docs, toxicity.fit(empty, labels)).where("predicted = 1").count() == 0


def test_windows_cover_all_words():
    before = np.cumsum([0, 0, 1, 31, 32, 33, 48, 49, 500])
    row, first, length = toxicity.windows(before)
    for r in range(len(before) - 1):
        seen = set()
        for a, n in zip(first[row == r], length[row == r]):
            seen |= set(range(a, a + n))
        assert seen == set(range(before[r], before[r + 1]))


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.arange(5, dtype=np.uint64))
    for k, v in net.p.items():
        net.p[k] = rng.normal(0, 0.5, v.shape)
    number, grams, at = np.array([0, 1, 5, 3]), np.array([1, 2, 3, 4, 2, 9]), np.array([0, 2, 3, 5])
    ids = rng.integers(0, 4, (6, 3))
    mask = np.arange(6)[:, None] < np.array([6, 3, 1])
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        logit = net.forward(net.gates(net.inputs(number, grams, at).astype(np.float64)), ids, mask)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    g = net.gradient(number, grams, at, ids, mask, y)
    for k in net.p:
        flat, gf = net.p[k].reshape(-1), g[k].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - gf[i]) < 2e-3, (k, i)


def plain_grams(text):
    """N-grams of a text as they are described, one by one."""
    low = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    low = re.sub(" +", " ", low).lstrip(" ")
    return [low[i : i + n] for n in langid.LENGTHS for i in range(len(low) - n + 1) if n > 1 or low[i] != " "]


def test_language_against_counting(labelled):
    """Counts and log sums one n-gram at a time give the same posteriors."""
    docs, _, _ = labelled
    rows = [(r.doc_id, r.text, r.lang) for r in docs.limit(150).collect()]
    spark = docs.sparkSession
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    bucket = {}

    def code(g):
        if g not in bucket:
            h = 0
            for k, c in enumerate(g):
                h = ((h + ord(c)) * int(langid._STEPS[k])) & 0xFFFFFFFF
                h ^= h >> 15
            bucket[g] = ((h + len(g)) * int(langid._STEPS[0]) & 0xFFFFFFFF) >> 17
        return bucket[g]

    counts, prior = {}, {}
    for _, text, lang in rows:
        if lang:
            prior[lang] = prior.get(lang, 0) + 1
            for g in plain_grams(text):
                counts.setdefault(lang, {}).setdefault(code(g), 0)
                counts[lang][code(g)] += 1
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    for d, text, _ in rows[:40]:
        logs = {}
        for lang, c in counts.items():
            total = sum(c.values()) + langid.SMOOTHING * langid.BUCKETS
            logs[lang] = np.log(prior[lang] / sum(prior.values())) + sum(np.log((c.get(code(g), 0) + langid.SMOOTHING) / total) for g in plain_grams(text))
        best = max(logs, key=logs.get)
        assert got[d][0] == best
        assert got[d][1] == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), abs=1e-3)


def test_word_vectors_against_counting(spark, frame, corpus):
    """Neighbours added up one by one, and means and spreads over a text's words, are what the operator gives."""
    place, sign = quality.index_vectors()
    bucket = lambda w: int((quality.Prefix(np.frombuffer(w, np.uint8), 5)(np.array([0]), np.array([len(w)])) >> np.uint64(64 - quality.BITS))[0])
    token = re.compile(rb"[0-9a-zA-Z\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]")
    texts = [(t or "").encode() for _, t in corpus[:60]]
    words = [[bucket(w) for w in token.findall(t)] for t in texts]
    sums = {}
    for ws in words:
        for i, w in enumerate(ws):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ws):
                    v = sums.setdefault(w, np.zeros(quality.SIZE))
                    for p, x in zip(place[ws[j]], sign[ws[j]]):
                        v[p] += x
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)

    def vector(w):
        own = np.zeros(quality.SIZE)
        for p, x in zip(place[w], sign[w]):
            own[p] += x
        return unit(unit(sums.get(w, np.zeros(quality.SIZE))) + unit(own))

    got = quality.word_vectors(frame.where("doc_id < 60"))
    for w in list(sums)[:200]:
        assert np.allclose(got[w], vector(w), atol=1e-5)
    offsets = np.cumsum([0, *map(len, texts)])
    x = quality.pooled(np.frombuffer(b"".join(texts), np.uint8), offsets, got)
    for k, ws in enumerate(words):
        v = np.array([got[w] for w in ws]) if ws else np.zeros((1, quality.SIZE))
        assert np.allclose(x[k], np.concatenate((v.mean(0), v.std(0))), atol=2e-3), k


def test_forward_pass_against_one_step_at_a_time():
    rng = np.random.default_rng(2)
    net = toxicity.Network(np.arange(9, dtype=np.uint64))
    for k, v in net.p.items():
        net.p[k] = rng.normal(0, 0.7, v.shape)
    x, ids = rng.normal(0, 1, (6, toxicity.WORD_SIZE + toxicity.CHAR_SIZE)), rng.integers(0, 6, (7, 4))
    mask = np.arange(7)[:, None] < np.array([7, 5, 1, 3])
    logit, h = net.forward(net.gates(x), ids, mask), toxicity.HIDDEN
    for n in range(4):
        states = {}
        for side, steps in (("f", range(7)), ("b", range(6, -1, -1))):
            s = np.zeros(h)
            for t in steps:
                if mask[t, n]:
                    g, u = x[ids[t, n]] @ net.p[f"x{side}"] + net.p[f"c{side}"], s @ net.p[f"u{side}"]
                    r, z = 1 / (1 + np.exp(-(g[:h] + u[:h]))), 1 / (1 + np.exp(-(g[h : 2 * h] + u[h : 2 * h])))
                    s = (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :]) + z * s
                states.setdefault(t, {})[side] = s
        both = [np.concatenate((states[t]["f"], states[t]["b"])) for t in range(7) if mask[t, n]]
        e = np.exp([b @ net.p["attend"] for b in both])
        assert logit[n] == pytest.approx(sum(a * b for a, b in zip(e / e.sum(), both)) @ net.p["out"] + net.p["bias"][0], abs=1e-4)


def test_part_epochs_leave_giants_aside(spark):
    """A text larger than what is left of its source's budget does not shut out those after it."""
    rows = [(0, " ".join(["w"] * 5000), "s0")] + [(i, "a b c d e", "s0") for i in range(1, 100)] + [(1000 + i, "x " * 50, "s1") for i in range(40)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), budget=0.3).collect()
    mine = [r for r in got if r.source == "s0"]
    assert 0 not in {r.doc_id for r in mine} and len(mine) == 99


def test_clashing_names(spark):
    """Columns of the caller that are named like helper columns come through as they are."""
    from sievework.llm import line_dedup

    docs = [(1, "a\nb\nc\nd e f g h", 7, 8), (2, "a\nb\nc\nx", 9, 10), (3, "a\nb\nc\nd e f g h", 11, 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, th long, gone_th long").withColumns({c: F.lit(5) for c in ("gone_id", "dedup_th", "dedup_id", "near_t", "near_th", "mark", "mixed")}).withColumn("source", F.lit("s"))
    one = line_dedup.line_dedup(df)
    assert one.columns == [*df.columns, "dedup_runs"] and {r.doc_id: (r.th, r.gone_th, r.near_th) for r in one.collect()} == {1: (7, 8, 5), 2: (9, 10, 5), 3: (11, 12, 5)}
    two = jaccard_join.deduplicate(df)
    assert two.columns == df.columns and {r.doc_id: (r.th, r.gone_th) for r in two.collect()} == {1: (7, 8), 2: (9, 10)}
    three = mixing.mix_sources(df)
    assert {r.doc_id: (r.th, r.gone_th, r.mark) for r in three.collect()} == {1: (7, 8, 5), 2: (9, 10, 5), 3: (11, 12, 5)}
