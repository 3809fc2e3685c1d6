"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

Every text is scored through overlapping windows of words; a document's score is that of its worst window. Training has
document labels only, so each labelled document stands by its worst window, found anew in each epoch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Prefix, map_slices, mix, remainder, table, text_bytes, trim, words_of

#: Words in a window, and from one window's start to the next.
WINDOW = 32
STRIDE = 16
#: The network learns from at most so many labelled documents, those of the least hashes.
MOST_ROWS = 3_000
#: Longer texts, in bytes, are not learnt from (they are scored as all others are), so that the driver holds a bounded sample.
MOST_BYTES = 64 << 10
#: Known words at most, the most frequent; each needs so many training documents. Their vectors start at random. All other
#: words share one vector and are told apart by characters.
MOST_WORDS, LEAST_DOCUMENTS = 32_768, 5
#: In training, known words are taken for unknown ones so often, that characters learn to tell too; weights are averaged over
#: the last hundred or so steps.
FORGET, AVERAGE = 0.5, 0.01
#: Decay of vectors towards zero in each step of training, in learning rates; without it few documents are learnt by heart.
DECAY = {"word": 0.3, "char": 0.05}
WORD_SIZE, CHAR_SIZE, HIDDEN, CHAR_BUCKETS = 8, 4, 8, 2048
#: Times that the worst windows are found anew, and steps of training at least, however few documents there are.
EPOCHS, STEPS = 12, 840
CHUNK, TRAIN_CHUNK = 4096, 1024
#: Lower case for A-Z; other bytes stay. Words are runs of ASCII letters and of bytes of characters beyond ASCII.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
IS_LETTER = np.zeros(256, bool)
IS_LETTER[0x41:0x5B] = IS_LETTER[0x61:0x7B] = IS_LETTER[0x80:] = True


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Distinct words (hash, and one place), the number of each word in text order, and the words before each row."""
    low = FOLD[data]
    starts, ends, before = words_of(low, offsets, IS_LETTER)
    hashes = Prefix(low, 10)(starts, ends)
    found, place, number = np.unique(hashes, return_index=True, return_inverse=True)
    return low, found, starts[place], ends[place], number, before


def trigrams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of each word, with a space before and after it, and where each word's begin."""
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths)))
    place = np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)
    here = low[place].astype(np.uint64)
    last = np.empty_like(here)
    last[1:], last[at[:-1]] = here[:-1], 32
    after = np.empty_like(here)
    after[:-1], after[at[1:] - 1] = here[1:], 32
    return (mix(last << np.uint64(16) | here << np.uint64(8) | after) >> np.uint64(53)).astype(np.int16), at[:-1]


def windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and number of words of every window: one each STRIDE words; the last one ends with its text."""
    n = np.diff(before)
    count = np.where(n == 0, 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * STRIDE, np.maximum(n[row] - WINDOW, 0))
    return row, before[row] + start, np.minimum(n[row], WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tanh(x: np.ndarray) -> np.ndarray:
    return 2 * sigmoid(2 * x) - 1


class Network:
    """Parameters by name; words is the sorted array of known words' hashes."""

    def __init__(self, words: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        d, h = WORD_SIZE + CHAR_SIZE, HIDDEN
        r = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.words = words
        self.p = {"word": rng.normal(0, 0.02, (len(words) + 1, WORD_SIZE)).astype(np.float32), "char": rng.normal(0, 0.1, (CHAR_BUCKETS, CHAR_SIZE)).astype(np.float32)}
        self.p["word"][-1] = 0
        for side in "fb":
            self.p |= {f"x{side}": r(d, 3 * h), f"u{side}": r(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"attend": r(2 * h), "out": r(2 * h), "bias": np.full(1, -2, np.float32)}

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))

    def inputs(self, number: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        chars = np.add.reduceat(self.p["char"][grams], at) / np.diff(np.append(at, len(grams)))[:, None]
        return np.concatenate((self.p["word"][number], chars.astype(np.float32)), 1)

    def forward(self, gates: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows; ids (steps x windows) number rows of the gates, the inputs' share of each gate."""
        steps, n, h = *ids.shape, HIDDEN
        states, caches = {}, {"f": [None] * steps, "b": [None] * steps}
        for side in "fb":
            u, state = self.p[f"u{side}"], np.zeros((n, h), np.float32)
            states[side] = np.empty((steps, n, h), np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                g, s = gates[side][ids[t]], state @ u
                rz = sigmoid(g[:, : 2 * h] + s[:, : 2 * h])
                r, z = rz[:, :h], rz[:, h:]
                c = tanh(g[:, 2 * h :] + r * s[:, 2 * h :])
                new = c + z * (state - c)
                if mask is not None:
                    new = np.where(mask[t][:, None], new, state)
                if keep:
                    caches[side][t] = (state, r, z, c, s[:, 2 * h :])
                state = states[side][t] = new
        both = np.concatenate((states["f"], states["b"]), 2)
        e = both @ self.p["attend"]
        if mask is not None:
            e = np.where(mask, e, -30)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * both).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, both, a, pooled, caches) if keep else logit

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: x @ self.p[f"x{s}"] + self.p[f"c{s}"] for s in "fb"}

    def gradient(self, number, grams, at, ids, mask, y) -> dict[str, np.ndarray]:
        x = self.inputs(number, grams, at)
        logit, both, a, pooled, caches = self.forward(self.gates(x), ids, mask, True)
        h, n = HIDDEN, len(y)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((sigmoid(logit) - y) / n).astype(np.float32)
        g["out"], g["bias"][0] = pooled.T @ d, d.sum()
        dp = d[:, None] * self.p["out"]
        da = (both * dp).sum(2)
        de = a * (da - (a * da).sum(0))
        g["attend"] = np.einsum("tnk,tn->k", both, de)
        dboth = a[:, :, None] * dp + de[:, :, None] * self.p["attend"]
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            u, back = self.p[f"u{side}"], np.zeros((n, h), np.float32)
            dg = np.zeros((len(x), 3 * h), np.float32)
            for t in range(len(ids) - 1, -1, -1) if side == "f" else range(len(ids)):
                state, r, z, c, sn = caches[side][t]
                whole = back + dboth[t, :, k * h : (k + 1) * h]
                new = np.where(mask[t][:, None], whole, 0)
                dc = new * (1 - z) * (1 - c * c)
                dz = new * (state - c) * z * (1 - z)
                dr = dc * sn * r * (1 - r)
                ds = np.concatenate((dr, dz, dc * r), 1)
                np.add.at(dg, ids[t], np.concatenate((dr, dz, dc), 1))
                g[f"u{side}"] += state.T @ ds
                back = np.where(mask[t][:, None], new * z + ds @ u.T, whole)
            g[f"x{side}"] = x.T @ dg
            g[f"c{side}"] = dg.sum(0)
            dx += dg @ self.p[f"x{side}"].T
        np.add.at(g["word"], number, dx[:, :WORD_SIZE])
        count = np.diff(np.append(at, len(grams)))
        np.add.at(g["char"], grams, np.repeat(dx[:, WORD_SIZE:] / count[:, None], count, axis=0))
        return g

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, row and first word of every window of every row."""
        low, found, starts, ends, number, before = distinct_words(data, offsets)
        row, first, length = windows(before)
        out = np.zeros(len(row), np.float32)
        if len(row):
            gates = self.gates(self.inputs(self.number(found), *trigrams(low, starts, ends)))
            full = np.flatnonzero(length == WINDOW)
            steps = np.arange(WINDOW)[:, None]
            for k in range(0, len(full), CHUNK):
                w = full[k : k + CHUNK]
                out[w] = self.forward(gates, number[first[w] + steps], None)
            short = np.flatnonzero(length < WINDOW)
            for k in range(0, len(short), CHUNK):
                w = short[k : k + CHUNK]
                inside = steps < length[w]
                out[w] = self.forward(gates, number[np.where(inside, first[w] + steps, first[w])], inside)
        return out, row, first - before[row]


def _read(texts: list[bytes]):
    """Distinct words of all texts with their trigrams, and the words' numbers, read some texts at a time."""
    held: list = []
    for k in range(0, len(texts), 256):
        some = texts[k : k + 256]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in some]))).astype(np.int64)
        low, found, starts, ends, number, before = distinct_words(np.frombuffer(b"".join(some), np.uint8), offsets)
        held.append((found, *trigrams(low, starts, ends), number.astype(np.int32), np.diff(before)))
    none = np.zeros(0, np.int32)
    join = lambda xs: np.concatenate(list(xs) or [none])
    found, place, inverse = np.unique(join(h[0] for h in held), return_index=True, return_inverse=True)
    grams, shift = join(h[1] for h in held), np.cumsum([0, *(len(h[1]) for h in held)])
    at = join(h[2] + s for h, s in zip(held, shift, strict=False))
    count = np.diff(np.append(at, len(grams)))
    words = np.cumsum([0, *(len(h[0]) for h in held)])
    number = inverse.astype(np.int32)[join(h[3] + np.int32(w) for h, w in zip(held, words, strict=False))]
    at, count = at[place], count[place]
    grams = grams[np.repeat(at - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())] if len(at) else none
    return found, grams, np.cumsum(count) - count, count, number, np.concatenate(([0], np.cumsum(join(h[4] for h in held)))).astype(np.int64)


def _train(texts: list[bytes], y: np.ndarray) -> Network:
    rows = len(texts)
    found, grams, at, count, number, before = _read(texts)
    rate = y.mean() if rows else 0.0
    df, toxic = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    for k in range(rows):  # the distinct words of one document at a time
        mine = np.unique(number[before[k] : before[k + 1]])
        df[mine] += 1
        toxic[mine] += y[k] > 0
    known = np.flatnonzero(df >= LEAST_DOCUMENTS)
    if len(known) > MOST_WORDS:
        known = np.sort(known[np.argsort(-df[known], kind="stable")[:MOST_WORDS]])
    net = Network(found[known])
    row, first, length = windows(before)
    if not len(row) or rate in (0.0, 1.0):
        net.p["out"][:], net.p["bias"][0] = 0, 6.0 if rate == 1 else -6.0
        return net
    mine = net.number(found)
    rng = np.random.default_rng(5)
    # at first a document stands by the window with the word that is most often in toxic ones; the network sees none of this
    often = np.where(df >= LEAST_DOCUMENTS, (toxic - df * rate) / np.sqrt(df * rate + 1), 0)
    score = np.maximum.reduceat(np.append(often[number], 0), np.stack([first, first + length], 1).ravel())[::2]
    mean: dict[str, np.ndarray] = {}
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    batches = -(-2 * len(np.unique(row)) // 128)
    turns = -(-max(EPOCHS * batches, STEPS) // batches)
    for turn in range(turns):
        if turn and turn % max(1, turns // EPOCHS) == 0:
            gates = net.gates(net.inputs(mine, grams, at))
            steps = np.arange(WINDOW)[:, None]
            score = np.zeros(len(row), np.float32)
            for k in range(0, len(row), TRAIN_CHUNK):
                w = slice(k, k + TRAIN_CHUNK)
                inside = steps < length[w]
                score[w] = net.forward(gates, number[np.where(inside, first[w] + steps, first[w])], inside)
        order = np.lexsort((-score, row))
        top = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))]
        chosen = np.concatenate((top, rng.choice(np.flatnonzero(y[row] == 0), len(top))))
        rng.shuffle(chosen)
        for k in range(0, len(chosen), 128):
            w = chosen[k : k + 128]
            inside = np.arange(WINDOW)[:, None] < length[w]
            ids, local = np.unique(number[np.where(inside, first[w] + np.arange(WINDOW)[:, None], first[w])], return_inverse=True)
            c = count[ids]
            begin = np.concatenate(([0], np.cumsum(c)[:-1]))
            some = grams[np.arange(c.sum()) + np.repeat(at[ids] - begin, c)]
            step += 1
            for name, g in net.gradient(np.where(rng.random(len(ids)) < FORGET, len(known), mine[ids]), some, begin, local.reshape(WINDOW, -1), inside, y[row[w]]).items():
                if name == "word":
                    g[-1] = 0
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                net.p[name] -= 0.01 * (m[name] / (1 - 0.9**step) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6) + DECAY.get(name, 0.01) * net.p[name])
                if name in mean:
                    mean[name] += np.float32(AVERAGE) * (net.p[name] - mean[name])
                else:
                    mean[name] = net.p[name].copy()
    net.p = mean
    return net


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Network:
    """A network from at most most_rows labelled documents (doc_id, toxic) of most_bytes at most whose remainder (crc32 of
    doc_id, modulo 5) is not 0; of equal texts, and of texts of one doc_id, one is kept (by hash). Null texts are empty ones.
    Without labelled rows, or with none that is toxic, nothing is toxic."""
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most_rows)
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    rows = rows.join(F.broadcast(sample), "doc_id")  # most_rows small rows at most
    got = rows.orderBy("doc_id", F.xxhash64("text"), "toxic").limit(most_rows).toArrow()
    data, offsets = text_bytes(got.column("text"))
    ids = got.column("doc_id").to_numpy()
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    toxic = got.column("toxic").to_pylist()
    once: dict[bytes, float] = {}
    for k in first:
        once.setdefault(data[offsets[k] : offsets[k + 1]].tobytes(), toxic[k])
    del got, data
    net = _train(list(once), np.array(list(once.values()), np.float32))
    trim()
    return net


def _worst(state: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the worst window's probability and first word (0 and -1 without windows), and the number of windows."""
    net = Network.__new__(Network)
    vars(net).update(state)
    logit, row, first = net.logits(data, offsets)
    rows = len(offsets) - 1
    order = np.lexsort((first, -logit, row))
    at = np.flatnonzero(np.concatenate(([True], row[order][1:] != row[order][:-1]))) if len(row) else np.zeros(0, np.int64)
    top = order[at]
    p, word = np.zeros(rows), np.full(rows, -1, np.int64)
    p[row[top]], word[row[top]] = sigmoid(logit[top].astype(np.float64)), first[top]
    return p, word, np.bincount(row, minlength=rows)


def score(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (worst window's probability), predicted, windows, and the worst window's first word, for each row.

    Null and empty texts, and others without words, have no window and score 0. Repeated rows give repeated rows;
    other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(net))  # MOST_WORDS and CHAR_BUCKETS vectors: under 2 MB

    def run(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        p, word, windows_ = _worst(shared.value, data, offsets)
        return table(doc_id=part.column("doc_id").cast(pa.int64()), score=p, windows=windows_, worst_word=word)

    out = map_slices(docs.select("doc_id", "text"), run, "doc_id long, score double, windows long, worst_word long")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score less than the threshold. Null and empty texts, and others without
    words, score 0 and stay; repeated rows are treated alike."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(net))  # as in score()

    def run(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return part.filter(pa.array(_worst(shared.value, data, offsets)[0] < threshold))

    return map_slices(docs, run, docs.schema)
