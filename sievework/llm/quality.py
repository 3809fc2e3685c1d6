"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy with
temperature-calibrated probabilities.

A document is the mean of its words' vectors and their spread about it; nothing else is an input."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Prefix, map_slices, mix, remainder, slices, table, tree_sum

#: Hashed vocabulary, size of a vector, entries of an index vector, words on either side that count as context.
BITS = 16
VOCABULARY = 1 << BITS
SIZE = 48
ENTRIES = 4
GAPS = (1, 2)
#: The network learns from at most so many labelled rows, those of the least hashes (documented bound; 16 MB of vectors).
MOST_ROWS = 40_000
HIDDEN = 32
#: Epochs at most, and epochs without a lower loss on the rows held back after which training ends.
EPOCHS, PATIENCE = 60, 12
#: Token kinds: letters and digits, and punctuation mark by mark.
_KIND = np.zeros(256, np.uint8)
_KIND[0x30:0x3A] = _KIND[0x61:0x7B] = _KIND[0x41:0x5B] = _KIND[0x80:] = 1
_KIND[0x21:0x30] = _KIND[0x3A:0x41] = _KIND[0x5B:0x61] = _KIND[0x7B:0x7F] = 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens (runs of letters and digits; single punctuation marks), and the tokens before each row."""
    n = len(data)
    kind = _KIND[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = first[:-1] | (kind == 2)
    begin[1:] |= kind[1:] != kind[:-1]
    begin &= kind > 0
    starts = np.flatnonzero(begin)
    stop = np.flatnonzero(np.concatenate(((kind[1:] != kind[:-1]) | (kind[1:] == 2) | first[1:-1], [True]))) if n else np.zeros(0, np.int64)
    ends = stop[kind[stop] > 0] + 1
    return (Prefix(data, 5)(starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Sparse random index vectors: for each bucket, from its number, the places of ENTRIES entries and their signs."""
    h = mix(np.arange(VOCABULARY * ENTRIES, dtype=np.uint64)).reshape(VOCABULARY, ENTRIES)
    return ((h >> np.uint64(8)) % np.uint64(SIZE)).astype(np.int64), np.where(h & np.uint64(1), 1.0, -1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """VOCABULARY x SIZE: for each word the sum of its neighbours' index vectors over all documents, scaled to length 1, and
    its own added. Each task adds up whole numbers, and the tasks' sums are added block by block of rows, so that the result
    does not depend on the order. Its size is fixed."""
    step = 256

    def run(batches):
        place, sign = index_vectors()
        sums = np.zeros(VOCABULARY * SIZE)
        for batch in batches:
            for _, data, offsets in slices(batch):
                ids, before = tokens(data, offsets)
                row = np.repeat(np.arange(len(before) - 1), np.diff(before))
                for gap in GAPS:
                    same = row[gap:] == row[:-gap]
                    a, b = ids[:-gap][same], ids[gap:][same]
                    for x, y in ((a, b), (b, a)):
                        for k in range(ENTRIES):
                            np.add.at(sums, x * SIZE + place[y, k], sign[y, k])
        sums = sums.reshape(VOCABULARY, SIZE)
        for k in range(0, VOCABULARY, step):
            if sums[k : k + step].any():
                yield table(block=np.array([k], np.int64), sums=pa.array([sums[k : k + step].astype("<f8").tobytes()], pa.binary()))

    got = tree_sum(docs.select("text").mapInArrow(run, "block long, sums binary"), "block", "<f8").collect()  # 25 MB, whatever the input
    out = np.zeros((VOCABULARY, SIZE))
    for r in got:
        out[r.block : r.block + step] = np.frombuffer(r.sums, "<f8").reshape(step, -1)
    place, sign = index_vectors()
    own = np.zeros((VOCABULARY, SIZE))
    for k in range(ENTRIES):
        np.add.at(own, (np.arange(VOCABULARY), place[:, k]), sign[:, k])
    return _unit(_unit(out) + _unit(own)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each row's word vectors. A row without tokens is all zero."""
    ids, before = tokens(data, offsets)
    rows = len(offsets) - 1
    out = np.zeros((rows, 2 * SIZE), np.float32)
    if not len(ids):
        return out
    # a row's distinct words first, so that fewer vectors are gathered
    of = np.repeat(np.arange(rows), np.diff(before))
    pair = np.sort(of << BITS | ids)
    begin = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    count = np.diff(np.append(begin, len(pair)))
    pair = pair[begin]
    row = pair >> BITS
    w = vectors[pair & (VOCABULARY - 1)]
    share = (count / np.diff(before)[row])[:, None].astype(np.float32)
    at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    mean = np.add.reduceat(w * share, at)
    out[row[at], :SIZE] = mean
    out[row[at], SIZE:] = np.sqrt(np.maximum(np.add.reduceat(w * w * share, at) - mean * mean, 0))
    return out


class Net:
    """Two layers, tanh between, trained by Adam on the log loss. A fifth of the rows is held back: training ends where their
    loss is least, and the temperature is the one that suits them best."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        some = x if len(x) else np.zeros((1, x.shape[1]))
        self.mean, self.scale = some.mean(0), some.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        back = np.arange(len(x)) % 5 == 0
        tx, ty = (x[~back], y[~back]) if (~back).any() else (x, y)
        shapes = ((x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, 1), (1,))
        self.w = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
        rate = np.clip(ty.mean() if len(ty) else 0.5, 0.01, 0.99)
        self.w[3][:] = np.log(rate / (1 - rate))
        self.temperature = 1.0
        if len(set(y)) < 2:  # nothing to tell apart: every text gets the rate of its one class, or 0.5
            self.w[2][:] = 0
            return
        m, v, t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        best, kept, since = np.inf, self.w, 0
        bx, by = (x[back], y[back]) if back.any() else (tx, ty)
        for _ in range(EPOCHS if len(tx) else 0):
            order = rng.permutation(len(tx))
            for k in range(0, len(order), 128):
                b = order[k : k + 128]
                h = np.tanh(tx[b] @ self.w[0] + self.w[1])
                d = ((1 / (1 + np.exp(-(h @ self.w[2] + self.w[3])[:, 0])) - ty[b]) / len(b))[:, None]
                dh = d @ self.w[2].T * (1 - h * h)
                t += 1
                for i, g in enumerate((tx[b].T @ dh + 1e-3 * self.w[0], dh.sum(0), h.T @ d + 1e-3 * self.w[2], d.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.004 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            z = self.logit(bx, scaled=True)
            loss = np.mean(np.logaddexp(0, np.where(by > 0, -z, z)))
            best, kept, since = (loss, self.w[:], 0) if loss < best else (best, kept, since + 1)
            if since >= PATIENCE:
                break
        self.w = kept
        z = self.logit(bx, scaled=True)
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        self.temperature = float(grid[int(np.argmin([np.mean(np.logaddexp(0, np.where(by > 0, -z, z) / g)) for g in grid]))])

    def logit(self, x: np.ndarray, scaled: bool = False) -> np.ndarray:
        x = x if scaled else (x - self.mean) / self.scale
        return (np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])[:, 0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[np.ndarray, Net]:
    """Word vectors from all documents, and a network from at most most_rows labelled ones (doc_id, quality) whose
    remainder (crc32 of doc_id, modulo 5) is not 0; of several texts or labels of one doc_id one is kept (by hash). Without labelled rows every score is 0.5, with
    one class only every score is 0.99 or 0.01."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # most_rows small rows at most

    def run(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        x = pooled(data, offsets, shared.value)
        return table(doc_id=part.column("doc_id"), quality=part.column("quality").cast(pa.int64()), th=part.column("th"), x=pa.array([r.astype("<f4").tobytes() for r in x], pa.binary()))

    made = map_slices(rows.select("doc_id", "quality", F.xxhash64("text").alias("th"), "text"), run, "doc_id long, quality long, th long, x binary")
    got = made.groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), F.struct("th", "quality")).alias("r")).select("doc_id", "r.*").limit(most_rows).collect()
    got.sort(key=lambda r: r.doc_id)
    x = np.array([np.frombuffer(r.x, "<f4") for r in got], np.float64).reshape(-1, 2 * SIZE)
    return vectors, Net(x, np.array([r.quality for r in got], np.float64))


def score(docs: DataFrame, model: tuple[np.ndarray, Net], threshold: float = 0.3) -> DataFrame:
    """doc_id, score (probability of quality 1) and predicted for each row; null and empty texts are scored as texts
    without words. Repeated rows give repeated rows."""
    vectors, net = model
    shared = docs.sparkSession.sparkContext.broadcast((vectors, vars(net)))  # VOCABULARY x SIZE floats and the network: 13 MB

    def run(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        v, state = shared.value
        f = Net.__new__(Net)
        vars(f).update(state)
        return table(doc_id=part.column("doc_id").cast(pa.int64()), score=f(pooled(data, offsets, v).astype(np.float64)))

    out = map_slices(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
