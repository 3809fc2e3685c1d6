"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import map_slices, slices, table, text_bytes, tree_sum

#: Buckets of hashed n-grams, n-gram lengths, additive smoothing.
BUCKETS = 1 << 15
LENGTHS = (1, 2, 3)
SMOOTHING = 0.1
#: The log-probability matrix is languages x BUCKETS; at most so many languages, 64 MB, are broadcast. More is refused.
MOST_LANGUAGES = 500
_STEPS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_SHIFT = np.uint32(32 - 15)


def _letters() -> np.ndarray:
    """For every code point of the basic plane its lower case, 32 where it is no letter."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0]) if ord(low[0]) < 1 << 16 else c
    return out


_table: list = []


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows, the n-grams' row numbers, and the letters in each row.

    Letters in lower case; anything else is one space, and n-grams of spaces only do not count."""
    if not _table:
        _table.append(_letters())
    data, offsets = text_bytes(texts)
    lead = (data & 0xC0) != 0x80
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum(lead)))[offsets]
    rows = len(offsets) - 1
    if len(chars) != at[-1]:  # bytes that are no UTF-8
        texts_ = [data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        at = np.concatenate(([0], np.cumsum([len(t) // 4 for t in texts_])))
        chars = np.frombuffer(b"".join(texts_), np.uint32)
    low = _table[0][np.minimum(chars, 0xFFFF)]
    if len(beyond := np.flatnonzero(chars > 0xFFFF)):
        found, back = np.unique(chars[beyond], return_inverse=True)
        low[beyond] = np.array([c if chr(c).isalpha() else 32 for c in found.tolist()], np.uint32)[back]
    of = np.repeat(np.arange(rows), np.diff(at))
    letter = low != 32
    # one space between runs of letters, and around each text
    first = np.ones(len(low), bool)
    first[1:] = of[1:] != of[:-1]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:]
    low, of = low[keep], of[keep]
    n_letters = np.bincount(of, weights=low != 32, minlength=rows).astype(np.int64)
    codes, row = [], []
    for n in LENGTHS:
        if len(low) < n:
            continue
        h = np.zeros(len(low) - n + 1, np.uint32)
        for k in range(n):
            h = (h + low[k : len(low) - n + 1 + k]) * _STEPS[k]
            h ^= h >> np.uint32(15)
        h = (h + np.uint32(n)) * _STEPS[0]
        ok = of[: len(h)] == of[n - 1 :]
        if n == 1:
            ok &= low != 32
        codes.append((h >> _SHIFT)[ok].astype(np.int64))
        row.append(of[: len(h)][ok])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(codes or none), np.concatenate(row or none), n_letters


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix (languages x BUCKETS, log prior in a last column) from all rows
    (text, lang) with a lang. Each task sums its counts; the tasks' sums are added in a tree."""
    rows = labelled.select("text", "lang").where(F.col("lang").isNotNull())

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for part, _, _ in slices(batch, most=1 << 20):
                codes, row, _ = grams(part.column("text"))
                langs = part.column("lang").dictionary_encode()
                label = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                names = langs.dictionary.to_pylist()
                found = np.bincount(label[row] * BUCKETS + codes, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, counts, docs in zip(names, found, np.bincount(label, minlength=len(names)), strict=True):
                    mine = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    mine[:-1] += counts
                    mine[-1] += docs
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
        for name, counts in sums.items():
            yield table(lang=[name], sums=pa.array([counts.astype("<i8").tobytes()], pa.binary()))

    got = tree_sum(rows.mapInArrow(run, "lang string, sums binary"), "lang", "<i8").orderBy("lang").collect()
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.array([np.frombuffer(r.sums, "<i8") for r in got], np.float64).reshape(-1, BUCKETS + 1)
    counts, docs = counts[:, :-1] + SMOOTHING, counts[:, -1]
    matrix = np.log(counts / counts.sum(1, keepdims=True))
    prior = np.log(docs / max(docs.sum(), 1))
    return [r.lang for r in got], np.concatenate((matrix, prior[:, None]), 1).astype(np.float32)


def posteriors(texts: pa.Array, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each language for each row, and the letters in each row. Rows are summed as sparse counts in batches."""
    codes, row, letters = grams(texts)
    rows = len(texts)
    scores = np.tile(matrix[:, -1].astype(np.float64), (rows, 1))
    for k in range(matrix.shape[0]):
        scores[:, k] += np.bincount(row, weights=matrix[k, :-1][codes], minlength=rows)
    scores -= scores.max(1, keepdims=True)
    p = np.exp(scores)
    return p / p.sum(1, keepdims=True), letters


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score (posterior of lang_pred) and letters for each row of docs; null, empty and letterless texts
    are `und` with score 0. Without any learned language, all are. Repeated rows give repeated rows."""
    langs, matrix = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(matrix)  # at most MOST_LANGUAGES x BUCKETS
    names = np.array([*langs, "und"], object)

    def run(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        rows = part.num_rows
        best, score, letters = np.full(rows, len(langs)), np.zeros(rows), np.zeros(rows, np.int64)
        if len(langs):
            p, letters = posteriors(part.column("text"), shared.value)
            best = np.where(letters > 0, p.argmax(1), len(langs))
            score = np.where(letters > 0, p.max(1), 0.0)
        return table(doc_id=part.column("doc_id").cast(pa.int64()), lang_pred=pa.array(names[best], pa.string()), score=score, letters=letters)

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, letters long", most=1 << 20)
