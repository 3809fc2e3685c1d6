"""Substring dedup over words: fixed-block anchors.

Every text is cut into non-overlapping reference blocks of 10 words, and these are indexed by hash. Every rolling window of
10 words of every text probes the index. A repeat of 20 words holds a whole reference block of each of its copies, so what
no probe has hit is no repeat. Hits are extended to maximal exact repeats: around a hit, stretches of equal words are
extended as a whole, and where stretches differ, window by window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import WHITE, Prefix, binaries, lists, map_slices, ranges, table, words_of
from sievework.llm.repeats import DOC, Scheme, Tokens, covered, place, with_spans

#: Words that make a repeat.
WINDOW = 20


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Words as they are, ASCII white space apart; hashes are of words with one space between."""
    starts, ends, before = words_of(data, offsets, ~WHITE)
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    laid = np.full(int(at[-1]) + 1, 0x20, np.uint8)
    keep = ~WHITE[data]
    laid[np.arange(int(keep.sum())) + np.repeat(np.arange(len(starts)), lengths)] = data[keep]
    made: dict = {}

    def hash_(first: np.ndarray, stop: np.ndarray, seed: int) -> np.ndarray:
        if seed not in made:
            made[seed] = Prefix(laid, seed)
        return made[seed](at[first], at[stop])

    return Tokens(before, hash_)


def _window_hashes(window: int):
    def content(data, t: Tokens, start: np.ndarray, size: np.ndarray) -> pa.Array:
        every = ranges(start, size)
        return lists(t.hash(every, every + window, 3).view(np.int64), np.concatenate(([0], np.cumsum(size))))

    return content


def _compare(met: DataFrame, window: int) -> DataFrame:
    """Windows by anchor and hash: all but the first of each."""
    single = met.select("anchor", *DOC, F.posexplode("content").alias("i", "hash"), "start").select("anchor", "hash", *DOC, (F.col("start") + F.col("i")).alias("start"))
    first = single.groupBy("anchor", "hash").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return single.join(first, ["anchor", "hash"]).where(place() > F.col("first")).select(*DOC, "start", (F.col("start") + window).alias("stop"))


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th, spans (words): exactly the words inside a window whose words also start earlier."""
    block = window // 2  # two blocks less a word fit in a window wherever the grid lies
    return covered(docs, Scheme(word_tokens, window, block, True), _window_hashes(window), "array<long>", _compare)


def _keep(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    starts, ends, before = words_of(data, offsets, ~WHITE)
    n = np.diff(before)
    spans = part.column("spans")
    of = np.repeat(np.arange(part.num_rows), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) + before[of] for k in (0, 1))
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, a, 1)
    np.add.at(change, b, -1)
    keep = np.cumsum(change)[:-1] == 0
    row = np.repeat(np.arange(part.num_rows), n)[keep]
    lengths = (ends - starts)[keep]
    # kept words with a space after each but a row's last
    size = np.bincount(row, weights=lengths + 1, minlength=part.num_rows).astype(np.int64)
    to = np.concatenate(([0], np.cumsum(np.maximum(size - 1, 0))))
    count = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows))))
    place_ = np.cumsum(lengths + 1) - (lengths + 1) - (np.cumsum(size > 0) - (size > 0))[row]
    out = np.full(int(to[-1]), 0x20, np.uint8)
    out[ranges(place_, lengths)] = data[ranges(starts[keep], lengths)]
    return table(doc_id=part.column("doc_id"), n_words=n, n_removed=n - np.diff(count), spans=spans, kept=binaries(out, to))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, n_removed, spans (removed runs in words, stop excluded) and kept (the
    other words, joined by one space).

    Words are runs of anything but ASCII white space, as they are. Every word inside a window of `window` words of one
    document is removed if the same words also start earlier: in a row of a smaller doc_id (null first, equal ones by hash
    of the text), or further up in the same text. Windows are judged on the input. Null and blank texts have no words and
    keep nothing, as an empty string. Rows that agree in doc_id and text are one document and are treated alike. Other
    columns are ignored."""
    spans = "array<struct<start:bigint,stop:bigint>>"
    out = map_slices(with_spans(docs, repeated_words(docs, window)), _keep, f"doc_id long, n_words long, n_removed long, spans {spans}, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def digest(docs: DataFrame) -> DataFrame:
    """substring_dedup() as op6 returns it, one row a row of docs; kept_sha256 is of the kept words. Nulls, blank texts, ties, repeated
    rows and an empty table are as there."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
