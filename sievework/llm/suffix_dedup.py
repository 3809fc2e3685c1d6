"""Suffix-array dedup over bytes: shard Burrows-Wheeler transforms, merged by interleave refinement.

Texts are too long to sort as a whole, and nearly all suffixes are settled without it: each 100 bytes have an anchor, a block
of 40 that the bytes choose, and only stretches of text whose anchors occur again can repeat. Equal stretches are told by
hash. Stretches that share an anchor but differ are gathered by anchor; there, shards of them are transformed, the
transforms are merged, and intervals with common prefixes of 100 bytes are the repeated strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.bwt import SHARD, repeats
from sievework.llm.common import Prefix, binaries, drop_written, map_slices, ranges, table, written
from sievework.llm.repeats import DOC, Scheme, Tokens, covered, with_spans

#: Bytes that make a repeat, and bytes in an anchor.
WINDOW, BLOCK = 100, 40
#: One in so many blocks is looked up to see whether a window can repeat at all.
SAMPLE = 8
#: Bytes of text in a slice; arrays of larger ones do not stay in a core's cache.
SLICE = 1 << 18
#: Bytes of stretches gathered in one task's group, and different stretches of one anchor beyond which they are dealt to several groups.
GROUP, CROWDED = 1 << 18, 1024
#: Windows of crowded anchors that meet in one group, on average.
MEET = 1 << 16


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    made: dict = {}

    def prefix(seed: int) -> Prefix:
        if seed not in made:
            made[seed] = Prefix(data, seed)
        return made[seed]

    return Tokens(offsets, lambda first, stop, seed: prefix(seed)(first, stop), lambda size, seed: prefix(seed).every(size))


def _bytes(window: int):
    def content(data: np.ndarray, t: Tokens, start: np.ndarray, size: np.ndarray) -> pa.Array:
        lengths = size + window - 1
        return binaries(data[ranges(start, lengths)], np.concatenate(([0], np.cumsum(lengths))))

    return content


def _join(string: np.ndarray, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a string that overlap or touch, as one run: string, start, stop."""
    order = np.lexsort((begin, string))
    string, begin = string[order], begin[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (string[1:] != string[:-1]) | (begin[1:] > begin[:-1] + window)
    last = np.append(fresh[1:], True) if len(order) else fresh
    return string[fresh], begin[fresh], begin[last] + window


def _documents(part: pa.Table) -> np.ndarray:
    """Each row's document, numbered in the order of places: null first, then doc_id, then the text's hash."""
    null = part.column("doc_id").is_null().to_numpy()
    doc, th = part.column("doc_id").fill_null(0).to_numpy(), part.column("th").to_numpy()
    order = np.lexsort((th, doc, ~null))
    number = np.zeros(len(order), np.int64)
    number[order[1:]] = np.cumsum((np.diff(th[order]) != 0) | (np.diff(doc[order]) != 0) | (null[order[1:]] != null[order[:-1]]))
    return number


def _merge(window: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        start = part.column("start").to_numpy()
        strings = part.column("content").to_pylist()
        shards, members, size = [], [[]], 0
        for k, s in enumerate(strings):
            if size > SHARD:
                members.append([])
                size = 0
            members[-1].append(k)
            size += len(s) + 1
        for mine in members:
            lengths = np.array([len(strings[k]) for k in mine])
            ends = np.cumsum(lengths + 1) - 1
            symbols = np.full(int(ends[-1]) + 1, 256, np.uint16)
            symbols[ranges(np.concatenate(([0], ends[:-1] + 1)), lengths)] = np.frombuffer(b"".join(strings[k] for k in mine), np.uint8)
            shards.append((symbols, ends))
        (shard, at), interval = repeats(shards, window)
        first_string = np.concatenate(([0], np.cumsum([len(m) for m in members])))
        string, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k, (_, ends) in enumerate(shards):
            mine = shard == k
            local = np.searchsorted(ends, at[mine])
            string[mine] = first_string[k] + local
            offset[mine] = at[mine] - np.concatenate(([0], ends[:-1] + 1))[local]
        # the first of each interval starts the others' copies; other anchors' strings are other bytes or other stretches
        spot = _documents(part)[string] << 32 | start[string] + offset
        begins = np.flatnonzero(np.diff(interval, prepend=-1))
        lead = np.repeat(np.minimum.reduceat(spot, begins), np.diff(np.append(begins, len(spot)))) if len(spot) else spot
        later = spot != lead
        string, offset = string[later], offset[later]
        of, a, b = _join(string, start[string] + offset, window)
        out = part.select(DOC).take(pa.array(of)).append_column("start", pa.array(a, pa.int64())).append_column("stop", pa.array(b, pa.int64()))
        none = pa.nulls(len(of), pa.int64())
        out = out.append_column("one", none).append_column("two", none)
        # a crowded anchor is in several groups: what is first here may be later than another group's
        open_ = np.flatnonzero(part.column("crowded").to_numpy())
        if not len(open_):
            return out
        lengths = np.array([len(strings[k]) for k in open_])
        data = np.frombuffer(b"".join(strings[k] for k in open_), np.uint8)
        windows, begin = lengths - window + 1, np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.full(len(strings), -1, np.int64)
        place[open_] = begin
        left = np.zeros(len(data), bool)
        left[ranges(begin, windows)] = True
        some = place[string] >= 0
        left[place[string[some]] + offset[some]] = False
        at = np.flatnonzero(left)
        k = np.searchsorted(begin, at, "right") - 1
        one, two = (Prefix(data, seed)(at, at + window).view(np.int64) for seed in (2, 3))
        more = part.select(DOC).take(pa.array(open_[k])).append_column("start", pa.array(start[open_[k]] + at - begin[k], pa.int64()))
        more = more.append_column("stop", pa.nulls(len(at), pa.int64())).append_column("one", pa.array(one)).append_column("two", pa.array(two))
        return pa.concat_tables([out, more.cast(out.schema)])

    return run


def _later(window: int):
    """Windows that start earlier in another group, told by two hashes."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        one, two, start = (part.column(c).to_numpy() for c in ("one", "two", "start"))
        spot = _documents(part) << 32 | start
        order = np.lexsort((spot, two, one))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
        lead = spot[order][np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        later = order[spot[order] != lead]
        return part.select([*DOC, "start"]).take(pa.array(later)).append_column("stop", pa.array(start[later] + window, pa.int64()))

    return run


def _compare(met: DataFrame, window: int) -> DataFrame:
    met = written(met, "met")
    # a crowded anchor's stretches are dealt to several groups, and what is first in its group meets the other groups' by its own bytes
    crowd = met.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED)
    crowd = crowd.select("anchor", F.ceil(F.col("n") / CROWDED).alias("pieces"))
    rows = met.join(crowd, "anchor", "left").withColumn("crowded", F.col("pieces").isNotNull())
    size = met.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    groups = max(1, -(-int(size) // GROUP))
    piece = F.pmod(F.xxhash64(*DOC, "start"), F.coalesce("pieces", F.lit(1)))
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("anchor", piece), F.lit(groups))).drop("anchor", "pieces").groupBy("deal")
    spans = "doc_id long, th long, start long, stop long"
    merged = written(dealt.applyInArrow(_merge(window), f"{spans}, one long, two long"), "merged")
    drop_written(met)
    settled, rest = merged.where("stop is not null").select(*DOC, "start", "stop"), merged.where("stop is null").drop("stop")
    n = rest.count()
    if not n:
        return settled
    rest = rest.groupBy(F.pmod("one", F.lit(-(-n // MEET))).alias("deal"))
    return settled.unionByName(rest.applyInArrow(lambda part: _later(window)(part), spans))


def repeated_bytes(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, th, spans (bytes): exactly the bytes inside a string of `window` bytes that also starts earlier."""
    return covered(docs, Scheme(byte_tokens, window, block, False, SAMPLE, SLICE), _bytes(window), "binary", _compare)


def _keep(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    n = np.diff(offsets)
    spans = part.column("spans")
    of = np.repeat(np.arange(part.num_rows), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[of] for k in (0, 1))
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, a, 1)
    np.add.at(change, b, -1)
    keep = np.cumsum(change)[:-1] == 0
    to = np.concatenate(([0], np.cumsum(keep)))[offsets]
    return table(doc_id=part.column("doc_id"), n_bytes=n, n_removed=n - np.diff(to), spans=spans, kept=binaries(data[keep], to))


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs (doc_id, text): n_bytes, n_removed, spans (maximal removed runs in bytes, stop excluded) and
    kept (the other bytes).

    Texts are UTF-8 bytes; every byte inside a string of `window` bytes of one document is removed if the same string also
    starts earlier: in a row of a smaller doc_id (null first, equal ones by hash of the text), or further up in the same
    text. Strings are judged on the input. Null and empty texts have no bytes. Rows that agree in doc_id and text are one
    document and are treated alike. Other columns are ignored."""
    spans = "array<struct<start:bigint,stop:bigint>>"
    return map_slices(with_spans(docs, repeated_bytes(docs, window)), _keep, f"doc_id long, n_bytes long, n_removed long, spans {spans}, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """suffix_dedup() as op3 returns it, one row a row of docs; kept_sha256 is of the remaining bytes. Nulls, empty texts, ties, repeated
    rows and an empty table are as there."""
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
