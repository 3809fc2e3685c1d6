"""Repeated windows of W tokens over a whole corpus, for texts of words or of bytes.

Every window has one anchor, a block of k tokens inside it that depends on the window's content alone. Windows of one text
that follow each other and share an anchor are a stretch. So equal windows have equal anchors, and only stretches with
equal anchors need to meet. Of equal stretches all but the first are covered as a whole; only where an anchor stands in
different stretches, at the edges of repeats, single windows are compared.

Three scans of the texts feed this: which blocks occur again anywhere (live ones), the stretches of live anchors, and the
contents of those stretches that have to be compared. Between scans a Bloom filter of bounded size carries what is known;
what it lets through by mistake is sorted out by joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import SLICE_BYTES, bloom, drop_written, in_bloom, map_slices, mix, ranges, slices, table, written

DOC = ["doc_id", "th"]
#: Hashes are dealt to buckets by their first bits: so many buckets at least, and no more than so many bytes of text for each.
LEAST_BUCKETS, BUCKET_TEXT = 256, 16 << 20
#: A task sends its hashes after so many bytes of text; within a bucket a hash is told by so many further bits.
FLUSH_TEXT, KEY_BITS = 8 << 20, 38
#: Positions within a slice have so many bits in an anchor's rank, hashes the rest.
AT_BITS = 30


@dataclass
class Tokens:
    """A slice's tokens: where each row's begin, and hashes of token ranges by seed; every: of all ranges of a size, across rows too,
    where that is cheaper."""

    before: np.ndarray
    hash: Callable[[np.ndarray, np.ndarray, int], np.ndarray]
    every: Callable[[int, int], np.ndarray] | None = None

    def starts(self, size: int) -> np.ndarray:
        """Whether so many tokens from here on are of one row."""
        out = np.ones(int(self.before[-1]), bool)
        first = np.maximum(self.before[1:] - size + 1, self.before[:-1])
        out[ranges(first, self.before[1:] - first)] = False
        return out


@dataclass
class Scheme:
    """What tokens are, the window, the block, and whether the blocks to be met again lie on a fixed grid (else they are the
    anchors). All blocks of a window that repeats occur again; without a grid that is asked of one in `sample` blocks, which
    their content picks. Texts are read in slices of `most` bytes."""

    tokens: Callable[[np.ndarray, np.ndarray], Tokens]
    window: int
    block: int
    grid: bool
    sample: int = 1
    most: int = SLICE_BYTES

    def sampled(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(40)) % np.uint64(self.sample) == 0


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width], by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def blocks(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First token of every block of k tokens inside a row, and the block's hash."""
    at = np.flatnonzero(t.starts(k))
    return at, t.every(k, 1)[at] if t.every else t.hash(at, at + k, 1)


def stretches(t: Tokens, s: Scheme, live: "Live | None", known: "tuple[np.ndarray, np.ndarray] | None" = None):
    """Row, first window, windows, anchor (first token) and anchor's hash of every stretch. With live, a window counts only
    if its anchor is live and all its blocks (the sampled ones) occur again; on a grid only live blocks can be anchors. known:
    blocks(), if they are."""
    at, h = known or blocks(t, s.block)
    total = int(t.before[-1])
    rank = np.full(total, np.iinfo(np.uint64).max, np.uint64)
    value = np.zeros(total, np.uint64)
    value[at] = h
    again = None
    if live is not None:
        some = np.ones(len(h), bool) if s.grid else s.sampled(h)
        repeated = ~some
        repeated[some] = live.again(h[some])
        again = np.zeros(total, np.int8)
        again[at] = repeated
        again = sliding_min(again, s.window - s.block + 1) if total > s.window - s.block else again[:0]
        if s.grid:
            at, h = at[repeated], h[repeated]
            hit = live.hit(h)
            at, h = at[hit], h[hit]
    rank[at] = (mix(h + np.uint64(9)) >> np.uint64(AT_BITS) << np.uint64(AT_BITS)) | at.astype(np.uint64)
    inside = t.starts(s.window)
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    least = sliding_min(rank, s.window - s.block + 1)
    inside = inside[: len(least)]
    if again is not None:
        inside &= again.view(bool)
    least[~inside] = np.iinfo(np.uint64).max
    # an anchor's place is in its rank, so windows of different rows differ
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    size = np.diff(np.append(first, len(least)))
    some = least[first] != np.iinfo(np.uint64).max
    first, size = first[some], size[some]
    anchor = (least[first] & np.uint64((1 << AT_BITS) - 1)).astype(np.int64)
    hashes = value[anchor]
    if live is not None and not s.grid:
        ok = live.hit(hashes)
        first, size, anchor, hashes = first[ok], size[ok], anchor[ok], hashes[ok]
    return np.searchsorted(t.before, first, "right") - 1, first, size, anchor, hashes


def _pack(h: np.ndarray, grid: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Sorted distinct hashes by bucket: 4 bytes a step, or 5 a hash where a step is too long. Two low bits of each say
    whether it is on the grid, and whether it occurs again here."""
    if not len(h):
        return
    flagged = np.sort((h >> np.uint64(64 - bits - KEY_BITS) << np.uint64(1)) | grid)
    h = flagged >> np.uint64(1)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.append(first, len(h)))
    value = (h[first] << np.uint64(2)) | (flagged[first + size - 1] & np.uint64(1)) | ((size > 1).astype(np.uint64) << np.uint64(1))
    edge = np.searchsorted(h[first] >> np.uint64(KEY_BITS), np.arange((1 << bits) + 1, dtype=np.uint64))
    mask = np.uint64((1 << (KEY_BITS + 2)) - 1)
    for b in range(1 << bits):
        mine = value[edge[b] : edge[b + 1]] & mask
        if len(mine):
            step = np.diff(mine, prepend=np.uint64(0))
            if int(step.max()) < 1 << 32:
                yield b, b"\4" + step.astype("<u4").tobytes()
            else:
                yield b, b"\5" + np.ascontiguousarray(mine.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if raw[0] == 4:
        return np.cumsum(np.frombuffer(raw, "<u4", offset=1), dtype=np.uint64)
    out = np.zeros(((len(raw) - 1) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _names(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(prefix + np.uint64(1)).view(np.int64), mix(prefix ^ np.uint64(0xA5A5A5A5)).view(np.int64)


@dataclass
class Live:
    """What is known of blocks, as Bloom filters by a hash's first bits: hits are blocks on the grid that another place, probed
    at every token of every text, repeats (without a grid: anchors that occur twice); repeated are all blocks that do, of the
    sampled ones without a grid."""

    hits: object
    repeated: object
    bits: int

    def _in(self, filter_, h: np.ndarray) -> np.ndarray:
        return in_bloom(filter_.value, *_names(h >> np.uint64(64 - self.bits - KEY_BITS)))

    def hit(self, h: np.ndarray) -> np.ndarray:
        return self._in(self.hits, h)

    def again(self, h: np.ndarray) -> np.ndarray:
        return self._in(self.repeated, h)


def live_blocks(docs: DataFrame, s: Scheme) -> Live:
    """Send the hashes of all blocks (grid) or anchors to buckets, and see there which occur again."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BUCKETS, int(size) // BUCKET_TEXT).bit_length() - 1 + (int(size) // BUCKET_TEXT > LEAST_BUCKETS)

    def hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = s.tokens(data, offsets)
        if s.grid:
            at, h = blocks(t, s.block)
            return h, (at - t.before[np.searchsorted(t.before, at, "right") - 1]) % s.block == 0
        # anchors and sampled blocks, each place once
        at, h = blocks(t, s.block)
        _, _, _, anchor, _ = stretches(t, s, None, (at, h))
        there = np.zeros(int(t.before[-1]), bool)
        there[anchor] = True
        hit = there[at]
        some = hit | s.sampled(h)
        return h[some], hit[some]

    def send(batches):
        held, size = [], 0
        for batch in batches:
            for _, data, offsets in slices(batch, most=s.most):
                held.append(hashes(data, offsets))
                size += len(data)
                if size >= FLUSH_TEXT:
                    yield from packed(held)
                    held, size = [], 0
        yield from packed(held)

    def packed(held):
        if held:
            got = list(_pack(*(np.concatenate(x) for x in zip(*held, strict=True)), bits))
            if got:
                yield table(bucket=np.array([b for b, _ in got], np.int64), hashes=pa.array([x for _, x in got], pa.binary()))

    def meet(part: pa.Table) -> pa.Table:
        bucket = part.column("bucket")[0].as_py()
        all_ = np.concatenate([_unpack(x.as_py()) for x in part.column("hashes")])
        all_.sort()
        key = all_ >> np.uint64(2)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        flags = np.bitwise_or.reduceat(all_ & np.uint64(3), first)
        again = (np.diff(np.append(first, len(key))) > 1) | (flags & np.uint64(2) > 0)
        live = key[first[again]] | np.uint64(bucket << KEY_BITS)
        return pa.table({"live": live.view(np.int64), "hit": flags[again] & np.uint64(1) > 0})

    def named(batches):
        for batch in batches:
            a, b = _names(batch.column("live").to_numpy().view(np.uint64))
            yield table(a=a, b=b)

    sent = docs.select("text").mapInArrow(send, "bucket long, hashes binary")
    found = written(sent.groupBy("bucket").applyInArrow(meet, "live long, hit boolean"), "live")
    make = lambda df: bloom(df.select("live").mapInArrow(named, "a long, b long"), "a", "b")
    out = Live(make(found.where("hit")), make(found), bits)
    drop_written(found)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text; rows that agree in both are one document) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def stretch_table(docs: DataFrame, s: Scheme, live: Live) -> DataFrame:
    """anchor, body (hashes of the anchor and of the whole stretch), doc_id, th, start, windows."""

    def run(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        t = s.tokens(data, offsets)
        row, start, size, _, h = stretches(t, s, live)
        body = t.hash(start, start + size + s.window - 1, 2)
        ids = part.select(DOC).take(pa.array(row))
        return table(anchor=h.view(np.int64), body=body.view(np.int64), doc_id=ids.column(0), th=ids.column(1), start=start - t.before[row], windows=size)

    return map_slices(keyed(docs), run, "anchor long, body long, doc_id long, th long, start long, windows long", most=s.most)


def _spot(anchor: np.ndarray, doc: pa.Array, th: pa.Array, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a stretch's anchor and place."""
    x = anchor.view(np.uint64) + mix(doc.fill_null(0).to_numpy().view(np.uint64) + mix(th.to_numpy().view(np.uint64) + mix(start.astype(np.uint64))))
    return _names(x)


def contents(docs: DataFrame, s: Scheme, live: Live, wanted, content: Callable, kind: str) -> DataFrame:
    """The stretches whose anchor and place the filter `wanted` lets through, with `content` made of their tokens."""

    def run(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        t = s.tokens(data, offsets)
        row, start, size, _, h = stretches(t, s, live)
        ids = part.select(DOC).take(pa.array(row))
        ok = in_bloom(wanted.value, *_spot(h.view(np.int64), *ids.columns, start - t.before[row]))
        row, start, size, h, ids = row[ok], start[ok], size[ok], h[ok], ids.filter(pa.array(ok))
        return table(anchor=h.view(np.int64), doc_id=ids.column(0), th=ids.column(1), start=start - t.before[row], content=content(data, t, start, size))

    return map_slices(keyed(docs), run, f"anchor long, doc_id long, th long, start long, content {kind}", most=s.most)


def place(start: Column | str = "start") -> Column:
    """The order of places: doc_id (null first), then the text's hash, then the position."""
    return F.struct("doc_id", "th", F.col(start).alias("start") if isinstance(start, str) else start.alias("start"))


def covered(docs: DataFrame, s: Scheme, content: Callable, kind: str, compare: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """doc_id, th, spans (tokens): what the windows cover whose tokens also start earlier, as maximal runs (start, stop). compare(table, window) gets stretches (anchor, doc_id, th, start, content) that share an anchor and differ,
    and returns what is covered by windows that start earlier in another of them (doc_id, th, start, stop)."""
    live = live_blocks(docs, s)
    every = written(stretch_table(docs, s, live), "stretches")
    groups = every.groupBy("anchor", "body", "windows").agg(F.min(place()).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = written(groups, "groups")
    back = groups.where("n > 1").select("anchor", "body", "windows", F.col("first"))
    copies = every.join(back, ["anchor", "body", "windows"]).where(place() > F.col("first"))
    out = copies.select(*DOC, "start", (F.col("start") + F.col("windows") + (s.window - 1)).alias("stop"))
    mixed = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    leaders = written(groups.join(mixed, "anchor").select("anchor", "first.doc_id", "first.th", "first.start"), "leaders")

    def second(batches):
        for batch in batches:
            a, b = _spot(batch.column("anchor").to_numpy(), batch.column("doc_id"), batch.column("th"), batch.column("start").to_numpy())
            yield table(a=a, b=b)

    wanted = bloom(leaders.mapInArrow(second, "a long, b long"), "a", "b")
    found = contents(docs, s, live, wanted, content, kind)
    same = [found[c].eqNullSafe(leaders[c]) for c in ("anchor", "doc_id", "th", "start")]
    met = found.join(leaders, same[0] & same[1] & same[2] & same[3], "left_semi").dropDuplicates(["anchor", *DOC, "start"])
    out = written(runs(out.unionByName(compare(met, s.window))), "runs")
    drop_written(every, groups, leaders)
    return out


def runs(intervals: DataFrame) -> DataFrame:
    """doc_id, th and spans: what the intervals (start, stop) of a document cover, as maximal runs in order."""
    order = Window.partitionBy(*DOC).orderBy("start")
    fresh = F.coalesce(F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    marked = intervals.withColumn("fresh", fresh.cast("long")).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(*DOC, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def with_spans(docs: DataFrame, covered_: DataFrame) -> DataFrame:
    """keyed(docs) and spans (empty where nothing is covered)."""
    gone = covered_.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), "spans")
    rows = keyed(docs)
    both = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["th"] == gone["gone_th"]), "left")
    return both.select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"))
