"""N-gram Jaccard join: size-aware, heavy and light.

Light (small) sets list the subsets of the sizes that a similar pair must share, with which similar sets meet. Heavy
(large) sets enter inverted lists with the tokens of their prefix, rarest first, and the lists are scanned. The boundary
between them is where the subsets begin to cost more than the lists. Tokens are 64-bit hashes of shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import WHITE, Prefix, binaries, bloom, drop_written, in_bloom, lists, map_slices, mix, slices, table, text_bytes, unused, words_of, written
from sievework.llm.graph import components

#: Words in a shingle, and the similarity as a fraction, where a caller names none.
WORDS, SIMILAR = 5, (80, 100)
#: Frequent tokens go last in the order of tokens. At most so many, 2 MB, are known to all tasks: those that are in this
#: share of a slice's documents, the most frequent first. Any order of tokens gives the same pairs.
MOST_FREQUENT, FREQUENT = 1 << 17, 0.004
#: The boundary is sought below this size.
LIGHT_MOST = 24
#: Before all pairs of different components are compared, two rounds make large groups few components: in the first, members
#: of a list are compared with one leader; in the second, each member of a list longer than LONG with its FEW most promising
#: ones. After a round, lists whose members are all in one component are dropped.
LONG, FEW = 32, 4
#: A sketch has a bit for each cell that a token falls in, about four cells a token within these bounds. Tokens in cells that
#: another set has empty are not in it, which bounds an intersection from above before whole sets are looked at.
LEAST_CELLS, MOST_CELLS = 64, 1 << 16
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def need(n: int, m: int, t: tuple[int, int]) -> int:
    """The least intersection with which sets of n and m tokens are similar: inter >= t (n + m - inter)."""
    return -(-t[0] * (n + m) // (t[0] + t[1]))


def prefix(n, t: tuple[int, int]):
    return n - -(-t[0] * n // t[1]) + 1


def subset_sizes(n: int, t: tuple[int, int]) -> list[int]:
    """The intersections that sets of n tokens may need with sets of any similar size."""
    low, high = -(-t[0] * n // t[1]), n * t[1] // t[0]
    return sorted({o for m in range(max(low, 1), high + 1) if (o := need(n, m, t)) <= min(n, m)})


def subsets(n: int, t: tuple[int, int]) -> int:
    return sum(comb(n, o) for o in subset_sizes(n, t))


def boundary(t: tuple[int, int], per_document: float) -> int:
    """The largest size up to which subsets cost no more than prefix tokens with their lists; per_document, the frequent
    tokens that a document has on average, stands for how crowded lists are."""
    x = 0
    while x < LIGHT_MOST and subsets(x + 1, t) <= prefix(x + 1, t) * (2 + per_document):
        x += 1
    return x


def token_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and token of each row's set, sorted: shingles of so many lower-cased words; all of a text's fewer words are one."""
    # words are laid one space apart, so that a shingle is one range of bytes
    starts, ends, before = words_of(data, offsets, ~WHITE)
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    laid = np.full(int(at[-1]), 0x20, np.uint8)
    keep = ~WHITE[data]
    laid[np.arange(int(keep.sum())) + np.repeat(np.arange(len(starts)), lengths)] = FOLD[data[keep]]
    n = np.diff(before)
    count = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = before[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(first + words, before[row + 1]) - 1
    token = Prefix(laid, 8)(at[first], at[last] + lengths[last])
    cuts = np.concatenate(([0], np.cumsum(count))).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # row by row: sorts of a few hundred numbers
        token[lo:hi].sort()
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    return row[fresh], token[fresh]


def statistics(docs: DataFrame, words: int) -> tuple[np.ndarray, float]:
    """Frequent tokens over all documents, rarest first (at most MOST_FREQUENT), and how many a document has on average.
    A token counts in the slices in which FREQUENT of the documents have it."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in slices(batch):
                _, token = token_sets(data, offsets, words)
                token.sort()
                first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(token)))
                often = count >= max(4, FREQUENT * part.num_rows)
                yield table(token=token[first[often]].view(np.int64), n=count[often].astype(np.int64))

    summed = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    got = summed.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    total = docs.agg(F.count(F.lit(1))).first()[0]
    n = got.column("n").to_numpy()
    return got.column("token").to_numpy()[::-1].astype(np.int64).view(np.uint64), float(n.sum()) / max(total, 1)


def _light(tokens: np.ndarray, t: tuple[int, int]) -> list[np.ndarray]:
    """Keys of sets of one size (sets x n): one for each subset of each size that may have to be shared."""
    n, out = tokens.shape[1], []
    parts = mix(tokens)
    whole = parts.sum(1, dtype=np.uint64)
    for o in subset_sizes(n, t):
        salt = np.uint64(o * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        left = np.array(list(combinations(range(n), n - o)), np.int64).reshape(comb(n, o), n - o)
        out.append(mix(whole[:, None] - parts[:, left].sum(2, dtype=np.uint64) + salt))
    return out


def signed(docs: DataFrame, words: int, t: tuple[int, int], frequent: np.ndarray, most_light: int) -> DataFrame:
    """doc_id, th, n (set size), a, b (128-bit hash of the set), keys (prefix tokens in order), light (subset keys), sketch."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order + 1))  # MOST_FREQUENT numbers at most
    both_from = -(-t[0] * (most_light + 1) // t[1])

    def run(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        row, token = token_sets(data, offsets, words)
        rows = part.num_rows
        n = np.bincount(row, minlength=rows)
        at = np.concatenate(([0], np.cumsum(n)))
        add = lambda x: np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))[at])
        known, rank = shared.value
        place = np.zeros(len(token), np.int64)
        if len(known):
            k = np.minimum(np.searchsorted(known, token), len(known) - 1)
            place = np.where(known[k] == token, rank[k], 0)
        # in each row the other tokens, sorted, then the frequent ones by rank
        often = place > 0
        last = np.flatnonzero(often)
        last = last[np.lexsort((token[last], place[last], row[last]))]
        others = np.flatnonzero(~often)
        count = np.bincount(row[others], minlength=rows)
        by = np.empty(len(token), np.int64)
        before = np.concatenate(([0], np.cumsum(count)))
        by[at[row[others]] + np.arange(len(others)) - before[row[others]]] = others
        by[at[row[last]] + count[row[last]] + np.arange(len(last)) - (at - before)[row[last]]] = last
        local = np.arange(len(token)) - np.repeat(at[:-1], n)
        cells = np.clip(1 << np.ceil(np.log2(np.maximum(4 * n, 1))).astype(np.int64), LEAST_CELLS, MOST_CELLS) * (n > 0)
        cell = np.concatenate(([0], np.cumsum(cells)))
        bits = np.zeros(cell[-1], np.uint8)
        bits[cell[row] + (mix(token + np.uint64(3)) >> (np.uint64(64) - np.log2(cells[row]).astype(np.uint64))).astype(np.int64)] = 1
        sketch = np.packbits(bits)
        heavy = np.where((n >= both_from) & (n > 0), prefix(n, t), 0)
        keys = token[by][local < np.repeat(heavy, n)]
        light: list = [[] for _ in range(rows)]
        for size in range(1, most_light + 1):
            mine = np.flatnonzero(n == size)
            if len(mine):
                made = np.concatenate(_light(token[at[mine][:, None] + np.arange(size)], t), 1)
                for r, x in zip(mine.tolist(), made.view(np.int64).tolist(), strict=True):
                    light[r] = x
        return table(
            doc_id=part.column("doc_id").cast(pa.int64()), th=part.column("th"), n=n.astype(np.int64), a=add(mix(token)).view(np.int64), b=add(mix(token ^ np.uint64(0x5BD1E995A5A5A5A5))).view(np.int64),
            keys=lists(keys.view(np.int64), np.concatenate(([0], np.cumsum(heavy)))), light=pa.array(light, pa.list_(pa.int64())), sketch=binaries(sketch, cell // 8),
        )

    return map_slices(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), run, "doc_id long, th long, n long, a long, b long, keys array<long>, light array<long>, sketch binary")


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (rows x bytes) with neighbouring cells put together until it has `size` bytes a row."""
    while bits.shape[1] > size:
        cells = np.unpackbits(bits, axis=1)
        bits = np.packbits(cells[:, ::2] | cells[:, 1::2], axis=1)
    return bits


def _crowd(n, ident, comp, bits, t: tuple[int, int], few: int | None):
    """Pairs of one long list that the sketches leave open, of different components: for each member the few with most room
    to spare, or all. Sketches of one width are compared block by block, and with those of twice the width, folded."""
    width = np.array([len(x) for x in bits])
    out = []
    for w in np.unique(width):
        own, other = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        cols = np.concatenate((own, other))
        a = np.frombuffer(b"".join(bits[i] for i in own), np.uint8).reshape(len(own), w)
        both = [a]
        if len(other):
            both.append(_folded(np.frombuffer(b"".join(bits[i] for i in other), np.uint8).reshape(len(other), 2 * w), w))
        a, c = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(np.concatenate(both)).view(np.uint64)
        full = np.bitwise_count(c).sum(1, dtype=np.int64)
        step = max(1, (1 << 20) // max(1, c.size))
        for k in range(0, len(own), step):
            i = own[k : k + step]
            shared = np.bitwise_count(a[k : k + step, None, :] & c[None, :, :]).sum(2, dtype=np.int64)
            room = np.minimum(n[i][:, None] - full[k : k + len(i)][:, None] + shared, n[cols][None, :] - full[None, :] + shared)
            spare = room - -(-t[0] * (n[i][:, None] + n[cols][None, :]) // (t[0] + t[1]))
            spare[comp[i][:, None] == comp[cols][None, :]] = -1
            spare[n[cols][None, :] * t[1] < n[i][:, None] * t[0]] = -1
            spare[n[i][:, None] * t[1] < n[cols][None, :] * t[0]] = -1
            if few is not None and spare.shape[1] > few:
                keep = np.zeros(spare.shape, bool)
                np.put_along_axis(keep, np.argpartition(-spare, few, axis=1)[:, :few], True, axis=1)
                spare[~keep] = -1
            r, col = np.nonzero(spare >= 0)
            out.append(np.stack([i[r], cols[col]], 1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return ident[pairs[:, 0]], ident[pairs[:, 1]]


def _pairs(t: tuple[int, int], turn: int):
    """A function over sorted lists (key, n, id, pos, comp, size, bits): pairs to look at. A list goes on over batches.

    In short lists, and in the first round in all: each member with the leader of its size class; in the last round all pairs
    of different components. In long lists see _crowd()."""
    last = turn == 2

    def emit(key, n, ident, pos, comp, size, bits):
        x, y = [], []
        long = np.flatnonzero(size > (LONG if turn else np.inf))
        if len(long):
            cuts = np.flatnonzero(np.concatenate(([True], key[long][1:] != key[long][:-1], [True])))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                mine = long[lo:hi]
                u, v = _crowd(n[mine], ident[mine], comp[mine], [bits[i] for i in mine], t, None if last else FEW)
                x.append(u)
                y.append(v)
        short = np.flatnonzero(size <= (LONG if turn else np.inf))
        key, n, ident, pos, comp = (c[short] for c in (key, n, ident, pos, comp))
        if len(short):
            if last:
                # the i-th member of a list with the j-th before it, gap by gap
                i = [np.zeros(0, np.int64)]
                j = [np.zeros(0, np.int64)]
                for gap in range(1, LONG):
                    same = np.flatnonzero(key[gap:] == key[:-gap])
                    if not len(same):
                        break
                    i.append(same)
                    j.append(same + gap)
                i, j = np.concatenate(i), np.concatenate(j)
            else:
                grade = np.floor(np.log(n) / np.log(t[1] / t[0])).astype(np.int64)
                order = np.lexsort((ident, grade, key))
                head = np.ones(len(key), bool)
                k, g = key[order], grade[order]
                head[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
                i, j = order[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))][~head], order[~head]
            ok = comp[i] != comp[j]
            i, j = i[ok], j[ok]
            least = -(-t[0] * (n[i] + n[j]) // (t[0] + t[1]))
            room = np.where(pos[i] < 0, np.minimum(n[i], n[j]), 1 + np.minimum(n[i] - 1 - pos[i], n[j] - 1 - pos[j]))
            ok = (room >= least) & (least <= np.minimum(n[i], n[j]))
            x.append(ident[i[ok]])
            y.append(ident[j[ok]])
        if not x:
            return table(u=np.zeros(0, np.int64), v=np.zeros(0, np.int64))
        a, b = np.concatenate(x), np.concatenate(y)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return table(u=pair[:, 0], v=pair[:, 1])

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "id", "pos", "comp", "size", "bits")]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            end = int(np.searchsorted(now[0], now[0][-1], "left"))
            if end:
                yield emit(*(x[:end] for x in now))
            held = [x[end:] for x in now]
        if held is not None and len(held[0]):
            yield emit(*held)

    return run


def _candidates(entries: DataFrame, distinct: DataFrame, t: tuple[int, int], turn: int) -> DataFrame:
    columns = ["key", "n", "id", "pos", "comp", "size"]
    none = F.lit(None).cast("binary").alias("bits")
    rows = entries.select(*columns, none)
    if turn:  # sketches are needed in long lists only
        long = entries.where(F.col("size") > LONG).join(distinct.select("id", F.col("sketch").alias("bits")), "id").select(*columns, "bits")
        rows = rows.where(F.col("size") <= LONG).unionByName(long)
    dealt = rows.repartition("key").sortWithinPartitions("key", "n", "id")
    return dealt.mapInArrow(_pairs(t, turn), "u long, v long").distinct()


def _thinned(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries with their components, of lists that still have members of two components."""
    known = entries.drop("comp").join(comps.select("id", "root"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    return known.select(*entries.columns).repartition("key").sortWithinPartitions("key").mapInArrow(_lists(_mixed), entries.schema)


def _possible(t: tuple[int, int]):
    """Pairs whose sketches leave room for the intersection that they need."""

    def run(batches):
        for batch in batches:
            (x, xo), (y, yo) = text_bytes(batch.column("x")), text_bytes(batch.column("y"))
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[None, xo[i] : xo[i + 1]], y[None, yo[i] : yo[i + 1]]
                k = min(p.shape[1], q.shape[1])
                p, q = _folded(p, k), _folded(q, k)
                room = min(n[i] - int(np.bitwise_count(p & ~q).sum()), m[i] - int(np.bitwise_count(q & ~p).sum()))
                keep[i] = room >= need(int(n[i]), int(m[i]), t)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return run


def _similar(t: tuple[int, int]):
    def run(batches):
        for batch in batches:
            (x, xo), (y, yo) = text_bytes(batch.column("x")), text_bytes(batch.column("y"))
            keep = []
            for i in range(batch.num_rows):
                both = np.sort(np.frombuffer(x[xo[i] : xo[i + 1]].tobytes() + y[yo[i] : yo[i + 1]].tobytes(), np.uint64))
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(t[1] * inter >= t[0] * (len(both) - inter))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, words: int, t: tuple[int, int]) -> DataFrame:
    """Of pairs (u, v), the similar ones. Whole sets are made from the texts once more, only where sketches leave it open,
    and only from the row that stands for a set; a Bloom filter picks those rows, joins make it exact."""
    some = distinct.select("id", "n", "sketch")
    u = some.select(F.col("id").alias("u"), "n", F.col("sketch").alias("x"))
    v = some.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    open_ = written(pairs.join(u, "u").join(v, "v").select("u", "v", "n", "m", "x", "y").mapInArrow(_possible(t), "u long, v long"), "open")
    stands = distinct.select("id", F.xxhash64("row.doc_id", "row.th").alias("r"), F.col("row.th").alias("th"))
    named = open_
    for side in ("u", "v"):
        named = named.join(stands.select(F.col("id").alias(side), F.col("r").alias(f"r{side}"), F.col("th").alias(f"t{side}")), side)
    named = written(named, "named")
    drop_written(open_)
    bits = bloom(named.select(F.explode(F.array(F.struct(F.col("ru").alias("r"), F.col("tu").alias("th")), F.struct(F.col("rv").alias("r"), F.col("tv").alias("th")))).alias("x")).select("x.*").distinct(), "r", "th")

    def run(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
        ok = in_bloom(bits.value, part.column("r").to_numpy(), part.column("th").to_numpy())
        if not ok.any():
            return None
        part = part.filter(pa.array(ok))
        row, token = token_sets(*text_bytes(part.column("text")), words)
        return table(r=part.column("r"), th=part.column("th"), tokens=binaries(token.tobytes(), 8 * np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows))))))

    rows = docs.select("text", F.xxhash64("text").alias("th"), "doc_id").select("text", "th", F.xxhash64("doc_id", "th").alias("r"))
    made = written(map_slices(rows, run, "r long, th long, tokens binary"), "sets")
    sets = made.dropDuplicates(["r", "th"])
    y = sets.select(F.col("r").alias("rv"), F.col("th").alias("tv"), F.col("tokens").alias("y"))
    x = sets.select(F.col("r").alias("ru"), F.col("th").alias("tu"), F.col("tokens").alias("x"))
    out = written(named.join(y, ["rv", "tv"]).join(x, ["ru", "tu"]).select("u", "v", "x", "y").mapInArrow(_similar(t), "u long, v long").distinct(), "links")
    drop_written(made, named)
    bits.unpersist()
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (size of its set), component_id, the least doc_id that its links reach,
    th (hash of its text) and component, a number that the rows of a component share (null for an empty set).

    A set: the distinct shingles of `words` lower-cased (A-Z) words, ASCII white space apart; of fewer words the whole
    sequence. Sets link when their Jaccard similarity is at least similar[0] / similar[1]. Null, empty and blank texts have
    empty sets, link with nothing and keep their own doc_id. Equal sets are one set from the start, so repeated rows and
    copies cost nothing more. A null doc_id is never a component's name unless there is no other. Other columns are ignored.

    Links are verified on whole sets. What is skipped are pairs that are already in one component: a few rounds join what is
    joined easily; then all pairs of different components that share a list are compared."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent, per_document = statistics(docs, words)
    every = written(signed(docs, words, similar, frequent, boundary(similar, per_document)), "signed")
    rows = written(every.select("doc_id", "th", "n", "a", "b"), "rows")
    distinct = every.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.first("keys").alias("keys"), F.first("light").alias("light"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "th")).alias("row"))
    whole = written(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    drop_written(every)
    entries = whole.select("id", "n", F.posexplode("keys").alias("pos", "key"))
    entries = entries.unionByName(whole.select("id", "n", F.lit(-1).alias("pos"), F.explode(F.array_distinct("light")).alias("key")))
    entries = entries.repartition("key").sortWithinPartitions("key").mapInArrow(_lists(_doubled), "id long, n long, pos int, key long, size long")
    entries = written(entries.withColumn("comp", F.col("id")), "entries")
    distinct = written(whole.drop("keys", "light"), "sketches")
    drop_written(whole)
    links, comps = None, None
    for turn in range(3):
        pairs = written(_candidates(entries, distinct, similar, turn), "pairs")
        found = _links(pairs, distinct, docs, words, similar)
        both = found if links is None else written(links.unionByName(found), "links")
        grown = written(components(both), "components")
        drop_written(pairs, comps, *(() if links is None else (links, found)))
        links, comps = both, grown
        if turn < 2:
            fewer = written(_thinned(entries, comps), "entries")
            drop_written(entries)
            entries = fewer
    named = distinct.select("id", "a", "b", "least").join(comps, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("a", "b", "root", "component_id")
    named = written(named, "named")
    drop_written(entries, distinct, links, comps)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = rows.join(named, ["a", "b"], "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("root").alias("component"))


def _lists(keep: Callable):
    """A function over entries sorted by key: those that keep(table, first row of each list, size of each) leaves. A list may
    go on over batches."""

    def whole(t: pa.Table, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) > 1:
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            yield from keep(t, first, np.diff(np.append(first, len(key)))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = t.column("key").to_numpy()
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            yield from whole(t.slice(0, last), key[:last])
            held = t.slice(last).combine_chunks()
        if held is not None:
            yield from whole(held, held.column("key").to_numpy())

    return run


def _doubled(t: pa.Table, first: np.ndarray, count: np.ndarray) -> pa.Table:
    """Lists of two members at least, with their size."""
    size = np.repeat(count, count)
    return t.append_column("size", pa.array(size)).filter(pa.array(size > 1))


def _mixed(t: pa.Table, first: np.ndarray, count: np.ndarray) -> pa.Table:
    """Lists with members of two components at least."""
    comp = t.column("comp").to_numpy()
    return t.filter(pa.array(np.repeat(np.minimum.reduceat(comp, first) < np.maximum.reduceat(comp, first), count)))


def deduplicate(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The rows of docs of which one in each component stays: that of the least doc_id (null last, equal ones by hash of
    the text; of rows that agree in both one). Rows with empty sets all stay. Columns stay as they are.

    Only rows that a Bloom filter of those to go lets through are shuffled; all others stay where they are read."""
    found = written(near_duplicates(docs, words, similar).where(F.col("component").isNotNull()).select("doc_id", "th", "component"), "found")
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("x")
    kept = found.groupBy("component").agg(chosen).select("component", F.col("x.doc_id").alias("keep_id"), F.col("x.th").alias("keep_th"))
    both = found.groupBy("component", "doc_id", "th").agg(F.count(F.lit(1)).alias("n")).join(kept, "component")
    goes = ~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th")))
    moved = written(both.where(goes | (F.col("n") > 1)).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), goes.alias("goes"), F.xxhash64("doc_id", "th").alias("mark")), "moved")
    drop_written(found)
    bits = bloom(moved, "mark", "gone_th")

    @F.pandas_udf("boolean")
    def maybe(mark: pd.Series, th: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(bits.value, mark.to_numpy(), th.to_numpy()))

    th, mark, gone_id, gone_th = unused(docs.columns, "th", "mark", "gone_id", "gone_th")
    keyed = docs.withColumn(th, F.xxhash64("text")).withColumn(mark, F.xxhash64(F.col("doc_id").cast("long"), F.col(th)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    some = maybe(F.col(mark), F.col(th))
    gone = moved.where("goes").select(F.col("gone_id").alias(gone_id), F.col("gone_th").alias(gone_th))
    met = keyed.where(some).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(th) == F.col(gone_th)), "left_anti")
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")), F.lit("")) == ""
    return keyed.where(~some).select(*columns).unionByName(met.where(blank).select(*columns)).unionByName(met.where(~blank).dropDuplicates(["doc_id", th]).select(*columns))
