"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of the test items."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import lists, map_slices, ranges, table, words_of

#: Lower case for A-Z; word bytes are digits, letters and all bytes of characters beyond ASCII; the rest become spaces.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
IS_WORD = FOLD != 0x20

#: An automaton is built over at most so many bytes of item text (its nodes take about 30 times the windows' bytes); more items are scanned for in further passes.
BLOCK_BYTES = 256 << 10

SCHEMA = "doc_id long, th long, n_words long, word_hits array<int>, item_ids array<long>, spans array<struct<start:int,end:int>>, words array<struct<start:int,end:int>>"


def item_windows(items: list[tuple[int | None, str | None]], width: int) -> dict[bytes, list[int]]:
    """Normalised window -> the ids of its items. An item of fewer words than `width`, but not none, is one window."""
    out: dict[bytes, set] = {}
    for item, text in items:
        words = FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()
        for i in range(max(1, len(words) - width + 1) if words else 0):
            ids = out.setdefault(b" ".join(words[i : i + width]), set())
            if item is not None:
                ids.add(item)
    return {k: sorted(v) for k, v in out.items()}


def _automaton(windows: dict[bytes, list[int]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (window, ids) in enumerate(windows.items()):
        found.add_word(f" {window.decode('latin-1')} ", (k, window.count(b" ") + 1, ids))
    found.make_automaton()
    return found


def _join(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[str, np.ndarray]:
    """All rows' words, each after one space; a row ends with a space and \\x01. Also where each word's space lies."""
    rows = len(offsets) - 1
    of = np.repeat(np.arange(rows), np.diff(before))
    lengths = ends - starts
    size = np.cumsum(lengths + 1)
    space = size - (lengths + 1) + 2 * of
    total = int(size[-1] if len(size) else 0) + 2 * rows
    out = np.full(total, 0x20, np.uint8)
    out[ranges(space + 1, lengths)] = FOLD[data[ranges(starts, lengths)]]
    last = np.concatenate(([0], size))[before[1:]] + 2 * np.arange(rows) + 1
    out[last] = 1
    return out.tobytes().decode("latin-1"), space


def scanner(windows: dict[bytes, list[int]]):
    """A function over slices of texts; the automaton is built once in each Python worker."""
    made: list = []

    def scan(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        if not made:
            made.append(_automaton(windows))
        rows = part.num_rows
        starts, ends, before = words_of(data, offsets, IS_WORD)
        text, space = _join(data, offsets, starts, ends, before)
        hits = [(end, *value) for end, value in made[0].iter(text)] if windows and len(starts) else []
        n_words = np.diff(before)
        covered, item_ids = np.zeros(len(starts) + 1, np.int64), [[] for _ in range(rows)]
        if hits:
            # a match ends on the space after its last word, which is the space of the next word or of the row's end
            last = np.searchsorted(space, np.array([h[0] for h in hits]), "left") - 1
            count = np.array([h[2] for h in hits])
            np.add.at(covered, last - count + 1, 1)
            np.add.at(covered, last + 1, -1)
            of = np.searchsorted(before, last, "right") - 1
            sets: dict[int, set] = {}
            for row, h in zip(of.tolist(), hits, strict=True):
                sets.setdefault(row, set()).update(h[3])
            for row, ids in sets.items():
                item_ids[row] = sorted(ids, key=str)
        hit = np.cumsum(covered)[:-1] > 0
        spots = np.flatnonzero(hit)
        counts = np.bincount(np.searchsorted(before, spots, "right") - 1, minlength=rows) if len(spots) else np.zeros(rows, np.int64)
        to = np.concatenate(([0], np.cumsum(counts)))
        local = spots - before[:-1].repeat(counts)
        # maximal runs of hit words, as offsets in characters of the original text
        begins = np.flatnonzero(np.concatenate(([True], (np.diff(spots) > 1) | (np.diff(np.repeat(np.arange(rows), counts)) > 0)))) if len(spots) else np.zeros(0, np.int64)
        stops = np.concatenate((begins[1:], [len(spots)])) - 1 if len(spots) else begins
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if len(spots) else np.zeros(1, np.int64)
        row_of = np.repeat(np.arange(rows), counts)[begins]
        base = chars[offsets[row_of]] if len(spots) else begins
        span = [chars[starts[spots[begins]]] - base, chars[ends[spots[stops]]] - base] if len(spots) else [begins, begins]
        runs = np.concatenate(([0], np.cumsum(np.bincount(row_of, minlength=rows)))).astype(np.int32)
        pairs = lambda a, b: pa.ListArray.from_arrays(pa.array(runs), pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["start", "end"]))
        return table(
            doc_id=part.column("doc_id").cast(pa.int64()),
            th=part.column("th"),
            n_words=n_words.astype(np.int64),
            word_hits=lists(local.astype(np.int32), to),
            item_ids=pa.array(item_ids, pa.list_(pa.int64())),
            spans=pairs(*span),
            words=pairs(spots[begins] - before[row_of], spots[stops] + 1 - before[row_of]) if len(spots) else pairs(begins, begins),
        )

    return scan


def _items(benchmark: DataFrame, k: int, n: int) -> list[tuple[int | None, str | None]]:
    """Block k of n of the items, dealt by a hash of the row; only this block is on the driver."""
    mine = benchmark.select(F.col("item_id").cast("long"), "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    return [tuple(r) for r in mine.distinct().orderBy("item_id", "text").collect()]


def _runs(found: Column) -> Column:
    """Runs (words, spans) of several blocks, put together where they overlap or touch in words."""
    kind = "array<struct<words:struct<start:int,end:int>,spans:struct<start:int,end:int>>>"

    def add(made: Column, x: Column) -> Column:
        last = F.get(made, F.size(made) - 1)
        grown = F.struct(*(F.struct(last[k]["start"].alias("start"), F.greatest(last[k]["end"], x[k]["end"]).alias("end")).alias(k) for k in ("words", "spans")))
        longer = F.concat(F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0))), F.array(grown))
        return F.when(x["words"]["start"] <= last["words"]["end"], longer).otherwise(F.concat(made, F.array(x))).cast(kind)

    return F.aggregate(F.array_sort(found), F.array().cast(kind), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, word_hits (indices of hit words), item_ids (sorted as strings),
    spans (maximal runs of hit words as character offsets in the original text) and words (the same runs as word indices).

    A window is `width` consecutive words of an item, or a shorter item as a whole; every word of a document inside an
    occurrence of a window is hit. Null and empty texts have no words. A null item_id marks words but is not listed.
    Repeated rows give repeated rows; other columns of docs are ignored. An empty benchmark hits nothing.

    The benchmark's size is read first. Up to block_bytes, the usual case, one automaton scans all texts once, without
    a shuffle. A larger benchmark is dealt into blocks of about that size: each further pass yields only documents with
    hits, which are put together by document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    n = _count(benchmark, block_bytes)
    scan = lambda k: map_slices(docs, scanner(item_windows(_items(benchmark, k, n), width)), SCHEMA)
    first = scan(0)
    if n == 1:
        return first.drop("th")
    lists = ("word_hits", "item_ids", "runs")
    zipped = F.arrays_zip("words", "spans").alias("runs")
    first = first.withColumn("runs", zipped)
    more = None
    for k in range(1, n):
        one = scan(k).where(F.size("word_hits") > 0).dropDuplicates(["doc_id", "th"]).withColumn("runs", zipped)
        more = one if more is None else more.unionByName(one)
    more = more.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(*(F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in lists))
    out = first.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    both = {c: F.array_sort(F.array_distinct(F.concat(c, F.coalesce(f"more_{c}", F.array())))) for c in lists}
    both["item_ids"] = F.transform(F.array_sort(F.transform(both["item_ids"], lambda x: x.cast("string"))), lambda x: x.cast("long"))
    out = out.select("doc_id", "n_words", both["word_hits"].alias("word_hits"), both["item_ids"].alias("item_ids"), _runs(both["runs"]).alias("runs"))
    return out.select("doc_id", "n_words", "word_hits", "item_ids", F.col("runs.spans").alias("spans"), F.col("runs.words").alias("words"))


def _count(benchmark: DataFrame, block_bytes: int) -> int:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(size) // block_bytes))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without any hit word, with all their columns: a contaminated document goes as a whole. Null and empty
    texts and all rows, for an empty benchmark, stay; repeated rows are treated alike. Each block of the benchmark is one
    pass, without a shuffle."""
    n = _count(benchmark, block_bytes)
    for k in range(n):
        scan = scanner(item_windows(_items(benchmark, k, n), width))

        def run(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, scan=scan) -> pa.RecordBatch:
            found = scan(table(doc_id=pa.nulls(part.num_rows, pa.int64()), th=pa.nulls(part.num_rows, pa.int64())), data, offsets)
            hits = found.column("word_hits").value_lengths().to_numpy(zero_copy_only=False)
            return part.filter(pa.array(hits == 0))

        docs = map_slices(docs, run, docs.schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    """decontaminate() as op2 returns it, one row a row of it; nulls, empty texts and repeated rows are as there."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("word_hits").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("word_hits") > 0).alias("contaminated"),
    )
