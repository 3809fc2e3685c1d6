"""What the operators share: the shared folder, sizes, and batches of whole texts as numpy bytes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts are handled in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: ASCII white space as the word contracts name it: space and \x09-\x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: a temporary one in local mode, else one in the warehouse, which
    all executors reach."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jsc.get() if jsc.isDefined() else None
    if not found and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        found = _local.setdefault("dir", "") or tempfile.mkdtemp(prefix="sievework-")
        _local["dir"] = found
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/sievework-shared"


_local: dict[str, str] = {}


def trim() -> None:
    """Give freed memory back to the system where the C library can; it keeps what many arrays of many sizes have left."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Shuffle files of a query are deleted when it has ended; nothing reads them later, since its result is in a table.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, compressed, kept if executors go. This cuts the
    lineage; drop_written() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sievework-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame | None) -> None:
    """Delete what written() made, once no later plan reads it."""
    for df in tables:
        if df is None:
            continue
        context = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sievework-" in path:
                p = context._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it, in whatever case."""
    there = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in there:
            n += "_"
        out.append(n)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column laid end to end, and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    n = len(column)
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch so that each part holds about `most` bytes of text, whole rows only."""
    _, offsets = text_bytes(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        part = batch.slice(lo, hi - lo)
        yield part, *text_bytes(part.column(column))
        lo = hi


def map_slices(df: DataFrame, f: Callable, schema: str | StructType, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of texts; f(part, data, offsets) gives a record batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, column, most):
                if (out := f(part, data, offsets)) is not None and out.num_rows:
                    yield out
        trim()

    return df.mapInArrow(run, schema)


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of bytes where is_word holds, none across rows), and the words before each row."""
    n = len(data)
    w = np.zeros(n + 2, np.int8)
    w[1:-1] = is_word[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][offsets[:-1] <= n]] = True
    at = w[1:-1] == 1
    starts = np.flatnonzero(at & ((w[:-2] == 0) | first[:-1]))
    ends = np.flatnonzero(at & ((w[2:] == 0) | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _constants(seed: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62, dtype=np.uint64)) | 5
    table = rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table, np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Prefix:
    """64-bit polynomial hashes of any byte range: sum of table[b] * base**i, read off from prefix sums.

    The table and the base come from the seed, so that all tasks agree; two seeds give two independent hashes."""

    def __init__(self, data: np.ndarray, seed: int):
        table, base, inverse = _constants(seed)
        n = len(data) + 1
        if seed not in _powers or len(_powers[seed][0]) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
            _powers[seed] = up, down
        up, self.down = _powers[seed]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(table[data] * up[: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Of every range of `size` bytes, as a call gives them."""
        count = max(len(self.sums) - size, 0)
        return mix((self.sums[size:] - self.sums[:count]) * self.down[:count] + np.uint64(size))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64."""
    x = x.astype(np.uint64, copy=True)
    high = x >> np.uint64(33)
    x ^= high
    for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x *= np.uint64(odd)
        np.right_shift(x, np.uint64(33), out=high)
        x ^= high
    return x


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., for counts[0] numbers, then the same for the next."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = np.flatnonzero(counts)
    s, c = np.asarray(starts, np.int64)[full], counts[full]
    out[0] = s[0]
    out[np.cumsum(c)[:-1]] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def binaries(data: np.ndarray | bytes, offsets: np.ndarray) -> pa.Array:
    n = len(offsets) - 1
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data)])


def tree_sum(df: DataFrame, key: str, dtype: str) -> DataFrame:
    """Sum binary arrays of equal size (column `sums`) by key. With many tasks this goes in levels, so that no task gathers
    more than a few hundred arrays of a key however many tasks made them."""
    kind = df.schema[key].dataType.simpleString()
    tasks = df.rdd.getNumPartitions()  # of the plan; nothing runs
    levels = (4096, 64) if tasks > 4096 else (64,) if tasks > 128 else ()

    def add(part: pa.Table) -> pa.Table:
        total = np.frombuffer(part.column("sums")[0].as_py(), dtype).copy()
        for x in part.column("sums").to_pylist()[1:]:
            total += np.frombuffer(x, dtype)
        return pa.table({key: part.column(key)[:1], "salt": part.column("salt")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    df = df.select(key, F.spark_partition_id().cast("long").alias("salt"), "sums")
    for n in (*levels, 1):
        df = df.withColumn("salt", F.col("salt") % n).groupBy(key, "salt").applyInArrow(add, f"{key} {kind}, salt long, sums binary")
    return df.drop("salt")


#: A Bloom filter has 16 bits for each of its members up to this many bits, 32 MB; with more members it lets more through.
BLOOM_MOST = 1 << 28


def _spots(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = a.view(np.uint64), b.view(np.uint64)
    m = np.uint64(bits - 1)
    return x & m, (x >> np.uint64(32) ^ y) & m


def bloom(df: DataFrame, a: str, b: str):
    """A broadcast Bloom filter of bounded size over two columns of hashes; what it lets through has to be joined yet."""
    n = df.agg(F.count(F.lit(1))).first()[0]
    bits = min(BLOOM_MOST, 1 << max(12, (16 * n).bit_length()))
    mask = F.lit(bits - 1).cast("long")
    spots = F.array(F.col(a).bitwiseAND(mask), F.shiftrightunsigned(a, 32).bitwiseXOR(F.col(b)).bitwiseAND(mask))
    words = df.select(F.explode(spots).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("one"))
    got = words.groupBy("word").agg(F.bit_or("one").alias("one")).toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("one").to_numpy()
    return df.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def in_bloom(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.ones(len(a), bool)
    for spot in _spots(a, b, len(words) * 64):
        out &= (words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out
