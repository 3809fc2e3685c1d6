"""Graphs as vertex and edge tables: ordered candidates, levels, paths and bounded closures."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType


def first_existing(wanted: DataFrame, candidates: str, there: DataFrame, key: str = "path") -> DataFrame:
    """For each row of wanted the first of an array of candidates that `there` has, as column found (null for none)."""
    keyed = wanted.withColumn("wanted_id", F.struct(*wanted.columns))
    spread = keyed.select("wanted_id", F.posexplode(candidates).alias("at", key))
    best = spread.join(there.select(key).distinct(), key).groupBy("wanted_id").agg(F.min_by(key, "at").alias("found"))
    return keyed.join(best, "wanted_id", "left").drop("wanted_id")


#: Levels after which what has been found is put into one table.
CUT = 8


def held(df: DataFrame) -> DataFrame:
    """df computed once: a compressed table in the folder of checkpoints, or kept by Spark where there is none. Its size is then
    known to later joins; what explode makes of a small table is not, and would be broadcast."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/sievework-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(*tables: DataFrame) -> None:
    """Delete what held() made, once no later plan reads it."""
    for df in tables:
        df.unpersist()
        context = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/sievework-graph-" in f}:
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def levels(edges: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """node, level, parent: breadth first from roots (node) along edges (u, v); of several parents the least. A step is a join
    with what is new; it ends when nothing is."""
    none = F.lit(None).cast(edges.schema["u"].dataType).alias("parent")
    seen = front = held(roots.select(F.col("node"), F.lit(0).alias("level"), none).dropDuplicates(["node"]))
    edge = held(edges.select("u", "v").distinct())
    for level in range(1, most + 1):
        step = front.join(edge, front["node"] == edge["u"]).groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        fresh = held(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("level"), "parent"))
        if fresh.isEmpty():
            let_go(fresh)
            break
        seen, front = seen.unionByName(fresh), fresh
        if level % CUT == 0:  # else a plan of many levels grows with their number
            seen = held(seen)
    let_go(edge)
    return seen


def paths(edges: DataFrame, starts: DataFrame, most: int = 20) -> DataFrame:
    """target, node, path: all ways from starts (target, node, path as an array that ends in node) along edges (u, v) that meet no
    node twice, of at most `most` steps. A step is a join with the ways that the last one made longer; a recursive query would
    end at a number of rows."""
    out = front = starts.select("target", "node", "path")
    for _ in range(most):
        step = front.join(edges.select("u", "v").distinct(), front["node"] == F.col("u")).where(~F.array_contains("path", F.col("v")))
        front = held(step.select("target", F.col("v").alias("node"), F.array_append("path", F.col("v")).alias("path")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


#: Targets of edges up to which a closure is put together from the distances between them, a byte each.
TARGETS = 2048


def bounded_closure(edges: DataFrame, seeds: DataFrame, rounds: int = 6, most: int = TARGETS) -> DataFrame:
    """node, source, round: where a seed (node, source) gets along edges (u, v) in at most `rounds` steps, and when first.

    Where edges have `most` targets or fewer, pairs are made only as they are read: a source's first steps are bits, and how far
    its other nodes are is the least distance from those. Else a step is a join with what the last one found for the first
    time, and all pairs of a step are a table."""
    edges = edges.select("u", "v")
    targets = edges.select("v").distinct().limit(most + 1).toArrow().column(0).combine_chunks()
    if not len(targets):
        return seeds.select("node", "source", F.lit(0).alias("round")).distinct()
    if len(targets) > most or rounds > 250:
        return _by_steps(edges, seeds, rounds)
    return _by_distances(edges, seeds, rounds, targets)


def _by_steps(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    edge = held(edges.distinct())
    out = front = held(seeds.select("node", "source", F.lit(0).alias("round")).distinct())
    for i in range(1, rounds + 1):
        step = front.join(edge, front["node"] == edge["u"]).select(F.col("v").alias("node"), "source").distinct()
        known = out.select(F.col("node").alias("n"), F.col("source").alias("s"))
        front = held(step.join(known, F.col("node").eqNullSafe(F.col("n")) & F.col("source").eqNullSafe(F.col("s")), "left_anti").withColumn("round", F.lit(i)))
        if front.isEmpty():
            let_go(front)
            break
        out = out.unionByName(front)
    let_go(edge)
    return out


def _distances(firsts: list, rounds: int) -> np.ndarray:
    """Steps between targets, from the bits of each one's first steps; more than `rounds` is 254."""
    step = np.array(firsts, np.float32)
    out = np.full(step.shape, 254, np.uint8)
    front = np.eye(len(step), dtype=bool)
    for i in range(rounds + 1):
        out[front] = i
        front = (front.astype(np.float32) @ step > 0) & (out == 254)
        if not front.any():
            break
    return out


def _by_distances(edges: DataFrame, seeds: DataFrame, rounds: int, targets: pa.Array) -> DataFrame:
    spark, n = edges.sparkSession, len(targets)
    words = [f"w{k}" for k in range(-(-n // 64))]
    numbered = pa.table({"v": targets, "i": pa.array(range(n), pa.int32())})
    number = F.broadcast(spark.createDataFrame(numbered, StructType([edges.schema["v"], *spark.range(0).select(F.lit(0).alias("i")).schema])))
    bit = lambda k: F.when(F.shiftright("i", 6) == k, F.expr("shiftleft(1L, i & 63)")).otherwise(F.lit(0).cast("long"))
    both = lambda df, key, names, make: df.groupBy(key).agg(*(F.bit_or(make(k)).alias(x) for k, x in enumerate(names)))
    firsts = held(both(edges.where("u IS NOT NULL").join(number, edges["v"].eqNullSafe(number["v"])), "u", words, bit))
    unpacked = lambda t, names: np.unpackbits(np.stack([t.column(x).to_numpy() for x in names], 1).astype("<i8").view(np.uint8), axis=1, count=n, bitorder="little")
    inner = firsts.join(number, firsts["u"] == number["v"]).select("i", *words).toArrow()
    step = np.zeros((n, n), bool)
    step[inner.column("i").to_numpy()] = unpacked(inner, words)
    shared = spark.sparkContext.broadcast((_distances(step, rounds - 1), targets))

    # one row a source: the bits of its seeds' first steps, and of the seeds themselves, which are found in round 0
    own = [f"o{k}" for k in range(len(words))]
    begun = seeds.select("node", "source").distinct()
    met = begun.join(firsts, begun["node"] == firsts["u"], "left").join(number, begun["node"].eqNullSafe(number["v"]), "left")
    zero = F.lit(0).cast("long")
    sources = met.groupBy("source").agg(*(F.bit_or(F.coalesce(x, zero)).alias(x) for x in words), *(F.bit_or(F.coalesce(bit(k), zero)).alias(x) for k, x in enumerate(own)))
    sources = sources.where(" OR ".join(f"{x} <> 0" for x in words))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, nodes = shared.value
        for batch in batches:
            first, seed = unpacked(batch, words), unpacked(batch, own).view(bool)
            ends = np.cumsum(first.sum(1, dtype=np.int64))
            lo = 0
            while lo < len(ends):  # so many sources that their first steps' rows of distances are a few MB
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE // n, "right")))
                source, to = np.nonzero(first[lo:hi])
                far = np.minimum.reduceat(distance[to], np.searchsorted(source, np.arange(hi - lo)), axis=0) + np.uint8(1)
                far[seed[lo:hi]] = 255
                who, when, what, size = [], [], [], []
                for i in range(1, rounds + 1):
                    row, node = np.nonzero(far == i)
                    count = np.bincount(row, minlength=hi - lo)
                    some = np.flatnonzero(count)
                    who.append(some + lo)
                    when.append(np.full(len(some), i, np.int32))
                    what.append(node)
                    size.append(count[some])
                offsets = np.concatenate(([0], np.cumsum(np.concatenate(size)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), nodes.take(pa.array(np.concatenate(what))))
                yield pa.RecordBatch.from_arrays([batch.column("source").take(pa.array(np.concatenate(who))), pa.array(np.concatenate(when)), lists], ["source", "round", "nodes"])
                lo = hi

    schema = StructType([seeds.schema["source"]]).add("round", IntegerType()).add("nodes", ArrayType(edges.schema["v"].dataType))
    later = sources.mapInArrow(found, schema).select(F.explode("nodes").alias("node"), "source", "round")
    return begun.select("node", "source", F.lit(0).alias("round")).unionByName(later)


#: Bytes of distances put together at once.
SLICE = 8 << 20
