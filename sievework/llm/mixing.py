"""Mixing sources to target weights: temperature mixing, in DataFrame operations only.

Token shares p are raised to an exponent a in [0, 1] and normalised. The exponent is bisected to the least flattening
that meets a target entropy, but never so far that a source repeats more often than allowed. The weights become token
budgets, and each source's documents are dealt out in permuted blocks, epoch by epoch, up to its budget.

Only keys are dealt and sorted: a row's ids, source and tokens. Its other columns cross the network once, at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import WORD_RE, drop_written, written

#: Budget as a share of all tokens; entropy to reach as a share of log(sources); epochs of a source at most.
BUDGET = 1.0
ENTROPY = 0.97
REPEATS = 2
#: Sections of the bracket in each round, and rounds: the exponent is known to 32 ** -6.
SECTIONS, ROUNDS = 32, 6
#: A block holds about the square root of its source's documents, this many at least.
LEAST_BLOCK = 256
#: Plans of so many sources at most, 2 MB, are broadcast to the keys; with more, keys and plans meet salted so many ways.
MOST_SOURCES, SALTS = 1 << 15, 64


def token_count(text: Column) -> Column:
    """Words of ASCII white space apart; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def exponent(stats: DataFrame, total: int, sources: int, budget: float, entropy: float, repeats: float) -> float:
    """The bisected exponent for a table (tokens) of one row a source, by its aggregates alone: in each round the bracket
    is cut into SECTIONS, and all sections are judged in one aggregation."""
    lo, hi = 0.0, 1.0
    if sources < 2:
        return 1.0
    for turn in range(ROUNDS):
        step = (hi - lo) / SECTIONS
        grid = stats.where("tokens > 0").select((F.col("tokens") / total).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(SECTIONS))).alias("k"))
        grid = grid.withColumn("x", F.pow("p", lo + F.col("k") * step))
        # entropy of x / z is log z - sum(x log x) / z; a source repeats x / z * budget / p times
        judged = grid.groupBy("k").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("x")).alias("l"), F.max(F.col("x") / F.col("p")).alias("r"))
        flat = (F.log("z") - F.col("l") / F.col("z") > entropy * F.log(F.lit(float(sources)))) | (F.col("r") / F.col("z") * budget > repeats)
        last = judged.where(flat).agg(F.max("k")).first()[0]
        if turn == 0 and last is None:
            return 0.0
        last = min(-1 if last is None else last, SECTIONS - 1)
        lo, hi = lo + last * step, lo + (last + 1) * step
    return round(hi, 6)


def plan(stats: DataFrame, budget: float = BUDGET, entropy: float = ENTROPY, repeats: int = REPEATS) -> DataFrame:
    """stats (one row a source: key, docs, tokens) with weight, quota (tokens), full (whole epochs), rest (tokens of a last
    part epoch) and blocks. A source without tokens costs nothing and is taken once."""
    total, sources = stats.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.when(F.col("tokens") > 0, 1))).first()
    a = exponent(stats, total, sources, budget, entropy, repeats)
    z = stats.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / total, F.lit(a)))).first()[0] if total else None
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0)
    out = stats.withColumn("weight", weight)
    out = out.withColumn("quota", F.least(F.floor(F.col("weight") * F.lit(float(total * budget))), F.col("tokens") * repeats).cast("long"))
    out = out.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("int"))
    out = out.withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("full") * F.col("tokens")).otherwise(0).cast("long"))
    return out.withColumn("blocks", F.ceil(F.col("docs") / F.greatest(F.lit(float(LEAST_BLOCK)), F.sqrt("docs"))).cast("long"))


def _hash(*parts: Column | str) -> Column:
    """The first 13 hex digits of an MD5, a whole number below 2 ** 52."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def _marks(docs: DataFrame) -> DataFrame:
    """docs with mix_f and mix_g, two hashes of all columns: rows that agree in both are the same in everything."""
    whole = [F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return docs.withColumns({"mix_f": F.xxhash64(F.lit(1), *whole), "mix_g": F.xxhash64(F.lit(2), *whole)})


def _planned(keys: DataFrame, planned: DataFrame, sources: int) -> DataFrame:
    if sources <= MOST_SOURCES:
        return keys.join(F.broadcast(planned), "mix_key")
    salt = F.pmod(F.xxhash64("mix_f", "mix_g"), F.lit(SALTS))
    spread = planned.withColumn("mix_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return keys.withColumn("mix_salt", salt).join(spread, ["mix_key", "mix_salt"]).drop("mix_salt")


def mix_sources(docs: DataFrame, budget: float = BUDGET, entropy: float = ENTROPY, repeats: int = REPEATS) -> DataFrame:
    """One row for each document and epoch in which it is drawn: the columns of docs and mix_tokens, mix_weight (of its
    source), mix_epoch (from 0), mix_block (rank of its block in its source's permutation) and mix_rank (in its block).

    A null source is one source of its own; a null text or one without words has no tokens. Blocks are dealt by a hash of
    doc_id and permuted by a hash in each epoch; so are documents in a block, those of one hash by doc_id, tokens and hashes
    of all columns, so that the order is total. In a part epoch, documents with more tokens than the epoch has room for are
    set aside; the others are taken in that order while their tokens fit. Repeated rows are drawn as rows of their own.
    Columns of docs whose names begin with mix_ are replaced. An empty table gives no rows."""
    docs = docs.drop(*(c for c in docs.columns if c.startswith("mix_")))
    marked = _marks(docs)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    keys = marked.select("mix_f", "mix_g", F.col("doc_id").alias("mix_id"), token_count(F.col("text")).alias("mix_tokens"), key.alias("mix_key"))
    keys = written(keys, "keys")
    stats = written(keys.groupBy(F.col("mix_key").alias("key")).agg(F.count(F.lit(1)).alias("docs"), F.sum("mix_tokens").alias("tokens")), "sources")
    planned = written(plan(stats, budget, entropy, repeats).select(F.col("key").alias("mix_key"), *(F.col(c).alias(f"mix_{c}") for c in ("weight", "full", "rest", "blocks"))), "plan")
    rows = _planned(keys, planned, stats.count())
    name = F.coalesce(F.col("mix_id").cast("string"), F.lit(""))
    rows = rows.withColumn("mix_b", _hash(name, F.lit("b")) % F.col("mix_blocks"))
    last = F.col("mix_full") - F.when(F.col("mix_rest") > 0, 0).otherwise(1)
    rows = rows.where(last >= 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("mix_h", _hash(name, F.col("mix_epoch").cast("string")))
    part = F.col("mix_epoch") >= F.col("mix_full")
    rows = rows.withColumn("mix_aside", part & (F.col("mix_tokens") > F.col("mix_rest")))
    rows = rows.withColumn("mix_fits", F.when(F.col("mix_aside"), 0).otherwise(F.col("mix_tokens")))
    block = ["mix_key", "mix_epoch", "mix_b"]
    order = Window.partitionBy(*block).orderBy("mix_h", "mix_id", "mix_tokens", "mix_f", "mix_g")
    ranked = rows.withColumn("mix_rank", F.row_number().over(order).cast("long"))
    ranked = ranked.withColumn("mix_sum", F.sum("mix_fits").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # tokens of the blocks before a block: a window over blocks, of which a source has the root of its documents at most
    sizes = rows.groupBy(*block).agg(F.sum("mix_fits").alias("mix_size"))
    sizes = sizes.withColumn("mix_o", _hash(F.col("mix_key"), F.col("mix_epoch").cast("string"), F.col("mix_b").cast("string")))
    blocks = Window.partitionBy("mix_key", "mix_epoch").orderBy("mix_o", "mix_b")
    sizes = sizes.withColumn("mix_block", F.row_number().over(blocks).cast("long"))
    sizes = sizes.withColumn("mix_before", F.sum("mix_size").over(blocks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("mix_size")).drop("mix_size", "mix_o")
    drawn = ranked.join(sizes, block).where(~part | (~F.col("mix_aside") & (F.col("mix_before") + F.col("mix_sum") <= F.col("mix_rest"))))
    made = ["mix_tokens", "mix_weight", "mix_epoch", "mix_block", "mix_rank"]
    drawn = written(drawn.select("mix_f", "mix_g", *made), "drawn")
    drop_written(keys, stats, planned)
    # rows that agree in both hashes are the same, and the draws of all of them have been counted one by one
    rest = [F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns]
    once = marked.groupBy("mix_f", "mix_g").agg(*rest)
    return once.join(drawn, ["mix_f", "mix_g"]).select(*(F.col(f"`{c}`") for c in docs.columns), *made)


def digest(docs: DataFrame) -> DataFrame:
    """mix_sources() as op4 returns it: doc_id, source, n_tokens, weight (6 decimals), epoch, block and rank of every draw. Nulls,
    empty texts, ties, repeated rows and an empty table are as there."""
    out = mix_sources(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 6).alias("weight"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_rank").alias("rank"))
