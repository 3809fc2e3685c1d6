"""Line dedup in DataFrame operations only: a suffix array over each document's line-ID sequence by prefix doubling.

The rank of a suffix by its first h lines is found by sorting the distinct pairs of ranks by h / 2 lines. Suffixes that
nothing else begins like are discarded as soon as that is known: their rank is final and they begin no repeat. After the
doubling has reached the run length asked for, suffixes of one rank are an interval of common prefixes at least as long;
all but its first are later copies, and what they cover together are the maximal repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import WORD_RE, drop_written, unused, written

#: A repeat is deleted if it has so many lines, or is one line of so many characters.
MIN_LINES = 3
MIN_CHARS = 200
#: The pipeline also deletes a repeat of fewer lines if they have so many words: a passage of over 50 words.
MIN_WORDS = 51
#: Buckets of the sort that numbers the classes; their sizes are summed in one small window.
BUCKETS = 4096

DOC = ["doc_id", "th"]


def _held(df: DataFrame, name: str, held: list[DataFrame]) -> DataFrame:
    """A written table, noted in `held` for its deletion."""
    held.append(written(df, name))
    return held[-1]


def _ranked(classes: DataFrame, order: list[str], bucket: Column, held: list[DataFrame]) -> DataFrame:
    """rank: how many suffixes come before a class (columns n and `order`) in sorted order. bucket must not fall as the
    order rises; classes are sorted within buckets and buckets are added up."""
    classes = _held(classes.withColumn("bucket", bucket.cast("long")), "classes", held)
    inside = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sizes = classes.groupBy("bucket").agg(F.sum("n").alias("size"))
    up = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("before", F.sum("size").over(up) - F.col("size")).drop("size")
    return classes.withColumn("within", F.sum("n").over(inside) - F.col("n")).join(sizes, "bucket").withColumn("rank", F.col("before") + F.col("within")).drop("bucket", "before", "within")


def _line(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text: rows of one doc_id and text are one document), pos, two hashes, the characters and
    the words of each line. A null text has no lines, an empty one has one."""
    out = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(_line(F.col("text"))).alias("pos", "line"))
    return out.select(*DOC, F.col("pos").cast("long").alias("pos"), F.xxhash64(F.lit(1), "line").alias("a"), F.xxhash64(F.lit(2), "line").alias("b"), F.length("line").alias("chars"), F.regexp_count("line", F.lit(WORD_RE)).cast("long").alias("words"))


def _repeats(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """Classes of suffixes with equal keys that begin at more than one place, with their number and first place."""
    first = F.min(F.struct(*DOC, "pos"))
    return suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), first.alias("first"), F.max(F.struct(*DOC, "pos")).alias("last")).where("first < last").drop("last")


def _ahead(suffixes: DataFrame, by: int) -> DataFrame:
    """ahead: the rank of the suffix `by` lines further on in the same document, where that is not discarded or absent; `to`,
    if there, becomes that suffix's."""
    frame = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(by, by)
    out = {c: F.max(c).over(frame) for c in ("to",) if c in suffixes.columns}
    return suffixes.withColumns({"ahead": F.max("rank").over(frame), **out}).where(F.col("ahead").isNotNull())


def _words(suffixes: DataFrame) -> DataFrame:
    """at, to: the words before and up to the end of a suffix's line, less those of lines that are discarded, of which no run
    has any. Rows of one document are as many for each of its lines."""
    order = Window.partitionBy(*DOC).orderBy("pos")
    copies = F.count(F.lit(1)).over(order.rangeBetween(0, 0))
    to = (F.sum("words").over(order.rangeBetween(Window.unboundedPreceding, 0)) / copies).cast("long")
    return suffixes.withColumn("to", to).withColumn("at", F.col("to") - F.col("words")).drop("words")


def repeated(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, min_words: int | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, th, start, stop (lines, stop excluded): the later copies of repeats; they may overlap. The tables that the plan
    reads are added to `held`."""
    held = [] if held is None else held
    sized = [] if min_words is None else ["at", "to"]
    enough = F.lit(False) if min_words is None else F.col("to") - F.col("at") >= min_words
    whole = lines(docs)
    # by one line: lines that occur once are discarded before anything is sorted
    counted = whole.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = _ranked(counted, ["a", "b"], F.shiftright(F.col("a"), 52), held)
    suffixes = whole.join(classes, ["a", "b"]).select(*DOC, "pos", "chars", "rank", "n", *(["words"] if sized else []))
    suffixes = _held(_words(suffixes) if sized else suffixes, "suffixes", held)
    firsts = _repeats(suffixes, ["rank"]).select("rank", "first")
    later = F.struct(*DOC, "pos") > F.col("first")
    alone = F.lit(True) if min_lines <= 1 else (F.col("chars") >= min_chars) | enough
    out = suffixes.where(alone).join(firsts, "rank").where(later).select(*DOC, F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"))
    reached = 1
    total = suffixes.agg(F.count(F.lit(1))).first()[0]
    while reached < min_lines:
        step = min(reached, min_lines - reached)
        # words also need the lengths that the doubling leaps over
        for by in range(1 if sized else step, step + 1):
            pairs = _ahead(suffixes, by).select(*DOC, "pos", F.col("rank").alias("r"), "ahead", F.col("n").alias("of"), *sized)
            found = _repeats(pairs, ["r", "ahead", "of"])
            if sized and reached + by < min_lines:
                runs = pairs.where(enough).join(found, ["r", "ahead", "of"]).where(later)
                out = out.unionByName(runs.select(*DOC, F.col("pos").alias("start"), (F.col("pos") + reached + by).alias("stop")))
        reached += step
        if reached < min_lines:
            # a class's place in the order is near r + of * ahead / total, which does not fall as (r, ahead) rises
            place = (F.col("r") + F.col("of") * F.col("ahead") / max(total, 1)) * BUCKETS / max(total, 1)
            classes = _ranked(found.select("r", "ahead", "of", "n"), ["r", "ahead"], F.floor(place), held)
            suffixes = _held(pairs.join(classes, ["r", "ahead", "of"]).select(*DOC, "pos", "rank", "n", *sized), "suffixes", held)
        else:
            runs = pairs.join(found, ["r", "ahead", "of"]).where(later)
            out = out.unionByName(runs.select(*DOC, F.col("pos").alias("start"), (F.col("pos") + min_lines).alias("stop")))
    return out


def _runs(covered: DataFrame) -> DataFrame:
    """doc_id, th and dedup_runs: what the intervals (start, stop) of a document cover, as maximal runs in order."""
    before = Window.partitionBy(*DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(*DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True))
    marked = covered.withColumn("fresh", fresh.cast("long")).withColumn("run", F.sum("fresh").over(up))
    merged = marked.groupBy(*DOC, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("dedup_runs"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, min_words: int | None = None) -> DataFrame:
    """docs with text less its later copies of repeated line runs, and dedup_runs, the deleted runs (start, stop) in lines.

    A run of min_lines lines, or one line of min_chars characters, or with min_words a run of any length with so many words,
    is a later copy if the same lines also start earlier: in a row of a smaller doc_id (null first, equal ones by hash of the text), or further up in the same text. Runs are
    judged on the input. Lines are what newlines part; they are compared as they are, empty ones too. A null text stays
    null, an empty one empty; a text of which all lines go becomes empty. Rows that agree in doc_id and text are one
    document and are treated alike. Other columns stay."""
    docs = docs.drop("dedup_runs")
    th, gone_id, gone_th = unused(docs.columns, "th", "gone_id", "gone_th")
    held: list[DataFrame] = []
    covered = repeated(docs.select("doc_id", "text"), min_lines, min_chars, min_words, held)
    gone = written(_runs(covered).select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th), "dedup_runs"), "runs")
    drop_written(*held)
    keyed = docs.withColumn(th, F.xxhash64("text"))
    # a merge join at every size: the runs grow with the input, so the plan does not change where they cease to be small
    both = keyed.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(th) == F.col(gone_th)), "left")
    kept = F.filter(_line(F.col("text")), lambda x, i: ~F.exists("dedup_runs", lambda r: (i >= r["start"]) & (i < r["stop"])))
    text = F.when(F.col("dedup_runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    runs = F.coalesce("dedup_runs", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    return both.select(*(text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns), runs.alias("dedup_runs"))


def digest(docs: DataFrame) -> DataFrame:
    """line_dedup() as op1 returns it: doc_id, n_lines (0 for null), n_removed, n_runs and kept_sha256 (of the empty text for
    null) for each row. Nulls, empty texts, ties, repeated rows and an empty table are as there."""
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_line(F.col("text"))))
    out = line_dedup(docs.select("doc_id", "text", n_lines.cast("long").alias("n_lines")))
    removed = F.aggregate("dedup_runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return out.select("doc_id", "n_lines", removed.alias("n_removed"), F.size("dedup_runs").cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
