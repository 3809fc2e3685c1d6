"""Source trees as files tables. Spark's own readers leave out hidden files, so a local tree is listed by the driver and read
by the executors; trees in a store are read with binaryFile."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.plans.catalog import MAX_FULL_BYTES, MAX_LITE_BYTES

# Extensions and folders that decide what is read.
MEDIA = (".png .jpg .jpeg .gif .webp .ico .bmp .avif .tiff .woff .woff2 .ttf .otf .eot .pdf .zip .gz .tgz .tar .7z .rar .mp3 .mp4 .mov .avi .mkv .webm .wav .flac .db .sqlite .sqlite3 .lockb").split()
NATIVE = (".wasm .exe .dll .so .dylib .node .o .a .obj .class .pyc .pyd .jar .bin .msi .dmg .apk .deb .rpm .ko").split()
SKIPPED = {
    "source": frozenset(".git node_modules dist build coverage .next .nuxt .svelte-kit __pycache__ .venv venv vendor .pytest_cache .turbo .cache .idea .vscode target out scratch".split()),
    "package": frozenset(".git node_modules coverage __pycache__ .venv venv .pytest_cache .cache .idea .vscode scratch".split()),
}
MAX_FILES = 3000
LISTED = "package string, path string, abs string, size long, klass string, ignored_by string"


@dataclass
class Listing:
    """Rows (package, path, abs, size, klass, ignored_by) of all files met, and what stopped or was passed over: nothing that
    is not read goes uncounted."""

    rows: list[tuple] = field(default_factory=list)
    truncated: bool = False
    failures: list[str] = field(default_factory=list)
    skipped_folders: int = 0


def list_tree(root: str, package: str, mode: str = "package", ignore: tuple[str, ...] = (), max_files: int = MAX_FILES, full: int = MAX_FULL_BYTES, lite: int = MAX_LITE_BYTES) -> Listing:
    """Walk a local tree in path order, hidden files too, links left out. klass: media, native, full, lite, hard, or ignored.
    Native and media files count neither for sizes nor for max_files."""
    import re

    out, kept = Listing(), 0
    globs = [(g, re.compile(T.glob_pattern(g))) for g in ignore]
    for folder, folders, names in os.walk(root, onerror=lambda e: out.failures.append(str(e.filename))):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel + "/"
        keep = []
        for f in sorted(folders):
            hit = next((g for g, p in globs if p.match(f"{rel}{f}/") or p.match(rel + f)), None)
            if f in SKIPPED[mode] or os.path.islink(os.path.join(folder, f)):
                out.skipped_folders += 1
            elif hit:
                out.rows.append((package, rel + f + "/", None, 0, "ignored", hit))
            else:
                keep.append(f)
        folders[:] = keep
        for name in sorted(names):
            path, where = rel + name, os.path.join(folder, name)
            if os.path.islink(where):
                continue
            try:
                size = os.stat(where).st_size
            except OSError:
                out.failures.append(path)
                continue
            hit = next((g for g, p in globs if p.match(path)), None)
            ext = "." + path.rsplit(".", 1)[1].lower() if "." in path else ""
            klass = "ignored" if hit else "native" if ext in NATIVE else "media" if ext in MEDIA else "full" if size <= full else "lite" if size <= lite else "hard"
            if klass in ("full", "lite", "hard"):
                if kept == max_files:
                    out.truncated = True
                    continue
                kept += 1
            out.rows.append((package, path, where, size, klass, hit))
    return out


def list_file(path: str, package: str, full: int = MAX_FULL_BYTES, lite: int = MAX_LITE_BYTES) -> Listing:
    """One file as a listing: no folder, glob or class of extension keeps it out. A file above `full` is still read whole; above
    `lite` it stays metadata, and the scan is not complete."""
    size = os.stat(path).st_size
    return Listing([(package, os.path.basename(path), path, size, "full" if size <= max(full, lite) else "hard", None)])


def read_listed(spark: SparkSession, listing: Listing) -> DataFrame:
    """files (package, path, size, klass, bytes, content): bytes of native files' first and last 64 KB, content of full and lite
    ones; hard ones stay metadata. A file that cannot be read has nulls, which count as failures later."""
    rows = spark.createDataFrame(listing.rows, LISTED)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for where, size, klass in zip(b["abs"], b["size"], b["klass"], strict=True):
                try:
                    if klass == "native":
                        with open(where, "rb") as f:
                            head = f.read(64 << 10)
                            f.seek(max(len(head), size - (64 << 10)))
                            data.append(head + f.read())
                    elif klass in ("full", "lite"):
                        with open(where, "rb") as f:
                            data.append(f.read())
                    else:
                        data.append(None)
                except OSError:
                    data.append(None)
            yield pd.DataFrame({"package": b["package"], "path": b["path"], "size": b["size"], "klass": b["klass"], "bytes": data})

    out = rows.where("klass <> 'ignored'").mapInPandas(load, "package string, path string, size long, klass string, bytes binary")
    return out.withColumn("content", F.when(F.col("klass").isin("full", "lite"), F.decode("bytes", "UTF-8")))


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The same columns from a store that only Spark reads; the package is the first folder below root. Hidden files are not
    seen by that reader."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substring_index("path", root.rstrip("/") + "/", -1)
    size = F.col("length")
    klass = F.when(size <= MAX_FULL_BYTES, "full").when(size <= MAX_LITE_BYTES, "lite").otherwise("hard")
    out = raw.select(F.substring_index(rel, "/", 1).alias("package"), F.regexp_replace(rel, "^[^/]*/", "").alias("path"), size.alias("size"), klass.alias("klass"), F.col("content").alias("bytes"))
    return out.withColumn("content", F.decode("bytes", "UTF-8"))


def coverage(files: DataFrame, listing: Listing) -> DataFrame:
    """One row a package: files by class, unread ones, and complete (nothing hard, unread, ignored away by limits or failed)."""
    unread = F.col("klass").isin("full", "lite", "native") & F.col("bytes").isNull()
    count = lambda c: F.count_if(F.col("klass") == c).alias(c)
    out = files.groupBy("package").agg(F.count(F.lit(1)).alias("files"), *map(count, ("full", "lite", "hard", "native", "media")), F.count_if(unread).alias("unread"))
    whole = (F.col("hard") == 0) & (F.col("unread") == 0) & F.lit(not listing.truncated and not listing.failures)
    return out.withColumn("complete", whole)
