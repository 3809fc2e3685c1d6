"""Package archives as rows: entries with their bytes, or what is wrong with them. Nothing is unpacked to disk."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Limits of an archive.
MAX_COMPRESSED, MAX_ENTRIES, MAX_TOTAL, MAX_FILE, MAX_PATH, MAX_DEPTH = 100 << 20, 20_000, 300 << 20, 50 << 20, 1024, 32
ENTRIES = "archive string, entry long, path string, size long, kind string, bytes binary, violation string"


def path_violation(path: str) -> str | None:
    """Why a name must not be unpacked, the first reason that holds."""
    name = path.replace("\\", "/")
    if not name or "\0" in name:
        return "empty"
    if name.startswith("/"):
        return "absolute"
    if len(name) > 1 and name[1] == ":":
        return "drive"
    if len(name) > MAX_PATH:
        return "long"
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if len(parts) > MAX_DEPTH:
        return "deep"
    depth = 0
    for p in parts:
        depth += -1 if p == ".." else 1
        if depth < 0:
            return "traversal"
    return None


def entries(archive: str, data: bytes) -> Iterator[tuple]:
    if len(data) > MAX_COMPRESSED:
        yield archive, 0, "", len(data), "archive", None, "compressed-size"
        return
    total = 0
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as tar:
            for k, info in enumerate(tar):
                kind = "file" if info.isfile() else "folder" if info.isdir() else "link" if info.islnk() or info.issym() else "other"
                total += info.size if kind == "file" else 0
                wrong = path_violation(info.name)
                if k >= MAX_ENTRIES:
                    wrong = "entries"
                elif total > MAX_TOTAL:
                    wrong = "total-size"
                elif kind == "file" and info.size > MAX_FILE:
                    wrong = wrong or "file-size"
                elif kind in ("link", "other"):
                    wrong = wrong or kind
                body = tar.extractfile(info).read() if kind == "file" and not wrong else None
                yield archive, k, info.name, info.size, kind, body, wrong
                if wrong in ("entries", "total-size"):
                    return
    except (tarfile.TarError, EOFError, OSError) as e:
        yield archive, -1, "", 0, "archive", None, f"unreadable: {type(e).__name__}"


def read_archives(archives: DataFrame) -> DataFrame:
    """ENTRIES of tar archives, compressed or not, from rows (path, content) as binaryFile gives them. An archive's entries are
    checked in order; beyond a limit the rest is not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ENTRIES.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                held, size = [], 0
                for row in entries(path, bytes(content or b"")):
                    held.append(row)
                    size += len(row[5] or b"")
                    if size > 8 << 20:
                        yield pd.DataFrame(held, columns=columns)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=columns)

    return archives.select("path", "content").mapInPandas(run, ENTRIES)
