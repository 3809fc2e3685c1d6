"""Accuracy against labels: rates by group, and one-to-one matches of findings within a band of lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 (3 decimals, null where undefined) by keys from booleans expected and found."""
    both = lambda e, f: F.count_if((F.col("expected") == e) & (F.col("found") == f))
    out = rows.groupBy(*keys).agg(both(True, True).alias("tp"), both(False, True).alias("fp"), both(True, False).alias("fn"))
    rate = lambda x: F.round(F.try_divide(F.col("tp"), x), 3)
    return out.select(*keys, "tp", "fp", "fn", rate(F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp") + F.col("fn")).alias("recall"), F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 3).alias("f1"))


def detected(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that are both expected and found, once each."""
    return expected.select(*keys).intersect(found.select(*keys))


def band_match(expected: DataFrame, found: DataFrame, band: int = 2) -> DataFrame:
    """item, rule_id, line, at: each expected (item, rule_id, line) takes the first free finding of its item and rule within
    `band` lines, in order of lines: one pass over both. Groups are an item's findings of one rule, bounded by its file."""

    def greedy(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free, out, k = sorted(right["line"].tolist()), [], 0
        for line in sorted(left["line"].tolist()):
            # lines rise, so what lies below one's band is of no use to any later one
            while k < len(free) and free[k] < line - band:
                k += 1
            hit = k < len(free) and free[k] <= line + band
            out.append((left["item"].iloc[0], left["rule_id"].iloc[0], line, free[k] if hit else None))
            k += hit
        return pd.DataFrame(out, columns=["item", "rule_id", "line", "at"]).astype({"at": "Int64"})

    kind = expected.schema["item"].dataType.simpleString()
    keys = ["item", "rule_id"]
    return expected.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInPandas(greedy, f"item {kind}, rule_id string, line long, at long")
