"""Statistics of bytes: kind by magic, entropy, printable strings and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Leading bytes of the kinds that are told apart.
MAGIC = (("7F454C46", "elf"), ("4D5A", "pe"), ("0061736D", "wasm"), ("CAFEBABE", "macho-fat"), ("FEEDFACE", "macho"), ("FEEDFACF", "macho"), ("CEFAEDFE", "macho"), ("CFFAEDFE", "macho"), ("504B0304", "zip"), ("1F8B", "gzip"))
ENTROPY_LIMIT = 7.2


def kind(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 8))
    out = F.lit("unknown")
    for magic, name in reversed(MAGIC):
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def entropy(rows: DataFrame, key: str, data: str) -> DataFrame:
    """key, bytes, entropy (Shannon's, in bits a byte, 3 decimals; 0 for no bytes). Bytes are read off a hex string and counted
    by value before anything is shuffled: at most 256 counts a key and task."""
    pairs = rows.select(key, F.explode(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))).alias("b"))
    counts = pairs.groupBy(key, "b").agg(F.count(F.lit(1)).alias("c"))
    out = counts.groupBy(key).agg(F.sum("c").alias("bytes"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("s"))
    out = out.select(key, "bytes", F.round(F.log2(F.col("bytes").cast("double")) - F.col("s") / F.col("bytes"), 3).alias("entropy"))
    return rows.select(key).join(out, key, "left").select(key, F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def printable(data: Column, least: int = 4) -> Column:
    """Runs of at least `least` printable ASCII characters or tabs."""
    return F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(rf"([\x20-\x7e\t]{{{least},}})"), F.lit(1))


# What strings in a binary tell.
HIGH_SIGNALS = (
    ("exfil-endpoint", r"(?i)webhook\.site|requestbin|discord(?:app)?\.com/api/webhooks|api\.telegram\.org/bot|ngrok|oast\.(?:me|online|fun|pro)|interact\.sh|pipedream|pastebin"),
    ("credential-marker", r"(?i)AWS_|OPENAI_API_KEY|DEEPSEEK_API_KEY|ANTHROPIC_API_KEY|GITHUB_TOKEN|github_pat_|ghp_|AKIA|sk-ant-|xox[baprs]-"),
)
MEDIUM_SIGNALS = (
    ("shell-tool", r"(?i)(?<![A-Za-z0-9_])(?:curl|wget|powershell|cmd\.exe|bash|sh|nc|ncat|socat)(?![A-Za-z0-9_])"),
    ("credential-path", r"(?i)\.ssh|\.npmrc|\.aws|\.netrc|kubeconfig|id_rsa|id_ed25519"),
)
MAX_BINARIES = 500


def signals(data: Column, pairs: tuple) -> Column:
    text = F.decode(data, "ISO-8859-1")
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in pairs)))


def binary_findings(binaries: DataFrame, most: int = MAX_BINARIES) -> DataFrame:
    """Findings about binaries (package, path, data, entropy): a module or a native file (info), entropy above the limit (medium),
    and telling strings (high, or medium for tools and paths only). Of each package the first `most` files by path are
    looked at; the rest are counted by skipped()."""
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("package").orderBy("path"))
    rows = binaries.withColumn("k", k).where(F.col("k") <= most)
    rows = rows.select("package", "path", kind(F.col("data")).alias("kind"), "entropy", signals(F.col("data"), HIGH_SIGNALS).alias("high"), signals(F.col("data"), MEDIUM_SIGNALS).alias("medium"))
    one = lambda rule, severity, detail: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
    found = F.array(
        F.when(F.col("kind") == "wasm", one("SEN-WASM-001", "info", F.col("kind"))).otherwise(one("SEN-BIN-001", "info", F.col("kind"))),
        F.when(F.col("entropy") > ENTROPY_LIMIT, one("SEN-BIN-003", "medium", F.col("entropy"))),
        F.when(F.size("high") > 0, one("SEN-BIN-002", "high", F.array_join("high", ", "))).when(F.size("medium") > 0, one("SEN-BIN-002", "medium", F.array_join("medium", ", "))),
    )
    return rows.select("package", "path", F.explode(F.array_compact(found)).alias("f")).select("package", "path", "f.*")


def skipped(binaries: DataFrame, most: int = MAX_BINARIES) -> DataFrame:
    """package and the number of its binaries beyond the limit."""
    return binaries.groupBy("package").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("skipped"))
