"""Cleaning and mixing of a training corpus in stages, each over all that the one before has kept.

toxicity          documents that the network scores at 0.5 or more go
line_dedup        later copies of repeated line runs (3 lines, a line of 200 characters, or over 50 words) are cut out of the texts; a text of which nothing is left goes
near_duplicates   of each component of documents with 5-word similarity of 0.8 or more, one stays
decontaminate     documents with 10 consecutive words of a benchmark item go
mix               documents are drawn to the target weights of their sources, in permuted blocks

All stages but the last return the columns of documents; n_chars, where there is one, follows the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from sievework.llm.common import drop_written, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores less than 0.5. Null and empty texts stay; repeated rows are treated alike."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, net)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their later copies of repeated runs. Null and empty texts stay as they are; a text of which nothing is left goes; rows that
    agree in doc_id and text are one document; of equal doc_ids the text's hash decides which is later."""
    out = line_dedup.line_dedup(docs, min_words=line_dedup.MIN_WORDS)
    left = F.col("text").isNull() | (F.col("text") != "") | (F.size("dedup_runs") == 0)
    out = out.where(left).drop("dedup_runs")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component. Null, empty and blank texts all stay; ties and repeated rows are decided as in deduplicate()."""
    return jaccard_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Null and empty texts stay; repeated rows are treated alike; an empty benchmark drops nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as they are drawn, with mix_ columns. Null sources are one source; null and empty texts have no tokens; ties, repeated
    rows and empty tables are as in mix_sources()."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
]

#: The first stage is a trained network, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, and deleted once the next
    stage's are there. The rows that the last stage reads stay until the folder is cleared."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            drop_written(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
