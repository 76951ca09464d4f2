"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, documents that leak the benchmark go,
secrets are masked, and what is left is mixed to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontamination, jaccard_join, mixing, secret_scan, toxicity
from pagewright.llm.common import free_names, quoted, release, remove, scratch
from pagewright.llm.queries import table

#: Score from which a document is toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    release(spark)
    score = free_names(docs.columns, "score")["score"]
    return toxicity.score_column(docs, machine, docs.columns, score).where(F.col(score) < TOXIC).select(*quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.masked(docs, docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(mixing.mix_sources(docs, columns=docs.columns), docs.count())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", mask_secrets),
    ("mixing", mix),
]

#: A trained model, a transitive closure over set similarities and a latent index decide; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir. A stage's table goes when the next one's is written."""
    folder, before = scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
