"""Captures as a stream: the latest capture of every page, and fetch times by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T

SCHEMA = "page_id long, url string, html string, status int, timing_ms long, captured_at timestamp"


def read_captures(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Capture files as they arrive; a capture that is told twice within the lateness counts once."""
    rows = spark.readStream.schema(SCHEMA).json(folder).withWatermark("captured_at", late)
    return rows.withColumn("site_id", T.netloc(F.col("url"))).dropDuplicatesWithinWatermark(["url", "captured_at"])


def fetch_windows(captures: DataFrame, width: str = "10 minutes") -> DataFrame:
    """(window, site_id, fetches, failures, mean_ms) by event time; append mode gives a window once it is over."""
    bad = F.coalesce(F.col("status") >= 400, F.lit(True))
    return captures.groupBy(F.window("captured_at", width), "site_id").agg(F.count("*").alias("fetches"), F.count_if(bad).alias("failures"), F.round(F.avg("timing_ms"), 1).alias("mean_ms"))


def keep_latest(captures: DataFrame, table: str, checkpoint: str):
    """Maintain a Parquet table with the latest capture of every url; each batch is merged into a new version beside the old one.

    Returns the query. The table's folder holds versions by batch number; readers take the greatest that is complete."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("url", F.struct(*[c for c in batch.columns if c != "url"]).alias("c"))
        before = latest_version(spark, table, number)
        rows = new if before is None else new.unionByName(spark.read.parquet(f"{table}/{before}"))
        rows.groupBy("url").agg(F.max_by("c", "c.captured_at").alias("c")).write.mode("overwrite").parquet(f"{table}/{number}")

    return captures.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def latest_version(spark: SparkSession, table: str, below: int | None = None) -> int | None:
    """The greatest complete version, below a given one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [f.getPath() for f in files.listStatus(path)]
    done = [int(p.getName()) for p in names if p.getName().isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max((n for n in done if below is None or n < below), default=None)
