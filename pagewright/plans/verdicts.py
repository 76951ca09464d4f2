"""Reviewers' verdicts become results: the first verdict of a check counts, missing fields come from measurements, then the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assemble(verdicts: DataFrame, measured: DataFrame, catalog: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, check_id, gate, severity, confidence, title, evidence, evidence_quality, urls, reason).

    verdicts: (site_id, ord, check_id, gate, severity, confidence, title, evidence, urls, reason); measured: (site_id, check_id,
    evidence); sites: (site_id, skill_id), the skills that submit verdicts. Every check of such a skill without a verdict is not_evaluated."""
    turn = F.row_number().over(Window.partitionBy("site_id", "check_id").orderBy("ord"))
    rows = verdicts.where("check_id is not null").withColumn("turn", turn).where("turn = 1")
    gate = F.when(F.col("gate").isin("finding", "pass", "not_evaluated"), F.col("gate")).otherwise("not_evaluated")
    rows = rows.withColumn("gate", gate).join(measured.select("site_id", "check_id", F.col("evidence").alias("measured")), ["site_id", "check_id"], "left")
    rows = rows.join(F.broadcast(catalog.select("check_id", "severity_band")), "check_id", "left")
    found, none = F.col("gate") == "finding", F.lit(None).cast("string")
    worst = F.coalesce(F.get("severity_band", F.lit(0)), F.lit("medium"))
    out = rows.select(
        "site_id", "check_id", "gate", F.when(found, F.coalesce("severity", worst)).otherwise(none).alias("severity"), F.when(found, F.coalesce("confidence", F.lit("medium"))).otherwise(none).alias("confidence"),
        F.when(found, F.coalesce("title", "check_id")).otherwise(none).alias("title"), F.when(found, F.coalesce("evidence", "measured", F.lit(""))).otherwise(none).alias("evidence"),
        F.when(F.col("gate") != "not_evaluated", "semantic-judgment").alias("evidence_quality"), F.when(found, F.col("urls")).alias("urls"),
        F.when(F.col("gate") == "not_evaluated", F.coalesce("reason", F.lit("not judged"))).alias("reason"),
    )
    owed = sites.join(F.broadcast(catalog.select("skill_id", "check_id")), "skill_id").select("site_id", "check_id").join(out.select("site_id", "check_id"), ["site_id", "check_id"], "left_anti")
    silent = owed.select("site_id", "check_id", F.lit("not_evaluated").alias("gate"), *[none.alias(c) for c in ("severity", "confidence", "title", "evidence", "evidence_quality")], F.lit(None).cast("array<string>").alias("urls"), F.lit("no verdict").alias("reason"))
    return out.unionByName(silent)
