"""The report: routing, deduplication, coverage, root causes, numbering, clamps, lints and counts, as one DataFrame plan.

Input is the results relation with a unique ord that stands for the order of arrival; wherever the first of several wins, ord decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T

# Which probes must quote a status, and which symptoms one cause absorbs.
STATUS_CHECKS = ("REF-SOFT-404", "ACC-BOT-CHALLENGE")
ROOT_CAUSE, SYMPTOMS = "REP-KEY-FACT-LOSS", ("REP-LINKS-SCRIPT-ONLY", "REP-EXTRACTION-LOSS")
CITED_ID = r"\b[A-Z]{3}-[A-Z0-9][A-Z0-9-]{2,}\b"


def severity_rank(c):
    return F.when(c == "critical", 0).when(c == "high", 1).when(c == "medium", 2).when(c == "low", 3).otherwise(4)


def probe_demotion(results: DataFrame) -> DataFrame:
    """Probe findings that quote no three-digit status become not_evaluated."""
    silent = (F.col("gate") == "finding") & F.col("check_id").isin(*STATUS_CHECKS) & ~T.text_of(F.col("evidence")).rlike(r"\b[0-9]{3}\b")
    return results.withColumn("gate", F.when(silent, "not_evaluated").otherwise(F.col("gate")))


def route_results(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """results with route: passed, not_evaluated, needs_verification or finding. Unknown ids of findings are not_evaluated."""
    rows = probe_demotion(results).join(F.broadcast(catalog.select("check_id", F.lit(True).alias("known"))), "check_id", "left")
    gate, route = F.col("gate"), F.lit("finding")
    route = F.when(F.col("known").isNull(), "not_evaluated").otherwise(route)
    route = F.when(F.col("confidence") == "low", "needs_verification").otherwise(route)
    route = F.when((gate == "pass") & (F.col("evidence_quality") == "hypothesis"), "not_evaluated").when(gate == "pass", "passed").when(gate == "not_evaluated", "not_evaluated").otherwise(route)
    return rows.withColumn("route", route).drop("known")


def finding_dedup(findings: DataFrame) -> DataFrame:
    """One finding for each check and set of urls: the first."""
    urls = F.array_sort(F.coalesce("urls", F.array().cast("array<string>")))
    turn = F.row_number().over(Window.partitionBy("site_id", "check_id", urls).orderBy("ord"))
    return findings.withColumn("turn", turn).where("turn = 1").drop("turn")


def root_cause_merge(findings: DataFrame) -> DataFrame:
    """Symptoms that share a url with their site's first root cause go, and are named in its evidence."""
    turn = F.row_number().over(Window.partitionBy("site_id").orderBy("ord"))
    cause = findings.where(F.col("check_id") == ROOT_CAUSE).withColumn("t", turn).where("t = 1").select("site_id", F.col("urls").alias("cause_urls"), F.col("ord").alias("cause_ord"))
    rows = findings.join(cause, "site_id", "left")
    gone = F.coalesce(F.col("check_id").isin(*SYMPTOMS) & F.arrays_overlap("urls", "cause_urls"), F.lit(False))
    rows = rows.withColumn("gone", gone)
    told = rows.where("gone").groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_set("check_id")), ", ").alias("symptoms"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))), ", ").alias("where"))
    rows = rows.where("not gone").join(told, "site_id", "left")
    more = F.concat("evidence", F.lit(" Same cause: "), "symptoms", F.lit(" on "), "where", F.lit("."))
    is_cause = (F.col("ord") == F.col("cause_ord")) & F.col("symptoms").isNotNull()
    return rows.withColumn("evidence", F.when(is_cause, more).otherwise(F.col("evidence"))).drop("cause_urls", "cause_ord", "gone", "symptoms", "where")


def finding_ids(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Numbered by severity and check, then clamped: critical without high confidence is high but keeps its place; out_of_band warns."""
    order = Window.partitionBy("site_id").orderBy(severity_rank(F.col("severity")), "check_id", "ord")
    rows = findings.withColumn("place", F.row_number().over(order)).withColumn("id", F.format_string("F-%03d", "place"))
    clamp = (F.col("severity") == "critical") & (F.coalesce("confidence", F.lit("")) != "high")
    rows = rows.withColumn("clamped", clamp).withColumn("severity", F.when(clamp, "high").otherwise(F.col("severity")))
    rows = rows.join(F.broadcast(catalog.select("check_id", "category", "severity_band")), "check_id", "left")
    return rows.withColumn("out_of_band", F.coalesce(~F.array_contains("severity_band", F.col("severity")), F.lit(False))).drop("severity_band")


def not_evaluated_backfill(routed: DataFrame, catalog: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, check_id, reason): the first reason of each check that no finding decides, and every catalog check without a result."""
    turn = F.row_number().over(Window.partitionBy("site_id", "check_id").orderBy("ord"))
    said = routed.where("route = 'not_evaluated'").withColumn("turn", turn).where("turn = 1")
    found = routed.where("route = 'finding'").select("site_id", "check_id").distinct()
    said = said.join(found, ["site_id", "check_id"], "left_anti").select("site_id", "check_id", F.lit("reported").alias("reason"))
    ids = F.array_sort(F.collect_list("check_id"))
    every = sites.select("site_id").distinct().withColumn("k", F.lit(1)).join(F.broadcast(catalog.agg(ids.alias("ids")).withColumn("k", F.lit(1))), "k").select("site_id", F.explode("ids").alias("check_id"))
    silent = every.join(routed.select("site_id", "check_id").distinct(), ["site_id", "check_id"], "left_anti")
    return said.unionByName(silent.select("site_id", "check_id", F.lit("no result").alias("reason")))


def severity_counts(findings: DataFrame, sites: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    rows = findings.groupBy("site_id").agg(F.count("severity").alias("total"), *[n(s) for s in ("critical", "high", "medium", "low")])
    return sites.select("site_id").distinct().join(rows, "site_id", "left").na.fill(0, ["total", "critical", "high", "medium", "low"])


def cited_unknown_ids(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    cited = findings.select("site_id", "check_id", F.explode(F.array_distinct(F.regexp_extract_all(T.text_of(F.col("evidence")), F.lit(CITED_ID), 0))).alias("cited")).where("cited <> check_id")
    return cited.join(F.broadcast(catalog.select(F.col("check_id").alias("cited"))), "cited", "left_anti").select("site_id", "check_id", "cited")


def opportunities(rows: DataFrame) -> DataFrame:
    """One for each title, ignoring case and outer space, the first; by priority and title; rows: (site_id, ord, title, priority)."""
    key = F.lower(F.trim("title"))
    turn = F.row_number().over(Window.partitionBy("site_id", key).orderBy("ord"))
    once = rows.withColumn("turn", turn).where("turn = 1").drop("turn")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(severity_rank(F.col("priority")), "title"))).drop("ord")


def shed_rows(rows: DataFrame) -> DataFrame:
    """The first shed decision for each thing, ignoring case; rows: (site_id, ord, what, at_seconds, reason)."""
    turn = F.row_number().over(Window.partitionBy("site_id", F.lower("what")).orderBy("ord"))
    return rows.withColumn("turn", turn).where("turn = 1").drop("turn")


def coverage(routed: DataFrame, catalog: DataFrame) -> DataFrame:
    """(site_id, checks_passed, skills): distinct passed checks and the skills that reported."""
    rows = routed.join(F.broadcast(catalog.select("check_id", "skill_id")), "check_id", "left")
    return rows.groupBy("site_id").agg(F.count_distinct(F.when(F.col("route") == "passed", F.col("check_id"))).alias("checks_passed"), F.count_distinct("skill_id").alias("skills"))


def damp_by_corroboration(findings: DataFrame, anchors: DataFrame, absence: tuple[str, ...], least: int = 3) -> DataFrame:
    """Opt-in: with `least` independent anchors that name the brand, absence findings fall one severity; anchors: (site_id, matches)."""
    rows = findings.join(anchors.select("site_id", "matches"), "site_id", "left")
    lower = (F.coalesce("matches", F.lit(0)) >= least) & F.col("check_id").isin(*absence)
    step = F.when(F.col("severity") == "critical", "high").when(F.col("severity") == "high", "medium").otherwise("low")
    return rows.withColumn("severity", F.when(lower, step).otherwise(F.col("severity"))).drop("matches")


def build_report(results: DataFrame, catalog: DataFrame, sites: DataFrame) -> dict[str, DataFrame]:
    """findings, needs_verification, not_evaluated, counts, coverage and cited of every site."""
    routed = route_results(results, catalog)
    findings = finding_ids(root_cause_merge(finding_dedup(routed.where("route = 'finding'"))), catalog)
    return {
        "findings": findings,
        "needs_verification": routed.where("route = 'needs_verification'"),
        "not_evaluated": not_evaluated_backfill(routed, catalog, sites),
        "counts": severity_counts(findings, sites),
        "coverage": coverage(routed, catalog),
        "cited": cited_unknown_ids(findings, catalog),
    }


def render(site_id: str, report: dict[str, DataFrame], most: int = 200) -> str:
    """One site's report as Markdown; the driver reads at most `most` findings of that one site."""
    counts = report["counts"].where(F.col("site_id") == site_id).first()
    lines = [f"# Retrieval readiness of {site_id}", ""]
    if counts:
        lines += [", ".join(f"{counts[s]} {s}" for s in ("critical", "high", "medium", "low")), ""]
    for f in report["findings"].where(F.col("site_id") == site_id).orderBy("place").limit(most).collect():
        lines += [f"## {f['id']} {f['title']}", f"{f['severity']}, {f['confidence']} confidence, {f['check_id']}", "", f["evidence"] or "", *(f"- {u}" for u in f["urls"] or []), ""]
    return "\n".join(lines)
