"""What a report says about itself: decisions to drop work, limits, status, lint warnings, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T

# Wording that no report may use, each with what is wrong about it.
FORBIDDEN = (
    (r"(?i)\bFAQPage\b", "retired schema"),
    (r"(?i)\bHowTo\b", "retired schema"),
    (r"(?i)llms\.txt.{0,80}(rank|discover|citation|visibility)", "llms.txt as a ranking factor"),
    (r"(?i)\b(CLS|LCP|INP)\b[^.]{0,40}\d", "a made-up web vital"),
    (r"(?i)\bguarantee", "a guarantee"),
    (r"(?i)\bwill (rank|be cited|appear)", "a predicted outcome"),
    (r"(?i)\bIndexNow\b", "receipt is not indexing"),
)
LEAKED = ((r"is_soft_404", "a field name in evidence"), (r"snapshot\s*\.\s*[a-z_]+", "a field name in evidence"))
BUDGET_SECONDS = 300


def shed_argument(raw: Column) -> Column:
    """(what, at_seconds, reason) of 'what@seconds:reason'; seconds are 0 and reason null where they are missing or odd; null without what."""
    text = F.trim(T.text_of(raw))
    head = F.regexp_extract(text, r"(?s)^([^:]*)", 1)
    reason = F.substring(F.trim(F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1)), 1, 300)
    what = F.substring(F.trim(F.regexp_extract(head, r"(?s)^([^@]*)", 1)), 1, 120)
    seconds = F.trim(F.regexp_extract(head, r"(?s)^[^@]*@(.*)$", 1))
    number = F.when(seconds.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.coalesce(seconds.try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
    at = F.greatest(F.lit(0), number.cast("int"))
    return F.when(what != "", F.struct(what.alias("what"), at.alias("at_seconds"), F.nullif(reason, F.lit("")).alias("reason")))


def limitations(runs: DataFrame, shed: DataFrame, budget: int = BUDGET_SECONDS) -> DataFrame:
    """(site_id, status, limitations): complete, or partial where nothing was captured or work was dropped; and what limits the report.

    runs: (site_id, pages_selected, fragments, degraded boolean, seconds); shed: (site_id, ord, what, at_seconds, reason)."""
    line = F.format_string(f"Shed at %ds to stay inside the {budget}s budget: %s%s", F.col("at_seconds"), F.col("what"), F.coalesce(F.concat(F.lit(" ("), F.col("reason"), F.lit(")")), F.lit("")))
    dropped = shed.groupBy(F.col("site_id").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]).alias("dropped"))
    rows = runs.join(dropped, F.col("site_id") == F.col("s"), "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<string>")))
    nothing = F.coalesce(F.col("pages_selected") == 0, F.col("degraded"))
    said = F.array_compact(F.array(
        F.when(F.col("degraded"), "Single-skill degraded mode: the judgment checks are not_evaluated."),
        F.when((F.col("fragments") == 0) & ~F.col("degraded"), "No specialist fragments were loaded; every check is not_evaluated by backfill."),
        F.when(nothing, "No pages were captured; runnable checks are not_evaluated."),
        F.when(F.col("seconds").isNull(), "Runtime was not measured for this run."),
        F.when(F.col("seconds") > budget, F.format_string(f"This audit took %ds against a {budget}s budget; the report is complete.", F.col("seconds"))),
    ))
    status = F.when(nothing | (F.size("dropped") > 0), "partial").otherwise("complete")
    return rows.select("site_id", status.alias("status"), F.concat(said, F.col("dropped")).alias("limitations"))


def never_claims(texts: DataFrame) -> DataFrame:
    """(site_id, field, warning): texts that a report should not hold; warnings only. texts: (site_id, field, text)."""
    rules = [(r, w, "evidence", False) for r, w in FORBIDDEN] + [(r, w, "evidence", True) for r, w in LEAKED]
    warned = [F.when(F.col("text").rlike(r) & ((F.col("field") == field) == of_field), F.lit(w)) for r, w, field, of_field in rules]
    return texts.select("site_id", "field", F.explode(F.array_compact(F.array(*warned))).alias("warning"))


def fragment_summary(results: DataFrame, left_out: DataFrame) -> DataFrame:
    """(site_id, findings, passes, not_evaluated); results: (site_id, gate); left_out: (site_id), the checks that have no result."""
    more = left_out.groupBy(F.col("site_id").alias("s")).agg(F.count("*").alias("more"))
    n = lambda gate: F.count_if(F.col("gate") == gate)
    rows = results.groupBy("site_id").agg(n("finding").alias("findings"), n("pass").alias("passes"), n("not_evaluated").alias("reported")).join(more, F.col("site_id") == F.col("s"), "left")
    return rows.select("site_id", "findings", "passes", (F.col("reported") + F.coalesce("more", F.lit(0))).alias("not_evaluated"))


def human_summary(findings: DataFrame, open_items: DataFrame) -> DataFrame:
    """(site_id, summary): the order in which to fix a site's findings, in words.

    findings: (site_id, place, severity, title, action, effort, owner, acceptance_test); open_items: (site_id, needs_verification,
    not_evaluated), a row for every site."""
    bits = F.array_compact(F.array(F.concat(F.lit("effort: "), "effort"), F.concat(F.lit("owner: "), "owner")))
    fix = F.concat(F.lit("   Fix: "), F.coalesce("action", F.lit("")), F.when(F.size(bits) > 0, F.concat(F.lit(" ("), F.array_join(bits, ", "), F.lit(")"))).otherwise(""))
    lines = F.concat_ws("\n", F.concat(F.col("place").cast("string"), F.lit(". ["), F.upper("severity"), F.lit("] "), "title"), fix, F.concat(F.lit("   Verify: "), "acceptance_test"))
    told = findings.groupBy(F.col("site_id").alias("s")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", lines.alias("lines")))), lambda x: x["lines"]), "\n").alias("lines"))
    rows = open_items.join(told, F.col("site_id") == F.col("s"), "left")
    verify = F.when(F.col("needs_verification") > 0, F.format_string("%d item(s) need verification before they can be called defects.", "needs_verification"))
    silent = F.when(F.col("not_evaluated") > 0, F.format_string("%d check(s) were not evaluated; that is not a defect.", "not_evaluated"))
    head = F.format_string("Audit of %s: %d finding(s). Fix in this order:", F.col("site_id"), F.coalesce("n", F.lit(0)))
    return rows.select("site_id", F.concat_ws("\n", head, F.col("lines"), verify, silent).alias("summary"))


