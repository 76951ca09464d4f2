"""Referral checks: what a visitor who follows a citation meets. All are prepared here and completed by a reviewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks_access import per_site, urls_where
from .results import Frames, check, gated


@check("REF-SOFT-404", "missing_probe")
def soft_404(frames: Frames) -> DataFrame:
    rows = per_site(frames, frames["missing_probe"].select("site_id", "probe_path", "status"))
    return gated(rows, "REF-SOFT-404", F.col("status") == 200, severity="medium", title="Missing pages answer 200", evidence=F.format_string("%s returned %d", F.col("probe_path"), F.col("status")), urls=F.array(F.concat("base_url", "probe_path")), skip=F.col("status").isNull(), open_=True)


@check("REF-404-DEAD-END", "missing_probe")
def dead_end(frames: Frames) -> DataFrame:
    rows = per_site(frames, frames["missing_probe"].select("site_id", "probe_path", "status", "has_search", "has_navigation", "has_suggestions"))
    empty = ~F.col("has_search") & ~F.col("has_navigation") & ~F.col("has_suggestions")
    return gated(rows, "REF-404-DEAD-END", (F.col("status") == 404) & empty, severity="low", title="The error page leads nowhere", evidence=F.format_string("%s returned %d without search, navigation or suggestions", F.col("probe_path"), F.col("status")), urls=F.array(F.concat("base_url", "probe_path")), skip=F.col("status").isNull(), open_=True)


@check("REF-PATH-DROP-REDIRECT", "redirect_variants")
def path_drop(frames: Frames) -> DataFrame:
    """Any readable variant that drops the path is a finding; variants without a readable answer say nothing."""
    readable = F.col("path_preserved").isNotNull() & F.coalesce("variant_ok", F.lit(True))
    agg = per_site(frames, frames["redirect_variants"].groupBy("site_id").agg(F.count_if(~F.col("path_preserved")).alias("dropped"), F.count_if(readable).alias("readable"), F.count("*").alias("n")))
    return gated(agg, "REF-PATH-DROP-REDIRECT", F.col("dropped") > 0, severity="high", title="Redirects drop the path", evidence=F.format_string("%d of %d variants drop the path", F.col("dropped"), F.col("n")), urls=F.array("base_url"), skip=F.coalesce(F.col("dropped") + F.col("readable"), F.lit(0)) == 0, open_=True)


def _pages(check_id: str, flag, title: str, severity="medium"):
    def run(frames: Frames) -> DataFrame:
        rows = frames["pages"].withColumn("flag", F.coalesce(flag(), F.lit(False)))
        agg = per_site(frames, rows.groupBy("site_id").agg(F.count_if("flag").alias("n"), F.count("*").alias("pages"), urls_where(F.col("flag"), 8).alias("urls")))
        sev = severity() if callable(severity) else severity
        return gated(agg, check_id, F.col("n") > 0, severity=sev, confidence="medium", title=title, evidence=F.format_string("%d of %d sampled pages", F.col("n"), F.col("pages")), urls=F.col("urls"), skip=F.col("pages").isNull(), open_=True)

    check(check_id, "pages")(run)


_pages("REF-COLLAPSED-ANSWER", lambda: F.col("details_elements") > F.col("details_open"), "Answers are collapsed by default")
_pages("REF-OVERLAY-BLOCK", lambda: F.col("overlay"), "An overlay may cover the page", "low")
_pages("REF-PERF-RISK", lambda: (F.col("images_without_dimensions") > 0) | (F.col("render_blocking_head_scripts") > 0), "Images without dimensions or blocking scripts", "low")
_pages("REF-VIEWPORT-ABSENT", lambda: ~F.col("has_viewport_meta"), "Pages without a viewport declaration", lambda: F.when(F.col("n") == F.col("pages"), "high").otherwise("medium"))


@check("REF-FRAGMENT-UNSURVIVABLE", "passage_checks")
def fragment(frames: Frames) -> DataFrame:
    agg = per_site(frames, frames["passage_checks"].groupBy("site_id").agg(F.count_if(~F.col("contiguous")).alias("n"), F.count("*").alias("passages")))
    return gated(agg, "REF-FRAGMENT-UNSURVIVABLE", F.col("n") > 0, severity="low", confidence="medium", title="Passages that no text fragment can reach", evidence=F.format_string("%d of %d passages are not contiguous", F.col("n"), F.col("passages")), urls=F.array("base_url"), skip=F.col("passages").isNull(), open_=True)


@check("REF-ANSWER-NOT-CONFIRMED", "passage_checks")
def not_confirmed(frames: Frames) -> DataFrame:
    agg = per_site(frames, frames["passage_checks"].where("in_window is not null").groupBy("site_id").agg(F.count_if(~F.col("in_window")).alias("n"), F.count("*").alias("passages")))
    return gated(agg, "REF-ANSWER-NOT-CONFIRMED", F.col("n") > 0, severity="low", confidence="medium", title="Answers stand below the first screen", evidence=F.format_string("%d of %d passages begin late", F.col("n"), F.col("passages")), urls=F.array("base_url"), skip=F.col("passages").isNull(), open_=True)
