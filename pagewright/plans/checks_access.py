"""Access checks: can an automated reader reach the pages?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import robots as R
from pagewright.operators import urls as U

from .results import Frames, check, gated



def per_site(frames: Frames, rows: DataFrame) -> DataFrame:
    """rows, one a site, and a row of nulls for each other site."""
    return frames["sites"].select("site_id", "base_url").join(rows, "site_id", "left")


def important(frames: Frames) -> DataFrame:
    return frames["pages"].where(F.coalesce("page_class", F.lit("other")).isin(*U.IMPORTANT))


def with_important(frames: Frames, rows: DataFrame) -> DataFrame:
    """rows, one a site, and how many important pages there are: with none there is nothing to decide."""
    count = important(frames).groupBy(F.col("site_id").alias("i_site")).agg(F.count("*").alias("important"))
    return rows.join(count, F.col("site_id") == F.col("i_site"), "left").drop("i_site").withColumn("no_page", F.col("important").isNull())


def urls_where(flag, most: int | None = None):
    """The urls of the rows where flag holds, in page order."""
    sorted_ = F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("page_ord", "url")))), lambda x: x["url"])
    return F.slice(sorted_, 1, most) if most else sorted_


@check("ACC-ROBOTS-ROLE", "pages", "robots")
def robots_role(frames: Frames) -> DataFrame:
    pages = important(frames).select("site_id", "url", "page_ord", T.norm_path(F.col("url")).alias("path"))
    tokens = frames["robots"].where("role = 'search-index'").select("site_id", "token").distinct()
    blocked = R.decide_paths(pages, frames["robots"], tokens).where("blocked").select("site_id", "token", "path", "rule")
    hits = pages.join(blocked, ["site_id", "path"])
    rows = hits.groupBy("site_id").agg(F.array_sort(F.collect_set("url")).alias("urls"), F.max(F.col("path") == "/").alias("whole"), F.array_join(F.array_sort(F.collect_set(F.concat("token", F.lit(": "), "rule"))), "; ").alias("rules"))
    rows = with_important(frames, per_site(frames, rows).join(frames["sites"].select("site_id", "robots_status"), "site_id"))
    finding = F.col("urls").isNotNull() & (F.coalesce("robots_status", F.lit("ok")) != "not_found")
    return gated(rows, "ACC-ROBOTS-ROLE", finding, severity=F.when(F.col("whole"), "critical").otherwise("high"), title="Answer-index crawlers are disallowed on important pages", evidence=F.concat(F.lit("robots.txt disallows "), F.col("rules")), urls=F.col("urls"), skip=(F.col("robots_status") == "error") | F.col("no_page"))


@check("ACC-ROBOTS-UNAVAILABLE")
def robots_unavailable(frames: Frames) -> DataFrame:
    rows = frames["sites"]
    confidence = F.when(F.coalesce("robots_attempts", F.lit(1)) >= 2, "high").otherwise("low")
    evidence = F.format_string("robots.txt answered %s in %s attempt(s)", F.coalesce(F.col("robots_http_status").cast("string"), F.lit("nothing")), F.coalesce("robots_attempts", F.lit(1)).cast("string"))
    return gated(rows, "ACC-ROBOTS-UNAVAILABLE", F.col("robots_status") == "error", severity="high", confidence=confidence, title="robots.txt is unavailable to crawlers", evidence=evidence, urls=F.array(F.concat("base_url", F.lit("/robots.txt"))))


def page_directives(frames: Frames) -> DataFrame:
    """Important pages with flags of their robots meta and header together; a header's directive wins."""
    rows = important(frames).withColumn("d", F.map_zip_with(T.directives(F.col("robots_meta")), T.directives(F.col("x_robots_tag")), lambda k, a, b: F.coalesce(b, a)))
    has = lambda k: F.map_contains_key("d", k)
    no_snippet = has("nosnippet") | (has("max-snippet") & F.coalesce(F.try_element_at("d", F.lit("max-snippet")), F.lit("")).isin("0", ""))
    return rows.select("site_id", "page_ord", "url", T.norm_path(F.col("url")).alias("path"), (has("noindex") | has("none")).alias("noindex"), no_snippet.alias("nosnippet"), (has("noarchive") | has("nocache")).alias("nocache"), has("noarchive").alias("noarchive"))


@check("ACC-INDEX-CONTROL", "pages")
def index_control(frames: Frames) -> DataFrame:
    """May yield two results a site: noindex, and snippet limits on pages that are not noindex."""
    rows = page_directives(frames)
    probes = frames.get("ua_probes")
    if probes is not None:
        clean = probes.where((F.col("status") == 200) & ~T.text_of(F.lower("robots_meta")).contains("noindex") & ~T.text_of(F.lower("x_robots_tag")).contains("noindex"))
        rows = rows.join(clean.select("site_id", T.norm_path(F.col("requested_path")).alias("path"), F.lit(True).alias("clean")).distinct(), ["site_id", "path"], "left")
    else:
        rows = rows.withColumn("clean", F.lit(None).cast("boolean"))
    noindex, snippet = F.col("noindex"), F.col("nosnippet") & ~F.col("noindex")
    agg = rows.groupBy("site_id").agg(F.count("*").alias("n"), urls_where(noindex).alias("a"), urls_where(snippet).alias("b"), F.max(noindex & (F.col("path") == "/")).alias("whole"), F.max(noindex & F.col("clean")).alias("tiered"))
    agg = per_site(frames, agg)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    first = gated(agg, "ACC-INDEX-CONTROL", some("a"), severity=F.when(F.col("whole"), "critical").otherwise("high"), confidence=F.when(F.col("tiered"), "low").otherwise("high"), title="noindex on important pages", evidence=F.format_string("%d of %d important pages carry noindex", F.size("a"), F.col("n")), urls=F.col("a"), skip=F.col("n").isNull())
    second = gated(agg, "ACC-INDEX-CONTROL", some("b"), severity="high", title="Snippets are switched off on important pages", evidence=F.format_string("%d of %d important pages carry nosnippet or max-snippet:0", F.size("b"), F.col("n")), urls=F.col("b"))
    both = first.where("gate = 'finding'").unionByName(second.where("gate = 'finding'"))
    return both.unionByName(first.join(both.select("site_id").distinct(), "site_id", "left_anti"))


@check("ACC-NOARCHIVE-COPILOT", "pages")
def noarchive(frames: Frames) -> DataFrame:
    agg = with_important(frames, per_site(frames, page_directives(frames).groupBy("site_id").agg(urls_where(F.col("nocache")).alias("urls"), F.max(F.col("noarchive")).alias("hard"))))
    return gated(agg, "ACC-NOARCHIVE-COPILOT", F.coalesce(F.size("urls"), F.lit(0)) > 0, severity=F.when(F.col("hard"), "high").otherwise("medium"), title="Archive limits on important pages", evidence=F.format_string("%d pages carry noarchive or nocache", F.size("urls")), urls=F.col("urls"), skip=F.col("no_page"))


@check("ACC-CANONICAL-CONFLICT", "pages")
def canonical_conflict(frames: Frames) -> DataFrame:
    pages = frames["pages"]
    bad = U.canonical_conflicts(pages.select("site_id", "url", "final_url", "canonical", "chain")).join(pages.select("site_id", "url", "page_ord"), ["site_id", "url"])
    agg = bad.groupBy("site_id").agg(F.count("*").alias("n"), F.count_distinct("target_key").alias("targets"), F.count_if("redirected").alias("moved"), urls_where(F.col("redirected")).alias("moved_urls"), urls_where(F.lit(True)).alias("all_urls"))
    total = pages.groupBy("site_id").agg(F.count("*").alias("pages"))
    agg = per_site(frames, agg).join(total, "site_id", "left")
    finding = (F.col("n") > 0) & ~((F.col("n") >= 2) & (F.col("targets") == 1))
    moved = F.col("moved") > 0
    severity = F.when(moved & (F.col("moved") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2))), "high").otherwise("medium")
    confidence = F.when(moved, "high").when(F.col("n") <= 2, "low").otherwise("medium")
    return gated(agg, "ACC-CANONICAL-CONFLICT", finding, severity=severity, confidence=confidence, title="Canonical declarations disagree with where pages are served", evidence=F.format_string("%d of %d pages name another canonical", F.col("n"), F.col("pages")), urls=F.when(moved, F.col("moved_urls")).otherwise(F.col("all_urls")))


@check("ACC-REDIRECT-LOOP", "pages")
def redirect_loop(frames: Frames) -> DataFrame:
    pages = frames["pages"]
    shapes = U.redirect_shapes(pages.select("site_id", "url", F.coalesce("chain", F.array().cast("array<string>")).alias("chain"))).join(pages.select("site_id", "url", "page_ord"), ["site_id", "url"])
    agg = per_site(frames, shapes.groupBy("site_id").agg(urls_where(F.col("loops")).alias("loops"), urls_where(F.col("long_chain")).alias("chains")))
    return gated(agg, "ACC-REDIRECT-LOOP", F.size(F.concat("loops", "chains")) > 0, severity=F.when(F.size("loops") > 0, "high").otherwise("medium"), title="Important urls redirect through loops or long chains", evidence=F.format_string("%d loop, %d take 4 hops or more", F.size("loops"), F.size("chains")), urls=F.concat("loops", "chains"))


@check("ACC-BOT-CHALLENGE", "ua_probes")
def bot_challenge(frames: Frames) -> DataFrame:
    odd = F.col("status").isin(401, 403, 429, 503) & (F.col("status") != F.col("browser_status"))
    rows = frames["ua_probes"].where(odd).groupBy("site_id").agg(F.array_sort(F.collect_set("requested_path")).alias("urls"), F.array_join(F.array_sort(F.collect_set(F.concat("token", F.lit(" received "), F.col("status").cast("string")))), "; ").alias("said"))
    return gated(per_site(frames, rows), "ACC-BOT-CHALLENGE", F.col("urls").isNotNull(), severity="high", confidence="medium", title="Automated readers are challenged where browsers are served", evidence=F.col("said"), urls=F.col("urls"))


@check("ACC-SITEMAP-ORPHAN", "pages", "sitemaps", "sitemap_entries")
def sitemap_orphan(frames: Frames) -> DataFrame:
    sites = frames["sites"].select("site_id", T.netloc(F.col("base_url")).alias("netloc"))
    links = frames["pages"].select("site_id", F.explode("links.href").alias("href")).join(sites, "site_id")
    found = U.sitemap_orphans(frames["sitemap_entries"].select("site_id", "url"), links, frames["pages"].select("site_id", "url"))
    agg = per_site(frames, found.groupBy("site_id").agg(F.slice(F.array_sort(F.collect_list("url")), 1, 5).alias("urls"), F.count("*").alias("n"), F.max("important").alias("top")))
    agg = agg.join(frames["sites"].select("site_id", "candidates_count"), "site_id").join(frames["sitemaps"].select("site_id", "parse_ok"), "site_id", "left")
    finding = (F.col("n") > 0) & (F.col("candidates_count") >= 50) & F.col("parse_ok")
    return gated(agg, "ACC-SITEMAP-ORPHAN", finding, severity=F.when(F.col("top"), "medium").otherwise("low"), confidence="medium", title="Sitemap urls that no sampled page links to", evidence=F.format_string("%d sampled sitemap urls have no internal link", F.col("n")), urls=F.col("urls"))


@check("ACC-SITEMAP-INVALID", "sitemaps")
def sitemap_invalid(frames: Frames) -> DataFrame:
    rows = per_site(frames, frames["sitemaps"].select("site_id", F.col("url").alias("sitemap"), "http_status", "parse_ok"))
    bad = ~F.coalesce("parse_ok", F.lit(True)) | (F.coalesce("http_status", F.lit(200)) >= 400)
    return gated(rows, "ACC-SITEMAP-INVALID", F.col("sitemap").isNotNull() & bad, title="The declared sitemap cannot be used", evidence=F.format_string("status %s", F.col("http_status").cast("string")), urls=F.array("sitemap"))


@check("ACC-HREFLANG-INCONSISTENT", "pages")
def hreflang(frames: Frames) -> DataFrame:
    pages = frames["pages"]
    alternates = pages.select("site_id", "url", F.explode("hreflang").alias("h")).select("site_id", "url", "h.lang", "h.href")
    problems = U.hreflang_problems(pages.select("site_id", "url", "lang"), alternates)
    agg = per_site(frames, alternates.groupBy("site_id").agg(F.count("*").alias("declared"))).join(problems.groupBy("site_id").agg(F.slice(F.array_sort(F.collect_set("url")), 1, 5).alias("urls"), F.count("*").alias("n")), "site_id", "left")
    return gated(agg, "ACC-HREFLANG-INCONSISTENT", F.col("n") > 0, title="Locale alternates are missing or wrong", evidence=F.format_string("%d hreflang problems", F.col("n")), urls=F.col("urls"), skip=F.col("declared").isNull())


@check("ACC-LLMS-TXT-ABSENT")
def llms_txt(frames: Frames) -> DataFrame:
    docs = F.array_contains(F.coalesce("site_types", F.array().cast("array<string>")), "docs-developer")
    return gated(frames["sites"], "ACC-LLMS-TXT-ABSENT", ~F.coalesce("has_llms_txt", F.lit(False)), severity="low", title="A documentation site without llms.txt", evidence="/llms.txt offers no index", urls=F.array(F.concat("base_url", F.lit("/llms.txt"))), skip=~docs)


@check("ACC-LINK-ROT", "link_probes")
def link_rot(frames: Frames) -> DataFrame:
    probes = frames["link_probes"]
    bad = probes.where(U.rotted(F.col("status"))).groupBy("site_id").agg(F.slice(F.array_sort(F.collect_list("url")), 1, 5).alias("urls"))
    rows = per_site(frames, U.link_rot(probes)).join(bad, "site_id", "left")
    return gated(rows, "ACC-LINK-ROT", F.col("rotted") > 0, severity=F.col("severity"), confidence="medium", title="Sampled internal links return errors", evidence=F.format_string("%d of %d sampled links return errors", F.col("rotted"), F.col("sampled")), urls=F.col("urls"), skip=F.col("sampled").isNull())


@check("ACC-FETCH-LATENCY", "pages")
def latency(frames: Frames) -> DataFrame:
    rows = per_site(frames, U.fetch_latency(frames["pages"].select("site_id", "timing_ms", "status")))
    return gated(rows, "ACC-FETCH-LATENCY", F.col("severity").isin("medium", "high"), severity=F.col("severity"), confidence="medium", title="Pages are slow to fetch", evidence=F.format_string("median %d ms over %d fetches", F.col("median_ms"), F.col("n")), urls=F.array("base_url"), skip=F.col("n").isNull() | (F.col("severity") == "not_evaluated"))
