"""Representation, answer, entity and freshness checks: what an extractor gets out of the pages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import claims as C
from pagewright.operators import runs as N

from .checks_access import per_site, urls_where
from .results import Frames, check, gated

# Patterns on raw pages and descriptions.
NOSCRIPT = r"(?i)<noscript[^>]*>[^<]*(enable javascript|javascript (?:is|must be) (?:enabled|required)|you need to enable)"
EMPTY_ROOT = r"""(?i)<div[^>]*\bid=["'](root|app|__next|__nuxt|q-app)["'][^>]*>\s*</div>"""
HIDDEN_STYLE = r"""(?i)<[a-z]+[^>]*\bstyle="[^"]*(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?:\.0+)?\s*(?:px|em|pt)?\s*[;"]|left\s*:\s*-\d{3,}px|text-indent\s*:\s*-\d{3,}px)[^"]*"[^>]*>"""
HIDDEN_ALLOWED = r"""(?i)class="[^"]*(?:sr-only|visually-hidden|skip-link|show-for-sr)|aria-hidden="true"|type="hidden\""""
META_TOKEN = r"(?U)[$€£₹]\s?\d[\d,.]*|\b\d+(?:\.\d+)?\s?%|\bv?\d+\.\d+(?:\.\d+)?\b|\b(?:Free|Starter|Basic|Pro|Premium|Enterprise|Business|Team)\b"
HANDLER_PATH = r"""(?:onclick|router\.push|navigate(?:To)?|history\.push)\s*\(\s*["'](/[^"']{1,80})"""
PRICING = "(?i)price|pricing|plan|cost|billing"
NAME_REQUIRED = ("Organization", "LocalBusiness", "Product", "Brand")
IDENTITY = (*NAME_REQUIRED, "WebSite")
IDENTITY_RAW = r'"@type"\s*:\s*"(Organization|LocalBusiness|Product|Brand|WebSite)"'
INDEPENDENT = ("wikipedia.org", "wikidata.org", "crunchbase.com", "producthunt.com", "g2.com", "capterra.com", "trustpilot.com", "yelp.com", "bbb.org", "news.ycombinator.com")
OWNED = ("linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "tiktok.com", "medium.com", "substack.com", "discord.com")
REGISTRIES = ("github.com", "npmjs.com", "pypi.org", "gitlab.com")


def shell_indicators(raw, visible, title):
    """Signs of a page that is empty until scripts run."""
    bare = F.lower(T.fold(title)).isin("", "loading", "loading...", "...")
    return F.array_compact(F.array(
        F.when(T.text_of(raw).rlike(NOSCRIPT), "noscript-enable-js"),
        F.when((T.word_count(visible) < 120) & (F.length(T.text_of(raw)) > 20000), "tiny-visible-vs-raw"),
        F.when(bare, "loading-or-empty-title"),
        F.when(T.text_of(raw).rlike(EMPTY_ROOT), "empty-root-container"),
    ))


def hidden_instances(raw):
    return F.size(F.filter(F.regexp_extract_all(T.text_of(raw), F.lit(HIDDEN_STYLE), 0), lambda t: ~t.rlike(HIDDEN_ALLOWED)))


def script_only_paths(raw, hrefs):
    """Paths that only a script handler names."""
    handlers = F.array_distinct(F.regexp_extract_all(T.text_of(raw), F.lit(HANDLER_PATH), 1))
    return F.array_except(handlers, F.transform(hrefs, lambda h: T.url_part(h, "path")))


def metadata_only_tokens(description, visible):
    seen = F.lower(T.fold(visible))
    return F.filter(F.array_distinct(F.regexp_extract_all(T.fold(description), F.lit(META_TOKEN), 0)), lambda t: ~seen.contains(F.lower(t)))


def measured(pages: DataFrame) -> DataFrame:
    """One narrow row of measures for each page; the raw page is read once."""
    facts = F.size(F.filter("contrast_strings", T.fact_like))
    empty_alt = F.size(F.filter("images", lambda i: i["alt_empty"]))
    description = F.coalesce(F.nullif(F.try_element_at("open_graph", F.lit("og:description")), F.lit("")), F.col("meta_description"))
    raw, visible = F.col("raw_html"), F.col("visible_text")
    return pages.select(
        "site_id", "page_id", "page_ord", "url", "page_class", "title", T.word_count(visible).alias("words"), facts.alias("facts"),
        F.size(shell_indicators(raw, visible, F.col("title"))).alias("shell"), F.size(metadata_only_tokens(description, visible)).alias("meta_tokens"),
        empty_alt.alias("empty_alt"), F.size("images").alias("images"), (F.col("canvas") + F.col("svg_without_text") + F.col("video_without_transcript")).alias("media"),
        "div_grid_candidates", "semantic_tables", F.size(script_only_paths(raw, F.col("links.href"))).alias("script_only"), hidden_instances(raw).alias("hidden"),
        (F.concat(T.text_of(F.col("title")), F.lit(" "), T.url_part(F.col("url"), "path")).rlike(PRICING)).alias("pricing"), F.coalesce(F.size(F.array_distinct("prices")), F.lit(0)).alias("prices"),
    )


def _page_check(check_id: str, flag, least: int, title: str, *, severity="medium", confidence="medium", skip_clean: bool = False):
    """A check that fires where at least `least` pages of a site are flagged; severity and confidence are those of the first."""

    def run(frames: Frames) -> DataFrame:
        rows = frames["measured"].withColumn("flag", F.coalesce(flag(), F.lit(False)))
        first = lambda c: F.min_by(c, F.when(F.col("flag"), F.col("page_ord")))
        sev = severity() if callable(severity) else F.lit(severity)
        conf = confidence() if callable(confidence) else F.lit(confidence)
        rows = rows.withColumn("sev", sev).withColumn("conf", conf)
        agg = per_site(frames, rows.groupBy("site_id").agg(F.count_if("flag").alias("n"), urls_where(F.col("flag"), 8).alias("urls"), first("sev").alias("sev"), first("conf").alias("conf")))
        finding = F.col("n") >= least
        return gated(agg, check_id, finding, severity=F.col("sev"), confidence=F.col("conf"), title=title, evidence=F.format_string("%d sampled pages are affected", F.col("n")), urls=F.col("urls"), skip=~F.coalesce(finding, F.lit(False)) if skip_clean else F.col("n").isNull())

    check(check_id, "measured")(run)


def _locked(most_words: int):
    alt = (F.col("empty_alt") >= 5) & (F.col("empty_alt") * 2 >= F.col("images"))
    media = (F.col("media") >= 3) & (F.col("facts") == 0)
    return (alt | media) & (F.col("words") < most_words)


_page_check("REP-KEY-FACT-LOSS", lambda: (F.col("shell") >= 2) & (F.col("facts") == 0), 1, "Main content is absent without scripts", severity="high", skip_clean=True)
_page_check("REP-STATE-ONLY-FACT", lambda: (F.col("facts") >= 1) & (F.col("words") < 250), 1, "Facts stand in script payloads only")
_page_check("REP-METADATA-CONTRAST", lambda: F.col("meta_tokens") > 0, 2, "Descriptions state what the pages do not show")
_page_check("REP-NON-TEXT-LOCKIN", lambda: _locked(300), 1, "Content is locked in images or media", severity=lambda: F.when(F.col("words") < 80, "high").otherwise("medium"), confidence=lambda: F.when(_locked(100), "high").otherwise("low"))
_page_check("REP-TABLE-SEMANTICS", lambda: (F.col("div_grid_candidates") >= 2) & (F.col("semantic_tables") == 0) & (F.col("page_class").isin("decision", "product") | (F.col("pricing") & (F.col("prices") >= 2))), 1, "Comparisons are laid out without tables")
_page_check("REP-LINKS-SCRIPT-ONLY", lambda: F.col("script_only") >= 5, 1, "Destinations are reachable by script only")
_page_check("REP-HIDDEN-TEXT-SUSPECT", lambda: (F.col("hidden") >= 2) & (F.col("words") < 300), 2, "Inline styles hide text on short pages")


def displaced(frames: Frames, check_id: str) -> DataFrame:
    pages = frames["pages"]
    runs = N.opening_lines(pages.select("site_id", "page_id", F.col("visible_text").alias("text")))
    rows = per_site(frames, N.extraction_displacement(runs, pages.select("site_id", "page_id")))
    urls = pages.groupBy("site_id").agg(urls_where(F.lit(True), 8).alias("urls"))
    finding = (F.col("sharers") >= F.col("needed")) & (F.col("median_chars") > 1500)
    return gated(rows.join(urls, "site_id", "left"), check_id, finding, confidence="medium", title="Shared boilerplate comes before the pages' own text", evidence=F.format_string("%d pages share an opening of %d characters at the median", F.col("sharers"), F.col("median_chars")), urls=F.col("urls"), skip=F.col("needed").isNull())


@check("REP-EXTRACTION-LOSS", "pages")
def extraction_loss(frames: Frames) -> DataFrame:
    return displaced(frames, "REP-EXTRACTION-LOSS")


@check("ANS-BOILERPLATE-DROWNING", "pages")
def boilerplate(frames: Frames) -> DataFrame:
    return displaced(frames, "ANS-BOILERPLATE-DROWNING")


def graph_nodes(parsed) -> list[dict]:
    """The nodes to judge: the object, the members of its @graph, or those of a list."""
    inner = parsed.get("@graph", parsed) if isinstance(parsed, dict) else parsed
    if isinstance(parsed, dict) and not isinstance(inner, (list, dict)):
        inner = parsed
    return [n for n in (inner if isinstance(inner, list) else [inner]) if isinstance(n, dict)]


def node_facts(raw: str | None) -> list[tuple]:
    """(ok, types, named, name, prices, availability) of each node of a JSON-LD block; one row, ok false, for a block that does not parse."""
    try:
        nodes = graph_nodes(json.loads(raw or ""))
    except ValueError:
        return [(False, [], False, None, [], [])]
    rows = []
    for n in nodes:
        types = n.get("@type")
        types = sorted({str(t) for t in types}) if isinstance(types, list) else [types] if isinstance(types, str) else []
        offers = n.get("offers")
        offers = [o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)]
        prices = [str(x["price"]) for x in (n, *offers) if x.get("price") is not None]
        name = n.get("name").strip() if isinstance(n.get("name"), str) else ""
        rows.append((True, types, bool(name), name or None, prices, [o["availability"] for o in offers if isinstance(o.get("availability"), str)]))
    return rows


def jsonld_nodes(blocks: DataFrame) -> DataFrame:
    """(page_id, block, ok, types, named, name, prices, availability); blocks: (page_id, block, raw)."""

    def expand(batches):
        for pdf in batches:
            rows = [(p, b, *facts) for p, b, raw in zip(pdf["page_id"], pdf["block"], pdf["raw"], strict=True) for facts in node_facts(raw)]
            yield pd.DataFrame(rows, columns=["page_id", "block", "ok", "types", "named", "name", "prices", "availability"])

    return blocks.select("page_id", "block", "raw").mapInPandas(expand, "page_id long, block int, ok boolean, types array<string>, named boolean, name string, prices array<string>, availability array<string>")


def jsonld_validity(nodes: DataFrame) -> DataFrame:
    """(page_id, nodes, unparsed, untyped, unnamed, identity_ok)."""
    typed = F.size("types") > 0
    needs = F.arrays_overlap("types", F.array(*map(F.lit, NAME_REQUIRED)))
    identity = F.arrays_overlap("types", F.array(*map(F.lit, IDENTITY)))
    return nodes.groupBy("page_id").agg(F.count("*").alias("nodes"), F.count_if(~F.col("ok")).alias("unparsed"), F.count_if(F.col("ok") & ~typed).alias("untyped"), F.count_if(F.col("ok") & needs & ~F.col("named")).alias("unnamed"), F.count_if(F.col("ok") & identity & F.col("named")).alias("identity_ok"))


@check("ENT-JSONLD-INVALID", "pages", "jsonld_nodes")
def jsonld_invalid(frames: Frames) -> DataFrame:
    pages = frames["pages"]
    broken = F.size(F.filter("jsonld", lambda b: ~b["parse_ok"] & b["raw"].rlike(IDENTITY_RAW))) > 0
    rows = jsonld_validity(frames["jsonld_nodes"]).join(pages.select("site_id", "page_id", "page_ord", "url", "page_class", broken.alias("broken_identity")), "page_id")
    bad = (F.col("unparsed") + F.col("untyped") + F.col("unnamed")) > 0
    home = (F.col("page_class") == "homepage") & F.col("broken_identity")
    agg = rows.groupBy("site_id").agg(F.count_if(bad).alias("n"), urls_where(bad).alias("urls"), F.max(home).alias("home"), F.max("broken_identity").alias("broken"), F.sum("identity_ok").alias("ok"))
    severity = F.when(F.col("home") | (F.col("broken") & (F.col("ok") == 0)), "high").otherwise("medium")
    return gated(per_site(frames, agg), "ENT-JSONLD-INVALID", F.col("n") > 0, severity=severity, title="Structured data is invalid", evidence=F.format_string("%d pages carry invalid JSON-LD", F.col("n")), urls=F.col("urls"))


@check("ENT-STRUCTURED-VISIBLE-CONFLICT", "pages", "jsonld_nodes", "claims")
def structured_visible(frames: Frames) -> DataFrame:
    prices = frames["jsonld_nodes"].select("page_id", F.explode("prices").alias("price"))
    found = C.price_conflicts(prices, frames["claims"]).join(frames["pages"].select("site_id", "page_id", "page_ord", "url"), "page_id")
    agg = per_site(frames, found.groupBy("site_id").agg(F.count("*").alias("n"), urls_where(F.lit(True)).alias("urls")))
    return gated(agg, "ENT-STRUCTURED-VISIBLE-CONFLICT", F.col("n") > 0, severity="high", title="Structured data and page disagree on the price", evidence=F.format_string("%d pages show another price than they declare", F.col("n")), urls=F.col("urls"))


def ownership(domain):
    return F.when(domain.isin(*INDEPENDENT), "independent").when(domain.isin(*OWNED), "owned").when(domain.isin(*REGISTRIES), "registry").otherwise("unknown")


def corroboration(links: DataFrame) -> DataFrame:
    """(site_id, declared, the resolved by class, independent_errors, timeouts, matches, unverified); links: (site_id, url, ownership, http_status, brand_name_match)."""
    ok = F.coalesce(F.col("http_status").between(200, 399), F.lit(False))
    ind = F.col("ownership") == "independent"
    return links.groupBy("site_id").agg(
        F.count("*").alias("declared"), F.count_if(ind & ok).alias("independent_resolved"), F.count_if((F.col("ownership") == "owned") & ok).alias("owned_resolved"),
        F.count_if((F.col("ownership") == "unknown") & ok).alias("unknown_resolved"), F.count_if(ind & (F.col("http_status") >= 400)).alias("independent_errors"),
        F.count_if(F.col("http_status").isNull()).alias("timeouts"), F.count_if(ind & ok & F.coalesce("brand_name_match", F.lit(False))).alias("matches"),
    )


@check("ENT-CORROBORATION-ABSENT", "external_links")
def corroboration_absent(frames: Frames) -> DataFrame:
    links = frames["external_links"]
    dead = links.where((F.col("ownership") == "independent") & (F.col("http_status") >= 400)).groupBy("site_id").agg(F.slice(F.array_sort(F.collect_list("url")), 1, 3).alias("urls"))
    rows = per_site(frames, corroboration(links)).join(dead, "site_id", "left")
    finding = (F.col("independent_errors") > 0) & (F.col("independent_resolved") == 0) & (F.col("timeouts") == 0)
    return gated(rows, "ENT-CORROBORATION-ABSENT", finding, title="Declared independent references do not resolve", evidence=F.format_string("%d declared independent links fail", F.col("independent_errors")), urls=F.col("urls"), skip=F.col("declared").isNull())


def name_variants(names: DataFrame) -> DataFrame:
    """(site_id, grp, variant, surfaces, mentions): the groups of a site's names, each by its first; names: (site_id, ord, surface, value)."""
    rows = N.name_groups(names).groupBy("site_id", "grp").agg(F.min_by("value", "ord").alias("variant"), F.array_sort(F.collect_set("surface")).alias("surfaces"), F.count("*").alias("mentions"))
    return rows.select("site_id", "grp", "variant", "surfaces", "mentions")


@check("ENT-NAME-INCONSISTENT", "names")
def name_inconsistent(frames: Frames) -> DataFrame:
    """A pass with the table of variants, which a reviewer completes; without a name there is nothing to judge."""
    row = F.concat("variant", F.lit(" ("), F.array_join("surfaces", ", "), F.lit(": "), F.col("mentions").cast("string"), F.lit(")"))
    table = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("grp", row.alias("row")))), 1, 6), lambda x: x["row"])
    agg = name_variants(frames["names"]).groupBy("site_id").agg(F.count("*").alias("variants"), F.array_join(table, "; ").alias("rows"))
    observed = F.concat(F.col("variants").cast("string"), F.lit(" variants: "), F.col("rows"))
    return gated(per_site(frames, agg), "ENT-NAME-INCONSISTENT", F.lit(False), skip=F.col("variants").isNull(), quality="semantic-judgment", open_=True, observed=observed)


@check("ENT-AMBIGUOUS-NAME", "pages", "names")
def ambiguous_name(frames: Frames) -> DataFrame:
    """A pass that tells where the home page says what kind of thing the name stands for; a reviewer completes it."""
    home = frames["pages"].where("page_class = 'homepage'").groupBy("site_id").agg(F.min_by(F.concat_ws(" ", "title", "meta_description"), "page_ord").alias("said"))
    named = frames["names"].groupBy("site_id").agg(F.min_by("value", "ord").alias("name"), F.max(F.when(F.col("surface") == "h1", T.has_qualifier(F.col("value")))).alias("in_h1"))
    agg = named.join(home, "site_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("string")
    observed = F.concat(F.lit("name "), "name", F.lit("; qualified in title: "), flag(T.has_qualifier(F.col("said"))), F.lit(", in h1: "), flag(F.col("in_h1")))
    return gated(per_site(frames, agg), "ENT-AMBIGUOUS-NAME", F.lit(False), skip=F.col("name").isNull(), quality="semantic-judgment", open_=True, observed=observed)


@check("FRS-LASTMOD-UNIFORM", "sitemap_entries")
def lastmod_uniform(frames: Frames) -> DataFrame:
    from pagewright.operators.urls import lastmod_stats

    rows = per_site(frames, lastmod_stats(frames["sitemap_entries"]))
    return gated(rows, "FRS-LASTMOD-UNIFORM", (F.col("distinct_values") <= 1) & (F.col("entries") > 1), severity="low", confidence="medium", title="All sitemap dates are the same", evidence=F.format_string("%d dates, %d distinct", F.col("present"), F.col("distinct_values")), urls=F.array(F.concat("base_url", F.lit("/sitemap.xml"))), skip=F.coalesce("present", F.lit(0)) == 0)


@check("FRS-IMPOSSIBLE-DATE", "pages")
def impossible_date(frames: Frames) -> DataFrame:
    """Structured dates that no calendar has, or after the capture."""
    rows = frames["pages"].select("site_id", "page_ord", "url", F.explode("structured_dates").alias("d")).join(frames["sites"].select("site_id", "captured_at"), "site_id")
    iso = F.col("d").rlike(r"^\d{4}-\d{2}-\d{2}")
    day = F.substring("d", 1, 10).try_cast("date")
    bad = iso & (day.isNull() | F.coalesce(day > F.date_add(F.col("captured_at").cast("date"), 1), F.lit(False)))
    agg = per_site(frames, rows.groupBy("site_id").agg(F.count("*").alias("dates"), F.count_if(bad).alias("n"), F.array_distinct(urls_where(bad)).alias("urls")))
    return gated(agg, "FRS-IMPOSSIBLE-DATE", F.col("n") > 0, title="Pages carry impossible dates", evidence=F.format_string("%d of %d structured dates are impossible", F.col("n"), F.col("dates")), urls=F.col("urls"), skip=F.col("dates").isNull())
