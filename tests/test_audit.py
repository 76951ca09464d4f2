"""Scenarios of one condition each: what must fire, and that nothing else does."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagewright.operators import robots as R
from pagewright.plans import audit as A
from pagewright.plans.catalog import catalog, catalog_rows
from pagewright.plans.report import build_report, damp_by_corroboration, render
from pagewright.plans.results import REGISTRY, RESULT, run_checks

HEAD = "<title>Acme</title><meta name=viewport content=w>"
WORDS = " ".join(f"word{i}" for i in range(400))
SITES = "site_id string, base_url string, site_types array<string>, candidates_count long, robots_status string, robots_attempts int, robots_http_status int, has_llms_txt boolean, captured_at timestamp"
CAPTURES = "page_id long, url string, html string, status int, timing_ms long, page_class string, x_robots_tag string, chain array<string>"


def pages_of(site, bodies, at, **more):
    """Rows of CAPTURES for a scenario; a list gives each page its own value."""
    rows = []
    for i, body in enumerate(bodies):
        own = {k: v[i] if isinstance(v, list) else v for k, v in more.items()}
        html = f"<html><head>{own.get('head', HEAD)}</head><body>{body}</body></html>"
        rows.append((at + i, f"https://{site}/p{i}" if i else f"https://{site}/", html, own.get("status", 200), own.get("timing", 100), own.get("page_class", "homepage" if i == 0 else "product"), own.get("x_robots"), own.get("chain")))
    return rows


def site_row(site, status="ok", attempts=1, candidates=10):
    return (site, f"https://{site}", [], candidates, status, attempts, 503 if status == "error" else 200, False, datetime.datetime(2026, 1, 1))


CLEAN = [f"<p>{WORDS} {i}</p>" for i in range(3)]
CASES = {
    "clean": (CLEAN, {}, {}),
    "empty shell": (["<noscript>Please enable JavaScript</noscript><div id='root'></div>"], {"head": "<title>Loading...</title><meta name=viewport content=w>"}, {"REP-KEY-FACT-LOSS": ("high", "medium")}),
    "facts in state": (["<div id='root'></div><script id='__NEXT_DATA__'>{\"a\": \"Plans start at nine dollars per month for teams\"}</script>"], {}, {"REP-STATE-ONLY-FACT": ("medium", "medium")}),
    "server-rendered state": ([f"<p>{WORDS}</p><script id='__NEXT_DATA__'>{{\"a\": \"Plans start at nine dollars per month for teams\"}}</script>"], {}, {}),
    "legitimate sr-only": (["<p class=\"sr-only\" style=\"display:none\">skip</p><p class=\"sr-only\" style=\"display:none\">x</p><p>words</p>"] * 2, {}, {}),
    "hidden text": (["<p style=\"display:none\">a</p><p style=\"visibility:hidden\">b</p>"] * 2, {}, {"REP-HIDDEN-TEXT-SUSPECT": ("medium", "medium")}),
    "invalid JSON-LD": (['<script type="application/ld+json">{"@type": "Organization" "name"}</script>' + CLEAN[0]], {}, {"ENT-JSONLD-INVALID": ("high", "high")}),
    "valid JSON-LD": (['<script type="application/ld+json">{"@type": "Organization", "name": "Acme"}</script>' + CLEAN[0]], {}, {}),
    "images without alt": (["<img src=a width=1 height=1>" * 6 + "<p>few words</p>"], {}, {"REP-NON-TEXT-LOCKIN": ("high", "high")}),
    "images with alt": (["<img src=a width=1 height=1 alt=words>" * 6 + "<p>few words</p>"], {}, {}),
    "pricing in div grid": (["<div class=col>$1</div>" * 6 + CLEAN[0]], {"page_class": "decision"}, {"REP-TABLE-SEMANTICS": ("medium", "medium")}),
    "noindex home": (CLEAN, {"head": [HEAD + "<meta name=robots content=noindex>", HEAD, HEAD]}, {"ACC-INDEX-CONTROL": ("critical", "high")}),
    "nosnippet header": (CLEAN, {"x_robots": [None, "nosnippet", None]}, {"ACC-INDEX-CONTROL": ("high", "high")}),
    "noarchive": (CLEAN, {"head": HEAD + "<meta name=robots content=nocache>"}, {"ACC-NOARCHIVE-COPILOT": ("medium", "high")}),
    "redirect cycle": (CLEAN, {"chain": [["https://a.example/1", "https://a.example/2", "https://a.example/1"], None, None]}, {"ACC-REDIRECT-LOOP": ("high", "high")}),
    "terminating redirects": (CLEAN, {"chain": [["https://a.example/1", "https://a.example/1/"], None, None]}, {}),
    "slow pages": (CLEAN, {"timing": [3000, 3100, 9000]}, {"ACC-FETCH-LATENCY": ("medium", "medium")}),
    "slow failures do not count": (CLEAN, {"timing": 9000, "status": [503, 200, 200]}, {}),
    "canonical elsewhere": (CLEAN, {"head": [HEAD, HEAD + "<link rel=canonical href='https://b.example/x'>", HEAD]}, {"ACC-CANONICAL-CONFLICT": ("medium", "low")}),
    "canonicals consolidate": (CLEAN, {"head": HEAD + "<link rel=canonical href='https://b.example/x'>"}, {}),
    "bad locale": (CLEAN, {"head": [HEAD + "<link rel=alternate hreflang=english href=/en>", HEAD, HEAD]}, {"ACC-HREFLANG-INCONSISTENT": ("medium", "high")}),
    "descriptions promise more": (CLEAN, {"head": HEAD + "<meta name=description content='From $29 a month'>"}, {"REP-METADATA-CONTRAST": ("medium", "medium")}),
    "handlers only": (["<b onclick=\"go\">" + "".join(f"router.push('/x{i}')" for i in range(5)) + CLEAN[0]], {}, {"REP-LINKS-SCRIPT-ONLY": ("medium", "medium")}),
    "price conflict": (['<script type="application/ld+json">{"@type": "Product", "name": "x", "offers": {"price": "79"}}</script><p>now $29 ' + WORDS], {}, {"ENT-STRUCTURED-VISIBLE-CONFLICT": ("high", "high")}),
    "shared opening": (["".join(f"<p>menu entry {k} {'x' * 300}</p>" for k in range(8)) + c for c in CLEAN], {}, {"REP-EXTRACTION-LOSS": ("medium", "medium"), "ANS-BOILERPLATE-DROWNING": ("medium", "medium")}),
    "impossible date": ([f"<time datetime=2024-02-31>x</time>{c}" for c in CLEAN], {}, {"FRS-IMPOSSIBLE-DATE": ("medium", "high")}),
    "no viewport": (CLEAN, {"head": "<title>x</title>"}, {"REF-VIEWPORT-ABSENT": ("high", "medium")}),
    "collapsed and covered": (["<details>x</details><div class=consent></div><img src=x alt=y>" + CLEAN[0]], {}, {"REF-COLLAPSED-ANSWER": ("medium", "medium"), "REF-OVERLAY-BLOCK": ("low", "medium"), "REF-PERF-RISK": ("low", "medium")}),
}


#: Scenarios about a site's surroundings: (frame, rows without their site), ..., what fires; "site" gives the row of the site itself.
ROBOTS, PROBES, LINKS, MISSING, VARIANTS, MAPS, ENTRIES = "robots", "ua_probes", "link_probes", "missing_probe", "redirect_variants", "sitemaps", "sitemap_entries"
SCHEMAS = {
    PROBES: "site_id string, requested_path string, token string, status int, browser_status int, robots_meta string, x_robots_tag string",
    LINKS: "site_id string, url string, status int",
    MISSING: "site_id string, probe_path string, status int, has_search boolean, has_navigation boolean, has_suggestions boolean",
    VARIANTS: "site_id string, path_preserved boolean, variant_ok boolean",
    MAPS: "site_id string, url string, http_status int, parse_ok boolean",
    ENTRIES: "site_id string, url string, lastmod string",
}
AROUND = {
    "search bot disallowed": ({ROBOTS: ["User-agent: OAI-SearchBot\nDisallow: /"]}, {"ACC-ROBOTS-ROLE": ("critical", "high")}),
    "training bot disallowed": ({ROBOTS: ["User-agent: GPTBot\nDisallow: /"]}, {}),
    "robots 503 twice": ({"site": {"status": "error", "attempts": 2}}, {"ACC-ROBOTS-UNAVAILABLE": ("high", "high")}),
    "robots 503 once": ({"site": {"status": "error"}}, {"ACC-ROBOTS-UNAVAILABLE": ("high", "low")}),
    "robots 404": ({"site": {"status": "not_found"}, ROBOTS: ["User-agent: Googlebot\nDisallow: /"]}, {}),
    "challenge": ({PROBES: [("/", "OAI-SearchBot", 403, 200, None, None)]}, {"ACC-BOT-CHALLENGE": ("high", "medium")}),
    "no challenge": ({PROBES: [("/", "OAI-SearchBot", 200, 200, None, None)]}, {}),
    "dead link and a gone one": ({LINKS: [("https://s/pricing", 404), ("https://s/x", 410)]}, {"ACC-LINK-ROT": ("medium", "medium")}),
    "one dead link": ({LINKS: [("https://s/zz", 404), ("https://s/ok", 200)]}, {"ACC-LINK-ROT": ("low", "medium")}),
    "gone links only": ({LINKS: [("https://s/x", 410), ("https://s/y", None)]}, {}),
    "soft 404": ({MISSING: [("/zz", 200, True, True, True)]}, {"REF-SOFT-404": ("medium", "high")}),
    "dead end": ({MISSING: [("/zz", 404, False, False, False)]}, {"REF-404-DEAD-END": ("low", "high")}),
    "helpful 404": ({MISSING: [("/zz", 404, True, False, False)]}, {}),
    "path dropped": ({VARIANTS: [(True, True), (False, True)]}, {"REF-PATH-DROP-REDIRECT": ("high", "high")}),
    "path kept or unread": ({VARIANTS: [(True, True), (None, False)]}, {}),
    "sitemap broken": ({MAPS: [("https://s/sitemap.xml", 200, False)]}, {"ACC-SITEMAP-INVALID": ("medium", "high")}),
    "orphans on a large site": ({"site": {"candidates": 60}, MAPS: [("m", 200, True)], ENTRIES: [("https://s/pricing", "2024-01-01"), ("https://s/p1", "2024-01-02")]}, {"ACC-SITEMAP-ORPHAN": ("medium", "medium")}),
    "orphans on a small site": ({MAPS: [("m", 200, True)], ENTRIES: [("https://s/pricing", "2024-01-01"), ("https://s/p1", "2024-01-02")]}, {}),
    "uniform dates": ({ENTRIES: [(f"https://s/{i}", "2024-01-01") for i in range(3)]}, {"FRS-LASTMOD-UNIFORM": ("low", "medium")}),
}


@pytest.fixture(scope="module")
def outcome(spark):
    """All scenarios at once, each a site of its own: its findings, and the frames."""
    pages, sites, robots, other, expected = [], [], [], {k: [] for k in SCHEMAS}, {}
    for i, (name, (bodies, more, fires)) in enumerate(CASES.items()):
        site = f"case{i}.example"
        pages += pages_of(site, bodies, 100 * i, **more)
        sites.append(site_row(site))
        expected[site] = (name, fires)
    for i, (name, (around, fires)) in enumerate(AROUND.items()):
        site = f"around{i}.example"
        pages += pages_of(site, CLEAN, 100_000 + 100 * i)
        sites.append(site_row(site, **around.get("site", {})))
        robots += [(site, body) for body in around.get(ROBOTS, ())]
        for k in SCHEMAS:
            other[k] += [(site, *r) for r in around.get(k, ())]
        expected[site] = (name, fires)
    frames = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in other.items()}
    frames |= {"sites": spark.createDataFrame(sites, SITES), "robots": R.robots_rows(spark.createDataFrame(robots, "site_id string, body string")), "pages": A.page_frame(A.site_pages(spark.createDataFrame(pages, CAPTURES).coalesce(2))).persist()}
    found = {site: {} for site in expected}
    derived = A.derive(frames)
    derived["measured"] = derived["measured"].persist()
    # check by check: one plan of all of them is planned anew after each of its many stages
    run_checks(derived, only=())
    rows = [r for check_id in sorted(REGISTRY) for r in run_checks(derived, only=(check_id,)).collect()]
    for r in rows:
        if r["gate"] == "finding":
            found[r["site_id"]][r["check_id"]] = (r["severity"], r["confidence"])
    yield expected, found, spark.createDataFrame(rows, RESULT), frames
    frames["pages"].unpersist()


def test_scenarios(outcome):
    expected, found, *_ = outcome
    wrong = {name: (found[site], fires) for site, (name, fires) in expected.items() if found[site] != fires}
    assert wrong == {}


def test_missing_frames_are_not_evaluated(spark):
    out = run_checks({"sites": spark.createDataFrame([site_row("a.example")], SITES)}, only=("ACC-LINK-ROT", "REP-KEY-FACT-LOSS"))
    assert {r["gate"] for r in out.collect()} == {"not_evaluated"}
    assert len(catalog_rows()) == 49


def test_report_and_rendering(spark, outcome):
    expected, _, results, frames = outcome
    site = next(s for s, (name, _) in expected.items() if name == "slow pages")
    own = results.where(F.col("site_id") == site).withColumn("ord", F.monotonically_increasing_id())
    report = build_report(own, catalog(spark), frames["sites"].where(F.col("site_id") == site))
    assert [r["id"] for r in report["findings"].collect()] == ["F-001"]
    assert "ACC-FETCH-LATENCY" in render(site, report)
    damped = damp_by_corroboration(report["findings"], spark.createDataFrame([(site, 3)], "site_id string, matches long"), ("ACC-FETCH-LATENCY",))
    assert damped.first()["severity"] == "low"
    decided = own.where("gate <> 'not_evaluated'").select("check_id").distinct().count()
    assert report["not_evaluated"].count() + decided == 49


def test_audit_looks_at_pages_that_matter(spark):
    """Captures without classes get them from selection; a site without an important page is not evaluated, and names are told."""
    rows = [(1, "https://a.example/", "<title>Acme Software | Home</title><h1>Acme</h1><footer>© 2024 Acme Widgets Inc. All rights</footer>"), (2, "https://a.example/pricing", "<title>Acme | Plans</title><meta name=robots content=noindex>"), (3, "https://b.example/zz/1", "<p>x</p>")]
    pages = A.page_frame(A.site_pages(spark.createDataFrame(rows, "page_id long, url string, html string")))
    frames = A.derive({"pages": A.classed(pages), "sites": A.bare_sites(A.site_pages(spark.createDataFrame(rows, "page_id long, url string, html string")))})
    assert {(r["url"], r["page_class"]) for r in frames["pages"].select("url", "page_class").collect()} == {("https://a.example/", "homepage"), ("https://a.example/pricing", "decision"), ("https://b.example/zz/1", "other")}
    only = ("ACC-INDEX-CONTROL", "ACC-NOARCHIVE-COPILOT", "ENT-NAME-INCONSISTENT", "ENT-AMBIGUOUS-NAME")
    got = {(r["site_id"], r["check_id"]): r for r in run_checks(frames, only).collect()}
    assert got["a.example", "ACC-INDEX-CONTROL"]["gate"] == "finding" and got["a.example", "ACC-NOARCHIVE-COPILOT"]["gate"] == "pass"
    assert {got["b.example", c]["gate"] for c in only} == {"not_evaluated"}
    told = got["a.example", "ENT-NAME-INCONSISTENT"]
    assert told["gate"] == "pass" and told["requires_completion"] and "Acme Software (footer, h1, title: 4)" in told["evidence"]
    assert got["a.example", "ENT-AMBIGUOUS-NAME"]["evidence"] == "name Acme Software; qualified in title: true, in h1: false"
