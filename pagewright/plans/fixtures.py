"""Small typed relations written once and used by both engines: as a DataFrame and as a SQL common table expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_DUCK = {"string": "varchar", "long": "bigint", "int": "integer", "boolean": "boolean", "double": "double", "array<string>": "varchar[]"}


def _literal(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return "[" + ", ".join(map(_literal, x)) + "]" if isinstance(x, list) else repr(x)


@dataclass(frozen=True)
class Fixture:
    name: str
    schema: str  # "a string, b long"
    rows: tuple[tuple, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def cte(self) -> str:
        fields = [f.split() for f in self.schema.split(", ")]
        names = ", ".join(n for n, _ in fields)
        typed = ", ".join(f"cast({n} as {_DUCK[k]}) as {n}" for n, k in fields)
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"{self.name} as (select {typed} from (values {values}) as t({names}))"


def ctes(*fixtures: Fixture) -> str:
    return ", ".join(f.cte() for f in fixtures)


URLS = Fixture("urls", "site_id string, url string, ord long", (
    ("a", "https://www.a.example/", 1), ("a", "https://a.example/pricing/", 2), ("a", "https://a.example/docs/guide-1", 3), ("a", "https://a.example/docs/guide-2", 4),
    ("a", "https://a.example/blog/2024/x", 5), ("a", "https://a.example/blog/2023/y", 6), ("a", "https://a.example/blog/2022/z?p=1", 7), ("a", "https://a.example/login", 8),
    ("a", "https://a.example/about", 9), ("a", "https://a.example/x/1", 10), ("a", "https://a.example/x/2", 11), ("b", "http://b.example/shop/item/7", 1), ("b", "http://b.example/account/settings", 2),
    ("b", "http://B.example:8080/Shop/Index.html?q=1#f", 3), ("b", "http://b.example", 4), ("b", "", 5),
))
ROBOTS = Fixture("robots_files", "site_id string, body string", (
    ("a", "# hello\nUser-agent: GPTBot\nUser-agent: OAI-SearchBot\nDisallow: /private\nAllow: /private/open\n\nUser-agent: *\nDisallow: /tmp*\nSitemap: https://a.example/sitemap.xml\n"),
    ("b", "Disallow: /early\nUser-agent: Googlebot\nDisallow:\nUser-agent: PerplexityBot\nDisallow: /\nAllow: /shop$\nAllow: /\n"),
    ("c", "User-Agent: *\nDisallow: /\nno colon here\nUser-agent: Bingbot\nAllow: /a # open\n"), ("d", ""),
))
PATHS = Fixture("paths", "site_id string, path string", tuple((s, p) for s in "abcd" for p in ("/", "/private", "/private/open/x", "/tmpfile", "/shop", "/shop/1", "/a")))
CHAINS = Fixture("chains", "site_id string, url string, chain array<string>", (
    ("a", "https://a.example/1", ["https://a.example/1", "https://A.example/2", "https://a.example/1"]), ("a", "https://a.example/2", ["https://a.example/2", "https://a.example/2/"]),
    ("a", "https://a.example/3", ["https://a.example/3?a=1", "https://a.example/3?a=2", "https://a.example/3?a=3", "https://a.example/3?a=4", "https://a.example/3?a=5"]), ("b", "http://b.example/", []),
))
CANONICALS = Fixture("pages_c", "site_id string, url string, final_url string, canonical string, chain array<string>", (
    ("a", "https://a.example/1", "https://www.a.example/1/", "https://a.example/1/index.html", ["x"]), ("a", "https://a.example/2", "https://a.example/2", "https://a.example/other", ["x", "y"]),
    ("a", "https://a.example/3", None, "https://a.example/home", ["x"]), ("b", "http://b.example/1", "", "http://c.example/1", []), ("b", "http://b.example/2", "", None, []),
))
LOCALES = Fixture("locales", "site_id string, url string, lang string", (("a", "https://a.example/en", "en"), ("a", "https://a.example/fr", "fr"), ("a", "https://a.example/de", None)))
ALTERNATES = Fixture("alternates", "site_id string, url string, lang string, href string", (
    ("a", "https://a.example/en", "fr", "https://a.example/fr/"), ("a", "https://a.example/fr", "en", "https://a.example/en"), ("a", "https://a.example/fr", "de", "https://a.example/de"),
    ("a", "https://a.example/en", "x-default", "https://a.example/en"), ("a", "https://a.example/en", "es", "https://a.example/es"),
))
PROBED = Fixture("probed", "site_id string, url string, status long", (
    ("a", "https://a.example/gone", 410), ("a", "https://a.example/pricing/old", 404), ("a", "https://a.example/ok", 200), ("b", "http://b.example/x", 500), ("b", "http://b.example/y", None), ("c", "http://c.example/1", 200),
))
TIMES = Fixture("times", "site_id string, timing_ms long, status long", (
    ("a", 100, 200), ("a", 3001, 200), ("a", 3000, 200), ("a", 9000, 503), ("b", 6000, 200), ("b", 6001, 200), ("b", 7000, 200), ("b", 100, 200), ("c", 9000, 200), ("c", 9000, 200), ("d", 50, 200), ("d", 60, 200), ("d", 90000, 200),
))
SITEMAP = Fixture("entries", "site_id string, url string, lastmod string", (
    ("a", "https://a.example/pricing", "2024-01-01"), ("a", "https://a.example/deep/x", "2024-01-01"), ("a", "https://a.example/about/", " "), ("a", "https://a.example/linked", "2024-02-01"), ("b", "http://b.example/1", None), ("b", "http://b.example/2", None),
))
LINKS = Fixture("links", "site_id string, netloc string, href string, ord long", (
    ("a", "a.example", "https://a.example/linked/", 1), ("a", "a.example", "https://other.example/pricing", 2), ("a", "a.example", "https://a.example/logo.PNG", 3), ("a", "a.example", "https://a.example/tag/x", 4),
    ("a", "a.example", "https://a.example/linked#top", 5), ("a", "a.example", "mailto:x@a.example", 6), ("a", "a.example", "https://a.example/", 7), ("a", "a.example", "https://A.example/new?x=1", 8), ("b", "b.example", "http://b.example/feed/", 1), ("b", "b.example", "http://b.example/real", 2),
))
OPENINGS = Fixture("openings", "site_id string, page_id long, line_ord long, line string", tuple(
    (s, p, i, f"shared line {i} of the menu" if i < n and s == "a" else f"own {s} {p} {i}") for s in "ab" for p, n in ((1, 8), (2, 7), (3, 2), (4, 6)) for i in range(9)
))
HEADINGS = Fixture("headings", "page_id long, ord long, level int, text string, id string", tuple(
    [(1, 0, 1, "Top", None)] + [(1, i, 3, f"Item {i}", "x" if i % 2 else None) for i in range(1, 11)] + [(1, 11, 2, "End", "e")] + [(2, i, 2, f"Seven {i}", None) for i in range(7)]
))
CLAIMS = Fixture("claims", "site_id string, page_id long, claim_ord long, type string, value string, quote string", tuple(
    [("a", 1, i, "price", f"${i}", f"only ${i} today") for i in range(1, 10)] + [("a", 1, 20 + i, "plan", "Pro", "Pro " * 50) for i in range(7)] + [("a", 2, 1, "price", "$1", "for $1"), ("a", 2, 2, "plan", "Pro", "the Pro plan"), ("b", 3, 1, "price", "$79.00", "now $79.00")]
))
OFFERS = Fixture("offers", "page_id long, price string", ((1, "5"), (2, "29.00"), (3, "79"), (3, "79.0")))
EXTERNALS = Fixture("externals", "site_id string, url string, ownership string, http_status long, brand_name_match boolean", (
    ("a", "https://g2.com/a", "independent", 404, None), ("a", "https://x.com/a", "owned", 200, True), ("b", "https://yelp.com/b", "independent", 200, True), ("b", "https://b.blog", "unknown", None, None), ("b", "https://g2.com/b", "independent", 301, False),
))
RESULTS = Fixture("results", "site_id string, ord long, check_id string, gate string, severity string, confidence string, evidence_quality string, title string, evidence string, urls array<string>", (
    ("a", 1, "ACC-LINK-ROT", "finding", "low", "medium", "direct-measurement", "Rot", "1 of 5 links", ["u1", "u2"]), ("a", 2, "ACC-LINK-ROT", "finding", "medium", "medium", "direct-measurement", "Rot again", "2", ["u2", "u1"]),
    ("a", 3, "REP-KEY-FACT-LOSS", "finding", "high", "medium", "direct-measurement", "Shell", "see ZZZ-NOTREAL", ["u1"]), ("a", 4, "REP-EXTRACTION-LOSS", "finding", "medium", "medium", "direct-measurement", "Loss", "x", ["u1", "u9"]),
    ("a", 5, "REP-LINKS-SCRIPT-ONLY", "finding", "medium", "medium", "direct-measurement", "Links", "x", ["u7"]), ("a", 6, "ACC-BOT-CHALLENGE", "finding", "high", "medium", "direct-measurement", "Bots", "no status told", ["u1"]),
    ("a", 7, "REF-SOFT-404", "finding", "medium", "high", "direct-measurement", "Soft", "/x returned 200", ["u3"]), ("a", 8, "ACC-ROBOTS-ROLE", "finding", "critical", "medium", "direct-measurement", "Robots", "x", ["u0"]),
    ("a", 9, "MADE-UP", "finding", "high", "high", "direct-measurement", "No", "x", []), ("b", 1, "ACC-LINK-ROT", "pass", None, None, "direct-measurement", None, None, None), ("b", 2, "FRS-CLAIM-CONFLICT", "pass", None, None, "hypothesis", None, None, None),
    ("b", 3, "ACC-CANONICAL-CONFLICT", "finding", "medium", "low", "direct-measurement", "Canonical", "x", ["u1"]), ("b", 4, "ENT-JSONLD-INVALID", "not_evaluated", None, None, "direct-measurement", None, None, None), ("b", 5, "ENT-JSONLD-INVALID", "not_evaluated", None, None, "direct-measurement", None, None, None),
    ("b", 6, "ACC-LINK-ROT", "not_evaluated", None, None, "direct-measurement", None, None, None),
))
OPPORTUNITIES = Fixture("opps", "site_id string, ord long, title string, priority string", (("a", 1, "Add a feed", "low"), ("a", 2, " add a FEED ", "high"), ("a", 3, "Zip it", "odd"), ("a", 4, "Caption", "medium"), ("b", 1, "Add a feed", "high")))
SHED = Fixture("shed", "site_id string, ord long, what string, at_seconds long, reason string", (("a", 1, "Probes", 151, "late"), ("a", 2, "probes", 160, "later"), ("a", 3, "Links", 211, "late"), ("b", 1, "Links", 1, "x")))
VERDICTS = Fixture("verdicts", "site_id string, ord long, check_id string, gate string, severity string, confidence string, title string, evidence string, urls array<string>, reason string", (
    ("a", 1, "FRS-CLAIM-CONFLICT", "finding", None, None, None, None, ["u"], None), ("a", 2, "FRS-CLAIM-CONFLICT", "pass", None, None, None, None, None, None), ("a", 3, "FRS-DATE-CONFLICT", "maybe", None, None, None, None, None, None),
    ("a", 4, "FRS-STALE-VERSION", "finding", "low", "high", "Old", "v1", None, None), ("a", 5, None, "pass", None, None, None, None, None, None), ("b", 1, "FRS-DATE-CONFLICT", "not_evaluated", None, None, None, None, None, "no time"),
))
MEASURED = Fixture("measured", "site_id string, check_id string, evidence string", (("a", "FRS-CLAIM-CONFLICT", "two prices"), ("b", "FRS-DATE-CONFLICT", "x")))
SKILLS = Fixture("skills", "site_id string, skill_id string", (("a", "freshness-consistency-audit"), ("b", "freshness-consistency-audit")))
TITLES = Fixture("titles", "page_id long, title string", ((1, "Acme Inc | Home"), (2, "Docs – Guide · Acme"), (3, "a|b"), (4, ""), (5, None), (6, "  One   two  "), (7, "« x : y »")))
META = Fixture("metas", "page_id long, robots_meta string", ((1, "noindex, follow"), (2, "max-snippet:0; NOSNIPPET"), (3, None), (4, "max-snippet: 20, max-snippet:-1"), (5, " , ;")))
STRINGS = Fixture("strings", "sid long, s string", ((1, "Plans start at $29 a month for teams"), (2, "https://a.example/one two three four five six"), (3, "short one"), (4, "{\"a\": 1} and so on and so on and so on"), (5, "a_b/c:d"), (6, "  five   words   make   enough   here  "), (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa")))
QUESTIONS = Fixture("questions", "question_id string, anchor string, page_id long", (("Q-001", "fits every team", 1), ("Q-002", "the  same  words", 1), ("Q-003", "nowhere at all", 1), ("Q-004", "", 2), ("Q-005", "repeated run", 2)))
RUNS = Fixture("runs", "page_id long, run_ord long, text string", (
    (1, 1, "This plan fits every team. Really."), (1, 2, "Here the same words stand."), (1, 3, "And the same words again."), (2, 1, "A repeated run."), (2, 2, "A  repeated run."), (2, 3, "fits every team too"), (3, 1, "repeated run elsewhere"),
))
PASSAGES = Fixture("passages", "question_id string, page_id long, passage string", (
    ("Q-1", 1, "plan fits  every team"), ("Q-2", 1, "Really. Here the same"), ("Q-3", 1, "team. Really. Here the same words stand. And"), ("Q-4", 1, "Head line"), ("Q-5", 1, "The title"), ("Q-6", 1, "it's a dash - really"), ("Q-7", 1, "not there"), ("Q-8", 1, None), ("Q-9", 9, "no page"),
))
BLOCKS = Fixture("blocks", "page_id long, block_ord long, text string", ((1, 1, "This plan fits every team."), (1, 2, "Really."), (1, 3, "Here the same words stand."), (1, 4, "And it’s a dash – really.")))
HEAD_RUNS = Fixture("head_runs", "page_id long, text string", ((1, "A Head line here"), (1, "link")))
PAGE_TITLES = Fixture("page_titles_f", "page_id long, title string", ((1, "The  title"),))
FACTS = Fixture("facts", "site_id string, host string, wording string, types array<string>, paths array<string>", (
    ("a", "docs.a.example", "api reference and changelog", ["techarticle"], ["/docs/1", "/docs/2", "/x"]), ("b", "b.gov.uk", "news of the admission", [], ["/notice/1"]), ("c", "c.example", "nothing", [], []),
    ("d", "shop.d.example", "add to cart pricing sign up", ["product", "offer"], ["/cart", "/product/1"] + [f"/product/{i}" for i in range(9)]),
))
NAMES = Fixture("names", "site_id string, ord long, surface string, value string", (("a", 1, "title", "Acme Corp"), ("a", 2, "footer", "The Acme Company Ltd"), ("a", 3, "og", "Zeta Labs"), ("a", 4, "schema", "Acme Zeta"), ("a", 5, "x", "the of"), ("b", 1, "title", "Bolt")))
HANDLERS = Fixture("handlers", "page_id long, raw string, hrefs array<string>", (
    (1, "<a onclick(\"/a\")><b router.push('/b')> navigateTo(\"/c\") history.push( '/d')", ["http://x.example/a", "http://x.example/d?q=1"]), (2, None, []), (3, "onclick(\"/z\") onclick(\"/z\")", []),
))
DESCRIPTIONS = Fixture("descriptions", "page_id long, description string, visible string", ((1, "From $29, 50% off the Pro plan v2.1", "we charge $29 for pro"), (2, "Free", "FREE"), (3, None, "x"), (4, "€5 and €5", "")))
SHELLS = Fixture("shells", "page_id long, raw string, visible string, title string", (
    (1, "<noscript>Please enable JavaScript</noscript><div id=\"root\"></div>", "", "Loading..."), (2, "<p>fine</p>", "some words here", "Good"), (3, "<div class='x' id='app'> </div>", "x", ""),
))
HIDDEN = Fixture("hidden", "page_id long, raw string", ((1, "<p style=\"display:none\">a</p><span style=\"color:red;visibility: hidden\">b</span>"), (2, "<p class=\"sr-only\" style=\"display:none\">a</p>"), (3, "<i style=\"text-indent:-9999px\">x</i><b style=\"font-size:0;\">y</b>"), (4, None)))
LOGS = Fixture("probe_logs", "site_id string, body string", (
    ("a", "engine: one\ntimestamp: 2026-01-02T03:04:05Z\n# remark\n[Q-001] - absent\nnote: said nothing\n[Q-002] navigational official-cited\nhttps://a.example/1\nhttps://a.example/2\n"), ("b", "engine: one\n[Q-001] - absent\n"),
    ("c", "engine: e\ntimestamp: 2026-01-02T03:04:05Z\n[Q-001] - absent\n[Q-001] - odd\nstray words\n"),
))
PROMPTS = Fixture("prompts", "site_id string, question_id string, question string", tuple((s, f"Q-00{i}", f"what {i}?") for s in "abc" for i in (1, 2)))
