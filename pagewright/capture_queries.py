"""The queries of what follows from stored captures, of the bounded views, and of what a report says about itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import captures as W
from pagewright.operators import excerpts as E
from pagewright.operators import runs as N
from pagewright.plans import checks_content as K
from pagewright.plans import summary as Y
from pagewright.plans.fixtures import Fixture, ctes
from pagewright.queries import _URL, query, table

FETCHES = Fixture("fetches", "site_id string, url string, status int, error string, final_url string, chain array<string>", (
    ("a", "https://a.example/1", 200, None, "https://a.example/1", []), ("a", "https://a.example/2", 404, None, "https://a.example/2", ["x"]), ("a", "https://a.example/3", None, "too many redirects", None, ["u1", "u2", "u3", "u4"]),
    ("b", "http://b.example/", 301, None, "http://b.example/x", None), ("b", "http://b.example/5", 500, None, None, ["p", "q", "r"]), ("b", "http://b.example/6", None, "timeout", None, None),
))
PROBED = Fixture("probed", "site_id string, status int, error string, body string", (
    ("a", 200, None, "<a href=x>Home</a> <a href=y>Search</a> <A HREF=z>Popular</A>"), ("b", 404, None, "gone"), ("c", None, "timeout", None), ("d", 200, None, None), ("e", 410, None, "<p href= href= href= Did you mean this?"),
))
DEEP = Fixture("deep", "site_id string, url string", (("a", "https://www.a.example/pricing"), ("b", "https://B.example:8443/docs/x?q=1"), ("c", "https://c.example/")))
ANSWERS = Fixture("answers", "requested string, status int, error string, final_url string", (
    ("http://www.a.example/pricing", 200, None, "https://www.a.example/pricing"), ("https://a.example/pricing", 200, None, "https://www.a.example/"), ("http://B.example:8443/docs/x", None, "refused", None),
    ("https://www.b.example/docs/x", 403, None, "https://b.example/docs/x"), ("http://c.example/", 200, None, "https://c.example"),
))
LINKS = Fixture("links", "site_id string, page_ord long, link_ord long, href string", (
    ("a", 1, 1, "https://a.example/x/"), ("a", 1, 2, "https://a.example/x"), ("a", 1, 3, "mailto:x@a.example"), ("a", 1, 4, "https://cdn.a.example/y"), ("a", 1, 5, "https://nota.example/z"), ("a", 2, 1, "http://a.example/private/1"),
    ("a", 2, 2, "https://a.example/seen"), ("a", 2, 3, "https://a.example/4"), ("a", 2, 4, "https://a.example/5"), ("a", 2, 5, "https://a.example/6"), ("a", 3, 1, "https://a.example/7"), ("b", 1, 1, "//b.example/1"), ("b", 1, 2, "http://b.example/1"),
))
SEEN = Fixture("seen", "site_id string, url string", (("a", "https://a.example/seen/"), ("b", "http://b.example")))
HOSTS = Fixture("hosts", "site_id string, netloc string", (("a", "a.example"), ("b", "b.example")))
DECLARED = Fixture("declared", "site_id string, page_ord long, kind string, ord long, url string", (
    ("a", 1, "link", 1, "https://www.linkedin.com/company/a"), ("a", 1, "sameAs", 1, "https://linkedin.com/in/a"), ("a", 1, "sameAs", 2, "ftp://x"), ("a", 1, "link", 2, "https://unknown.example/"), ("a", 2, "link", 1, "https://en.wikipedia.org/wiki/A"),
    ("a", 2, "link", 2, "https://wikipedia.org/A"), ("a", 2, "sameAs", 1, "https://other.example/a"), ("b", 1, "link", 1, "https://b.example/about"), ("b", 1, "link", 2, "https://www.G2.com/b"),
))
EXPECTED = Fixture("expected", "question_id string, expected_page string", (("Q-1", "https://a.example/x"), ("Q-2", "http://www.A.example/x/"), ("Q-3", "https://a.example/none"), ("Q-4", None), ("Q-5", "https://b.example")))
KNOWN_PAGES = Fixture("known_pages", "page_id long, page_ord long, url string", ((1, 1, "https://a.example/x"), (2, 2, "https://www.a.example/x/"), (3, 3, "https://b.example/"), (4, 4, "https://a.example/x")))
SITE_PAGES = Fixture("site_pages", "site_id string, page_ord long, page_id long, url string, structured_dates array<string>, overlay boolean", (
    ("a", 1, 1, "u1", ["2024-01-01"], True), ("a", 2, 2, "u2", [], False), ("a", 3, 3, "u3", None, None), ("b", 1, 4, "v1", ["x", "y"], False),
))
SITE_HEADINGS = Fixture("site_headings", "site_id string, page_ord long, page_id long, ord long, level int, text string", (
    ("a", 1, 1, 1, 1, "Plans and Pricing"), ("a", 1, 1, 2, 2, "How to install"), ("a", 2, 2, 1, 2, "Compare A vs B"), ("a", 2, 2, 2, 1, "Release news"), ("a", 2, 2, 3, 1, "Later"), ("a", 3, 3, 1, 3, "Our policy"), ("a", 3, 3, 2, 2, None), ("b", 1, 4, 1, 2, ""),
))
DATE_CLAIMS = Fixture("date_claims", "page_id long, claim_ord long, type string, value string", tuple((1, 9 - i, "date", f"2020-01-0{i}") for i in range(1, 8)) + ((2, 1, "price", "$4"), (4, 1, "date", "May 2021")))
OFFSETS = Fixture("offsets", "page_id long, char_offset long", ((1, 40), (1, 12), (2, 0)))
LABELS = Fixture("nav_links", "site_id string, page_ord long, ord long, anchor_text string", (("a", 1, 1, " Home "), ("a", 1, 2, "Docs"), ("a", 1, 3, "Home"), ("a", 2, 1, None), ("a", 2, 2, "About"), ("b", 1, 1, "  ")))
SHED_RAW = Fixture("shed_raw", "id int, raw string", ((1, "off-site probes@151:over time"), (2, "x"), (3, " @5:y"), (4, None), (5, "y@abc: a:b "), (6, "z@-3"), (7, "w@12.9"), (8, "q:@7")))
RUNS_MADE = Fixture("runs_made", "site_id string, pages_selected long, fragments long, degraded boolean, seconds long", (("a", 8, 6, False, 120), ("b", 0, 0, False, None), ("c", None, 0, True, 400), ("d", 3, 2, False, 310)))
DROPPED = Fixture("dropped_work", "site_id string, ord long, what string, at_seconds int, reason string", (("a", 2, "second", 200, None), ("a", 1, "first", 151, "late")))
SAID = Fixture("said", "site_id string, field string, text string", (
    ("a", "title", "Add FAQPage markup, we guarantee it"), ("a", "evidence", "is_soft_404 is true in snapshot.pages"), ("a", "summary", "is_soft_404"), ("b", "title", "llms.txt helps discovery"), ("b", "title", "An LCP of 2.5 s"), ("b", "title", None), ("b", "title", "plain"),
))
GATES = Fixture("gates", "site_id string, gate string", (("a", "finding"), ("a", "pass"), ("a", "pass"), ("a", "not_evaluated"), ("b", "pass")))
LEFT_OUT = Fixture("left_out", "site_id string", (("a",), ("a",)))
TO_FIX = Fixture("to_fix", "site_id string, place long, severity string, title string, action string, effort string, owner string, acceptance_test string", (
    ("a", 2, "low", "Second", "do that", None, "web", None), ("a", 1, "high", "First", "do this", "small", "seo", "see that it is there"), ("a", 3, "low", "Third", "do more", None, None, None),
))
OPEN_ITEMS = Fixture("open_items", "site_id string, needs_verification long, not_evaluated long", (("a", 1, 0), ("b", 0, 3)))
RAW_URLS = Fixture("raw_urls", "id int, url string", ((1, "https://a.example/é?q=%e0%aB"), (2, "https://a.example/日本 x\"<>"), (3, "plain-._~!$&'()*+,;=:@/?#[]"), (4, ""), (5, None), (6, "ÿĀ")))
QUALIFIED = Fixture("qualified", "id int, text string", ((1, "Acme Software for teams"), (2, "Acme"), (3, "ACME LTD"), (4, None), (5, "The Acme foundation"), (6, "softwares")))
FOOTERS = Fixture("footers", "page_id long, raw string", (
    (1, "<script>copyright Bad Name Inc</script><footer>© 2024 Acme Widgets Inc. All Rights Reserved</footer>"), (2, "<p>Copyright First Co Ltd</p><p>(c) Second Name GmbH</p>"), (3, "(c) plain words"), (4, None), (5, "&copy; 2020 All Rights Reserved Legal"),
))


@query(f"""with {ctes(FETCHES)}, c as (select *, coalesce(chain, []) as ch, error is not null or status is null or status >= 400 as failed from fetches)
select site_id, url, case when failed then 0 else status end as status, case when failed then ch[-1] else final_url end as final_url, array_to_string(ch, ' ') as chain from c where not failed or len(ch) >= 3""")
def fetch_outcomes(spark, sf_dir):
    return W.fetch_outcomes(FETCHES.frame(spark)).withColumn("chain", F.array_join("chain", " "))


@query(f"""with {ctes(PROBED)}, l as (select *, lower(coalesce(body, '')) as low from probed where status is not null and error is null)
select site_id, status, status = 200 as is_soft_404, contains(low, 'search') as has_search, (length(low) - length(replace(low, '<a ', ''))) >= 9 or (length(low) - length(replace(low, 'href=', ''))) >= 15 as has_navigation, regexp_matches(low, '{W.SUGGESTIONS}') as has_suggestions from l""")
def soft_404_flags(spark, sf_dir):
    return W.soft_404_flags(PROBED.frame(spark))


_PART = lambda u, i: f"regexp_extract(coalesce({u}, ''), '{_URL}', {i})"


@query(f"""with {ctes(DEEP, ANSWERS)}, d as (select *, {_PART('url', 2)} as netloc, {_PART('url', 3)} as path, regexp_replace(lower({_PART('url', 2)}), ':[0-9]*$', '') as host from deep),
v as (select site_id, url, path, 'http' as variant, 'http://' || netloc || path as requested from d union all select site_id, url, path, case when starts_with(host, 'www.') then 'apex' else 'www' end, case when starts_with(host, 'www.') then 'https://' || host[5:] else 'https://www.' || host end || path from d),
s as (select requested, status, {_PART('final_url', 3)} as final_path from answers where error is null and status is not null)
select site_id, url, variant, v.requested, status, final_path, final_path = path as path_preserved, status < 400 as variant_ok from v left join s on s.requested = v.requested""")
def redirect_variants(spark, sf_dir):
    return W.redirect_variants(DEEP.frame(spark), ANSWERS.frame(spark))


@query(f"""with {ctes(LINKS, SEEN, HOSTS)}, r as (select l.*, regexp_replace(href, '/+$', '') as bare from links l join hosts h on h.site_id = l.site_id where {_PART('href', 1)} in ('http', 'https') and ({_PART('href', 2)} = netloc or ends_with({_PART('href', 2)}, '.' || netloc))),
f as (select * from r qualify row_number() over (partition by site_id, bare order by page_ord, link_ord) = 1), u as (select f.* from f left join seen s on s.site_id = f.site_id and regexp_replace(s.url, '/+$', '') = f.bare where s.url is null)
select site_id, href as url, row_number() over (partition by site_id order by page_ord, link_ord) as ord from u qualify ord <= 5""")
def link_rot_sample(spark, sf_dir):
    return W.link_rot_sample(LINKS.frame(spark), SEEN.frame(spark), HOSTS.frame(spark))


_KNOWN = ", ".join(f"'{d}'" for d in K.INDEPENDENT + K.OWNED)


@query(f"""with {ctes(DECLARED, HOSTS)}, d as (select d.*, netloc as site_netloc, lower({_PART('url', 2)}) as there, regexp_replace(lower({_PART('url', 2)}), '^www\\.', '') as domain from declared d join hosts h on h.site_id = d.site_id),
k as (select * from d where (kind = 'sameAs' and starts_with(url, 'http')) or (kind = 'link' and there <> '' and not ends_with(there, site_netloc) and domain in ({_KNOWN}))), f as (select * from k qualify row_number() over (partition by site_id, domain order by page_ord, kind = 'link', ord, url) = 1)
select site_id, domain, url, row_number() over (partition by site_id order by page_ord, kind = 'link', ord, domain) as ord from f qualify row_number() over (partition by site_id order by page_ord, kind = 'link', f.ord, domain) <= 12""")
def declared_external(spark, sf_dir):
    return W.declared_external(DECLARED.frame(spark), HOSTS.frame(spark), K.INDEPENDENT + K.OWNED)


_PAGE_KEY = lambda u: f"regexp_replace(lower({_PART(u, 2)}), '^www\\.', '') || coalesce(nullif(regexp_replace({_PART(u, 3)}, '/+$', ''), ''), '/')"


@query(f"""with {ctes(EXPECTED, KNOWN_PAGES)}, x as (select url, arg_min(page_id, page_ord) as id from known_pages group by 1), n as (select {_PAGE_KEY('url')} as k, arg_min(page_id, page_ord) as id from known_pages group by 1)
select question_id, coalesce(x.id, n.id) as page_id, case when x.id is not null then 'exact' when n.id is not null then 'normalised' else 'missing' end as how from expected left join x on x.url = expected_page left join n on n.k = {_PAGE_KEY('expected_page')}""")
def question_pages(spark, sf_dir):
    return W.question_pages(EXPECTED.frame(spark), KNOWN_PAGES.frame(spark))


_SLOTS = " union all ".join(f"select site_id, page_ord, {k + 1} as kind, '{name}' as archetype from h where " + " or ".join(f"contains(heads, '{w}')" for w in words) for k, (name, words) in enumerate(E.SLOTS))


@query(f"""with {ctes(SITE_PAGES, SITE_HEADINGS)}, h as (select site_id, page_ord, lower(string_agg(coalesce(text, ''), ' ' order by ord)) as heads from site_headings group by 1, 2), s as ({_SLOTS}),
a as (select s.site_id, s.page_ord, kind, archetype, url from s join site_pages p on p.site_id = s.site_id and p.page_ord = s.page_ord union all select site_id, -1, 0, 'identity', arg_min(url, page_ord) from site_pages group by 1)
select site_id, row_number() over (partition by site_id order by page_ord, kind)::integer as ord, archetype, url from a qualify ord <= 6""")
def suggested_slots(spark, sf_dir):
    return E.suggested_slots(SITE_PAGES.frame(spark).select("site_id", "page_ord", "url"), SITE_HEADINGS.frame(spark))


@query(f"""with {ctes(SITE_PAGES, DATE_CLAIMS)}, c as (select page_id, list(value order by claim_ord)[1:5] as vs from date_claims where type = 'date' group by 1)
select p.page_id, array_to_string(coalesce(structured_dates, []), ' ') as structured, array_to_string(coalesce(vs, []), ' ') as visible from site_pages p left join c on c.page_id = p.page_id""")
def page_dates(spark, sf_dir):
    return E.page_dates(SITE_PAGES.frame(spark).select("page_id", "structured_dates"), DATE_CLAIMS.frame(spark)).select("page_id", F.array_join("structured", " ").alias("structured"), F.array_join("visible", " ").alias("visible"))


@query(f"""with {ctes(SITE_PAGES, DATE_CLAIMS)} select site_id, count_if(len(coalesce(structured_dates, [])) > 0)::bigint as structured, count_if(page_id in (select page_id from date_claims where type = 'date'))::bigint as visible, count(*) as pages from site_pages group by 1""")
def date_coverage(spark, sf_dir):
    return E.date_coverage(SITE_PAGES.frame(spark).select("site_id", "page_id", "structured_dates"), DATE_CLAIMS.frame(spark))


@query(f"""with {ctes(SITE_PAGES, SITE_HEADINGS, OFFSETS)}, o as (select page_id, min(char_offset) as w from offsets group by 1), h as (select page_id, arg_min(text, ord) as t from site_headings where level = 1 group by 1)
select p.page_id, w as window_offset, t as headline, coalesce(overlay, false) as overlay_present from site_pages p left join o on o.page_id = p.page_id left join h on h.page_id = p.page_id""")
def screen_windows(spark, sf_dir):
    return E.screen_windows(SITE_PAGES.frame(spark).select("page_id", "overlay"), OFFSETS.frame(spark), SITE_HEADINGS.frame(spark))


@query(f"with {ctes(SITE_HEADINGS)} select site_id, row_number() over (partition by site_id order by page_ord, ord)::integer as place, text from site_headings where level in (1, 2) and text <> '' qualify place <= 30")
def heading_inventory(spark, sf_dir):
    return E.heading_inventory(SITE_HEADINGS.frame(spark))


@query(f"""with {ctes(LABELS)}, f as (select site_id, trim(anchor_text) as label, page_ord, ord from nav_links where trim(coalesce(anchor_text, '')) <> '' qualify row_number() over (partition by site_id, trim(anchor_text) order by page_ord, ord) = 1)
select site_id, row_number() over (partition by site_id order by page_ord, ord)::integer as place, label from f qualify place <= 20""")
def nav_inventory(spark, sf_dir):
    return E.nav_inventory(LABELS.frame(spark))


@query(f"""with {ctes(SHED_RAW)}, p as (select id, trim(coalesce(raw, '')) as t from shed_raw), h as (select id, regexp_extract(t, '^([^:]*)', 1) as head, trim(regexp_extract(t, '^[^:]*:(.*)$', 1)) as reason from p)
select id, trim(regexp_extract(head, '^([^@]*)', 1)) as what, greatest(0, coalesce(trunc(try_cast(trim(regexp_extract(head, '@(.*)$', 1)) as double)), 0))::integer as at_seconds, nullif(reason, '') as reason from h where trim(regexp_extract(head, '^([^@]*)', 1)) <> ''""")
def shed_argument(spark, sf_dir):
    return SHED_RAW.frame(spark).select("id", Y.shed_argument(F.col("raw")).alias("s")).where("s is not null").select("id", "s.*")


@query(f"""with {ctes(RUNS_MADE, DROPPED)}, d as (select site_id, list(format('Shed at {{}}s to stay inside the 300s budget: {{}}{{}}', at_seconds, what, coalesce(' (' || reason || ')', '')) order by ord) as lines from dropped_work group by 1),
r as (select r.*, coalesce(lines, []) as lines, coalesce(pages_selected = 0, degraded) as nothing from runs_made r left join d on d.site_id = r.site_id)
select site_id, case when nothing or len(lines) > 0 then 'partial' else 'complete' end as status, array_to_string(list_filter([case when degraded then 'Single-skill degraded mode: the judgment checks are not_evaluated.' end,
 case when fragments = 0 and not degraded then 'No specialist fragments were loaded; every check is not_evaluated by backfill.' end, case when nothing then 'No pages were captured; runnable checks are not_evaluated.' end, case when seconds is null then 'Runtime was not measured for this run.' end,
 case when seconds > 300 then format('This audit took {{}}s against a 300s budget; the report is complete.', seconds) end], lambda x: x is not null) || lines, ' / ') as limitations from r""")
def limitations(spark, sf_dir):
    return Y.limitations(RUNS_MADE.frame(spark), DROPPED.frame(spark)).withColumn("limitations", F.array_join("limitations", " / "))


@query(f"with {ctes(SAID)} " + " union all ".join([f"select site_id, field, '{w}' as warning from said where field <> 'evidence' and regexp_matches(text, '{r}')" for r, w in Y.FORBIDDEN] + [f"select site_id, field, '{w}' from said where field = 'evidence' and regexp_matches(text, '{r}')" for r, w in Y.LEAKED]))
def never_claims(spark, sf_dir):
    return Y.never_claims(SAID.frame(spark))


@query(f"""with {ctes(GATES, LEFT_OUT)} select site_id, count_if(gate = 'finding')::bigint as findings, count_if(gate = 'pass')::bigint as passes, (count_if(gate = 'not_evaluated') + (select count(*) from left_out l where l.site_id = gates.site_id))::bigint as not_evaluated from gates group by site_id""")
def fragment_summary(spark, sf_dir):
    return Y.fragment_summary(GATES.frame(spark), LEFT_OUT.frame(spark))


@query(f"""with {ctes(TO_FIX, OPEN_ITEMS)}, l as (select *, array_to_string(list_filter(['effort: ' || effort, 'owner: ' || owner], lambda x: x is not null), ', ') as bits from to_fix),
t as (select site_id, count(*) as n, string_agg(place || '. [' || upper(severity) || '] ' || title || chr(10) || '   Fix: ' || coalesce(action, '') || case when bits <> '' then ' (' || bits || ')' else '' end || coalesce(chr(10) || '   Verify: ' || acceptance_test, ''), chr(10) order by place) as lines from l group by 1)
select o.site_id, array_to_string(list_filter([format('Audit of {{}}: {{}} finding(s). Fix in this order:', o.site_id, coalesce(n, 0)), lines, case when needs_verification > 0 then format('{{}} item(s) need verification before they can be called defects.', needs_verification) end,
 case when not_evaluated > 0 then format('{{}} check(s) were not evaluated; that is not a defect.', not_evaluated) end], lambda x: x is not null), chr(10)) as summary from open_items o left join t on t.site_id = o.site_id""")
def human_summary(spark, sf_dir):
    return Y.human_summary(TO_FIX.frame(spark), OPEN_ITEMS.frame(spark))


_ENCODED = """array_to_string(list_transform(regexp_extract_all(coalesce(url, ''), '(?s)%[0-9a-fA-F]{{2}}|.'), lambda x: case when regexp_matches(x, '^%[0-9a-f]{{2}}$') then upper(x) when regexp_matches(x, '^(%..|[A-Za-z0-9:/?#\\[\\]@!$&''()*+,;=%~._-])$') then x
 when regexp_matches(url, '^[\\x{{00}}-\\x{{FF}}]*$') then printf('%%%02X', unicode(x)) else regexp_replace(hex(encode(x)), '(..)', '%\\1', 'g') end), '')"""


@query(f"with {ctes(RAW_URLS)} select id, {_ENCODED.replace('{{', '{').replace('}}', '}')} as encoded from raw_urls")
def pct_encode_url(spark, sf_dir):
    return RAW_URLS.frame(spark).select("id", T.pct_encode_url(F.col("url")).alias("encoded"))


@query("""select page_id, array_to_string(list_transform(regexp_extract_all(coalesce(url, ''), '(?s)%[0-9a-fA-F]{2}|.'), lambda x: case when regexp_matches(x, '^%[0-9a-f]{2}$') then upper(x) else x end), '') as encoded from pages""")
def pct_encode_pages(spark, sf_dir):
    """The generated urls are ASCII and need no encoding."""
    return table(spark, sf_dir, "pages").select("page_id", T.pct_encode_url(F.col("url")).alias("encoded"))


@query(f"with {ctes(QUALIFIED)} select id, len(list_intersect(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), [{', '.join(repr(w) for w in T.QUALIFIERS + tuple(t for t in T.LEGAL_TOKENS if t != 'foundation'))}])) > 0 as qualified from qualified")
def has_qualifier(spark, sf_dir):
    return QUALIFIED.frame(spark).select("id", T.has_qualifier(F.col("text")).alias("qualified"))


@query()
def footer_name(spark, sf_dir):
    return FOOTERS.frame(spark).select("page_id", N.footer_name(F.col("raw")).alias("name"))


@query("select doc_id, json_extract_string(json_object('a', json_object('lang', lang, 'n', n_chars)), '$.a.lang') as lang, cast(json_extract(json_object('a', json_object('lang', lang, 'n', n_chars)), '$.a.n') as varchar) as n from documents")
def dotted_path(spark, sf_dir):
    """A value deep in a stored document, by its dotted path."""
    body = F.to_json(F.struct(F.struct("lang", F.col("n_chars").alias("n")).alias("a")))
    return table(spark, sf_dir, "documents").select("doc_id", T.dig(body, "a.lang").alias("lang"), T.dig(body, "a.n").alias("n"))
