"""Queries over extracted pages, and SQL that reads the same from a page's tokens, one row each, by running counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import markup as H
from pagewright.functions.dates import date_conflicts
from pagewright.functions import text as T
from pagewright.operators import asof as W
from pagewright.operators import captures as Q
from pagewright.operators import destinations as D
from pagewright.operators import excerpts as E
from pagewright.operators import robots as R
from pagewright.operators import runs as N
from pagewright.operators import urls as U
from pagewright.operators.shared import stored
from pagewright.plans import audit as A
from pagewright.sources import html as P
from pagewright.sources.html import extract_pages

from .queries import part, query, sql_netloc, sql_path, table

_REST = r'(?:[^\x27">]|"[^"]*"|\x27[^\x27]*\x27)*'
_RAW = "|".join(rf"<{n}(?:[\s/]{_REST})?>.*?(?:</{n}(?:\s[^>]*)?>|\z)" for n in ("script", "style", "title"))
_TOKEN = rf"(?is)<!--.*?(?:-->|\z)|{_RAW}|<(?:/?[a-z]{_REST}|[!?][^>]*)>|[^<]+|<"
_ATTRIBUTE = H.ATTRIBUTE


def sql_unescape(x: str) -> str:
    """Character references replaced; a text is cut at them and put together again."""
    names = ", ".join(f"'{n}'" for n in H.NAMES)
    values = ", ".join("''''" if v == "'" else f"'{v}'" for v in H.NAMES.values())
    ref = f"regexp_extract_all({x}, '{H.REFERENCE}', 0)"
    number = "chr(cast(regexp_extract(r, '^&#([0-9]+)', 1) as integer))"
    decoded = f"list_transform({ref}, lambda r: case when regexp_matches(r, '^&#[0-9]') then {number} else coalesce(map([{names}], [{values}])[regexp_extract(r, '^&([a-zA-Z0-9]+);', 1)], r) end)"
    pieces = f"string_split_regex({x}, '{H.REFERENCE}')"
    return f"(case when contains({x}, '&') then (select array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(d[i], '')), '') from (select {pieces} as p, {decoded} as d)) else {x} end)"


def sql_fold(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{85}}\x{{A0}}]+', ' ', 'g'))"


def _names(*names: str) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_HEADS = tuple(f"h{i}" for i in range(1, 7))
_BLOCKS = tuple(t for t in P.BLOCK_TAGS if t not in _HEADS)
#: A row for each token: which section, block and link it stands in, and whether its heading or link has ended.
TOKENS = rf"""tok as (
  select page_id, {sql_netloc("url")} as site_id, i as pos, t[i] as tok, lower(regexp_extract(t[i], '^<(/?[a-zA-Z][^\s/>]*)', 1)) as name
  from (select page_id, url, regexp_extract_all(coalesce(html, ''), '{_TOKEN}', 0) as t from pages where {sql_netloc("url")} <> ''), unnest(range(1, len(t) + 1)) as u(i)
), kinds as (
  select *, (name in {_names(*_HEADS)})::int as h, (name in {_names(*("/" + n for n in _HEADS))})::int as h_end, (name = 'a')::int as a, (name = '/a')::int as a_end,
    (name in {_names(*_HEADS, *_BLOCKS, *("/" + n for n in _BLOCKS))})::int as b,
    case when name in ('noscript', 'template', 'svg') then 1 when name in ('/noscript', '/template', '/svg') then -1 else 0 end as hide
  from tok
), counted as (
  select *, sum(h) over w as sec, sum(b) over w as blk, sum(a) over w as lnk, sum(hide) over w as hidden from kinds window w as (partition by page_id order by pos)
), routed as (
  select *, sum(h_end) over (partition by page_id, sec order by pos) as head_ends, sum(a_end) over (partition by page_id, sec, lnk order by pos) as link_ends, sum(a) over (partition by page_id, sec order by pos) as links_here from counted
), texts as (
  select page_id, site_id, pos, sec, blk, lnk, case when sec > 0 and head_ends = 0 then 'heading' when links_here > 0 and link_ends = 0 then 'link' else 'block' end as part, {sql_unescape("tok")} as body
  from routed where name = '' and hidden = 0 and not regexp_matches(tok, '(?is)^<(?:!|\?|script|style|title)')
), blocks as (
  select page_id, sec, blk, {sql_fold("string_agg(body, ' ' order by pos)")} as block from texts where part = 'block' group by 1, 2, 3
), headings as (
  select page_id, sec, max(case when h = 1 then substr(name, 2, 1) end) as level, max(h_end) as closed from routed where sec > 0 and hidden = 0 group by 1, 2
), heading_texts as (
  select page_id, sec, {sql_fold("string_agg(body, '' order by pos)")} as heading from texts where part = 'heading' group by 1, 2
)"""
_PAGES = f"all_pages as (select page_id, {sql_netloc('url')} as site_id, html from pages where {sql_netloc('url')} <> '')"


def _extracted(spark, sf_dir, *columns):
    return extract_pages(A.site_pages(table(spark, sf_dir, "pages")).select("site_id", "page_id", "url", "html"))


@query(f"""with {TOKENS}, {_PAGES}, shown as (
  select page_id, string_agg(block, chr(10) order by sec, blk) as visible, count(*) as n_blocks from blocks where block <> '' group by 1
), sections as (
  select page_id, count(*) as n from (select page_id, sec from blocks where block <> '' union select h.page_id, h.sec from headings h join heading_texts t on h.page_id = t.page_id and h.sec = t.sec where closed = 1 and heading <> '') group by 1
), linked as (select page_id, count(*) as n from (select distinct page_id, sec, lnk from routed where name = '/a' and link_ends = 1 and links_here > 0) group by 1),
jsonld as (select page_id, count(*) as n from tok where regexp_matches(tok, '(?i)^<script[^>]*type\\s*=\\s*["\\x27]?application/ld\\+json') group by 1),
titles as (select page_id, min_by({sql_fold(sql_unescape("regexp_extract(tok, '(?is)^<title[^>]*>(.*?)(?:</title|\\z)', 1)"))}, pos) as title from tok where regexp_matches(tok, '(?i)^<title') group by 1)
select p.site_id, p.page_id, nullif(t.title, '') as title, coalesce(length(visible), 0) as visible_chars, md5(coalesce(visible, '')) as visible_md5,
  coalesce(len(regexp_extract_all(visible, '[^\\s\\x{{85}}\\x{{A0}}]+')), 0) as words, coalesce((select count(*) from headings h where h.page_id = p.page_id and closed = 1), 0) as n_headings,
  coalesce(l.n, 0) as n_links, (select count(*) from tok k where k.page_id = p.page_id and name = 'img') as n_images, coalesce(j.n, 0) as n_jsonld, coalesce(s.n, 0) as n_sections, coalesce(n_blocks, 0) as n_blocks
from all_pages p left join shown v on p.page_id = v.page_id left join sections s on p.page_id = s.page_id left join linked l on p.page_id = l.page_id left join jsonld j on p.page_id = j.page_id left join titles t on p.page_id = t.page_id""")
def page_extract(spark, sf_dir):
    """What extraction makes of each page."""
    return A.stats_of(_extracted(spark, sf_dir))


_HEADINGS = """told as (
  select h.page_id, h.sec, cast(h.level as integer) as level, coalesce(t.heading, '') as text from headings h left join heading_texts t on h.page_id = t.page_id and h.sec = t.sec where closed = 1
)"""


@query(f"with {TOKENS}, {_HEADINGS} select page_id, row_number() over (partition by page_id order by sec) as ord, level, text from told qualify ord <= {P.MOST['headings']}")
def page_headings(spark, sf_dir):
    """The heading tree of each page."""
    return _extracted(spark, sf_dir).select("page_id", F.posexplode("headings").alias("ord", "h")).select("page_id", (F.col("ord") + 1).alias("ord"), "h.level", "h.text")


@query(f"""with {TOKENS}, {_HEADINGS}, sized as (
  select page_id, sec, string_agg(block, chr(10) order by blk) as body, sum(length(block) + 1) as chars from blocks where block <> '' group by 1, 2
), keys as (select page_id, sec from sized union select page_id, sec from told), offsets as (
  select k.page_id, k.sec, t.text as heading, coalesce(t.level, 0) as heading_level, substr(coalesce(z.body, ''), 1, {P.MOST['section']}) as body,
    coalesce(sum(z.chars) over (partition by k.page_id order by k.sec rows between unbounded preceding and 1 preceding), 0) as char_offset
  from keys k left join sized z on k.page_id = z.page_id and k.sec = z.sec left join told t on k.page_id = t.page_id and k.sec = t.sec
) select page_id, cast(row_number() over (partition by page_id order by sec) as integer) as ord, heading, cast(heading_level as integer) as heading_level, cast(char_offset as bigint) as char_offset, md5(body) as body_md5 from offsets where body <> '' or coalesce(heading, '') <> ''""")
def page_sections(spark, sf_dir):
    """The sections of each page, and where each begins in its text."""
    rows = _extracted(spark, sf_dir).select("page_id", F.posexplode("sections").alias("ord", "s"))
    return rows.select("page_id", (F.col("ord") + 1).alias("ord"), "s.heading", "s.heading_level", "s.char_offset", F.md5(F.col("s.text").cast("binary")).alias("body_md5"))


_LINKS = f"""link_texts as (
  select page_id, sec, lnk, nullif(substr({sql_fold("string_agg(body, '' order by pos)")}, 1, {P.MOST['anchor']}), '') as anchor_text from texts where part = 'link' group by 1, 2, 3
), anchors as (
  select r.page_id, r.sec, r.lnk, min(r.pos) as pos, max(case when name = 'a' then {sql_unescape("regexp_extract(tok, '(?i)[[:space:]]href=\\x22([^\\x22]*)\\x22', 1)")} end) as href, max(case when name = '/a' and link_ends = 1 then 1 else 0 end) as closed
  from routed r where hidden = 0 and links_here > 0 group by 1, 2, 3
), linked as (
  select a.page_id, row_number() over (partition by a.page_id order by a.pos) as ord, p.url, a.href, t.anchor_text from anchors a join pages p on a.page_id = p.page_id
  left join link_texts t on a.page_id = t.page_id and a.sec = t.sec and a.lnk = t.lnk where closed = 1 and href <> ''
)"""


@query(f"""with {TOKENS}, {_LINKS} select page_id, ord, case when regexp_matches(href, '^[^:/?#]+:') then href when href like '//%' then regexp_extract(url, '^[^:/?#]+:', 0) || href
  when href like '/%' then regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0) || href else regexp_extract(url, '^[^:/?#]+://[^/?#]*/(?:[^?#]*/)?', 0) || href end as href, anchor_text from linked where ord <= {P.MOST['links']}""")
def page_anchors(spark, sf_dir):
    """The links of each page, resolved, with their texts."""
    return _extracted(spark, sf_dir).select("page_id", F.posexplode("links").alias("ord", "a")).select("page_id", (F.col("ord") + 1).alias("ord"), "a.href", "a.anchor_text")


@query(f"""with {TOKENS}, {_LINKS}, first as (select p.site_id, trim(anchor_text) as label, min(p.page_id * 1000 + ord) as seen from linked l join (select distinct page_id, site_id from tok) p on l.page_id = p.page_id where trim(anchor_text) <> '' group by 1, 2)
select site_id, row_number() over (partition by site_id order by seen) as place, label from first qualify place <= {E.MOST_LABELS}""")
def nav_inventory_pages(spark, sf_dir):
    """The first distinct link labels of each site."""
    links = _extracted(spark, sf_dir).select("site_id", F.col("page_id").alias("page_ord"), F.posexplode("links").alias("ord", "a")).select("site_id", "page_ord", "ord", "a.anchor_text")
    return E.nav_inventory(links)


@query(f"""with {TOKENS}, {_HEADINGS} select p.site_id, row_number() over (partition by p.site_id order by t.page_id, sec) as place, text from told t join (select distinct page_id, site_id from tok) p on t.page_id = p.page_id
where level <= 2 and text <> '' qualify place <= {E.MOST_HEADINGS}""")
def heading_inventory_pages(spark, sf_dir):
    """The first upper headings of each site."""
    heads = _extracted(spark, sf_dir).select("site_id", F.col("page_id").alias("page_ord"), F.posexplode("headings").alias("ord", "h")).select("site_id", "page_ord", "ord", "h.level", "h.text")
    return E.heading_inventory(heads)


@query(rf"""with t as (select page_id, {sql_fold(sql_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} as title from pages where {sql_netloc("url")} <> ''),
s as (select page_id, list_filter(list_transform(string_split_regex(title, '\s+[|–—·:»«]\s+'), lambda p: trim(p)), lambda p: p <> '') as parts from t where title <> '') select page_id, i as ord, parts[i] as segment from s, unnest(range(1, len(parts) + 1)) as u(i)""")
def title_segments_pages(spark, sf_dir):
    """The parts of each page's title."""
    return _extracted(spark, sf_dir).select("page_id", F.posexplode(T.title_segments(F.col("title"))).alias("ord", "segment")).select("page_id", (F.col("ord") + 1).alias("ord"), "segment")


@query(f"""select conv_id, coalesce(array_to_string((list(text order by turn) filter (length(text) between 10 and 300 and not regexp_matches(text, '^(?:https?://|/|#)')))[1:{P.MOST['strings']}], '|'), '') as strings
from (select conv_id, turn, i, case i when 1 then text else role end as text from conversations, unnest([1, 2]) as u(i) where turn < {P.MOST['items']}) group by 1""")
def state_text(spark, sf_dir):
    """What a page would know of each conversation from a payload that a script assigns."""
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    payload = F.concat(F.lit("window.state = "), F.to_json(F.struct(F.array_sort(F.collect_list(turn)).alias("turns"))), F.lit(";"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(payload.alias("payload"))
    return rows.select("conv_id", F.array_join(F.expr(P.state_strings(P.state_json("payload"))), "|").alias("strings"))


# what automated readers are served
_STATUS = (200, 403, 429, 503, 404)
_DIFFERENTIAL = """bots as (select * from fetches where token is not null), browsers as (select * from fetches where token is null and status is not null),
met as (select b.*, w.status as browser_status, w.at as browser_at from bots b left join browsers w on w.site_id = b.site_id and w.path = b.path and w.at <= b.at qualify row_number() over (partition by b.fetch_id order by w.at desc nulls last, w.fetch_id desc) = 1)
select site_id, fetch_id, token, path as requested_path, allows as robots_allows, case when coalesce(allows, true) then status end as status, browser_status, browser_at,
  case when coalesce(allows, true) and status in (401, 403, 429, 503) and status <> browser_status then 'browser ' || browser_status || ' / bot-UA ' || status end as differential, case when coalesce(allows, true) then robots_meta end as robots_meta, cast(null as varchar) as x_robots_tag from met"""


@query(f"""with fetches as (select 'events' as site_id, event_id as fetch_id, ts as at, case event_type when 'error' then 'GPTBot' when 'signup' then 'PerplexityBot' when 'purchase' then 'OAI-SearchBot' end as token,
  '/u/' || (user_id % 40) as path, [{", ".join(map(str, _STATUS))}][cast(floor(value) as integer) % 5 + 1] as status, event_type as robots_meta, cast(null as boolean) as allows from events), {_DIFFERENTIAL}""")
def ua_differential_events(spark, sf_dir):
    """Events as fetches of forty paths: what a bot got, beside what a browser got last."""
    rows = table(spark, sf_dir, "events")
    token = F.when(F.col("event_type") == "error", "GPTBot").when(F.col("event_type") == "signup", "PerplexityBot").when(F.col("event_type") == "purchase", "OAI-SearchBot")
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.floor("value") % 5 + 1).cast("int"))
    url = F.concat(F.lit("http://events/u/"), (F.col("user_id") % 40).cast("string"), F.lit("/?q"))
    body = F.concat(F.lit("<html><META content='"), F.col("event_type"), F.lit("' name=robots>"))
    return W.ua_probes(rows.select(F.lit("events").alias("site_id"), F.col("event_id").alias("fetch_id"), F.col("ts").alias("at"), token.alias("token"), url.alias("url"), status.alias("status"), body.alias("body"), F.lit(None).cast("string").alias("x_robots_tag")))


_ROBOTS_FILE = "User-agent: *\nDisallow: /en/\nAllow: /en/7\nDisallow: /de/8$\nAllow: /de/8\nDisallow: /es/*\n\nUser-agent: GPTBot\nDisallow: /\nAllow: /fr/*\n"
_RULES = "rules(agent, rule, dis) as (values ('*', '/en/', 1), ('*', '/en/7', 0), ('*', '/de/8$', 1), ('*', '/de/8', 0), ('*', '/es/*', 1), ('gptbot', '/', 1), ('gptbot', '/fr/*', 0))"
_FITS = "case when ends_with(rule, '$') then path = rtrim(rule, '$') else starts_with(path, rtrim(rule, '*')) end"


def _robots(pages):
    return R.robots_rows(pages.select("site_id").distinct().withColumn("body", F.lit(_ROBOTS_FILE)))


@query(f"""with {_RULES}, p as (select distinct {sql_netloc("url")} as site_id, {sql_path("url")} as path from pages where {sql_netloc("url")} <> ''), tokens(token, agent) as (values ('GPTBot', 'gptbot'), ('bingbot', '*')),
best as (select p.site_id, token, path, rule, dis, row_number() over (partition by p.site_id, token, path order by length(rtrim(rule, '$*')) desc nulls last, dis desc, rule desc) as t from p, tokens k left join rules r on r.agent = k.agent and {_FITS})
select site_id, token, path, rule, case dis when 1 then 'disallow' when 0 then 'allow' end as kind, coalesce(dis = 1, false) as blocked from best where t = 1""")
def robots_pages(spark, sf_dir):
    """What a given robots file says of each page's path."""
    pages = A.site_pages(table(spark, sf_dir, "pages")).select("site_id", T.norm_path(F.col("url")).alias("path"))
    tokens = pages.select("site_id", F.explode(F.array(F.lit("GPTBot"), F.lit("bingbot"))).alias("token")).distinct()
    return R.decide_paths(pages.select("site_id", "path"), _robots(pages), tokens)


@query(f"""with {_RULES}, paged as (select page_id, {sql_netloc("url")} as site_id, '/' || split_part({part("url", 3)}, '/', 2) as path, case page_id % 4 when 1 then 'GPTBot' when 2 then 'PerplexityBot' when 3 then 'OAI-SearchBot' end as token from pages where {sql_netloc("url")} <> ''),
fetches as (select site_id, page_id as fetch_id, page_id as at, token, path, [{", ".join(map(str, _STATUS))}][cast(page_id // 3 % 5 as integer) + 1] as status, cast(null as varchar) as robots_meta,
  coalesce((select arg_max(dis, length(rtrim(rule, '$*')) * 2 + dis) = 0 from rules where agent = case when token = 'GPTBot' then 'gptbot' else '*' end and {_FITS}), true) as allows from paged), {_DIFFERENTIAL}""")
def ua_differential_pages(spark, sf_dir):
    """Captures of pages, every fourth a browser's, under a given robots file; a section's pages count as one path."""
    pages = A.site_pages(table(spark, sf_dir, "pages"))
    token = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("GPTBot", "PerplexityBot", "OAI-SearchBot"))), (F.col("page_id") % 4 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.floor(F.col("page_id") / 3) % 5 + 1).cast("int"))
    url = F.concat(F.lit("http://h/"), F.coalesce(F.get(T.segments(F.col("url")), 0), F.lit("")))
    rows = pages.select("site_id", F.col("page_id").alias("fetch_id"), F.col("page_id").alias("at"), token.alias("token"), url.alias("url"), status.alias("status"), F.col("html").alias("body"), F.lit(None).cast("string").alias("x_robots_tag"))
    return W.ua_probes(rows, _robots(pages), stretch=50)


@query()
def name_groups_documents(spark, sf_dir):
    """The first words of a source's documents as variants of names."""
    words = F.slice(F.split(T.fold(F.col("text")), " "), 1, 3)
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("site_id"), F.col("doc_id").alias("ord"), F.col("lang").alias("surface"), F.array_join(words, " ").alias("value"))
    return N.name_groups(docs).select("site_id", "grp", "ord")


@query()
def name_groups_customers(spark, sf_dir):
    """Customers of a segment: names that share a word, and numbers."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("site_id"), F.col("c_custkey").alias("ord"), F.lit("name").alias("surface"))
    number = F.col("ord") % 300
    return N.name_groups(rows.withColumn("value", F.concat_ws(" ", F.when(number % 2 == 0, F.concat(F.lit("Shop"), (number / 10).cast("int").cast("string"))), (number % 7).cast("string"), (number % 11).cast("string")))).select("site_id", "grp", "ord")


# where fetches may go
_V4 = [(int(a[24:], 16), int(b[24:], 16), bits, kind) for a, b, bits, kind in D.block_rows() if a.startswith(D.MAPPED)]


@query(f"""with blocks(lo, hi, bits, kind) as (values {", ".join(f"({a}, {b}, {n}, '{k}')" for a, b, n, k in _V4)}),
a as (select event_id as id, user_id % 256 as p, event_id % 256 as q, event_id // 7 % 256 as r, event_id % 13 as s from events), n as (select *, p * 16777216 + q * 65536 + r * 256 + s as address from a),
held as (select id, p || '.' || q || '.' || r || '.' || s as host, kind, row_number() over (partition by id order by bits desc) as t from n left join blocks on address between lo and hi)
select id, host, coalesce(kind, 'public') as kind, coalesce(kind, 'public') = 'public' as allowed from held where t = 1
union all select -1 - page_id, regexp_replace({sql_netloc("url")}, ':[0-9]*$', ''), 'name', true from pages where {sql_netloc("url")} <> ''""")
def destinations(spark, sf_dir):
    """The hosts of pages, and addresses made of the events' numbers."""
    n = lambda c, by=256: (c % by).cast("string")
    events = table(spark, sf_dir, "events")
    parts = F.concat_ws(".", n(F.col("user_id")), n(F.col("event_id")), n(F.floor(F.col("event_id") / 7)), n(F.col("event_id"), 13))
    urls = events.select(F.col("event_id").alias("id"), F.concat(F.lit("http://"), parts, F.lit(":8080/")).alias("url"))
    pages = A.site_pages(table(spark, sf_dir, "pages")).select((-1 - F.col("page_id")).alias("id"), "url")
    return D.destinations(urls.unionByName(pages)).drop("url")


_SPANS = """spans as (select user_id as page_id, event_type as kind, event_id, case event_id % 5 when 3 then date_trunc('month', ts) when 4 then date_trunc('year', ts) else date_trunc('day', ts) end as first,
  case event_id % 5 when 3 then date_trunc('month', ts) + interval 1 month - interval 1 day when 4 then date_trunc('year', ts) + interval 1 year - interval 1 day else date_trunc('day', ts) end as last from events)"""


@query(f"with {_SPANS} select page_id, kind, count(*) as dates, max(first) > min(last) as conflict from spans group by 1, 2")
def date_conflicts_events(spark, sf_dir):
    """Events as dates that pages state, written in five ways: which pages contradict themselves?"""
    ways = ("yyyy-MM-dd'T'HH:mm:ss", "d MMMM yyyy", "MMM d, yyyy", "MMMM yyyy", "yyyy")
    value = F.coalesce(*[F.when(F.col("event_id") % 5 == i, F.date_format("ts", w)) for i, w in enumerate(ways)])
    return date_conflicts(table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_type").alias("kind"), value.alias("value")))


# stored answers, made of events
_ANSWERS = """answers as (select event_id, event_type as site_id, 'http://' || event_type || '.example/' || case user_id % 4 when 0 then 'pricing/' when 1 then 'docs/' else 'blog/' end || event_id as url,
  case cast(floor(value) as integer) % 6 when 0 then 404 when 1 then 410 when 2 then 500 when 3 then null else 200 end as status from events)"""


def _answers(spark, sf_dir):
    section = F.when(F.col("user_id") % 4 == 0, "pricing/").when(F.col("user_id") % 4 == 1, "docs/").otherwise("blog/")
    code = F.floor("value") % 6
    status = F.when(code == 0, 404).when(code == 1, 410).when(code == 2, 500).when(code > 3, 200)
    url = F.concat(F.lit("http://"), F.col("event_type"), F.lit(".example/"), section, F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("site_id"), url.alias("url"), status.alias("status"))


@query(f"""with {_ANSWERS}, r as (select *, coalesce(status >= 400 and status <> 410, false) as bad from answers),
g as (select site_id, count(*) as sampled, count_if(bad) as rotted, count_if(bad and regexp_matches({part('url', 3)}, '{U.DECISION_PATH}')) as on_decision_path from r group by 1)
select *, case when rotted = 0 then null when rotted >= 3 or on_decision_path > 0 then 'medium' else 'low' end as severity from g""")
def link_rot_events(spark, sf_dir):
    return U.link_rot(_answers(spark, sf_dir))


@query(f"""with {_ANSWERS}, c as (select *, case when event_id % 3 = 0 then [url, url || '/2', url || '/3'] else [url] end as ch, status is null or status >= 400 as failed from answers)
select site_id, url, case when failed then 0 else status end as status, case when failed then ch[-1] else url || '?final' end as final_url, array_to_string(ch, ' ') as chain from c where not failed or len(ch) >= 3""")
def fetch_outcomes_events(spark, sf_dir):
    chain = F.when(F.col("event_id") % 3 == 0, F.array("url", F.concat("url", F.lit("/2")), F.concat("url", F.lit("/3")))).otherwise(F.array("url"))
    rows = _answers(spark, sf_dir).select("site_id", "url", "status", F.lit(None).cast("string").alias("error"), F.concat("url", F.lit("?final")).alias("final_url"), chain.alias("chain"))
    return Q.fetch_outcomes(rows).withColumn("chain", F.array_join("chain", " "))


@query(f"""with {TOKENS}, {_HEADINGS}, starts as (select page_id, min(char_offset) as window_offset from (
  select page_id, sec, coalesce(sum(chars) over (partition by page_id order by sec rows between unbounded preceding and 1 preceding), 0) as char_offset, body_chars, heading from (
    select k.page_id, k.sec, coalesce(z.chars, 0) as chars, coalesce(z.chars, 0) as body_chars, t.text as heading from (select page_id, sec from blocks where block <> '' union select page_id, sec from told) k
    left join (select page_id, sec, sum(length(block) + 1) as chars from blocks where block <> '' group by 1, 2) z on k.page_id = z.page_id and k.sec = z.sec left join told t on k.page_id = t.page_id and k.sec = t.sec)) where body_chars > 0 or coalesce(heading, '') <> '' group by 1
), mains as (select page_id, arg_min(text, sec) as headline from told where level = 1 group by 1)
select p.page_id, cast(s.window_offset as bigint) as window_offset, m.headline, exists (select 1 from tok k where k.page_id = p.page_id and regexp_matches(k.tok, '(?is)^<[a-z][^>]*(?:class|id)\\s*=\\s*["\\x27]?[^"\\x27>]*(?:cookie|consent|gdpr|paywall|interstitial|onetrust|osano|subscribe-modal|signup-modal)')) as overlay_present
from (select distinct page_id from tok) p left join starts s on p.page_id = s.page_id left join mains m on p.page_id = m.page_id""")
def screen_windows_pages(spark, sf_dir):
    """Where each page's text begins, its headline, and whether its source has an overlay."""
    pages = stored(_extracted(spark, sf_dir).select("page_id", "overlay", "sections", "headings"))
    sections = pages.select("page_id", F.explode("sections").alias("s")).select("page_id", "s.char_offset")
    headings = pages.select("page_id", F.posexplode("headings").alias("ord", "h")).select("page_id", "ord", "h.level", "h.text")
    return E.screen_windows(pages.select("page_id", "overlay"), sections, headings)
