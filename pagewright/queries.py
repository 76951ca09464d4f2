"""The registered queries of the engine's own operators, each with the SQL that states the same, where SQL can."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions.jsonschema import schema_errors
from pagewright.operators import claims as C
from pagewright.operators import passages as P
from pagewright.operators import robots as R
from pagewright.operators import runs as N
from pagewright.operators import urls as U
from pagewright.operators.containment import contained
from pagewright.operators.shared import stored
from pagewright.plans import audit as A
from pagewright.plans import checks_content as K
from pagewright.plans import fixtures as X
from pagewright.plans import report as M
from pagewright.plans import verdicts as V
from pagewright.plans.catalog import catalog, catalog_rows
from pagewright.sources import files as S
from pagewright.sources.html import extract_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of the url functions
_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(url: str, i: int) -> str:
    return f"regexp_extract(coalesce({url}, ''), '{_URL}', {i})"


def sql_netloc(url: str) -> str:
    return f"lower(regexp_replace({part(url, 2)}, '\\.+$', ''))"


def sql_path(url: str) -> str:
    p = f"regexp_replace({part(url, 3)}, '/+$', '')"
    return f"(case when {p} = '' then '/' else {p} end)"


def sql_doc(url: str) -> str:
    host = f"regexp_replace(regexp_replace(lower({part(url, 2)}), '\\.+$', ''), '^www\\.', '')"
    return f"({host} || regexp_replace(regexp_replace(regexp_replace({part(url, 3)}, '/+$', ''), '/index\\.html?$', ''), '/+$', ''))"


def sql_hop(url: str) -> str:
    q, p = part(url, 4), part(url, 3)
    return f"(lower({part(url, 1)}) || '://' || lower({part(url, 2)}) || case when {p} = '' then '/' else {p} end || case when {q} = '' then '' else '?' || {q} end)"


def sql_cluster(url: str) -> str:
    segs = f"list_filter(string_split({part(url, 3)}, '/'), lambda s: s <> '')"
    return f"('/' || coalesce(array_to_string(list_transform({segs}[1:2], lambda s: regexp_replace(s, '[0-9]+', '{{d}}', 'g')), '/'), ''))"


def sql_fold(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    stop = ", ".join(f"'{t}'" for t in T.STOP_TOKENS + T.LEGAL_TOKENS)
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')), lambda t: t not in ({stop}))"


_RANK = "case {} when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end"
_CATALOG = "catalog as (select * from (values " + ", ".join(f"('{c}', '{s}', '{k}', {b!r}, '{d}')" for c, s, k, b, d in catalog_rows()) + ") as t(check_id, skill_id, category, severity_band, decided))"


# pages
def _regex_rows(spark: SparkSession, sf_dir: str, pattern: str, group: int = 1) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), group)).alias("ord", "value"))


def _regex_sql(pattern: str, group: int = 1) -> str:
    return f"select page_id, i - 1 as ord, v[i] as value from (select page_id, regexp_extract_all(html, '{pattern}', {group}) as v from pages) , unnest(range(1, len(v) + 1)) as t(i)"


@query(_regex_sql("(?s)<title>(.*?)</title>"))
def page_titles(spark, sf_dir):
    return _regex_rows(spark, sf_dir, "(?s)<title>(.*?)</title>")


@query(_regex_sql("(?s)<h1>(.*?)</h1>"))
def page_h1(spark, sf_dir):
    return _regex_rows(spark, sf_dir, "(?s)<h1>(.*?)</h1>")


@query(_regex_sql('<a href="([^"]*)"'))
def page_links(spark, sf_dir):
    return _regex_rows(spark, sf_dir, '<a href="([^"]*)"')


@query("with p as (select page_id, regexp_extract_all(html, '<p>([^<]*)', 1) as ps from pages) select page_id, len(ps)::bigint as paragraphs, length(array_to_string(ps, ''))::bigint as chars from p")
def page_paragraphs(spark, sf_dir):
    ps = F.regexp_extract_all("html", F.lit("<p>([^<]*)"), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(ps).cast("long").alias("paragraphs"), F.length(F.array_join(ps, "")).cast("long").alias("chars"))


@query()
def site_repetition(spark, sf_dir):
    return A.site_repetition(table(spark, sf_dir, "pages"))


@query()
def audit_findings(spark, sf_dir):
    captures = A.site_pages(table(spark, sf_dir, "pages"))
    return A.audit(spark, {"sites": A.bare_sites(captures), "pages": A.page_frame(captures)}, stored)["results"].groupBy("check_id", "gate").agg(F.count("*").alias("sites"))


@query(f"select {sql_netloc('url')} as site_id, {sql_cluster('url')} as pattern, count(*) as n from pages group by 1, 2 qualify row_number() over (partition by {sql_netloc('url')} order by count(*) desc, {sql_cluster('url')}) <= 15")
def url_clusters(spark, sf_dir):
    return U.url_clusters(A.site_pages(table(spark, sf_dir, "pages")).select("site_id", "url")).drop("rank")


@query(f"select page_id, {sql_netloc('url')} as netloc, {sql_path('url')} as path_key, {sql_doc('url')} as doc_key, {sql_hop('url')} as hop_key, {sql_cluster('url')} as cluster from pages")
def url_keys(spark, sf_dir):
    return U.url_keys(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@query(f"with {X.ctes(X.URLS)} select ord, site_id, {sql_netloc('url')} as netloc, {sql_path('url')} as path_key, {sql_doc('url')} as doc_key, {sql_hop('url')} as hop_key, {sql_cluster('url')} as cluster from urls")
def url_keys_cases(spark, sf_dir):
    return U.url_keys(X.URLS.frame(spark)).drop("url")


_ASSET, _LISTING = U.ASSET, U.LISTING


@query(f"""with {X.ctes(X.LINKS)}, good as (select * from links where {part('href', 1)} in ('http', 'https') and {sql_netloc('href')} = netloc and {sql_path('href')} <> '/'
  and not regexp_matches({part('href', 3)}, '{_ASSET}') and not regexp_matches({part('href', 3)}, '{_LISTING}')),
first as (select site_id, {sql_path('href')} as k, min(ord) as o, arg_min(href, ord) as url from good group by 1, 2)
select site_id, url, row_number() over (partition by site_id order by o, k) as ord from first""")
def candidate_links(spark, sf_dir):
    return U.candidate_links(X.LINKS.frame(spark))


@query()
def candidate_links_pages(spark, sf_dir):
    pages = extract_pages(A.site_pages(table(spark, sf_dir, "pages")).select("site_id", "page_ord", "url", "html"))
    links = pages.select("site_id", F.col("site_id").alias("netloc"), "page_ord", F.posexplode("links.href").alias("i", "href")).withColumn("ord", F.struct("page_ord", "i"))
    return U.candidate_links(links)


def _select_sql(rows: str) -> str:
    fit = " ".join(f"when regexp_matches(pattern, '(?i){rx}') or regexp_matches(seen, '(?i){rx}') then {i}" for i, (_, rx) in enumerate(U.PRIORITIES))
    label = " ".join(f"when {i} then '{name}'" for i, (name, _) in enumerate(U.PRIORITIES))
    return f"""r as (select *, {sql_cluster('url')} as pattern from {rows}),
s as (select *, count(*) over (partition by site_id, pattern) as size, row_number() over (partition by site_id, pattern order by ord) as turn from r),
home as (select site_id, arg_min(url, ord) as url, 'homepage' as page_class, 0 as phase, 0 as priority, 0 as size, 0 as ord from s where {part('url', 3)} in ('', '/') group by site_id),
g as (select site_id, pattern, max(size) as size, min(ord) as ord, arg_min(url, ord) as url, string_agg(url, chr(10)) as seen from s where turn <= 3 group by site_id, pattern),
h as (select *, case {fit} else {len(U.PRIORITIES)} end as priority from g),
k as (select site_id, url, case priority {label} else 'other' end as page_class, case when regexp_matches(pattern, '(?i){U.ACCOUNT}') or regexp_matches(url, '(?i){U.ACCOUNT}') then 2 else 1 end as phase, priority, size, ord from h),
b as (select *, row_number() over (partition by site_id, url order by phase, priority) as dup from (select * from home union all select * from k)),
o as (select site_id, url, page_class, row_number() over (partition by site_id order by phase, priority, size desc, ord, url) as ord from b where dup = 1)
select site_id, url, page_class, ord from o where ord <= 8"""


@query(f"with p as (select {sql_netloc('url')} as site_id, url, row_number() over (partition by {sql_netloc('url')} order by page_id) as ord from pages), {_select_sql('p')}")
def select_pages(spark, sf_dir):
    return A.chosen_pages(table(spark, sf_dir, "pages"))


@query(f"with {X.ctes(X.URLS)}, {_select_sql('urls')}")
def select_pages_cases(spark, sf_dir):
    return U.select_pages(X.URLS.frame(spark))


def _site_type_sql() -> str:
    arms = []
    for name, (types, markers, phrases) in U.SITE_TYPES.items():
        score = f"4 * len(list_intersect(types, {list(types)!r})) + least(6, len(list_filter(paths, lambda p: " + " or ".join(f"contains(p, '{m}')" for m in markers) + ")))"
        score += "".join(f" + 2 * contains(wording, '{p}')::int" for p in phrases)
        if name == "gov-edu":
            score += f" + 10 * regexp_matches(host, '{U.PUBLIC_HOST}')::int"
        score += "".join(f" + 5 * starts_with(host, '{p}')::int" for p, k in U.HOST_PREFIXES if k == name)
        arms.append(f"select site_id, '{name}' as site_type, cast({score} as integer) as score from facts")
    return f"with {X.ctes(X.FACTS)}, s as ({' union all '.join(arms)}), b as (select *, max(score) over (partition by site_id) as best from s where score > 0), r as (select site_id, site_type, score, row_number() over (partition by site_id order by score desc, site_type) as rank from b where score >= 4 and score * 2 >= best) select * from r where rank <= 3"


@query(_site_type_sql())
def site_type_score(spark, sf_dir):
    return U.site_type_scores(X.FACTS.frame(spark))


@query(f"""with {X.ctes(X.SITEMAP, X.LINKS)}, l as (select distinct site_id, {sql_path('href')} as k from links where {sql_netloc('href')} = netloc)
select site_id, url, (len(list_filter(string_split({part('url', 3)}, '/'), lambda s: s <> '')) <= 1 and regexp_matches(url, '{U.ORPHAN_PATH}')) as important from entries e
where not exists (select 1 from l where l.site_id = e.site_id and l.k = {sql_path('e.url')})""")
def sitemap_orphans(spark, sf_dir):
    return U.sitemap_orphans(X.SITEMAP.frame(spark), X.LINKS.frame(spark), spark.createDataFrame([], "site_id string, url string"))


@query(f"""with e as (select {sql_netloc('url')} as site_id, url from pages), h as (select {sql_netloc('url')} as site_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages),
l as (select distinct site_id, {sql_path('href')} as k from h) select e.site_id, count(*) as orphans from e where not exists (select 1 from l where l.site_id = e.site_id and l.k = {sql_path('e.url')}) group by 1""")
def sitemap_orphans_pages(spark, sf_dir):
    pages = A.site_pages(table(spark, sf_dir, "pages"))
    links = pages.select("site_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("path"))
    links = links.select("site_id", F.col("site_id").alias("netloc"), F.concat(F.lit("http://"), "site_id", "path").alias("href"))
    found = U.sitemap_orphans(pages.select("site_id", "url"), links, spark.createDataFrame([], "site_id string, url string"))
    return found.groupBy("site_id").agg(F.count("*").alias("orphans"))


@query(f"with {X.ctes(X.SITEMAP)}, e as (select site_id, nullif(trim(coalesce(lastmod, '')), '') as m from entries) select site_id, count(*) as entries, count(m) as present, count(distinct m) as distinct_values from e group by 1")
def lastmod_stats(spark, sf_dir):
    return U.lastmod_stats(X.SITEMAP.frame(spark))


@query(f"""with {X.ctes(X.LOCALES, X.ALTERNATES)}, bad as (select site_id, url, 'invalid lang' as issue, lang as value from alternates where not regexp_matches(lang, '{U.LANG_TAG}')),
met as (select a.site_id, a.url, lower(coalesce(p.lang, '')) as own, t.url as target from alternates a join locales p on p.site_id = a.site_id and p.url = a.url join locales t on t.site_id = a.site_id and {sql_path('t.url')} = {sql_path('a.href')} where regexp_matches(a.lang, '{U.LANG_TAG}'))
select * from bad union all select site_id, url, 'missing reciprocal tag', target from met where not exists (select 1 from alternates b where b.site_id = met.site_id and b.url = met.target and lower(coalesce(b.lang, '')) = met.own)""")
def hreflang_reciprocity(spark, sf_dir):
    return U.hreflang_problems(X.LOCALES.frame(spark), X.ALTERNATES.frame(spark))


@query(f"""with {X.ctes(X.CHAINS)}, k as (select site_id, url, len(chain) as n, list_transform(chain, lambda c: {sql_hop('c')}) as ks from chains),
l as (select *, len(list_distinct(ks)) < len(ks) as loops, greatest(n - 1, 0) as hops from k) select site_id, url, hops::integer as hops, loops, not loops and hops >= 4 as long_chain from l""")
def redirect_loops(spark, sf_dir):
    return U.redirect_shapes(X.CHAINS.frame(spark))


@query(f"""with {X.ctes(X.CANONICALS)}, c as (select *, {sql_doc('canonical')} as target_key, {sql_doc("coalesce(nullif(final_url, ''), url)")} as own from pages_c where coalesce(canonical, '') <> '')
select site_id, url, canonical, len(chain) > 1 as redirected, target_key from c where target_key <> own""")
def canonical_conflict(spark, sf_dir):
    return U.canonical_conflicts(X.CANONICALS.frame(spark))


@query(f"""with {X.ctes(X.PROBED)}, r as (select *, coalesce(status >= 400 and status <> 410, false) as bad from probed),
g as (select site_id, count(*) as sampled, count_if(bad) as rotted, count_if(bad and regexp_matches({part('url', 3)}, '{U.DECISION_PATH}')) as on_decision_path from r group by 1)
select *, case when rotted = 0 then null when rotted >= 3 or on_decision_path > 0 then 'medium' else 'low' end as severity from g""")
def link_rot(spark, sf_dir):
    return U.link_rot(X.PROBED.frame(spark))


_LATENCY = "select {k} as site_id, count(*) as n, cast(floor(median({t})) as bigint) as median_ms, min({t}) as min_ms, max({t}) as max_ms from {f} where {t} > 0 and {s} < 400 group by 1"
_BAR = "select *, case when n < 3 then 'not_evaluated' when median_ms >= 5000 then 'high' when median_ms >= 2500 then 'medium' else 'pass' end as severity from g"


@query(f"with {X.ctes(X.TIMES)}, g as ({_LATENCY.format(k='site_id', t='timing_ms', s='status', f='times')}) {_BAR}")
def fetch_latency(spark, sf_dir):
    return U.fetch_latency(X.TIMES.frame(spark))


@query(f"with e as (select event_type as k, cast(floor(value * 100) as bigint) as v, 200 as st from events), g as ({_LATENCY.format(k='k', t='v', s='st', f='e')}) {_BAR}")
def fetch_latency_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("site_id"), F.floor(F.col("value") * 100).alias("timing_ms"), F.lit(200).alias("status"))
    return U.fetch_latency(rows)


# robots
_LINES = f"""{X.ctes(X.ROBOTS)}, raw as (select site_id, i - 1 as ord, trim(regexp_replace(string_split(body, chr(10))[i], '#.*$', '')) as line from robots_files, unnest(range(1, len(string_split(body, chr(10))) + 1)) as t(i)),
kv as (select site_id, ord, lower(trim(regexp_extract(line, '^([^:]*):', 1))) as key, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) as value from raw where contains(line, ':')),
r0 as (select *, coalesce(max(case when key = 'user-agent' then 1 else 0 end) over (partition by site_id order by ord rows between unbounded preceding and 1 preceding), 0) as after from kv where key in ('user-agent', 'allow', 'disallow')),
r1 as (select * from r0 where key = 'user-agent' or (after = 1 and value <> '')),
r2 as (select *, case when key = 'user-agent' and coalesce(lag(key) over (partition by site_id order by ord), 'user-agent') <> 'user-agent' then 1 else 0 end as st from r1),
grps as (select site_id, cast(sum(st) over (partition by site_id order by ord) as bigint) as grp, ord, key, value from r2)"""


@query(f"with {_LINES} select * from grps")
def robots_parse(spark, sf_dir):
    return R.robots_groups(X.ROBOTS.frame(spark))


_ROWS = f"""{_LINES}, rules as (select site_id, grp, coalesce(list(value order by ord) filter (key = 'disallow'), []) as d, coalesce(list(value order by ord) filter (key = 'allow'), []) as a from grps group by 1, 2),
rrows as (select g.site_id, g.grp, g.ord, lower(g.value) as token, r.d, r.a from grps g join rules r on r.site_id = g.site_id and r.grp = g.grp where g.key = 'user-agent')"""
_SEARCH = ", ".join(f"'{t}'" for t in R.SEARCH_TOKENS)


@query(f"with {_ROWS} select site_id, grp, token, case when token in ({_SEARCH}) then 'search-index' when token = '*' then 'wildcard' else 'unknown' end as role, array_to_string(d, ' ') as disallow, array_to_string(a, ' ') as allow, case when token = '*' then list_contains(d, '/') end as catch_all from rrows")
def robots_rows(spark, sf_dir):
    return R.robots_rows(X.ROBOTS.frame(spark)).select("site_id", "grp", "token", "role", F.array_join("disallow", " ").alias("disallow"), F.array_join("allow", " ").alias("allow"), "catch_all")


def _decide_sql(fits: str, size: str) -> str:
    tokens = " union all ".join(f"select '{t}' as token" for t in ("googlebot", "PerplexityBot", "bingbot", "oai-searchbot"))
    return f"""with {_ROWS}, {X.ctes(X.PATHS)}, tk as ({tokens}), named as (select distinct p.site_id, token, case when exists (select 1 from rrows r where r.site_id = p.site_id and r.token = lower(tk.token)) then lower(tk.token) else '*' end as agent from tk, paths p),
rule as (select distinct site_id, token as agent, unnest(d) as rule, 1 as dis from rrows union select distinct site_id, token, unnest(a), 0 from rrows),
met as (select n.site_id, n.token, p.path, r.rule, r.dis, {size} as size from named n join paths p on p.site_id = n.site_id left join rule r on r.site_id = n.site_id and r.agent = n.agent and {fits}),
best as (select *, row_number() over (partition by site_id, token, path order by size desc nulls last, dis desc, rule desc) as t from met)
select site_id, token, path, rule, case dis when 1 then 'disallow' when 0 then 'allow' end as kind, coalesce(dis = 1, false) as blocked from best where t = 1"""


def _decide(spark: SparkSession, anchored: bool) -> DataFrame:
    files = X.ROBOTS.frame(spark)
    tokens = files.select("site_id", F.explode(F.array(*map(F.lit, ("googlebot", "PerplexityBot", "bingbot", "oai-searchbot")))).alias("token"))
    return R.decide_paths(X.PATHS.frame(spark), R.robots_rows(files), tokens, anchored)


@query(_decide_sql("(case when ends_with(r.rule, '$') then p.path = regexp_replace(r.rule, '\\$$', '') else starts_with(p.path, regexp_replace(r.rule, '\\*+$', '')) end)", "length(regexp_replace(r.rule, '[*$]+$', ''))"))
def robots_longest_match(spark, sf_dir):
    return _decide(spark, True)


@query(_decide_sql("starts_with(p.path, regexp_replace(regexp_extract(r.rule, '^([^$]*)', 1), '\\*+$', ''))", "length(regexp_replace(regexp_extract(r.rule, '^([^$]*)', 1), '\\*+$', ''))"))
def robots_longest_match_collector(spark, sf_dir):
    return _decide(spark, False)


# text and runs
@query(f"select doc_id, md5({sql_fold('text')}) as folded from documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query(f"select doc_id, md5({sql_fold("translate(coalesce(text, ''), '" + T.CONFUSABLES.replace(chr(39), chr(39) * 2) + "', '" + T.CONFUSABLES_AS.replace(chr(39), chr(39) * 2) + "')")}) as folded from documents")
def fold_confusables(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_confusables(F.col("text"))).alias("folded"))


@query(f"with {X.ctes(X.TITLES)}, f as (select page_id, {sql_fold('title')} as t from titles), p as (select *, list_filter(list_transform(regexp_split_to_array(t, '\\s+[|–—·:»«]\\s+'), lambda x: trim(x)), lambda x: x <> '') as ps from f) select page_id, array_to_string(case when len(ps) > 0 then ps when t <> '' then [t] else [] end, ';') as parts from p")
def title_segments(spark, sf_dir):
    return X.TITLES.frame(spark).select("page_id", F.array_join(T.title_segments(F.col("title")), ";").alias("parts"))


@query(f"with {X.ctes(X.TITLES)} select page_id, array_to_string(list_sort({sql_tokens('title')}), ' ') as tokens from titles")
def name_tokens(spark, sf_dir):
    return X.TITLES.frame(spark).select("page_id", F.array_join(F.array_sort(T.name_tokens(F.col("title"))), " ").alias("tokens"))


@query(f"""with {X.ctes(X.META)}, p as (select page_id, i, trim(ps[i]) as d from (select page_id, regexp_split_to_array(lower(coalesce(robots_meta, '')), '[,;]') as ps from metas), unnest(range(1, len(ps) + 1)) as t(i)),
k as (select page_id, i, trim(regexp_extract(d, '^([^:]*)', 1)) as name, case when contains(d, ':') then trim(regexp_extract(d, '^[^:]*:(.*)$', 1)) end as value from p where d <> '')
select page_id, name, value from k qualify row_number() over (partition by page_id, name order by i desc) = 1""")
def directives(spark, sf_dir):
    return X.META.frame(spark).select("page_id", F.explode(T.directives(F.col("robots_meta"))).alias("name", "value"))


@query(f"""with {X.ctes(X.STRINGS)}, f as (select sid, {sql_fold('s')} as t from strings) select sid, length(t) >= 25 and len(string_split(t, ' ')) >= 5 and not regexp_matches(t, '^(?:http|/|#|\\{{|fn:|urn:)') and not regexp_matches(t, '^[A-Za-z0-9_/.:,@%+=-]+$') as fact from f""")
def fact_like(spark, sf_dir):
    return X.STRINGS.frame(spark).select("sid", T.fact_like(F.col("s")).alias("fact"))


def _documents_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.opening_lines(table(spark, sf_dir, "documents").select(F.col("source").alias("site_id"), F.col("doc_id").alias("page_id"), "text"))


_OPENING = f"""l as (select source as site_id, doc_id as page_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {sql_fold('x')}), lambda x: x <> '')[1:150] as ls from documents), o as (select site_id, page_id, unnest(ls) as line from l)"""


@query(f"with {_OPENING} select site_id, line, count(distinct page_id) as pages, length(line) as chars from o group by 1, 2 having count(distinct page_id) > 1")
def run_repetition(spark, sf_dir):
    return N.run_repetition(_documents_runs(spark, sf_dir))


_NEED = "n as (select site_id, cast(greatest(2, ceil(count(distinct page_id) / 2)) as bigint) as needed from {} group by 1)"


@query(f"with {X.ctes(X.OPENINGS)}, {_NEED.format('openings')}, c as (select site_id, line, count(distinct page_id) as pages from openings group by 1, 2) select c.site_id, line, pages, needed from c join n on n.site_id = c.site_id where pages >= needed")
def shared_lines(spark, sf_dir):
    runs = X.OPENINGS.frame(spark)
    return N.shared_lines(runs, runs.select("site_id", "page_id"))


@query(f"""with {X.ctes(X.OPENINGS)}, {_NEED.format('openings')}, c as (select site_id, line from openings group by 1, 2, site_id having count(distinct page_id) >= (select needed from n where n.site_id = openings.site_id)),
m as (select o.*, c.line is not null as sh from openings o left join c on c.site_id = o.site_id and c.line = o.line), f as (select *, min(case when not sh then line_ord end) over (partition by site_id, page_id) as own from m),
p as (select site_id, page_id, count(*) as skipped, sum(length(line) + 1) as chars from f where own is null or line_ord < own group by 1, 2 having count(*) >= 5), g as (select site_id, count(*) as sharers, cast(floor(median(chars)) as bigint) as median_chars from p group by 1)
select n.site_id, coalesce(sharers, 0) as sharers, needed, coalesce(median_chars, 0) as median_chars from n left join g on g.site_id = n.site_id""")
def extraction_displacement(spark, sf_dir):
    runs = X.OPENINGS.frame(spark)
    return N.extraction_displacement(runs, runs.select("site_id", "page_id"))


_HEADS = """, a as (select *, coalesce((lag(level) over (partition by page_id order by ord) <> level)::int, 0) as ch from {0}), b as (select *, sum(ch) over (partition by page_id order by ord) as run from a),
c as (select *, row_number() over (partition by page_id, run order by ord) as turn, count(*) over (partition by page_id, run) as size from b), d as (select *, sum((turn > 6 and coalesce(id, '') <> '')::int) over (partition by page_id, run) as ids from c)
select page_id, row_number() over (partition by page_id order by ord) as ord, level, case when size > 7 and turn = 7 then format('[+{{}} more h{{}} siblings, {{}} with an id]', size - 6, level, ids) else text end as text, case when not (size > 7 and turn = 7) then id end as id from d where size <= 7 or turn <= 7"""


@query(f"with {X.ctes(X.HEADINGS)}" + _HEADS.format("headings"))
def heading_runs(spark, sf_dir):
    return N.heading_runs(X.HEADINGS.frame(spark))


@query("with h as (select conv_id as page_id, turn as ord, length(role)::integer as level, role as text, cast(null as varchar) as id from conversations)" + _HEADS.format("h"))
def heading_runs_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("ord"), F.length("role").alias("level"), F.col("role").alias("text"), F.lit(None).cast("string").alias("id"))
    return N.heading_runs(rows)


@query()
def anchorable_runs(spark, sf_dir):
    pages = extract_pages(A.site_pages(table(spark, sf_dir, "pages")).select("site_id", "page_id", "page_ord", "url", "html"))
    blocks = pages.select("site_id", "page_id", "page_ord", F.posexplode("blocks").alias("block_ord", "text"))
    return N.anchorable_runs(stored(blocks))


@query()
def shared_preamble(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return N.shared_preamble(docs.select(F.col("source").alias("site_id"), F.col("doc_id").alias("page_id"), "text"))


@query()
def name_groups(spark, sf_dir):
    return N.name_groups(X.NAMES.frame(spark))


# claims
_ASCII = ("version", "phone", "count")


def _claims_sql() -> str:
    d = "[0-9]"
    rx = {
        "version": rf"(?i)\bv(?:ersion\s*)?{d}+\.{d}+(?:\.{d}+)?\b|\b{d}+\.{d}+\.{d}+\b",
        "phone": rf"(?:\+{d}{{1,2}}\s?)?(?:\({d}{{3}}\)|{d}{{3}})[\s.-]{d}{{3}}[\s.-]{d}{{4}}\b",
        "count": C.PATTERNS["count"].replace("(?iuU)", "(?i)"),
    }
    arms = " union all ".join(f"select doc_id, text, {k} as k, '{t}' as type, regexp_extract_all(coalesce(text, ''), '{rx[t]}') as vs from documents" for k, t in enumerate(_ASCII))
    return f"""with a as ({arms}), v as (select doc_id, text, k, type, i, vs[i] as value from a, unnest(range(1, len(vs) + 1)) as t(i)), w as (select * from v where not (type = 'count' and contains(value, '.')) qualify row_number() over (partition by doc_id, type, value order by i) = 1),
o as (select *, row_number() over (partition by doc_id order by k, i) as claim_ord from w) select doc_id as page_id, claim_ord, type, value, substring(trim(coalesce(list_filter(string_split(text, chr(10)), lambda x: contains(x, value))[1], value)), 1, 160) as quote from o where claim_ord <= 30"""


def _document_claims(spark: SparkSession, sf_dir: str, types=_ASCII) -> DataFrame:
    return C.claim_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"), types)


@query(_claims_sql())
def claim_index(spark, sf_dir):
    return _document_claims(spark, sf_dir)


@query()
def claim_index_all_types(spark, sf_dir):
    return _document_claims(spark, sf_dir, tuple(C.PATTERNS))


@query(f"with claims_ as ({_claims_sql()}) select type, count(*) as n, count(distinct page_id) as pages from claims_ group by 1")
def claim_topics(spark, sf_dir):
    return C.claim_topics(_document_claims(spark, sf_dir))


@query(f"""with {X.ctes(X.CLAIMS)}, a as (select *, min(claim_ord) over v as first, count(*) over v as n, row_number() over (partition by page_id, type, value order by claim_ord) as turn from claims window v as (partition by page_id, type, value)),
b as (select *, dense_rank() over (partition by page_id, type order by first) as rank from a),
k as (select page_id, 0 as m, first as o1, claim_ord as o2, type, value, case when length(quote) > 140 then substring(quote, 1, 137) || '...' else quote end as quote, case when n > 5 then n else 1 end as n from b where rank <= 6 and (n <= 5 or turn = 1)),
l as (select page_id, 1 as m, 0 as o1, 0 as o2, type, format('[+{{}} more distinct {{}} values on this page]', count(distinct value), type) as value, cast(null as varchar) as quote, count(distinct value) as n from b where rank > 6 group by page_id, type)
select page_id, row_number() over (partition by page_id order by m, case when m = 1 then type end, o1, o2) as ord, type, value, quote, n from (select * from k union all select * from l)""")
def cap_claims(spark, sf_dir):
    return C.cap_claims(X.CLAIMS.frame(spark))


@query(f"with {X.ctes(X.CLAIMS)}, g as (select site_id, type, value, count(distinct page_id) as pages from claims group by 1, 2, 3), r as (select *, row_number() over (partition by site_id, type order by pages desc, value) as rank from g) select * from r where rank <= 8")
def claim_matrix(spark, sf_dir):
    return C.claim_matrix(X.CLAIMS.frame(spark))


_NUM = "try_cast(replace(nullif(regexp_extract({}, '[0-9][0-9,]*(?:\\.[0-9]+)?'), ''), ',', '') as double)"


@query(f"""with {X.ctes(X.OFFERS, X.CLAIMS)}, s as (select page_id, min({_NUM.format('price')}) as v from offers group by 1 having count(distinct {_NUM.format('price')}) = 1), c as (select page_id, min({_NUM.format('value')}) as v from claims where type = 'price' group by 1 having count(distinct {_NUM.format('value')}) = 1)
select s.page_id, s.v as schema_value, c.v as visible_value from s join c on c.page_id = s.page_id where s.v <> c.v""")
def price_conflict(spark, sf_dir):
    return C.price_conflicts(X.OFFERS.frame(spark), X.CLAIMS.frame(spark))


# passages
_ANCHOR = """met as (select q.question_id, q.page_id, r.page_id as on_page, r.run_ord, {run} as run from asked q join rn r on q.want <> '' and contains({run}, q.want)),
f as (select question_id, count_if(on_page = page_id) as hits, count(distinct case when on_page = page_id then run end) as distinct_runs, count(distinct case when on_page <> page_id then on_page end) as elsewhere, arg_min(run, case when on_page = page_id then run_ord end) as run from met group by 1),
j as (select q.question_id, coalesce(hits, 0) as hits, coalesce(distinct_runs, 0) as distinct_runs, coalesce(elsewhere, 0) as elsewhere, case when want = '' then 'unanswered' when coalesce(hits, 0) = 0 then 'not_found' when distinct_runs > 1 then 'ambiguous' else 'resolved' end as status, run from asked q left join f on f.question_id = q.question_id)"""


@query(f"with {X.ctes(X.QUESTIONS, X.RUNS)}, asked as (select question_id, page_id, {sql_fold('anchor')} as want from questions), rn as (select * from runs), {_ANCHOR.format(run=sql_fold('r.text'))} select question_id, hits, distinct_runs, elsewhere, status, case when status = 'resolved' then run end as run from j")
def anchor_match(spark, sf_dir):
    return P.anchor_match(X.QUESTIONS.frame(spark), X.RUNS.frame(spark))


@query(f"select item_id, count(*) as documents, min(doc_id) as first_doc from benchmark b join documents d on contains({sql_fold('d.text')}, {sql_fold('b.text')}) group by 1")
def anchor_match_benchmark(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", T.fold(F.col("text")).alias("want"))
    docs = table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("run"))
    return contained(items, "want", docs, ["doc_id"], "run").groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def _sql_confusable(x: str) -> str:
    quote = lambda s: s.replace("'", "''")
    return sql_fold(f"translate(coalesce({x}, ''), '{quote(T.CONFUSABLES)}', '{quote(T.CONFUSABLES_AS)}')")


@query(f"""with {X.ctes(X.PASSAGES, X.BLOCKS, X.HEAD_RUNS, X.PAGE_TITLES)}, q as (select question_id, page_id, {sql_fold('passage')} as want from passages),
b as (select page_id, block_ord, {sql_fold('text')} as t, {sql_fold('text')} || ' ' || lead({sql_fold('text')}) over (partition by page_id order by block_ord) as pair from blocks), w as (select page_id, string_agg(t, ' ' order by block_ord) as whole from b group by 1),
h as (select q.question_id, case when want = '' then 'no passage' when exists (select 1 from b where b.page_id = q.page_id and contains(t, want)) then 'block' when exists (select 1 from b where b.page_id = q.page_id and contains(pair, want)) then 'adjacent blocks'
 when contains(coalesce(w.whole, ''), want) then 'split' when exists (select 1 from head_runs r where r.page_id = q.page_id and contains({sql_fold('r.text')}, want)) then 'heading or link' when want = {sql_fold('pt.title')} then 'title'
 when contains({_sql_confusable('w.whole')}, {_sql_confusable('want')}) then 'look-alike' else 'absent' end as how from q left join w on w.page_id = q.page_id left join page_titles_f pt on pt.page_id = q.page_id)
select question_id, how in ('block', 'adjacent blocks', 'heading or link') as contiguous, how from h""")
def passage_contiguity(spark, sf_dir):
    return P.passage_contiguity(X.PASSAGES.frame(spark), X.BLOCKS.frame(spark), X.HEAD_RUNS.frame(spark), X.PAGE_TITLES.frame(spark))


@query(f"""with j as (select cast(item_id as varchar) as question_id, doc_id as page_id, instr({sql_fold('d.text')}, {sql_fold('b.text')}) - 1 as "at" from benchmark b join documents d on contains({sql_fold('d.text')}, {sql_fold('b.text')})) select question_id, page_id, "at", "at" <= 600 as in_window from j""")
def first_window(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("passage"))
    return P.first_window(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"))


@query(f"""with {X.ctes(X.PASSAGES, X.BLOCKS)}, a as (select distinct question_id, page_id, unnest(string_split(lower({sql_fold('passage')}), ' ')) as w from passages), b as (select distinct page_id, block_ord, unnest(string_split(lower({sql_fold('text')}), ' ')) as w from blocks),
g as (select question_id, block_ord, count(*) as common from a join b on b.page_id = a.page_id and b.w = a.w and a.w <> '' group by 1, 2), r as (select *, row_number() over (partition by question_id order by common desc, block_ord) as rank from g) select * from r where rank <= 2""")
def nearest_blocks(spark, sf_dir):
    return P.nearest_blocks(X.PASSAGES.frame(spark).withColumnRenamed("passage", "anchor"), X.BLOCKS.frame(spark))


@query()
def sentence_bounds(spark, sf_dir):
    met = P.anchor_match(X.QUESTIONS.frame(spark), X.RUNS.frame(spark)).join(X.QUESTIONS.frame(spark).select("question_id", "anchor"), "question_id")
    return P.cut_passages(met)


# page measures
@query(f"""with {X.ctes(X.HANDLERS)} select page_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(raw, ''), '{K.HANDLER_PATH.replace(chr(39), chr(39) * 2)}', 1)), lambda h: not list_contains(list_transform(hrefs, lambda u: {part('u', 3)}), h))), ' ') as missing from handlers""")
def script_only_links(spark, sf_dir):
    return X.HANDLERS.frame(spark).select("page_id", F.array_join(F.array_sort(K.script_only_paths(F.col("raw"), F.col("hrefs"))), " ").alias("missing"))


@query(f"""with {X.ctes(X.DESCRIPTIONS)} select page_id, coalesce(array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all({sql_fold('description')}, '{K.META_TOKEN.replace('(?U)', '')}')), lambda t: not contains(lower({sql_fold('visible')}), lower(t)))), ';'), '') as tokens from descriptions""")
def metadata_contrast(spark, sf_dir):
    return X.DESCRIPTIONS.frame(spark).select("page_id", F.array_join(F.array_sort(K.metadata_only_tokens(F.col("description"), F.col("visible"))), ";").alias("tokens"))


@query(f"""with {X.ctes(X.SHELLS)} select page_id, array_to_string(list_filter([case when regexp_matches(coalesce(raw, ''), '{K.NOSCRIPT}') then 'noscript-enable-js' end,
 case when len(list_filter(string_split({sql_fold('visible')}, ' '), lambda x: x <> '')) < 120 and length(coalesce(raw, '')) > 20000 then 'tiny-visible-vs-raw' end, case when lower({sql_fold('title')}) in ('', 'loading', 'loading...', '...') then 'loading-or-empty-title' end,
 case when regexp_matches(coalesce(raw, ''), '{K.EMPTY_ROOT.replace(chr(39), chr(39) * 2)}') then 'empty-root-container' end], lambda x: x is not null), ',') as signs from shells""")
def shell_indicators(spark, sf_dir):
    return X.SHELLS.frame(spark).select("page_id", F.array_join(K.shell_indicators(F.col("raw"), F.col("visible"), F.col("title")), ",").alias("signs"))


@query(f"""with {X.ctes(X.HIDDEN)} select page_id, len(list_filter(regexp_extract_all(coalesce(raw, ''), '{K.HIDDEN_STYLE}'), lambda t: not regexp_matches(t, '{K.HIDDEN_ALLOWED}')))::integer as instances from hidden""")
def hidden_text(spark, sf_dir):
    return X.HIDDEN.frame(spark).select("page_id", K.hidden_instances(F.col("raw")).alias("instances"))


@query()
def jsonld_validity(spark, sf_dir):
    blocks = ['{"@type": "Product", "offers": {"price": 5}}', '{"@graph": [{"@type": "Organization", "name": "A"}, {"name": "x"}]}', '{"@type": "Organization" "name"', '[{"@type": ["Brand"], "name": " "}]']
    return K.jsonld_validity(K.jsonld_nodes(spark.createDataFrame([(i, 0, b) for i, b in enumerate(blocks)], "page_id long, block int, raw string")))


@query()
def document_errors(spark, sf_dir):
    schema = {"type": "object", "required": ["check_id"], "additionalProperties": False, "properties": {"check_id": {"type": "string", "pattern": "^[A-Z]"}, "n": {"type": "integer", "minimum": 0}}}
    docs = [json.dumps(x) for x in ({"check_id": "A"}, {"n": True}, {"check_id": "a", "n": -1, "z": 0}, [])] + ["{"]
    return spark.createDataFrame(list(enumerate(docs)), "id int, body string").select("id", F.array_join(schema_errors(F.col("body"), schema), "; ").alias("errors"))


@query(f"""with {X.ctes(X.EXTERNALS)} select site_id, count(*) as declared, count_if(ownership = 'independent' and http_status between 200 and 399) as independent_resolved, count_if(ownership = 'owned' and http_status between 200 and 399) as owned_resolved, count_if(ownership = 'unknown' and http_status between 200 and 399) as unknown_resolved,
 count_if(ownership = 'independent' and http_status >= 400) as independent_errors, count_if(http_status is null) as timeouts, count_if(ownership = 'independent' and http_status between 200 and 399 and brand_name_match) as matches from externals group by 1""")
def corroboration(spark, sf_dir):
    return K.corroboration(X.EXTERNALS.frame(spark))


# the report
_ROUTED = f"""{_CATALOG}, {X.ctes(X.RESULTS)}, dem as (select * replace (case when gate = 'finding' and check_id in ('REF-SOFT-404', 'ACC-BOT-CHALLENGE') and not regexp_matches(coalesce(evidence, ''), '\\b[0-9]{{3}}\\b') then 'not_evaluated' else gate end as gate) from results),
routed as (select d.*, case when gate = 'pass' and evidence_quality = 'hypothesis' then 'not_evaluated' when gate = 'pass' then 'passed' when gate = 'not_evaluated' then 'not_evaluated' when confidence = 'low' then 'needs_verification' when c.check_id is null then 'not_evaluated' else 'finding' end as route from dem d left join catalog c on c.check_id = d.check_id)"""
_DEDUP = f"{_ROUTED}, fd as (select * from routed where route = 'finding' qualify row_number() over (partition by site_id, check_id, list_sort(coalesce(urls, [])) order by ord) = 1)"
_MERGED = f"""{_DEDUP}, cause as (select site_id, arg_min(urls, ord) as cu, min(ord) as co from fd where check_id = 'REP-KEY-FACT-LOSS' group by 1), mk as (select fd.*, cu, co, coalesce(check_id in ('REP-LINKS-SCRIPT-ONLY', 'REP-EXTRACTION-LOSS') and list_has_any(urls, cu), false) as gone from fd left join cause on cause.site_id = fd.site_id),
told as (select site_id, string_agg(distinct check_id, ', ' order by check_id) as sy, array_to_string(list_sort(list_distinct(flatten(list(urls)))), ', ') as wh from mk where gone group by 1),
mg as (select mk.site_id, ord, check_id, severity, confidence, case when ord = co and sy is not null then evidence || ' Same cause: ' || sy || ' on ' || wh || '.' else evidence end as evidence from mk left join told on told.site_id = mk.site_id where not gone)"""
_IDS = f"""{_MERGED}, nm as (select *, row_number() over (partition by site_id order by {_RANK.format('severity')}, check_id, ord) as place from mg),
ids as (select nm.site_id, nm.check_id, format('F-{{:03d}}', place) as id, case when severity = 'critical' and coalesce(confidence, '') <> 'high' then 'high' else severity end as severity, severity = 'critical' and coalesce(confidence, '') <> 'high' as clamped, c.category, c.severity_band as band from nm left join catalog c on c.check_id = nm.check_id)"""


def _routed(spark: SparkSession) -> DataFrame:
    return M.route_results(X.RESULTS.frame(spark), catalog(spark))


def _merged(spark: SparkSession) -> DataFrame:
    return M.root_cause_merge(M.finding_dedup(_routed(spark).where("route = 'finding'")))


@query(f"with {_ROUTED} select site_id, ord, check_id, route from routed")
def route_results(spark, sf_dir):
    return _routed(spark).select("site_id", "ord", "check_id", "route")


@query(f"with {_ROUTED} select site_id, ord, check_id, gate from dem")
def probe_demotion(spark, sf_dir):
    return M.probe_demotion(X.RESULTS.frame(spark)).select("site_id", "ord", "check_id", "gate")


@query(f"with {_DEDUP} select site_id, ord, check_id from fd")
def finding_dedup(spark, sf_dir):
    return M.finding_dedup(_routed(spark).where("route = 'finding'")).select("site_id", "ord", "check_id")


@query(f"with {_MERGED} select site_id, ord, check_id, evidence from mg")
def root_cause_merge(spark, sf_dir):
    return _merged(spark).select("site_id", "ord", "check_id", "evidence")


@query(f"with {_IDS} select site_id, check_id, id, severity, clamped, category, coalesce(not list_contains(band, severity), false) as out_of_band from ids")
def finding_ids(spark, sf_dir):
    return M.finding_ids(_merged(spark), catalog(spark)).select("site_id", "check_id", "id", "severity", "clamped", "category", "out_of_band")


@query(f"with {_IDS} select s.site_id, count(severity) as total, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from (select distinct site_id from results) s left join ids on ids.site_id = s.site_id group by 1")
def severity_counts(spark, sf_dir):
    return M.severity_counts(M.finding_ids(_merged(spark), catalog(spark)), X.RESULTS.frame(spark).select("site_id"))


@query(f"""with {_ROUTED} select distinct site_id, check_id, 'reported' as reason from routed r where route = 'not_evaluated' and not exists (select 1 from routed f where f.site_id = r.site_id and f.check_id = r.check_id and f.route = 'finding')
union all select s.site_id, c.check_id, 'no result' from (select distinct site_id from results) s cross join catalog c where not exists (select 1 from routed r where r.site_id = s.site_id and r.check_id = c.check_id)""")
def not_evaluated_backfill(spark, sf_dir):
    return M.not_evaluated_backfill(_routed(spark), catalog(spark), X.RESULTS.frame(spark).select("site_id"))


@query(f"with {_ROUTED} select r.site_id, count(distinct case when route = 'passed' then r.check_id end) as checks_passed, count(distinct c.skill_id) as skills from routed r left join catalog c on c.check_id = r.check_id group by 1")
def report_coverage(spark, sf_dir):
    return M.coverage(_routed(spark), catalog(spark))


@query(f"with {_MERGED}, ct as (select site_id, check_id, unnest(list_distinct(regexp_extract_all(coalesce(evidence, ''), '\\b[A-Z]{{3}}-[A-Z0-9][A-Z0-9-]{{2,}}\\b'))) as cited from mg) select * from ct where cited <> check_id and cited not in (select check_id from catalog)")
def cited_unknown_ids(spark, sf_dir):
    return M.cited_unknown_ids(_merged(spark), catalog(spark))


@query(f"with {X.ctes(X.OPPORTUNITIES)}, o as (select * from opps qualify row_number() over (partition by site_id, lower(trim(title)) order by ord) = 1) select site_id, title, priority, row_number() over (partition by site_id order by {_RANK.format('priority')}, title) as place from o")
def opportunities(spark, sf_dir):
    return M.opportunities(X.OPPORTUNITIES.frame(spark))


@query(f"with {X.ctes(X.SHED)} select * from shed qualify row_number() over (partition by site_id, lower(what) order by ord) = 1")
def shed_decisions(spark, sf_dir):
    return M.shed_rows(X.SHED.frame(spark))


@query(f"""with {_CATALOG}, {X.ctes(X.VERDICTS, X.MEASURED, X.SKILLS)}, v as (select * replace (case when gate in ('finding', 'pass', 'not_evaluated') then gate else 'not_evaluated' end as gate) from verdicts where check_id is not null qualify row_number() over (partition by site_id, check_id order by ord) = 1),
o as (select v.site_id, v.check_id, gate, case when gate = 'finding' then coalesce(severity, c.severity_band[1], 'medium') end as severity, case when gate = 'finding' then coalesce(confidence, 'medium') end as confidence, case when gate = 'finding' then coalesce(title, v.check_id) end as title, case when gate = 'finding' then coalesce(v.evidence, m.evidence, '') end as evidence, case when gate = 'not_evaluated' then coalesce(reason, 'not judged') end as reason
 from v left join measured m on m.site_id = v.site_id and m.check_id = v.check_id left join catalog c on c.check_id = v.check_id)
select * from o union all select s.site_id, c.check_id, 'not_evaluated', null, null, null, null, 'no verdict' from skills s join catalog c on c.skill_id = s.skill_id where not exists (select 1 from o where o.site_id = s.site_id and o.check_id = c.check_id)""")
def verdict_assembly(spark, sf_dir):
    return V.assemble(X.VERDICTS.frame(spark), X.MEASURED.frame(spark), catalog(spark), X.SKILLS.frame(spark)).drop("urls", "evidence_quality")


@query()
def probe_rows(spark, sf_dir):
    return S.probe_rows(X.LOGS.frame(spark), X.PROMPTS.frame(spark))[0].withColumn("cited", F.array_join("cited", " "))


@query()
def probe_problems(spark, sf_dir):
    return S.probe_rows(X.LOGS.frame(spark), X.PROMPTS.frame(spark))[1]


@query("with r as (select conv_id, count(*) as questions from conversations where role = 'user' group by 1) select count(*) as runs, min(questions) as least, max(questions) as most, round(avg(questions), 4) as mean from r")
def corpus_stats(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("run_id")).agg(F.count("*").alias("questions"))
    return S.corpus_stats(turns)


@query('select source as site_id, cast(sum(length(coalesce(text, ''))) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding) as bigint) as "at", doc_id from documents')
def running_offset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return N.running_total(docs.select("source", "doc_id", "text"), "source", "doc_id", F.length(T.text_of(F.col("text")))).select(F.col("source").alias("site_id"), F.col("before").alias("at"), "doc_id")


from pagewright import capture_queries, page_queries  # noqa: E402, F401  they register their queries here
