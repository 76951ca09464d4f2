"""URL filters that follow redirects.

Rules judge a url by host suffix and path prefix; the longest rule that fits wins. Pages that redirect to one another, or name
the same canonical url, are aliases. All canonical links and refresh redirects of a page count, with attributes in any order and
quoted or not; comments and scripts hold none. Character references in them are decoded, and references are resolved against the
page's base element or url, by the rules for relative references. Urls meet without scheme, fragment, default port and dot
segments. Connected components over these edges carry a block to every alias that no rule judges
itself. An explicit allow has precedence: a page under an allow rule stays allowed, and a component that holds one is not
blocked by its aliases.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule, has no aliases and is allowed; null
html names no edges; repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER
from .components import components


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(text: str, verdict: str) -> Rule:
    """example.net/de/8 fits paths from /de/8 on example.net and its subdomains."""
    cut_at = text.find("/")
    return Rule(text[:cut_at], text[cut_at:], verdict) if cut_at >= 0 else Rule(text, "", verdict)


RULES = (
    parse_rule("com/en/", "block"),
    parse_rule("example.com/en/7", "allow"),
    parse_rule("net/de/", "allow"),
    parse_rule("example.net/de/8", "block"),
    parse_rule("org/es/", "block"),
)
#: What holds no markup; then the tags that may name an alias, and an attribute's value in one of three groups.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
_TAGS = r"""(?is)<(?:link|meta|base)\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
_ATTRIBUTE = r"""(?is)^<[a-z]+\b(?:[^>"']|"[^"]*"|'[^']*')*?[\s"'/]{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFRESH = r"""(?is)^[\s\d.]*[;,]?\s*url\s*=\s*["']?([^"']*)"""
#: Character references that urls need, in the order in which they are decoded; & comes last.
_REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#58;", ":"), ("&#x3a;", ":"), ("&#61;", "="), ("&#x3d;", "="), ("&#63;", "?"), ("&#x3f;", "?"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path that begins with / without its segments . and .., as RFC 3986 has it; the empty path is /."""
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x))
    folded = F.concat(F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(""), step), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    return F.when(path.contains("/."), F.when(folded == "", "/").otherwise(folded)).when(path == "", "/").otherwise(path)


def url_key(url: Column) -> Column:
    """The name under which redirects meet; null where there is no host."""
    scheme = F.lower(F.regexp_extract(url, r"^((?s:.*?))://", 1))
    host = F.regexp_replace(host_of(url), F.when(scheme == "https", ":443$").when(scheme == "http", ":80$").otherwise("^$"), F.lit(""))
    query = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, without_dots(path_of(url)), query))


def resolved(reference: Column, base: Column) -> Column:
    """The url that a reference names on a page of that url; null where it is none or the page itself."""
    origin = F.regexp_extract(base, r"^((?s:.*?)://[^/?#]*)", 1)
    folder = F.regexp_replace(F.when(path_of(base) == "", "/").otherwise(path_of(base)), "[^/]*$", "")
    return (
        F.when(F.regexp_like(reference, F.lit(r"^([A-Za-z][A-Za-z0-9+.-]*:|#)")) | (reference == ""), F.when(reference.contains("://"), reference))
        .when(reference.startswith("//"), F.concat(F.regexp_extract(base, r"^((?s:.*?):)//", 1), reference))
        .when(reference.startswith("/"), F.concat(origin, reference))
        .when(reference.startswith("?"), F.concat(origin, path_of(base), reference))
        .otherwise(F.concat(origin, folder, reference))
    )


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, decoded and trimmed; empty where it is missing."""
    pattern = _ATTRIBUTE.format(name)
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    for reference, char in _REFERENCES:
        value = F.regexp_replace(value, f"(?i){reference}", char)
    return F.regexp_replace(value, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; ties go to allow."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): keys of urls that the pages' own markup declares the same."""
    here = pages.where(F.lower("html").rlike("http-equiv|canonical"))
    tags = here.select("url", F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, ""), F.lit(_TAGS), 0).alias("tags"))
    bases = F.filter("tags", lambda t: F.regexp_like(t, F.lit("(?i)^<base\\b")) & (attribute(t, "href") != ""))
    base = F.when(F.size(bases) > 0, F.coalesce(resolved(attribute(F.get(bases, 0), "href"), F.col("url")), F.col("url"))).otherwise(F.col("url"))
    tags = tags.withColumn("base", base).select("url", "base", F.explode("tags").alias("tag"))
    tag = F.col("tag")
    refresh = F.regexp_extract(attribute(tag, "content"), _REFRESH, 1)
    to = F.when(tag.rlike("(?i)^<link\\b") & attribute(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)"), attribute(tag, "href"))
    to = to.when(tag.rlike("(?i)^<meta\\b") & (F.lower(attribute(tag, "http-equiv")) == "refresh"), F.regexp_replace(refresh, r"^\s+|\s+$", ""))
    found = tags.select("url", "base", to.alias("to")).where("to is not null")
    return found.select(url_key(F.col("url")).alias("u"), url_key(resolved(F.col("to"), F.col("base"))).alias("v"))


def url_filter(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict. redirects: more edges, as (from_url, to_url)."""
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(url_key(F.col("from_url")).alias("u"), url_key(F.col("to_url")).alias("v")))
    member = components(edges)

    def judged(df: DataFrame, url: str) -> DataFrame:
        df = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
        name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
        return df.withColumn("rule", name).withColumn("own", verdict)

    # the key keeps its host and path, so rules judge the aliases that are no pages too
    nodes = judged(member.withColumn("as_url", F.concat(F.lit("x://"), F.col("node"))), "as_url")
    spread = nodes.groupBy("component").agg(F.max((F.col("own") == "block").cast("int")).alias("blocks"), F.max((F.col("own") == "allow").cast("int")).alias("allows"))
    spread = spread.where("blocks = 1 and coalesce(allows, 0) = 0").select(F.col("component").alias("c"))
    blocked = nodes.join(spread, F.col("component") == F.col("c"), "left_semi").select(F.col("node").alias("alias"))
    rows = judged(pages.select("page_id", "url"), "url").withColumn("key", url_key(F.col("url")))
    rows = rows.join(blocked, F.col("key") == F.col("alias"), "left")
    verdict = F.coalesce("own", F.when(F.col("alias").isNotNull(), F.lit("block")), F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle() -> str:
    """The same in DuckDB; the components are reached by recursion."""
    quoted_ = lambda pattern: pattern.replace("'", "''")

    def host(u: str) -> str:
        return f"translate(coalesce(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"

    def path(u: str) -> str:
        return f"coalesce(regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"

    def clean(p: str) -> str:
        parts = f"string_split({p}, '/')[2:]"
        folded = f"list_reduce([''] || {parts}, lambda a, x: case when x = '..' then regexp_replace(a, '/[^/]*$', '') when x = '.' then a else a || '/' || x end) || case when {parts}[-1] in ('.', '..') then '/' else '' end"
        return f"(case when contains({p}, '/.') then coalesce(nullif({folded}, ''), '/') when {p} = '' then '/' else {p} end)"

    def key(u: str) -> str:
        scheme = f"lower(regexp_extract({u}, '^((?s:.*?))://', 1))"
        bare = f"case when {scheme} = 'https' then regexp_replace({host(u)}, ':443$', '') when {scheme} = 'http' then regexp_replace({host(u)}, ':80$', '') else {host(u)} end"
        return f"case when {bare} <> '' then {bare} || {clean(path(u))} || regexp_extract({u}, '^(?s:.*?)://[^/?#]*[^?#]*(\\?[^#]*)', 1) end"

    def resolve(r: str, u: str) -> str:
        origin = f"regexp_extract({u}, '^((?s:.*?)://[^/?#]*)', 1)"
        folder = f"regexp_replace(coalesce(nullif({path(u)}, ''), '/'), '[^/]*$', '')"
        return f"""(case when regexp_matches({r}, '^([A-Za-z][A-Za-z0-9+.-]*:|#)') or {r} = '' then case when contains({r}, '://') then {r} end
          when starts_with({r}, '//') then regexp_extract({u}, '^((?s:.*?):)//', 1) || {r} when starts_with({r}, '/') then {origin} || {r}
          when starts_with({r}, '?') then {origin} || {path(u)} || {r} else {origin} || {folder} || {r} end)"""

    def value(tag: str, name: str) -> str:
        out = " || ".join(f"regexp_extract({tag}, '{quoted_(_ATTRIBUTE.format(name))}', {i})" for i in (1, 2, 3))
        for reference, char in _REFERENCES:
            out = f"regexp_replace({out}, '{reference}', '{quoted_(char)}', 'gi')"
        return f"regexp_replace({out}, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')"

    def fits(h: str, p: str) -> tuple[str, str]:
        order = sorted(RULES, key=lambda r: (-len(r.name), r.verdict != "allow"))
        test = lambda r: f"(({h} = '{r.host}' or ends_with({h}, '.{r.host}')) and starts_with({p}, '{r.path}'))"
        return tuple("case " + " ".join(f"when {test(r)} then '{x(r)}'" for r in order) + " end" for x in (lambda r: r.name, lambda r: r.verdict))

    name, own = fits("host", "path")
    return f"""
with recursive g as (
  select url, regexp_extract_all(regexp_replace(html, '{_HIDDEN}', '', 'g'), '{quoted_(_TAGS)}') as tags from pages where regexp_matches(lower(html), 'http-equiv|canonical')),
b as (select url, tags, list_filter(tags, lambda t: regexp_matches(t, '(?i)^<base\\b') and {value("t", "href")} <> '')[1] as base_tag from g),
c as (select url, tags, case when base_tag is null then url else coalesce({resolve("(" + value("base_tag", "href") + ")", "url")}, url) end as base from b),
tag as (select url, base, unnest(tags) as tag from c),
a as (select url, base, case when regexp_matches(tag, '(?i)^<link\\b') and regexp_matches({value("tag", "rel")}, '(?i)(?:^|\\s)canonical(?:\\s|$)') then {value("tag", "href")}
        when regexp_matches(tag, '(?i)^<meta\\b') and lower({value("tag", "http-equiv")}) = 'refresh' then regexp_replace(regexp_extract({value("tag", "content")}, '{quoted_(_REFRESH)}', 1), '^\\s+|\\s+$', '', 'g') end as target from tag),
t as (select url, {resolve("target", "base")} as full_target from a where target is not null),
e0 as (select {key("url")} as u, {key("full_target")} as v from t where full_target is not null),
e as (select u, v from e0 where u is not null and v is not null and u <> v union select v, u from e0 where u is not null and v is not null and u <> v),
reach as (select u as node, u as other from e union select r.node, e.v from reach r join e on r.other = e.u),
nodes as (select node, min(other) as component from reach group by node),
nk as (select *, {host("'x://' || node")} as host, {path("'x://' || node")} as path from nodes),
spread as (select component from (select component, {own} as own from nk) group by component
           having max(case when own = 'block' then 1 else 0 end) = 1 and max(case when own = 'allow' then 1 else 0 end) = 0),
blocked as (select distinct node from nodes join spread using (component)),
p as (select page_id, url, {host("url")} as host, {path("url")} as path, {key("url")} as k from pages)
select page_id, host, path, {name} as rule, coalesce({own}, case when b.node is not null then 'block' end, 'allow') as verdict
from p left join blocked b on p.k = b.node"""
