"""What follows from stored fetches and probes: which pages count, what variants and error pages show, which links to sample, which
outside pages a site declares, and which page a question belongs to. Responses are inputs; nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T

from .robots import decide_paths

LONG_CHAIN = 3
# Wording by which an error page points on.
SUGGESTIONS = "popular|recent|related|did you mean|maybe you"
MOST_LINKS, MOST_EXTERNAL = 5, 12


def fetch_outcomes(captures: DataFrame, long_chain: int = LONG_CHAIN) -> DataFrame:
    """(site_id, url, status, final_url, chain): fetches that worked, and those that ran out of redirects, as status 0 at the end of
    their chain; other failures are left out; captures: (site_id, url, status, error, final_url, chain)."""
    chain = F.coalesce("chain", F.array().cast("array<string>"))
    failed = F.col("error").isNotNull() | F.col("status").isNull() | (F.col("status") >= 400)
    rows = captures.where(~failed | (F.size(chain) >= long_chain))
    end = F.when(failed, F.element_at(chain, -1)).otherwise(F.col("final_url"))
    return rows.select("site_id", "url", F.when(failed, 0).otherwise(F.col("status")).alias("status"), end.alias("final_url"), chain.alias("chain"))


def occurrences(text: Column, part: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part))


def soft_404_flags(probes: DataFrame) -> DataFrame:
    """(site_id, status, is_soft_404, has_search, has_navigation, has_suggestions) of answers to a path that cannot exist; none for
    probes without an answer; probes: (site_id, status, error, body)."""
    low = F.lower(T.text_of(F.col("body")))
    links = (occurrences(low, "<a ") >= 3) | (occurrences(low, "href=") >= 3)
    rows = probes.where("status is not null and error is null")
    return rows.select("site_id", "status", (F.col("status") == 200).alias("is_soft_404"), low.contains("search").alias("has_search"), links.alias("has_navigation"), low.rlike(SUGGESTIONS).alias("has_suggestions"))


def redirect_variants(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """(site_id, url, variant, requested, status, final_path, path_preserved, variant_ok): the page by http and with or without www.

    pages: (site_id, url); answers: (requested, status, error, final_url). A variant without an answer has nulls; whether a path
    survived says nothing about whether the variant was served."""
    netloc, path = T.url_part(F.col("url"), "netloc"), T.url_part(F.col("url"), "path")
    host = F.regexp_replace(F.lower(F.regexp_replace(netloc, "^.*@", "")), r":\d*$", "")
    other = F.when(host.startswith("www."), F.struct(F.lit("apex").alias("variant"), F.concat(F.lit("https://"), F.substring(host, F.lit(5), F.length(host)), path).alias("requested")))
    other = other.otherwise(F.struct(F.lit("www").alias("variant"), F.concat(F.lit("https://www."), host, path).alias("requested")))
    plain = F.struct(F.lit("http").alias("variant"), F.concat(F.lit("http://"), netloc, path).alias("requested"))
    rows = pages.select("site_id", "url", path.alias("path"), F.inline(F.array(plain, other)))
    served = answers.where("error is null and status is not null").select(F.col("requested").alias("asked"), F.col("status").alias("status"), T.url_part(F.col("final_url"), "path").alias("final_path"))
    rows = rows.join(served, F.col("requested") == F.col("asked"), "left")
    return rows.select("site_id", "url", "variant", "requested", "status", "final_path", (F.col("final_path") == F.col("path")).alias("path_preserved"), (F.col("status") < 400).alias("variant_ok"))


def link_rot_sample(links: DataFrame, fetched: DataFrame, sites: DataFrame, robots: DataFrame | None = None, most: int = MOST_LINKS) -> DataFrame:
    """(site_id, url, ord): links to the site or its subdomains that were not fetched and that robots rules allow anyone, first seen first.

    links: (site_id, page_ord, link_ord, href); fetched: (site_id, url); sites: (site_id, netloc); robots: rows of robots_rows. Urls
    that differ by slashes at their end are one."""
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    there = T.url_part(F.col("href"), "netloc")
    rows = links.join(sites.select("site_id", "netloc"), "site_id").where(T.url_part(F.col("href"), "scheme").isin("http", "https"))
    rows = rows.where((there == F.col("netloc")) | there.endswith(F.concat(F.lit("."), F.col("netloc"))))
    first = rows.groupBy("site_id", bare(F.col("href")).alias("bare")).agg(F.min(F.struct("page_ord", "link_ord", "href")).alias("first"))
    first = first.join(fetched.select("site_id", bare(F.col("url")).alias("bare")).distinct(), ["site_id", "bare"], "left_anti")
    if robots is not None:
        path = F.when(T.url_part(F.col("first.href"), "path") == "", "/").otherwise(T.url_part(F.col("first.href"), "path"))
        first = first.withColumn("path", path)
        barred = decide_paths(first.select("site_id", "path"), robots, first.select("site_id", F.lit("*").alias("token")).distinct()).where("blocked")
        first = first.join(barred.select("site_id", "path"), ["site_id", "path"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("first.page_ord", "first.link_ord"))
    return first.withColumn("ord", rank).where(F.col("ord") <= most).select("site_id", F.col("first.href").alias("url"), "ord")


def declared_external(declared: DataFrame, sites: DataFrame, known: tuple[str, ...], most: int = MOST_EXTERNAL) -> DataFrame:
    """(site_id, domain, url, ord): the outside pages that a site declares, one for each domain, first seen first.

    declared: (site_id, page_ord, kind, ord, url), kind 'sameAs' or 'link'; of links only those to known domains count. On a page
    structured declarations come before links."""
    netloc = F.lower(T.url_part(F.col("url"), "netloc"))
    domain = F.regexp_replace(netloc, r"^www\.", "")
    same = (F.col("kind") == "sameAs") & F.col("url").startswith("http")
    link = (F.col("kind") == "link") & (netloc != "") & ~netloc.endswith(F.col("site_netloc")) & domain.isin(*known)
    rows = declared.join(sites.select("site_id", F.col("netloc").alias("site_netloc")), "site_id").where(same | link)
    first = rows.groupBy("site_id", domain.alias("domain")).agg(F.min(F.struct("page_ord", (F.col("kind") == "link").alias("late"), "ord", "url")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("first.page_ord", "first.late", "first.ord", "domain"))
    return first.withColumn("place", rank).where(F.col("place") <= most).select("site_id", "domain", F.col("first.url").alias("url"), F.col("place").alias("ord"))


def question_pages(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(question_id, page_id, how): the page that a question expects, by its url, else by host without www. and path; how is exact,
    normalised or missing; questions: (question_id, expected_page); pages: (page_id, page_ord, url). Of several the first counts."""
    key = F.concat(F.regexp_replace(F.lower(T.url_part(F.col("url"), "netloc")), r"^www\.", ""), T.norm_path(F.col("url")))
    first = lambda by: pages.groupBy(by.alias("k")).agg(F.min_by("page_id", "page_ord").alias("page_id"))
    exact, near = first(F.col("url")).select(F.col("k").alias("exact_url"), F.col("page_id").alias("exact_id")), first(key).select(F.col("k").alias("near_key"), F.col("page_id").alias("near_id"))
    rows = questions.select("question_id", F.col("expected_page").alias("url")).withColumn("key", key)
    rows = rows.join(exact, F.col("url") == F.col("exact_url"), "left").join(near, F.col("key") == F.col("near_key"), "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("near_id").isNotNull(), "normalised").otherwise("missing")
    return rows.select("question_id", F.coalesce("exact_id", "near_id").alias("page_id"), how.alias("how"))
