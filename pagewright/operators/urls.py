"""Operators on urls and links: templates, candidates, page selection, site types, orphans, rot, locales, redirects, canonicals."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T

from .medians import exact_median

# What page selection looks for, in order, and what it puts last.
PRIORITIES = (
    ("decision", "price|pricing|plan|plans|cost"),
    ("docs", "doc|docs|help|faq|support|guide|tutorial|manual"),
    ("recent", "blog|news|article|post|release|changelog|update"),
    ("about", "about|contact|team|location|store|hours|company"),
    ("product", "product|shop|item|service|solution|feature"),
    ("trust", "security|legal|privacy|terms|status"),
)
ACCOUNT = "login|log-in|signin|sign-in|signup|sign-up|register|dashboard|settings|account|forgot|password|checkout|cart"
IMPORTANT = ("homepage", "decision", "product", "docs", "about", "trust")
ASSET = r"(?i)\.(?:png|jpe?g|gif|svg|webp|ico|css|js|pdf|zip|xml|json|mp4|mp3|woff2?)$"
LISTING = r"(?i)/(?:wp-[^/]*|feed|tag|author)(?:/|$)"
DECISION_PATH = "(?i)pric|pricing|product|docs?/|guide|help|support|checkout|contact|about"
ORPHAN_PATH = "(?i)price|pricing|product|doc|help|guide|about|contact"
LANG_TAG = "^[a-z]{2,3}(-[A-Za-z]{2})?(-[a-z]{2})?$"
# Site types with their schema types, path markers and phrases.
SITE_TYPES = {
    "ecommerce": (("product", "offer", "aggregateoffer", "itemlist/product"), ("/products/", "/product/", "/collections/", "/cart", "/checkout", "/shop"), ("add to cart", "add to bag", "shopping cart", "free shipping", "sale price")),
    "docs-developer": (("techarticle", "apireference", "softwaresourcecode"), ("/docs", "/documentation", "/api/", "/reference", "/guide", "/tutorial", "/whatsnew", "/library", "/manual"), ("api reference", "getting started", "installation", "changelog", "sdk", "documentation", "module index", "library reference", "release notes")),
    "saas": (("softwareapplication", "webapplication", "service"), ("/pricing", "/signup", "/sign-up", "/login", "/integrations", "/features", "/plan", "/enterprise", "/customers", "/security"), ("free trial", "start free", "per user", "per month", "book a demo", "pricing", "sign up", "log in", "get started free", "for teams")),
    "local-business": (("localbusiness", "restaurant", "dentist", "medicalclinic", "medicalbusiness", "store", "hotel", "professionalservice"), ("/locations", "/book-appointment", "/appointment", "/directions", "/menu", "/opening-hours"), ("opening hours", "book an appointment", "find us", "call us", "our location", "walk-ins", "make a reservation")),
    "publisher": (("newsarticle", "article", "blogposting", "newsmediaorganization", "liveblogposting"), ("/news", "/article", "/story", "/blog/", "/opinion", "/archive"), ("subscribe", "latest news", "breaking", "editor", "newsletter")),
    "gov-edu": (("governmentorganization", "collegeoruniversity", "educationalorganization", "govermentservice", "school"), ("/admission", "/scheme", "/tender", "/notice", "/circular", "/department"), ("admission", "notification", "government of", "prospectus", "faculty")),
    "marketplace-platform": (("itemlist", "searchresultspage"), ("/sellers", "/vendors", "/listings", "/marketplace", "/browse"), ("become a seller", "list your", "sellers", "vendors", "marketplace")),
    "org-portfolio": (("organization", "ngo", "nonprofit", "person", "creativework"), ("/about", "/work", "/projects", "/services", "/portfolio", "/team"), ("our work", "our mission", "case study", "what we do", "get in touch")),
}
HOST_PREFIXES = (("docs.", "docs-developer"), ("developer.", "docs-developer"), ("api.", "docs-developer"), ("shop.", "ecommerce"), ("store.", "ecommerce"), ("news.", "publisher"), ("blog.", "publisher"))
PUBLIC_HOST = r"(^|\.)(gov|mil)(\.[a-z]{2,3})?$|(^|\.)(edu|ac)(\.[a-z]{2,3})?$|\.nic\.in$"


def url_clusters(urls: DataFrame, most: int = 15) -> DataFrame:
    """(site_id, pattern, n, rank): the largest url templates of each site; urls: (site_id, url)."""
    sized = urls.groupBy("site_id", T.cluster_key(F.col("url")).alias("pattern")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("n").desc(), "pattern"))
    return sized.withColumn("rank", rank).where(F.col("rank") <= most)


def url_keys(urls: DataFrame) -> DataFrame:
    u = F.col("url")
    return urls.select("*", T.netloc(u).alias("netloc"), T.norm_path(u).alias("path_key"), T.norm_url_key(u).alias("doc_key"), T.redirect_key(u).alias("hop_key"), T.cluster_key(u).alias("cluster"))


def candidate_links(links: DataFrame, most: int = 400) -> DataFrame:
    """(site_id, url, ord): same-site document links by first sight; links: (site_id, netloc, href, ord)."""
    href = F.col("href")
    good = T.url_part(href, "scheme").isin("http", "https") & (T.netloc(href) == F.col("netloc")) & (T.norm_path(href) != "/")
    good = good & ~T.url_part(href, "path").rlike(ASSET) & ~T.url_part(href, "path").rlike(LISTING)
    first = links.where(good).groupBy("site_id", T.norm_path(href).alias("path_key")).agg(F.min(F.struct("ord", "href")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("first.ord", "path_key"))
    return first.withColumn("ord", rank).where(F.col("ord") <= most).select("site_id", F.col("first.href").alias("url"), "ord")


def select_pages(urls: DataFrame, most: int = 8) -> DataFrame:
    """(site_id, url, page_class, ord): the home page, a page for each priority's templates, the largest other templates, account pages last.

    urls: (site_id, url, ord). A template's page is its first url; templates go by size, ties by first sight."""
    rows = urls.withColumn("pattern", T.cluster_key(F.col("url")))
    group = Window.partitionBy("site_id", "pattern")
    rows = rows.withColumn("size", F.count("*").over(group)).withColumn("turn", F.row_number().over(group.orderBy("ord")))
    home = rows.where(T.url_part(F.col("url"), "path").isin("", "/")).groupBy("site_id").agg(F.min_by("url", "ord").alias("url"))
    home = home.select("site_id", "url", F.lit("homepage").alias("page_class"), F.lit(0).alias("phase"), F.lit(0).alias("priority"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("ord"))
    shown = rows.where("turn <= 3").groupBy("site_id", "pattern").agg(F.max("size").alias("size"), F.min("ord").alias("ord"), F.min_by("url", "ord").alias("url"), F.concat_ws("\n", F.collect_list("url")).alias("seen"))
    fits = [F.when(F.col("pattern").rlike("(?i)" + rx) | F.col("seen").rlike("(?i)" + rx), F.struct(F.lit(i).alias("priority"), F.lit(label).alias("page_class"))) for i, (label, rx) in enumerate(PRIORITIES)]
    shown = shown.withColumn("fit", F.coalesce(*fits, F.struct(F.lit(len(PRIORITIES)).alias("priority"), F.lit("other").alias("page_class"))))
    account = F.col("pattern").rlike("(?i)" + ACCOUNT) | F.col("url").rlike("(?i)" + ACCOUNT)
    picks = shown.select("site_id", "url", "fit.page_class", F.when(account, 2).otherwise(1).alias("phase"), "fit.priority", "size", F.col("ord").cast("long").alias("ord"))
    both = home.unionByName(picks)
    once = Window.partitionBy("site_id", "url").orderBy("phase", "priority")
    both = both.withColumn("dup", F.row_number().over(once)).where("dup = 1")
    order = Window.partitionBy("site_id").orderBy("phase", "priority", F.col("size").desc(), "ord", "url")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("site_id", "url", "page_class", F.col("place").alias("ord"))


def _contains_any(words: tuple[str, ...]):
    return lambda x: reduce(or_, [x.contains(w) for w in words])


def site_type_scores(facts: DataFrame, most: int = 3) -> DataFrame:
    """(site_id, site_type, score, rank); facts: (site_id, host, types array, paths array, wording), all lower case.

    Four for each schema type, up to six for paths, two for each phrase, ten for a public host, five for a telling host prefix;
    of those at least 4 and half of the best score, the best three."""
    arms = []
    for name, (types, markers, phrases) in SITE_TYPES.items():
        hit_types = F.size(F.array_intersect("types", F.array(*map(F.lit, types))))
        marked = F.size(F.filter("paths", _contains_any(markers)))
        said = reduce(add, [F.col("wording").contains(p).cast("int") for p in phrases])
        score = 4 * hit_types + F.least(F.lit(6), marked) + 2 * said
        if name == "gov-edu":
            score = score + F.when(F.col("host").rlike(PUBLIC_HOST), 10).otherwise(0)
        for prefix, kind in HOST_PREFIXES:
            if kind == name:
                score = score + F.when(F.col("host").startswith(prefix), 5).otherwise(0)
        arms.append(F.struct(F.lit(name).alias("site_type"), score.cast("int").alias("score")))
    rows = facts.select("site_id", F.explode(F.array(*arms)).alias("s")).select("site_id", "s.*").where("score > 0")
    rows = rows.withColumn("best", F.max("score").over(Window.partitionBy("site_id"))).where("score >= 4 and score * 2 >= best")
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("score").desc(), "site_type"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("best")


def sitemap_orphans(entries: DataFrame, links: DataFrame, selected: DataFrame) -> DataFrame:
    """(site_id, url, important): sitemap urls that no sampled page links to and that were not sampled themselves.

    entries, selected: (site_id, url); links: (site_id, netloc, href)."""
    key = lambda df, c: df.select("site_id", T.norm_path(F.col(c)).alias("path_key")).distinct()
    linked = key(links.where(T.netloc(F.col("href")) == F.col("netloc")), "href")
    rows = entries.select("site_id", "url").withColumn("path_key", T.norm_path(F.col("url")))
    rows = rows.join(linked, ["site_id", "path_key"], "left_anti").join(key(selected, "url"), ["site_id", "path_key"], "left_anti")
    important = (F.size(T.segments(F.col("url"))) <= 1) & F.col("url").rlike(ORPHAN_PATH)
    return rows.select("site_id", "url", important.alias("important"))


def lastmod_stats(entries: DataFrame) -> DataFrame:
    """(site_id, entries, present, distinct_values); entries: (site_id, url, lastmod)."""
    lastmod = F.nullif(F.trim(T.text_of(F.col("lastmod"))), F.lit(""))
    return entries.groupBy("site_id").agg(F.count("*").alias("entries"), F.count(lastmod).alias("present"), F.count_distinct(lastmod).alias("distinct_values"))


def hreflang_problems(pages: DataFrame, alternates: DataFrame) -> DataFrame:
    """(site_id, url, issue, value): bad language tags, and sampled targets that do not name the page's language in return.

    pages: (site_id, url, lang); alternates: (site_id, url, lang, href)."""
    bad = alternates.where((T.text_of(F.col("lang")) != "") & ~F.col("lang").rlike(LANG_TAG)).select("site_id", "url", F.lit("invalid lang").alias("issue"), F.col("lang").alias("value"))
    good = alternates.where((T.text_of(F.col("lang")) == "") | F.col("lang").rlike(LANG_TAG)).select("site_id", "url", T.norm_path(F.col("href")).alias("to"))
    own = pages.select("site_id", "url", F.lower(T.text_of(F.col("lang"))).alias("own"))
    back = alternates.groupBy("site_id", F.col("url").alias("target")).agg(F.collect_set(F.lower(T.text_of(F.col("lang")))).alias("back"))
    target = pages.select("site_id", F.col("url").alias("target"), T.norm_path(F.col("url")).alias("to"))
    target = target.join(back, ["site_id", "target"], "left")
    met = good.join(own, ["site_id", "url"]).join(target, ["site_id", "to"])
    missing = met.where(~F.array_contains(F.coalesce("back", F.array().cast("array<string>")), F.col("own")))
    return bad.unionByName(missing.select("site_id", "url", F.lit("missing reciprocal tag").alias("issue"), F.col("target").alias("value")))


def redirect_shapes(chains: DataFrame) -> DataFrame:
    """(site_id, url, hops, loops, long_chain); chains: (site_id, url, chain array)."""
    keys = F.transform("chain", T.redirect_key)
    hops = F.greatest(F.size("chain") - 1, F.lit(0))
    loops = F.size(F.array_distinct(keys)) < F.size(keys)
    return chains.select("site_id", "url", hops.alias("hops"), loops.alias("loops"), (~loops & (hops >= 4)).alias("long_chain"))


def canonical_conflicts(pages: DataFrame) -> DataFrame:
    """(site_id, url, canonical, redirected, target_key) of pages whose canonical is another document; pages: (site_id, url, final_url, canonical, chain)."""
    final = F.coalesce(F.nullif("final_url", F.lit("")), F.col("url"))
    rows = pages.where((T.text_of(F.col("canonical")) != "") & (T.norm_url_key(F.col("canonical")) != T.norm_url_key(final)))
    return rows.select("site_id", "url", "canonical", (F.coalesce(F.size("chain"), F.lit(0)) > 1).alias("redirected"), T.norm_url_key(F.col("canonical")).alias("target_key"))


def rotted(status: Column) -> Column:
    """400 and above, but for 410: gone is a right answer. A timeout has no status and never counts."""
    return F.coalesce((status >= 400) & (status != 410), F.lit(False))


def link_rot(probes: DataFrame) -> DataFrame:
    """(site_id, sampled, rotted, on_decision_path, severity); probes: (site_id, url, status)."""
    bad = rotted(F.col("status"))
    decision = bad & T.url_part(F.col("url"), "path").rlike(DECISION_PATH)
    rows = probes.groupBy("site_id").agg(F.count("*").alias("sampled"), F.count_if(bad).alias("rotted"), F.count_if(decision).alias("on_decision_path"))
    severity = F.when(F.col("rotted") == 0, F.lit(None)).when((F.col("rotted") >= 3) | (F.col("on_decision_path") > 0), "medium").otherwise("low")
    return rows.withColumn("severity", severity.cast("string"))


def fetch_latency(samples: DataFrame, least: int = 3, medium_ms: int = 2500, high_ms: int = 5000) -> DataFrame:
    """(site_id, n, median_ms, min_ms, max_ms, severity) of the successful, timed fetches; samples: (site_id, timing_ms, status).

    The median is an integer, rounded down; fewer than `least` samples give no severity and no verdict."""
    ok = samples.where((F.col("timing_ms") > 0) & (F.col("status") < 400))
    rows = exact_median(ok, "site_id", "timing_ms").withColumnsRenamed({"median": "median_ms", "least": "min_ms", "most": "max_ms"})
    return rows.withColumn("severity", F.when(F.col("n") < least, "not_evaluated").when(F.col("median_ms") >= high_ms, "high").when(F.col("median_ms") >= medium_ms, "medium").otherwise("pass"))
