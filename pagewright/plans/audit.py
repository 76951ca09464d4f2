"""From captured pages to a report: the frames that the checks read, and the whole audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T
from pagewright.operators import claims as C
from pagewright.operators import runs as N
from pagewright.operators import urls as U
from pagewright.operators.shared import stored
from pagewright.sources.html import extract_pages

from .catalog import catalog
from .checks_content import jsonld_nodes, measured
from .report import build_report
from .results import Frames, run_checks

#: What a capture holds besides its page; missing columns are null.
CAPTURE = {"status": "int", "timing_ms": "long", "final_url": "string", "chain": "array<string>", "x_robots_tag": "string", "page_class": "string"}


def site_pages(pages: DataFrame) -> DataFrame:
    """Captures keyed by site: site_id is the url's host; page_ord is the page's place in it; pages: (page_id, url, html, ...)."""
    for name, kind in CAPTURE.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    rows = pages.select("page_id", "url", "html", *CAPTURE, T.netloc(F.col("url")).alias("site_id")).where("site_id <> ''")
    return rows.withColumn("page_ord", F.row_number().over(Window.partitionBy("site_id").orderBy("page_id")))


def page_frame(captures: DataFrame) -> DataFrame:
    """Extracted pages, once for all who read them, with the raw page and the distinct prices that they show."""
    pages = stored(extract_pages(captures.withColumn("raw_html", F.col("html"))))
    price = F.array_distinct(F.regexp_extract_all(T.text_of(F.col("claim_text")), F.lit(C.PATTERNS["price"]), 0))
    return pages.withColumn("prices", price)


def classed(pages: DataFrame, most: int = 8) -> DataFrame:
    """pages with the class that selection gives them where they have none of their own; pages that it leaves out are 'other'."""
    chosen = U.select_pages(pages.select("site_id", "url", F.col("page_ord").alias("ord")), most)
    chosen = chosen.select(F.col("site_id").alias("c_site"), F.col("url").alias("c_url"), F.col("page_class").alias("c_class"))
    rows = pages.join(chosen, (F.col("site_id") == F.col("c_site")) & (F.col("url") == F.col("c_url")), "left")
    return rows.withColumn("page_class", F.coalesce("page_class", "c_class", F.lit("other"))).drop("c_site", "c_url", "c_class")


def derive(frames: Frames) -> Frames:
    """Add what follows from classed pages: measures, claims, JSON-LD nodes, their names."""
    pages = frames["pages"]
    out = dict(frames)
    out["measured"] = measured(pages)
    out["claims"] = C.claim_index(pages.select("page_id", F.col("claim_text").alias("text")))
    out["jsonld_nodes"] = jsonld_nodes(pages.select("page_id", F.posexplode("jsonld.raw").alias("block", "raw")))
    out["names"] = names_of(pages)
    return out


def names_of(pages: DataFrame) -> DataFrame:
    """(site_id, ord, surface, value): the names that pages state, title and structured ones first, in page order."""
    title = F.get(T.title_segments(F.col("title")), 0)
    mains = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"])
    stated = [("title", F.array(title)), ("h1", F.slice(mains, 1, 1)), ("footer", F.array(N.footer_name(F.col("raw_html"))))]

    def cells_of(k: int) -> Column:
        surface, values = stated[k]
        return F.transform(values, lambda v: F.struct(F.lit(k).alias("k"), F.lit(surface).alias("surface"), v.alias("value")))

    cells = F.concat(*map(cells_of, range(len(stated))))
    rows = pages.select("site_id", "page_ord", F.inline(cells)).where("value <> ''")
    return rows.select("site_id", (F.col("page_ord") * len(stated) + F.col("k")).alias("ord"), "surface", "value")


def audit(spark: SparkSession, frames: Frames, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Run every check over the frames and merge the results. `keep` may persist what many checks read: the classed pages and what is
    derived from them."""
    classes = dict(frames, pages=keep(classed(frames["pages"])))
    results = run_checks({name: df if name in frames else keep(df) for name, df in derive(classes).items()})
    order = Window.partitionBy("site_id").orderBy("check_id", "title", F.concat_ws(",", "urls"))
    results = results.withColumn("ord", F.row_number().over(order))
    report = build_report(results, catalog(spark), frames["sites"])
    report["results"] = results
    return report


def bare_sites(pages: DataFrame) -> DataFrame:
    """A sites frame for captures of which only pages are known."""
    none = lambda kind: F.lit(None).cast(kind)
    return pages.select("site_id").distinct().select(
        "site_id", F.concat(F.lit("http://"), "site_id").alias("base_url"), none("array<string>").alias("site_types"), none("long").alias("candidates_count"), F.lit("ok").alias("robots_status"),
        none("int").alias("robots_attempts"), none("int").alias("robots_http_status"), none("boolean").alias("has_llms_txt"), none("timestamp").alias("captured_at"),
    )


def site_repetition(pages: DataFrame) -> DataFrame:
    """The flagship question: how much text does each site carry, and how much of it do its pages repeat?"""
    captures = site_pages(pages).select("site_id", "page_id", "url", "html")
    blocks = extract_pages(captures).select("site_id", "page_id", F.explode("blocks").alias("line"))
    return N.site_overview(stored(blocks))


def stats_of(pages: DataFrame) -> DataFrame:
    """Narrow facts of extracted pages, one row each."""
    cols = ["headings", "links", "images", "jsonld", "sections", "blocks"]
    return pages.select(
        "site_id", "page_id", "title", F.length("visible_text").alias("visible_chars"), F.md5(F.col("visible_text").cast("binary")).alias("visible_md5"),
        T.word_count(F.col("visible_text")).alias("words"), *[F.size(c).alias(f"n_{c}") for c in cols],
    )


def chosen_pages(pages: DataFrame, most: int = 8) -> DataFrame:
    captures = site_pages(pages)
    return U.select_pages(captures.select("site_id", "url", F.col("page_ord").alias("ord")), most)
