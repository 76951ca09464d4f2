"""Bounded views of a site's pages for reviewers: question slots, dates, first screens, headings and navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The kinds of question that a page's headings may claim, with their keywords, in order.
SLOTS = (
    ("transaction", ("fee", "pricing", "price", "cost", "tuition", "admission")),
    ("procedure", ("how", "install", "guide", "apply", "setup", "steps")),
    ("temporal", ("version", "release", "deadline", "update", "changelog", "news")),
    ("local", ("location", "contact", "hours", "address", "visit", "campus")),
    ("trust", ("certif", "accredit", "recogn", "award", "policy", "privacy")),
    ("capability", ("feature", "support", "service", "program", "product")),
    ("comparison", ("compare", " vs ", "plans", "tiers")),
)
MOST_SLOTS, MOST_DATES, MOST_HEADINGS, MOST_LABELS = 6, 5, 30, 20


def suggested_slots(pages: DataFrame, headings: DataFrame, most: int = MOST_SLOTS) -> DataFrame:
    """(site_id, ord, archetype, url): identity on the first page, then each kind that a page's headings claim, in page order.

    pages: (site_id, page_ord, url); headings: (site_id, page_ord, ord, text)."""
    said = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))), lambda h: h["text"]), " "))
    heads = headings.groupBy("site_id", "page_ord").agg(said.alias("heads"))
    claims = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.col("heads").contains(w))
    found = F.array_compact(F.array(*[F.when(claims(words), F.struct(F.lit(k + 1).alias("kind"), F.lit(name).alias("archetype"))) for k, (name, words) in enumerate(SLOTS)]))
    rows = pages.join(heads, ["site_id", "page_ord"]).select("site_id", "page_ord", "url", F.inline(found))
    first = pages.groupBy("site_id").agg(F.min("page_ord").alias("page_ord"), F.min_by("url", "page_ord").alias("url"))
    both = rows.unionByName(first.select("site_id", F.lit(None).cast("long").alias("page_ord"), "url", F.lit(0).alias("kind"), F.lit("identity").alias("archetype")))
    order = Window.partitionBy("site_id").orderBy(F.col("page_ord").asc_nulls_first(), "kind")
    return both.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most).select("site_id", "ord", "archetype", "url")


def page_dates(pages: DataFrame, claims: DataFrame, most: int = MOST_DATES) -> DataFrame:
    """(page_id, structured, visible): a page's structured dates and the first dates that it shows; arrays, empty for none.

    pages: (page_id, structured_dates array); claims: (page_id, claim_ord, type, value)."""
    none = F.array().cast("array<string>")
    shown = claims.where("type = 'date'").groupBy(F.col("page_id").alias("p")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("claim_ord", "value"))), lambda c: c["value"]), 1, most).alias("visible"))
    rows = pages.join(shown, F.col("page_id") == F.col("p"), "left")
    return rows.select("page_id", F.coalesce("structured_dates", none).alias("structured"), F.coalesce("visible", none).alias("visible"))


def date_coverage(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """(site_id, structured, visible, pages): pages with structured dates, with dates that they show, and all."""
    shown = claims.where("type = 'date'").select(F.col("page_id").alias("p")).distinct().withColumn("shows", F.lit(True))
    rows = pages.join(shown, F.col("page_id") == F.col("p"), "left")
    return rows.groupBy("site_id").agg(F.count_if(F.size(F.coalesce("structured_dates", F.array().cast("array<string>"))) > 0).alias("structured"), F.count_if(F.col("shows")).alias("visible"), F.count("*").alias("pages"))


def screen_windows(pages: DataFrame, sections: DataFrame, headings: DataFrame) -> DataFrame:
    """(page_id, window_offset, headline, overlay_present): where a page's text begins, its first main heading, an overlay in its source.

    pages: (page_id, overlay boolean); sections: (page_id, char_offset); headings: (page_id, ord, level, text)."""
    start = sections.groupBy(F.col("page_id").alias("s")).agg(F.min("char_offset").alias("window_offset"))
    main = headings.where("level = 1").groupBy(F.col("page_id").alias("h")).agg(F.min_by("text", "ord").alias("headline"))
    rows = pages.join(start, F.col("page_id") == F.col("s"), "left").join(main, F.col("page_id") == F.col("h"), "left")
    return rows.select("page_id", "window_offset", "headline", F.coalesce("overlay", F.lit(False)).alias("overlay_present"))


def heading_inventory(headings: DataFrame, most: int = MOST_HEADINGS) -> DataFrame:
    """(site_id, place, text): a site's first headings of the two upper levels; headings: (site_id, page_ord, ord, level, text)."""
    order = Window.partitionBy("site_id").orderBy("page_ord", "ord")
    rows = headings.where("level in (1, 2) and text <> ''").withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= most).select("site_id", "place", "text")


def nav_inventory(links: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """(site_id, place, label): a site's first distinct link labels; links: (site_id, page_ord, ord, anchor_text)."""
    label = F.regexp_replace(F.coalesce("anchor_text", F.lit("")), r"(?U)^\s+|\s+$", "")
    first = links.select("site_id", label.alias("label"), F.struct("page_ord", "ord").alias("seen")).where("label <> ''").groupBy("site_id", "label").agg(F.min("seen").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("seen"))
    return first.withColumn("place", rank).where(F.col("place") <= most).select("site_id", "place", "label")
