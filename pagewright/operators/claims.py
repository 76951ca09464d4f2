"""Typed claims: extraction by patterns, caps, topics, the cross-page matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
# The claim types in order, each with its pattern; digits and word characters are Unicode.
PATTERNS = {
    "price": r"(?U)(?:[$€£₹]\s?\d[\d,.]*)|(?:\b\d[\d,.]*\s?(?:USD|EUR|GBP|INR)\b)",
    "date": rf"(?iuU)\b{_MONTH}\.?\s+\d{{1,2}},?\s?(?:19|20)\d{{2}}\b|\b\d{{1,2}}\s+{_MONTH}\.?\s+(?:19|20)\d{{2}}\b|\b(?:19|20)\d{{2}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}/\d{{1,2}}/(?:19|20)\d{{2}}\b|(?:(?:updated|modified|published|revised|last\s+(?:updated|modified|reviewed)|copyright|©|as\s+of)[^.\n]{{0,40}}?\b(?:19|20)\d{{2}}\b)",
    "count": r"(?iuU)\b\d[\d,.]*\+?\s+(?:customers|users|teams|companies|developers|downloads|installs|packages|modules|plugins|extensions|themes|pages|articles|posts|members|countries|enterprises|stars|reviews|questions|students|patients|locations|stores|recipes|episodes|issues|projects|skills)\b",
    "plan": r"(?U)\b(?:Free|Starter|Basic|Standard|Pro|Professional|Premium|Team|Business|Enterprise|Growth|Scale|Plus|Advanced)\b(?!(?:\s+(?:deviation|library|error|form)))(?:\s+plan)?",
    "version": r"(?iuU)\bv(?:ersion\s*)?\d+\.\d+(?:\.\d+)?\b|\b\d+\.\d+\.\d+\b",
    "hours": r"(?iuU)\b\d{1,2}(?::\d{2})?\s?(?:am|pm)\s?(?:[-–]\s?\d{1,2}(?::\d{2})?\s?(?:am|pm))?",
    "phone": r"(?U)(?:\+\d{1,2}\s?)?(?:\(\d{3}\)|\d{3})[\s.-]\d{3}[\s.-]\d{4}\b",
    "address": r"(?U)\b\d{1,5}\s+[A-Z][A-Za-z]+(?:\s[A-Za-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Suite|Ste|Floor|Way)\b\.?",
    "eligibility": r"(?iuU)\b(?:eligib\w*|eligibility)\b[^.\n]{0,120}",
    "deadline": r"(?iuU)\b(?:deadline|apply by|applies? (?:by|until)|closes? on|ends? on|due (?:by|on)|registration closes)\b[^.\n]{0,80}",
    "stock": r"(?iuU)\b(?:in stock|out of stock|sold out|back-?order|pre-?order|discontinued|no longer available|available again)\b[^.\n]{0,60}",
    "shipping": r"(?iuU)\b(?:free shipping|ships? (?:in|within)|delivery (?:in|within)|same-day delivery)\b[^.\n]{0,60}",
    "credential": r"(?iuU)\b(?:ISO\s?\d{4,5}|SOC\s?2(?:\s+Type\s+I{1,2})?|GDPR[ -]compliant|HIPAA|FedRAMP|PCI[ -]DSS|certified)\b[^.\n]{0,60}",
}
MOST_CLAIMS, QUOTE = 30, 160


def _claim(order: int, kind: str):
    return lambda v, i: F.struct(F.lit(order).alias("k"), i.alias("i"), F.lit(kind).alias("type"), v.alias("value"))


def claim_index(texts: DataFrame, types: tuple[str, ...] = tuple(PATTERNS), most: int | None = MOST_CLAIMS) -> DataFrame:
    """(page_id, claim_ord, type, value, quote): distinct values by type order and place, dotted counts left out, the first `most`.

    texts: (page_id, text). The quote is the first line that holds the value."""
    text = T.text_of(F.col("text"))
    arms = [F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[t]), 0), _claim(k, t)) for k, t in enumerate(types)]
    rows = texts.select("page_id", text.alias("text"), F.explode(F.concat(*arms)).alias("c")).select("page_id", "text", "c.*")
    rows = rows.where(~((F.col("type") == "count") & F.col("value").contains(".")))
    first = F.row_number().over(Window.partitionBy("page_id", "type", "value").orderBy("i"))
    rows = rows.withColumn("again", first).where("again = 1")
    rows = rows.withColumn("claim_ord", F.row_number().over(Window.partitionBy("page_id").orderBy("k", "i")))
    if most is not None:
        rows = rows.where(F.col("claim_ord") <= most)
    line = F.coalesce(F.get(F.filter(F.split("text", "\n"), lambda x: x.contains(F.col("value"))), F.lit(0)), F.col("value"))
    return rows.select("page_id", "claim_ord", "type", "value", F.substring(F.trim(line), 1, QUOTE).alias("quote"))


def claim_topics(claims: DataFrame) -> DataFrame:
    return claims.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


def cap_claims(claims: DataFrame, per_type: int = 6, repeat: int = 5, quote: int = 140) -> DataFrame:
    """(page_id, ord, type, value, quote, n): at most per_type distinct values of a type, values stated over `repeat` times as one row
    with their count, and a marker row, quote null, for each type that lost values (n of them); claims: (page_id, claim_ord, type, value, quote)."""
    value = Window.partitionBy("page_id", "type", "value")
    rows = claims.withColumn("first", F.min("claim_ord").over(value)).withColumn("n", F.count("*").over(value)).withColumn("turn", F.row_number().over(value.orderBy("claim_ord")))
    rows = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("page_id", "type").orderBy("first")))
    cut = F.when(F.length("quote") > quote, F.concat(F.substring("quote", 1, quote - 3), F.lit("..."))).otherwise(F.col("quote"))
    kept = rows.where((F.col("rank") <= per_type) & ((F.col("n") <= repeat) | (F.col("turn") == 1)))
    kept = kept.select("page_id", F.lit(0).alias("marker"), F.col("first").alias("o1"), F.col("claim_ord").alias("o2"), "type", "value", cut.alias("quote"), F.when(F.col("n") > repeat, F.col("n")).otherwise(F.lit(1)).alias("n"))
    lost = rows.where(F.col("rank") > per_type).groupBy("page_id", "type").agg(F.count_distinct("value").alias("n"))
    text = F.format_string("[+%d more distinct %s values on this page]", "n", "type")
    marks = lost.select("page_id", F.lit(1).alias("marker"), F.lit(0).alias("o1"), F.lit(0).alias("o2"), "type", text.alias("value"), F.lit(None).cast("string").alias("quote"), "n")
    both = kept.unionByName(marks)
    order = Window.partitionBy("page_id").orderBy("marker", F.when(F.col("marker") == 1, F.col("type")), "o1", "o2")
    return both.select("page_id", F.row_number().over(order).alias("ord"), "type", "value", "quote", F.col("n").cast("long").alias("n"))


def claim_matrix(claims: DataFrame, most: int = 8) -> DataFrame:
    """(site_id, type, value, pages, rank): the values of each type over a site's pages; claims: (site_id, page_id, type, value)."""
    rows = claims.groupBy("site_id", "type", "value").agg(F.count_distinct("page_id").alias("pages"))
    rank = F.row_number().over(Window.partitionBy("site_id", "type").orderBy(F.col("pages").desc(), "value"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def price_conflicts(schema_prices: DataFrame, claims: DataFrame) -> DataFrame:
    """(page_id, schema_value, visible_value): pages that declare exactly one price and show exactly one, and not the same.

    schema_prices: (page_id, price); claims: (page_id, type, value)."""
    one = lambda df, c, name: df.withColumn("x", T.parse_number(F.col(c).cast("string"))).where("x is not null").groupBy("page_id").agg(F.count_distinct("x").alias(f"{name}_n"), F.min("x").alias(name))
    declared = one(schema_prices, "price", "schema_value").where("schema_value_n = 1")
    shown = one(claims.where("type = 'price'"), "value", "visible_value").where("visible_value_n = 1")
    return declared.join(shown, "page_id").where("schema_value <> visible_value").select("page_id", "schema_value", "visible_value")
