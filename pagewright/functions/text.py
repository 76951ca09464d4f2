"""Scalar functions on text and urls, all JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation look-alikes and what each is compared as.
CONFUSABLES = "‐‑‒–—−‘’‚‛“”„‟ "
CONFUSABLES_AS = "------''''\"\"\"\" "
# Words that say nothing about whose name it is.
STOP_TOKENS = ("the", "and", "of", "a", "an", "to", "for")
LEGAL_TOKENS = ("inc", "llc", "ltd", "gmbh", "corp", "corporation", "co", "company", "limited", "llp", "bv", "ag", "sa", "sas", "pty", "foundation", "nonprofit")
# Words that say what kind of thing a name stands for.
QUALIFIERS = (
    "documentation", "software", "library", "framework", "platform", "agency", "studio", "consultancy", "tools", "developer", "hosting",
    "marketplace", "app", "api", "saas", "analytics", "cloud", "foundation", "nonprofit", "open", "source", "university", "institute", "college",
    "school", "council", "ministry", "department", "government", "clinic", "dental", "dentist", "medical", "hospital", "restaurant", "cafe", "hotel",
    "salon", "garage", "bakery", "clothing", "apparel", "streetwear", "fashion", "wear", "shop", "store", "brand", "label", "boutique", "jewellery",
    "jewelry", "furniture", "cosmetics", "beauty", "skincare", "footwear", "outfitters", "news", "magazine", "journal", "media", "publisher",
    "review",
)
# RFC 3986 appendix B, with the parts that are asked for as groups.
URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def text_of(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def fold(x: Column) -> Column:
    """Runs of any Unicode white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(text_of(x), r"(?U)\s+", " "))


def fold_confusables(x: Column) -> Column:
    return fold(F.translate(text_of(x), CONFUSABLES, CONFUSABLES_AS))


def short(x: Column, limit: int = 200) -> Column:
    t = F.regexp_replace(text_of(x), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def url_part(url: Column, part: str) -> Column:
    """scheme, netloc, path, query or fragment; lenient, never null."""
    return F.regexp_extract(text_of(url), URL, ("scheme", "netloc", "path", "query", "fragment").index(part) + 1)


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_replace(url_part(url, "netloc"), r"\.+$", ""))


def norm_path(url: Column) -> Column:
    """The path without trailing slashes; "/" for none."""
    path = F.regexp_replace(url_part(url, "path"), "/+$", "")
    return F.when(path == "", F.lit("/")).otherwise(path)


def norm_url_key(url: Column) -> Column:
    """Host without www. and path without slash or index page: urls of one document agree."""
    host = F.regexp_replace(F.regexp_replace(F.lower(url_part(url, "netloc")), r"\.+$", ""), r"^www\.", "")
    path = F.regexp_replace(url_part(url, "path"), "/+$", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", ""), "/+$", ""))


def redirect_key(url: Column) -> Column:
    """The url as it is, with scheme and host in lower case and no fragment."""
    query, path = url_part(url, "query"), url_part(url, "path")
    return F.concat(
        F.lower(url_part(url, "scheme")), F.lit("://"), F.lower(url_part(url, "netloc")),
        F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def segments(url: Column) -> Column:
    return F.filter(F.split(url_part(url, "path"), "/"), lambda s: s != "")


def cluster_key(url: Column) -> Column:
    """The url's template: its first two path segments with digit runs as {d}."""
    return F.concat(F.lit("/"), F.array_join(F.transform(F.slice(segments(url), 1, 2), lambda s: F.regexp_replace(s, r"(?U)\d+", "{d}")), "/"))


def parse_number(x: Column) -> Column:
    """The first number, without its thousands separators; null without one."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text_of(x), r"\d[\d,]*(?:\.\d+)?", 0), F.lit("")), ",", "").try_cast("double")


def name_tokens(x: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_of(x)), F.lit("[a-z0-9]+"), 0))
    return F.array_except(words, F.array(*map(F.lit, STOP_TOKENS + LEGAL_TOKENS)))


def significant(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$"))


def same_name(a: Column, b: Column) -> Column:
    """One token set holds the other, or they share a significant token."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    inside = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return (some & inside) | F.arrays_overlap(significant(a), significant(b))


def title_segments(x: Column) -> Column:
    """The parts of a title between separators that have white space around them."""
    t = fold(x)
    parts = F.filter(F.transform(F.split(t, r"(?U)\s+[|–—·:»«]\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


def directives(x: Column) -> Column:
    """Robots directives as a map; the last of a name wins, one without a value maps to null."""
    parts = F.filter(F.split(F.lower(text_of(x)), "[,;]"), lambda p: (F.trim(p) != ""))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, "^([^:]*)", 1)).alias("k"), F.when(p.contains(":"), F.trim(F.regexp_extract(p, "^[^:]*:(.*)$", 1))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def fact_like(x: Column) -> Column:
    """Reads like content: 25 characters and 5 words at least, no url, path, object or machine token."""
    t = fold(x)
    words = F.size(F.split(t, " "))
    return (F.length(t) >= 25) & (words >= 5) & ~t.rlike(r"^(?:http|/|#|\{|fn:|urn:)") & ~t.rlike(r"^[A-Za-z0-9_/.:,@%+=-]+$")


def question_id(x: Column, ordinal: Column) -> Column:
    digits = F.regexp_extract(text_of(x), r"(\d+)", 1)
    return F.concat(F.lit("Q-"), F.format_string("%03d", F.when(digits != "", digits.try_cast("long")).otherwise(ordinal.cast("long"))))


def brand_token(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text_of(name)), "[a-z0-9]+", 0), F.lit(""))


def word_count(x: Column) -> Column:
    t = fold(x)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def has_qualifier(x: Column) -> Column:
    """Whether a text says what kind of thing it names, or its legal form."""
    words = F.regexp_extract_all(F.lower(text_of(x)), F.lit("[a-z]+"), 0)
    return F.arrays_overlap(words, F.array(*map(F.lit, QUALIFIERS + tuple(t for t in LEGAL_TOKENS if t != "foundation"))))


def pct_encode_url(url: Column) -> Column:
    """A url in ASCII: characters that urls may not hold are encoded byte by byte, as Latin-1 where all of them are, else as UTF-8;
    sequences that are encoded already stay, in upper case. Null is the empty text."""
    latin = text_of(url).rlike(r"^[\x00-\xFF]*$")
    hexed = lambda c, charset: F.regexp_replace(F.hex(F.encode(c, charset)), "(..)", "%$1")
    one = lambda c: (
        F.when(c.rlike("^%[0-9a-f]{2}$"), F.upper(c))
        .when(c.rlike(r"^(?:%..|[A-Za-z0-9:/?#\[\]@!$&'()*+,;=%~._-])$"), c)
        .otherwise(F.when(latin, hexed(c, "ISO-8859-1")).otherwise(hexed(c, "UTF-8")))
    )
    return F.array_join(F.transform(F.regexp_extract_all(text_of(url), F.lit("(?s)%[0-9a-fA-F]{2}|."), 0), one), "")


def dig(document: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where there is none."""
    return F.get_json_object(document, "$." + path)
