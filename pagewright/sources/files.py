"""Stored captures and documents as tables: JSON, JSON lines, CSV ledgers, sitemaps, gzip bodies, probe logs, and the sinks."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.window import Window

from pagewright.functions import text as T

# What a probe may come to, and the protocol's limits.
OUTCOMES = ("official-cited", "third-party-cited", "mentioned-not-cited", "absent", "wrong-entity", "fact-stated-wrongly", "unhelpful-landing")
MOST_PROBES, MOST_NAVIGATIONAL, MOST_URLS = 6, 1, 10
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken rows): a file, or line, that cannot be read is a broken row with its path, never a failed job.

    Good rows have the schema's columns and _path, broken ones _path and _corrupt, the text. A file that holds an array gives a row for
    each of its objects. Empty lines and files of no bytes are passed over."""
    raw = spark.read.text(path, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("_path"))
    raw = raw.where(F.trim("value") != "") if lines else raw
    one = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    many = F.from_json("value", f"array<struct<{_typed(schema)}>>", {"mode": "PERMISSIVE"})
    rows = raw.withColumn("is_list", F.col("value").rlike(r"^\s*\[")).withColumn("one", F.when(~F.col("is_list"), one)).withColumn("many", F.when(F.col("is_list"), many))
    names = [f.name for f in T_.StructType.fromDDL(schema)]
    item = lambda source: [F.col(f"{source}.{n}").alias(n) for n in names]
    singles = rows.where("one is not null and one._corrupt is null").select(*item("one"), "_path")
    listed = rows.where("many is not null").select(F.explode("many").alias("item"), "_path").where("item is not null").select(*item("item"), "_path")
    broken = rows.where("coalesce(one._corrupt, if(one is null and many is null, value, null)) is not null").select("_path", F.col("value").alias("_corrupt"))
    return singles.unionByName(listed), broken


def _typed(schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T_.StructType.fromDDL(schema))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).csv(path)


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The file of a pattern that was changed last."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_sizes(df: DataFrame, *keys: str) -> DataFrame:
    """The characters that each row takes as JSON."""
    return df.select(*keys, F.length(F.to_json(F.struct(*df.columns))).cast("long").alias("json_chars"))


def salvage_gzip(data: bytes, most: int = 2 << 20) -> bytes:
    """The decompressed body, or what a cut-off one still yields, up to `most` bytes."""
    out, stream = b"", zlib.decompressobj(31)
    for at in range(0, len(data), 1 << 14):
        try:
            out += stream.decompress(data[at : at + (1 << 14)], most - len(out)) if len(out) < most else b""
        except zlib.error:
            break
    return out[:most]


def decode_bodies(captures: DataFrame) -> DataFrame:
    """captures with html, decoded from body (binary) by content_encoding; types other than html and xml keep null html."""
    kept = [c for c in captures.columns if c != "body"]

    def emit(batches):
        for pdf in batches:
            html = []
            for body, coding, kind in zip(pdf["body"], pdf["content_encoding"], pdf["content_type"], strict=True):
                readable = body is not None and re.search("html|xml", kind or "html", re.I)
                raw = salvage_gzip(bytes(body)) if readable and (coding or "").lower() == "gzip" else bytes(body)[: 2 << 20] if readable else None
                html.append(None if raw is None else raw.decode("utf-8", "replace"))
            yield pdf[kept].assign(html=html)

    schema = captures.select(*kept).schema.add("html", "string")
    return captures.mapInPandas(emit, schema)


def parse_sitemaps(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sitemaps, entries): (site_id, url, http_status, parse_ok, is_index) and (site_id, url, lastmod, ord).

    bodies: (site_id, url, http_status, xml). An index's first child is the next document to fetch: entries of kind 'sitemap'."""
    xml = F.regexp_replace(T.text_of(F.col("xml")), r"<\?xml[^>]*\?>|<!--(?s:.*?)-->", "")
    whole = F.trim(xml).rlike(r"(?s)^<(?:\w+:)?(urlset|sitemapindex)\b.*</(?:\w+:)?(urlset|sitemapindex)>$")
    rows = bodies.withColumn("x", F.trim(xml)).withColumn("parse_ok", whole)
    sitemaps = rows.select("site_id", "url", "http_status", "parse_ok", F.col("x").rlike(r"^<(?:\w+:)?sitemapindex\b").alias("is_index"))
    item = F.posexplode(F.regexp_extract_all("x", F.lit(r"(?s)<(?:\w+:)?(?:url|sitemap)>(.*?)</(?:\w+:)?(?:url|sitemap)>"), 1))
    entries = rows.where("parse_ok").select("site_id", item.alias("ord", "item"))
    part = lambda tag: F.trim(F.regexp_extract("item", rf"(?s)<(?:\w+:)?{tag}>(.*?)</", 1))
    entries = entries.select("site_id", part("loc").alias("url"), F.nullif(part("lastmod"), F.lit("")).alias("lastmod"), "ord").where("url <> ''")
    return sitemaps, entries


def probe_rows(logs: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of probe logs: lines "[Q-id] label outcome", then notes and urls of that probe.

    logs: (site_id, body); prompts: (site_id, question_id, question). Rows: (site_id, question_id, engine, stamp, label, outcome, note,
    cited array, question). Problems name the site and what breaks the protocol; a site with any has no rows."""
    lines = logs.select("site_id", F.posexplode(F.split(T.text_of(F.col("body")), r"\r?\n")).alias("ord", "raw"))
    lines = lines.withColumn("line", F.trim("raw")).where("line <> '' and not startswith(line, '#')")
    head = r"^\[([A-Za-z0-9_-]+)\]\s+(\S+)\s+(\S+)$"
    low, line = F.lower("line"), F.col("line")
    kind = F.when(low.startswith("engine:"), "engine").when(low.startswith("timestamp:"), "stamp").when(line.rlike(head), "head").when(low.startswith("note:"), "note").when(line.rlike("^https?://"), "url").otherwise("other")
    lines = lines.withColumn("kind", kind).withColumn("rest", F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)))
    lines = lines.withColumn("probe", F.sum((F.col("kind") == "head").cast("int")).over(Window.partitionBy("site_id").orderBy("ord")))
    site = lines.groupBy("site_id").agg(F.max(F.when(F.col("kind") == "engine", F.col("rest"))).alias("engine"), F.max(F.when(F.col("kind") == "stamp", F.col("rest"))).alias("stamp"))
    probes = lines.where("probe > 0").groupBy("site_id", "probe").agg(
        F.max(F.when(F.col("kind") == "head", line)).alias("head"), F.max(F.when(F.col("kind") == "note", F.struct("ord", "rest"))).alias("n"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "url", F.struct("ord", "line")))), lambda x: x["line"]), 1, MOST_URLS).alias("cited"),
    )
    part = lambda i: F.regexp_extract("head", head, i)
    probes = probes.select("site_id", "probe", part(1).alias("question_id"), part(2).alias("label"), part(3).alias("outcome"), F.col("n.rest").alias("note"), "cited").join(site, "site_id")
    probes = probes.join(prompts.select("site_id", "question_id", "question"), ["site_id", "question_id"], "left")
    of_site, of_question = Window.partitionBy("site_id"), Window.partitionBy("site_id", "question_id")
    probes = probes.withColumn("all", F.count("*").over(of_site)).withColumn("navigational", F.count_if(F.col("label") == "navigational").over(of_site)).withColumn("same", F.count("*").over(of_question))
    faults = F.array_compact(F.array(
        F.when(~F.col("outcome").isin(*OUTCOMES), "unknown outcome"), F.when(~F.col("label").isin("-", "navigational"), "unknown label"), F.when(F.col("engine").isNull(), "no engine"),
        F.when(~F.coalesce(F.col("stamp").rlike(STAMP), F.lit(False)), "no UTC timestamp"), F.when(F.col("question").isNull(), "unknown question"), F.when(F.col("same") > 1, "question recorded twice"),
        F.when(F.col("all") > MOST_PROBES, "too many probes"), F.when(F.col("navigational") > MOST_NAVIGATIONAL, "too many navigational probes"),
    ))
    stray = lines.where("kind = 'other' or (probe = 0 and kind in ('note', 'url'))").select("site_id", F.lit("line cannot be read").alias("problem"))
    problems = probes.select("site_id", F.explode(faults).alias("problem")).unionByName(stray).distinct()
    rows = probes.join(problems, "site_id", "left_anti").select("site_id", "question_id", "engine", "stamp", F.nullif("label", F.lit("-")).alias("label"), "outcome", "note", "cited", "question")
    return rows, problems


def corpus_stats(runs: DataFrame) -> DataFrame:
    """One row over recorded runs: their number, least, most and mean questions; runs: (run_id, questions)."""
    return runs.agg(F.count("*").alias("runs"), F.min("questions").alias("least"), F.max("questions").alias("most"), F.round(F.avg("questions"), 4).alias("mean"))

