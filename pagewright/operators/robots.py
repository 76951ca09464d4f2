"""Robots files: parsing as gaps and islands over lines, agent rows, and which rule decides a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T

# Crawlers whose index feeds answers.
SEARCH_TOKENS = ("oai-searchbot", "claude-searchbot", "perplexitybot", "googlebot", "bingbot")
MOST_PATHS = 50


def robots_lines(files: DataFrame) -> DataFrame:
    """(site_id, ord, key, value) of the meaningful lines; files: (site_id, body)."""
    rows = files.select("site_id", F.posexplode(F.split(T.text_of(F.col("body")), r"\r\n|\r|\n")).alias("ord", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    rows = rows.withColumn("line", line).where(F.col("line").contains(":"))
    return rows.select("site_id", "ord", F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))


def robots_groups(files: DataFrame) -> DataFrame:
    """(site_id, grp, ord, key, value): user-agent, allow and disallow lines with their group.

    A user-agent line begins a group only after a rule that was recorded: an empty rule records nothing, so the agents after it join the group."""
    rows = robots_lines(files).where(F.col("key").isin("user-agent", "allow", "disallow"))
    by_site = Window.partitionBy("site_id").orderBy("ord")
    so_far = by_site.rowsBetween(Window.unboundedPreceding, -1)
    agent = F.col("key") == "user-agent"
    rows = rows.withColumn("after_agent", F.coalesce(F.max(agent).over(so_far), F.lit(False)))
    rows = rows.where(agent | (F.col("after_agent") & (F.col("value") != "")))
    starts = agent & (F.coalesce(F.lag("key").over(by_site), F.lit("user-agent")) != "user-agent")
    return rows.withColumn("grp", F.sum(starts.cast("int")).over(by_site)).select("site_id", "grp", "ord", "key", "value")


def robots_sitemaps(files: DataFrame) -> DataFrame:
    return robots_lines(files).where("key = 'sitemap' and value <> ''").select("site_id", "ord", F.col("value").alias("url"))


def robots_rows(files: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """(site_id, grp, token, role, disallow array, allow array, catch_all); one row for each agent of each group; roles: (token, role)."""
    groups = robots_groups(files)
    path = lambda key: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == key, F.struct("ord", "value")))), lambda x: x["value"]), 1, MOST_PATHS)
    rules = groups.groupBy("site_id", "grp").agg(path("disallow").alias("disallow"), path("allow").alias("allow"))
    agents = groups.where("key = 'user-agent'").select("site_id", "grp", "ord", F.lower("value").alias("token"))
    rows = agents.join(rules, ["site_id", "grp"])
    if roles is None:
        known = F.when(F.col("token").isin(*SEARCH_TOKENS), F.lit("search-index"))
    else:
        rows = rows.join(F.broadcast(roles.select(F.lower("token").alias("token"), F.col("role").alias("known"))), "token", "left")
        known = F.col("known")
    role = F.coalesce(known, F.when(F.col("token") == "*", "wildcard").otherwise("unknown"))
    return rows.select("site_id", "grp", "ord", "token", role.alias("role"), "disallow", "allow", F.when(F.col("token") == "*", F.array_contains("disallow", "/")).alias("catch_all"))


def rule_body(rule: Column, anchored: bool) -> Column:
    """What a path must begin with. Collector style cuts at "$"; specialist style reads a closing "$" as the path's end."""
    if anchored:
        return F.regexp_replace(F.trim(rule), r"\*+$", "")
    return F.regexp_replace(F.regexp_extract(rule, r"^([^$]*)", 1), r"\*+$", "")


def rule_rows(rows: DataFrame, anchored: bool) -> DataFrame:
    """(site_id, agent, rule, kind, start, exact, size): what a path must begin with, or be if exact, and the length that ranks the rule;
    empty anchored rules fit nothing and are left out."""
    flat = F.explode(F.concat(F.transform("disallow", lambda r: F.struct(r.alias("rule"), F.lit("disallow").alias("kind"))), F.transform("allow", lambda r: F.struct(r.alias("rule"), F.lit("allow").alias("kind")))))
    rules = rows.select("site_id", F.col("token").alias("agent"), flat.alias("r")).select("site_id", "agent", "r.*").distinct()
    body = rule_body(F.col("rule"), anchored)
    if not anchored:
        return rules.select("*", body.alias("start"), F.lit(False).alias("exact"), F.length(body).alias("size"))
    trimmed = F.trim("rule")
    exact = trimmed.endswith("$")
    start = F.when(exact, F.regexp_replace(trimmed, r"\$$", "")).otherwise(body)
    return rules.where(trimmed != "").select("*", start.alias("start"), exact.alias("exact"), F.length(F.regexp_replace(body, r"[*$]+$", "")).alias("size"))


def decide_paths(paths: DataFrame, rows: DataFrame, tokens: DataFrame, anchored: bool = True) -> DataFrame:
    """(site_id, token, path, rule, kind, blocked): the longest rule that fits decides, a disallow before an allow of its length.

    paths: (site_id, path); tokens: (site_id, token); rows: robots_rows. A token without rows of its own is under those of "*".
    A path meets rules by its own beginnings, of the lengths that its site's rules have: an equi join, which only pairs that fit
    leave. Tokens come in when each group of rules has decided."""
    rules = rule_rows(rows, anchored)
    own = rows.select("site_id", F.col("token").alias("key")).distinct().withColumn("has", F.lit(True))
    named = tokens.withColumn("key", F.lower("token")).join(own, ["site_id", "key"], "left")
    named = named.select("site_id", "token", F.when(F.col("has"), F.col("key")).otherwise("*").alias("agent")).distinct()
    asked = paths.select("site_id", "path").where("path is not null").distinct()

    lengths = rules.groupBy("site_id").agg(F.collect_set(F.length("start")).alias("lengths"))
    beginnings = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    starts = asked.join(lengths, "site_id").select("site_id", "path", F.explode(beginnings).alias("start"))
    fits = starts.join(rules, ["site_id", "start"]).where(~F.col("exact") | (F.col("path") == F.col("start")))
    best = F.max(F.struct("size", (F.col("kind") == "disallow").cast("int").alias("first"), "rule"))
    decided = fits.groupBy("site_id", "agent", "path").agg(best.alias("best"))
    out = asked.join(named, "site_id").join(decided, ["site_id", "agent", "path"], "left")
    kind = F.when(F.col("best").isNull(), F.lit(None)).when(F.col("best.first") == 1, "disallow").otherwise("allow")
    return out.select("site_id", "token", "path", F.col("best.rule").alias("rule"), kind.cast("string").alias("kind"), F.coalesce(F.col("best.first") == 1, F.lit(False)).alias("blocked"))
