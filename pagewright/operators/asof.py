"""As-of joins, and what automated readers are served beside browsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import markup as H
from pagewright.functions import text as T

from .robots import decide_paths

# The crawlers that probes stand for, and the answers that turn a reader away.
PROBE_TOKENS = ("OAI-SearchBot", "GPTBot", "PerplexityBot")
REFUSALS = (401, 403, 429, 503)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, tie: str, carry: list[str], stretch: float) -> DataFrame:
    """left and, as `found`, the carried columns of the nearest right row that is not later, of the same keys; null where there is none.

    Keys are equal also where both are null; a left row without a time finds nothing. Of right rows of one time that of the greatest
    `tie` counts; left rows may repeat. Time is cut into stretches of that many units (seconds for a timestamp). Inside a stretch the
    rows of a key are walked in order; from stretch to stretch only the last right row of each travels, one row a stretch, so a key
    with very many rows is spread over as many tasks as it has stretches."""
    one = lambda name: F.col("`" + name.replace("`", "``") + "`")
    key = [one(k).alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    is_time = dict(left.dtypes)[at].startswith("timestamp")
    when = F.unix_micros(one(at).cast("timestamp")) / 1_000_000 if is_time else one(at)
    place = [*key, one(at).alias("at"), F.floor(when / stretch).alias("stretch")]
    payload = F.struct(one(at).alias("at"), one(tie).alias("tie"), F.struct(*map(one, carry)).alias("row"))
    rows = left.select(*place, F.lit(1).alias("side"), F.struct(*map(one, left.columns)).alias("own"))
    facts = right.where(one(at).isNotNull()).select(*place, F.lit(0).alias("side"), payload.alias("fact"))
    both = rows.unionByName(facts, allowMissingColumns=True)

    earlier = Window.partitionBy(*names).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*names, "stretch").agg(F.max("fact").alias("fact"))
    ends = ends.select(*[F.col(n).alias(f"e_{n}") for n in names], F.col("stretch").alias("e_stretch"), F.last("fact", ignorenulls=True).over(earlier).alias("before"))
    same = F.col("stretch").eqNullSafe(F.col("e_stretch"))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"e_{n}"))
    met = both.join(ends, same, "left")
    # the facts of a time come before the rows of it
    walk = Window.partitionBy(*names, "stretch").orderBy("at", "side", F.col("fact.tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.coalesce(F.last("fact", ignorenulls=True).over(walk), "before")
    return met.withColumn("found", F.when(F.col("at").isNotNull(), found)).where("side = 1").select("own.*", F.col("found.row").alias("found"))


def robots_meta(body: Column) -> Column:
    """The content of a raw body's first robots meta tag; null without one."""
    tags = F.regexp_extract_all(T.text_of(body), F.lit(H.opening("meta")), 0)
    tag = F.get(F.filter(tags, lambda t: t.rlike(r"""(?i)\sname\s*=\s*["']?robots(?:["'\s/>])""") & t.rlike(r"(?i)\scontent\s*=")), 0)
    value = F.regexp_extract(tag, r"""(?is)\scontent\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*)""", 1)
    return F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit(""))


def ua_probes(fetches: DataFrame, robots: DataFrame | None = None, tokens: tuple[str, ...] = PROBE_TOKENS, stretch: float = 86400) -> DataFrame:
    """(site_id, fetch_id, token, requested_path, robots_allows, status, browser_status, browser_at, differential, robots_meta,
    x_robots_tag): each automated fetch beside the browser's last fetch of the same path before it.

    fetches: (site_id, fetch_id, at, token null for a browser, url, status, body, x_robots_tag). robots: robots_rows(); a token that
    they bar from a path has no answer, the rule itself is what there is to say. A differential is a refusal where a browser got
    another answer; without a browser's answer, or without one's own, there is none."""
    rows = fetches.withColumn("requested_path", T.norm_path(F.col("url")))
    bots = rows.where(F.col("token").isin(*tokens)).withColumn("robots_meta", robots_meta(F.col("body"))).drop("body", "url")
    browsers = rows.where(F.col("token").isNull() & F.col("status").isNotNull()).select("site_id", "requested_path", "at", "fetch_id", "status")
    met = as_of(bots, browsers, ["site_id", "requested_path"], "at", "fetch_id", ["status", "at"], stretch)
    if robots is None:
        met = met.withColumn("robots_allows", F.lit(None).cast("boolean"))
    else:
        asked = met.select("site_id", F.col("requested_path").alias("path")).distinct()
        named = met.select("site_id", "token").distinct()
        decided = decide_paths(asked, robots, named).select(F.col("site_id").alias("d_site"), F.col("token").alias("d_token"), F.col("path").alias("d_path"), (~F.col("blocked")).alias("robots_allows"))
        met = met.join(decided, (F.col("site_id") == F.col("d_site")) & (F.col("token") == F.col("d_token")) & (F.col("requested_path") == F.col("d_path")), "left")
    asked = F.coalesce("robots_allows", F.lit(True))
    answer = lambda c: F.when(asked, F.col(c)).alias(c)
    refused = F.col("status").isin(*REFUSALS) & (F.col("status") != F.col("found.status"))
    said = F.when(asked & refused, F.format_string("browser %d / bot-UA %d", "found.status", "status"))
    return met.select(
        "site_id", "fetch_id", "token", "requested_path", "robots_allows", answer("status"), F.col("found.status").alias("browser_status"),
        F.col("found.at").alias("browser_at"), said.alias("differential"), answer("robots_meta"), answer("x_robots_tag"),
    )
