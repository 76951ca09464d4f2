"""Quality rules whose thresholds come from the corpus itself.

Every text yields a few integer measures. Each measure's distribution is kept, for every language and source, as a
log-bucketed quantile sketch: counts by bucket, five mantissa bits a power of two, so a quantile is at most 1/32 too high.
Counts add up, so sketches merge: partial aggregation merges them inside Spark, and sources merge into languages and these into
the corpus. A group's quantiles are drawn towards its parent's by the weight of `prior` rows: a group of that many stands halfway,
a small one is nearly its parent, a large one nearly itself, and no size switches anything.

A rule's threshold is a fence, the upper decile plus `spread` times its distance from the median (and as far below the lower decile
for the mean word length). No measure has a cutoff of its own: a group where most texts have no symbols has a fence of 0. Since a
text's share is a small sample, a text goes only if its count is over what the fence's share makes likely for its length, by more
than `deviations` standard deviations of that count, where what repeats counts by the piece; a mean strays alike. Documents are then joined to
their group's fences.

Defined cases: a null or empty text has no words and fails the base rule; null language or source is a group of its own;
repeated rows each get their own verdict; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, let, words_of

WINDOW = 8
#: measure: (count, whole, size of a piece), a share in ten-thousandths; or None where the measure is a mean with fences on both sides.
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars", 1),
    "line_share": ("n_dup_lines", "n_lines", 1),
    "repeat_share": ("n_repeat_words", "n_words", 2 * WINDOW),
    "upper_share": ("n_upper", "word_chars", 1),
    "word_length": None,
}
LEVELS = (10, 50, 90)
SHARES = {m: x for m, x in MEASURES.items() if x}


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of that width which the text has twice or more.

    Windows are compared by a 64-bit hash within one text."""

    def covered(win: Column) -> Column:
        at = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def spans(s: Column) -> Column:
            twice = F.filter(s, lambda e, j: F.coalesce(e["x"] == F.get(s, j - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get(s, j + 1)["x"], F.lit(False)))
            return let(
                F.sort_array(F.transform(twice, lambda e: e["i"])),
                lambda p: F.aggregate(F.transform(p, lambda v, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - v, F.lit(width)))), F.lit(0), lambda a, v: a + v),
            )

        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(at, spans))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(let(let(hashed, windows), covered)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and MEASURES of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"), words_of(F.col("text")).alias("words"), lines.alias("lines"))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
    )

    shares = [F.when(F.col(whole) > 0, F.expr(f"{part} * 10000 div {whole}")).otherwise(F.lit(0)).cast("long").alias(m) for m, (part, whole, _) in SHARES.items()]
    mean = F.when(F.col("n_words") > 0, F.expr("word_chars * 100 div n_words")).otherwise(F.lit(0)).cast("long").alias("word_length")
    return rows.select("*", *shares, mean)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, top, n): top is the largest value of the bucket."""
    flat = rows.select("lang", "source", F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])).alias("measure", "value"))
    flat = flat.withColumn("shift", F.greatest(F.length(F.bin("value")) - 6, F.lit(0)))
    flat = flat.withColumn("top", F.expr("shiftleft(shiftright(value, shift) + 1, shift) - 1"))
    return flat.groupBy("lang", "source", "measure", "top").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """One row for each key with {prefix}_n and {prefix}_{measure}_{level}: quantiles of the merged sketch."""
    merged = sketch.groupBy(*keys, "measure", "top").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*keys, "measure")
    merged = merged.withColumn("below", F.sum("n").over(part.orderBy("top"))).withColumn("all", F.sum("n").over(part))
    at = merged.groupBy(*keys, "measure").agg(F.max("all").alias("n"), *[F.min(F.when(F.col("below") * 100 >= F.col("all") * q, F.col("top"))).alias(f"q{q}") for q in LEVELS])
    cells = [F.max(F.when(F.col("measure") == m, F.col(f"q{q}"))).alias(f"{prefix}_{m}_{q}") for m in MEASURES for q in LEVELS]
    return at.groupBy(*keys).agg(F.max("n").alias(f"{prefix}_n"), *cells)


def _rules(prior: int, spread: int, deviations: int) -> tuple[dict[str, str], dict[str, str], list[str]]:
    """(languages' quantiles, fences, tests) in words that Spark and DuckDB share but for integer division, written DIV."""
    lang = {f"d_{m}_{q}": f"(l_n * l_{m}_{q} + {prior} * a_{m}_{q}) DIV (l_n + {prior})" for m in MEASURES for q in LEVELS}
    own = {(m, q): f"((s_n * s_{m}_{q} + {prior} * d_{m}_{q}) DIV (s_n + {prior}))" for m in MEASURES for q in LEVELS}
    fences, tests = {}, []
    for m, share in MEASURES.items():
        fences[f"{m}_most"] = f"{own[m, 90]} + {spread} * ({own[m, 90]} - {own[m, 50]})"
        if share:
            count, whole, piece = share
            over = f"(cast(10000 * {count} as double) - cast({m}_most * {whole} as double))"
            tests.append(f"({over} <= 0 or {over} * {over} <= {deviations**2 * piece}.0 * 10000.0 * (cast({m}_most * {whole} as double) + {10000 * piece}.0))")
        else:
            fences[f"{m}_least"] = f"{own[m, 10]} - {spread} * ({own[m, 50]} - {own[m, 10]})"
            # words stray from their mean length by about half of it, means of n words by that over the root of n
            for off, fence in ((f"{m} - {m}_most", f"{m}_most"), (f"{m}_least - {m}", f"{m}_least")):
                tests.append(f"({off} <= 0 or cast({off} as double) * ({off}) * 4 * n_words <= {deviations**2}.0 * {fence} * {fence})")
    return lang, fences, tests


def quality_rules(docs: DataFrame, prior: int = 200, spread: int = 3, deviations: int = 4, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """Verdicts: doc_id, the base counts, base_failed, kept, and the measures."""
    rows = cut(measures(docs))
    sketch = sketches(rows)
    by_source = quantiles(sketch, ["lang", "source"], "s")
    by_lang = quantiles(sketch, ["lang"], "l").withColumnRenamed("lang", "l_lang")
    overall = quantiles(sketch.withColumn("everything", F.lit(1)), ["everything"], "a")
    lang, fences, tests = _rules(prior, spread, deviations)
    native = lambda named: [F.expr(x.replace("DIV", "div")).cast("long").alias(c) for c, x in named.items()]
    by_lang = by_lang.withColumn("one", F.lit(1)).join(overall, F.col("one") == F.col("everything")).select("l_lang", *native(lang))
    groups = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")))
    groups = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *native(fences))
    joined = rows.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    within = F.expr(" and ".join(tests))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & within).alias("kept"), *MEASURES
    )


def oracle() -> str:
    def quantile_sql(keys: str, prefix: str) -> str:
        part = f"partition by {keys}{', ' if keys else ''}measure"
        lead = f"{keys}, " if keys else ""
        cells = ", ".join(f"max(case when measure = '{m}' then q{q} end) as {prefix}_{m}_{q}" for m in MEASURES for q in LEVELS)
        levels = ", ".join(f"min(case when below * 100 >= total * {q} then top end) as q{q}" for q in LEVELS)
        group = f"group by {keys}" if keys else ""
        return f"""select {lead}max(total) as {prefix}_n, {cells} from (
            select {lead}measure, max(total) as total, {levels}
            from (select {lead}measure, top, sum(n) over ({part} order by top) as below, sum(n) over ({part}) as total
                  from (select {lead}measure, top, sum(n) as n from sketch group by {lead}measure, top))
            group by {lead}measure) {group}"""

    lang, fences, tests = _rules(200, 3, 4)
    named = lambda columns: ", ".join(f"cast({x.replace('DIV', '//')} as bigint) as {c}" for c, x in columns.items())
    shares = ", ".join(f"case when {whole} > 0 then {part} * 10000 // {whole} else 0 end as {m}" for m, (part, whole, _) in SHARES.items())
    flat = " union all ".join(f"select lang, source, '{m}' as measure, {m} as value from m" for m in MEASURES)
    return f"""
with base as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
win as (select rid, i, array_to_string(words[i:i + 7], ' ') as w from base, unnest(range(1, len(words) - 6)) as t(i)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, w) as c from win) where c > 1),
rep as (select rid, sum(least(8, coalesce(nxt - i, 8))) as n_repeat_words
        from (select rid, i, lead(i) over (partition by rid order by i) as nxt from twice) group by rid),
c as (
  select base.rid, doc_id, lang, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         length(regexp_replace(text, '[^A-Z]+', '', 'g'))::bigint as n_upper
  from base left join rep using (rid)),
m as (
  select *, {shares}, case when n_words > 0 then word_chars * 100 // n_words else 0 end as word_length
  from c),
flat as (select *, greatest(length(bin(value)) - 6, 0) as sh from ({flat})),
sketch as (select lang, source, measure, (((value >> sh::bigint) + 1) << sh::bigint) - 1 as top, count(*) as n from flat group by all),
s as ({quantile_sql("lang, source", "s")}),
l as (select l.lang, {named(lang)} from ({quantile_sql("lang", "l")}) l cross join ({quantile_sql("", "a")}) a),
f as (select s.lang, s.source, {named(fences)} from s join l on s.lang is not distinct from l.lang),
v as (select m.*, f.* exclude (lang, source), n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed
      from m left join f on m.lang is not distinct from f.lang and m.source is not distinct from f.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed) and {" and ".join(tests)} as kept,
       {", ".join(f"{m}::bigint as {m}" for m in MEASURES)}
from v"""
