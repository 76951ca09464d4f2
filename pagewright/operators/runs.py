"""Text runs of a site's pages: repetition, shared openings, samples that an anchor can be cut from, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T

from .medians import exact_median
from .shared import computed

OPENING = 150


def opening_lines(texts: DataFrame, most: int = OPENING) -> DataFrame:
    """(site_id, page_id, line_ord, line): the first folded, non-empty lines of each page; texts: (site_id, page_id, text)."""
    lines = F.filter(F.transform(F.split(T.text_of(F.col("text")), "\n"), T.fold), lambda x: x != "")
    return texts.select("site_id", "page_id", F.posexplode(F.slice(lines, 1, most)).alias("line_ord", "line"))


def run_repetition(runs: DataFrame) -> DataFrame:
    """(site_id, line, pages, chars) of the lines on two pages of a site or more; runs: (site_id, page_id, line)."""
    return runs.groupBy("site_id", "line").agg(F.count_distinct("page_id").alias("pages")).where("pages > 1").withColumn("chars", F.length("line"))


def shared_lines(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(site_id, line, pages, needed): lines on at least half of a site's pages, and on two; pages: (site_id, page_id)."""
    sizes = pages.groupBy("site_id").agg(F.greatest(F.lit(2), F.ceil(F.count_distinct("page_id") / 2)).cast("long").alias("needed"))
    return runs.groupBy("site_id", "line").agg(F.count_distinct("page_id").alias("pages")).join(sizes, "site_id").where("pages >= needed")


def extraction_displacement(runs: DataFrame, pages: DataFrame, least: int = 5) -> DataFrame:
    """(site_id, sharers, needed, median_chars): how far shared opening lines push a page's own text.

    Only the unbroken shared lines at the start of a page count, and only where there are `least` or more; the median is rounded down."""
    shared = shared_lines(runs, pages).select("site_id", "line", F.lit(True).alias("is_shared"))
    rows = runs.join(shared, ["site_id", "line"], "left")
    first = F.min(F.when(F.col("is_shared").isNull(), F.col("line_ord"))).over(Window.partitionBy("site_id", "page_id"))
    rows = rows.withColumn("first_own", first).where("first_own is null or line_ord < first_own")
    per_page = rows.groupBy("site_id", "page_id").agg(F.count("*").alias("skipped"), F.sum(F.length("line") + 1).alias("chars")).where(F.col("skipped") >= least)
    med = exact_median(per_page, "site_id", "chars").select("site_id", F.col("n").alias("sharers"), F.col("median").alias("median_chars"))
    sizes = pages.groupBy("site_id").agg(F.greatest(F.lit(2), F.ceil(F.count_distinct("page_id") / 2)).cast("long").alias("needed"))
    return sizes.join(med, "site_id", "left").select("site_id", F.coalesce("sharers", F.lit(0)).alias("sharers"), "needed", F.coalesce("median_chars", F.lit(0)).alias("median_chars"))


def site_overview(blocks: DataFrame) -> DataFrame:
    """(site_id, pages, blocks, chars, repeated_blocks, repeated_share, rank): how much of a site's text its pages repeat.

    blocks: (site_id, page_id, line). The counts are of distinct lines on a page."""
    once = blocks.groupBy("site_id", "line", "page_id").agg(F.count("*").alias("times"))
    per_line = once.groupBy("site_id", "line").agg(F.count("*").alias("on_pages"), F.sum("times").alias("times"))
    chars = F.col("times") * F.length("line")
    rows = per_line.groupBy("site_id").agg(F.sum("times").alias("blocks"), F.sum(chars).alias("chars"), F.count_if(F.col("on_pages") > 1).alias("repeated_blocks"), F.coalesce(F.sum(F.when(F.col("on_pages") > 1, chars)), F.lit(0)).alias("repeated_chars"))
    pages = blocks.groupBy("site_id").agg(F.count_distinct("page_id").alias("pages"))
    rows = rows.join(pages, "site_id").withColumn("repeated_share", F.round(F.col("repeated_chars") / F.greatest(F.col("chars"), F.lit(1)), 4))
    rows = rows.select("site_id", "pages", "blocks", "chars", "repeated_blocks", "repeated_share")
    # instead of sorting all sites in one task, count the sites of every share (four decimals leave 10001 of them) and, within it, of
    # every beginning of a name, and sum what comes before
    share, head = F.col("repeated_share"), F.substring("site_id", 1, 3)
    earlier = lambda key, order: F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = rows.groupBy(share.alias("share"), head.alias("head")).agg(F.count("*").alias("n"))
    shares = heads.groupBy("share").agg(F.sum("n").alias("n")).select("share", earlier(F.lit(0), F.desc("share")).alias("before"))
    places = heads.select("share", "head", earlier("share", "head").alias("inside")).join(shares, "share")
    ranked = rows.join(places, (share == F.col("share")) & (head == F.col("head")))
    turn = F.row_number().over(Window.partitionBy("share", "head").orderBy("site_id"))
    return ranked.select("site_id", "pages", "blocks", "chars", "repeated_blocks", "repeated_share", (F.col("before") + F.col("inside") + turn).cast("int").alias("rank"))


def heading_runs(headings: DataFrame, keep: int = 6) -> DataFrame:
    """(page_id, ord, level, text, id): runs of more than keep + 1 headings of one level become their first `keep` and a marker.

    headings: (page_id, ord, level, text, id)."""
    page = Window.partitionBy("page_id").orderBy("ord")
    rows = headings.withColumn("run", F.sum(F.coalesce((F.lag("level").over(page) != F.col("level")).cast("int"), F.lit(0))).over(page))
    run = Window.partitionBy("page_id", "run")
    rows = rows.withColumn("turn", F.row_number().over(run.orderBy("ord"))).withColumn("size", F.count("*").over(run))
    rows = rows.withColumn("with_id", F.sum(((F.col("turn") > keep) & (T.text_of(F.col("id")) != "")).cast("int")).over(run))
    long_run = F.col("size") > keep + 1
    kept = rows.where(~long_run | (F.col("turn") <= keep + 1))
    mark = long_run & (F.col("turn") == keep + 1)
    text = F.format_string("[+%d more h%d siblings, %d with an id]", F.col("size") - keep, "level", "with_id")
    return kept.select("page_id", F.row_number().over(page).alias("ord"), "level", F.when(mark, text).otherwise(F.col("text")).alias("text"), F.when(~mark, F.col("id")).alias("id"))


def _greedy(items: Column, start: Column, budget: int, most: int) -> Column:
    """(spent, kept) of the items, taken in their order, that fit the budget, at most `most`; what does not fit is passed over."""
    state = F.struct(start.cast("long").alias("spent"), F.filter(items, lambda x: F.lit(False)).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["kept"]) < most) & (acc["spent"] + x["chars"] <= budget)
        return F.when(fits, F.struct((acc["spent"] + x["chars"]).alias("spent"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)

    return F.aggregate(items, state, step)


def _by_page(items: Column, start: Column, budget: int) -> Column:
    """The items, in their order, that fit the budget; the first of a page that does not ends that page."""
    state = F.struct(start.cast("long").alias("spent"), F.lit(-1).cast("long").alias("ended"), F.filter(items, lambda x: F.lit(False)).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct((acc["spent"] + x["chars"]).alias("spent"), acc["ended"].alias("ended"), F.array_append(acc["kept"], x).alias("kept"))
        full = F.struct(acc["spent"].alias("spent"), x["page_ord"].cast("long").alias("ended"), acc["kept"].alias("kept"))
        return F.when(acc["ended"] == x["page_ord"], acc).when(acc["spent"] + x["chars"] <= budget, taken).otherwise(full)

    return F.aggregate(items, state, step)["kept"]


def anchorable_runs(blocks: DataFrame, per_page: int = 10, least: int = 12, longest: int = 600, budget: int = 9000, most_shared: int = 14) -> DataFrame:
    """(site_id, page_id, text, chars, pages, ord): runs that a quotation can be cut from, under one budget of characters a site.

    Runs on several pages come first, once, with page_id null: by pages and length, those that still fit a third of the budget, up
    to most_shared. Then each page's own runs, rarest and longest first, until one does not fit; a later page may still have one that
    does. blocks: (site_id, page_id, page_ord, block_ord, text). Equal ranks go by text, on a page by place.

    A budget is spent in order, but only a bounded part of a site can take from it. Of shared runs of one length only the first
    most_shared can be taken. Of pages whose first run is of one length all are taken from until the budget is gone, so only the first
    budget / least of them can count. The rest is cut before a site's lengths, not its texts, are brought together."""
    folded = blocks.withColumn("text", T.fold(F.col("text"))).withColumn("chars", F.length("text").cast("long")).where(F.col("chars").between(least, longest))
    on = folded.groupBy("site_id", "text", "chars").agg(F.count_distinct("page_id").alias("pages"))
    alike = F.row_number().over(Window.partitionBy("site_id", "chars").orderBy(F.desc("pages"), "text"))
    shared = on.where("pages > 1").withColumn("alike", alike).where(F.col("alike") <= most_shared)
    items = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("rarity"), (-F.col("chars")).alias("brevity"), "text", "chars", "pages")))
    shared = shared.groupBy("site_id").agg(items.alias("items")).select("site_id", _greedy(F.col("items"), F.lit(0), budget // 3, most_shared).alias("taken"))
    told = shared.select("site_id", F.posexplode("taken.kept").alias("i", "x")).select("site_id", F.col("x.text").alias("text"), F.col("x.chars").alias("chars"), F.col("x.pages").alias("pages"), (F.col("i") + 1).cast("long").alias("ord"))

    own = folded.groupBy("site_id", "page_ord", "text", "chars").agg(F.min("page_id").alias("page_id"), F.min("block_ord").alias("place"))
    own = own.join(told.select("site_id", "text"), ["site_id", "text"], "left_anti").join(on.select("site_id", "text", "pages"), ["site_id", "text"])
    page = Window.partitionBy("site_id", "page_ord").orderBy("pages", F.desc("chars"), "place")
    own = own.withColumn("turn", F.row_number().over(page)).withColumn("head", F.first("chars").over(page)).where(F.col("turn") <= per_page)
    heads = own.where("turn = 1").withColumn("alike", F.row_number().over(Window.partitionBy("site_id", "head").orderBy("page_ord"))).where(F.col("alike") <= budget // least)
    able = own.join(heads.select("site_id", "page_ord"), ["site_id", "page_ord"], "left_semi")
    lines = able.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("page_ord", "turn", "chars"))).alias("lines"))
    spent, before = F.coalesce("taken.spent", F.lit(0)), F.coalesce(F.size("taken.kept"), F.lit(0))
    lines = lines.join(shared, "site_id", "left").select("site_id", before.alias("before"), F.posexplode(_by_page(F.col("lines"), spent, budget)).alias("i", "x"))
    chosen = lines.select("site_id", F.col("x.page_ord").alias("page_ord"), F.col("x.turn").alias("turn"), (F.col("before") + F.col("i") + 1).cast("long").alias("ord"))
    rows = able.join(chosen, ["site_id", "page_ord", "turn"]).select("site_id", F.col("page_id").cast("long").alias("page_id"), "text", "chars", "pages", "ord")
    return told.select("site_id", F.lit(None).cast("long").alias("page_id"), "text", "chars", "pages", "ord").unionByName(rows)


def running_total(rows: DataFrame, key: str, order: str, value: Column, stretch: int = 4096) -> DataFrame:
    """rows and `before`, the sum of value over the key's rows of a smaller order, a whole number; null for the first.

    Stretches of the order are summed first, so that a key with very many rows is spread over as many tasks as it has stretches, and
    only their sums come together."""
    cells = rows.withColumn("__stretch", F.floor(F.col(order) / stretch)).withColumn("__amount", value)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy(F.col(key).alias("__key"), F.col("__stretch").alias("__at")).agg(F.sum("__amount").alias("__total"))
    sums = sums.select("__key", "__at", F.sum("__total").over(earlier(Window.partitionBy("__key").orderBy("__at"))).alias("__skipped"))
    met = cells.join(sums, F.col(key).eqNullSafe(F.col("__key")) & F.col("__stretch").eqNullSafe(F.col("__at")))
    inside = F.sum("__amount").over(earlier(Window.partitionBy(key, "__stretch").orderBy(order)))
    zero = F.lit(0)
    before = F.when(F.col("__skipped").isNotNull() | inside.isNotNull(), F.coalesce("__skipped", zero) + F.coalesce(inside, zero))
    return met.select(*rows.columns, before.alias("before"))


def shared_preamble(openings: DataFrame, least_pages: int = 4, least_chars: int = 400) -> DataFrame:
    """(site_id, preamble, pages): the longest opening of a site's longest text that half of its pages or more share; openings: (site_id, page_id, text).

    Of texts that are equally long the one of the least page_id counts. Only lengths are grouped by site, not texts."""
    rows = openings.select("site_id", "page_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("size", F.length("text"))
    sites = rows.groupBy(F.col("site_id").alias("site")).agg(F.count("*").alias("n"), F.max("size").alias("most"))
    same = F.col("site_id").eqNullSafe(F.col("site"))
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "text"))
    longest = rows.join(sites, same & (F.col("size") == F.col("most"))).groupBy("site", "n", "most").agg(first["text"].alias("longest"))

    def grown(shared: Column, step: Column) -> Column:
        k = shared + step
        fits = (k <= F.col("size")) & F.startswith(F.col("text"), F.substring(F.col("longest"), F.lit(1), k))
        return F.when(fits, k).otherwise(shared)

    # sharing falls as the opening grows, so halving steps find its end; a text has fewer than 2^31 characters
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(31))])
    shared = rows.join(longest, same).select("site", F.aggregate(steps, F.lit(0), grown).alias("chars")).groupBy("site", "chars").agg(F.count("*").alias("held"))
    longer = Window.partitionBy("site").orderBy(F.desc("chars"))
    shared = shared.withColumn("pages", F.sum("held").over(longer)).withColumnRenamed("site", "site_id")
    ends = shared.join(longest.select("site", "n"), same).where("2 * pages >= n").groupBy("site_id").agg(F.max(F.struct("chars", "pages")).alias("end"))
    enough = (F.col("n") >= least_pages) & (F.col("end.chars") >= least_chars)
    found = F.when(enough, F.substring(F.col("longest"), F.lit(1), F.col("end.chars")))
    return ends.join(longest, same).select("site_id", found.alias("preamble"), F.when(enough, F.col("end.pages")).otherwise(F.lit(0).cast("long")).alias("pages"))


def _rivals(names: DataFrame) -> DataFrame:
    """(site_id, ord, edge): names that share an edge fit one another; names: (site_id, ord, tokens), distinct token sets of a site.

    Names that share a telling token fit, so a token is an edge of all names that have it. Otherwise one set must hold the other, and
    the smaller has no telling token: each such set is an edge of itself and of the sets that hold it, which are met by its tokens."""
    telling = names.select("site_id", "ord", F.explode(T.significant(F.col("tokens"))).alias("token")).select("site_id", "ord", F.concat(F.lit("t:"), "token").alias("edge"))
    holders = names.select("site_id", "ord", "tokens", F.explode("tokens").alias("token"))
    faint = names.where(F.size(T.significant(F.col("tokens"))) == 0).select("site_id", F.col("ord").alias("small"), F.col("tokens").alias("inner"), F.explode("tokens").alias("token"))
    held_by = faint.select("site_id", "token").distinct().join(holders, ["site_id", "token"]).groupBy("site_id", "token").agg(F.count("*").alias("sets"))
    rarest = faint.join(held_by, ["site_id", "token"]).groupBy("site_id", "small", "inner").agg(F.min_by("token", F.struct("sets", "token")).alias("token"))
    held = rarest.join(holders, ["site_id", "token"]).where(F.size(F.array_except("inner", "tokens")) == 0)
    pairs = held.where("small <> ord").select("site_id", "ord", "small")
    # an edge for each pair: two sets that hold a third do not fit for that
    edge = F.concat(F.lit("s:"), F.col("small").cast("string"), F.lit(":"), F.col("ord").cast("string"))
    return telling.unionByName(pairs.select("site_id", "ord", edge.alias("edge"))).unionByName(pairs.select("site_id", F.col("small").alias("ord"), edge.alias("edge")))


def name_groups(names: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(site_id, grp, ord, surface, value): variants of a name, each in the first group that it fits; names: (site_id, ord, surface, value).

    A group keeps the tokens of its first member, so order decides: founders are the names that fit no earlier founder. They are found
    in rounds. A name that is the first of its undecided rivals is a founder; names that fit a founder are not; the others wait. A
    round counts edges and compares no pairs, and every round settles the first name of each site at least. Names without telling tokens
    are left out; names of one site have distinct ords."""
    rows = names.withColumn("tokens", T.name_tokens(F.col("value"))).where(F.size("tokens") > 0).withColumn("set", F.array_sort("tokens"))
    # sets that are equal fit wherever one of them does
    sets = computed(rows.groupBy("site_id", "set").agg(F.min("ord").alias("ord")))
    edges = computed(_rivals(sets.select("site_id", "ord", F.col("set").alias("tokens"))))
    alone = sets.select("site_id", "ord").join(edges.select("site_id", "ord").distinct(), ["site_id", "ord"], "left_anti")
    founders, waiting = [alone], edges
    for _ in range(most_rounds):
        first = waiting.groupBy("site_id", "edge").agg(F.min("ord").alias("first"))
        met = waiting.join(first, ["site_id", "edge"])
        found = computed(met.groupBy("site_id", "ord").agg(F.every(F.col("ord") == F.col("first")).alias("leads")).where("leads").select("site_id", "ord"))
        founders.append(found)
        taken = waiting.join(found, ["site_id", "ord"], "left_semi").select("site_id", "edge").distinct()
        settled = waiting.join(taken, ["site_id", "edge"], "left_semi").select("site_id", "ord").distinct()
        waiting = computed(waiting.join(settled, ["site_id", "ord"], "left_anti"))
        if waiting.isEmpty():
            break
    else:
        raise RuntimeError(f"names did not settle in {most_rounds} rounds")
    founder = founders[0]
    for more in founders[1:]:
        founder = founder.unionByName(more)
    heads = founder.withColumn("grp", F.row_number().over(Window.partitionBy("site_id").orderBy("ord")).cast("long"))
    of_edge = edges.join(heads, ["site_id", "ord"]).groupBy("site_id", "edge").agg(F.min("grp").alias("grp"))
    fits = edges.join(of_edge, ["site_id", "edge"]).select("site_id", "ord", "grp").unionByName(heads.select("site_id", "ord", "grp"))
    # a founder shares edges with later founders of none; its own group is the first
    chosen = fits.groupBy("site_id", "ord").agg(F.min("grp").alias("grp"))
    by_set = sets.join(chosen, ["site_id", "ord"]).select("site_id", "set", "grp")
    return rows.join(by_set, ["site_id", "set"]).select("site_id", "grp", "ord", "surface", "value")


# What announces a legal name, what marks one, and words that follow it but are no part of it.
FOOTER = r"(?s)(?:(?i:copyright|©|\(c\)|&copy;)).{0,120}?((?:[A-Z](?U:[\w&.'\-]*\s?)){1,6}[A-Z](?U:[\w&.'\-]*)\.?)"
LEGAL_MARK = r"(?i)©|copyright|\binc\b|\bltd\b|\bllc\b|\bgmbh\b|\blimited\b|\bcorp(?:oration)?\b|\bvof\b|\bsl\b"
FOOTER_NOISE = ("all", "rights", "reserved", "legal", "statements", "privacy", "terms", "notice", "the")


def footer_name(raw: Column) -> Column:
    """The last legal name that a page's source states after a copyright mark; null without one of three characters or more."""
    html = F.regexp_replace(T.text_of(raw), r"(?is)<script\b.*?</script>", " ")
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(FOOTER), 0).alias("whole"), F.regexp_extract_all(html, F.lit(FOOTER), 1).alias("name"))
    marked = F.filter(both, lambda m: F.concat(m["name"], F.lit(" "), F.substring(m["whole"], 1, 20)).rlike(LEGAL_MARK))
    noise = rf"(?i)(?:(?:^|\s+)(?:{'|'.join(FOOTER_NOISE)})[.,]*)+$"
    names = F.transform(marked, lambda m: F.regexp_replace(F.regexp_replace(F.regexp_replace(m["name"], r"\s+", " "), r"^ | $", ""), noise, ""))
    names = F.transform(names, lambda n: F.regexp_replace(n, "^[ .,]+|[ .,]+$", ""))
    return F.try_element_at(F.filter(names, lambda n: F.length(n) >= 3), F.lit(-1))
