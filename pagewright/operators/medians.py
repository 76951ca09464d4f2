"""Exact medians of whole numbers without bringing a key's values together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import computed

#: Bits of a value that one round tells apart: no more than 2 ** DIGIT counts of a key come together.
DIGIT = 12


def exact_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median, least, most): the median of a key's whole numbers, rounded down between the two middle ones; nulls do not count.

    By distributed selection: equal values are counted first, map side and over all tasks. Then, from the topmost bits on, the counts
    of the values' beginnings tell in which beginning the middle ranks fall, and only values with that beginning go on. A null key is a
    key of its own; a key without values has no row."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))
    counts = computed(counts)
    low, high = counts.agg(F.min("value"), F.max("value")).first()
    width = 0 if low is None else (high - low).bit_length()
    # unsigned bits in the order of the values: what they are above the least, or, over the whole range, with the sign turned
    turned = width > 62
    counts = counts.withColumn("bits", F.col("value").bitwiseXOR(F.lit(-(1 << 63))) if turned else F.col("value") - F.lit(low or 0))
    sizes = counts.groupBy("key").agg(F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    # where a middle rank is looked for: behind `skipped` values, among those that begin with `start`
    open_ = sizes.select("key", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("skipped"))
    above = 64
    for shift in range((max(width, 1) - 1) // DIGIT * DIGIT, -1, -DIGIT):
        starts = open_.select(F.col("key").alias("o_key"), F.col("start").alias("o_start")).distinct()
        begins = F.lit(0).cast("long") if above == 64 else F.shiftrightunsigned("bits", above)
        inside = counts.join(starts, F.col("key").eqNullSafe(F.col("o_key")) & (begins == F.col("o_start")), "left_semi")
        digits = inside.groupBy("key", begins.alias("start"), F.shiftrightunsigned("bits", shift).alias("next")).agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("key", "start").orderBy("next")) - F.col("n")
        digits = digits.select(F.col("key").alias("d_key"), F.col("start").alias("d_start"), "next", "n", before.alias("before"))
        met = open_.join(digits, F.col("key").eqNullSafe(F.col("d_key")) & (F.col("start") == F.col("d_start")))
        met = met.where("rank - skipped > before and rank - skipped <= before + n")
        open_ = met.select("key", "rank", F.col("next").alias("start"), (F.col("skipped") + F.col("before")).alias("skipped"))
        above = shift
    middle = F.col("start").bitwiseXOR(F.lit(-(1 << 63))) if turned else F.col("start") + F.lit(low or 0)
    # halves first, as the sum of two large numbers is none
    mean = F.shiftright(F.min("m"), 1) + F.shiftright(F.max("m"), 1) + F.min("m").bitwiseAND(F.lit(1)).bitwiseAND(F.max("m").bitwiseAND(F.lit(1)))
    found = open_.select(F.col("key").alias("m_key"), middle.alias("m")).groupBy("m_key").agg(mean.alias("median"))
    return sizes.join(found, F.col("key").eqNullSafe(F.col("m_key"))).select(F.col("key").alias(key), "n", "median", "least", "most")
