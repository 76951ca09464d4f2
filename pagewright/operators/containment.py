"""Which texts hold which phrases, by equal keys instead of by comparing every phrase with every text.

Phrases and texts are folded: words stand one space apart. A phrase may begin and end inside a word of the text, but its inner words
stand there whole. So a phrase of seven words or more meets the texts that hold its first five inner words in a row, one of three to
six words those that hold its longest inner word. One of one or two words meets, by the first characters of its longer word, the
words of the corpus's vocabulary that hold this word, and by them their texts. All that meet are verified on the whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, HEAD = 5, 3


def _longest(words: Column) -> Column:
    return F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("size"), w.alias("word"))))["word"]


def _text_keys(text: Column) -> Column:
    """Hashes of a text's words, and of each GRAM of them in a row. The words are bound once, not split anew for every gram."""
    at = lambda words: F.sequence(F.lit(1), F.greatest(F.size(words) - GRAM + 1, F.lit(1)))
    gram = lambda words, i: F.xxhash64(F.lit(GRAM), F.array_join(F.slice(words, i, GRAM), " "))
    keys = lambda words: F.concat(F.transform(at(words), lambda i: gram(words, i)), F.transform(words, lambda w: F.xxhash64(F.lit(1), w)))
    return F.array_distinct(F.transform(F.array(F.split(text, " ")), keys)[0])


def _heads(word: Column) -> Column:
    """All that stands in a word in up to HEAD characters."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))
    return F.array_distinct(F.concat(*[of(n) for n in range(1, HEAD + 1)]))


def contained(phrases: DataFrame, want: str, texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Every row of phrases beside every row of texts whose `text` contains its `want`; both are folded, keys tell texts' rows apart.

    Empty and null phrases are in no text. Rows that repeat stay repeated. No column may be in both tables."""
    key, word, head, piece, one = "__key", "__word", "__head", "__piece", "__want"
    words = F.split(F.col(one), " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    wants = phrases.select(F.col(want).alias(one)).where(F.col(one) != "").distinct()
    gram = F.xxhash64(F.lit(GRAM), F.array_join(F.slice(inner, 1, GRAM), " "))
    long = wants.where(F.size(words) >= 3).withColumn(key, F.when(F.size(inner) >= GRAM, gram).otherwise(F.xxhash64(F.lit(1), _longest(inner))))
    short = wants.where(F.size(words) < 3).withColumn(piece, _longest(words)).withColumn(head, F.substring(piece, 1, HEAD))
    keyed = texts.where(F.col(text).isNotNull()).select(*keys, F.explode(_text_keys(F.col(text))).alias(key))
    vocabulary = texts.select(F.explode(F.array_distinct(F.split(F.col(text), " "))).alias(word)).distinct()
    holding = vocabulary.select(word, F.explode(_heads(F.col(word))).alias(head)).join(short, head).where(F.col(word).contains(F.col(piece)))
    by_key = long.select(key, one).unionAll(holding.select(F.xxhash64(F.lit(1), word).alias(key), one))
    met = keyed.join(by_key, key).select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], one).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)])
    rows = texts.join(met, same).where(F.col(text).contains(F.col(one))).select(*texts.columns, one)
    return rows.join(phrases, F.col(one) == F.col(want)).select(*phrases.columns, *texts.columns)
