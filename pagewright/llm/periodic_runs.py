"""Periodic runs: stretches of words that repeat with some period, at least four times over.

A run of period p holds words equal to the word p further on for a stretch of at least three periods, so that stretch covers one of
the grid points 0, 3p, 6p, ... of its document. The grids of all periods hold about n ln(n) / 3 pairs of a period and a point. For
all of them at once the longest common extensions, forward and backward from a point and the word a period on, are found by binary
search over prefix hashes; equal stretches of several points and of multiples of a period are one run; and each run's words are
compared as they are. Hashes only ever make an extension too long, and then that comparison fails: the texts are done again with
another base, so results do not rest on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import free_names, in_arrow, let, quoted, words_of
from .words import Words, slices, split_words

#: A run has this many periods, and this many words, at least.
LEAST_EXPONENT = 4
LEAST_WORDS = 6
#: Pairs of a period and a grid point that are looked at together, which bounds a worker's memory.
PAIRS = 1 << 19
#: A Mersenne prime; products of two remainders fit 64 bits.
PRIME = np.uint64((1 << 31) - 1)
RUNS = "array<struct<start:long,length:long,period:long>>"


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo PRIME, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, np.uint64(base)
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step % PRIME
        have, step = have + more, step * step % PRIME
    return out


class Prefixes:
    """Sums of codes[j] * base ** j over prefixes: stretches are equal where their sums are, once the earlier one is moved up."""

    def __init__(self, codes: np.ndarray, rng: np.random.Generator):
        self.codes = codes
        self.power = powers(int(rng.integers(1 << 20, int(PRIME) - 1)), len(codes) + 1)
        names = rng.integers(1, int(PRIME), int(codes.max(initial=0)) + 1).astype(np.uint64)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        # a sum of 2 ** 33 remainders below 2 ** 31 fits 64 bits
        np.cumsum(names[codes] * self.power[: len(codes)] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def alike(self, at: np.ndarray, period: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from at hash as the n words from at + period."""
        one = (self.sums[at + n] + PRIME - self.sums[at]) % PRIME * self.power[period] % PRIME
        return one == (self.sums[at + period + n] + PRIME - self.sums[at + period]) % PRIME

    def extension(self, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Per pair the most words, up to most, that are alike onward from the two points, or up to them if back."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            ok = self.alike(at[open_] - mid if back else at[open_], period[open_], mid)
            low[open_[ok]] = mid[ok]
            high[open_[~ok]] = mid[~ok] - 1


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts[i] rows of each i: i, and the row's number among them."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def pairs(begins: np.ndarray, ends: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, grid point) in flat positions, at most about PAIRS together; a period has one point a (exponent - 1) periods."""
    periods = (ends - begins) // exponent
    at = 0
    while at < len(periods):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(periods[at:]), PAIRS, "right")) + at)
        doc, number = spread(periods[at:upto])
        doc, period, at = doc + at, number + 1, upto
        points = -(-(ends[doc] - begins[doc] - period) // ((exponent - 1) * period))
        sums, first = np.cumsum(points), 0
        while first < len(points):
            last = max(first + 1, int(np.searchsorted(sums, sums[first] - points[first] + PAIRS, "right")))
            owner, number = spread(points[first:last])
            owner += first
            yield doc[owner], period[owner], begins[doc[owner]] + number * (exponent - 1) * period[owner]
            first = last


def distinct_runs(doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal stretches once, with the least of their periods: a stretch that has two such periods has the least as a divisor of both."""
    order = np.lexsort((period, length, start))
    doc, start, length, period = doc[order], start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return doc[new], start[new], length[new], period[new]


def confirmed(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bool:
    """Whether all words of all runs are those a period on, and no neighbour's is."""
    stop = start + length
    left, right = start > begins[doc], stop < ends[doc]
    if np.any(codes[start[left] - 1] == codes[start[left] - 1 + period[left]]) or np.any(codes[stop[right]] == codes[stop[right] - period[right]]):
        return False
    sums, first = np.cumsum(length - period), 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(sums, sums[first] - (length - period)[first] + PAIRS, "right")))
        owner, number = spread((length - period)[first:last])
        at = start[first:last][owner] + number
        if np.any(codes[at] != codes[at + period[first:last][owner]]):
            return False
        first = last
    return True


def runs(words: Words, exponent: int = LEAST_EXPONENT, least: int = LEAST_WORDS, seed: int = 1) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs, in flat positions, by document and start; ties by length."""
    begins, ends, codes = words.offsets[:-1], words.offsets[1:], words.codes
    while True:
        prefix = Prefixes(codes, np.random.default_rng(seed))
        found = [tuple(np.zeros(0, np.int64) for _ in range(4))]
        for doc, period, at in pairs(begins, ends, exponent):
            hit = codes[at] == codes[at + period]
            doc, period, at = doc[hit], period[hit], at[hit]
            ahead = prefix.extension(at, period, ends[doc] - at - period)
            behind = prefix.extension(at, period, at - begins[doc], back=True)
            length = ahead + behind + period
            long = length >= np.maximum(least, exponent * period)
            found.append(distinct_runs(doc[long], (at - behind)[long], length[long], period[long]))
        out = distinct_runs(*[np.concatenate(c) for c in zip(*found, strict=True)])
        if confirmed(codes, begins, ends, *out):
            return out
        seed += 1


def collapsed(words: Words, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    """The texts without the words that a run repeats: all of its words after its first period."""
    edge = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    keep = np.cumsum(edge[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(keep)])[words.offsets]
    kept = words.uniq.cast(pa.large_string()).take(pa.array(words.codes[keep]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept), pa.scalar(" ", pa.large_string())).cast(pa.string())


def periodic_runs(docs: DataFrame, columns: list[str], exponent: int = LEAST_EXPONENT, least: int = LEAST_WORDS, runs_name: str = "runs", text_name: str = "collapsed") -> DataFrame:
    """The columns of docs by name, `runs` (start, length, period of every run of the text, in words, by start and period) and
    `collapsed` (the text's words without those that a run repeats, joined by one space).

    A run has a smallest period p, at least `exponent` periods (2 or more) and `least` words, and no neighbouring word extends it.
    Null, empty and wordless texts have no runs and collapse to an empty text; rows that repeat are treated alike; a text of any
    length is taken whole; an empty table gives an empty result. Give other names where docs has such columns."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    schema = StructType([*(docs.schema[c] for c in columns), *StructType.fromDDL(f"{runs_name} {RUNS}, {text_name} string")])
    text = free_names(columns, "text")["text"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words = split_words(part.column(text))
                doc, start, length, period = found = runs(words, exponent, least)
                order = np.lexsort((period, start))
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
                fields = [pa.array((start - words.offsets[doc])[order]), pa.array(length[order]), pa.array(period[order])]
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], listed, collapsed(words, *found)], names=schema.names)

    return docs.select(*quoted(columns), F.col("text").alias(text)).transform(in_arrow, emit, schema)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): for one id in ten, by crc32, the words from some point on repeat a stretch of three to ten times; all others as they are.

    Rows with a null id or no words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(words, F.lit(1), a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p))), " "))

    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), let(words_of(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """A row for each of periodic_runs(): the number of runs, the longest, and digests of all runs and of the collapsed text."""
    # the longest first, then the least start, then the least period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
