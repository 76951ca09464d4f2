"""Toxicity by a factorization machine over hashed terms.

Terms are words and word prefixes, lower-cased and stripped of punctuation, hashed to 2**18 buckets. A bounded labelled sample
picks the buckets that tell the labels apart; a second-order factorization machine over those learns a weight for each and,
by the inner products of their factors, for each pair. It is trained on the driver, from the sample only, and is a few hundred
kilobytes; every document is scored in Arrow batches without a shuffle.

Defined cases: a null or empty text has no terms and scores the model's bias; repeated rows score alike; without any usable
label, or with labels of one kind only, every score is the share of label 1 (0 without labels); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, in_arrow, label_of, labelled_sample, quoted
from .words import Words, slices, split_words

BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7)
#: Counts from which a bucket is a further term.
LEVELS = (2, 3, 5)
#: Buckets, their levels, and a class for each power of two of words.
SPACE = BUCKETS * (len(LEVELS) + 2)
STRIP = ".,;:!?\"'()[]{}#*$%&|<>-_~`"
#: Ids that are never learnt from.
HELD_OUT = (3, 1)


def word_terms(word: str) -> list[int]:
    """Buckets of a word and its prefixes; -1 fills the places that it has not."""
    word = word.strip(STRIP).lower()
    if not word:
        return [-1] * (len(PREFIXES) + 1)
    terms = ["w:" + word, *("p:" + word[:n] if len(word) >= n else None for n in PREFIXES)]
    return [-1 if t is None else xxhash.xxh3_64_intdigest(t) % BUCKETS for t in terms]


def term_table(words: Words) -> np.ndarray:
    return np.array([word_terms(w) for w in words.uniq.to_pylist()], np.int32).reshape(-1, len(PREFIXES) + 1)


def document_terms(words: Words, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs, sorted. A term is a bucket, a bucket that occurs LEVELS times or more, or a length class.

    chosen flags the buckets worth counting; words with none of them are passed over."""
    table, n = term_table(words), len(words.offsets) - 1
    if chosen is not None:
        table = np.where((table >= 0) & chosen[table], table, -1)
    used = (table >= 0).any(axis=1)
    at = np.flatnonzero(used[words.codes]) if len(words.codes) else np.zeros(0, np.int64)
    docs, flat = np.repeat(words.owner()[at], table.shape[1]), table[words.codes[at]].ravel()
    pairs, times = np.unique(docs[flat >= 0].astype(np.int64) * SPACE + flat[flat >= 0], return_counts=True)
    lengths = np.arange(n) * SPACE + BUCKETS * (len(LEVELS) + 1) + np.log2(words.counts + 1).astype(np.int64)
    found = np.sort(np.concatenate([pairs, *(pairs[times >= c] + BUCKETS * (k + 1) for k, c in enumerate(LEVELS)), lengths]))
    return found // SPACE, found % SPACE


@dataclass
class Machine:
    """score = sigmoid(bias + sum w + sum over pairs of <v_i, v_j>) over a document's distinct terms."""

    lookup: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float

    def margins(self, docs: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(docs, self.w[terms], n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[terms, f]
            pairs += np.bincount(docs, x, n) ** 2 - np.bincount(docs, x * x, n)
        return self.bias + linear + pairs / 2

    def score(self, words: Words) -> np.ndarray:
        docs, terms = document_terms(words, self.chosen)
        terms = self.lookup[terms]
        return sigmoid(self.margins(docs[terms >= 0], terms[terms >= 0], len(words.offsets) - 1))

    @cached_property
    def chosen(self) -> np.ndarray:
        return (self.lookup[: BUCKETS * (len(LEVELS) + 1)].reshape(-1, BUCKETS) >= 0).any(axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(terms: np.ndarray, sizes: np.ndarray, y: np.ndarray, chosen: list[int], factors: int = 6, epochs: int = 25, rate: float = 0.15, decay: float = 1e-4, lean: float = 1.5, seed: int = 7) -> Machine:
    """Adagrad over mini-batches of the sample: the chosen terms of its documents, one after another, how many each has, and its label.
    Label 1 weighs `lean` times as much."""
    lookup = np.full(SPACE, -1, np.int32)
    lookup[chosen] = np.arange(len(chosen))
    rng = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.0
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), factors))
    if not len(chosen) or share in (0.0, 1.0):
        flat = np.clip(share, 1e-9, 1 - 1e-9)
        return Machine(lookup, w, v * 0, float(np.log(flat / (1 - flat))))
    bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
    starts = np.concatenate([[0], np.cumsum(sizes)])
    terms = lookup[terms]
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // 256)):
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in part]) if len(part) else np.zeros(0, np.int64)
            docs, t = np.repeat(np.arange(len(part)), sizes[part]), terms[at]
            sums = np.zeros((len(part), factors))
            np.add.at(sums, docs, v[t])
            squares = np.zeros((len(part), factors))
            np.add.at(squares, docs, v[t] ** 2)
            m = bias + np.bincount(docs, w[t], len(part)) + (sums**2 - squares).sum(1) / 2
            g = (sigmoid(m) - y[part]) * np.where(y[part] > 0.5, lean, 1.0) / len(part)
            dw = np.bincount(t, g[docs], len(w)) + decay * w * (w != 0)
            dv = np.zeros_like(v)
            np.add.at(dv, t, g[docs, None] * (sums[docs] - v[t]))
            dv += decay * v
            db = g.sum()
            gw += dw**2
            gv += dv**2
            gb += db**2
            w -= rate * dw / np.sqrt(gw)
            v -= rate / 4 * dv / np.sqrt(gv)
            bias -= rate * db / np.sqrt(gb)
    return Machine(lookup, w, v, bias)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample_rows: int = 20000, terms: int = 1000, least_docs: int = 5, least_lift: float = 5.0, skip: tuple[int, int] = HELD_OUT) -> Machine:
    """Learn from at most sample_rows labelled documents, from none whose id's crc32 is held out.

    Of the terms that at least least_docs of them hold, those count whose share of label 1 is off by least_lift or more, in squared
    standard deviations; others add noise, most where labels are few. cross_validated() chooses the lift."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owner, found = document_terms(split_words(part.column("text")))
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("label"), lists], names=["label", "terms"])

    sample = cut(labelled_sample(docs, label_of(labels, column, *skip), sample_rows).transform(in_arrow, emit, "label double, terms array<int>"))
    total, ones = sample.agg(F.count("*"), F.sum("label")).first()
    if not total:
        return fit(*[np.zeros(0)] * 3, [])
    by_term = sample.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    share = ones / total
    # squared distance from the expected count in standard deviations, with a prior of one document
    lift = F.pow(F.col("k") - share * F.col("n"), 2) / (F.col("n") * share * (1 - share) + 1)
    chosen = [r[0] for r in by_term.where((F.col("n") >= least_docs) & (lift >= least_lift)).orderBy(lift.desc(), "term").limit(terms).select("term").collect()]
    picked = F.array(*map(F.lit, sorted(chosen))) if chosen else F.array().cast("array<int>")
    # at most sample_rows rows, put in order here: the fit must not depend on the order in which tasks end
    own = F.array_intersect("terms", picked)
    rows = sample.select(F.xxhash64(own, "label").alias("key"), own.alias("terms"), "label").toArrow().combine_chunks()
    rows = rows.take(np.argsort(rows.column("key").to_numpy(), kind="stable"))
    lists = rows.column("terms").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return fit(lists.flatten().to_numpy(), sizes, rows.column("label").to_numpy(), chosen)


def score_column(docs: DataFrame, machine: Machine, columns: list[str], name: str = "score") -> DataFrame:
    """The columns and the score of every row; columns hold text."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    schema = docs.select(*quoted(columns)).schema.add(name, "double")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = model.value.score(split_words(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*columns, name])

    return docs.select(*quoted(columns)).transform(in_arrow, emit, schema)


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.7, **how) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    got = score_column(docs.select("doc_id", "text"), train(docs, labels, **how), ["doc_id", "text"])
    return got.select("doc_id", held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def cross_validated(docs: DataFrame, labels: DataFrame, lifts: tuple[float, ...], folds: int = 3, least: float = 0.7, **how) -> list[tuple[float, int, int]]:
    """(least_lift, toxic documents found, clean ones flagged) of each lift, over the rows that may be learnt from only.

    Every such row is scored once, by a machine that has not learnt from its fold; held-out rows are neither learnt from nor scored."""
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(1)), F.lit(folds))
    known = label_of(labels, "toxic", *HELD_OUT).where(F.col("label").isin(0.0, 1.0)).select("doc_id", F.col("label").cast("int").alias("toxic"), fold.alias("fold"))
    known = cut(known)
    out = []
    for lift in lifts:
        found = flagged = 0
        for k in range(folds):
            machine = train(docs, known.where(F.col("fold") != k), least_lift=lift, **how)
            ids = known.where(F.col("fold") == k).select(F.col("doc_id").alias("k_id"), "toxic")
            rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("k_id"))
            got = score_column(rows, machine, ["toxic", "text"]).where(F.col("score") >= least).agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
            found, flagged = found + got[0], flagged + got[1]
        out.append((lift, found, flagged))
    return out
