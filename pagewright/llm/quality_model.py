"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts in Arrow batches. The trees are grown on the driver from a bounded labelled sample, by
histograms of binned features, and flattened into five arrays; scoring walks all documents of a batch down a tree at once.

Defined cases: a null or empty text has all statistics 0 and gets their score; repeated rows score alike; without any usable
label, or with labels of one kind only, every score is the share of label 1 (0 without labels); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, in_arrow, label_of, labelled_sample
from .words import rolling, slices, split_words

HELD_OUT = (4, 2)
#: Byte classes that are counted: a share of all bytes each.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>@^~=+{}[]\\/_",
    "pipe": b"|",
    "shout": b"!?",
    "stop": b".",
    "comma": b",;:",
    "line": b"\n",
    "space": b" \t\r\x0b\x0c",
}
FEATURES = (*(f"{k}_share" for k in CLASSES), "wide_share", "log_words", "word_bytes", "word_spread", "distinct_share", "echo_share", "repeat_share", "line_words", "line_repeat_share", "long_share")


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    size = np.maximum(np.diff(ends), 1).astype(float)
    table = np.zeros(256, np.uint8)
    for i, chars in enumerate(CLASSES.values(), 1):
        table[list(chars)] = i
    table[0xC0:] = len(CLASSES) + 1  # the first byte of a longer character
    kinds = table[raw]

    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])[at])

    out = [per_text(kinds == i, ends) / size for i in range(1, len(CLASSES) + 2)]
    lines_n = per_text(kinds == list(CLASSES).index("line") + 1, ends) + 1
    words = split_words(texts.cast(pa.string()))
    counts, owner = words.counts, words.owner()
    some = np.maximum(counts, 1).astype(float)
    lengths = pc.binary_length(words.uniq).to_numpy(zero_copy_only=False).astype(float)[words.codes] if len(words.codes) else np.zeros(0)
    mean = per_text(lengths, words.offsets) / some
    spread = np.sqrt(np.maximum(per_text(lengths**2, words.offsets) / some - mean**2, 0))

    def distinct(keys: np.ndarray, who: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, who))
        k, w = keys[order], who[order]
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
        return np.bincount(w[first], minlength=n).astype(float)

    echo = np.zeros(len(words.codes), bool)
    echo[1:] = (words.codes[1:] == words.codes[:-1]) & (owner[1:] == owner[:-1])
    grams = rolling(words.hashes()[words.codes], 4) if len(words.codes) >= 4 else np.zeros(0, np.uint64)
    inside = owner[: len(grams)] == owner[3:] if len(grams) else np.zeros(0, bool)
    whole = np.bincount(owner[: len(grams)][inside], minlength=n) if len(grams) else np.zeros(n)
    again = whole - distinct(grams[inside], owner[: len(grams)][inside]) if len(grams) else np.zeros(n)
    lines = pc.split_pattern(texts.cast(pa.string()), "\n")
    coded = lines.flatten().dictionary_encode()
    at = lines.offsets.to_numpy().astype(np.int64)
    who = np.repeat(np.arange(n), np.diff(at))
    line_again = np.diff(at) - distinct(coded.indices.to_numpy(zero_copy_only=False), who) if len(coded) else np.zeros(n)
    out += [np.log1p(counts), mean, spread, distinct(words.codes, owner) / some, per_text(echo, words.offsets) / some, again / np.maximum(whole, 1), counts / lines_n, line_again / lines_n, per_text(lengths > 20, words.offsets) / some]
    return np.stack(out, axis=1)


@dataclass
class Trees:
    """Nodes of all trees in flat arrays: a row goes left where its feature is at most the limit; leaves point at themselves."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 8.0) -> Trees:
    """Boost depth-limited trees on the logistic loss; a split is scored from gradient histograms of the binned features."""
    share = float(y.mean()) if len(y) else 0.0
    flat = float(np.clip(share, 1e-9, 1 - 1e-9))
    bias = float(np.log(flat / (1 - flat)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "limit", "left", "right", "value")}
    roots: list[int] = []

    def node(value: float = 0.0) -> int:
        i = len(nodes["feature"])
        for k, v in (("feature", 0), ("limit", np.inf), ("left", i), ("right", i), ("value", value)):
            nodes[k].append(v)
        return i

    if len(y) and 0 < share < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            roots.append(node())
            work = [(roots[-1], np.arange(len(y)), 0)]
            while work:
                i, rows, level = work.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-3, -1, 0)
                if level < depth:
                    for j, e in enumerate(edges):
                        if len(e):
                            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
                            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
                            nl = np.cumsum(np.bincount(binned[rows, j], minlength=len(e) + 1))[:-1]
                            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                            gain[(nl < least) | (len(rows) - nl < least)] = 0
                            k = int(gain.argmax())
                            if gain[k] > best[0]:
                                best = (float(gain[k]), j, k)
                if best[1] < 0:
                    nodes["value"][i] = -rate * gs / (hs + ridge)
                    margin[rows] += nodes["value"][i]
                    continue
                _, j, k = best
                goes = binned[rows, j] <= k
                a, b = node(), node()
                nodes["feature"][i], nodes["limit"][i], nodes["left"][i], nodes["right"][i] = j, edges[j][k], a, b
                work += [(a, rows[goes], level + 1), (b, rows[~goes], level + 1)]
    arrays = {k: np.array(v, float if k in ("limit", "value") else np.int32) for k, v in nodes.items()}
    return Trees(np.array(roots, np.int32), depth=depth, bias=bias, **arrays)


def _emit_statistics(names: list[str]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = statistics(part.column("text"))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float64()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], names=[*names, "x"])

    return emit


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", sample_rows: int = 20000, skip: tuple[int, int] = HELD_OUT, **how) -> Trees:
    """Learn from at most sample_rows labelled documents, from none whose id's crc32 is held out."""
    sample = labelled_sample(docs, label_of(labels, column, *skip), sample_rows).select("doc_id", "label", "text")
    rows = cut(sample.transform(in_arrow, _emit_statistics(["doc_id", "label"]), "doc_id long, label double, x array<double>")).toArrow().combine_chunks()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)))
    y, ids = rows.column("label").to_numpy(), rows.column("doc_id").to_numpy()
    # at most sample_rows rows, put in order here: sums must not depend on the order in which tasks end
    order = np.lexsort((*x.T[::-1], ids)) if len(y) else np.zeros(0, np.int64)
    return grow(x[order], y[order], **how)


def quality_model(docs: DataFrame, labels: DataFrame, least: float = 0.7, **how) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = model.value.score(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    got = rows.transform(in_arrow, emit, rows.select("doc_id").schema.add("score", "double"))
    return got.select("doc_id", held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
