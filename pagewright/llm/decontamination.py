"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages. Their TF-IDF matrix, with document frequencies counted over the whole corpus, is cut into
parts of at most `rank` passages, and each part gets a randomised SVD of its own, whose products are summed from distributed
partial products: the latent space of a part holds its passages whole, so products in it are those of the full matrix. Every
document is folded in as overlapping windows over its whole text. Windows that hold a high enough share of a passage's weight are
candidates, and the longest common subsequence of words decides: nearly verbatim passages are leaks; looser ones only when the
latent cosine is high enough and the passage's answer terms, its rarest, are there too. Only the index of
a block of at most about `block_passages` passages is gathered and sent to the executors, however long items are; a larger benchmark
is taken in blocks, each of which reads the corpus. Documents are neither shuffled nor collected.

Defined cases: null and empty texts hold no leak, null and empty items leak nowhere, items of under `least_words` words leak
where all their words stand in a row, as verbatim with a cosine of 1; repeated rows are reported alike; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, laid_down, quoted
from .words import Words, rolling, slices, split_words

STRIP = ".,;:!?\"'()[]{}#*$%&|<>-_~`"


@dataclass(frozen=True)
class Settings:
    passage: int = 40
    window: int = 64
    stride: int = 16
    least_words: int = 8
    rank: int = 256
    extra: int = 8
    cosine: float = 0.25
    cover: float = 0.4
    verbatim: float = 0.75
    paraphrase: float = 0.5
    answers: int = 6
    answer_share: float = 0.6
    block_passages: int = 1024


@dataclass
class Part:
    place: np.ndarray  # the row in latent of each of the index's terms
    latent: np.ndarray  # a row for each term of the part: its idf times its latent coordinates; the last row is 0, for other words
    bound: np.ndarray  # most that one word of each of the index's terms adds to the product with any passage
    passages: np.ndarray  # latent coordinates
    norms: np.ndarray
    words: list[np.ndarray]
    items: list[int]
    answers: list[np.ndarray]
    masks: list[dict[int, int]] = field(default_factory=list)


@dataclass
class Index:
    terms: dict[str, int]
    parts: list[Part]
    short: dict[tuple[int, ...], list[int]]  # items of under least_words words, by their codes


def folded(words: Words) -> list[str]:
    return [w.strip(STRIP).lower() for w in words.uniq.to_pylist()]


def term_codes(words: Words, terms: dict[str, int]) -> np.ndarray:
    """A term's place for every word; len(terms) for words that are no term, -1 for words of punctuation only."""
    other = len(terms)
    table = np.array([terms.get(w, other) if w else -1 for w in folded(words)], np.int64)
    return table[words.codes] if len(words.codes) else np.zeros(0, np.int64)


def cut_passages(codes: np.ndarray, most: int) -> list[np.ndarray]:
    parts = max(1, math.ceil(len(codes) / most))
    return np.array_split(codes, parts)


def common_length(masks: dict[int, int], size: int, window: np.ndarray) -> int:
    """Longest common subsequence by bit vectors; masks: the places of each code in the passage."""
    full = (1 << size) - 1
    row = full
    for c in window.tolist():
        m = masks.get(c)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def document_frequency(docs: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and documents, over the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value)
        held, rows = np.zeros(n + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"))
                codes, owner = term_codes(words, shared.value), words.owner()
                ok = (codes >= 0) & (codes < n)
                pairs = np.unique(owner[ok] * (n + 1) + codes[ok])
                held += np.bincount(pairs % (n + 1), minlength=n + 1)
                rows += part.num_rows
        held[n] = rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])

    got = docs.select("text").transform(in_arrow, emit, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms) + 1, np.int64)
    for r in got:
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def randomised_svd(rows: DataFrame, n_terms: int, idf: np.ndarray, rank: int, extra: int, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors, as columns, of the TF-IDF matrix with a row for each array<long> `codes`.

    Each round multiplies a tall thin matrix by A'A: every task returns its own partial product, and the driver adds them."""
    width = min(n_terms, rank + extra)
    sc = rows.sparkSession.sparkContext

    def times(q: np.ndarray) -> np.ndarray:
        shared = sc.broadcast((idf, q))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, right = shared.value
            total = np.zeros_like(right)
            for batch in batches:
                for codes in batch.column("codes").to_pylist():
                    c, tf = np.unique(np.array(codes, np.int64), return_counts=True)
                    a = tf * weight[c]
                    total[c] += np.outer(a, a @ right[c])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        out = np.zeros_like(q)
        for r in rows.transform(in_arrow, emit, "part binary").toLocalIterator():
            out += np.frombuffer(r["part"]).reshape(q.shape)
        return out

    q = np.random.default_rng(seed).normal(size=(n_terms, width))
    for _ in range(2):
        q, _ = np.linalg.qr(times(q))
    small = q.T @ times(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-30)]
    return q @ vectors[:, keep]


def benchmark_passages(benchmark: DataFrame, s: Settings) -> DataFrame:
    """(item_id, seq, words) of all passages; an item of under least_words words is one row of seq -1."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"))
                names, rows = folded(words), []
                for i, item in enumerate(part.column("item_id").to_pylist()):
                    own = [names[c] for c in words.codes[words.offsets[i] : words.offsets[i + 1]].tolist() if names[c]]
                    if len(own) >= s.least_words:
                        rows += [(item, k, [own[j] for j in at]) for k, at in enumerate(cut_passages(np.arange(len(own)), s.passage))]
                    elif own:
                        rows.append((item, -1, own))
                cells = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int32()), pa.array(cells[2], pa.list_(pa.string()))], names=["item_id", "seq", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    return laid_down(items.transform(in_arrow, emit, "item_id long, seq int, words array<string>"))


def build_index(docs: DataFrame, passages: DataFrame, s: Settings) -> Index | None:
    """The index of one block of passages: (item_id, seq, words)."""
    rows = passages.orderBy("item_id", "seq", "words").collect()
    terms = {w: i for i, w in enumerate(sorted({w for r in rows for w in r["words"]}))}
    cut_up, owners, short = [], [], {}
    for r in rows:
        codes = np.array([terms[w] for w in r["words"]], np.int64)
        if r["seq"] < 0:
            short.setdefault(tuple(codes.tolist()), []).append(r["item_id"])
        else:
            cut_up.append(codes)
            owners.append(r["item_id"])
    if not cut_up:
        return Index(terms, [], short) if short else None
    held, total = document_frequency(docs, terms)
    idf = np.log((total + 1) / (held + 1)) + 0.05
    n_parts = math.ceil(len(cut_up) / s.rank)
    return Index(terms, [build_part(docs, [cut_up[k] for k in at], [owners[k] for k in at], idf, s) for at in np.array_split(np.arange(len(cut_up)), n_parts)], short)


def build_part(docs: DataFrame, cut_up: list[np.ndarray], owners: list[int], idf: np.ndarray, s: Settings) -> Part:
    own = np.unique(np.concatenate(cut_up))
    place = np.full(len(idf) + 1, len(own))
    place[own] = np.arange(len(own))
    frame = docs.sparkSession.createDataFrame([(place[p].tolist(),) for p in cut_up], "codes array<long>").repartition(max(1, min(8, len(cut_up) // 64)))
    v = randomised_svd(frame, len(own), idf[own], len(cut_up), s.extra)
    latent = np.concatenate([idf[own][:, None] * v, np.zeros((1, v.shape[1]))]).astype(np.float32)
    most = np.zeros(len(idf) + 1)
    passages, answers, masks = [], [], []
    for p in cut_up:
        c, tf = np.unique(p, return_counts=True)
        np.maximum.at(most, c, tf)
        passages.append((tf[:, None] * latent[place[c]]).sum(0))
        answers.append(c[np.lexsort((c, -idf[c]))][: s.answers])
        at: dict[int, int] = {}
        for k, x in enumerate(p.tolist()):
            at[x] = at.get(x, 0) | 1 << k
        masks.append(at)
    matrix = np.array(passages, np.float32)
    bound = most * np.concatenate([idf**2, [0]])
    return Part(place, latent, bound, matrix, np.linalg.norm(matrix, axis=1), cut_up, owners, answers, masks)


def short_items(index: Index, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, words, first word) of every item of under least_words words whose words stand in a row."""
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    for n in {len(words) for words in index.short}:
        if len(codes) < n:
            continue
        wanted = np.array([words for words in index.short if len(words) == n], np.int64)
        hashed = rolling(codes.astype(np.uint64), n)
        like = np.unique(np.concatenate([rolling(words.astype(np.uint64), n) for words in wanted]))
        at = np.flatnonzero(np.isin(hashed, like) & (owner[: len(hashed)] == owner[n - 1 :]))
        for i in at.tolist():
            for item in index.short.get(tuple(codes[i : i + n].tolist()), ()):
                yield int(owner[i]), item, n, i - int(ends[owner[i]])


def search(index: Index, words: Words, s: Settings) -> list[tuple[int, int, str, int, int, float, int]]:
    """(text, item, kind, common words, passage words, cosine, first word of the window) of the best window for each text and item."""
    codes, offsets = term_codes(words, index.terms), words.offsets
    real = codes >= 0
    ends = np.concatenate([[0], np.cumsum(real)])[offsets]
    codes = codes[real]
    counts = np.diff(ends)
    # a text's words in chunks of a stride; a window is some consecutive chunks, and the last one ends where the text does
    chunks = -(-counts // s.stride)
    at_chunk = np.concatenate([[0], np.cumsum(chunks)])
    owner = np.repeat(np.arange(len(counts)), chunks)
    start = ends[owner] + (np.arange(at_chunk[-1]) - at_chunk[owner]) * s.stride
    grid = start[:, None] + np.arange(s.stride)
    other = len(index.terms)
    grid = np.where(grid < ends[owner + 1][:, None], np.append(codes, other)[np.minimum(grid, len(codes))], other)
    n_windows = np.where(counts == 0, 0, np.maximum(0, -(-(counts - s.window) // s.stride)) + 1)
    who = np.repeat(np.arange(len(counts)), n_windows)
    chunk = at_chunk[who] + np.arange(len(who)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    first = start[chunk] if len(chunk) else chunk
    last = np.minimum(first + s.window, ends[who + 1])
    best: dict[tuple[int, int], tuple] = {}
    for part in index.parts:
        mass = np.concatenate([[0], np.cumsum(part.bound[codes])])
        # no window below this can reach the cover that is asked for
        hopeful = np.flatnonzero(mass[last] - mass[first] >= s.cover * float((part.norms**2).min()) * 0.999)
        if not len(hopeful):
            continue
        rows = part.place[grid]
        sums = np.zeros((len(grid) + 1, part.latent.shape[1]), np.float32)
        for at in range(0, len(grid), 4096):
            block = sums[at : min(at + 4096, len(grid))]
            for k in range(s.stride):
                block += part.latent[rows[at : at + 4096, k]]
        for at in range(0, len(hopeful), 4096):
            some = hopeful[at : at + 4096]
            x = sums[chunk[some]]
            for k in range(1, s.window // s.stride):
                there = chunk[some] + k
                x = x + sums[np.where(there < at_chunk[who[some] + 1], there, len(grid))]
            products = x @ part.passages.T
            norm = np.maximum(np.linalg.norm(x, axis=1), 1e-9)
            for i, j in zip(*np.nonzero(products >= s.cover * part.norms**2), strict=True):
                w = int(some[i])
                window = codes[first[w] : last[w]]
                size = len(part.words[j])
                length = common_length(part.masks[j], size, window)
                cosine = float(products[i, j] / norm[i] / max(part.norms[j], 1e-9))
                kind = ""
                if length >= s.verbatim * size:
                    kind = "verbatim"
                elif length >= s.paraphrase * size and cosine >= s.cosine and np.isin(part.answers[j], window).mean() >= s.answer_share:
                    kind = "paraphrase"
                if kind:
                    key, row = (int(who[w]), part.items[j]), (length / size, kind, length, size, cosine, int(first[w] - ends[who[w]]))
                    if key not in best or row > best[key]:
                        best[key] = row
    for d, item, size, start in short_items(index, codes, ends):
        key, row = (d, item), (1.0, "verbatim", size, size, 1.0, start)
        if key not in best or row > best[key]:
            best[key] = row
    return [(d, item, kind, length, size, cos, start) for (d, item), (_, kind, length, size, cos, start) in best.items()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, kind, common_words, passage_words, cosine, start_word: a row for each document and item that it leaks."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    made = (("item_id", "long"), ("kind", "string"), ("common_words", "integer"), ("passage_words", "integer"), ("cosine", "double"), ("start_word", "long"))
    schema = rows.select("doc_id", "text_key").schema
    for name, kind in made:
        schema = schema.add(name, kind)
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
    out = []
    for block, passages in enumerate(passage_blocks(benchmark, settings)):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(docs, passages, settings))

        def emit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    found = sorted(search(shared.value, split_words(part.column("text")), settings), key=lambda x: (x[0], str(x[1]))) if shared.value is not None else []
                    at = pa.array([f[0] for f in found], pa.int64())
                    cells = [pa.array([f[k + 1] for f in found], t) for k, t in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("text_key").take(at), *cells], names=schema.names)

        out.append(rows.transform(in_arrow, emit, schema).withColumn("block", F.lit(block)))
    columns = [name for name, _ in made]
    if len(out) == 1:
        return out[0].select("doc_id", *columns)
    # an item's passages may lie in several blocks: the best of them counts, once for each repeated row
    best = F.struct((F.col("common_words") / F.col("passage_words")).alias("share"), *columns[1:])
    keys = ["doc_id", "text_key", "item_id"]
    each = reduce(DataFrame.unionAll, out).groupBy(*keys, "block").agg(F.max(best).alias("best"), F.count("*").alias("times"))
    merged = each.groupBy(*keys).agg(F.max("best").alias("best"), F.max("times").alias("times")).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return merged.select("doc_id", "item_id", *[F.col(f"best.{c}").alias(c) for c in columns[1:]])


def passage_blocks(benchmark: DataFrame, settings: Settings) -> list[DataFrame]:
    passages = benchmark_passages(benchmark, settings)
    blocks = max(1, math.ceil(passages.count() / settings.block_passages))
    return [passages.where(F.pmod(F.xxhash64("item_id", "seq", "words"), F.lit(blocks)) == b) for b in range(blocks)]


def clean(docs: DataFrame, benchmark: DataFrame, columns: list[str], settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that leak no item, with the given columns, decided where they stand: no join, no shuffle."""
    schema = docs.select(*quoted(columns)).schema
    out = docs.select(*quoted(columns))
    for passages in passage_blocks(benchmark, settings):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(docs, passages, settings))

        def emit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(part.num_rows, bool)
                    if shared.value is not None:
                        keep[[f[0] for f in search(shared.value, split_words(part.column("text")), settings)]] = False
                    yield part.filter(pa.array(keep))

        out = out.transform(in_arrow, emit, schema)
    return out
