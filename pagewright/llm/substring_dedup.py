"""Substring dedup by prefix-partitioned suffix trees.

A suffix of the corpus begins at every word. Suffixes that agree on their first `window` words lie below one internal node, of that
depth or more, of the corpus's suffix tree; these deep nodes are what repeats, and starts that follow one another make up a maximal
repeat. The tree is built in parts. A part holds the suffixes whose window has the same anchor: the least hash among the prefixes of
8 words that begin inside it. Equal windows have equal anchors, so no deep node is split, and an anchor serves a run of consecutive
suffixes, whose words are sent once for the run.

Prefixes have the length that it takes. The words of all runs of an anchor are counted; anchors met once hold no repeat and are
dropped; those whose parts fit a task's memory are done; the windows of the others are dealt anew by the longer prefix of 16 words,
and what is still too much (a long passage of very many documents) by all words of the window, where a part is a single node and
its count alone decides. A part's subtree is built level by level: its suffixes are dealt to the nodes of a depth by the nodes that
their pieces have at the depth before, comparing words exactly, until the depth of the window. Nodes there with two suffixes or more
are the deep internal ones. What returns to the documents is word intervals.

Anchors, and whole windows of the last length, are compared by 64-bit hashes, words within a part by 48-bit hashes of each word.

Defined cases: null and empty texts have no words, no repeats and the digest of the empty string; texts shorter than the window
lose nothing; repeated rows repeat each other; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, laid_down
from .words import Words, give_back, mix, slices, split_words

WINDOW = 35
#: Lengths of an anchor, in words; at last the whole window.
PREFIXES = (8, 16)
#: Words of a part that a task builds a subtree of.
PART_WORDS = 1 << 18
#: Bitmaps of 4096 bytes in the filter of documents with a part that was too large.
BITMAPS = 256
#: Bytes of a word's hash within a part.
WORD_BYTES = 6


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbours, by prefix sums: a constant number of operations whatever n is."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    base, size = 0x9E3779B97F4A7C15, len(values)
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        power = np.cumprod(np.append(one, np.full(size - 1, base, np.uint64)), dtype=np.uint64)
        inverse = np.cumprod(np.append(one, np.full(size - n, pow(base, -1, 1 << 64), np.uint64)), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power, dtype=np.uint64)])
        return mix((sums[n:] - sums[:-n]) * inverse)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours, by doubling."""
    done = 1
    while done * 2 <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def stretches(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the runs that begin where breaks is set; the first item always begins one."""
    starts = np.flatnonzero(breaks)
    return starts, np.append(starts[1:], len(breaks))


def anchors_of(values: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """The anchor of the window at each word; the last ones of a text are the caller's matter."""
    return sliding_least(window_hashes(values, prefix), window - prefix + 1) if len(values) >= window else np.zeros(0, np.uint64)


def anchor_runs(words: Words, values: np.ndarray, window: int, prefix: int, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, first word, windows, times) of the runs of windows with one anchor; times is 2 if its prefix stands in the run
    twice or more. inside flags the windows that count, all of them by default."""
    anchors, owner = anchors_of(values, window, prefix), words.owner()
    n = len(anchors)
    ok = owner[:n] == owner[window - 1 :] if n else np.zeros(0, bool)
    at = np.flatnonzero(ok if inside is None else ok & inside[:n])
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    a, d = anchors[at], owner[at]
    starts, stops = stretches(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (at[1:] != at[:-1] + 1)]))
    # a prefix is an anchor if the largest anchor of all windows over it is its own hash
    reach = window - prefix + 1
    hashes = window_hashes(values, prefix)
    rim = np.zeros(reach - 1, np.uint64)
    most = ~sliding_least(~np.concatenate([rim, anchors, rim]), reach)[: len(hashes)]
    place = np.flatnonzero(most == hashes)
    near = (hashes[place][1:] == hashes[place][:-1]) & (place[1:] - place[:-1] <= reach)
    again = np.concatenate([[0], np.cumsum(near)])
    first, last = np.searchsorted(place, at[starts]), np.searchsorted(place, at[stops - 1] + reach)
    times = np.where(again[np.maximum(last - 1, 0)] - again[np.minimum(first, len(again) - 1)] > 0, 2, 1)
    return a[starts], d[starts], at[starts] - words.offsets[d[starts]], stops - starts, times


def flags(spans: list[tuple[int, int]], size: int) -> np.ndarray:
    """True for the positions inside (begin, end) of any span of absolute positions."""
    edge = np.zeros(size + 1, np.int64)
    for begin, end in spans:
        edge[begin] += 1
        edge[end] -= 1
    return np.cumsum(edge)[:size] > 0


def deep_nodes(codes: np.ndarray, starts: np.ndarray, parts: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix lies below a node of that depth, or more, with another one of its part.

    codes: words; starts: where the suffixes begin, each followed by `depth` words; parts: the part of each. A level's nodes are
    numbered in the order of their words; as many pieces as fit one number are put together for the next level."""
    level, rank = 1, np.unique(codes, return_inverse=True)[1].astype(np.uint64)
    while level < depth:
        bits = max(1, int(rank.max()).bit_length())
        pieces = min(max(2, 63 // bits), -(-depth // level))
        offsets = [min(k * level, depth - level) for k in range(pieces)] if pieces * level >= depth else [k * level for k in range(pieces)]
        grown = offsets[-1] + level
        n = len(codes) - grown + 1
        joined = rank[:n].copy()
        for k, at in enumerate(offsets[1:], 1):
            if bits * (k + 1) > 63:
                raise ValueError("too many words in a part")
            joined = (joined << np.uint64(bits)) | rank[at : at + n]
        rank, level = np.unique(joined, return_inverse=True)[1].astype(np.uint64), grown
    node = (parts.astype(np.uint64) << np.uint64(max(1, int(rank.max()).bit_length()))) | rank[starts]
    _, own, size = np.unique(node, return_inverse=True, return_counts=True)
    return size[own] > 1


def intervals(doc: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first word, end) of the merged windows; some stay apart, which does no harm."""
    order = np.lexsort((place, doc))
    d, p = doc[order], place[order]
    if not len(d):
        return d.astype(np.int64), p.astype(np.int32), p.astype(np.int32)
    starts, stops = stretches(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + window)]))
    return d[starts].astype(np.int64), p[starts].astype(np.int32), (p[stops - 1] + window).astype(np.int32)


RUNS = "anchor long, doc long, start int, size int, times int"
SPANS = "array<struct<start:int,size:int,prefix:int>>"


def _spans(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, size, prefix) of all spans of a batch."""
    lists = part.column("spans")
    ends = lists.offsets.to_numpy().astype(np.int64)
    cells = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    return (np.repeat(np.arange(part.num_rows), np.diff(ends)), *(cells.field(c).to_numpy().astype(np.int64) for c in ("start", "size", "prefix")))


def runs_of(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(anchor, doc, start, size, times) of the runs of docs: (doc, text), and spans if only their windows count."""
    limited = "spans" in docs.columns

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, keys, inside = split_words(part.column("text")), part.column("doc").to_numpy(), None
                values = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
                if limited:
                    row, start, size, _ = _spans(part)
                    begin = words.offsets[:-1][row] + start
                    inside = flags(list(zip(begin.tolist(), (begin + size).tolist(), strict=True)), len(values))
                anchor, text, start, size, times = anchor_runs(words, values, window, prefix, inside)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(keys[text]), *(pa.array(x.astype(np.int32)) for x in (start, size, times))], names=["anchor", "doc", "start", "size", "times"])

    return docs.transform(in_arrow, emit, RUNS)


def parts_of(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc, start, words) of the spans of docs: (doc, text, spans); words holds those of all windows of a span."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, keys = split_words(part.column("text")), part.column("doc").to_numpy()
                values = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
                row, start, size, prefix = _spans(part)
                begin, length = words.offsets[:-1][row] + start, size + window - 1
                anchor = np.zeros(len(row), np.uint64)
                for n in np.unique(prefix).tolist():
                    some = prefix == n
                    anchor[some] = anchors_of(values, window, n)[begin[some]]
                ends = np.concatenate([[0], np.cumsum(length)])
                place = np.arange(ends[-1]) - np.repeat(ends[:-1], length) + np.repeat(begin, length)
                cells = np.ascontiguousarray(values[place].view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])
                sent = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((ends * WORD_BYTES).astype(np.int32).tobytes()), pa.py_buffer(cells.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(keys[row]), pa.array(start.astype(np.int32)), sent], names=["anchor", "doc", "start", "words"])

    return docs.transform(in_arrow, emit, "anchor long, doc long, start int, words binary")


def subtrees(parts: DataFrame, window: int) -> DataFrame:
    """(doc, start, stop): the intervals below deep nodes of every part; parts: (anchor, doc, start, words)."""

    def built(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        if not table.num_rows:
            return
        anchor, doc, start = (table.column(c).to_numpy() for c in ("anchor", "doc", "start"))
        column = table.column("words").chunk(0)
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        cells = np.zeros(((ends[-1] - ends[0]) // WORD_BYTES, 8), np.uint8)
        cells[:, :WORD_BYTES] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, WORD_BYTES)
        ends = (ends - ends[0]) // WORD_BYTES
        windows = np.diff(ends) - window + 1
        row = np.repeat(np.arange(len(windows)), windows)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        part = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
        deep = deep_nodes(cells.reshape(-1).view(np.uint64), ends[row] + turn, part[row], window)
        d, a, b = intervals(doc[row[deep]], start[row[deep]].astype(np.int64) + turn[deep], window)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], names=["doc", "start", "stop"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            last = int(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))[-1])
            if last or (open_rows and open_rows[-1].column("anchor")[-1].as_py() != anchor[0]):
                yield from built([*open_rows, batch.slice(0, last)])
                open_rows = [batch.slice(last)]
            else:
                open_rows.append(batch)
        if open_rows:
            yield from built(open_rows)
        give_back()

    return parts.repartition("anchor").sortWithinPartitions("anchor").transform(in_arrow, emit, "doc long, start int, stop int")


def likely(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc is among those of found, and a few others: a filter of 1 MB at most, whatever found holds, so that
    texts without a span are not sent to the join that decides. With very many found it lets all pass."""
    bits = BITMAPS * 32768
    at = lambda doc: F.pmod(doc, F.lit(bits))
    maps = found.select(at(F.col("doc")).alias("at")).groupBy(F.expr("cast(at div 32768 as int)").alias("map")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bitmap"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.expr(f"cast(pmod(doc, {bits}) % 32768 div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    held = F.expr(f"cast(pmod(doc, {bits}) % 8 as int)")
    rows = docs.withColumn("map_of", (F.floor(at(F.col("doc")) / 32768)).cast("int"))
    rows = rows.join(F.broadcast(maps), F.col("map_of") == F.col("map")).where(F.call_function("getbit", byte.cast("long"), held) == 1)
    return rows.select(*docs.columns)


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that have spans, and these; found: (doc, start, size, prefix)."""
    spans = found.groupBy(F.col("doc").alias("found_doc")).agg(F.collect_set(F.struct("start", "size", "prefix")).alias("spans"))
    # a merge join at every size: texts are laid out by doc once, for this and for the join that ends the query
    return docs.join(spans.hint("merge"), F.col("doc") == F.col("found_doc")).drop("found_doc")


def repeats(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES, part_words: int = PART_WORDS) -> DataFrame:
    """(doc, start, stop): intervals of words, covering all that repeats; docs: (doc long, text), and what else they hold."""
    todo, fitting, told = docs, None, None
    for prefix in (*(p for p in prefixes if p < window), window):
        runs = runs_of(todo.select("doc", "text", *[c for c in todo.columns if c == "spans"]), window, prefix)
        parts = runs.groupBy(F.col("anchor").alias("part")).agg(F.sum("times").alias("times"), F.sum(F.col("size") + window - 1).alias("words")).where("times > 1")
        found = runs.join(parts, F.col("anchor") == F.col("part")).select("doc", "start", "size", F.lit(prefix).alias("prefix"), (F.col("words") > part_words).alias("large"))
        if prefix == window:  # every part is one node
            told = found.select("doc", "start", (F.col("start") + F.col("size") + window - 1).alias("stop"))
            break
        found = laid_down(found)
        fits = found.where("not large").drop("large")
        fitting = fits if fitting is None else fitting.unionAll(fits)
        large = found.where("large")
        if large.isEmpty():
            break
        todo = with_spans(likely(docs, large), large)
    out = subtrees(parts_of(with_spans(docs, fitting), window), window) if fitting is not None else None
    return out if told is None else told if out is None else out.unionAll(told)


def kept_mask(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the words outside all spans."""
    edge = np.zeros(n + 1, np.int64)
    for start, stop in spans:
        edge[start] += 1
        edge[stop] -= 1
    return np.cumsum(edge)[:n] == 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept words if with_text; `how` goes to repeats()."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.xxhash64("doc_id", "text"))
    spans = repeats(rows, window, **how).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnRenamed("doc", "span_doc")
    joined = rows.join(spans.hint("merge"), F.col("doc") == F.col("span_doc"), "left").drop("span_doc")
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    schema = schema.add("kept_text", "string") if with_text else schema

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"))
                uniq, found, texts = words.uniq.to_pylist(), [], []
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    own = words.codes[words.offsets[i] : words.offsets[i + 1]]
                    keep = own[kept_mask(len(own), [(s["start"], s["stop"]) for s in spans])] if spans else own
                    text = " ".join([uniq[c] for c in keep.tolist()])
                    found.append((len(own), len(own) - len(keep), hashlib.sha256(text.encode()).hexdigest()))
                    if with_text:
                        texts.append(text)
                cells = list(zip(*found, strict=True)) or [()] * 3
                columns = [part.column("doc_id"), pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())] if with_text else columns, names=schema.names)

    return joined.transform(in_arrow, emit, schema)
