"""N-gram Jaccard self-join by universe partition.

A document is the set of its distinct n-word shingles. Sets are grouped by size band; a band meets itself and the next smaller
one. If two sets of a band's group are similar enough, their symmetric difference is at most H, so of H + 1 + E segments, into
which a hash deals the universe of shingles, the sets agree on E + 1 or more. Each set is indexed by its segments:

* segments that cost most get no index entry. Empty ones are shared by much of the band; hot ones turn out to be. The E segments
  of slack pay for them: a set may leave out up to E.
* a set with more empty segments than slack adds, over a prefix of the segments, their one-deletion neighbourhoods, each of
  which is worth two segments, until the sum is right again; this happens to both sets of any pair that needs it.

Sets that meet in a segment are paired in a star with its least one, first within a task, then over all; every pair is verified on
the whole sets. What a failed pair leaves open is settled exactly, in one pass. Hot buckets drop the members whose slack allows it.
Open buckets, those whose members lie in more than one component, make up groups by their least set, the centre. A task reads a
group (large ones are dealt to several) and compares parity sketches: a sketch has a bit for each of some 16 H hash classes, the
parity of the set's shingles there, so two sets differ in at least as many shingles as their sketches in bits. Members without a
possible partner of another component leave. For the others the difference from the centre is computed, once for a group, and the
group is read again: two members differ in just those shingles in which their differences from the centre differ, so every pair
of two components is verified exactly without its whole sets, and those that join components are the missing links.

Shingles are compared by 64-bit hashes, sets are named by a 64-bit hash of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free_names, in_arrow, laid_down, quoted, release
from .components import components
from .words import Words, mix, rolling, slices, split_words

MOST_BANDS = 200
#: Members of an open bucket from which it is hot.
HOT = 32
#: Members of a star that one task compares with its centre.
SPOKES = 256
NODES = "node long, n int, spare_own int, spare_next int, sketch binary"
#: Sets that a task compares with a group's members at once.
PIVOTS = 4096


@dataclass(frozen=True)
class Plan:
    """Bands and segments for Jaccard similarity of at least percent / 100."""

    percent: int

    @property
    def starts(self) -> np.ndarray:
        out = [1]
        while out[-1] < 1 << 31 and len(out) < MOST_BANDS:
            out.append(max(out[-1] + 1, math.ceil(out[-1] * (100 / self.percent) ** 2)))
        return np.array(out, np.int64)

    def segments(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segments, slack) of each band's group; 0 segments where only equal sets are similar."""
        most = np.append(starts[1:], 1 << 32) - 1
        differ = (100 - self.percent) * 2 * most // (100 + self.percent)
        empty = (differ + 2) * np.exp(-starts / (differ + 2))
        slack = np.ceil(1 + empty + 2 * np.sqrt(empty)).astype(np.int64)
        return np.where(differ > 0, differ + 1 + slack, 0), slack


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offsets): one set for each text; a text of fewer than n words is one shingle."""
    values = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    grams, offsets = rolling(values, n), words.offsets
    out, ends = [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            s = s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s
        elif b > a:
            s = rolling(np.append(values[a:b], np.uint64(b - a)), b - a + 1)
        else:
            s = grams[:0]
        out.append(s)
        ends.append(ends[-1] + len(s))
    return np.concatenate(out) if out else grams[:0], np.array(ends, np.int64)


def set_names(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each set; of the empty set too."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.uint64(1)), dtype=np.uint64)])
    return mix((sums[ends[1:]] - sums[ends[:-1]]) ^ mix(np.diff(ends).astype(np.uint64))).view(np.int64)


def sketches(tokens: np.ndarray, ends: np.ndarray, plan: Plan) -> list[bytes]:
    """Parity bits of each set, a power of two of them, sixteen for each shingle that two sets of its size may differ in."""
    out = []
    differ = (100 - plan.percent) * 2 * np.diff(ends) // (100 + plan.percent)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        bits = max(64, 1 << (16 * int(differ[i]) - 1).bit_length()) if differ[i] else 64
        odd = np.bincount((tokens[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def least_difference(a: bytes, b: bytes) -> int:
    """Shingles that two sets differ in at least; the longer sketch is folded to the shorter one's classes."""
    x, y = sorted((a, b), key=len)
    folded, bits = 0, len(x) * 8
    value = int.from_bytes(y, "little")
    while value:
        folded ^= value & ((1 << bits) - 1)
        value >>= bits
    return (folded ^ int.from_bytes(x, "little")).bit_count()


def folded_rows(sketch: list[bytes], width: int) -> np.ndarray:
    """All sketches as rows of 64-bit words, folded to that many bytes, the fewest of any."""
    words = width // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, words), axis=0) for s in sketch])


def _label(band: np.ndarray, segment: np.ndarray, content: np.ndarray, kind: int) -> np.ndarray:
    """The bucket: 56 bits of hash over the band."""
    with np.errstate(over="ignore"):
        h = mix(content + mix(band.astype(np.uint64) * np.uint64(1 << 33) + segment.astype(np.uint64) * np.uint64(2) + np.uint64(kind)))
    return ((h << np.uint64(8)) | band.astype(np.uint64)).view(np.int64)


def signatures(tokens: np.ndarray, ends: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, set) of the index entries of all sets, and the slack left to each set in its own and the next band (columns 0, 1)."""
    starts = plan.starts
    segments, slack = plan.segments(starts)
    sizes = np.diff(ends)
    own = np.searchsorted(starts, sizes, "right") - 1
    mixed = mix(tokens)
    buckets, sets, spare = [], [], np.zeros((len(sizes), 2), np.int64)
    for role in (0, 1):
        band = np.minimum(own + role, len(starts) - 1)
        m = np.where(sizes > 0, segments[band], 0)
        if role:  # only sets that are large enough for the next band's least one
            m = np.where(100 * sizes >= plan.percent * starts[band], m, 0)
        use = np.flatnonzero(m)
        if not len(use):
            continue
        base = np.concatenate([[0], np.cumsum(m)])
        owner = np.repeat(np.arange(len(sizes)), np.where(m > 0, sizes, 0))
        pick = np.repeat(m > 0, sizes)
        tok, mx = tokens[pick], mixed[pick]
        seg = ((tok >> np.uint64(32)) * m[owner].astype(np.uint64)) >> np.uint64(32)
        at = base[owner] + seg.astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(total, at, mx)
        filled = np.bincount(at, minlength=base[-1])
        whose = np.repeat(np.arange(len(sizes)), m)
        place = np.arange(base[-1]) - base[whose]
        empty = np.bincount(whose, filled == 0, len(sizes)).astype(np.int64)
        left = slack[band] - empty
        spare[:, role] = np.where(m > 0, np.maximum(left, 0), 0)
        full = filled > 0
        buckets.append(_label(band[whose[full]], place[full], total[full], 0))
        sets.append(whose[full])
        for r in np.flatnonzero((left < 0) & (m > 0)):
            own_filled = filled[base[r] : base[r + 1]] > 0
            worth = np.cumsum(own_filled)  # a prefix of p segments is worth its filled ones
            enough = np.flatnonzero(worth >= -left[r])
            # too empty even for that: its empty segments are indexed as they are
            upto = int(enough[0]) + 1 if len(enough) else int(m[r])
            mine = owner == r
            inside = seg[mine].astype(np.int64)
            chosen = inside < upto
            content = np.concatenate([total[base[r] : base[r] + upto], total[base[r] : base[r] + upto][inside[chosen]] - mx[mine][chosen]])
            where = np.concatenate([np.arange(upto), inside[chosen]])
            if not len(enough):
                bare = np.flatnonzero(~own_filled)
                buckets.append(_label(np.full(len(bare), band[r]), bare, np.zeros(len(bare), np.uint64), 0))
                sets.append(np.full(len(bare), r))
            buckets.append(_label(np.full(len(where), band[r]), where, content, 1))
            sets.append(np.full(len(where), r))
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), spare
    return np.concatenate(buckets), np.concatenate(sets), spare


def stars(bucket: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (bucket, node) without repeats, each one's centre, the bucket's least node, and where a bucket begins."""
    order = np.lexsort((node, bucket))
    b, n = bucket[order], node[order]
    new = np.append(True, (b[1:] != b[:-1]) | (n[1:] != n[:-1])) if len(b) else np.zeros(0, bool)
    b, n = b[new], n[new]
    first = np.append(True, b[1:] != b[:-1]) if len(b) else np.zeros(0, bool)
    return b, n, n[first][np.cumsum(first) - 1] if len(b) else n, first


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def document_sets(docs: DataFrame, shingle: int, plan: Plan) -> DataFrame:
    """(doc_id, node, n, spare_own, spare_next) of every row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, ends = shingle_sets(split_words(part.column("text"), lower=True), shingle)
                _, _, spare = signatures(tokens, ends, plan)
                cells = (set_names(tokens, ends), np.diff(ends).astype(np.int32), spare[:, 0].astype(np.int32), spare[:, 1].astype(np.int32), pa.array(sketches(tokens, ends, plan), pa.binary()))
                yield _batch(["doc_id", "node", "n", "spare_own", "spare_next", "sketch"], part.column("doc_id"), *cells)

    return docs.transform(in_arrow, emit, f"doc_id long, {NODES}")


def star_links(docs: DataFrame, shingle: int, plan: Plan) -> DataFrame:
    """(bucket, node, centre), node <> centre: every bucket with two sets or more, as a tree of at most two levels."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            for part in slices(batch):
                tokens, ends = shingle_sets(split_words(part.column("text"), lower=True), shingle)
                names = set_names(tokens, ends)
                bucket, which, _ = signatures(tokens, ends, plan)
                b, n, centre, first = stars(bucket, names[which])
                # one entry of a bucket leaves the slice; the others are linked to it here
                yield _batch(["bucket", "node", "centre"], b, n, pa.array(centre, mask=first))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bucket, open_centre = None, None
        for batch in batches:
            linked = batch.filter(batch.column("centre").is_valid())
            if linked.num_rows:
                yield linked
            rest = batch.filter(batch.column("centre").is_null())
            if not rest.num_rows:
                continue
            b, n, centre, first = stars(rest.column("bucket").to_numpy(), rest.column("node").to_numpy())
            if open_bucket is not None:
                same = b == open_bucket
                centre = np.where(same, open_centre, centre)
            open_bucket, open_centre = int(b[-1]), int(centre[-1])
            link = n != centre
            if link.any():
                yield _batch(["bucket", "node", "centre"], b[link], n[link], centre[link])

    sent = docs.select("doc_id", "text").transform(in_arrow, emit, "bucket long, node long, centre long")
    # what is linked in its slice already goes anywhere, so that of a hot bucket one row a slice meets the others
    place = F.when(F.col("centre").isNull(), F.col("bucket")).otherwise(F.xxhash64("node", "bucket"))
    sent = sent.withColumn("place", place).repartition("place").drop("place")
    return sent.sortWithinPartitions("bucket").transform(in_arrow, meet, "bucket long, node long, centre long")


def set_carriers(docs: DataFrame, known: DataFrame, needed: DataFrame) -> DataFrame:
    """(text) of a document for each of the needed sets, a row for each; known: (doc_id, node)."""
    ids = known.join(needed, F.col("node") == F.col("needed"), "left_semi").groupBy("node").agg(F.min("doc_id").alias("carrier")).select("carrier")
    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("carrier"), "left_semi").select("text")


def possible(pairs: DataFrame, facts: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that size and sketches allow; facts: (node, n, sketch)."""
    side = lambda c: facts.select(F.col("node").alias(f"{c}_"), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    rows = pairs.join(side("a"), F.col("a") == F.col("a_")).join(side("b"), F.col("b") == F.col("b_"))
    rows = rows.where((F.col("n_a") * 100 >= F.col("n_b") * plan.percent) & (F.col("n_b") * 100 >= F.col("n_a") * plan.percent))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            least = [least_difference(x, y) for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True)]
            ok = np.array(least, np.int64) * (100 + plan.percent) <= sums * (100 - plan.percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return rows.select("a", "b", "n_a", "n_b", "s_a", "s_b").transform(in_arrow, emit, "a long, b long")


def grouped_spokes(docs: DataFrame, known: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(hub, salt, role, node, tokens) for pairs (a, b): the set of every b, once for some SPOKES of its partners, and before them by
    its role, and the sets of the partners a. A hub is spread over tasks by its salts."""
    pairs = laid_down(pairs.select("a", "b").distinct())
    hubs = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("salts"))
    spokes = pairs.join(hubs, F.col("b") == F.col("hub")).select(F.col("a").alias("node"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    centres = hubs.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = spokes.unionAll(centres)
    needed = wanted.select(F.col("node").alias("needed")).distinct()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, ends = shingle_sets(split_words(part.column("text"), lower=True), shingle)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield _batch(["set_node", "tokens"], set_names(tokens, ends), lists)

    sets = set_carriers(docs, known, needed).transform(in_arrow, emit, "set_node long, tokens array<long>").join(needed, F.col("set_node") == F.col("needed"), "left_semi")
    rows = wanted.join(sets, F.col("node") == F.col("set_node")).select("hub", "salt", "role", "node", "tokens")
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")


def with_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """(hub, node, hub's set, node's set) of every partner in the rows of grouped_spokes, a list for each batch."""
    key, centre = None, None
    for batch in batches:
        ends = batch.column("tokens").offsets.to_numpy()
        flat = batch.column("tokens").values.to_numpy().view(np.uint64)
        hub, salt, role, node = (batch.column(c).to_numpy() for c in ("hub", "salt", "role", "node"))
        met = []
        for i in range(batch.num_rows):
            tokens = flat[ends[i] : ends[i + 1]]
            if role[i] == 0:
                key, centre = (hub[i], salt[i]), tokens.copy()
            elif key != (hub[i], salt[i]):
                raise RuntimeError("a set to compare with is missing; were the documents changed meanwhile?")
            else:
                met.append((hub[i], node[i], centre, tokens))
        yield met


def found_in(tokens: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Whether each token is in the sorted array."""
    if not len(there):
        return np.zeros(len(tokens), bool)
    return there[np.minimum(np.searchsorted(there, tokens), len(there) - 1)] == tokens


def verified(docs: DataFrame, known: DataFrame, pairs: DataFrame, shingle: int, plan: Plan) -> DataFrame:
    """(a, b, ok) of the pairs (a, b): the whole sets, made from the texts that hold them, are compared."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in with_centre(batches):
            ok = []
            for _, _, centre, tokens in met:
                common = int(found_in(tokens, centre).sum())
                ok.append(100 * common >= plan.percent * (len(centre) + len(tokens) - common))
            yield _batch(["a", "b", "ok"], np.array([m[1] for m in met], np.int64), np.array([m[0] for m in met], np.int64), pa.array(ok, pa.bool_()))

    return cut(grouped_spokes(docs, known, pairs, shingle).transform(in_arrow, compare, "a long, b long, ok boolean").distinct())


def differences(docs: DataFrame, known: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(b, a, delta) of the pairs (a, b): the shingles that just one of the two sets has, sorted."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in with_centre(batches):
            deltas = [np.sort(np.concatenate([tokens[~found_in(tokens, centre)], centre[~found_in(centre, tokens)]])) for _, _, centre, tokens in met]
            ends = np.cumsum([0, *map(len, deltas)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(deltas) if deltas else np.zeros(0, np.uint64)).view(np.int64)))
            yield _batch(["b", "a", "delta"], np.array([m[0] for m in met], np.int64), np.array([m[1] for m in met], np.int64), lists)

    return grouped_spokes(docs, known, pairs, shingle).transform(in_arrow, compare, "b long, a long, delta array<long>").dropDuplicates(["a", "b"])


def dealt(groups: DataFrame, width: str = "0") -> DataFrame:
    """(centre, salt, other, width) and the rest of groups (centre, node, comp, ...), sorted by the first three.

    Members of a group's largest component need no comparison with each other. The others are its pivots (other is false), dealt
    by a salt to tasks of about PIVOTS; each of these tasks reads all members, the pivots first. Groups of one component are left out."""
    sizes = groups.groupBy("centre", "comp").agg(F.count("*").alias("size"), F.min(F.expr(width)).alias("width"))
    shape = sizes.groupBy(F.col("centre").alias("c")).agg(F.max(F.struct("size", "comp")).alias("most"), F.sum("size").alias("members"), F.min("width").alias("width"))
    shape = shape.where(F.col("members") > F.col("most.size")).select("c", F.col("most.comp").alias("largest"), "width", F.ceil((F.col("members") - F.col("most.size")) / PIVOTS).cast("int").alias("salts"))
    rows = groups.join(shape, F.col("centre") == F.col("c")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    own = (F.col("comp") != F.col("largest")) & (F.pmod(F.xxhash64("node"), F.col("salts")) == F.col("salt"))
    rows = rows.withColumn("other", ~own).drop("c", "largest", "salts")
    return rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "other", "node")


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """((centre, salt), other, rows) of a batch of dealt()."""
    centre, salt, other = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("centre", "salt", "other"))
    new = np.append(True, (centre[1:] != centre[:-1]) | (salt[1:] != salt[:-1]) | (other[1:] != other[:-1])) if len(centre) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(centre)], strict=True):
        yield (int(centre[a]), int(salt[a])), bool(other[a]), batch.slice(a, b - a)


def undecided(groups: DataFrame, facts: DataFrame, plan: Plan) -> DataFrame:
    """(centre, node) of the members that sizes and sketches allow a partner of another component in their group."""
    rows = dealt(groups.join(facts.select(F.col("node").alias("f"), "n", "sketch"), F.col("node") == F.col("f")).drop("f"), "length(sketch)")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots = None, []
        for batch in batches:
            nodes, centres = [], []
            for at, other, part in stretches(batch):
                if at != key:
                    key, pivots = at, []
                bits = folded_rows(part.column("sketch").to_pylist(), part.column("width")[0].as_py())
                node, comp, n = (part.column(c).to_numpy() for c in ("node", "comp", "n"))
                n = n.astype(np.int64)
                if not other:
                    pivots.append((bits, node, comp, n))
                hit = np.zeros(len(node), bool)
                for p_bits, p_node, p_comp, p_n in pivots:
                    for i in range(len(p_node)):
                        room = (n + p_n[i]) * (100 - plan.percent) - np.bitwise_count(bits ^ p_bits[i]).sum(axis=1).astype(np.int64) * (100 + plan.percent)
                        near = (room >= 0) & (comp != p_comp[i]) & (n * 100 >= p_n[i] * plan.percent) & (p_n[i] * 100 >= n * plan.percent)
                        if near.any():
                            hit |= near
                            nodes.append(p_node[i : i + 1])
                nodes.append(node[hit])
                centres.append((at[0], sum(map(len, nodes))))
            total = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
            ends = np.array([0, *(e for _, e in centres)])
            yield _batch(["centre", "node"], np.repeat(np.array([c for c, _ in centres], np.int64), np.diff(ends)), total.astype(np.int64))

    return rows.select("centre", "salt", "other", "width", "node", "comp", "n", "sketch").transform(in_arrow, emit, "centre long, node long").distinct()


class Pivots:
    """A task's pivots of one group: their differences from the centre, by shingle."""

    def __init__(self):
        self.node, self.comp, self.n, self.sizes, self.tokens = [], [], [], [], []
        self.root: dict[int, int] = {}

    def add(self, node: np.ndarray, comp: np.ndarray, n: np.ndarray, deltas: list[np.ndarray]) -> None:
        for own, new in ((self.node, node), (self.comp, comp), (self.n, n), (self.sizes, [len(d) for d in deltas]), (self.tokens, deltas)):
            own.extend(new)

    def close(self) -> None:
        flat = np.concatenate(self.tokens)
        owner = np.repeat(np.arange(len(self.node)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.token, starts = np.unique(flat[order], return_index=True)
        self.ends, self.owner = np.append(starts, len(flat)), owner[order]
        self.sizes, self.n = np.array(self.sizes, np.int64), np.array(self.n, np.int64)
        self.tokens = []

    def top(self, x: int) -> int:
        while self.root.setdefault(x, x) != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def links(self, node: int, comp: int, n: int, delta: np.ndarray, plan: Plan) -> Iterator[tuple[int, int]]:
        """The pivots that are similar enough and of a component that nothing has joined yet."""
        at = np.flatnonzero(found_in(delta, self.token))
        at = np.searchsorted(self.token, delta[at])
        shared = np.bincount(np.concatenate([self.owner[self.ends[i] : self.ends[i + 1]] for i in at.tolist()]), minlength=len(self.sizes)) if len(at) else 0
        apart, sums = self.sizes + len(delta) - 2 * shared, self.n + n
        for i in np.flatnonzero(sums * (100 - plan.percent) >= apart * (100 + plan.percent)).tolist():
            x, y = self.top(int(self.comp[i])), self.top(comp)
            if x != y:
                self.root[x] = y
                yield int(self.node[i]), node


def settled(groups: DataFrame, plan: Plan) -> DataFrame:
    """(u, v): similar sets that join the components of each group; groups: (centre, node, comp, n, delta), delta the difference
    from the centre. The differences of two members are those of their deltas, so whole sets are not needed here."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots, is_open = None, None, False
        early: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]] = []
        for batch in batches:
            out = []
            for at, other, part in stretches(batch):
                if at != key:
                    if is_open:
                        out += among(pivots, early)
                    key, pivots, early, is_open = at, Pivots(), [], True
                node, comp, n = (part.column(c).to_numpy().astype(np.int64) for c in ("node", "comp", "n"))
                lists = part.column("delta")
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
                deltas = [flat[a:b].copy() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                if not other:
                    pivots.add(node, comp, n, deltas)
                    early.append((node, comp, n, deltas))
                    continue
                if is_open:
                    out += among(pivots, early)
                    early, is_open = [], False
                if pivots.node:
                    for x in zip(node.tolist(), comp.tolist(), n.tolist(), deltas, strict=True):
                        out += pivots.links(*x, plan)
            yield _batch(["u", "v"], np.array([u for u, _ in out], np.int64), np.array([v for _, v in out], np.int64))
        out = among(pivots, early) if is_open else []
        yield _batch(["u", "v"], np.array([u for u, _ in out], np.int64), np.array([v for _, v in out], np.int64))

    def among(pivots: Pivots, early: list) -> list[tuple[int, int]]:
        pivots.close()
        return [pair for rows in early for x in zip(*(c.tolist() for c in rows[:3]), rows[3], strict=True) for pair in pivots.links(*x, plan)]

    return dealt(groups).select("centre", "salt", "other", "node", "comp", "n", "delta").transform(in_arrow, emit, "u long, v long").distinct()


def set_components(docs: DataFrame, nodes: DataFrame, shingle: int, plan: Plan, hot: int | None = None) -> DataFrame:
    """(node, component) of the sets that are linked with any; nodes: the rows of document_sets."""
    hot = hot or HOT
    known = nodes.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    links = laid_down(star_links(docs, shingle, plan))
    release(docs.sparkSession)
    in_buckets = links.select(F.col("node").alias("l")).unionAll(links.select("centre")).distinct()
    met = known.join(in_buckets, F.col("node") == F.col("l"), "left_semi")
    facts = laid_down(met.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "spare_own", "spare_next")]))
    told = links.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    tried = verified(docs, known.select("doc_id", "node"), possible(told, facts.select("node", "n", "sketch"), plan), shingle, plan)
    stars = tried.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))
    member = cut(components(stars))
    release(docs.sparkSession)

    linked = stars.select(F.col("u").alias("la"), F.col("v").alias("lb"))
    broken = links.join(linked, (F.col("node") == F.col("la")) & (F.col("centre") == F.col("lb")), "left_anti").select(F.col("bucket").alias("open")).distinct()
    rows = links.join(broken, F.col("bucket") == F.col("open"), "left_semi")
    rows = open_rows(rows.select("bucket", "node").unionAll(rows.select("bucket", F.col("centre").alias("node"))).distinct(), member)
    # a set may miss as many hot buckets as it has slack; it stays in all of them if they are more
    starts = F.array(*[F.lit(int(s)) for s in plan.starts])
    own_band = F.size(F.filter(starts, lambda s: s <= F.col("n"))) - 1
    spare = F.when(F.col("bucket").bitwiseAND(F.lit(255)) == own_band, F.col("spare_own")).otherwise(F.col("spare_next"))
    rows = rows.join(facts.drop("sketch"), "node").withColumn("band", F.col("bucket").bitwiseAND(F.lit(255))).withColumn("spare", spare)
    hots = rows.where(F.col("members") > hot).groupBy(F.col("node").alias("h"), F.col("band").alias("hb")).agg(F.count("*").alias("hots"))
    rows = rows.join(hots, (F.col("node") == F.col("h")) & (F.col("band") == F.col("hb")), "left")
    rows = rows.where((F.col("members") <= hot) | (F.col("hots") > F.col("spare"))).select("bucket", "node")
    # buckets with the same least set are one group: every pair of a bucket is a pair of its group
    groups = laid_down(open_rows(rows, member).select("centre", "node", "comp").distinct())
    some = laid_down(undecided(groups, facts, plan))
    if some.isEmpty():
        return member
    release(docs.sparkSession)
    apart = differences(docs, known.select("doc_id", "node"), some.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")), shingle)
    apart = apart.select("b", "a", "delta").unionAll(some.where("node = centre").select("centre", "node", F.array().cast("array<long>")))
    held = apart.join(groups, (F.col("b") == F.col("centre")) & (F.col("a") == F.col("node"))).select("centre", "node", "comp", "delta")
    held = held.join(facts.select(F.col("node").alias("f"), "n"), F.col("node") == F.col("f")).drop("f")
    extra = cut(settled(laid_down(held), plan))
    if extra.isEmpty():
        return member
    return cut(components(member.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(extra)))


def open_rows(rows: DataFrame, member: DataFrame) -> DataFrame:
    """(bucket, node, comp, members, centre) of the buckets whose members lie in more than one component; rows: (bucket, node)."""
    now = rows.join(member.select(F.col("node").alias("m"), "component"), F.col("node") == F.col("m"), "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
    open_ = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.min("node").alias("centre")).where("lo <> hi").select(F.col("bucket").alias("b"), "members", "centre")
    return now.join(open_, F.col("bucket") == F.col("b")).drop("b")


def jaccard_join(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).

    Documents with equal non-empty sets are linked; null and empty texts have an empty set and are linked with nothing. Rows with
    a null doc_id take part in no link and have no component. Rows that repeat a doc_id each get a row, of their own text's set and
    component. An empty table gives an empty result; other columns are not read."""
    return classes(docs, shingle, percent).select("doc_id", "n_shingles", "component_id")


def classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, class) of every row; node and class, its set and linked sets, are null where it takes part in no link."""
    plan = Plan(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = laid_down(document_sets(docs, shingle, plan))
    member = set_components(docs, nodes, shingle, plan).select(F.col("node").alias("m"), "component")
    rows = nodes.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    classed = rows.join(member, F.col("node") == F.col("m"), "left").select("doc_id", "n", "node", F.coalesce("component", "node").alias("class"))
    least = classed.where(F.col("class").isNotNull()).groupBy(F.col("class").alias("c")).agg(F.min("doc_id").alias("least"))
    out = classed.join(least, F.col("class") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "node", "class")


def with_node(docs: DataFrame, shingle: int, name: str) -> DataFrame:
    """docs and, under that name, the set of the row's text, null for an empty one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, ends = shingle_sets(split_words(part.column("text"), lower=True), shingle)
                node = pa.array(set_names(tokens, ends), pa.int64(), mask=np.diff(ends) == 0)
                yield pa.RecordBatch.from_arrays([*part.columns, node], names=[*part.schema.names, name])

    return docs.transform(in_arrow, emit, docs.select("*", F.lit(None).cast("long").alias(name)).schema)


def one_of_each(docs: DataFrame, columns: list[str], shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each component does: the one with the least doc_id.

    Rows with a null doc_id cannot be told apart and all stay. Where ids repeat each row goes by its own text: of rows that
    share a doc_id and a component one stays, and of those with no words one for each text. Columns may have any names."""
    own = quoted(columns)
    new = free_names(columns, "gone", "id", "set", "class", "own_set", "turn")
    found = laid_down(classes(docs, shingle, percent))
    release(docs.sparkSession)
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = found.where("component_id < doc_id").select(F.col("doc_id").alias(new["gone"])).distinct()
        return docs.select(*own).join(gone, F.col("doc_id") == F.col(new["gone"]), "left_anti")
    held = found.where("node is not null").select(
        F.col("doc_id").alias(new["id"]), F.col("node").alias(new["set"]), F.col("class").alias(new["class"]), (F.col("component_id") < F.col("doc_id")).alias(new["gone"])
    )
    rows = with_node(docs.select(*own), shingle, new["own_set"])
    rows = rows.join(held.distinct(), (F.col("doc_id") == F.col(new["id"])) & (F.col(new["own_set"]) == F.col(new["set"])), "left")
    wordless = F.when(F.col(new["class"]).isNull(), F.col("text"))
    order = Window.partitionBy("doc_id", new["class"], wordless).orderBy(F.xxhash64("text"), *[F.xxhash64(c) for c in own])
    kept = rows.where(~F.coalesce(new["gone"], F.lit(False))).withColumn(new["turn"], F.row_number().over(order))
    return kept.where((F.col(new["turn"]) == 1) | F.col("doc_id").isNull()).select(*own)
