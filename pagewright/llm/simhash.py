"""Near duplicates by SimHash fingerprints, linked within a Hamming radius through BK-trees.

Two fingerprints within r bits agree on at least one of r + 1 blocks of bits. Each distinct fingerprint goes to a shard for each of
its blocks, so every link lies within some shard. A shard that is too large is dealt again by blocks of the bits that it has not yet
in common, which loses no link either; one that is still too large after some rounds is cut into slices, and each slice of its
fingerprints is taken through the trees of all of its slices, so no task holds more than two slices.

A shard's BK-tree has its first fingerprint as the root; a node's children are keyed by their distance from it, and a search at
distance d from a node follows only children whose key is within d - r and d + r. All trees of a batch are grown and searched level
by level at once. Where a fingerprint is linked with a node, all that stands below a child within the radius of that node is linked
with the node as well, by its own search, and needs no visit: tight groups cost a few visits each, not all pairs. A shard gives
spanning links only.

The trees are handed to the tasks that search them by the shuffle that deals out the shards, not by broadcast through the driver:
together they hold every fingerprint, which has no bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, laid_down, release
from .components import components
from .words import Words, slices, split_words

BITS = 64
SEED = 42
#: Fingerprints of a shard that a task takes as one tree; larger shards are dealt again, at most DEPTH times, and then sliced.
SHARD = 2048
DEPTH = 3
#: Hashes counted together, and pairs of a fingerprint and a node looked at together: both bound a worker's memory.
HASHES = 1 << 16
VISITS = 1 << 20


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, XXH64) of every run of `size` words joined by a space, repeats included; of shorter texts the whole, of wordless ones none."""
    lengths = pc.binary_length(words.uniq).to_numpy(zero_copy_only=False).astype(np.int64)[words.codes] + 1
    ends = np.concatenate([[0], np.cumsum(lengths)])
    flat = b" ".join(pc.take(words.uniq.cast(pa.binary()), pa.array(words.codes)).to_pylist())
    counts = words.counts
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), made)
    first = np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made) + words.offsets[text]
    last = np.minimum(first + size, words.offsets[text + 1])
    digest = xxhash.xxh64_intdigest
    found = (digest(flat[a:b], SEED) for a, b in zip(ends[first].tolist(), (ends[last] - 1).tolist(), strict=True))
    return text, np.fromiter(found, np.uint64, len(text))


def fingerprints(texts: pa.Array, size: int) -> np.ndarray:
    """A bit is 1 if it is set in over half of the text's hashes; none: 0."""
    text, hashes = shingle_hashes(split_words(texts, lower=True), size)
    ones, total = np.zeros((len(texts), BITS), np.int64), np.bincount(text, minlength=len(texts))
    for at in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[at : at + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner = text[at : at + HASHES]
        new = np.flatnonzero(np.diff(owner, prepend=-1))
        ones[owner[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprint(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fingerprint long) of every row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = fingerprints(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow, emit, "doc_id long, fingerprint long")


class Forest:
    """A BK-tree over the values of each group; the first value of a group is its root. Values of a group are distinct.

    kids[first[x] : first[x + 1]] are the children of value x by rising key, edge their keys."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        n = len(values)
        starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if n else np.zeros(0, np.int64)
        self.values, self.root = values, np.repeat(starts, np.diff(np.append(starts, n)))
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at, todo = self.root.copy(), np.setdiff1d(np.arange(n), starts, assume_unique=True)
        while len(todo):
            d = np.bitwise_count(values[todo] ^ values[at[todo]]).astype(np.int64)
            _, lead, slot = np.unique(at[todo] * (BITS + 1) + d, return_index=True, return_inverse=True)
            heads = todo[lead]
            parent[heads], edge[heads] = at[heads], d[lead]
            at[todo] = heads[slot]
            todo = todo[at[todo] != todo]
        order = np.lexsort((edge, parent))
        order = order[len(starts) :]  # roots have no parent
        self.kids, self.edge = order, edge[order]
        self.first = np.searchsorted(parent[order], np.arange(n + 1))
        #: Where the children of a node with a key of at least k begin is a search for this.
        self.code = parent[order] * (BITS + 1) + self.edge

    def links(self, values: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) within the radius: enough of them that a query is joined with the component of every node that is within."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        stack = [(np.arange(len(values))[i : i + VISITS], root[i : i + VISITS]) for i in range(0, len(values), VISITS)]
        while stack:
            query, node = stack.pop()
            d = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            found.append((query[near], node[near]))
            low = np.where(near, radius + 1, d - radius)  # nearer children are linked with the node itself
            a = np.searchsorted(self.code, node * (BITS + 1) + np.maximum(low, 0))
            b = np.searchsorted(self.code, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            most = max(1, VISITS // (2 * radius + 1))
            for i in range(0, len(query), most):
                counts = b[i : i + most] - a[i : i + most]
                if counts.any():
                    owner = np.repeat(np.arange(len(counts)), counts)
                    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + a[i : i + most][owner]
                    stack.append((query[i : i + most][owner], self.kids[place]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least of 0 .. n - 1 that each is linked with by the links u, v."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while np.any(new != new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def masks(radius: int) -> list[dict[int, list[int]]]:
    """For each round, the blocks that a shard's mask (the bits that its fingerprints share) is extended by, one at a time."""

    def extended(mask: int) -> list[int]:
        free = [b for b in range(BITS) if not mask >> b & 1]
        parts = np.array_split(free, radius + 1)
        return [mask | sum(1 << int(b) for b in part) for part in parts]

    rounds, now = [], [0]
    for _ in range(DEPTH):
        rounds.append({m: extended(m) for m in now})
        now = sorted({x for xs in rounds[-1].values() for x in xs})
    return rounds


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def dealt(rows: DataFrame, blocks: dict[int, list[int]]) -> DataFrame:
    """(mask, part, fingerprint): each fingerprint of a shard in the shards of its further blocks; part is its bits under the mask."""
    options = F.create_map(*[x for m, found in blocks.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(f)) for f in found]))])
    rows = rows.select("fingerprint", F.explode(options[F.col("mask")]).alias("mask"))
    return rows.select("mask", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("part"), "fingerprint")


def shard_links(rows: DataFrame, radius: int) -> DataFrame:
    """(u, v) within the radius, as far as they join components of a shard; rows: (mask, part, cell, side, fingerprint), where those
    of side 0 are a shard's tree and those of side 1, if any, are taken through it instead of the tree's own."""

    def found(keys: np.ndarray, side: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        tree = side == 0
        forest, group = Forest(values[tree], keys[tree]), keys[tree]
        there = ~tree & np.isin(keys, group)  # a slice without another has nothing to be taken through
        asked, at = values[there], np.searchsorted(group, keys[there])
        alone = np.flatnonzero(~np.isin(group, keys[there]))  # trees that are searched by their own values
        query, node = forest.links(np.concatenate([asked, forest.values[alone]]), np.concatenate([at, forest.root[alone]]), radius)
        # queries are numbered behind the tree's values; a tree's own stand for themselves
        own = len(group)
        name = np.concatenate([own + np.arange(len(asked)), alone])
        every = np.concatenate([forest.values, asked])
        label = spanning(name[query], node, len(every))
        apart = np.flatnonzero(every != every[label])
        return pa.RecordBatch.from_arrays([pa.array(every[apart].view(np.int64)), pa.array(every[label[apart]].view(np.int64))], names=["u", "v"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("mask", "part", "cell", "side", "fingerprint")], axis=1))
            if sum(map(len, held)) < VISITS // 16:
                continue
            rows = np.concatenate(held)
            last = np.flatnonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last shard may go on in the next batch
            held = [rows[whole:]]
            if whole:
                yield of(rows[:whole])
        rows = np.concatenate(held) if held else np.zeros((0, 5), np.int64)
        if len(rows):
            yield of(rows)

    def of(rows: np.ndarray) -> pa.RecordBatch:
        keys = np.cumsum(np.any(np.diff(rows[:, :3], axis=0, prepend=rows[:1, :3]), axis=1))
        return found(keys, rows[:, 3], np.ascontiguousarray(rows[:, 4]).view(np.uint64))

    order = ("mask", "part", "cell", "side", "fingerprint")
    return rows.select(*order).repartition("mask", "part", "cell").sortWithinPartitions(*order).transform(in_arrow, emit, "u long, v long")


def sliced(rows: DataFrame, members: Column, shard: int) -> DataFrame:
    """Shards of any size as cells of at most about two slices: one is the tree, the other is taken through it."""
    n = F.ceil(members / shard).cast("int")
    mine = F.pmod(F.xxhash64("fingerprint"), n).cast("int")
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct((F.least(mine, o) * n + F.greatest(mine, o)).cast("long").alias("cell"), F.when(mine <= o, 0).otherwise(1).cast("long").alias("side")))
    return rows.select("mask", "part", "fingerprint", F.explode(cells).alias("c")).select("mask", "part", "c.cell", "c.side", "fingerprint")


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(u, v): fingerprints within the radius, as far as they are needed to join all that are linked; distinct: (fingerprint).

    A round counts the shards, takes those of at most SHARD fingerprints, and deals the others again by a further block."""
    rounds, total = masks(radius), distinct.count()
    rows, out = distinct.select("fingerprint", F.lit(0).cast("long").alias("mask")), []
    fixed = 0
    for depth, blocks in enumerate(rounds):
        rows = dealt(rows, blocks) if depth == 0 else dealt(rows, blocks).distinct()  # two ways may lead to one shard
        fixed += (BITS - fixed) // (radius + 1)
        last = depth == len(rounds) - 1
        if not last and depth == 0 and total >> fixed > SHARD // 4:
            rows = rows.select("fingerprint", "mask")  # even an average shard is too large here
            continue
        rows = laid_down(rows)
        sizes = rows.groupBy(F.col("mask").alias("m"), F.col("part").alias("p")).agg(F.count("*").alias("members")).where("members > 1")
        met = rows.join(sizes, (F.col("mask") == F.col("m")) & (F.col("part") == F.col("p"))).select("mask", "part", "fingerprint", "members")
        small = met if last else met.where(F.col("members") <= SHARD)
        out.append(laid_down(shard_links(sliced(small, F.col("members"), SHARD), radius)))
        release(distinct.sparkSession)
        rows = laid_down(met.where(F.col("members") > SHARD).select("fingerprint", "mask"))
        if last or rows.isEmpty():
            break
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable by links, itself included) of every row.

    Texts are lower-cased (A-Z); a fingerprint's bit is 1 if it is set in over half of the hashes of the text's shingles, repeats
    included. A text of fewer words is one shingle; null, empty and wordless texts have the fingerprint 0 and are linked like any
    other. Rows with equal ids each get a row of their own; rows with a null id link others but are never the least, and have a null
    component only if nothing they are linked with has an id. An empty table gives an empty result; other columns are not read."""
    rows = laid_down(with_fingerprint(docs, shingle))
    # one row for each fingerprint: groups of copies are reduced before they are dealt out
    least = cut(rows.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("least")))
    member = cut(components(links(least.select(F.col("f").alias("fingerprint")), radius)))
    named = least.join(member, F.col("f") == F.col("node"), "left").select("f", "least", "component")
    tops = named.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("least").alias("top"))
    named = named.join(tops, F.col("component") == F.col("c"), "left").select("f", F.coalesce("top", "least").alias("component_id"))
    found = rows.join(named, F.col("fingerprint") == F.col("f"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
