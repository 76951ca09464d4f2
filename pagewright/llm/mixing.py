"""Mixing sources to target weights by Pfair scheduling.

Documents are numbered within their source in a hashed order and cut into blocks. A source of rate w gives its k-th block the
release time floor((k - 1) / w) and the deadline ceil(k / w), in slots of one block; earliest deadline first among the released
blocks keeps every source, at every slot, within less than one block of its target. Rates are exact: weights are taken as the
decimals, fractions or integers that they are, and brought to integer shares. With shares that sum to n the schedule repeats after n
slots, where every source has just its target, so the driver simulates one such period for each phase, or the phase if that is
shorter, and the executors place all blocks by it. When a source runs out a new phase begins, with the weights of those that
remain, at a deviation of 0. Every row is placed exactly once.

The driver holds one count for each source and the simulated slots: of each phase as many as its blocks at most, and as the sum of
its shares at most. Numbering uses about sqrt(n) hashed buckets for a source of n rows, so neither a bucket nor the list of buckets
of a hot source grows with all rows.

Defined cases: a null source is a source of its own; a source without a weight shares the least given weight; weights of 0 or
less come after all others, as one equal phase; repeated rows and ids are rows of their own; an empty table gives an empty result;
columns may have any names, but old columns of the names that are made here give way to the new ones.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, quoted

BLOCK_ROWS = 64


def shares(weights: Mapping[int, float | int | Fraction | Decimal]) -> dict[int, int]:
    """The weights as integers in the same proportions, without a common divisor; a float counts as the decimal that it prints as."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def schedule(share: Mapping[int, int], blocks: Mapping[int, int]) -> list[int]:
    """The source of every slot, until one period is over or a source has given all its blocks: earliest deadline first among the
    released blocks; ties go to the larger rate."""
    total = sum(share.values())
    waiting = [(0, -n, s, 1) for s, n in share.items()]  # (release, tie, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, tie, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(k * total // tie), tie, s, k))
        _, tie, s, k = heapq.heappop(ready)
        out.append(s)
        if k == blocks[s]:
            break
        heapq.heappush(waiting, (k * total // -tie, tie, s, k + 1))
    return out


@dataclass(frozen=True)
class Phase:
    first: int  # slot
    slots: int
    order: np.ndarray  # the source of each slot of a period
    own: dict[int, tuple[int, int]]  # source: (its first block, its blocks a period)


def phases(blocks: Mapping[int, int], weights: Mapping[int, float | int | Fraction | Decimal]) -> list[Phase]:
    """The phases in order, until all blocks are placed."""
    left, out, slot, used = {s: n for s, n in blocks.items() if n > 0}, [], 0, dict.fromkeys(blocks, 0)
    while left:
        share = shares({s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1))
        whole = min(left[s] // n for s, n in share.items())
        order = np.array(schedule(share, left), np.int32)
        per = {int(s): int(n) for s, n in zip(*np.unique(order, return_counts=True), strict=True)}
        slots = max(whole, 1) * len(order)
        out.append(Phase(slot, slots, order, {s: (used[s], n) for s, n in per.items()}))
        slot += slots
        for s, n in per.items():
            used[s] += max(whole, 1) * n
            left[s] -= max(whole, 1) * n
            if not left[s]:
                del left[s]
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, columns: list[str] | None = None, block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """The columns of every row (default doc_id, source) and mix_slot, mix_block (within its source) and mix_position (dense, from 0).

    weights: target weight of each source; by default the whole square root of its blocks."""
    columns = [c for c in columns or ["doc_id", "source"] if c.lower() not in ("mix_slot", "mix_block", "mix_position")]
    spark = docs.sparkSession
    source = F.col("source").cast("string")
    counts = docs.groupBy(source.alias("s")).agg(F.count("*").alias("n")).collect()
    names = sorted((r["s"] for r in counts), key=lambda s: (s is None, s or ""))
    rows = {r["s"]: r["n"] for r in counts}
    blocks_of = {i: math.ceil(rows[s] / block_rows) for i, s in enumerate(names)}
    given = weights or {s: math.isqrt(blocks_of[i]) for i, s in enumerate(names)}
    default = min((w for w in given.values() if w > 0), default=1)
    plan = phases(blocks_of, {i: given.get(s, default) for i, s in enumerate(names)})

    # small tables: sources, their phases, and the slots of a period
    by_source = [(s, i, max(1, math.isqrt(rows[s])), rows[s]) for i, s in enumerate(names)]
    sources = spark.createDataFrame(by_source or [(None, 0, 1, 0)], "s string, source_no int, buckets long, source_rows long").where("source_rows > 0")
    ranges = [(s, p, start, start + phase.slots // len(phase.order) * per, per, phase.first, len(phase.order)) for p, phase in enumerate(plan) for s, (start, per) in phase.own.items()]
    phase = spark.createDataFrame(ranges or [(0,) * 7], "source_no int, phase int, start long, stop long, per long, first long, size long")
    place = spark.createDataFrame(_places(plan))

    # number the rows of a source: a hashed bucket, its rows before, the rank within it
    inner = {c: f"__c{i}" for i, c in enumerate(columns)}
    work = docs.select(*[c.alias(n) for c, n in zip(quoted(columns), inner.values(), strict=True)], source.alias("__s"))
    key = F.xxhash64(F.lit(seed), *[F.col(inner[c]) for c in columns if c in ("doc_id", "text")] or [F.col("__s")])
    sized = work.join(F.broadcast(sources.select(F.col("s").alias("__name"), "source_no", "buckets")), F.col("__s").eqNullSafe(F.col("__name"))).drop("__name")
    sized = sized.withColumn("__h", key).withColumn("__bucket", F.pmod(F.col("__h"), F.col("buckets")))
    sized = sized.drop("buckets")
    held = cut(sized.groupBy("source_no", "__bucket").agg(F.count("*").alias("held")))
    before = Window.partitionBy("source_no").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("skip", F.coalesce(F.sum("held").over(before), F.lit(0)))
    blocks = held.select("source_no", "__bucket", "skip", F.explode(F.sequence(F.expr(f"skip div {block_rows}"), F.expr(f"(skip + held - 1) div {block_rows}"))).alias("block"))
    blocks = blocks.join(phase, "source_no").where("block >= start and block < stop").withColumn("turn", F.expr("(block - start) % per"))
    blocks = blocks.join(place, ["phase", "source_no", "turn"]).withColumn("slot", F.expr("first + ((block - start) div per) * size + at"))
    # the last block of a source may be short; what it lacks moves up all that follows
    blocks = blocks.withColumn("lacking", _lacking(_short_blocks(plan, rows, names, block_rows)))
    slots = blocks.groupBy("source_no", "__bucket").agg(F.min("skip").alias("skip"), F.min("block").alias("block0"), F.array_sort(F.collect_list(F.struct("block", "slot", "lacking"))).alias("slots"))

    within = Window.partitionBy("source_no", "__bucket").orderBy("__h", *[F.col(n) for n in inner.values()])
    ranked = sized.withColumn("__rank", F.row_number().over(within) - 1)
    slots = slots.select(F.col("source_no").alias("__no"), F.col("__bucket").alias("__b"), "skip", "block0", "slots")
    ranked = ranked.join(slots, (F.col("source_no") == F.col("__no")) & (F.col("__bucket") == F.col("__b")))
    at = F.col("skip") + F.col("__rank")
    ranked = ranked.withColumn("__row", at).withColumn("__block", F.floor(at / block_rows).cast("long"))
    ranked = ranked.withColumn("__slot", F.get("slots", (F.col("__block") - F.col("block0")).cast("int")))
    position = F.col("__slot.slot") * block_rows + F.col("__row") % block_rows - F.col("__slot.lacking")
    return ranked.select(*[F.col(n).alias(c) for c, n in inner.items()], F.col("__slot.slot").alias("mix_slot"), F.col("__block").alias("mix_block"), position.alias("mix_position"))


def _places(plan: list[Phase]) -> pa.Table:
    """(phase, source_no, turn, at): the place in its period of every block that a source has there."""
    cells = []
    for p, phase in enumerate(plan):
        by_source = np.argsort(phase.order, kind="stable")
        source = phase.order[by_source]
        first = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
        turn = np.arange(len(source)) - np.repeat(first, np.diff(np.append(first, len(source))))
        cells.append((np.full(len(source), p, np.int32), source, turn, by_source))
    columns = [np.concatenate(x) for x in zip(*cells, strict=True)] if cells else [np.zeros(0, np.int64)] * 4
    return pa.table([pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.int64, np.int64), strict=True)], names=["phase", "source_no", "turn", "at"])


def _short_blocks(plan: list[Phase], rows: dict, names: list, block_rows: int) -> list[tuple[int, int]]:
    """(slot, missing rows) of every source's last block, where it is not full."""
    out = []
    for i, name in enumerate(names):
        lack = -rows[name] % block_rows
        if lack:
            last = math.ceil(rows[name] / block_rows) - 1
            phase = [p for p in plan if i in p.own and p.own[i][0] <= last][-1]
            start, per = phase.own[i]
            turn = int(np.flatnonzero(phase.order == i)[(last - start) % per])
            out.append((phase.first + (last - start) // per * len(phase.order) + turn, lack))
    return sorted(out)


def _lacking(short: list[tuple[int, int]]) -> Column:
    """Rows that the short blocks before a slot lack."""
    zero = F.lit(0).cast("long")
    if not short:
        return zero
    blocks = F.array(*[F.struct(F.lit(s).cast("long").alias("slot"), F.lit(n).cast("long").alias("n")) for s, n in short])
    return F.aggregate(blocks, zero, lambda acc, x: acc + F.when(x["slot"] < F.col("slot"), x["n"]).otherwise(zero))


def in_mixed_order(mixed: DataFrame, rows: int) -> DataFrame:
    """The mixed rows laid out by position: partitions are consecutive stretches, as many as Spark's shuffle partitions, each sorted."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = max(1, math.ceil(rows / parts))
    return mixed.repartitionById(parts, F.floor(F.col("mix_position") / stretch).cast("int")).sortWithinPartitions("mix_position")
