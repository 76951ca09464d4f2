"""Conversation structure repair: the cheapest edits that make the roles of a conversation an optional system turn and then pairs of
a user's and an assistant's turn.

The grammar has four states, so the states from which the rest of a conversation can be accepted at an exact cost are four bits.
These bitsets are found for every turn in layers of rising cost, each layer from the layers that an edit's cost below it; the first
layer that holds the start state at the first turn gives the least cost. A trace from there, which at every turn takes the
ASCII-least edit whose states meet the bitset of what then remains, gives the least audit: the roles of the repaired turns alternate,
so the state after a piece of an audit is one state only.

Long conversations are cut into segments. Four lanes of a bitset, one for each state at a segment's end, give what a segment costs
from each state to each; costs to the end follow backwards over the segments, and then every segment is traced by itself from each
state it could begin in. All segments of an Arrow batch go through the layers at once.

Texts are read twice, and shuffled once. First one byte a turn, its role and fault, comes together in the order of the turns; an
audit, which is one value of at least as many characters, is found from it. Then the turns pass by in the same order, with the audit
ahead of them, and are repaired as they pass; no task holds the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import in_arrow, laid_down

#: Costs of the edits; a truncated turn that is not deleted costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns of a segment, and segments that go through the layers together: they bound a worker's memory.
SEGMENT = 64
TOGETHER = 1024
#: A turn's byte: which of s, u, a its role begins with (3: none of them), and its fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
BLANK, DUPLICATE, CUT = 4, 8, 16
#: States: nothing yet, after the system turn, after a user's, after an assistant's; as bits of a lane, and in all four lanes.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = 1, 2, 4, 8
LANES = np.uint16(0x1111)
NEVER = 1 << 40


def before_system(x: np.ndarray) -> np.ndarray:
    """The states from which a system turn leads to a state of x; likewise below."""
    return x >> 1 & LANES


def before_user(x: np.ndarray) -> np.ndarray:
    return (x >> 2 & LANES) * np.uint16(START | AFTER_SYSTEM | AFTER_ASSISTANT)


def before_assistant(x: np.ndarray) -> np.ndarray:
    return (x >> 3 & LANES) * np.uint16(AFTER_USER)


def before_either(x: np.ndarray) -> np.ndarray:
    return before_user(x) | before_assistant(x)


def after(state: np.ndarray, role: np.ndarray) -> np.ndarray:
    """The state (0: none) that a turn of that role leads to."""
    to_user = (role == USER) & (state & (START | AFTER_SYSTEM | AFTER_ASSISTANT) > 0)
    out = np.where(to_user, AFTER_USER, 0) | np.where((role == ASSISTANT) & (state == AFTER_USER), AFTER_ASSISTANT, 0)
    return (out | np.where((role == SYSTEM) & (state == START), AFTER_SYSTEM, 0)).astype(np.uint16)


def after_either(state: np.ndarray) -> np.ndarray:
    return np.where(state == AFTER_USER, AFTER_ASSISTANT, np.where(state > 0, AFTER_USER, 0)).astype(np.uint16)


class Layers:
    """at[c, i] of each segment: the states from which the turns from i on cost exactly c, up to the layer that wanted asks for.

    turns: a row of bytes for each segment; n: how many of them there are. ends[c]: the states that cost c at the segment's end.
    closed: whether turns may be inserted there (elsewhere the next segment does that). wanted(at[c, 0] of all c so far): enough?"""

    def __init__(self, turns: np.ndarray, n: np.ndarray, ends: list[np.ndarray], closed: np.ndarray, wanted):
        width = turns.shape[1]
        self.turns, self.n, self.ends = turns, n, ends
        role, self.must = turns & 3, (turns & (BLANK | DUPLICATE)) > 0
        self.extra = np.where(turns & CUT, TRUNCATED, 0)
        there = np.arange(width) < n[:, None]
        keeps = there & ~self.must
        whole, cut = keeps & (self.extra == 0), keeps & (self.extra > 0)
        mask = lambda m: np.where(m, 0xFFFF, 0).astype(np.uint16).T.copy()
        absent, kept = mask(~there), {(x, r): mask(t & (role == r)) for x, t in ((0, whole), (TRUNCATED, cut)) for r in (SYSTEM, USER, ASSISTANT)}
        may, present = {0: mask(whole), TRUNCATED: mask(cut)}, mask(there)
        last = np.where(closed, 0xFFFF, 0).astype(np.uint16)
        nothing = np.zeros((width + 1, len(n)), np.uint16)
        self.at: list[np.ndarray] = []
        get = lambda c: self.at[c] if c >= 0 else nothing
        while True:
            c = len(self.at)
            layer = np.zeros((width + 1, len(n)), np.uint16)
            inserted = before_either(get(c - INSERT))
            layer[width] = (ends[c] if c < len(ends) else 0) | (inserted[width] & last)
            # everything but deletions and keeping at no cost comes from lower layers, for all turns at once
            known = get(c - DELETE)[1:] & present | inserted[:-1] & present
            for x in (0, TRUNCATED):
                known |= before_either(get(c - REROLE - x)[1:]) & may[x]
            lower = get(c - TRUNCATED)[1:]
            known |= before_system(lower) & kept[TRUNCATED, SYSTEM] | before_user(lower) & kept[TRUNCATED, USER] | before_assistant(lower) & kept[TRUNCATED, ASSISTANT]
            for i in range(width - 1, -1, -1):
                now = layer[i + 1]
                layer[i] = known[i] | now & absent[i] | before_system(now) & kept[0, SYSTEM][i] | before_user(now) & kept[0, USER][i] | before_assistant(now) & kept[0, ASSISTANT][i]
            self.at.append(layer)
            if wanted(layer[0]):
                return

    def trace(self, state: np.ndarray, cost: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The least audit of each segment from that state at exactly that cost, and the state it ends in; state 0 gives none."""
        at, rows = np.stack(self.at), np.arange(len(self.n))
        place, state, left = np.zeros(len(rows), np.int64), state.astype(np.uint16), cost.astype(np.int64)
        letters: list[list[str]] = [[] for _ in rows]
        go = rows[state > 0]
        holds = lambda c, i, r, s: np.where(c >= 0, at[np.maximum(c, 0), np.minimum(i, at.shape[1] - 1), r], 0) & s
        ends = np.stack(self.ends)
        end = np.zeros(len(rows), np.uint16)
        while len(go):
            done = (place[go] == self.n[go]) & (np.where(left[go] < len(ends), ends[np.minimum(left[go], len(ends) - 1), go], 0) & state[go] > 0)
            end[go[done]] = state[go[done]]
            go = go[~done]
            if not len(go):
                break
            i, s, c = place[go], state[go], left[go]
            here = i < self.n[go]
            j = np.minimum(i, self.turns.shape[1] - 1)
            # behind the last turn is the end, wherever the row's padding ends
            to = np.where(i + 1 >= self.n[go], at.shape[1] - 1, i + 1)
            own = np.where(here, i, at.shape[1] - 1)
            keep = here & ~self.must[go, j]
            x = self.extra[go, j]
            moves = (
                ("D", np.where(here, s, 0), c - DELETE, to, 1),
                ("I", after_either(s), c - INSERT, own, 0),
                ("K", np.where(keep, after(s, self.turns[go, j] & 3), 0), c - KEEP - x, to, 1),
                ("R", np.where(keep, after_either(s), 0), c - REROLE - x, to, 1),
            )
            open_ = np.ones(len(go), bool)
            for letter, next_, rest, where, step in moves:
                ok = open_ & (holds(rest, where, go, next_.astype(np.uint16)) > 0)
                for r in go[ok].tolist():
                    letters[r].append(letter)
                state[go[ok]], left[go[ok]] = next_[ok], rest[ok]
                place[go[ok]] += step
                open_ &= ~ok
            if open_.any():
                raise AssertionError("a layer promised what no edit gives")
        return ["".join(x) for x in letters], end


def padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(p) for p in pieces], np.int64)
    width = max(1, int(n.max(initial=0)))
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width), n


def short_audits(found: list[bytes]) -> list[tuple[int, str]]:
    """(cost, audit) of conversations of one segment each."""
    turns, n = padded(found)
    open_ = np.ones(len(n), bool)

    def wanted(first: np.ndarray) -> bool:
        cost[open_ & (first & START > 0)] = len_at[0]
        open_[first & START > 0] = False
        len_at[0] += 1
        return not open_.any()

    cost, len_at = np.zeros(len(n), np.int64), [0]
    ends = [np.full(len(n), START | AFTER_ASSISTANT, np.uint16)]
    layers = Layers(turns, n, ends, np.ones(len(n), bool), wanted)
    audits, _ = layers.trace(np.full(len(n), START), cost)
    return list(zip(cost.tolist(), audits, strict=True))


def long_audits(found: list[bytes]) -> list[tuple[int, str]]:
    """(cost, audit) of conversations of any length, by segments; those of all conversations go through the layers together."""
    pieces, last = [], []
    for turns in found:
        pieces += [turns[i : i + SEGMENT] for i in range(0, len(turns), SEGMENT)]
        last += [False] * (len(pieces) - len(last) - 1) + [True]
    last = np.array(last)
    # the costs from each state to each; behind a last segment, to the end from wherever that is accepted
    price = np.full((len(pieces), 4, 4), NEVER, np.int64)
    for at in range(0, len(pieces), TOGETHER):
        turns, n = padded(pieces[at : at + TOGETHER])
        closed = last[at : at + TOGETHER]
        lanes = np.where(closed, START | AFTER_ASSISTANT, 0x8421).astype(np.uint16)  # lane t holds the state t
        _, firsts = _layers(turns, n, [lanes], closed)
        bits = firsts[:, :, None] >> np.arange(16, dtype=np.uint16) & 1 > 0
        price[at : at + TOGETHER] = np.where(bits.any(axis=0), bits.argmax(axis=0), NEVER).reshape(-1, 4, 4).swapaxes(1, 2)
    # what the rest costs from each state, at each segment's end
    rest, begin = np.full((len(pieces), 4), NEVER, np.int64), np.zeros((len(pieces), 4), np.int64)
    for k in range(len(pieces) - 1, -1, -1):
        if last[k]:
            begin[k] = price[k, :, 0]
        else:
            rest[k] = begin[k + 1]
            begin[k] = np.minimum((price[k] + rest[k]).min(axis=1), NEVER)
    ways: list[list[tuple[str, int] | None]] = []
    for at in range(0, len(pieces), TOGETHER):
        ways += _ways(pieces[at : at + TOGETHER], rest[at : at + TOGETHER], last[at : at + TOGETHER])
    out, state, audit, cost = [], 0, [], int(begin[0, 0])
    for k, way in enumerate(ways):
        letters, state = way[state]
        audit.append(letters)
        if last[k]:
            out.append((cost, "".join(audit)))
            state, audit, cost = 0, [], int(begin[k + 1, 0]) if k + 1 < len(ways) else 0
    return out


def _layers(turns: np.ndarray, n: np.ndarray, ends: list[np.ndarray], closed: np.ndarray) -> tuple[Layers, np.ndarray]:
    """The layers up to the cost that no way between two states exceeds, all turns deleted and some inserted, and their bitsets at the first turn."""
    seen: list[np.ndarray] = []
    # a system turn may have to stay for a state to be reached, whatever it costs; nothing else asks for more than deletions
    most = DELETE * turns.shape[1] + TRUNCATED + 4 * INSERT + len(ends)
    layers = Layers(turns, n, ends, closed, lambda first: seen.append(first) or len(seen) > most)
    return layers, np.stack(seen)


def _ways(pieces: list[bytes], rest: np.ndarray, last: np.ndarray) -> list[list[tuple[str, int] | None]]:
    """For each segment and each state (0 to 3) that it may begin in: its audit and the state that it ends in. It is traced above the
    least of the costs from its end."""
    turns, n = padded(pieces)
    gap = np.where(rest < NEVER, rest - rest.min(axis=1, keepdims=True), -1)
    gap[last] = (0, -1, -1, 0)
    ends = [((gap == c) * (1 << np.arange(4))).sum(axis=1).astype(np.uint16) for c in range(int(gap.max()) + 1)]
    layers, first = _layers(turns, n, ends, last)
    out: list[list[tuple[str, int] | None]] = [[None] * 4 for _ in pieces]
    for s in range(4):
        has = first >> s & 1 > 0
        can = has.any(axis=0)
        letters, end = layers.trace(np.where(can, 1 << s, 0), has.argmax(axis=0))
        for r in np.flatnonzero(can).tolist():
            out[r][s] = (letters[r], int(end[r]).bit_length() - 1)
    return out


def audits(found: list[bytes]) -> list[tuple[int, str]]:
    """(cost, audit) of each conversation, given one byte a turn."""
    out: list[tuple[int, str]] = [(0, "")] * len(found)
    order = sorted((i for i, x in enumerate(found) if 0 < len(x) <= SEGMENT), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        width = -(-len(found[order[at]]) // 8) * 8
        upto = at
        while upto < len(order) and upto - at < TOGETHER and len(found[order[upto]]) <= width:
            upto += 1
        for i, got in zip(order[at:upto], short_audits([found[i] for i in order[at:upto]]), strict=True):
            out[i] = got
        at = upto
    long = [i for i, x in enumerate(found) if len(x) > SEGMENT]
    for i, got in zip(long, long_audits([found[i] for i in long]) if long else [], strict=True):
        out[i] = got
    return out


# DataFrames
_SPACE = r"\x20\x09-\x0D"


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key) with a space for a null role or text; key, a digest of the text, orders turns that tie."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    return rows.withColumn("key", F.md5(F.col("text").cast("binary")))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, code) of the rows of turn_rows, dealt out by conversation and in order. No texts are shuffled."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    short = rows.select("conv_id", "turn", "role", "key", role.alias("first"), blank.alias("blank"), cut.alias("cut")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "key").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    return short.withColumn("code", (F.col("first") + fault).cast("tinyint")).sortWithinPartitions("conv_id", *in_order()).select("conv_id", "turn", "code")


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


class Turns:
    """What is known of a conversation whose turns pass by in order: a byte each, and their numbers' range and count."""

    def __init__(self, conv_id):
        self.conv_id, self.codes = conv_id, bytearray()
        self.least = self.last = None
        self.distinct = 0

    def add(self, numbers: np.ndarray, codes: np.ndarray) -> None:
        self.codes += codes.tobytes()
        if len(numbers):
            self.distinct += int((np.diff(numbers) != 0).sum()) + (self.last is None or self.last != numbers[0])
            self.least, self.last = int(numbers[0]) if self.least is None else self.least, int(numbers[-1])

    def facts(self) -> dict[str, int]:
        codes = np.frombuffer(self.codes, np.uint8)
        role, fault = codes & 3, codes & ~np.uint8(3)
        steps = np.bincount(role[:-1].astype(np.int64) * 4 + role[1:], minlength=16)
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.distinct
        faults = {name: int((fault == f).sum()) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))}
        return {"gaps": gaps, **faults, "illegal": int(steps.sum() - sum(steps[4 * a + b] for a, b in LEGAL))}


def summaries(done: list[Turns], id_type: pa.DataType) -> pa.RecordBatch:
    rows = [x.facts() | {"cost": c, "audit": a} for x, (c, a) in zip(done, audits([bytes(x.codes) for x in done]), strict=True)]
    columns = {"conv_id": pa.array([x.conv_id for x in done], id_type)}
    columns |= {c: pa.array([r[c] for r in rows], pa.string() if c == "audit" else pa.int64()) for c in rows[0]}
    return pa.RecordBatch.from_pydict(columns)


def judged(conversations: DataFrame) -> DataFrame:
    """(conv_id, SUMMARY) of every conversation with a row; see repaired()."""
    rows = marked(turn_rows(conversations))

    schema = rows.select("conv_id").schema
    id_type = to_arrow_type(schema["conv_id"].dataType)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: Turns | None = None  # the conversation that may go on
        for batch in batches:
            names, turns = batch.column("conv_id").to_pylist(), batch.column("turn")
            known, values = turns.is_valid().to_numpy(zero_copy_only=False), turns.fill_null(0).to_numpy(zero_copy_only=False)
            codes = batch.column("code").to_numpy(zero_copy_only=False).astype(np.uint8)
            done = []
            for a, b in pairwise([0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]):
                if open_ is None or open_.conv_id != names[a]:
                    if open_ is not None:
                        done.append(open_)
                    open_ = Turns(names[a])
                open_.add(values[a:b][known[a:b]], codes[a:b])
            if done:
                yield summaries(done, id_type)
        if open_ is not None:
            yield summaries([open_], id_type)

    return rows.transform(in_arrow, emit, StructType([*schema, *StructType.fromDDL(SUMMARY)]))


def edited(conversations: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, position, turn, edit, role, text): the turns that stay and those that are inserted (turn null), dealt out by
    conversation and in order; audit: (conv_id, audit) of every conversation."""
    rows = turn_rows(conversations).withColumn("kind", F.lit(1))
    ahead = audit.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("key"), F.lit(0).alias("kind"))
    both = ahead.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *in_order()).select("conv_id", "kind", "turn", "role", "text")
    schema = StructType([*both.select("conv_id").schema, *StructType.fromDDL("position long, turn long, edit string, role string, text string")])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, at, tail, position, user = "", 0, 0, 0, True
        for batch in batches:
            out: list[tuple] = []
            for conv_id, is_turn, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_turn:
                    steps, at, tail, position, user = text, 0, len(text.rstrip("I")), 0, True
                    continue
                while at < len(steps):  # what is inserted ahead of the turn, the turn itself, what is inserted behind the last
                    edit, at = steps[at], at + 1
                    if edit == "I":
                        out.append((conv_id, position, None, edit, "user" if user else "assistant", ""))
                    elif edit != "D":
                        out.append((conv_id, position, turn, edit, role if edit == "K" else "user" if user else "assistant", text))
                    if edit != "D":
                        position, user = position + 1, out[-1][4][:1] != "u"
                    if edit != "I" and at < tail:
                        break
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=schema.names)

    return both.transform(in_arrow, emit, schema)


def repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the turns (conv_id, turn, role, text): one row for each conversation (conv_id, SUMMARY), and the turns of all as edited() gives them.

    Turns stand in the order of their number, those without one first; ties go by role and then by the digest of their text. A null
    role or text is a space, a null conv_id is a conversation of its own; other columns are not read. Turns that repeat are duplicates
    wherever they stand. A conversation all of whose turns go has an empty audit's worth of rows: none. Empty tables give empty ones."""
    found = laid_down(judged(conversations))
    return found, edited(conversations, found.select("conv_id", "audit"))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the turns of edited(), as `role:text` joined by newlines; taken as they pass by."""
    schema = StructType([*turns.select("conv_id").schema, *StructType.fromDDL("repaired_sha256 string")])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = None, None
        for batch in batches:
            done = []
            for conv_id, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if held is not None:
                        done.append((open_, held.hexdigest()))
                    open_, held = conv_id, hashlib.sha256()
                held.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names=schema.names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((open_, held.hexdigest()), kinds, strict=True)], names=schema.names)

    return turns.transform(in_arrow, emit, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 is dropped, 1 loses its text, 2 its sentence ends, 3 stands
    twice, 4 becomes a user's. A null is a space throughout."""
    id_text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(id_text.cast("binary")) % 20).alias("fault"))
    rows = rows.where("fault <> 0").withColumn("times", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def structure_repair(conversations: DataFrame) -> DataFrame:
    """A row for every conv_id of the table: what is wrong with its damaged rows, what the repair costs, its audit, and the digest of
    the repaired turns."""
    found, turns = repaired(damaged(conversations))
    names = [f.name for f in StructType.fromDDL(SUMMARY)]
    empty = lambda *there: [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(f"{SUMMARY}, repaired_sha256 string") if f.name not in there]
    parts = conversations.select("conv_id", *empty()).unionByName(found.select("*", *empty(*names))).unionByName(digests(turns).select("*", *empty("repaired_sha256")))
    best = parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*names, "repaired_sha256")])
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return best.select("conv_id", *[F.coalesce(c, F.lit(nothing.get(c, 0))).alias(c) for c in (*names, "repaired_sha256")])
