"""Periodic runs, conversation repair and SimHash against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import conversations, periodic_runs, queries, simhash
from pagewright.llm.words import split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# periodic runs
def brute_runs(w, exponent=4, least=6):
    found, n = {}, len(w)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def periodic_texts(rng, count):
    texts = []
    for k in range(count):
        w = [rng.choice("ab" if k % 3 else "abcdef") for _ in range(rng.randrange(60))]
        if k % 2 and w:
            a, p = rng.randrange(len(w)), rng.randrange(1, 7)
            w = [w[a + (i - a) % p] if i >= a and a + p <= len(w) else w[i] for i in range(len(w))]
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("pairs", [1 << 19, 7])
def test_runs_by_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    texts = periodic_texts(random.Random(1), 400)
    words = split_words(pa.array([*texts, None, "", " \n"]))
    got = [[] for _ in range(len(texts) + 3)]
    doc, start, length, period = periodic_runs.runs(words)
    for d, s, n, p in zip(doc, start - words.offsets[doc], length, period, strict=True):
        got[d].append((s, n, p))
    assert [sorted(g) for g in got] == [brute_runs(t.split()) for t in texts] + [[], [], []]


def test_a_wrong_hash_changes_nothing(monkeypatch):
    """With prefix sums that are all alike for the first base, every extension is too long; the words show it."""
    sums, made = periodic_runs.Prefixes.__init__, []

    def first_blind(self, codes, rng):
        sums(self, codes, rng)
        if not made:
            self.sums[:] = 0
        made.append(1)

    words = split_words(pa.array([" ".join("xyxyxyxyxz") + " q q q q q q q", "a b c"]))
    right = [x.tolist() for x in periodic_runs.runs(words)]
    monkeypatch.setattr(periodic_runs.Prefixes, "__init__", first_blind)
    assert [x.tolist() for x in periodic_runs.runs(words)] == right and len(made) == 2 and len(right[0]) == 2


def brute_op11(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = sorted(((s, n, p) for s, n, p in brute_runs(w)), key=lambda r: (r[0], r[2]))
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *own, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_op11_by_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [*periodic_texts(rng, 200), *(" ".join(rng.choice(["ö", "b\tb", "c"]) for _ in range(rng.randrange(300))) for _ in range(200)), None, "", " \n", "x " * 5000]
    rows = [*enumerate(texts), (None, "a a a a a a a"), (7, "b " * 9), (7, "b " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("!")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(got, key=repr) == sorted((brute_op11(*r) for r in rows), key=repr)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert periodic_runs.periodic_runs(docs.limit(0), ["doc_id"]).count() == 0
    kept = periodic_runs.periodic_runs(docs, docs.columns, runs_name="found").where("doc_id = 7").collect()
    assert [(r["runs"], r["collapsed"]) for r in kept if r["text"].startswith("b ")] == [("!", "b")] * 2


# conversations
NEXT = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}


def brute_audit(turns):
    """(cost, audit), backwards over turns and states."""
    best = None
    for i in range(len(turns), -1, -1):
        if i == len(turns):
            now = [(0, ""), None, None, (0, "")]
        else:
            role, x, must, now = turns[i] & 3, 5 * (turns[i] & 16 > 0), turns[i] & 12, []
            for s in range(4):
                moves = [("D", 2, s)] if must else [("D", 2, s), *([("K", x, NEXT[s][role])] if role in NEXT[s] else []), *(("R", 1 + x, NEXT[s][q]) for q in (1, 2) if q in NEXT[s])]
                now.append(min(((best[t][0] + c, letter + best[t][1]) for letter, c, t in moves if best[t]), default=None))
        for _ in range(4):
            for s in range(4):
                ways = [(now[t][0] + 5, "I" + now[t][1]) for q, t in NEXT[s].items() if q and now[t]]
                now[s] = min([*ways, *([now[s]] if now[s] else [])], default=None)
        best = now
    return best[0]


@pytest.mark.parametrize(("segment", "together"), [(64, 1024), (3, 1024), (1, 5)])
def test_audits_by_brute_force(monkeypatch, segment, together):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "TOGETHER", together)
    rng = random.Random(2)
    cases = [bytes(rng.choice([0, 1, 2, 1, 2, 1, 2, 3]) + rng.choice([0, 0, 0, 0, 4, 8, 16, 16]) for _ in range(rng.randrange(14))) for _ in range(400)]
    cases += [bytes(rng.choice([0, 1, 2, 1, 2, 3]) + rng.choice([0, 0, 4, 8, 16]) for _ in range(n)) for n in (63, 64, 65, 150)] + [bytes([16] * 9), bytes([0]), bytes([0, 0, 0]), b""]
    assert conversations.audits(cases) == [brute_audit(c) for c in cases]


def brute_repair(rows):
    """{conv_id: row} of op12 by its words, turns that tie by role and digest."""
    out, after = {}, {}
    for conv, turn, role, text in rows:
        after.setdefault(conv, [])
        show = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), "" if h == 1 else show(text)
        row = (turn, "user" if h == 4 else role, re.sub("[.!?]", "", text) if h == 2 else text)
        after[conv] += [] if h == 0 else [row, row] if h == 3 else [row]
    for conv, turns in after.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes = set(), []
        for _, role, text in turns:
            body = WORD.findall(text)
            fault = 4 if not body else 8 if (role, text) in seen else 0 if body[-1][-1] in ".!?" else 16
            seen.add((role, text))
            codes.append("sua".find(role[:1]) % 4 + fault if role else 3 + fault)
        cost, audit = brute_audit(codes)
        numbers = [t for t, _, _ in turns if t is not None]
        made, left = [], list(turns)
        for edit in audit:
            user = not made or made[-1][0][:1] != "u"
            if edit == "I":
                made.append(("user" if user else "assistant", ""))
                continue
            _, role, text = left.pop(0)
            if edit != "D":
                made.append((role if edit == "K" else "user" if user else "assistant", text))
        firsts = [r[:1] for _, r, _ in turns]
        out[conv] = {
            "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            **{name: sum(c & 28 == f for c in codes) for name, f in (("blank", 4), ("duplicate", 8), ("truncated", 16))},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False)),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        }
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))
    return out


def test_op12_by_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = ["Well.", "So?", "No end", "", " \n", None, "same.", "same.", "ends! ", "ü."]
    rows = [(conv, turn if rng.random() < 0.95 else rng.choice([None, 3]), rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2] if turn or conv % 2 else "system", rng.choice(texts) if rng.random() < 0.3 else f"text {conv} {turn}.") for conv in range(150) for turn in range(rng.randrange(1, 12))]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"t{t}" + ".?"[t % 3 % 2] * (t % 7 > 0)) for t in range(500)]  # over several segments
    rows += [(None, 1, "user", "a."), (None, None, None, None), (1001, 5, "tool", "x."), (1001, 5, "tool", "x."), (1002, -(2**40), "user", "x."), (1002, 2**40, "", "x.")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("!")).withColumn("kind", F.lit("!")).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = brute_repair(rows)
    assert {k: {c: v[c] for c in want[k]} for k, v in got.items()} == want
    assert conversations.structure_repair(spark.read.parquet(f"{tmp_path}/conversations.parquet").limit(0)).count() == 0


def test_a_conversation_all_of_whose_rows_are_dropped(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    [row] = conversations.structure_repair(spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert (row["cost"], row["audit"], row["gaps"], row["repaired_sha256"]) == (0, "", 0, hashlib.sha256(b"").hexdigest())


def test_turns_of_a_repair(spark):
    rows = [(1, 0, "assistant", "hi."), (1, 1, "assistant", "so."), (1, 2, "user", "q?")]
    found, turns = conversations.repaired(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert [tuple(r) for r in found.select("cost", "audit", "illegal").collect()] == [(3, "DRR", 2)] or found.first()["cost"] == brute_audit(bytes([2, 2, 1]))[0]
    roles = [r["role"] for r in turns.orderBy("position").collect()]
    assert roles == ["user", "assistant"]


# SimHash
def brute_print(text, size):
    w = WORD.findall((text or "").translate(FOLD))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius):
    label = list(range(len(prints)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                p, q = top(i), top(j)
                label[max(p, q)] = min(p, q)
    return [top(i) for i in range(len(prints))]


def clustered(rng, bases, size, bits, flips):
    out = set()
    for _ in range(bases):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randrange(flips)):
                x ^= 1 << rng.randrange(bits)
            out.add(x)
    return list(out)


@pytest.mark.parametrize("bits", [8, 20, 64])
def test_trees_by_brute_force(bits):
    rng = random.Random(bits)
    for radius in (0, 1, 4):
        prints = clustered(rng, 5, 60, bits, 8)
        forest = simhash.Forest(np.array(prints, np.uint64), np.zeros(len(prints), np.int64))
        query, node = forest.links(forest.values, forest.root, radius)
        assert np.all(np.bitwise_count(forest.values[query] ^ forest.values[node]) <= radius)
        assert simhash.spanning(query, node, len(prints)).tolist() == brute_classes(prints, radius)


@pytest.mark.parametrize("shard", [2048, 30, 4])
def test_links_are_whole_whatever_a_shard_takes(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(shard)
    prints = clustered(rng, 6, 40, 24, 7) + clustered(rng, 3, 30, 64, 9) + [0, 1, 2**64 - 1]
    rng.shuffle(prints)
    signed = [(simhash.signed(p),) for p in prints]
    member = {r["node"]: r["component"] for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fingerprint long"), 4)).collect()}
    want = brute_classes(prints, 4)
    groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in labels}
    assert groups([member.get(p, p) for (p,) in signed]) == groups(want)


def test_op13_by_brute_force(spark, tmp_path):
    rng = random.Random(6)
    base = [f"W{rng.randrange(400)}" for _ in range(250)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 250, 4)] + [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 40))) for _ in range(150)]
    texts += ["Ab c", "aB C", "", None, " \n", "ö é ü ñ ö", "word " * 9000, " ".join(base).upper()]
    rows = [(10 * i + 5, t) for i, t in enumerate(texts)] + [(1, " ".join(base)), (5, texts[0]), (None, texts[0]), (None, "alone in its words")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("!")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    prints = [brute_print(t, 4) for _, t in rows]
    label = brute_classes(prints, 4)
    least = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in label}
    want = sorted(((i, f"{p:016x}", least[x]) for (i, _), p, x in zip(rows, prints, label, strict=True)), key=repr)
    got = sorted((tuple(r) for r in queries.op13_simhash(spark, str(tmp_path)).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == want and len(set(label)) < len(rows) - 40
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
