"""Similarity, substrings, mixing, decontamination, archives and the classifiers against brute force, round trips and held-out rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import decontamination, jaccard_join, mixing, quality_model, substring_dedup, toxicity, warc
from pagewright.llm.words import split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def family(rng, size, n, edits):
    """Near copies of one text, each with some words replaced."""
    base, out = prose(rng, n), []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(n)] = rng.choice(VOCABULARY)
        out.append(" ".join(copy))
    return out


def brute_components(rows, k, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent", "hot"), [(3, 90, 32), (5, 80, 3)])
def test_jaccard_components(spark, monkeypatch, k, percent, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 16)
    monkeypatch.setattr(jaccard_join, "SPOKES", 5)
    rng = random.Random(1)
    texts = family(rng, 40, 120, 9) + family(rng, 25, 30, 2) + family(rng, 20, 12, 1) + [" ".join(prose(rng, n)) for n in (1, 2, 3, 9, 200)] * 2
    texts += ["The SAME words here", "the same WORDS here", "", " \n", None] + [" ".join(VOCABULARY[:50])] * 3
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d", 1), (None, "a b c d", 2), (5, "a b c d", 3), (5, "a b c d", 3), (7, "a b c d", 3), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_join(docs).collect()), key=repr)
    assert Counter(got) == Counter([(None, None), (None, None), (5, 5), (5, 5), (7, 5), (8, 8)])
    assert jaccard_join.one_of_each(docs, docs.columns).count() == 4
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_go_by_their_own_texts(spark):
    rng = random.Random(14)
    base, clean, other = (prose(rng, 60) for _ in range(3))
    near = " ".join(base[:30] + ["changed"] + base[31:])
    base, clean, other = map(" ".join, (base, clean, other))
    rows = [(1, base), (2, near), (2, clean), (3, clean), (4, other), (4, other + " end"), (5, ""), (5, ""), (5, None), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.one_of_each(docs, docs.columns).collect()
    assert Counter((r["doc_id"], (r["text"] or "").removesuffix(" end")) for r in got) == Counter([(1, base), (2, clean), (4, other), (5, ""), (5, ""), (None, base)])


def test_sketches_never_overstate():
    rng, plan = np.random.default_rng(2), jaccard_join.Plan(80)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in rng.integers(1, 200, 2))
        b = np.unique(np.concatenate([b, a[: len(a) // 2]]))
        x, y = (jaccard_join.sketches(s, np.array([0, len(s)]), plan)[0] for s in (a, b))
        assert jaccard_join.least_difference(x, y) <= len(np.setxor1d(a, b))


def brute_dedup(rows, n=35):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[p : p + n]) for _, w in docs for p in range(len(w) - n + 1))
    out = []
    for i, w in docs:
        gone = {j for p in range(len(w) - n + 1) if seen[tuple(w[p : p + n])] > 1 for j in range(p, p + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_words", [1 << 18, 150, 0])
def test_substring_dedup(spark, part_words):
    rng = random.Random(4)
    shared = prose(rng, 60)
    texts = [" ".join(prose(rng, rng.randrange(40)) + shared[rng.randrange(20) :] + prose(rng, 30)) for _ in range(20)]
    texts += ["a " * 200, "a b " * 40, " ".join(shared[:34]), " ".join(prose(rng, 35)), "", None, "\x0bx  y\n", "same " + " ".join(prose(rng, 50))]
    rows = [*enumerate(texts), (50, texts[-1]), (50, texts[-1]), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(docs, part_words=part_words).collect()), key=repr)
    assert got == brute_dedup(rows)
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_a_phrase_of_every_row_makes_no_large_part(spark):
    rng = random.Random(21)

    def anchor(phrase):
        words = split_words(pa.array([" ".join(phrase)]))
        return substring_dedup.window_hashes(words.hashes()[words.codes], 8)[0]

    phrase = min((prose(rng, 8) for _ in range(3000)), key=anchor)
    rows = [(i, " ".join(prose(rng, 60) + phrase + prose(rng, 60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    runs = substring_dedup.runs_of(docs, 35, 8)
    biggest = lambda r: r.groupBy("anchor").agg({"times": "sum"}).agg({"sum(times)": "max"}).first()[0]
    assert biggest(runs) >= 250  # the phrase is an anchor of nearly all,
    found = runs.groupBy("anchor").count().where("count >= 250").join(runs, "anchor").selectExpr("doc", "start", "size", "8 as prefix")
    assert biggest(substring_dedup.runs_of(substring_dedup.with_spans(docs, found), 35, 16)) < 10  # and at 16 words of nearly none
    assert substring_dedup.repeats(docs, part_words=500).count() == 0


def test_likely_documents(spark):
    rng = random.Random(5)
    every = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    docs, found = spark.createDataFrame([(d, "t") for d in every], "doc long, text string"), spark.createDataFrame([(d,) for d in every[:200] * 2], "doc long")
    got = [r["doc"] for r in substring_dedup.likely(docs, found).collect()]
    assert set(every[:200]) <= set(got) and len(got) == len(set(got)) < 260
    assert substring_dedup.likely(docs, found.limit(0)).count() == 0


def test_deep_nodes_by_brute_force():
    rng = np.random.default_rng(4)
    for depth in (2, 3, 7, 35):
        codes = np.concatenate([rng.integers(0, 3, 200), np.zeros(60, np.int64), rng.integers(0, 1 << 60, 80)]).astype(np.uint64)
        starts = np.arange(len(codes) - depth + 1)
        parts = (starts >= 250).astype(np.int64)
        seen = Counter((int(p), tuple(codes[s : s + depth])) for s, p in zip(starts, parts, strict=True))
        want = [seen[int(p), tuple(codes[s : s + depth])] > 1 for s, p in zip(starts, parts, strict=True)]
        assert substring_dedup.deep_nodes(codes, starts, parts, depth).tolist() == want


def brute_edf(share, slots):
    """Earliest deadline first among released blocks, looked for anew in every slot."""
    rate = {s: Fraction(n, sum(share.values())) for s, n in share.items()}
    given, out = Counter(), []
    for t in range(slots):
        ready = [(math.ceil((given[s] + 1) / w), -w, s) for s, w in rate.items() if math.floor(given[s] / w) <= t]
        out.append(min(ready)[2])
        given[out[-1]] += 1
    return out


def farthest(weights, order):
    """Most blocks that any source is off its target after any slot."""
    total, most, t = sum(map(Fraction, weights.values())), 0.0, np.arange(1, len(order) + 1)
    for s, w in weights.items():
        most = max(most, float(np.abs(np.cumsum(order == s) - float(Fraction(w) / total) * t).max()))
    return most


def whole_order(phase):
    return np.tile(phase.order, phase.slots // len(phase.order))


@pytest.mark.parametrize("share", [{0: 500, 1: 300, 2: 199, 3: 1}, {0: 997, 1: 1, 2: 1, 3: 1}, {i: 20 for i in range(50)}, {0: 3, 1: 7, 2: 11, 3: 2}])
def test_schedule_by_brute_force(share):
    got = mixing.schedule(share, dict.fromkeys(share, 1 << 40))
    assert got == brute_edf(share, sum(share.values())) and Counter(got) == share


def test_deviation_from_the_given_weights_stays_below_a_block():
    big = 2_000_000
    for weights in ({0: 0.7, 1: 0.2996, 2: 0.0004}, {0: Fraction(1, 3), 1: Fraction(1, 7), 2: Fraction(11, 21)}, {i: math.isqrt(1000 + 37 * i * i) for i in range(7)}):
        exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
        blocks = {s: int(big * w / sum(exact.values())) for s, w in exact.items()}
        first = mixing.phases(blocks, weights)[0]
        assert first.slots >= 1_000_000 and farthest(exact, whole_order(first)) < 1


def test_any_number_of_sources():
    rng = random.Random(17)
    blocks = {i: rng.randrange(1, 60) for i in range(1200)}
    plan = mixing.phases(blocks, {i: math.isqrt(n) for i, n in blocks.items()})
    placed = Counter()
    for phase in plan:
        order = whole_order(phase)
        placed.update(order.tolist())
        share = {s: math.isqrt(blocks[s]) for s in blocks if placed[s] < blocks[s] or s in phase.own}
        if len(order) < 3000:
            assert farthest({s: Fraction(n) for s, n in share.items()}, order) < 1
    assert placed == blocks


def test_mixing_places_every_row_once(spark):
    rows = [(i % 700, f"s{min(i % 7, 3)}" if i % 11 else None, "t") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, __s string").withColumnRenamed("__s", "slot")
    weights = {"s0": 5, "s1": 1, "s3": 0.25}
    got = mixing.mix_sources(docs, weights, columns=["doc_id", "source", "slot"], block_rows=7).toPandas()
    assert sorted(got["mix_position"]) == list(range(1500))
    assert (got.groupby("mix_slot")["mix_block"].nunique() == 1).all() and got.groupby("mix_slot").size().max() <= 7
    assert (got.groupby(["source", "mix_block"], dropna=False).size() <= 7).all()
    # slots follow the phases of a simulation over the counts alone
    counts = Counter(s for _, s, _ in rows)
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    plan = mixing.phases({i: -(-counts[s] // 7) for i, s in enumerate(names)}, {i: weights.get(s, 0.25) for i, s in enumerate(names)})
    want = [names[s] for phase in plan for s in whole_order(phase)]
    assert [r.source for r in got.drop_duplicates("mix_slot").sort_values("mix_slot").replace({np.nan: None}).itertuples()] == want
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(6)
    words = [f"term{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(15, 90)))) for i in range(30)] + [(90, None), (91, "too short"), (0, "")]
    body = lambda n: rng.choices(words, k=n)
    docs, leaked = [], set()
    for i in range(60):
        text = body(rng.randrange(400))
        if i % 3 == 0:
            item = items[i % 30][1].split()
            if i % 2:  # a paraphrase: some words replaced
                item = [w if rng.random() > 0.15 else rng.choice(words) for w in item]
            text[len(text) // 2 : len(text) // 2] = item
            leaked.add(i)
        docs.append((i, " ".join(text)))
    docs += [(100, None), (101, ""), (102, "word")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.decontaminate(frame, bench).collect()}
    assert {d for d, _ in got} == leaked and all((i, i % 30) in got for i in leaked)
    small = decontamination.Settings(block_passages=8)
    assert {r["doc_id"] for r in decontamination.clean(frame, bench, frame.columns, small).collect()} == {d for d, _ in docs} - leaked
    assert decontamination.decontaminate(frame.limit(0), bench).count() == 0 and decontamination.decontaminate(frame, bench.limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("block", [1024, 7])
def test_recall_against_every_window(spark, block):
    """Recall of what a search of every window of every document by common subsequences alone finds nearly verbatim."""
    rng = random.Random(31)
    often = list(itertools.accumulate(1 / (i + 2) for i in range(900)))
    words = lambda n: rng.choices([f"t{i}" for i in range(900)], cum_weights=often, k=n)
    items = [(i, words(rng.randrange(8, 100))) for i in range(40)]
    docs = []
    for i in range(60):
        body, item = words(rng.randrange(5, 120)), rng.choice(items)[1]
        part = item[: rng.randrange(8, len(item) + 1)]
        noise = rng.choice([0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.35])
        body[len(body) // 2 : len(body) // 2] = [w if rng.random() > noise else words(1)[0] for w in part]
        docs.append((i, body))
    s = decontamination.Settings(block_passages=block)
    want = set()
    for d, body in docs:
        for i, item in items:
            for passage in decontamination.cut_passages(np.array(item), s.passage):
                if any(lcs(list(passage), body[at : at + s.window]) >= s.verbatim * len(passage) for at in range(0, max(1, len(body) - s.window + 1))):
                    want.add((d, i))
    frame = spark.createDataFrame([(d, " ".join(b)) for d, b in docs] + [(99, " ".join(items[0][1]))] * 2, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontamination.decontaminate(frame, bench, s).collect())
    assert len(want) > 30 and len(want & set(got)) >= 0.9 * len(want)
    assert got[99, 0] == 2 and max(n for (d, _), n in got.items() if d != 99) == 1  # repeated rows are reported alike


def test_verbatim_items_of_a_full_block_are_found(spark):
    rng = random.Random(12)
    words = [f"term{i}" for i in range(3000)]
    often = list(itertools.accumulate(1 / (i + 1) for i in range(3000)))
    zipf = lambda n: rng.choices(words, cum_weights=often, k=n)
    items = [(i, " ".join(zipf(rng.randrange(8, 21)))) for i in range(1024)]
    docs = [(i, " ".join([*zipf(60), text, *zipf(60)])) for i, text in items]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.decontaminate(frame, bench).collect()}
    assert not [i for i, _ in items if (i, i) not in got]


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "one two three four five six seven"), (3, "who wrote hamlet"), (4, "Paris"), (5, "?!"), (6, "lonely")]
    texts = ["He asked: who WROTE - Hamlet?", "who wrote the hamlet", "hamlet", "zero one two three four five six seven", "one two three four five six", "in Paris, wrote", "who wrote", None, "?!"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([*items, (7, " ".join(VOCABULARY[:20]))], "item_id long, text string")
    want = {(0, 1, "verbatim", 2), (0, 3, "verbatim", 2), (3, 2, "verbatim", 1), (5, 4, "verbatim", 1)}
    for some in (bench, bench.where("item_id < 7")):  # with and without longer items
        assert {(r["doc_id"], r["item_id"], r["kind"], r["start_word"]) for r in decontamination.decontaminate(frame, some).collect()} == want
    assert [r["doc_id"] for r in decontamination.clean(frame, bench, frame.columns).orderBy("doc_id").collect()] == [1, 2, 4, 6, 7, 8]


def test_common_length_by_brute_force():
    rng = random.Random(8)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = defaultdict(int)
        for k, x in enumerate(a):
            masks[x] |= 1 << k
        assert decontamination.common_length(masks, len(a), np.array(b)) == table[-1][-1]


def test_loser_tree():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark, tmp_path):
    big, rows = "é" * 600, [(1, "http://a.b/1", "x" * 999), (2, "http://A.b/1", "x" * 999), (3, "http://a.b/2?q", None), (4, None, ""), (None, "http://c\n.d/", "y" * 1500)]
    rows += [(10 + i, f"http://a.b/{i}", big) for i in range(8)] + [(17, "http://a.b/again", big), (30, "no host", "y" * 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [tuple(r) for r in warc.round_trip(pages, str(tmp_path / "w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        last = max((p for p, _, h in rows if h == html and p is not None), default=None)
        revisit = len(data) >= 1000 and page is not None and page < last
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert Counter(got) == Counter(want)
    index = warc.write_archives(pages, str(tmp_path / "v"))
    history = warc.capture_history(index, str(tmp_path / "v"), range_bytes=300)
    keys = [(r["url_key"], r["stamp"]) for r in history.collect()]
    # ranges follow the archives' bytes: no task reads them all back
    assert history.rdd.getNumPartitions() > 8 and max(history.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= len(rows) // 2
    assert keys == sorted(keys) and len(keys) == len(rows) and warc.round_trip(pages.limit(0)).count() == 0


def labelled(rng):
    docs, labels = [], []
    for i in range(1500):
        toxic, junk = i % 5 == 0, i % 4 == 0
        words = prose(rng, 60) + (rng.choices(["vile", "rotten", "stinker"], k=3) if toxic else [])
        rng.shuffle(words)
        docs.append((i, " ".join(w + ("###" if junk else "") for w in words), "en"))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return docs + [(9000, None, "en"), (9001, "", "en"), (9001, "", "en"), (None, "x", "en")], labels + [(None, 1, 1), (1, None, None)]


@pytest.mark.parametrize(("run", "column", "modulus", "rest"), [(toxicity.toxicity, "toxic", 3, 1), (quality_model.quality_model, "quality", 4, 2)])
def test_classifiers_on_held_out_rows(spark, run, column, modulus, rest):
    docs, labels = labelled(random.Random(10))
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = run(frame, marks).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    truth = {i: (t if column == "toxic" else q) for i, q, t in labels[:1500]}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert run(frame.limit(0), marks).count() == 0
    assert all(r["score"] < 1e-6 for r in run(frame, marks.limit(0)).collect())
