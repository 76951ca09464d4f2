"""Passages by brute force: anchors, sentence bounds, containment joins."""

import random
import re

from pyspark.sql import functions as F

from pagewright.operators import passages as P
from pagewright.operators.containment import contained

MARK = re.compile(r"[.!?][\"'”’]?(?=\s|$)")


def brute_bounds(text, start, stop, longest):
    before = lambda n: max([0, *(m.end() for m in MARK.finditer(text[:n]))])
    after = [stop + m.end() for m in MARK.finditer(text[stop:])]
    first, last = before(start), after[0] if after else len(text)
    if last - first > longest:
        reach = min(len(text), max(stop, start + longest))
        inside = [stop + m.end() for m in MARK.finditer(text[stop:reach])]
        last = inside[-1] if inside else reach
        first = before(min(start, max(0, last - longest)))
    return first, min(max(last, stop), len(text))


def test_sentence_bounds_by_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        text = "".join(rng.choice(["word ", "a. ", 'b!" ', "v3.2 ", "?", "\n", "é ", "” ", "😀. "]) for _ in range(rng.randrange(1, 40)))
        start = rng.randrange(len(text))
        rows.append((i, text, start, rng.randrange(start + 1, len(text) + 1)))
    frame = spark.createDataFrame(rows, "i int, text string, start int, stop int")
    got = frame.select("i", P.sentence_bounds(F.col("text"), F.col("start"), F.col("stop"), 40).alias("b")).select("i", "b.*").collect()
    assert {r["i"]: (r["from"], r["to"]) for r in got} == {i: brute_bounds(t, a, b, 40) for i, t, a, b in rows}


def test_cut_passages(spark):
    rows = [("a", "two three", "One. So two  three it is. End."), ("b", "gone", "Nothing here."), ("c", "", "x"), ("d", None, "x"), ("e", "x.y\\E", "A x.y\\E b"), ("f", "v3.2 now.", "Old. Get v3.2 now. More.")]
    got = {r["question_id"]: r["passage"] for r in P.cut_passages(spark.createDataFrame(rows, "question_id string, anchor string, run string")).collect()}
    assert got == {"a": "So two  three it is.", "b": None, "c": None, "d": None, "e": "A x.y\\E b", "f": "Get v3.2 now. More."}


def test_containment_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["ab", "bab", "a", "cabin", "bin", "no", "nob", "é", "xyz"]
    texts = [(i, i % 3, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 25)))) for i in range(120)] + [(7, 1, None), (None, 0, "cabin bin no")]
    texts += [texts[3], texts[3]]
    phrases = [(200, ""), (201, None), (202, "bi"), (203, "n no")]
    for i in range(60):
        text = rng.choice([t for *_, t in texts if t and len(t) > 4])
        a, b = sorted(rng.sample(range(len(text) + 1), 2))
        phrases.append((i, text[a:b].strip()))
    frame = spark.createDataFrame(phrases, "q int, want string")
    got = contained(frame, "want", spark.createDataFrame(texts, "page long, ord int, text string").distinct(), ["page", "ord"], "text")
    want = {(q, w, *t) for q, w in phrases for t in texts if w and t[2] is not None and w in t[2]}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
