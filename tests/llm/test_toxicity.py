"""The factorization machine against a double loop, what its pairs are for, and that nothing held out is looked at."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import toxicity as T
from pagewright.llm.common import held_out


def test_margins_by_brute_force():
    rng = np.random.default_rng(1)
    machine = T.Machine(np.zeros(0, np.int32), rng.normal(size=30), rng.normal(size=(30, 4)), 0.3)
    sets = [sorted(rng.choice(30, size=n, replace=False).tolist()) for n in (0, 1, 2, 7, 30)]
    docs, terms = np.repeat(np.arange(5), [len(s) for s in sets]), np.array([t for s in sets for t in s], np.int64)
    for got, own in zip(machine.margins(docs, terms, 5), sets, strict=True):
        pairs = sum(float(machine.v[a] @ machine.v[b]) for i, a in enumerate(own) for b in own[i + 1 :])
        assert math.isclose(got, 0.3 + sum(machine.w[t] for t in own) + pairs, abs_tol=1e-9)


def test_pairs_find_what_no_weight_does():
    """Toxic is an insult with a mention; either alone is as common in clean texts, so that weights say nothing."""
    rng = np.random.default_rng(2)
    rows = [(a, b, int(a and b)) for a in (0, 1) for b in (0, 1) for _ in range(300)] + [(0, 0, 0)] * 300
    rng.shuffle(rows)
    sets = [[10 + i for i, on in enumerate((a, b)) if on] + [20 + int(rng.integers(5))] for a, b, _ in rows]
    terms, sizes, y = np.array([t for s in sets for t in s]), np.array([len(s) for s in sets]), np.array([r[2] for r in rows], float)
    machine = T.fit(terms, sizes, y, [10, 11, 20, 21, 22, 23, 24], epochs=60)
    at = machine.lookup[[10, 11]]
    assert float(machine.v[at[0]] @ machine.v[at[1]]) > 1
    margin = lambda s: machine.margins(np.zeros(len(s), np.int64), machine.lookup[s], 1)[0]
    assert margin([10, 11, 20]) > 0 > max(margin([10, 20]), margin([11, 20]), margin([20]))


def test_cross_validation_uses_learnable_rows_only(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"word{k}" for k in range(60)], k=30)) + (" vile rotten" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    ids = {r["doc_id"] for r in docs.where(~held_out(F.col("doc_id"), *T.HELD_OUT)).collect()}
    seen = []
    train = T.train
    monkeypatch.setattr(T, "train", lambda d, known, **how: seen.append({r["doc_id"] for r in known.collect()}) or train(d, known, **how))
    [(lift, found, flagged)] = T.cross_validated(docs, docs.select("doc_id", "toxic"), (5.0,))
    assert set.union(*seen) == ids and sum(len(ids - s) for s in seen) == len(ids)
    assert lift == 5.0 and found >= 0.9 * sum(i % 4 == 0 for i in ids) and flagged <= 2
