"""Anchorable runs and running totals against plain loops."""

import random
from collections import Counter, defaultdict

from pagewright.operators import runs as N


def plain_runs(rows, per_page, least, longest, budget, most_shared):
    pages, on = defaultdict(list), defaultdict(set)
    for site, page_id, page_ord, _, text in sorted(rows):
        text = " ".join(text.split())
        if least <= len(text) <= longest:
            on[site, text].add(page_id)
            if text not in pages[site, page_ord]:
                pages[site, page_ord].append(text)
    ids = {(r[0], r[2]): r[1] for r in rows}
    out = []
    for site in {r[0] for r in rows}:
        left, taken = budget, []
        ranked = sorted((-len(p), -len(t), t) for (s, t), p in on.items() if s == site and len(p) > 1)
        for _, _, t in ranked:
            if len(taken) < most_shared and budget - left + len(t) <= budget // 3:
                taken.append((None, t))
                left -= len(t)
        shared = {t for _, t in taken}
        for (s, o), texts in sorted(pages.items()):
            if s == site:
                rest = [t for t in texts if t not in shared]
                for t in sorted(rest, key=lambda t: (len(on[site, t]), -len(t)))[:per_page]:
                    if len(t) > left:
                        break
                    taken.append((ids[s, o], t))
                    left -= len(t)
        out += [(site, p, t, len(t), len(on[site, t]), k) for k, (p, t) in enumerate(taken, 1)]
    return Counter(out)


def test_anchorable_runs(spark):
    rng = random.Random(6)
    words = ["alpha", "be", "gamma", "delta epsilon", "x"]
    for budget in (60, 200, 900):
        rows = [(s, 100 * k + p, p, b, " ".join(rng.choices(words, k=rng.randrange(1, 9))) + " " * (b % 2)) for k, s in enumerate("abc") for p in range(25) for b in range(rng.randrange(6))]
        how = dict(per_page=3, least=6, longest=40, budget=budget, most_shared=4)
        got = N.anchorable_runs(spark.createDataFrame(rows, "site_id string, page_id long, page_ord long, block_ord long, text string").repartition(5), **how)
        assert Counter(tuple(r) for r in got.select("site_id", "page_id", "text", "chars", "pages", "ord").collect()) == plain_runs(rows, **how)


def test_running_total(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(5)) for i in range(-50, 300)]
    got = {(r["k"], r["i"]): r["before"] for r in N.running_total(spark.createDataFrame(rows, "k string, i long, v int"), "k", "i", N.F.col("v"), stretch=16).collect()}
    for k in ("a", "b", None):
        own = [(i, v) for c, i, v in rows if c == k]
        for n, (i, _) in enumerate(own):
            total = sum(v for _, v in own[:n])
            assert got[k, i] in ((None, 0) if total == 0 else (total,))
        assert got[k, own[0][0]] is None
