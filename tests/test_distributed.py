"""As-of joins, medians, robots rules and name groups against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright import queries as engine
from pagewright.operators import asof, medians, robots, runs

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_as_of(spark, stretch):
    rng = random.Random(stretch)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 60)])) for i in range(300)] + [(1, "a", 5)]
    right = [(rng.choice(["a", "b", None, "c"]), rng.choice([None, *range(-40, 60, 3)]), i, f"v{i}" if i % 5 else None) for i in range(90)]
    got = asof.as_of(spark.createDataFrame(left, "id int, key string, at int").repartition(3), spark.createDataFrame(right, "key string, at int, n int, v string"), ["key"], "at", "n", ["v", "n"], stretch)
    want = []
    for i, key, at in left:
        best = max(((r[1], r[2], r[3]) for r in right if at is not None and r[0] == key and r[1] is not None and r[1] <= at), default=None)
        want.append((i, key, at, None if best is None else (best[2], best[1])))
    assert sorted(((r["id"], r["key"], r["at"], r["found"] and tuple(r["found"])) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_ua_probes(spark):
    rows = [
        ("s", 1, 10, None, "http://s/x", 200, None, None), ("s", 2, 11, "GPTBot", "http://s/x/", 403, "<meta name='robots' content='noindex'>", "noarchive"), ("s", 3, 12, None, "http://s/x", None, None, None),
        ("s", 4, 13, "GPTBot", "http://s/x", 200, "<meta property=robots content=x>", None), ("s", 5, 9, "PerplexityBot", "http://s/x", 403, None, None), ("s", 6, 14, "OAI-SearchBot", "http://s/no", 429, "x", "y"), ("s", 7, 15, "OtherBot", "http://s/x", 403, None, None),
    ]
    files = spark.createDataFrame([("s", "User-agent: *\nDisallow: /no")], "site_id string, body string")
    fetches = spark.createDataFrame(rows, "site_id string, fetch_id int, at int, token string, url string, status int, body string, x_robots_tag string")
    got = {r["fetch_id"]: r for r in asof.ua_probes(fetches, robots.robots_rows(files)).collect()}
    assert set(got) == {2, 4, 5, 6}
    assert (got[2]["differential"], got[2]["robots_meta"], got[2]["x_robots_tag"], got[2]["browser_at"]) == ("browser 200 / bot-UA 403", "noindex", "noarchive", 10)
    assert (got[4]["differential"], got[4]["robots_meta"], got[4]["browser_status"]) == (None, None, 200) and (got[5]["differential"], got[5]["browser_status"]) == (None, None)
    assert (got[6]["robots_allows"], got[6]["status"], got[6]["x_robots_tag"]) == (False, None, None)


@pytest.mark.parametrize("span", [1, 50, 5000, 10**12, 2**63 - 1])
def test_exact_median(spark, monkeypatch, span):
    monkeypatch.setattr(medians, "DIGIT", 5 if span < 10**6 else 12)
    rng = random.Random(span)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-span, span) if rng.random() < 0.95 else None) for _ in range(400)] + [("one", 7), ("two", -3), ("two", 4), ("none", None), ("same", span), ("same", span)]
    values = defaultdict(list)
    for k, v in rows:
        if v is not None:
            values[k].append(v)
    want = {}
    for k, vs in values.items():
        vs.sort()
        want[k] = (len(vs), (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) // 2, vs[0], vs[-1])
    got = medians.exact_median(spark.createDataFrame(rows, "k string, v long").repartition(3), "k", "v")
    assert {r["k"]: (r["n"], r["median"], r["least"], r["most"]) for r in got.collect()} == want
    assert medians.exact_median(spark.createDataFrame([], "k string, v long"), "k", "v").count() == 0


@pytest.mark.parametrize("anchored", [True, False])
def test_robots_rules_by_brute_force(spark, anchored):
    rng = random.Random(4)
    ways = ["/", "/a", "/a/", "/a/b", "/a/b$", "/ab*", "*", "/a*$", "$", "/b$x", "/c**", " /a ", ""]
    rows = [(s, 1, 1, t, rng.sample(ways, 5), rng.sample(ways, 4)) for s in "xyz" for t in ("*", "gptbot") if (s, t) != ("z", "gptbot")]
    paths = [(s, p) for s in "xyzw" for p in ("/", "/a", "/a/", "/a/b", "/a/bc", "/ab", "/abc", "/b", "/b$x", "/c*", "/a*", "")]
    tokens = [(s, t) for s in "xyzw" for t in ("GPTBot", "bing")]
    frame = spark.createDataFrame(rows, "site_id string, grp int, ord int, token string, disallow array<string>, allow array<string>")
    got = robots.decide_paths(spark.createDataFrame(paths, "site_id string, path string"), frame, spark.createDataFrame(tokens, "site_id string, token string"), anchored)

    def start(rule):
        if not anchored:
            return rule.split("$")[0].rstrip("*"), False
        r = rule.strip(" ")
        return (r[:-1], True) if r.endswith("$") else (r.rstrip("*"), False)

    want = {}
    for s, token in tokens:
        mine = [r for r in rows if r[0] == s and r[3] == token.lower()] or [r for r in rows if r[0] == s and r[3] == "*"]
        for p in [p for t, p in paths if t == s]:
            best = None
            for r in mine:
                for rule, first in [(x, 1) for x in r[4]] + [(x, 0) for x in r[5]]:
                    body, exact = start(rule)
                    if (anchored and not rule.strip(" ")) or not (p == body if exact else p.startswith(body)):
                        continue
                    size = len(rule.strip(" ").rstrip("*").rstrip("*$")) if anchored else len(body)
                    best = max(best or (-1, -1, ""), (size, first, rule))
            want[s, token, p] = (best[2] if best else None, bool(best and best[1]))
    assert {(r["site_id"], r["token"], r["path"]): (r["rule"], r["blocked"]) for r in got.collect()} == want


def plain_groups(rows):
    stop = {"the", "and", "of", "a", "an", "to", "for", *"inc llc ltd gmbh corp corporation co company limited llp bv ag sa sas pty foundation nonprofit".split()}
    telling = lambda ts: {t for t in ts if len(t) >= 3 and not t.isdigit()}
    out = {}
    for site in {r[0] for r in rows}:
        groups = []
        for _, at, value in sorted((r for r in rows if r[0] == site), key=lambda r: r[1]):
            tokens = {t for t in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in value.lower()).split()} - stop
            if tokens:
                fit = [i for i, g in enumerate(groups) if g <= tokens or tokens <= g or telling(g) & telling(tokens)]
                if not fit:
                    groups.append(tokens)
                out[site, at] = fit[0] + 1 if fit else len(groups)
    return out


def test_name_groups_by_brute_force(spark):
    rng = random.Random(8)
    words = ["acme", "zeta", "bolt", "x", "yy", "12", "345", "the", "of", "delta", "Omega!", "q1"]
    for size in (1, 2, 3):
        rows = [(s, i, " ".join(rng.choices(words, k=rng.randrange(size + 1)))) for s in "ab" for i in rng.sample(range(1000), 60)]
        rows += [("chain", i, f"n{i:03d} n{i + 1:03d}") for i in range(12)]  # each waits for the one before
        got = runs.name_groups(spark.createDataFrame([(s, i, "t", v) for s, i, v in rows], "site_id string, ord long, surface string, value string").repartition(3))
        assert {(r["site_id"], r["ord"]): r["grp"] for r in got.collect()} == plain_groups(rows)


def test_names_of_tables_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("source", "doc_id", F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " "), 1, 3), " ")).collect()
    assert {(r["site_id"], r["ord"]): r["grp"] for r in engine.QUERIES["name_groups_documents"](spark, DATA).collect()} == plain_groups([tuple(r) for r in docs])
    keys = spark.read.parquet(f"{DATA}/customer.parquet").select("c_mktsegment", "c_custkey").collect()
    named = [(s, k, " ".join(([f"Shop{k % 300 // 10}"] if k % 300 % 2 == 0 else []) + [str(k % 300 % 7), str(k % 300 % 11)])) for s, k in keys]
    assert {(r["site_id"], r["ord"]): r["grp"] for r in engine.QUERIES["name_groups_customers"](spark, DATA).collect()} == plain_groups(named)
