"""Nulls, very long texts, repeated rows, ties, empty tables and clashing names, for every operator and stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import decontamination, jaccard_join, mixing, periodic_runs, quality_model, quality_rules, secret_scan, simhash, substring_dedup, toxicity, url_filters, warc

#: Names that operators use inside.
INNER = ("doc", "spans", "anchor", "node", "class", "gone", "__gone", "__score", "score", "base", "cand", "added", "row", "block", "words", "text_key", "__c0", "__s", "mix_slot", "key", "alias", "digest", "last", "d", "a.b", "TERMS")


def odd_docs(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(n))
    long = prose(60000)
    rows = [(1, long, "en", "s"), (2, long, "en", "s"), (3, None, None, None), (4, "", "de", ""), (5, prose(50), "en", "s"), (5, prose(50), "en", "t"), (None, prose(40), "en", "t"), (None, None, "en", "t")]
    rows += [(6, "same words here", "en", "s")] * 3 + [(7, "a " * 5000, "en", "s"), (8, "x" * 300000, "en", "s"), (9, " \n\t ", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in INNER:
        docs = docs.withColumn(name, F.lit(f"{name}!"))
    return docs.withColumn("n_chars", F.length("text").cast("long")).repartition(3)


@pytest.fixture(scope="module")
def tables(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").withColumn("label", F.lit("x"))
    bench = spark.createDataFrame([(1, "same words here"), (1, "same words here"), (2, None), (3, ""), (4, " ".join(f"q{i}" for i in range(4000)))], "item_id long, text string").withColumn("seq", F.lit("x"))
    return docs, labels, bench


OPERATORS = {
    "op1": lambda d, labels, b: quality_rules.quality_rules(d),
    "op2": lambda d, labels, b: mixing.mix_sources(d, columns=d.columns),
    "op3": lambda d, labels, b: jaccard_join.jaccard_join(d, 3, 90),
    "op5": lambda d, labels, b: quality_model.quality_model(d, labels),
    "op6": lambda d, labels, b: substring_dedup.substring_dedup(d),
    "op8": lambda d, labels, b: toxicity.toxicity(d, labels),
    "op10": lambda d, labels, b: secret_scan.secret_scan(d),
    "op11": lambda d, labels, b: periodic_runs.periodic_runs(d, d.columns),
    "op13": lambda d, labels, b: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(tables, name):
    docs, labels, bench = tables
    got = OPERATORS[name](docs, labels, bench)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.collect()
    assert len(rows) == docs.count()
    alike = {tuple(sorted((k, repr(v)) for k, v in r.asDict().items() if not k.startswith("mix_"))) for r in rows if r["doc_id"] == 6}
    assert len(alike) == 1  # repeated rows are treated alike
    assert OPERATORS[name](docs.limit(0), labels, bench).count() == 0


def test_leaks_of_odd_rows(tables):
    docs, _, bench = tables
    got = [(r["doc_id"], r["item_id"]) for r in decontamination.decontaminate(docs, bench).collect()]
    assert got == [(6, 1)] * 3
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0 and decontamination.decontaminate(docs, bench.limit(0)).count() == 0


def test_odd_pages(spark):
    long = "<p>" + "word " * 100000 + "</p>"
    rows = [(1, "http://a.com/en/1", long), (2, "http://a.com/en/1", long), (2, "http://a.com/en/1", long), (3, None, None), (None, None, long), (4, "://", ""), (5, "http://b.org/" + "../" * 300 + "es", "<link rel=canonical href='" + "../" * 2000 + "x'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in (*INNER, "host", "path", "rule", "own", "base", "tag", "to", "u", "v", "file", "start", "size", "stamp", "url_key"):
        pages = pages.withColumn(name, F.lit("x"))
    judged = url_filters.url_filter(pages).collect()
    assert len(judged) == len(rows) and {r["verdict"] for r in judged if r["page_id"] in (1, 2)} == {"block"}
    stored = warc.round_trip(pages).collect()
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in stored) == [(0, "response"), (1, "revisit"), (2, "response"), (2, "response"), (3, "response"), (4, "response"), (5, "response")]
    assert url_filters.url_filter(pages.limit(0)).count() == 0 and warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, tables, tmp_path, name):
    docs, labels, bench = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    for frame in (docs, docs.limit(0)):
        out = stage(spark, frame, str(tmp_path))
        made = [c for c in out.columns if c.startswith("mix_")]
        assert [c for c in out.columns if c not in made] == [c for c in frame.columns if c not in made]
        out.write.mode("overwrite").parquet(f"{tmp_path}/out")
        assert spark.read.parquet(f"{tmp_path}/out").count() <= frame.count()


def test_first_split_by_brute_force():
    """The root of a tree of one level is the split of the largest gain over all features and limits, ties to the first."""
    rng = np.random.default_rng(3)
    for seed in range(5):
        x = np.round(rng.normal(size=(300, 4)), 1)
        y = (x[:, seed % 4] + rng.normal(size=300) / 2 > 0.3).astype(float)
        got = quality_model.grow(x, y, trees=1, depth=1, bins=64, ridge=1.0, least=8)
        p = y.mean()
        g, h = p - y, np.full(300, p * (1 - p))
        best = (0.0, None)
        for j in range(4):
            for limit in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 64)[1:-1])):
                left = x[:, j] <= limit
                if 8 <= left.sum() <= 292:
                    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
                    gain = score(left) + score(~left) - g.sum() ** 2 / (h.sum() + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, (j, limit))
        root = got.roots[0]
        assert (int(got.feature[root]), float(got.limit[root])) == (best[1][0], float(best[1][1]))
        left = x[:, best[1][0]] <= best[1][1]
        for side, child in ((left, got.left[root]), (~left, got.right[root])):
            assert abs(got.value[child] + 0.2 * g[side].sum() / (h[side].sum() + 1)) < 1e-9
