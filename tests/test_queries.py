"""Every registered query of the engine against its SQL, and its independence of how rows are dealt out."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from pagewright import queries as engine

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(frame):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, [tuple(map(cell, r)) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None)]))


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    assert rows(engine.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(engine.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_runs_twice_alike(spark, name):
    first = engine.QUERIES[name](spark, DATA).toPandas()
    assert len(first.columns) and rows(first) == rows(engine.QUERIES[name](spark, DATA).toPandas())


def test_entry_has_rows(spark):
    assert engine.site_repetition(spark, DATA).count() > 0


def test_shared_preamble_by_brute_force(spark, tmp_path):
    long, other = "öpening " * 700, "another " * 100
    sites = {"a": [long + f"{i}" for i in range(3)] + [long[:4000] + "x" * i for i in range(2)] + ["short", None], "b": [other + f"{i}" for i in range(5)], "c": [other] * 3, None: [long] * 2 + [other] * 2, "d": ["y" * 399 + f"{i}" for i in range(6)], "e": [long + "z" * 99] + [other] * 9}
    docs = [(100 * k + i, site, text) for k, (site, texts) in enumerate(sites.items()) for i, text in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for site, texts in sites.items():
        texts = [t or "" for t in texts]
        longest = max(texts, key=len)
        end = max(k for k in range(len(longest) + 1) if 2 * sum(t.startswith(longest[:k]) for t in texts) >= len(texts))
        found = longest[:end] if len(texts) >= 4 and end >= 400 else None
        want[site] = (found, sum(t.startswith(found) for t in texts) if found else 0)
    assert len(want["a"][0]) > 3000 and want["e"][0] is None
    assert {r["site_id"]: (r["preamble"], r["pages"]) for r in engine.QUERIES["shared_preamble"](spark, str(tmp_path)).collect()} == want
