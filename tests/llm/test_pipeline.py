"""The pipeline over planted documents: what goes, what stays, and that the stages take odd tables."""

import random
from pathlib import Path

import corpus_pipeline

VOCABULARY = [f"word{i}" for i in range(500)]


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choices(VOCABULARY, k=n))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, prose(80) + (" vile rotten stinker" if toxic else ""), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    base, item = prose(100).split(), prose(30)
    rows += [(1000 + i, " ".join(base[:50] + [f"x{i}"] + base[51:]), "en", "s0", 0) for i in range(5)]
    rows += [(2000, prose(50) + " " + item + " " + prose(50), "en", "s1", 0), (3000, prose(40) + " token = abcdef123456", "en", None, 0), (None, None, None, None, None), (3001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    last = corpus_pipeline.run(spark, str(tmp_path))
    [folder] = {Path(f.removeprefix("file:")).parents[1] for f in last.inputFiles()}
    assert [p.name for p in folder.iterdir()] == ["mixing"]  # earlier stages' tables are gone
    out = last.toPandas()
    ids = set(out["doc_id"].dropna().astype(int))
    assert ids == {i for i in range(400) if i % 4} | {1000, 3000, 3001} and len(out) == len(ids) + 1
    assert out[out["doc_id"] == 3000]["text"].str.endswith(" [secret]").all()
    assert sorted(out["mix_position"]) == list(range(len(out)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "mixing"]
