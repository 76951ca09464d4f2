import gzip
import time

from pagewright.sources import files as S
from pagewright.streaming import captures as C


def test_json_with_broken_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}')
    (tmp_path / "b.json").write_text('{"k": ')
    good, broken = S.read_json(spark, str(tmp_path), "k long")
    assert good.count() == 1 and broken.first()["_path"].endswith("b.json")


def test_json_lines_and_lists(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": \n{"k": 2, "other": 3}\n"text"\n')
    good, broken = S.read_json(spark, str(tmp_path / "a.jsonl"), "k long, name string", lines=True)
    assert sorted(r["k"] for r in good.collect()) == [1, 2] and sorted(r["_corrupt"] for r in broken.collect()) == ['"text"', '{"k": ']
    (tmp_path / "b.json").write_text('[{"k": 5},\n {"name": "x"}]')
    (tmp_path / "c.json").write_text(" ")
    good, broken = S.read_json(spark, str(tmp_path / "[bc].json"), "k long, name string")
    assert {(r["k"], r["name"]) for r in good.collect()} == {(5, None), (None, "x")} and broken.count() == 1


def test_latest_file(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    time.sleep(1.1)
    (tmp_path / "b.json").write_text("{}")
    assert S.latest_file(spark, f"{tmp_path}/*.json").endswith("b.json")


def test_truncated_gzip_and_content_types(spark):
    whole = gzip.compress(b"<p>" + bytes(range(48, 120)) * 500)
    assert S.salvage_gzip(whole)[:3] == b"<p>" and S.salvage_gzip(whole[: len(whole) // 2])[:3] == b"<p>"
    rows = [(1, whole[: len(whole) // 2], "gzip", "text/html"), (2, b"\x00", None, "image/png"), (3, b"<p>", None, None), (4, None, None, "text/html")]
    got = {r["page_id"]: r["html"] for r in S.decode_bodies(spark.createDataFrame(rows, "page_id long, body binary, content_encoding string, content_type string")).collect()}
    assert got[1].startswith("<p>") and got[2] is None and got[3] == "<p>" and got[4] is None


def test_sitemaps(spark):
    xml = '<?xml version="1.0"?><urlset xmlns="x"><url><loc> https://a/1 </loc><lastmod>2024</lastmod></url><url><loc>https://a/2</loc></url></urlset>'
    maps, entries = S.parse_sitemaps(spark.createDataFrame([("a", "u", 200, xml), ("b", "u", 200, "<urlset><url>"), ("c", "u", 200, None)], "site_id string, url string, http_status int, xml string"))
    assert {r["site_id"]: r["parse_ok"] for r in maps.collect()} == {"a": True, "b": False, "c": False}
    assert [(r["url"], r["lastmod"]) for r in entries.orderBy("ord").collect()] == [("https://a/1", "2024"), ("https://a/2", None)]


def test_capture_stream(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    line = '{{"page_id": {0}, "url": "http://a.example/{0}", "html": "x", "status": 200, "timing_ms": {1}, "captured_at": "2026-01-01T00:0{0}:00Z"}}\n'
    (source / "1.json").write_text(line.format(1, 10) * 2 + line.format(2, 30))
    query = C.keep_latest(C.read_captures(spark, str(source)), table, str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    version = C.latest_version(spark, table)
    assert spark.read.parquet(f"{table}/{version}").count() == 2
    query = C.fetch_windows(C.read_captures(spark, str(source))).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["fetches"], r["failures"], r["mean_ms"]) for r in spark.table("windows").collect()] == [(2, 0, 20.0)]
