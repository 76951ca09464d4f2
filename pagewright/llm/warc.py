"""WARC archives with an external index merge.

Pages become WARC/1.1 records, gzipped one by one. Payloads of at least `least_revisit` bytes that are equal are stored once:
the capture with the largest page_id is the response, the others are revisits. Each task sorts its captures by URL key and
timestamp and writes one archive, a locally sorted run, and the run's index entries. The entries are dealt to ranges of the key
space, as many as the archives' bytes ask for, so a range's records, and with them its entries, are bounded however large the
archives are, and equal keys may be split. Spark's own external sort lines a range's entries up run by run in the order of their
offsets, which is the order of the run; they are kept as columns, and a loser tree merges the runs, each by a cursor that unpacks a
few entries at a time, into one ordered capture history. Entries travel, not run files: a table of stretches, one for every run and
range, would outgrow them with many runs. Records are read back through that history by offset, and every payload is checked against
its digest.

Archives lie in the shared folder, and those of a folder that the operator chose itself are removed when the process ends. A task that is run again writes a file of its own; only files that the index names are read.

Defined cases: null html is an empty payload; a null url has an empty key and no target header; a row with a null page_id is
always a response and refers to none; of repeated rows with the largest page_id each is a response; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, in_arrow, scratch

LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "url_key string, stamp string, page_id long, file string, start long, size long"
#: Records that are fetched and held at once, and entries that a cursor unpacks.
FETCH, UNPACK = 256, 64
#: Bytes of archive whose records one range holds, about.
RANGE_BYTES = 64 << 20


def url_key(url: Column) -> Column:
    """Host labels reversed, then path and query: captures of a site sort together."""
    host = F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)
    rest = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1), F.lit(""))
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)


def stamp_of(page_id: Column) -> Column:
    """A 14-digit capture time, made from the page id as the table has none."""
    return F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.coalesce(F.pmod(page_id, F.lit(1_000_000_000)), F.lit(0))), "yyyyMMddHHmmss")


class LoserTree:
    """A k-way merge: each inner node keeps the loser of its match, so the next least item costs log2(k) comparisons."""

    def __init__(self, runs: Sequence[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads: list = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) or (x is not None and y is not None and (x, a) < (y, b))

    def _play(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at > 0:
            if self.tree[at] == -1:
                self.tree[at] = winner
                return
            if self._before(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (item := self.heads[self.tree[0]]) is not None:
            winner = self.tree[0]
            yield item
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, stamp: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzipped record; a revisit keeps the HTTP head, with the full payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode() + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one gzipped record; field names in lower case."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length does not fit its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, payload


def write_archives(pages: DataFrame, folder: str, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write every page; the index entries, kept in the checkpoint folder so that nothing is written twice."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    large = rows.where(F.col("bytes") >= least_revisit)
    last = large.groupBy(F.col("digest").alias("d"), F.col("bytes").alias("b")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("d", "b", "last")
    rows = rows.join(last, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    rows = rows.select("page_id", "url", "html", "digest", refers.alias("refers_to"), url_key(F.col("url")).alias("url_key"), stamp_of(F.col("page_id")).alias("stamp"))
    rows = rows.sortWithinPartitions("url_key", "stamp", "page_id")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"run-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                where.create_dir(base, recursive=True)
                out = where.open_output_stream(f"{base}/{name}", compression=None)
            entries = []
            for i in range(batch.num_rows):
                page, url, page_html, digest, refers_to, key, stamp = (batch.column(c)[i].as_py() for c in range(7))
                data = record(page, url, stamp, page_html.encode(), digest, refers_to)
                out.write(data)
                entries.append((key, stamp, page, name, at, len(data)))
                at += len(data)
            cells = list(zip(*entries, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["url_key", "stamp", "page_id", "file", "start", "size"])
        if out is not None:
            out.close()

    return cut(rows.transform(in_arrow, emit, INDEX))


def cursor(entries: list[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str, int, int], int | None, str, int]]:
    """(order, page_id, file, size) of a run's entries, unpacked a few at a time."""
    for batch in entries:
        for at in range(0, batch.num_rows, UNPACK):
            for key, stamp, page, file, start, size in zip(*(c.to_pylist() for c in batch.slice(at, UNPACK).columns), strict=True):
                yield (key, stamp, -1 if page is None else page, start), page, file, size


def capture_history(index: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record, in global order of URL key, timestamp and page id, read back from its archive."""
    total = index.agg(F.sum("size")).first()[0] or 0
    ranges = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    ranged = index.repartitionByRange(ranges, "url_key", "stamp", F.coalesce("page_id", F.lit(-1)), "file", "start").sortWithinPartitions("file", "start")
    schema = "url_key string, stamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[pa.RecordBatch]] = []
        last = None
        for batch in batches:
            file = batch.column("file").dictionary_encode()
            names, codes = file.dictionary.to_pylist(), file.indices.to_numpy()
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else codes
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True):
                if names[codes[a]] != last:
                    last = names[codes[a]]
                    runs.append([])
                runs[-1].append(batch.slice(a, b - a))
        where, base = fs.FileSystem.from_uri(folder)
        merged = LoserTree([cursor(r) for r in runs])
        held: list = []

        def fetched() -> pa.RecordBatch:
            got = {}
            for file in sorted({h[2] for h in held}):
                with where.open_input_file(f"{base}/{file}") as source:
                    for h in sorted((h for h in held if h[2] == file), key=lambda h: h[0][3]):
                        source.seek(h[0][3])
                        got[file, h[0][3]] = source.read(h[3])
            rows = [(h[0][0], h[0][1], *read_capture(got[h[2], h[0][3]])) for h in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["url_key", "stamp", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for entry in merged:
            held.append(entry)
            if len(held) >= FETCH:
                yield fetched()
        if held:
            yield fetched()

    return ranged.transform(in_arrow, emit, schema)


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def read_capture(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, record type, refers to) of a stored record; a response's payload is checked."""
    fields, http, payload = parse_record(data)
    size, digest, kind = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['warc-record-id']}: the payload does not fit its digest")
    refers = fields.get("warc-refers-to")
    return _page(fields["warc-record-id"]), size, digest, kind, None if refers is None else _page(refers)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, stamp of every page, through the archives."""
    folder = folder or scratch(pages.sparkSession, "warc")
    history = capture_history(write_archives(pages, folder), folder)
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp")


def oracle() -> str:
    host = f"translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    return f"""
with p as (select *, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
q as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) end as last from p)
select page_id, payload_bytes, payload_digest, case when page_id < last then 'revisit' else 'response' end as record_type,
       case when page_id < last then last end as refers_to,
       array_to_string(list_reverse(string_split({host}, '.')), ',') || ')' || coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1), '') as url_key,
       strftime(to_timestamp(1577836800 + coalesce(page_id % 1000000000, 0)) at time zone 'UTC', '%Y%m%d%H%M%S') as stamp
from q"""
