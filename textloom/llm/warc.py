"""WARC archives: writing, reading, and a capture index merged from sorted runs.

Writing: one record for each page, each a gzip member of its own, gathered to archives of about ``ARCHIVE_BYTES`` that
begin with a warcinfo record and end with an empty member. Spark's own text writer puts each archive out as a file (its
bytes as they are, the empty member for a line end), so any store Spark writes to will do and a lost task leaves no half
file. Pages whose payload equals that of a page with a smaller id become revisit records without a payload. Reading:
every archive is parsed again, payload digests are recomputed, and each archive's captures leave as one run sorted by
(URL key, timestamp, page id), with the place of their member in the file, by which a record is opened alone. Ranges of
that key are then merged: each task takes its range of all runs, as Arrow batches, and merges them k ways with a loser
tree that turns a block of rows at a time into Python objects, which gives a globally ordered capture history. A hot
host is only many keys, so ranges split it; there are as many ranges as keep each at about ``RANGE_ROWS``.

Null html is the empty payload. Rows with the smallest page_id of a payload are all responses, also if repeated. A null
page_id is read back as null and sorts first. Null urls have the empty URL key. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import pick, sized
from textloom.session import Workspace, ship_package

#: Fixed by the WARC 1.1 format.
VERSION, END, REVISIT = "WARC/1.1", "\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Seconds since 1970 of the capture of page 0; page n is n seconds later.
CAPTURE_EPOCH = 1_704_067_200
#: Compressed bytes at which an archive is closed, rows of a range of the index, and rows of a run that a merge holds as objects.
ARCHIVE_BYTES, RANGE_ROWS, ROWS_AT_ONCE = 8 << 20, 500_000, 256
URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", re.S)


def url_key(url: str | None) -> str:
    """Host parts in reverse order, then path and query, in lower case: neighbours in a site sort together."""
    url = (url or "").strip()
    if not (m := URL.match(url)):
        return url.lower()
    host = re.sub(r"^www\.", "", re.sub(r":(80|443)?$", "", m[1].lower()))
    return ",".join(reversed(host.split("."))) + ")" + m[2].lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: str, refers_to: int | None) -> bytes:
    raw = payload.encode()
    block = HTTP.encode() + (b"" if refers_to is not None else raw)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else ""
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>"]
    lines += [f"WARC-Target-URI: {uri}"] * bool(uri)
    lines += [f"WARC-Date: {date(page_id)}", f"WARC-Payload-Digest: sha1:{digest(raw)}", f"X-Payload-Length: {len(raw)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode() + block + END.encode()


def about(name: str) -> bytes:
    """The warcinfo record that an archive begins with."""
    block = b"software: textloom\r\nformat: WARC File Format 1.1\r\n"
    lines = [VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {date(0)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode() + block + END.encode()


def member(data: bytes) -> bytes:
    """A gzip member."""
    pressed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pressed.compress(data) + pressed.flush()


def members(data: memoryview, step: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that isn't empty."""
    at = 0
    while at < len(data):
        opened, end, parts = zlib.decompressobj(31), at, []
        while not opened.eof:
            if end >= len(data):
                raise ValueError(f"gzip member at byte {at} is cut short")
            parts.append(opened.decompress(data[end : end + step]))
            end = min(end + step, len(data))
        end -= len(opened.unused_data)
        if content := b"".join(parts):
            yield at, end - at, content
        at = end


def read_record(file: BinaryIO, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record that the index places there; nothing else of the file is read."""
    file.seek(offset)
    (_, _, content), = members(memoryview(file.read(length)))
    (_, _, headers, payload), = parse(io.BytesIO(content))
    return headers, payload


def date(page_id: int | None) -> str:
    from datetime import UTC, datetime, timedelta

    at = datetime.fromtimestamp(CAPTURE_EPOCH, UTC) + timedelta(seconds=(page_id or 0) % (1 << 36))
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def parse(stream: BinaryIO) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record; raises on a malformed one or a digest that differs.

    One record is held at a time, whatever the length of the archive.
    """
    at = 0
    while first := stream.readline():
        if first != f"{VERSION}\r\n".encode():
            raise ValueError(f"no record at byte {at}")
        size, headers = len(first), {}
        while (line := stream.readline()) != b"\r\n":
            if not line.endswith(b"\r\n") or b": " not in line:
                raise ValueError(f"malformed header after byte {at}")
            size += len(line)
            name, value = line[:-2].decode().split(": ", 1)
            headers[name] = value
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        payload = block[block.index(b"\r\n\r\n") + 4 :] if headers["Content-Type"].startswith("application/http") else block
        if headers["WARC-Type"] == "response" and "sha1:" + digest(payload) != headers["WARC-Payload-Digest"]:
            raise ValueError(f"payload digest differs at byte {at}")
        yield at, size + 2 + n, headers, payload
        at += size + 2 + n + 4


def revisits(pages: DataFrame, min_bytes: int, work: Workspace) -> DataFrame:
    """(page_id, sha, refers_to) of pages whose payload a page with a smaller id has, too."""
    prints = pages.select("page_id", "sha", F.octet_length("html").alias("bytes"))
    first = prints.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last").drop("last")
    first = work.save(first, "first")  # a table, so that a join on one payload's many pages can be split
    later = prints.filter(F.col("bytes") >= min_bytes).join(first, "sha").filter("page_id > refers_to")
    return work.save(later.select("page_id", "sha", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, work: Workspace | None = None) -> None:
    """Write pages (page_id, url, html) as archives of gzip members under ``path``."""
    ship_package(pages.sparkSession)
    work = work or Workspace(pages.sparkSession, "revisits")
    html = F.coalesce("html", F.lit(""))
    own = pick(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha"))
    linked = own.join(sized(revisits(own, min_bytes, work)), ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            data = b"".join([member(about(f"{part}-{made}")), *held])
            held.clear()
            return pa.RecordBatch.from_pydict({"archive": pa.array([data], pa.binary())})

        for batch in batches:
            for row in zip(*(batch.column(n) for n in ("page_id", "url", "html", "refers_to")), strict=True):
                held.append(member(record(*(x.as_py() for x in row))))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    made, size = made + 1, 0
        if held:
            yield close()

    archives = linked.mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    out = archives.write.mode("overwrite").option("maxRecordsPerFile", 1)
    out.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).text(path)
    for name in ("first", "revisits"):
        work.remove(name)


def number(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


RUN_SCHEMA = "run string, nth int, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"
RUN_NAMES = [x.split()[0] for x in RUN_SCHEMA.split(", ")]


def order(row: tuple) -> tuple:
    """Sort key of a row of a run: URL key, timestamp, page id (null first), place."""
    return row[2], row[3], row[4] is not None, row[4] or 0, row[0], row[1]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of each archive as one run, sorted within it."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("path")[i].as_py().rsplit("/", 1)[-1]
                rows = []
                for offset, length, content in members(memoryview(batch.column("content")[i].as_buffer())):
                    (_, _, h, payload), = parse(io.BytesIO(content))
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    size = len(payload) if h["WARC-Type"] == "response" else int(h["X-Payload-Length"])
                    refers = number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                    rows.append((name, 0, url_key(h.get("WARC-Target-URI")), h["WARC-Date"], number(h["WARC-Record-ID"]), size, h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], refers, offset, length))
                rows.sort(key=order)
                if rows:
                    columns = list(zip(*rows, strict=True))
                    columns[1] = range(len(rows))
                    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=RUN_NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, RUN_SCHEMA)


class LoserTree:
    """k-way merge: inner nodes hold the loser of the match between their subtrees, so a step replays one path."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.row = [next(r, None) for r in self.runs]
        self.head = [None if r is None else order(r) for r in self.row]
        k = len(runs)
        self.tree = [-1] * max(1, k)  # tree[0]: the winner
        for i in range(k - 1, -1, -1):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; a spent run goes last."""
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and x <= y)

    def _replay(self, i: int) -> None:
        winner, node = i, (i + len(self.runs)) // 2
        while node > 0:
            held = self.tree[node]
            if held == -1:  # the other side isn't there yet
                self.tree[node] = winner
                return
            if self._less(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        while self.head[w := self.tree[0]] is not None:
            yield self.row[w]
            self.row[w] = row = next(self.runs[w], None)
            self.head[w] = None if row is None else order(row)
            self._replay(w)


def rows_of(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a run, a block at a time as objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield from zip(*(batch.column(n).slice(start, ROWS_AT_ONCE).to_pylist() for n in RUN_NAMES), strict=True)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs' rows in global order: ``part`` and ``place`` number them; ranges of the key are merged apart."""
    ship_package(runs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), {}
        for batch in batches:
            name = batch.column("run").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    own.setdefault(name[a], []).append(batch.slice(a, b - a))
        merged, place = iter(LoserTree([rows_of(r) for r in own.values()])), 0
        schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), *((f.name, f.type) for f in batch.schema)]) if own else None
        while some := [r for _, r in zip(range(20_000), merged, strict=False)]:
            columns = [[part] * len(some), range(place, place + len(some)), *zip(*some, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
            place += len(some)

    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("run", "nth")
    return dealt.mapInArrow(run, "part int, place long, " + RUN_SCHEMA)


def capture_history(spark: SparkSession, path: str, work: Workspace | None = None) -> DataFrame:
    """All captures of the archives under ``path`` with ``capture_rank``, their place in the global order."""
    work = work or Workspace(spark, "captures")
    runs = work.save(read_runs(spark, path), "runs")
    merged = work.save(merge_runs(runs), "merged")
    work.remove("runs")
    counts = {r["part"]: r["count"] for r in merged.groupBy("part").count().collect()}  # one row for each merging task
    base, total = [], 0
    for part in sorted(counts):
        base.append((part, total))
        total += counts[part]
    first = spark.createDataFrame(base, "part int, base long")
    return merged.join(first, "part").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("base") + F.col("place")).alias("capture_rank"), "url_key", "captured", F.col("run").alias("file"), "offset", "length")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and return their captures."""
    work = Workspace(pages.sparkSession, "warc")
    write_archives(pages, work.path("archives"), work=work)
    return capture_history(pages.sparkSession, work.path("archives"), work)


SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
k AS (SELECT *, regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host0,
        regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest FROM p),
u AS (SELECT *, regexp_replace(regexp_replace(lower(host0), ':(80|443)?$', ''), '^www\\.', '') AS host FROM k),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first,
        array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || lower(rest) AS uk FROM u)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(s, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  row_number() OVER (ORDER BY uk, page_id) - 1 AS capture_rank
FROM f
"""
