"""WARC archives of captured pages, and their index.

Records are written by Spark's text writer: a record ends with two line breaks, which
is the separator between rows, so any file system that Spark writes to takes archives,
and a lost task is simply run again.  Archives are not compressed: an index entry's
offset and length are places in the file, where its record can be read alone.  A payload
that was captured before is written as a revisit that refers to its response.

The archives are read back file by file, each record where it lies.  A file gives one run
of index entries, sorted by URL key, time and page.  The runs are dealt by key ranges
of a bounded number of entries; Spark brings the slice of each run in its order,
spilling where it must, and a tree of losers merges the slices.  Ranges in order, and
entries in order within a range, are the captures in global order, each URL's history
together.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice
from typing import TypeVar
from urllib.parse import parse_qsl, urlencode, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import scratch_path, stash, table

MIN_REVISIT_BYTES = 1000
#: Payloads of up to so many bytes go into files of so many records: no file holds more than 64 MB of them, but for single larger records.
FILE_CLASSES = ((1 << 14, 4096), (1 << 18, 256), (1 << 22, 16), (1 << 62, 1))
#: Index entries that one task merges, and those that it takes from a run, or gives, at once.
ENTRIES_A_TASK, ENTRIES_AT_ONCE = 100_000, 4096
_EPOCH = 1_700_000_000

T = TypeVar("T")


class LoserTree:
    """Merges sorted runs; each step replays one path from a leaf to the root, log2(runs) comparisons."""

    def __init__(self, runs: Sequence[Iterable[T]]) -> None:
        self._runs = [iter(r) for r in runs]
        self._k = len(self._runs)
        self._heads: list[T | None] = [next(r, None) for r in self._runs]
        self._losers = [-1] * max(1, self._k)
        for leaf in range(self._k):
            self._replay(leaf)

    def _before(self, x: int, y: int) -> bool:
        a, b = self._heads[x], self._heads[y]
        if a is None or b is None:
            return b is None and (a is not None or x < y)
        return a < b or (not b < a and x < y)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self._k) // 2
        while node > 0:
            other = self._losers[node]
            if other < 0:  # the first to come waits for the other side
                self._losers[node] = winner
                return
            if self._before(other, winner):
                self._losers[node], winner = winner, other
            node //= 2
        self._losers[0] = winner

    def __iter__(self) -> Iterator[T]:
        while self._k:
            winner = self._losers[0]
            head = self._heads[winner]
            if head is None:
                return
            yield head
            self._heads[winner] = next(self._runs[winner], None)
            self._replay(winner)


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels reversed, then the path and the sorted query; the whole string, lower-cased, if it has no host."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    standard = port is None or (parts.scheme.lower(), port) in (("http", 80), ("https", 443))
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return ",".join(reversed(labels)) + ("" if standard else f":{port}") + ")" + (parts.path or "/").lower() + (f"?{query}" if query else "")


def _record(page_id, seconds, url, payload, refers_to):
    """The text of a WARC record without the two line breaks at its end."""
    size = F.octet_length(payload)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    revisit = refers_to.isNotNull()
    name = F.coalesce(page_id.cast("string"), F.lit("none"))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A"), " ", "%20")
    date = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Date: "), date,
        F.when(url.isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), safe)).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.sha1(payload),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.length(http) + F.when(revisit, F.lit(0)).otherwise(size)).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, http, F.when(revisit, F.lit("")).otherwise(payload))


def write_archives(pages: DataFrame, seconds: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> list[str]:
    """Write a record for each row of (page_id, url, html); the folders that hold the archives.

    Of payloads that are equal and long enough, the one with the largest page_id is the
    response, the others revisit it; rows that repeat that page_id are responses too, as
    are rows without a page_id.  Payloads are equal if their SHA-256 and lengths are; the
    record states SHA-1, as the format does.  A null html is an empty payload, a null url
    has no target; whole payloads are written, however long; other columns, whatever their
    names, are not read; an empty table gives no folders.  ``seconds`` names a column with
    the time of capture since 1970; without one, pages are a second apart in the order
    of their ids.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("size"))
    groups = keyed.filter(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups, _ = stash(groups.filter("n > 1 AND refers_to IS NOT NULL").select("digest", "size", "refers_to"), "payloads")
    revisits = keyed.join(groups, ["digest", "size"]).filter(F.col("page_id") != F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()
    revisits, _ = stash(revisits, "revisits")
    when = F.col(seconds) if seconds else F.coalesce(F.col("page_id"), F.lit(0)) + _EPOCH
    rows = pages.select("page_id", "url", payload.alias("payload"), when.alias("seconds")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    rows = rows.join(revisits, ["page_id", "digest"], "left")
    kind = F.lit(len(FILE_CLASSES) - 1)
    for k in reversed(range(len(FILE_CLASSES) - 1)):
        kind = F.when(F.col("size") <= FILE_CLASSES[k][0], k).otherwise(kind)
    sizes = keyed.groupBy(kind.alias("k")).count().collect()  # a row a class
    folders = []
    for k in sorted(r["k"] for r in sizes):
        least = FILE_CLASSES[k - 1][0] if k else -1
        own = rows.filter((F.octet_length("payload") > least) & (F.octet_length("payload") <= FILE_CLASSES[k][0]))
        folders.append(scratch_path(spark, f"warc-{k}"))
        record = _record(F.col("page_id"), F.col("seconds"), F.col("url"), F.col("payload"), F.col("refers_to"))
        own.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_CLASSES[k][1]).text(folders[-1])
    return folders


_BREAK = re.compile(rb"\r\n\r\n")


def read_records(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], dict[str, str], memoryview, int, int]]:
    """(record headers, HTTP headers, payload, offset, length) of each record, in place; only lengths tell where one ends."""
    data = memoryview(data)

    def fields(start: int, end: int) -> dict[str, str]:
        lines = bytes(data[start:end]).decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    at = 0
    while at < len(data):
        end = _BREAK.search(data, at).start()
        head = fields(at, end)
        start, size = end + 4, int(head["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its length says")
        inner = _BREAK.search(data, start, start + size).start()
        yield head, fields(start, inner), data[inner + 4 : start + size], at, start + size + 4 - at
        at = start + size + 4


_ENTRY = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long, record_length long, run string, run_place long"
_NAMES = [c.split()[0] for c in _ENTRY.split(", ")]


def _page(urn: str | None) -> int | None:
    name = (urn or "").rpartition(":")[2].rstrip(">")
    return int(name) if name.lstrip("-").isdigit() else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in _ENTRY.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            entries = []
            for head, http, payload, offset, length in read_records(memoryview(content.as_buffer())):
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                size = len(payload) if kind == "response" else int(http["content-length"])
                if kind == "response" and hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest:
                    raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                entries.append((url_key(head.get("warc-target-uri")), head["warc-date"], _page(head["warc-record-id"]), size, digest, kind, _page(head.get("warc-refers-to")), path, offset, length))
            entries.sort(key=_order)
            columns = [*(list(zip(*entries, strict=True)) or [()] * 10), [path] * len(entries), range(len(entries))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], -1 if entry[2] is None else entry[2], entry[7], entry[8]


def _slice(table: pa.Table, start: int, stop: int) -> Iterator[tuple]:
    """The entries of one run's slice as (place in the global order, row), a few at once."""
    for at in range(start, stop, ENTRIES_AT_ONCE):
        part = table.slice(at, min(ENTRIES_AT_ONCE, stop - at))
        url, when, page, archive, offset = (part.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id", "archive", "record_offset"))
        for k in range(part.num_rows):
            yield url[k], when[k], -1 if page[k] is None else page[k], archive[k], offset[k], at + k


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range, run by run and each in its order: the slices merged."""
    parts = list(batches)
    if not parts:
        return
    entries = pa.Table.from_batches(parts).combine_chunks()
    if not entries.num_rows:
        return
    run = entries.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
    starts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), entries.num_rows]
    tree = LoserTree([_slice(entries, a, b) for a, b in zip(starts, starts[1:], strict=False)])
    first = TaskContext.get().partitionId() << 40
    merged = (e[-1] for e in tree)
    while rows := list(islice(merged, ENTRIES_AT_ONCE)):
        taken = entries.take(pa.array(rows)).select(_NAMES[:10]).combine_chunks()
        order = pa.array(np.arange(first, first + len(rows)))
        first += len(rows)
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in taken.columns), order], [*_NAMES[:10], "capture_order"])


def capture_history(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The captures of all archives, read back; ``capture_order`` rises with URL key, time and page over the whole result.

    Without folders there are no rows.  A record whose length or payload digest is not
    that of its bytes is an error.
    """
    schema = ", ".join([*_ENTRY.split(", ")[:10], "capture_order long"])
    if not folders:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folders)
    runs, _ = stash(files.select("path", "content").mapInArrow(_runs, _ENTRY), "runs")
    parts = max(1, math.ceil(runs.count() / ENTRIES_A_TASK))
    parts = max(parts, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = runs.repartitionByRange(parts, "url_key", "captured_at", "page_id", "archive", "record_offset").sortWithinPartitions("run", "run_place")
    return dealt.mapInArrow(_merge, schema)


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = capture_history(spark, write_archives(table(spark, sf_dir, "pages")))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), w AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
FROM w
"""
