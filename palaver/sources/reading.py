"""Reading transcript files: discovery, snapshots, lines with byte places, health of line files.

Files come through Spark's ``binaryFile`` source, so any file system that Spark reads
will do.  Lines end at newline bytes alone, and their places are bytes of the file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bounds on what a reader takes in.
MAX_RECORD_BYTES = 8 << 20
MAX_WHOLE_BYTES = 32 << 20
MAX_SQLITE_BYTES = 128 << 20
PROBE_LINES = 50
_BOM = b"\xef\xbb\xbf"


class Line(NamedTuple):
    number: int  # from 1
    start: int
    end: int  # behind the last byte, without the line's end
    data: bytes


class RecordTooLong(ValueError):
    pass


def lines(content: bytes, max_bytes: int = MAX_RECORD_BYTES) -> Iterator[Line]:
    """Lines of a file; a byte order mark is dropped from the first but stays within its place, a carriage return before the end is dropped."""
    at, number = 0, 0
    while at < len(content):
        end = content.find(b"\n", at)
        after = len(content) if end < 0 else end + 1
        end = len(content) if end < 0 else end
        if end > at and content[end - 1] == 13:
            end -= 1
        number += 1
        if end - at > max_bytes:
            raise RecordTooLong(f"record {number} has {end - at} bytes")
        data = content[at:end]
        yield Line(number, at, end, data.removeprefix(_BOM) if number == 1 else data)
        at = after


def json_lines(content: bytes, marks: tuple[bytes, ...] = ()) -> Iterator[tuple[Line, object | None]]:
    """Lines that aren't blank with their JSON value; None for a line that is no JSON.

    Where there are ``marks``, a line in braces without any of them is no record of
    interest, and is passed over unparsed.
    """
    for line in lines(content):
        if marks and line.data[:1] == b"{" and line.data[-1:] == b"}" and not any(m in line.data for m in marks):
            continue
        if line.data.strip():
            try:
                yield line, json.loads(line.data)
            except ValueError:
                yield line, None


def discover(spark: SparkSession, root: str | list[str], extension: str) -> DataFrame:
    """(source_path, len_bytes, modified_ms, content) of the files below a folder, whatever their depth, or of files named; unread where ``content`` is not selected."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(root)
    return found.select(F.col("path").alias("source_path"), F.col("length").alias("len_bytes"), (F.col("modificationTime").cast("double") * 1000).cast("long").alias("modified_ms"), "content")


def snapshot(files: DataFrame) -> DataFrame:
    """Files with ``fingerprint``, of what was read."""
    return files.withColumn("fingerprint", F.sha2("content", 256))


def changed_since(taken: DataFrame, now: DataFrame) -> DataFrame:
    """Paths whose file is not what the snapshot took: they are left for the next run."""
    new = now.select("source_path", F.col("len_bytes").alias("l"), F.col("modified_ms").alias("m"))
    return taken.join(new, "source_path", "left").filter("l IS NULL OR l != len_bytes OR m != modified_ms").select("source_path")


def unchanged(files: DataFrame, scans: DataFrame, parser_version: int) -> DataFrame:
    """Files of the length and time that a former scan with the same parser saw; their bytes are not read."""
    known = scans.filter(F.col("parser_version") == parser_version).select("source_path", "len_bytes", "modified_ms")
    return files.join(known, ["source_path", "len_bytes", "modified_ms"], "left_semi")


def health(records: DataFrame, source: str = "source_path") -> DataFrame:
    """Of records (source, line_no, bad): clean; partial, where a good line follows the last bad one; invalid, where none does."""
    last = lambda bad: F.max(F.when(F.col("bad") == bad, F.col("line_no")))
    ends = records.groupBy(source).agg(last(True).alias("b"), last(False).alias("g"))
    return ends.select(source, F.when(F.col("b").isNull(), "clean").when(F.col("g") > F.col("b"), "partial").otherwise("invalid").alias("health"))


def file_health(content: bytes) -> str:
    """``health`` of one file of JSON lines: whether it ends in a record that was not written to its end."""
    bad = good = 0
    try:
        for line, value in json_lines(content):
            if value is None:
                bad = line.number
            else:
                good = line.number
    except RecordTooLong:
        return "invalid"
    return "clean" if not bad else "partial" if good > bad else "invalid"


def torn(files: DataFrame) -> DataFrame:
    """Paths of JSON-lines files whose end is torn: what a former scan read of them is kept."""

    @F.pandas_udf("string")
    def check(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: file_health(bytes(c)))

    return files.filter("source_path LIKE '%.jsonl'").filter(check(F.col("content")) == "invalid").select("source_path")
