"""Line deduplication within an edit distance of one, by deletion neighbourhoods.

Two lines are within one edit when deleting one character from each at the same place
gives the same rest (a substitution), or deleting one from the longer gives the shorter.
All such variants are emitted as hashed keys and joined; what meets there is exact up
to hash collisions, which the edit distance of each pair that decides then rules out.

Equal lines of any length but none meet by their name.  Variants of all longer lines would
be many times the corpus, so lines without a neighbour leave first.  An edit leaves one half of a line as it was: lines that share no half
with another line have none.  Of the rest, an edit leaves all but one of ``SEGMENTS``
segments as they were: lines that share no such remainder have none, and only deletions
within the shared remainder's gap are emitted.  Nothing is lost by either step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import bound_batches, discard, fresh, stash, table
from .words import SPACES

#: Shorter lines, without white space around them, have only equal lines as neighbours: one edit makes too much of them another line.
MIN_CHARS = 20
#: Hashes of halves that a task remembers, so that a line that many have is not emitted at each.
REMEMBERED = 1 << 17
SEGMENTS = 16

_WHITE = SPACES.decode()
_KEY = ["k1", "k2"]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(text: str, seed: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed))


def _name(line: str) -> tuple[int, int]:
    d = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _lines(text: str | None, min_chars: int = 1) -> Iterator[tuple[int, str]]:
    for k, line in enumerate((text or "").split("\n")):
        if len(line := line.strip(_WHITE)) >= min_chars:
            yield k, line


def halves(line: str) -> Iterator[int]:
    """Keys of both halves, as a line of its length n and as one of a character more than n - 1: lines within one edit share one."""
    for n in (len(line), len(line) - 1):
        h = n // 2
        yield _hash(line[:h], 4 * n)
        yield _hash(line[len(line) - (n - h) :], 4 * n + 1)


def gaps(line: str, segments: int) -> Iterator[tuple[int, int, int]]:
    """(key, longer, segment): the line without one segment, as one of its own length and as one of a character more."""
    for longer in (0, 1):
        n = len(line) - longer
        cuts = [n * j // segments for j in range(segments + 1)]
        for j in range(segments):
            if cuts[j] < cuts[j + 1] or longer:
                rest = f"{line[: cuts[j]]}\n{line[cuts[j + 1] + longer :]}"
                yield _hash(rest, n * segments + j), longer, j


def variants(line: str, longer: int, segment: int, segments: int) -> Iterator[tuple[int, int]]:
    """(key, role) of the deletions within a gap: role 0 meets 0 (substitution), 1 (longer) meets 2 (the shorter itself)."""
    n = len(line) - longer
    first, last = n * segment // segments, n * (segment + 1) // segments
    if longer:
        for p in range(first, last + 1):
            yield _hash(line[:p] + line[p + 1 :], 1), 1
    else:
        yield _hash(line, 1), 2
        for p in range(first, last):
            yield _hash(f"{p}\n{line[:p]}\n{line[p + 1 :]}", 0), 0


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _rows(df: DataFrame, make: Callable[[dict], Iterator[tuple]], schema: str, once: bool = False) -> DataFrame:
    """Arrow rows that ``make`` gives for each row, in batches of bounded size; with ``once``, most of the rows that a task repeats are left out."""
    fields = [c.split() for c in schema.split(", ")]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        seen: set[tuple] = set()
        for batch in batches:
            for row in batch.to_pylist():
                if once:
                    new = [r for r in dict.fromkeys(make(row)) if r not in seen]
                    if len(seen) + len(new) > REMEMBERED:
                        seen.clear()
                    seen.update(new[:REMEMBERED])
                    rows += new
                else:
                    rows.extend(make(row))
                if len(rows) >= 20_000:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)

    return df.mapInArrow(run, schema)


def _met(keyed: DataFrame, key: str) -> DataFrame:
    """The keys that two different lines have."""
    return keyed.groupBy(key).agg(F.min("k1").alias("x"), F.max("k1").alias("y")).filter("x != y").select(key)


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, line_no) of every line with an earlier line, by doc_id and line, within one edit.

    Lines end at newlines and are compared without white space around them.  Lines that
    are shorter than ``min_chars`` go with equal lines alone; blank lines, and rows without
    a doc_id, are left alone.  Rows that share a doc_id count as one document: a line of
    theirs is not removed for one at the same place.  Whole texts are read, however long;
    an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")

    def named(row: dict) -> Iterator[tuple]:
        return ((*_name(line), row["doc_id"], k) for k, line in _lines(row["text"]))

    def halved(row: dict) -> Iterator[tuple]:
        return ((h, *_name(line)) for _, line in _lines(row["text"], min_chars) for h in halves(line))

    lines, _ = stash(_rows(texts, named, "k1 long, k2 long, doc_id long, line_no int"), "lines")
    first = lines.groupBy(*_KEY).agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))

    # Lines that share a half with another, and their texts.
    half = _rows(texts, halved, "half long, k1 long, k2 long", once=True)
    shared, shared_at = stash(_met(half, "half"), "shared-halves")
    near, near_at = stash(half.join(shared, "half").select(*_KEY).distinct(), "near-lines")
    discard(spark, shared_at)
    wanted = first.join(near, _KEY).groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_set("first.line_no").alias("places"))

    def picked(row: dict) -> Iterator[tuple]:
        places = set(row["places"])
        return ((*_name(line), row["doc_id"], k, line) for k, line in _lines(row["text"], min_chars) if k in places)

    some, _ = stash(_rows(texts.join(wanted, "doc_id"), picked, "k1 long, k2 long, doc_id long, line_no int, line string").dropDuplicates(_KEY), "line-texts")
    discard(spark, near_at)

    # Of those, lines that share all but one segment, and their variants within its gap.
    def gapped(row: dict) -> Iterator[tuple]:
        return ((key, row["k1"], row["k2"], longer, j) for key, longer, j in gaps(row["line"], segments))

    gap = _rows(some.select(*_KEY, "line"), gapped, "gap long, k1 long, k2 long, longer int, segment int")
    gap_met, _ = stash(_met(gap, "gap"), "shared-gaps")
    where = gap.join(gap_met, "gap").groupBy(*_KEY).agg(F.collect_set(F.struct("longer", "segment")).alias("where"))

    def varied(row: dict) -> Iterator[tuple]:
        every = {v for w in row["where"] for v in variants(row["line"], w["longer"], w["segment"], segments)}
        return ((key, role, row["k1"], row["k2"], row["doc_id"], row["line_no"]) for key, role in every)

    variant, _ = stash(_rows(some.join(where, _KEY), varied, "variant long, role int, k1 long, k2 long, doc_id long, line_no int"), "variants")
    earliest = variant.groupBy("variant", "role").agg(F.min(F.struct("doc_id", "line_no")).alias("partner"))
    meets = F.when(F.col("role") == 0, 0).otherwise(3 - F.col("role"))
    pairs = variant.withColumn("role", meets).join(earliest, ["variant", "role"])
    pairs = pairs.filter(F.col("partner") < F.struct("doc_id", "line_no")).select(*_KEY, F.col("partner.doc_id").alias("doc_id"), F.col("partner.line_no").alias("line_no")).distinct()
    pairs = pairs.join(some.select(*_KEY, "line"), _KEY).join(some.select("doc_id", "line_no", F.col("line").alias("other")), ["doc_id", "line_no"])

    def checked(row: dict) -> Iterator[tuple]:
        return iter([(row["k1"], row["k2"])] if within_one_edit(row["line"], row["other"]) else [])

    edited, _ = stash(_rows(pairs.select(*_KEY, "line", "other"), checked, "k1 long, k2 long").distinct(), "edited-lines")
    copied = first.filter("n > 1").select(*_KEY, "first")
    gone, _ = stash(copied.join(edited.withColumn("all", F.lit(True)), _KEY, "full"), "gone-lines")
    hit = lines.join(gone, _KEY).filter(F.coalesce("all", F.lit(False)) | (F.struct("doc_id", "line_no") > F.col("first")))
    return hit.select("doc_id", "line_no")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` and ``removed_lines`` (numbers from 0, rising) for each row.

    Null texts have no lines, empty ones have one; rows that repeat a doc_id share what is
    removed, and lines that tie in (doc_id, line) do not remove each other; columns of those
    names are replaced, others may have any name; an empty table gives no rows.
    """
    at, listed = fresh(docs, "_id"), fresh(docs, "_gone")
    gone = removed_lines(docs, min_chars, segments).groupBy(F.col("doc_id").alias(at)).agg(F.array_sort(F.collect_set("line_no")).alias(listed))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    counted = docs.withColumn("n_lines", n).join(gone, F.col("doc_id") == F.col(at), "left")
    removed = F.coalesce(listed, F.array().cast("array<int>"))
    return counted.withColumn("n_removed", F.size(removed).cast("long")).withColumn("removed_lines", removed).drop(at, listed)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` without the lines that ``dedup_lines`` lists."""
    kept = F.filter(F.split("text", "\n", -1), lambda _, k: ~F.array_contains("removed_lines", k))
    listed = dedup_lines(docs, min_chars, segments)
    return listed.withColumn("text", F.when(F.size("removed_lines") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).select(*docs.columns)


def op4_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed_lines", lambda k: k.cast("string")), ",").alias("removed_lines"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), l AS (
  SELECT doc_id, k - 1 AS k, trim(parts[k], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM d)
), u AS (
  SELECT s, length(s) AS n, min({'d': doc_id, 'k': k}) AS o, length(s) // 2 AS h FROM l WHERE s <> '' GROUP BY s
), w AS (
  SELECT * FROM u WHERE n >= 20
), near AS (
  SELECT a.s AS s, a.n AS n, b.s AS t, b.n AS m, a.o AS o, b.o AS p FROM w a JOIN w b ON a.n = b.n AND a.s < b.s AND a.s[:a.h] = b.s[:b.h]
  UNION SELECT a.s, a.n, b.s, b.n, a.o, b.o FROM w a JOIN w b ON a.n = b.n AND a.s < b.s AND a.s[a.h + 1:] = b.s[b.h + 1:]
  UNION SELECT a.s, a.n, b.s, b.n, a.o, b.o FROM w a JOIN w b ON a.n + 1 = b.n AND a.s[:a.h] = b.s[:(b.n - 1) // 2]
  UNION SELECT a.s, a.n, b.s, b.n, a.o, b.o FROM w a JOIN w b ON a.n + 1 = b.n AND a.s[a.h + 1:] = b.s[(b.n - 1) // 2 + 2:]
), edit AS (
  SELECT * FROM near WHERE list_bool_or(list_transform(range(0, m), lambda i: CASE WHEN n = m
    THEN s[1:i] = t[1:i] AND s[i + 2:] = t[i + 2:] ELSE s[1:i] = t[1:i] AND s[i + 1:] = t[i + 2:] END))
), gone AS (
  SELECT s FROM edit WHERE p < o UNION SELECT t FROM edit WHERE o < p
), hit AS (
  SELECT l.doc_id, l.k FROM l JOIN u USING (s) LEFT JOIN gone g ON g.s = l.s WHERE g.s IS NOT NULL OR {'d': l.doc_id, 'k': l.k} > u.o
)
SELECT d.doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, count(hit.k) AS n_removed, coalesce(string_agg(hit.k::VARCHAR, ',' ORDER BY hit.k), '') AS removed_lines
FROM d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id, parts
"""
