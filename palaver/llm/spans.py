"""Substring deduplication by sliding sentence spans.

A text is cut into sentences, and long sentences into clauses at marks and at words
chosen by their hash, the least of every ``CUT_WITHIN`` words in which none is marked
(winnowing), so that a passage is cut alike wherever it stands.  Every run of
several consecutive pieces, the shortest of at least ``MIN_RUN_WORDS`` words from each
piece on, is hashed.  Runs are joined over all documents by their hash; pieces that lie
in a run whose first occurrence is elsewhere, in another document or before it in its
own, are removed.

The first occurrence is the one in the smallest doc_id, and there the first.  It stays
whole where later ones overlap it: of those, what lies beyond its end is removed.  Two
passes over the texts emit the runs, one for the table of repeated hashes and one for
the places to look up in it, so only hashes and places move between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import bound_batches, fresh, stash, table
from .words import mix, scan_words, sequence_hashes, table_of

MIN_RUN_WORDS = 16
MIN_RUN_PIECES = 2
#: Of so many consecutive words, one ends a clause at least.
CUT_WITHIN = 8

_ENDS = table_of(b".!?,;:")
_OTHER = np.uint64(0x2545F4914F6CDD1D)


def _over(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """``f`` over each ``n`` consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def least_in_windows(x: np.ndarray, n: int) -> np.ndarray:
    """Which values are the least, or equal to it, of some ``n`` consecutive ones."""
    n = min(n, len(x))
    beyond = np.zeros(max(n - 1, 0), x.dtype)
    return _over(np.concatenate([beyond, _over(x, n, np.minimum), beyond]), n, np.maximum) == x


class Places(NamedTuple):
    hashes: np.ndarray
    checks: np.ndarray  # a second hash, of other values of the words
    start: np.ndarray  # code points
    end: np.ndarray
    again: np.ndarray  # the run has an earlier place in the text


def places(text: str | None, min_words: int = MIN_RUN_WORDS, min_pieces: int = MIN_RUN_PIECES) -> Places:
    """The run from each piece on.

    Words are compared in lower case (A-Z), white space is not compared, but a line's end
    is a cut.  Where the line ends are alike, a passage of 38 words gives a run that does not
    depend on what stands around it: it begins behind the cut of the first 8 words and ends
    at the first cut 16 words on, before the last 8 words, where cuts could differ.  A place that
    overlaps the first of its hash begins where that one ends, which so stays whole.
    """
    words = scan_words((text or "").encode("utf-8", "surrogatepass").lower(), _ENDS)
    n = len(words.hashes)
    empty = Places(np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
    if n < min_words:
        return empty
    # A marked word is less than any other, so each is chosen.
    ends = least_in_windows(np.where(words.marked, np.uint64(0), words.hashes), CUT_WITHIN) | words.newline_after
    ends[-1] = True
    stops = np.flatnonzero(ends) + 1  # one past the last word of each piece
    starts = np.concatenate([[0], stops[:-1]])
    last = np.maximum(np.searchsorted(stops, starts + min_words), np.arange(len(stops)) + min_pieces - 1)
    whole = last < len(stops)
    starts, stops = starts[whole], stops[last[whole]]
    if not len(starts):
        return empty
    hashes = sequence_hashes(words.hashes, starts, stops)
    checks = (sequence_hashes(mix(words.hashes ^ _OTHER), starts, stops) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    again = first[of] < np.arange(len(hashes))
    starts = np.where(again, np.maximum(starts, stops[first[of]]), starts)
    return Places(hashes, checks, words.start_points[starts], words.end_points[stops - 1], again)


def runs(text: str | None, min_words: int = MIN_RUN_WORDS, min_pieces: int = MIN_RUN_PIECES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of ``places``, each hash at its first place alone."""
    found = places(text, min_words, min_pieces)
    return found.hashes[~found.again], found.start[~found.again], found.end[~found.again]


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each hash of a text once, and whether it has more places there."""
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            hashes, checks, _, _, again = places(text.as_py())
            if doc_id is None or not len(hashes):
                continue
            once = hashes[~again]
            more = np.isin(once, hashes[again])
            yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), pa.array(checks[~again]), pa.array(np.full(len(once), doc_id, np.int64)), pa.array(more)], ["h", "c", "doc_id", "more"])


def _all_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            hashes, checks, start, end, again = places(text.as_py())
            if doc_id is None or not len(hashes):
                continue
            columns = [pa.array(hashes.view(np.int64)), pa.array(checks), pa.array(np.full(len(hashes), doc_id, np.int64)), pa.array(start), pa.array(end), pa.array(again)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", "doc_id", "start", "stop", "again"])


def repeated_spans(docs: DataFrame, within: bool = False) -> DataFrame:
    """The passages to remove: doc_id, span_start, span_end (code points, end exclusive), first_doc_id (the smallest that has a part of it; its own where the passage stands earlier in the document).

    With ``within``, as the query and ``remove_repeats`` ask, repeats inside one document
    count too; without, only those whose first occurrence is in a smaller doc_id.

    Null texts and texts of fewer words have none; whole texts are read, however long; rows
    without a doc_id are left out; rows that repeat a doc_id count as one document and
    don't repeat each other; an empty table gives no rows; other columns are not read.
    Runs are equal if 64 bits of one hash and 32 of another are: two different ones are so
    once in 2^96 pairs.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    known = texts.mapInArrow(_firsts, "h long, c int, doc_id long, more boolean").groupBy("h", "c").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.bool_or("more").alias("more"))
    known, _ = stash(known.filter("first_doc_id < last OR more" if within else "first_doc_id < last").select("h", "c", "first_doc_id"), "repeated-runs")
    found = texts.mapInArrow(_all_places, "h long, c int, doc_id long, start long, stop long, again boolean")
    hits, _ = stash(found.join(known, ["h", "c"]).filter("doc_id > first_doc_id OR again" if within else "doc_id > first_doc_id").select("doc_id", "start", "stop", "first_doc_id"), "hits")
    # Overlapping and touching runs of one document make one span.
    by_doc = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.groupBy("doc_id", "start", "stop").agg(F.min("first_doc_id").alias("first_doc_id")).withColumn("new", F.coalesce((F.col("start") > reach + 1).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(by_doc))
    spans = islands.groupBy("doc_id", "island").agg(F.min("start").alias("span_start"), F.max("stop").alias("span_end"), F.min("first_doc_id").alias("first_doc_id"))
    return spans.drop("island")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages of ``repeated_spans`` in ``text``; all other columns stay, whatever their names, and so do nulls, rows without a doc_id and white space around a passage."""
    at, cuts = fresh(docs, "_id"), fresh(docs, "_spans")
    spans = repeated_spans(docs, within=True).groupBy(F.col("doc_id").alias(at)).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias(cuts))
    joined = docs.join(spans, F.col("doc_id") == F.col(at), "left").drop(at)
    place = joined.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                for cut in reversed(cuts or []):
                    text = text[: cut["span_start"]] + text[cut["span_end"] :]
                out.append(text)
            columns = [pa.array(out, pa.string()) if k == place else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), within=True)
