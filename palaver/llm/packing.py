"""Packing token ids into sequences of equal length by cutting stock.

A document is cut into full sequences and one rest.  The rests are counted by length
class, the classes are packed by column generation (``cutting_stock``), and the rounded
patterns are dealt to the documents by their rank within a class.  Ids are made once;
what moves between tasks afterwards is one small row a piece.
"""

from __future__ import annotations

import math
import os
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cutting_stock import Pattern, plan_bins
from .memory import settle, shrink
from .tables import bound_batches, dense_rank_in_groups, stash, table
from .words import blocks

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE_TOKENS = 4096
END_ID = 2
#: Tokens by which length classes differ; a class counts as its longest member, so a piece wastes GRANULE / 2 at the mean.
GRANULE = 16
#: Words whose ids a worker remembers; a bound on memory that changes no result.
REMEMBERED = 700_000


#: Marks that never start or join a token with letters; the apostrophe does.
_MARKS = b".,!?;:#*$%&|"


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and never joins what it separates."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; threads would only wait in turns
        self._tokenizer = Tokenizer.from_file(path)
        self._ids: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> None:
        encoded = self._tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)
        self._ids.update((w, array("I", e.ids).tobytes()) for w, e in zip(words, encoded, strict=True))

    def _learn(self, words: set[bytes]) -> None:
        """Remember new words.  Marks behind an ASCII letter are a token run of their own, so a word with such an end is its front and its end."""
        fronts = {w: w.rstrip(_MARKS) for w in words}
        split = {w: f for w, f in fronts.items() if len(f) < len(w) and f[-1:].isalpha()}
        ends = {w[len(f) :] for w, f in split.items()}
        self._encode(list((words - split.keys() | set(split.values()) | ends).difference(self._ids)))
        known = self._ids
        known.update((w, known[f] + known[w[len(f) :]]) for w, f in split.items())

    def ids(self, text: str) -> bytes:
        """32-bit ids of the text in the byte order of the machine."""
        data = text.encode("utf-8", "surrogatepass")
        if b"<|" not in data:  # special tokens are found by their case
            data = data.lower()
        out = []
        for part in blocks(data):
            words = part.split()
            shrink(self._ids, REMEMBERED, REMEMBERED // 7)
            if new := set(words).difference(self._ids):
                self._learn(new)
            out.append(b"".join(map(self._ids.__getitem__, words)))
        return b"".join(out)


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, units int, row_hash long"


def cut_documents(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, granule: int = GRANULE) -> DataFrame:
    """The pieces of every document: full sequences, then the rest.  ``units`` is the length in granules, rounded up."""
    if sys.byteorder != "little" or array("I").itemsize != 4:
        raise RuntimeError("checksums are of little-endian 32-bit ids")
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                n, whole = len(ids) // 4, zlib.crc32(ids)
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, -(-length // granule), whole))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 5 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True) if rows else [()] * 7)], [c.split()[0] for c in _PIECES.split(", ")])
        settle()

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def _segments(patterns: list[Pattern]) -> dict[int, list[np.ndarray]]:
    """By size: ranks from which a pattern serves the class, items a bin, first bin, and first slot in the bin."""
    rows, served, first_bin = defaultdict(list), defaultdict(int), 0
    for content, times in patterns:
        slot = 0
        for size in sorted(content, reverse=True):
            rows[size].append((served[size], content[size], first_bin, slot))
            served[size] += content[size] * times
            slot += content[size]
        first_bin += times
    return {size: [np.array(c, np.int64) for c in zip(*r, strict=True)] for size, r in rows.items()}


def pack_documents(docs: DataFrame, path: str = VOCABULARY, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, granule: int = GRANULE) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of (doc_id, text) is a document; a null or empty text has the end id
    alone; repeated rows are packed each; an empty table gives no rows; other columns
    are not read; whole texts are, however long, and cut into as many pieces as they fill.
    ``capacity`` must be a multiple of ``granule``.  ``path`` must be
    readable on the executors.
    """
    if capacity % granule:
        raise ValueError("capacity must be a multiple of granule")
    bound_batches(docs.sparkSession)
    pieces, _ = stash(cut_documents(docs, path, capacity, end_id, granule), "pieces")
    histogram = {r["units"]: r["count"] for r in pieces.groupBy("units").count().collect()}  # at most capacity / granule rows
    segments = _segments(plan_bins(histogram, capacity // granule))
    order = [F.col(c) for c in ("doc_id", "start", "row_hash", "length")]
    total = sum(histogram.values())
    # As many chunks as rows in each: a common length is dealt over all of them, and so is the table of their sizes.
    ranked = dense_rank_in_groups(pieces, pieces, ["units"], F.xxhash64("doc_id", "start", "row_hash"), order, "rank", total, max(1, math.isqrt(total)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, rank = batch.column(batch.schema.get_field_index("units")).to_numpy(), batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, slot = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(units):
                from_rank, each, first_bin, first_slot = segments[int(size)]
                mine = units == size
                k = np.searchsorted(from_rank, rank[mine], "right") - 1
                sequence[mine] = first_bin[k] + (rank[mine] - from_rank[k]) // each[k]
                slot[mine] = first_slot[k] + (rank[mine] - from_rank[k]) % each[k]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(slot)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot")) - F.col("length")  # a sequence has capacity rows at most
    return placed.withColumn("offset", before).drop("slot")


def op10_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
