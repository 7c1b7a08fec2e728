"""Byte-level BPE through a sentencepiece model written straight from a rank file.

Byte b stands as the character 256 + b; every entry of the vocabulary becomes a piece
of such characters whose score is minus its rank, in a BPE model with identity
normalisation.  Sentencepiece merges the adjacent pair of the highest score first and
the leftmost of equals, which is the lowest-rank merge of byte-level BPE.  A match of
the pattern that is itself an entry is its own token.  Decoding maps ids back to the
bytes of their entries.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .memory import settle, shrink
from .tables import bound_batches, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Matches that are held at once, and matches whose ids a worker remembers; neither changes a result.
MATCHES_AT_ONCE = 200_000
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's entries in the order of their ranks, which are 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(entry)) for entry, rank in map(bytes.split, lines))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [entry for _, entry in pairs]


def as_characters(data: bytes) -> str:
    pairs = bytearray(b"\x00\x01" * len(data))  # byte b and 1 are the character 256 + b in UTF-16
    pairs[::2] = data
    return pairs.decode("utf-16-le")


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def model_bytes(entries: list[bytes]) -> bytes:
    """A sentencepiece model in its wire format; the piece of rank r has id r + 1, id 0 is the unknown piece."""
    normal, unknown, bpe = 1, 2, 2
    pieces = _piece("<unk>", 0.0, unknown) + b"".join(_piece(as_characters(e), -float(r), normal) for r, e in enumerate(entries))
    trainer = _number(3, bpe) + _number(4, len(entries) + 1) + _number(40, 0) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _bytes(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return pieces + _bytes(2, trainer) + _bytes(3, normalizer)


class Ragged:
    """Byte strings laid end to end, gathered by arrays of their numbers."""

    def __init__(self, strings: list[bytes]) -> None:
        self._bytes = np.frombuffer(b"".join(strings), np.uint8)
        self._lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self._starts = np.cumsum(self._lengths) - self._lengths

    def gather(self, numbers: np.ndarray) -> bytes:
        lengths = self._lengths[numbers]
        ends = np.cumsum(lengths)
        shift = self._starts[numbers] - (ends - lengths)
        return self._bytes[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class ByteBpe:
    """Encoder and decoder over one rank file; keeps the ids of frequent matches as bytes of 32-bit numbers."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> None:
        import sentencepiece

        self.entries = read_ranks(path)
        self._rank = {e: r for r, e in enumerate(self.entries)}
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.entries))
        self._pattern = regex.compile(pattern)
        self._ids: dict[str, bytes] = {}
        self._texts = Ragged(self.entries)
        self._numerals = Ragged([b"%d " % r for r in range(len(self.entries))])

    def _learn(self, matches: list[str]) -> None:
        shrink(self._ids, REMEMBERED, REMEMBERED // 4)
        parts = []
        for m in set(matches).difference(self._ids):
            data = m.encode("utf-8")
            if (rank := self._rank.get(data)) is not None:
                self._ids[m] = rank.to_bytes(4, sys.byteorder)
            else:
                parts.append((m, as_characters(data)))
        for (m, _), ids in zip(parts, self._model.encode([p for _, p in parts], num_threads=1) if parts else (), strict=True):
            self._ids[m] = (np.array(ids, np.uint32) - np.uint32(1)).tobytes()

    def encode_parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a whole text, a bounded number of matches at a time."""
        found = self._pattern.finditer(text) if len(text) > 8 * MATCHES_AT_ONCE else None
        while True:
            matches = [m[0] for m in islice(found, MATCHES_AT_ONCE)] if found is not None else self._pattern.findall(text)
            self._learn(matches)
            yield np.frombuffer(b"".join(map(self._ids.__getitem__, matches)), np.uint32)
            if found is None or len(matches) < MATCHES_AT_ONCE:
                return

    def encode(self, text: str) -> list[int]:
        return np.concatenate(list(self.encode_parts(text))).tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        return self._texts.gather(np.asarray(ids, np.int64))

    def numerals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each with a space behind it."""
        return self._numerals.gather(ids)


@lru_cache(2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def digests(bpe: ByteBpe, text: str | None) -> tuple[int, str, str]:
    """(number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded bytes) of a whole text."""
    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
    for ids in bpe.encode_parts(text or ""):
        if len(ids):
            of_ids.update((b" " if n else b"") + bpe.numerals(ids)[:-1])
            of_bytes.update(bpe.decode(ids))
            n += len(ids)
    return n, of_ids.hexdigest(), of_bytes.hexdigest()


def encode_documents(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """One row for each row of (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, and the digests of no bytes.  Whole texts are
    encoded, however long, a part at a time.  Repeated rows give repeated results; an
    empty table gives no rows; other columns, whatever their names, are not read.
    ``path`` must be readable on the executors.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            rows = [digests(bpe, t.as_py()) for t in batch.column(1)]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        settle()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
