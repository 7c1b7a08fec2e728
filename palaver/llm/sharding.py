"""Sharding by rendezvous hashing: every record goes to the shard that draws the best ticket for its key.

A ticket is a hash of (key, shard), weighted by the shard; adding a shard changes
only the records whose best ticket is the new shard's, about 1/(n+1) of them, and
moves each of them into it.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dense_rank_in_groups, table

N_SHARDS = 24
#: Hexadecimal digits of the hash that make a ticket: 52 bits, exact in a double.
_DIGITS = 13


def _ticket(key: Column, shard: int, weight: float | None) -> Column:
    """A uniform draw for (key, shard): its integer if weights are equal, else -w / ln(u)."""
    drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, _DIGITS), 16, 10).cast("long")
    if weight is None:
        return drawn
    u = (drawn.cast("double") + 0.5) / float(16**_DIGITS)
    return F.lit(float(weight)) / -F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Struct (ticket, minus_shard) of the winning shard; ties go to the smaller shard number."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    equal = len(set(weights)) == 1
    draws = [F.struct(_ticket(key, s, None if equal else w).alias("ticket"), F.lit(-s).alias("minus_shard")) for s, w in enumerate(weights)]
    return F.array_max(F.array(*draws))


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """Add the shard of each row.  Null keys count as the empty key; a column named ``out`` is replaced."""
    text_key = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return df.withColumn(out, (-rendezvous(text_key, weights)["minus_shard"]).cast("int"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Shards, slots and the shards after growing by one, for rows of (doc_id, text).

    Law ``key``: doc_id and the number of shards decide.  A null text has size 8 and the
    checksum of no bytes; rows that repeat a doc_id share its shard and get slots of
    their own; an empty table gives no rows; other columns are not read.
    """
    draws = [1.0] * n_shards
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", rendezvous(key, draws).alias("_best"), _ticket(key, n_shards, None).alias("_new"), _ticket(key, n_shards + 1, None).alias("_spread"), "text")
    moved = F.col("_new") > F.col("_best.ticket")
    old = -F.col("_best.minus_shard")
    placed = keyed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        old.cast("int").alias("shard"),
        F.when(moved, F.lit(n_shards)).otherwise(old).cast("int").alias("grown_shard"),
        "_spread",
    )
    counted = keyed.select("_spread", old.cast("int").alias("shard"))
    ranked = dense_rank_in_groups(placed, counted, ["shard"], F.col("_spread"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", docs.count())
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


#: The checksum is built from a table of remainders by the rule of its polynomial.
OP9_SQL = """
WITH RECURSIVE step(b, c, i) AS (
  SELECT b, b, 0 FROM range(256) AS r(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i + 1 FROM step WHERE i < 8
), t AS (SELECT list(c ORDER BY b) AS t FROM step WHERE i = 8
), bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), sums AS (
  SELECT doc_id, n, xor(list_reduce(list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM bytes, t
), best AS (
  SELECT doc_id, s, ('0x' || substr(md5(doc_id || ':' || s), 1, 13))::BIGINT AS ticket FROM documents, range(25) AS r(s)
), old AS (SELECT doc_id, (list(s ORDER BY ticket DESC, s))[1] AS shard FROM best WHERE s < 24 GROUP BY doc_id
), grown AS (SELECT doc_id, (list(s ORDER BY ticket DESC, s))[1] AS grown_shard FROM best GROUP BY doc_id
)
SELECT doc_id, n + 8 AS size, crc AS text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id || ':25'), 1, 13))::BIGINT
    % (SELECT greatest(1, ceil(count(*) / 20000))::BIGINT FROM documents), doc_id) - 1 AS slot
FROM sums JOIN old USING (doc_id) JOIN grown USING (doc_id)
"""
