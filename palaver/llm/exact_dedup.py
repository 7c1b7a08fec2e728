"""Exact deduplication by deterministic block naming.

Normalised texts are cut into blocks of fixed size.  Distinct blocks are sorted and
numbered, so that two blocks have one name exactly when they are equal; then adjacent
names are paired and the distinct pairs are sorted and numbered, again and again,
until one name is left for each document.  The names are built from comparisons of
whole blocks, so the last one is an identity without collisions; a hash only routes
blocks to tasks, and blocks that share it are told apart by their text.

The text crosses the network once, after equal blocks have been merged where they are
read.  A name is a position in the sorted rows of a hash partition, thus the same when
a lost task is run again.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import discard, drop_rows, stash, table

BLOCK_CHARS = 4096
_KEY = ["doc_id", "n_chars", "text_sha256"]


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("_norm"))
    cut = F.regexp_extract_all("_norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    cut = F.when(F.col("_norm") == "", F.array(F.lit(""))).otherwise(cut)
    rows = base.select("doc_id", "n_chars", F.sha2("_norm", 256).alias("text_sha256"), cut.alias("_cut"))
    return rows.select(*_KEY, F.size("_cut").alias("n_blocks"), F.posexplode("_cut").alias("pos", "block")).withColumn("h", F.xxhash64("block"))


def name_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_chars, text_sha256, n_blocks, name): rows are equal after removing white space exactly when (n_blocks, name) agree."""
    spark = docs.sparkSession
    rows = _blocks(docs, block_chars)
    distinct = rows.groupBy("h").agg(F.collect_set("block").alias("same"))
    sorted_blocks = distinct.select("h", F.size("same").alias("n"), F.explode("same").alias("block")).sortWithinPartitions("block", "h")
    names = sorted_blocks.select("h", F.when(F.col("n") > 1, F.col("block")).alias("block"), F.monotonically_increasing_id().alias("name"))
    names, names_at = stash(names, "block-names")
    plain = names.filter(F.col("block").isNull()).select("h", "name")
    clashes = names.filter(F.col("block").isNotNull())
    kept = [*_KEY, "n_blocks", "pos", "name"]
    named = rows.drop("block").join(plain, "h").select(*kept)
    if not clashes.isEmpty():
        named = named.unionByName(rows.join(clashes, ["h", "block"]).select(*kept))
    named, level_at = stash(named.withColumn("copies", F.lit(1).cast("long")).withColumn("left", F.col("n_blocks")), "level-0")
    discard(spark, names_at)

    done, longest, level = [named.filter("n_blocks = 1")], named.agg(F.max("n_blocks")).first()[0] or 1, named
    for step in range(1, math.ceil(math.log2(longest)) + 1 if longest > 1 else 1):
        even, odd = F.pmod("pos", F.lit(2)) == 0, F.pmod("pos", F.lit(2)) == 1
        copies = F.sum(F.when(even, F.lit(1))) if step == 1 else F.max("copies")
        pairs = level.filter("left > 1").groupBy(*_KEY, "n_blocks", "left", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b"), copies.alias("copies")
        )
        pairs, pairs_at = stash(pairs.withColumn("left", F.expr("(left + 1) div 2")), f"pairs-{step}")
        named_pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("a", "b")
        named_pairs, names_at = stash(named_pairs.select("a", "b", F.monotonically_increasing_id().alias("name")), f"pair-names-{step}")
        level, level_at = stash(pairs.join(named_pairs, ["a", "b"]).drop("a", "b"), f"level-{step}")
        discard(spark, pairs_at, names_at)
        done.append(level.filter("left = 1"))
    out = [*_KEY, "n_blocks", "name", "copies"]
    every = done[0].select(*out)
    for d in done[1:]:
        every = every.unionByName(d.select(*out).withColumn("n_blocks", F.col("n_blocks").cast("int")))
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "_copy")


def exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and are all equal.  Of equal texts the longest original
    stays, then the smallest doc_id; a null doc_id goes last.  Rows that repeat a doc_id
    with its text count in group_size and share the verdict of that doc_id.  Whole texts
    are compared, however long, a block at a time; an empty table gives no rows; other
    columns are not read.
    """
    named, _ = stash(name_documents(docs, block_chars), "identities")
    groups = named.groupBy("n_blocks", "name").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("m"))).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    groups, _ = stash(groups.select("n_blocks", "name", (-F.col("_best.m")).alias("keep_id"), "group_size"), "groups")
    joined = named.join(groups, ["n_blocks", "name"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for those that ``exact_duplicates`` drops, with all their columns; extra ones may have any name.

    Of rows equal in doc_id and text one stays.  A row leaves for its own text, so a
    repeated doc_id does not take other texts along; rows of a repeated or null doc_id
    are preferred to others of their length.  Null and empty texts are equal, of long ones
    nothing is left out, and an empty table stays empty.
    """
    return drop_rows(docs, lambda rows: exact_duplicates(rows).filter("NOT kept").select("doc_id"))


def op6_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, (list({'n': -n, 'id': doc_id} ORDER BY n DESC, doc_id))[1].id AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
