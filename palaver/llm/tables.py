"""Reading tables, and cutting lineage through the folder that all executors share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_A_FILE = 100_000
#: Used only on one machine, where the session names no checkpoint folder, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints/palaver"
#: Ends a shuffle's files with the query that wrote them; no table written here is read through a shuffle again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors all see; without one, a folder of this machine in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or DEFAULT_SHARED).rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; its files go when the session ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    for path in paths:
        fs, at = _hadoop(spark, path)
        fs.delete(at, True)


def stash(df: DataFrame, label: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write a DataFrame to the shared folder and read it back: its lineage ends in files that outlive executors.

    Where its number of rows, or a bound on it, is known, it goes into files of about
    ``ROWS_A_FILE``: not a small file from each of many tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df if rows is None else df.coalesce(max(1, math.ceil(rows / ROWS_A_FILE)))).write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Scratch tables that go together once the results that need them are written."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._paths = spark, []

    def stash(self, df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
        out, path = stash(df, label, rows)
        self._paths.append(path)
        return out

    def clear(self) -> None:
        discard(self._spark, *self._paths)
        self._paths = []


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's rows an Arrow batch, if they are more: texts and sets are long, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it the name of no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_rows(docs: DataFrame, dropped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` whose text ``dropped`` does not give up, with all their columns.

    ``dropped`` takes rows (doc_id, text) and returns the doc_ids to leave out.  Where a
    doc_id is repeated, or null, its rows go by an id made of doc_id and text, which is
    negative and so sorts before others: a row leaves for its own text alone.  Of rows with
    the same doc_id and text one stays at most.
    """
    row, many = fresh(docs, "_row"), fresh(docs, "_many")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(row))
    repeated, _ = stash(repeated, "repeated-ids")
    if repeated.isEmpty():
        keyed = docs.withColumn(row, F.col("doc_id"))
        gone, _ = stash(dropped(docs.select("doc_id", "text")).distinct().withColumnRenamed("doc_id", row), "dropped")
        return keyed.join(gone, row, "left_anti").select(*docs.columns)
    marked = docs.join(repeated.withColumn(many, F.lit(True)), docs["doc_id"].eqNullSafe(repeated[row]), "left").drop(row)
    own = -1 - F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    marked = marked.withColumn(row, F.when(F.col(many), own).otherwise(F.col("doc_id")))
    gone, _ = stash(dropped(marked.select(F.col(row).alias("doc_id"), "text")).distinct().withColumnRenamed("doc_id", row), "dropped")
    kept = marked.join(gone, row, "left_anti")
    one = kept.filter(F.col(many)).groupBy(row, F.col("text").alias(fresh(docs, "_text"))).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(many))
    return kept.filter(F.col(many).isNull()).select(*docs.columns).unionByName(one.select(f"{many}.*"))


def dense_rank_in_groups(df: DataFrame, counted: DataFrame, group: list[str], hashed: Column, order: list[Column], out: str, total: int, chunk_rows: int = 20_000) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without bringing a group into one task.

    Rows are dealt by the whole number ``hashed`` into chunks of about ``chunk_rows``; each
    (group, chunk) cell is numbered by itself and shifted by the sizes of the cells
    before it.  ``counted`` is the same rows by a cheaper plan (only the columns of
    ``group`` and those that ``hashed`` needs), used for the cell sizes.  The table of cells is
    joined by shuffle: it has ``total / chunk_rows`` rows a group, which is not bounded.
    """
    chunks = max(1, math.ceil(total / chunk_rows))
    cell = F.pmod(hashed, F.lit(chunks)).alias("_chunk")
    sizes = counted.select(*group, cell).groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    starts = sizes.select(*group, "_chunk", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(*order)) - 1
    numbered = df.select("*", cell).withColumn("_within", within)
    return numbered.join(starts, [*group, "_chunk"]).withColumn(out, F.col("_before") + F.col("_within")).drop("_chunk", "_within", "_before")
