"""Ranks, fusion of ranks, signals, groups and pages.  Every order ends in the id, so it is total."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Constants of the ranking contract.
RRF_K = 60
SIDECHAIN_PENALTY = 0.25 / 61
REPO_BOOST = 0.5 / 61
DECAY_FLOOR = 0.3
HALF_LIFE_DAYS = 30
RANK_WINDOW = 512
GROUP_FACTOR = 16
MAX_FETCH = 1 << 20
#: Queries of one batch of vector searches.
MAX_QUERIES = 4096
#: Keys whose other bits are alike form a block of a running total.
BLOCK_BITS = 13


def ranked(hits: DataFrame, score: str, id_col: str = "id", limit: int = RANK_WINDOW) -> DataFrame:
    """The best ``limit`` hits with ``rank`` from 1.  The limit comes first, so that what is numbered in one task has its bound."""
    best = hits.orderBy(F.col(score).desc(), F.col(id_col)).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(id_col))))


def rrf(rank: Column) -> Column:
    return 1.0 / (RRF_K + rank)


def union_of_corpora(*corpora: DataFrame) -> DataFrame:
    """(id, score) of ranked hits whose ids are of different kinds: each hit has the one term of its own rank."""
    out = None
    for hits in corpora:
        own = hits.select("id", rrf(F.col("rank")).alias("score"))
        out = own if out is None else out.unionByName(own)
    return out


def recency_decay(ts_sec: Column, now_ms: int) -> Column:
    """Halves every 30 days down to 0.3; no time, or one to come, is no age."""
    age_ms = F.greatest(F.lit(0), F.lit(now_ms) - F.coalesce(ts_sec * 1000, F.lit(now_ms)))
    return F.greatest(F.lit(DECAY_FLOOR), F.pow(F.lit(0.5), age_ms / (HALF_LIFE_DAYS * 86_400_000.0)))


def final_score(relevance: Column, ts_sec: Column, is_sidechain: Column, in_repo: Column, now_ms: int) -> Column:
    side = F.when(F.coalesce(is_sidechain, F.lit(False)), SIDECHAIN_PENALTY).otherwise(0.0)
    repo = F.when(F.coalesce(in_repo, F.lit(False)), REPO_BOOST).otherwise(0.0)
    score = F.greatest(F.lit(0.0), relevance * recency_decay(ts_sec, now_ms) - side + repo)
    return F.when((relevance > 0) & ~F.isnan(relevance), score).otherwise(0.0)


def fuse(lexical: DataFrame, semantic: DataFrame, weight_lexical: float = 0.5, weight_semantic: float = 0.5) -> DataFrame:
    """(id, score) of two ranked lists: the weighted sum of what each rank is worth, 0 where a list lacks the id."""
    total = weight_lexical + weight_semantic
    if total <= 0 or min(weight_lexical, weight_semantic) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    left = lexical.select("id", F.col("rank").alias("rl"))
    right = semantic.select("id", F.col("rank").alias("rs"))
    part = lambda r, w: F.coalesce(rrf(F.col(r)), F.lit(0.0)) * (w / total)
    return left.join(right, "id", "full").select("id", (part("rl", weight_lexical) + part("rs", weight_semantic)).alias("score"))


def page(hits: DataFrame, offset: int, limit: int, score: str = "score", id_col: str = "id") -> DataFrame:
    if offset < 0 or limit <= 0 or offset + limit > MAX_FETCH:
        raise ValueError("page out of range")
    return hits.orderBy(F.col(score).desc(), F.col(id_col)).offset(offset).limit(limit)


def group_by_session(hits: DataFrame, score: str = "score", id_col: str = "id", session: str = "session_id") -> DataFrame:
    """The best hit of each session, with ``occurrences`` of the session among the hits; a hit without one is its own group.

    Hits are at most a rank window, so sessions in it are as well.
    """
    key = F.coalesce(F.col(session), F.col(id_col))
    by_key = Window.partitionBy("_group")
    keyed = hits.withColumn("_group", key)
    numbered = keyed.withColumn("_n", F.row_number().over(by_key.orderBy(F.col(score).desc(), F.col(id_col)))).withColumn("occurrences", F.count(F.lit(1)).over(by_key))
    return numbered.filter("_n = 1").drop("_n", "_group")


def top_k_cosine(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "embedding", floor: float | None = None) -> DataFrame:
    """(id, cosine) of the k nearest rows at or above the floor: a partial top k in each task, then one merge.  Vectors that are empty or not finite are near nothing."""
    from palaver.functions.vectors import cosine, is_finite, norm

    size = sum(x * x for x in query) ** 0.5
    if not query or not size < float("inf"):
        raise ValueError("a query vector must be finite and not empty")
    unit = F.array(*(F.lit(x / size if size else 0.0) for x in query))
    scored = vectors.filter(is_finite(F.col(vector))).select(F.col(id_col).alias("id"), (cosine(F.col(vector), unit) / F.greatest(norm(F.col(vector)), F.lit(1e-30))).alias("cosine"))
    if floor is not None:
        scored = scored.filter(F.col("cosine") >= floor)
    return scored.orderBy(F.col("cosine").desc(), "id").limit(k)


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, cosine) of the k nearest other rows to each of a bounded number of queries: one product of matrices a batch, the best of each batch, then one merge.

    Similarities are compared to six decimals, then by id; vectors that are empty or not finite are near nothing.
    """
    from palaver.functions.vectors import is_finite

    asked = queries.filter(is_finite(F.col(vector))).select(id_col, vector).limit(MAX_QUERIES + 1).collect()
    if len(asked) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} queries at once")
    names = np.array([r[0] for r in asked], np.int64)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    wanted = unit(np.array([r[1] for r in asked], float)) if asked else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            ids = batch.column(0).to_numpy()
            near = np.round(unit(np.array(batch.column(1).to_pylist(), float)) @ wanted.T, 6)
            near[ids[:, None] == names[None, :]] = -2  # not its own neighbour
            order = np.lexsort((np.broadcast_to(ids[:, None], near.shape).T, -near.T), axis=1)[:, :k]
            found = np.take_along_axis(near.T, order, 1)
            keep = found > -2
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, order.shape[1])[keep.ravel()]), pa.array(ids[order][keep]), pa.array(found[keep])], ["query_id", "id", "cosine"])

    fine = vectors.filter(is_finite(F.col(vector)) & (F.size(vector) == wanted.shape[1])).select(F.col(id_col).cast("long"), vector)
    best = fine.mapInArrow(run, "query_id long, id long, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return best.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def running_budget(items: DataFrame, order: list[Column], cost: str, limit: int, partition: list[str] | None = None) -> DataFrame:
    """The longest prefix whose costs sum to at most ``limit``: after the first item that does not fit, none is taken."""
    window = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("running", F.sum(cost).over(window)).filter(F.col("running") <= limit)


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _sums_before(blocks: DataFrame, bits: int) -> DataFrame:
    """Blocks (block, total), each once, with ``before``, the sum of all smaller ones, null if there is none; null blocks come last."""
    order = Window.orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    if bits <= BLOCK_BITS:  # so few numbers are left
        return blocks.withColumn("before", F.sum("total").over(order))
    upper = F.shiftright("block", BLOCK_BITS)
    above = blocks.groupBy(upper.alias("upper")).agg(F.sum("total").alias("total"))
    above = _sums_before(above.withColumnRenamed("upper", "block"), bits - BLOCK_BITS).select(F.col("block").alias("_upper"), F.col("before").alias("_above"))
    order = Window.partitionBy("upper").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.withColumn("upper", upper).withColumn("_inner", F.sum("total").over(order))
    joined = inner.join(above, F.col("upper").eqNullSafe(F.col("_upper")))
    return joined.select("block", "total", _plus(F.col("_inner"), F.col("_above")).alias("before"))


def running_total(items: DataFrame, key: str, cost: str) -> DataFrame:
    """``items`` with ``running``, the sum of ``cost`` up to and with their ``key``, a whole number; null keys come last.

    For tables of any size: sums of blocks of keys, of blocks of blocks and so on are
    added, so no task gets more than the rows of 2^13 keys.  Rows that share a key share
    their sum.
    """
    keys = items.groupBy(F.col(key).cast("long").alias("block")).agg(F.sum(cost).alias("total"))
    totals = _sums_before(keys, 64).select(F.col("block").alias("_key"), _plus(F.col("total"), F.col("before")).alias("running"))
    return items.join(totals, F.col(key).cast("long").eqNullSafe(F.col("_key"))).drop("_key")
