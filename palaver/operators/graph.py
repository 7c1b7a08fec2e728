"""Branches of a session: which placements its mainline has.

Parents are resolved and leaves are picked for all sessions at once by joins; only the
walk from a leaf to its root runs per session, over pointers of placements alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.instants import order_instant, sort_class
from palaver.schema import Store


def ordered_placements(store: Store) -> DataFrame:
    """Placements with ``at``, the key of their order: class and instant of the time, document, ordinal, id."""
    instant = order_instant(F.col("ts_raw"))
    timed = store.messages.select("message_id", "ts_raw", instant.alias("i"))
    joined = store.placements.join(timed, "message_id")
    kind = sort_class(F.col("ts_raw"), F.col("i"))
    at = F.struct(
        kind.alias("class"),
        F.when(kind == 1, F.col("ts_raw").cast("binary")).alias("text"),
        F.col("i.sec").alias("sec"),
        F.col("i.nanos").alias("nanos"),
        "document_id",
        "ordinal",
        "placement_id",
    )
    return joined.withColumn("at", at).drop("ts_raw", "i")


def full_order(store: Store) -> DataFrame:
    """Every placement of each session with its position from 0."""
    order = Window.partitionBy("session_id").orderBy("at")
    return ordered_placements(store).withColumn("position", F.row_number().over(order) - 1).drop("at")


def parents(store: Store) -> DataFrame:
    """(session_id, placement_id, parent_placement_id, ambiguous): the parent of a placement within its session.

    A parent message with one placement there is that one; with several, it is the one
    in the child's document, if there is exactly one; else the branch is ambiguous.
    """
    child = store.placements.select("session_id", F.col("placement_id").alias("child"), F.col("document_id").alias("child_document"))
    edge = store.edges.select(F.col("child_placement_id").alias("child"), "parent_message_id")
    target = store.placements.select("session_id", F.col("message_id").alias("parent_message_id"), F.col("placement_id").alias("parent"), F.col("document_id").alias("parent_document"))
    met = child.join(edge, "child").join(target, ["session_id", "parent_message_id"])
    same = F.col("parent_document") == F.col("child_document")
    grouped = met.groupBy("session_id", "child").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_same"), F.min("parent").alias("any"), F.min(F.when(same, F.col("parent"))).alias("same"))
    parent = F.when(F.col("n") == 1, F.col("any")).when(F.col("n_same") == 1, F.col("same"))
    return grouped.select("session_id", F.col("child").alias("placement_id"), parent.alias("parent_placement_id"), parent.isNull().alias("ambiguous"))


def orphans(store: Store) -> DataFrame:
    """(child_placement_id, parent_message_id) of edges whose parent no table holds, which is legal."""
    known = store.messages.select(F.col("message_id").alias("parent_message_id"))
    return store.edges.join(known, "parent_message_id", "left_anti").select("child_placement_id", "parent_message_id")


def leaves(store: Store) -> DataFrame:
    """(session_id, leaf): the placement a session's mainline ends in.

    Among placements off sidechains, or all where there is no such: those whose message
    is no candidate's parent, preferably with a parent themselves; the last in order.
    Where a cycle leaves no leaf, the last candidate.
    """
    every = ordered_placements(store).select("session_id", "placement_id", "message_id", "is_sidechain", "at")
    main = every.filter("NOT is_sidechain").select("session_id").distinct().withColumn("has_main", F.lit(True))
    candidate = every.join(main, "session_id", "left").filter("has_main IS NULL OR NOT is_sidechain")
    edge = store.edges.select(F.col("child_placement_id").alias("placement_id"), "parent_message_id")
    with_edge = candidate.join(edge, "placement_id", "left")
    used = with_edge.filter("parent_message_id IS NOT NULL").select("session_id", F.col("parent_message_id").alias("message_id")).distinct().withColumn("used", F.lit(True))
    rated = with_edge.join(used, ["session_id", "message_id"], "left")
    worth = F.struct(F.col("used").isNull().alias("leaf"), (F.col("used").isNull() & F.col("parent_message_id").isNotNull()).alias("with_parent"), "at")
    return rated.groupBy("session_id").agg(F.max_by("placement_id", worth).alias("leaf"))


def mainline(store: Store) -> DataFrame:
    """(session_id, placement_id, position, error): the mainline of every session, from its root.

    The walk crosses sidechain parents, ends at a root, at a parent that no table holds
    and at a placement it has seen; ``error`` is set where the walk itself, and not some
    other branch, met an ambiguous parent, and the session then has that one row.
    """
    pointers = store.placements.select("session_id", "placement_id").join(parents(store), ["session_id", "placement_id"], "left").join(leaves(store), "session_id")

    schema = pa.schema([("session_id", pa.string()), ("placement_id", pa.string()), ("position", pa.int32()), ("error", pa.string())])

    def walk(session: str, rows: list[tuple]) -> list[tuple]:
        up = {placement: parent for placement, parent, _, _ in rows}
        unclear = {placement for placement, _, ambiguous, _ in rows if ambiguous}
        at, chain, seen = rows[0][3], [], set()
        while at is not None and at not in seen:
            if at in unclear:
                return [(session, at, -1, "ambiguous parent")]
            seen.add(at)
            chain.append(at)
            at = up.get(at)
        return [(session, placement, k, None) for k, placement in enumerate(reversed(chain))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("session_id", "placement_id", "parent_placement_id", "ambiguous", "leaf")), strict=True))
        out: list[tuple] = []
        for session, own in groupby(rows, key=lambda r: r[0]):
            out += walk(session, [r[1:] for r in own])
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = pointers.select("session_id", "placement_id", "parent_placement_id", "ambiguous", "leaf").repartition("session_id").sortWithinPartitions("session_id")
    return dealt.mapInArrow(run, "session_id string, placement_id string, position int, error string")


def relation_of(is_sidechain):
    return F.when(is_sidechain, "subagent").otherwise("reply")
