"""The catalog: merging what sources say of one entity, lookups, removals of what no source claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.schema import Store

#: Ids of one lookup.
MAX_IDS = 10_000


def merge_messages(claims: DataFrame) -> DataFrame:
    """One row a message out of claims (source_path, message_id, role, text, ts_raw, provider_id).

    Across sources the longest text wins, then the one that sorts first; the other fields
    must agree, which ``merge_conflicts`` checks.
    """
    best = F.max_by(F.struct("role", "text", "ts_raw", "provider_id", "source_path"), F.struct(F.coalesce(F.length("text"), F.lit(-1)), F.xxhash64("text"), "text", "source_path"))
    merged = claims.groupBy("message_id").agg(best.alias("m"), F.countDistinct("source_path").alias("sources"))
    return merged.select("message_id", "m.role", "m.text", "m.ts_raw", "m.provider_id", "sources")


def merge_conflicts(claims: DataFrame) -> DataFrame:
    """(message_id, rule): an id that one source gives two contents, or whose stable fields differ between sources."""
    told = lambda *c: F.countDistinct(F.struct(*(F.coalesce(F.col(x), F.lit("\0")).alias(x) for x in c)))
    within = claims.groupBy("source_path", "message_id").agg(told("role", "text", "ts_raw").alias("n")).filter("n > 1").select("message_id", F.lit("one source, two contents").alias("rule"))
    between = claims.groupBy("message_id").agg(told("role", "ts_raw", "provider_id").alias("n")).filter("n > 1").select("message_id", F.lit("sources disagree").alias("rule"))
    return within.unionByName(between).distinct()


def constant_or_null(placed: DataFrame, columns: list[str]) -> DataFrame:
    """Of each message's occurrences: the value that all of them have, null where they differ; nulls are values here."""
    same = lambda c: F.min(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v"))) == F.max(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")))
    out = [F.when(same(c), F.first(c)).alias(c) for c in columns]
    return placed.groupBy("message_id").agg(*out)


def payloads(store: Store) -> DataFrame:
    """Messages as the catalog shows them: content, and where it occurs."""
    placed = store.placements.join(store.edges.withColumnRenamed("child_placement_id", "placement_id"), "placement_id", "left")
    fields = constant_or_null(placed, ["is_sidechain", "parent_message_id", "parent_native_id"])
    listed = placed.groupBy("message_id").agg(F.array_sort(F.collect_set("session_id")).alias("sessions"), F.array_sort(F.collect_set(F.struct("document_id", "span_start", "span_end"))).alias("spans"))
    return store.messages.join(fields, "message_id", "left").join(listed, "message_id", "left").withColumn("session", F.when(F.size("sessions") == 1, F.col("sessions")[0]))


def get(table: DataFrame, wire_id: str, id_col: str = "message_id") -> DataFrame:
    return table.filter(F.col(id_col) == wire_id)


def get_many(table: DataFrame, ids: list[str], id_col: str = "message_id") -> DataFrame:
    """Rows in the order of ``ids``, which may repeat; ids that are missing give rows of nulls.

    The table is filtered by the ids first, which a scan can push down; what is joined is as long as the request.
    """
    if len(ids) > MAX_IDS:
        raise ValueError(f"at most {MAX_IDS} ids at once")
    asked = table.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, {id_col} string")
    return asked.join(table.filter(F.col(id_col).isin(*set(ids))), id_col, "left").orderBy("pos")


def list_page(table: DataFrame, limit: int, after: str | None = None, id_col: str = "message_id") -> DataFrame:
    """A page by id, from behind ``after``."""
    rest = table if after is None else table.filter(F.col(id_col) > after)
    return rest.orderBy(id_col).limit(limit)


def tombstones(known: DataFrame, found: DataFrame, complete: DataFrame) -> DataFrame:
    """Known paths (source_path, provider_id) that a complete scan of their provider did not find."""
    return known.join(complete.select("provider_id"), "provider_id", "left_semi").join(found.select("source_path"), "source_path", "left_anti")


def survivors(memberships: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of memberships (entity_id, source_path): those that stay, and entities that no source claims any more."""
    stay = memberships.join(gone.select("source_path"), "source_path", "left_anti")
    lost = memberships.select("entity_id").distinct().join(stay.select("entity_id"), "entity_id", "left_anti")
    return stay, lost


def orphan_counts(store: Store) -> DataFrame:
    """One row: activities and usage events whose message the catalog doesn't have."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    lost = count(store.tool_activities.join(store.messages, "message_id", "left_anti"), "activities")
    return lost.crossJoin(count(store.usage_events.filter("message_id IS NOT NULL").join(store.messages, "message_id", "left_anti"), "usage_events"))  # one row each


def purge_orphans(store: Store) -> Store:
    has = store.messages.select("message_id")
    known = store.placements.select("session_id").distinct()
    return store.with_tables(tool_activities=store.tool_activities.join(has, "message_id", "left_semi"), resume_claims=store.resume_claims.join(known, "session_id", "left_semi"))


def sequence(events: DataFrame, source: str = "source_path", place: str = "line_no") -> DataFrame:
    """Numbers from 0 in each source, in the order of its records."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(source).orderBy(place)) - 1)
