"""Tables of the canonical model, closed vocabularies, and checks that a store is whole."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Closed vocabularies of the model.
ROLES = ("user", "assistant", "system", "developer", "tool")
RELATIONS = ("reply", "retry", "fork", "continuation", "subagent", "tool_result")
ACTIVITY_KINDS = ("file", "command", "web", "query", "unknown")
ACTORS = ("main", "subagent")
STATUSES = ("success", "error", "unknown")
TOKEN_SOURCES = ("observed", "derived")

DDL: dict[str, str] = {
    "messages": "message_id string, role string, text string, ts_raw string, ts_sec long, ts_nanos int, provider_id string",
    "placements": "placement_id string, session_id string, document_id string, message_id string, ordinal long, is_sidechain boolean, span_start long, span_end long",
    "edges": "child_placement_id string, parent_message_id string, parent_native_id string, relation string",
    "documents": "document_id string, provider_id string, variant_id string, fingerprint string, len long",
    "sessions": "session_id string, title string, repo_slug string",
    "tool_activities": "message_id string, kind string, actor string, name string, target string, status string",
    "usage_events": "session_id string, message_id string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long, token_source string",
    "resume_claims": "session_id string, provider_id string, provider_session_id string, cwd string, id_state string, cwd_state string, pair_observed boolean",
    "source_scans": "source_path string, provider_id string, document_id string, len_bytes long, fingerprint string, parser_version int, relation_complete boolean, message_count long, modified_ms long",
}


@dataclass(frozen=True)
class Store:
    """The canonical tables as DataFrames; nothing is read before a query needs it."""

    messages: DataFrame
    placements: DataFrame
    edges: DataFrame
    documents: DataFrame
    sessions: DataFrame
    tool_activities: DataFrame
    usage_events: DataFrame
    resume_claims: DataFrame
    source_scans: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        return cls(**{name: spark.createDataFrame([], ddl) for name, ddl in DDL.items()})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Store:
        return cls(**{name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in DDL.items()})

    def write(self, path: str) -> None:
        """One folder a table, several at once.  Tables that are read by session are clustered by it, so row groups can be skipped."""

        def one(name: str) -> None:
            df: DataFrame = getattr(self, name)
            if "session_id" in df.columns:
                df = df.repartitionByRange("session_id").sortWithinPartitions("session_id")
            df.write.mode("errorifexists").parquet(f"{path}/{name}")

        with ThreadPoolExecutor(4) as pool:
            list(pool.map(one, [f.name for f in fields(self)]))

    def union(self, other: Store) -> Store:
        return Store(**{f.name: getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)})

    def with_tables(self, **tables: DataFrame) -> Store:
        return replace(self, **tables)


def violations(store: Store) -> DataFrame:
    """(rule, n): how often each rule of the model is broken.  A parent that no table holds is legal and is not counted."""
    p, e, d, m = store.placements, store.edges, store.documents, store.messages
    repeated = lambda df, *keys: df.groupBy(*keys).count().filter("count > 1")
    found = {
        "unknown_role": m.filter(~F.col("role").isin(*ROLES) | F.col("role").isNull()),
        "unknown_relation": e.filter(~F.col("relation").isin(*RELATIONS)),
        "message_id_kind": m.filter(~F.col("message_id").startswith("msg_v1_")),
        "session_id_kind": p.filter(~F.col("session_id").startswith("ses_v1_")),
        "document_id_kind": d.filter(~F.col("document_id").startswith("doc_v1_")),
        "duplicate_message": repeated(m, "message_id"),
        "duplicate_document": repeated(d, "document_id"),
        "duplicate_placement": repeated(p, "placement_id"),
        "duplicate_coordinates": repeated(p, "session_id", "document_id", "message_id", "ordinal"),
        "missing_message": p.join(m, "message_id", "left_anti"),
        "missing_document": p.join(d, "document_id", "left_anti"),
        "bad_span": p.join(d, "document_id").filter("span_start > span_end OR span_end > len"),
        "two_edges": repeated(e, "child_placement_id"),
        "edge_without_child": e.join(p, e["child_placement_id"] == p["placement_id"], "left_anti"),
    }
    out = None
    for rule, df in found.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = row if out is None else out.unionByName(row)
    return out
