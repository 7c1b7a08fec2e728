"""The canonical tables seen in the driver's tables, by rules that SQL can state as well: the stand-in for a store of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.instants import iso_utc
from palaver.operators.graph import relation_of
from palaver.schema import Store

PROVIDERS = ("claude-code", "codex", "opencode", "pi")
EPOCH = 1_700_000_000
NOW_MS = (EPOCH + 90 * 86_400) * 1000
KINDS = {"click": "command", "view": "file", "purchase": "web", "search": "query"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(spark: SparkSession, sf_dir: str) -> Store:
    said, events = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "events")
    c, t = F.col("conv_id"), F.col("turn")
    wire = lambda prefix, *parts: F.concat(F.lit(prefix), *(p if not isinstance(p, str) else F.lit(p) for p in parts))
    message = wire("msg_v1_c", c.cast("string"), "t", t.cast("string"))
    session, document = wire("ses_v1_c", c.cast("string")), wire("doc_v1_c", c.cast("string"))
    seconds = F.when(c % 10 != 9, EPOCH + c * 131 + t * 60)
    provider = F.element_at(F.array(*map(F.lit, PROVIDERS)), (c % 4 + 1).cast("int"))
    messages = said.select(message.alias("message_id"), "role", "text", iso_utc(seconds).alias("ts_raw"), seconds.cast("long").alias("ts_sec"), F.when(seconds.isNotNull(), 0).alias("ts_nanos"), provider.alias("provider_id"))
    nothing = F.lit(None).cast("long")
    own = said.select(wire("plc_v1_c", c.cast("string"), "t", t.cast("string")).alias("placement_id"), session.alias("session_id"), document.alias("document_id"), message.alias("message_id"), t.alias("ordinal"), (t % 7 == 5).alias("is_sidechain"))
    copy = said.filter((c % 5 == 0) & (t == 0)).select(wire("plc_v1_x", c.cast("string")).alias("placement_id"), wire("ses_v1_c", (c + 1).cast("string")).alias("session_id"), document.alias("document_id"), message.alias("message_id"), t.alias("ordinal"), F.lit(True).alias("is_sidechain"))
    placements = own.unionByName(copy).select("*", nothing.alias("span_start"), nothing.alias("span_end"))
    edges = said.filter(t > 0).select(
        wire("plc_v1_c", c.cast("string"), "t", t.cast("string")).alias("child_placement_id"), wire("msg_v1_c", c.cast("string"), "t", (t - 1).cast("string")).alias("parent_message_id"), F.lit(None).cast("string").alias("parent_native_id"), relation_of(t % 7 == 5).alias("relation")
    )
    convs = said.select("conv_id").distinct()
    documents = convs.select(document.alias("document_id"), provider.alias("provider_id"), F.lit("jsonl-v1").alias("variant_id"), F.sha2(c.cast("string"), 256).alias("fingerprint"), (c * 100).alias("len"))
    sessions = convs.select(session.alias("session_id"), F.when(c % 3 == 0, wire("Title ", c.cast("string"))).alias("title"), F.when(c % 7 != 6, wire("github.com/acme/r", (c % 7).cast("string"))).alias("repo_slug"))
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.lit("unknown")
    for name, k in KINDS.items():
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    at = wire("msg_v1_c", (u % 200).cast("string"), "t", (e % 3).cast("string"))
    activities = events.select(at.alias("message_id"), kind.alias("kind"), F.when(e % 5 == 0, "subagent").otherwise("main").alias("actor"), F.col("event_type").alias("name"), F.get_json_object("props", "$.k").alias("target"), F.when(e % 7 == 0, "error").otherwise("success").alias("status"))
    usage = events.select(
        wire("ses_v1_c", (u % 200).cast("string")).alias("session_id"), at.alias("message_id"), (e % 1000).alias("input_tokens"), (e % 97).alias("output_tokens"), (e % 11).alias("cache_read_tokens"), (e % 5).alias("cache_write_tokens"), (e % 3).alias("reasoning_tokens"), F.when(e % 3 == 0, "derived").otherwise("observed").alias("token_source")
    )
    claims = convs.select(
        session.alias("session_id"), provider.alias("provider_id"), F.when(c % 4 != 3, wire("p", c.cast("string"))).alias("provider_session_id"), F.when(c % 2 == 0, wire("/home/w", (c % 9).cast("string"))).alias("cwd"), F.when(c % 4 == 3, "missing").when(c % 13 == 5, "ambiguous").otherwise("resolved").alias("id_state"), F.when(c % 2 == 0, "resolved").otherwise("missing").alias("cwd_state"), (c % 2 == 0).alias("pair_observed")
    )
    scans = convs.select(wire("/src/", c.cast("string"), ".jsonl").alias("source_path"), provider.alias("provider_id"), document.alias("document_id"), (c * 100).alias("len_bytes"), F.sha2(c.cast("string"), 256).alias("fingerprint"), F.lit(1).alias("parser_version"), (c % 6 != 0).alias("relation_complete"), F.lit(0).cast("long").alias("message_count"), (c * 1000).alias("modified_ms"))
    return Store(messages, placements, edges, documents, sessions, activities, usage, claims, scans)


#: The same rules in SQL; registered queries begin with it.
SQL = """
WITH messages AS (
  SELECT 'msg_v1_c' || conv_id || 't' || turn AS message_id, role, text,
    CASE WHEN conv_id % 10 <> 9 THEN strftime(make_timestamp((1700000000 + conv_id * 131 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS ts_raw,
    CASE WHEN conv_id % 10 <> 9 THEN 1700000000 + conv_id * 131 + turn * 60 END AS ts_sec,
    ['claude-code', 'codex', 'opencode', 'pi'][conv_id % 4 + 1] AS provider_id
  FROM conversations
), placements AS (
  SELECT 'plc_v1_c' || conv_id || 't' || turn AS placement_id, 'ses_v1_c' || conv_id AS session_id, 'doc_v1_c' || conv_id AS document_id,
    'msg_v1_c' || conv_id || 't' || turn AS message_id, turn AS ordinal, turn % 7 = 5 AS is_sidechain FROM conversations
  UNION ALL
  SELECT 'plc_v1_x' || conv_id, 'ses_v1_c' || (conv_id + 1), 'doc_v1_c' || conv_id, 'msg_v1_c' || conv_id || 't' || turn, turn, true
  FROM conversations WHERE conv_id % 5 = 0 AND turn = 0
), edges AS (
  SELECT 'plc_v1_c' || conv_id || 't' || turn AS child_placement_id, 'msg_v1_c' || conv_id || 't' || (turn - 1) AS parent_message_id,
    CASE WHEN turn % 7 = 5 THEN 'subagent' ELSE 'reply' END AS relation FROM conversations WHERE turn > 0
), convs AS (SELECT DISTINCT conv_id FROM conversations
), docs AS (
  SELECT 'doc_v1_c' || conv_id AS document_id, ['claude-code', 'codex', 'opencode', 'pi'][conv_id % 4 + 1] AS provider_id FROM convs
), sessions AS (
  SELECT 'ses_v1_c' || conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'Title ' || conv_id END AS title,
    CASE WHEN conv_id % 7 <> 6 THEN 'github.com/acme/r' || (conv_id % 7) END AS repo_slug FROM convs
), tool_activities AS (
  SELECT 'msg_v1_c' || (user_id % 200) || 't' || (event_id % 3) AS message_id,
    CASE event_type WHEN 'click' THEN 'command' WHEN 'view' THEN 'file' WHEN 'purchase' THEN 'web' WHEN 'search' THEN 'query' ELSE 'unknown' END AS kind,
    CASE WHEN event_id % 5 = 0 THEN 'subagent' ELSE 'main' END AS actor, event_type AS name, json_extract_string(props, '$.k') AS target,
    CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status FROM events
), usage_events AS (
  SELECT 'ses_v1_c' || (user_id % 200) AS session_id, 'msg_v1_c' || (user_id % 200) || 't' || (event_id % 3) AS message_id,
    event_id % 1000 AS input_tokens, event_id % 97 AS output_tokens, event_id % 11 AS cache_read_tokens, event_id % 5 AS cache_write_tokens,
    event_id % 3 AS reasoning_tokens, CASE WHEN event_id % 3 = 0 THEN 'derived' ELSE 'observed' END AS token_source FROM events
), resume_claims AS (
  SELECT 'ses_v1_c' || conv_id AS session_id, ['claude-code', 'codex', 'opencode', 'pi'][conv_id % 4 + 1] AS provider_id,
    CASE WHEN conv_id % 4 <> 3 THEN 'p' || conv_id END AS provider_session_id, CASE WHEN conv_id % 2 = 0 THEN '/home/w' || (conv_id % 9) END AS cwd,
    CASE WHEN conv_id % 4 = 3 THEN 'missing' WHEN conv_id % 13 = 5 THEN 'ambiguous' ELSE 'resolved' END AS id_state FROM convs
), placed AS (SELECT p.*, m.role, m.text, m.ts_sec FROM placements p JOIN messages m USING (message_id))
"""
