"""A bounded pack of evidence for handing a task over: at most as many entries as a search has hits, so it ends on the driver."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.redact import redact
from palaver.functions.text import estimate_tokens
from palaver.operators.sessions import authoritative_placement, message_facts
from palaver.schema import Store

HIT_LIMIT = 50
PREVIEW_CHARS = 256


def candidates(hits: DataFrame, store: Store) -> DataFrame:
    """Hits (id, score, rank, session_id, text) as evidence: redacted, located, costed; those without text or place are left out."""
    located = hits.join(authoritative_placement(store).select(F.col("message_id").alias("id"), "document_id", "span_start", "span_end"), "id")
    facts = message_facts(store, hits.select(F.col("id").alias("message_id")))
    clean = located.filter("text != ''").withColumn("clean", redact(F.col("text")))
    told = clean.join(facts.withColumnRenamed("message_id", "id"), "id", "left")
    return told.withColumn("redacted", F.col("clean") != F.col("text")).withColumn("text", F.col("clean")).drop("clean").withColumn("tokens", estimate_tokens(F.col("text")))


def within_budget(evidence: DataFrame, max_evidence: int, max_tokens: int) -> DataFrame:
    """With ``kept``: the first entries by rank, up to a number, and of them the prefix whose tokens fit."""
    order = Window.orderBy("rank")
    numbered = evidence.withColumn("_n", F.row_number().over(order))
    spent = F.sum(F.when(F.col("_n") <= max_evidence, F.col("tokens"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("kept", (F.col("_n") <= max_evidence) & (spent <= max_tokens)).drop("_n")


def matched_sessions(hits: DataFrame) -> DataFrame:
    """Sessions of the hits in order of appearance, with the score of the first and the number of hits."""
    grouped = hits.filter("session_id LIKE 'ses\\_v1\\_%'").groupBy("session_id").agg(F.min("rank").alias("first_rank"), F.max_by("score", -F.col("rank")).alias("relevance_score"), F.count(F.lit(1)).alias("occurrences"))
    return grouped.orderBy("first_rank")


def build_pack(hits: DataFrame, store: Store, *, query: str, generation: int, max_evidence: int = 20, max_tokens: int = 8000, max_bytes: int = 256 * 1024) -> dict:
    """The pack as a JSON value.  Entries are dropped from the end until the content fits in ``max_bytes``."""
    rows = [r.asDict() for r in within_budget(candidates(hits, store), max_evidence, max_tokens).orderBy("rank").collect()]
    sessions = [r.asDict() for r in matched_sessions(hits).drop("first_rank").collect()]
    kept, dropped = [r for r in rows if r["kept"]], [r for r in rows if not r["kept"]]
    reason = None if not dropped else "max_evidence" if len(rows) > max_evidence and len(kept) == max_evidence else "budget_exceeded"

    def content() -> dict:
        return {
            "evidence": [{k: r[k] for k in ("id", "document_id", "session_id", "span_start", "span_end", "text")} for r in kept],
            "mainline": [{"id": r["id"], "session_id": r["session_id"], "role": r["role"] or "unknown", "ordinal": k, "text_preview": r["text"][:PREVIEW_CHARS], "is_sidechain": bool(r["is_sidechain"])} for k, r in enumerate(kept)],
            "matched_sessions": sessions,
        }

    while (size := len(json.dumps(content(), ensure_ascii=False).encode())) > max_bytes and kept:
        dropped.append(kept.pop())
        reason = "max_bytes"
    confidence = "low" if not kept else "medium" if len(sessions) > 1 else "high"
    asked = json.dumps([generation, query, max_evidence, max_tokens, max_bytes])
    locator = lambda r: {"document_id": r["document_id"], "cursor": r["id"]}
    return content() | {
        "pack_id": hashlib.sha256(asked.encode()).hexdigest()[:32],
        "catalog_generation": generation,
        "query": query,
        "confidence": {"overall": confidence, "per_session": [{"session_id": s["session_id"], "confidence": confidence} for s in sessions]},
        "budget": {"max_tokens": max_tokens, "max_bytes": max_bytes, "max_evidence": max_evidence, "used_tokens": sum(r["tokens"] for r in kept), "used_bytes": size},
        "truncation": {"truncated": bool(dropped), "reason": reason, "dropped_count": len(dropped), "dropped_locators": [locator(r) for r in dropped]},
        "redaction": {"redacted_count": sum(r["redacted"] for r in kept)},
        "source_locators": list({(r["document_id"], r["id"]): locator(r) for r in kept}.values()),
    }
