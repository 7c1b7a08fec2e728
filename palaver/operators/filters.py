"""Predicates over hits (a DataFrame with ``message_id``), all of them joins or filters that run before any limit."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.instants import search_instant
from palaver.schema import Store

# A short name that stands for a provider.
ALIASES = {"claude": "claude-code"}
HIDDEN_ROLES = ("system", "developer")


def canonical_providers(names: Iterable[str]) -> list[str]:
    return sorted({ALIASES.get(n, n) for n in names})


def by_provider(hits: DataFrame, store: Store, providers: Iterable[str]) -> DataFrame:
    """Messages with a placement in a document of any of the providers."""
    own = store.documents.filter(F.col("provider_id").isin(*canonical_providers(providers))).select("document_id")
    return hits.join(store.placements.join(own, "document_id").select("message_id"), "message_id", "left_semi")


def by_time(hits: DataFrame, store: Store, since: tuple[int, int] | None = None, until: tuple[int, int] | None = None) -> DataFrame:
    """Messages at or after ``since`` and before ``until``; one without an instant matches neither.

    The stored second, where there is one, is that of the strict reading, so the scan
    prunes by it; only what is left is parsed.
    """
    stored, messages = F.col("ts_sec"), store.messages
    if since is not None:
        messages = messages.filter(stored.isNull() | (stored >= since[0]))
    if until is not None:
        messages = messages.filter(stored.isNull() | (stored <= until[0]))
    timed = messages.filter("ts_raw IS NOT NULL").select("message_id", search_instant(F.col("ts_raw")).alias("at")).filter("at IS NOT NULL")
    point = lambda p: F.struct(F.lit(p[0]).cast("long").alias("sec"), F.lit(p[1]).cast("int").alias("nanos"))
    if since is not None:
        timed = timed.filter(F.col("at") >= point(since))
    if until is not None:
        timed = timed.filter(F.col("at") < point(until))
    return hits.join(timed.select("message_id"), "message_id", "left_semi")


def by_repo(hits: DataFrame, store: Store, slug: str) -> DataFrame:
    own = store.sessions.filter(F.col("repo_slug") == slug).select("session_id")
    return hits.join(store.placements.join(own, "session_id").select("message_id"), "message_id", "left_semi")


def by_sidechain(hits: DataFrame, store: Store, facet: str) -> DataFrame:
    """``main_only``: without a sidechain placement.  ``subagent_only``: with one.  ``include``: all."""
    side = store.placements.filter("is_sidechain").select("message_id")
    return {"include": lambda: hits, "main_only": lambda: hits.join(side, "message_id", "left_anti"), "subagent_only": lambda: hits.join(side, "message_id", "left_semi")}[facet]()


def by_tool(hits: DataFrame, store: Store, kind: str | None = None, name: str | None = None) -> DataFrame:
    """Messages with an activity of the kind and the name; where both are given, one activity must have both."""
    own = store.tool_activities
    if kind is not None:
        own = own.filter(F.col("kind") == kind)
    if name is not None:
        own = own.filter(F.col("name") == name)
    return hits if kind is None and name is None else hits.join(own.select("message_id"), "message_id", "left_semi")


def visible(hits: DataFrame, store: Store, include_system: bool = False) -> DataFrame:
    """Without messages of system and developer; one without a role stays."""
    if include_system:
        return hits
    return hits.join(store.messages.filter(F.col("role").isin(*HIDDEN_ROLES)).select("message_id"), "message_id", "left_anti")
