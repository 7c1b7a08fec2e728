"""Facts of sessions: members, owners, summaries, talks, titles, windows of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.schema import Store

PEEK_CHARS, PEEK_BYTES, PEEK_STEP, TITLE_CHARS = 200, 1024, 32, 80
MAX_CANDIDATES = 8


def occurrences(store: Store) -> DataFrame:
    """Placements with what their messages say."""
    return store.placements.join(store.messages.select("message_id", "role", "text", "ts_raw", "ts_sec", "ts_nanos"), "message_id")


def owning_session(store: Store) -> DataFrame:
    return store.placements.groupBy("message_id").agg(F.min("session_id").alias("session_id"))


def authoritative_placement(store: Store) -> DataFrame:
    """The placement in the smallest document; there the one of the smallest ordinal."""
    best = F.min_by(F.struct("placement_id", "session_id", "document_id", "span_start", "span_end"), F.struct("document_id", "ordinal", "placement_id"))
    return store.placements.groupBy("message_id").agg(best.alias("p")).select("message_id", "p.*")


def message_contexts(store: Store) -> DataFrame:
    """Sessions that hold a message, each with its placements in order."""
    return store.placements.groupBy("message_id", "session_id").agg(F.array_sort(F.collect_set("placement_id")).alias("placements"))


def ambiguous_messages(store: Store) -> DataFrame:
    """Messages of several sessions: how many, and the first eight."""
    owners = store.placements.select("message_id", "session_id").distinct()
    grouped = owners.groupBy("message_id").agg(F.count(F.lit(1)).alias("sessions"), F.array_sort(F.collect_set("session_id")).alias("all"))
    return grouped.filter("sessions > 1").select("message_id", "sessions", F.slice("all", 1, MAX_CANDIDATES).alias("candidates"))


def members(store: Store) -> DataFrame:
    """The distinct messages of each session in the order of their first placement."""
    first = store.placements.groupBy("session_id", "message_id").agg(F.min(F.struct("document_id", "ordinal")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "message_id")))
    return first.groupBy("session_id").agg(F.transform(listed, lambda m: m["message_id"]).alias("messages"))


def summary(placed: DataFrame) -> DataFrame:
    """Of occurrences (session_id, document_id, ordinal, role, text): first user message, counts, documents in order of appearance."""
    at = F.struct("document_id", "ordinal")
    documents = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "document_id"))), lambda x: x["document_id"]))
    user = F.col("role") == "user"
    return placed.groupBy("session_id").agg(
        F.min_by(F.when(user, F.col("text")), F.when(user, at)).alias("first_user_message"),
        F.count(F.lit(1)).alias("message_count"),
        F.count_if(user).alias("turn_count"),
        documents.alias("documents"),
    )


def talks(placed: DataFrame) -> DataFrame:
    """A talk is a user message and the assistant and tool messages up to the next; what comes before the first, and system and developer messages, belong to none."""
    order = Window.partitionBy("session_id").orderBy("document_id", "ordinal")
    heard = placed.filter(F.col("role").isin("user", "assistant", "tool"))
    numbered = heard.withColumn("talk", F.sum((F.col("role") == "user").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    replies = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.struct("document_id", "ordinal", "message_id")))), lambda r: r["message_id"])
    return numbered.filter("talk > 0").groupBy("session_id", "talk").agg(F.max(F.when(F.col("role") == "user", F.col("message_id"))).alias("user_message"), replies.alias("replies"))


def _said(placed: DataFrame) -> DataFrame:
    return placed.filter("role = 'user'").withColumn("t", F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).filter("t != ''")


def first_request(placed: DataFrame) -> DataFrame:
    """First user text of each session, trimmed and whole; blank texts don't count."""
    return _said(placed).groupBy("session_id").agg(F.min_by("t", F.struct("document_id", "ordinal")).alias("first_request"))


def search_text(store: Store) -> DataFrame:
    """(session_id, text): what a session is found by, its provider's id, folder and whole first request, of which search sees as much as of any text."""
    claims = store.resume_claims.groupBy("session_id").agg(F.min("provider_session_id").alias("native"), F.min("cwd").alias("cwd"))
    told = store.sessions.select("session_id").join(claims, "session_id", "left").join(first_request(occurrences(store)), "session_id", "left")
    return told.select("session_id", F.concat_ws(" ", "native", "cwd", "first_request").alias("text"))


def peek(placed: DataFrame) -> DataFrame:
    """First and last user text of each session, trimmed and cut; blank texts don't count."""
    at = F.struct("document_id", "ordinal")
    cut = _said(placed).groupBy("session_id").agg(F.substring(F.min_by("t", at), 1, PEEK_CHARS).alias("first_user_text"), F.substring(F.max_by("t", at), 1, PEEK_CHARS).alias("last_user_text"))
    return fit_peek(cut)


def fit_peek(peeks: DataFrame) -> DataFrame:
    """Cut 32 characters at a time from the larger text, the last one on a tie, until both as JSON fit in 1024 bytes."""
    texts = lambda a, b: F.octet_length(F.to_json(F.struct(a.alias("first_user_text"), b.alias("last_user_text")), {"ignoreNullFields": "false"}))

    def step(s, _):
        a, b = s["a"], s["b"]
        fits = texts(a, b) <= PEEK_BYTES
        last = F.octet_length(b) >= F.octet_length(a)
        shorter = lambda t: F.substring(t, F.lit(1), F.greatest(F.length(t) - PEEK_STEP, F.lit(0)))
        return F.struct(F.when(fits | last, a).otherwise(shorter(a)).alias("a"), F.when(fits | ~last, b).otherwise(shorter(b)).alias("b"))

    rounds = F.sequence(F.lit(1), F.lit(2 * PEEK_CHARS // PEEK_STEP + 2))  # as many as both texts can be cut
    start = F.struct(F.col("first_user_text").alias("a"), F.col("last_user_text").alias("b"))
    fitted = peeks.withColumn("s", F.aggregate(rounds, start, step))
    return fitted.withColumn("first_user_text", F.col("s.a")).withColumn("last_user_text", F.col("s.b")).drop("s")


def titles(store: Store, summaries: DataFrame | None = None, ai_summaries: DataFrame | None = None) -> DataFrame:
    """Custom title, else a generated summary, else the first user message, at most 80 characters."""
    first = peek(occurrences(store)).select("session_id", "first_user_text")
    base = store.sessions.select("session_id", "title").join(first, "session_id", "left")
    if ai_summaries is not None:
        base = base.join(ai_summaries.select("session_id", "summary"), "session_id", "left")
    else:
        base = base.withColumn("summary", F.lit(None).cast("string"))
    filled = lambda c: F.when(F.trim(c) != "", c)
    return base.select("session_id", F.substring(F.coalesce(*(filled(F.col(c)) for c in ("title", "summary", "first_user_text"))), 1, TITLE_CHARS).alias("title"))


def latest_activity(store: Store) -> DataFrame:
    timed = store.placements.select("session_id", "message_id").distinct().join(store.messages.select("message_id", "ts_sec").filter("ts_sec IS NOT NULL"), "message_id")
    return timed.groupBy("session_id").agg(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.max("ts_sec")), F.current_timezone()), "yyyy-MM-dd").alias("latest"))


def message_window(chain: DataFrame, anchor: str, around: int) -> DataFrame:
    """Rows of a chain (position, message_id) within ``around`` of the anchor, which must occur exactly once."""
    at = [r["position"] for r in chain.filter(F.col("message_id") == anchor).select("position").limit(2).collect()]
    if len(at) != 1:
        raise LookupError("anchor not on the mainline" if not at else "anchor occurs more than once")
    return chain.filter(F.col("position").between(at[0] - around, at[0] + around))


def message_facts(store: Store, ids: DataFrame) -> DataFrame:
    """(message_id, role, is_sidechain): whether any placement is on a sidechain."""
    side = store.placements.groupBy("message_id").agg(F.bool_or("is_sidechain").alias("is_sidechain"))
    return ids.join(store.messages.select("message_id", "role"), "message_id").join(side, "message_id", "left").select("message_id", "role", F.coalesce("is_sidechain", F.lit(False)).alias("is_sidechain"))
