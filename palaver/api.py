"""The engine: requests over a store, each a DataFrame until its page is collected."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import cursors, places
from palaver.functions.instants import relative_millis, search_instant
from palaver.functions.snippet import snippet
from palaver.functions.text import estimate_tokens, json_string_bytes, literal_terms, suggested_commands, why_matched
from palaver.functions.vectors import DIMENSIONS, MODEL_ID, embed, embed_text
from palaver.operators import budgets, filters, graph, handoff, lexical, merge, ranking, sessions, usage
from palaver.schema import Store
from palaver.sources import ingest, providers, reading


class InvalidRequest(ValueError):
    pass


class NotFound(LookupError):
    pass


@dataclass(frozen=True)
class Search:
    """A search; ``mode`` is lexical, semantic or hybrid."""

    query: str
    limit: int = 20
    offset: int = 0
    mode: str = "lexical"
    providers: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    repo: str | None = None
    current_repo: str | None = None
    sidechain: str = "include"
    tool_kind: str | None = None
    tool_name: str | None = None
    include_system: bool = False
    group_by_session: bool = False
    similarity_floor: float = 0.0
    budget: budgets.Budget = field(default_factory=budgets.Budget)

    def validate(self) -> None:
        if not self.query.strip() or any(ord(c) < 32 and c not in "\t\n\r" for c in self.query):
            raise InvalidRequest("query must have text and no control characters")
        if self.limit <= 0 or self.offset < 0 or self.offset + self.limit > ranking.MAX_FETCH:
            raise InvalidRequest("page out of range")
        if self.mode not in ("lexical", "semantic", "hybrid") or self.sidechain not in ("include", "main_only", "subagent_only"):
            raise InvalidRequest("unknown mode or facet")


class Engine:
    """``index`` is the folder of a generation's postings; without one, search reads the texts."""

    def __init__(self, spark: SparkSession, store: Store, *, now_ms: int, vectors: DataFrame | None = None, generation: int = 0, index: str | None = None) -> None:
        self.spark, self.store, self.now_ms, self.vectors, self.generation, self.index = spark, store, now_ms, vectors, generation, index

    @classmethod
    def open(cls, spark: SparkSession, generations: ingest.Generations, *, now_ms: int, vectors: DataFrame | None = None) -> Engine:
        """The engine over the current generation and its index."""
        return cls(spark, generations.open(spark), now_ms=now_ms, vectors=vectors, generation=generations.current(spark)["generation"], index=generations.index(spark))

    # --- search -----------------------------------------------------------------------

    def _instant(self, value: str | None) -> tuple[int, int] | None:
        if value is None:
            return None
        ms = relative_millis(value, self.now_ms)
        if ms is not None:
            return ms // 1000, ms % 1000 * 1_000_000
        at = self.spark.range(1).select(search_instant(F.lit(value)).alias("at")).first()[0]
        if at is None:
            raise InvalidRequest("a time needs a zone")
        return at["sec"], at["nanos"]

    def _allowed(self, q: Search) -> DataFrame | None:
        """Messages that pass every filter; None if there is none to pass."""
        since, until = self._instant(q.since), self._instant(q.until)
        if since and until and since >= until:
            raise InvalidRequest("since must be before until")
        s, out = self.store, self.store.messages.select("message_id")
        if q.providers:
            out = filters.by_provider(out, s, q.providers)
        if since or until:
            out = filters.by_time(out, s, since, until)
        if q.repo:
            out = filters.by_repo(out, s, q.repo)
        out = filters.by_sidechain(out, s, q.sidechain)
        out = filters.by_tool(out, s, q.tool_kind, q.tool_name)
        out = filters.visible(out, s, q.include_system)
        plain = not (q.providers or since or until or q.repo or q.tool_kind or q.tool_name or q.include_system is False or q.sidechain != "include")
        return None if plain else out

    def _found(self, corpus: str, query: str) -> DataFrame:
        """(id, bm25) in the messages or sessions, by postings where there are any."""
        if self.index is not None:
            return lexical.index_search(self.spark, f"{self.index}/{corpus}", query)
        if corpus == "messages":
            return lexical.scan_search(self.store.messages, "message_id", "text", query)
        return lexical.scan_search(self.session_corpus(), "session_id", "text", query)

    def _lexical(self, q: Search, window: int) -> DataFrame:
        """Ranked hits of messages and of sessions, by rank alone, before any signal; words are weighed over all of a corpus, filters come after."""
        allowed = self._allowed(q)
        found = self._found("messages", q.query)
        if allowed is not None:
            found = found.join(allowed.withColumnRenamed("message_id", "id"), "id", "left_semi")
        hits = [ranking.ranked(found, "bm25", limit=window)]
        if not (q.since or q.until or q.tool_kind or q.tool_name or q.sidechain != "include"):
            told = self._found("sessions", q.query)
            if q.providers:
                own = self.store.resume_claims.filter(F.col("provider_id").isin(*filters.canonical_providers(q.providers)))
                told = told.join(own.select(F.col("session_id").alias("id")), "id", "left_semi")
            if q.repo:
                told = told.join(self.store.sessions.filter(F.col("repo_slug") == q.repo).select(F.col("session_id").alias("id")), "id", "left_semi")
            hits.append(ranking.ranked(told, "bm25", limit=window))
        return ranking.union_of_corpora(*hits)

    def session_corpus(self) -> DataFrame:
        return sessions.search_text(self.store)

    def _semantic(self, q: Search, k: int) -> DataFrame:
        if self.vectors is None:
            raise InvalidRequest("no vectors")
        vectors = self.vectors.filter(F.col("model_id") == MODEL_ID)
        allowed = self._allowed(q)
        if allowed is not None:
            vectors = vectors.join(allowed, "message_id", "left_semi")
        found = ranking.top_k_cosine(vectors, [float(x) for x in embed_text(q.query, True)], k, "message_id", floor=q.similarity_floor or None)
        return ranking.ranked(found, "cosine", limit=k)

    def search(self, q: Search) -> DataFrame:
        """A page of hits: id, score, session_id, text, snippet, why_matched, suggested, resume_available, occurrences when grouped.

        Where vectors are missing, a semantic or hybrid search falls back to words;
        ``retrieval`` says what was done.  The page is cut to the bytes of the budget;
        ``has_more`` says that hits follow what is left of it, ``reason`` what cut it.

        The hits, at most twice a rank window, and then the page are collected: what is
        told of them is read by their ids.
        """
        q.validate()
        window = ranking.RANK_WINDOW * (ranking.GROUP_FACTOR if q.group_by_session else 1)
        ready = self.vectors is not None and not self.vectors.filter(F.col("model_id") == MODEL_ID).isEmpty()
        done = q.mode if ready or q.mode == "lexical" else "lexical_fallback"
        if done == "semantic":
            scored = self._semantic(q, max(window, q.offset + q.limit + 1)).select("id", F.col("cosine").alias("score"))
        elif done == "hybrid":
            words = ranking.ranked(self._lexical(q, window), "score", limit=window)
            scored = ranking.fuse(words, self._semantic(q, window))
        else:
            scored = self._signals(self._few(self._lexical(q, window)), q)
        hits = self._owned(self._few(scored))
        hits = ranking.group_by_session(hits) if q.group_by_session else hits.withColumn("occurrences", F.lit(1).cast("long"))
        limit = min(q.limit, q.budget.max_items)
        hits = ranking.page(hits, q.offset, limit + 1)
        return self._told(hits, q, limit).withColumn("retrieval", F.lit(done))

    def _few(self, hits: DataFrame) -> DataFrame:
        """Hits of a bounded number as a table of the driver."""
        return self.spark.createDataFrame(hits.select("id", F.col("score").cast("double")).collect(), "id string, score double")

    def _placed(self, hits: DataFrame) -> Store:
        """The store with the placements of the hits alone, whose ids are few enough to be sent to every task."""
        of = F.broadcast(hits.select(F.col("id").alias("message_id")).distinct())
        return self.store.with_tables(placements=self.store.placements.join(of, "message_id", "left_semi"))

    def _owned(self, scored: DataFrame) -> DataFrame:
        owner = sessions.owning_session(self._placed(scored)).withColumnRenamed("message_id", "id")
        return scored.join(owner, "id", "left").withColumn("session_id", F.coalesce("session_id", F.when(F.col("id").startswith("ses_v1_"), F.col("id"))))

    def _signals(self, hits: DataFrame, q: Search) -> DataFrame:
        s = self._placed(hits)
        side = merge.constant_or_null(s.placements, ["is_sidechain"]).withColumnRenamed("message_id", "id")
        timed = s.messages.select(F.col("message_id").alias("id"), "ts_sec").join(F.broadcast(hits.select("id")), "id", "left_semi")
        told = hits.join(timed, "id", "left").join(side, "id", "left")
        if q.current_repo:
            owner = sessions.owning_session(s).withColumnRenamed("message_id", "id")
            told = told.join(owner.join(s.sessions.select("session_id", "repo_slug"), "session_id").select("id", "repo_slug"), "id", "left")
            here = F.col("repo_slug") == q.current_repo
        else:
            here = F.lit(False)
        return told.select("id", ranking.final_score(F.col("score"), F.col("ts_sec"), F.col("is_sidechain"), here, self.now_ms).alias("score"))

    def _told(self, hits: DataFrame, q: Search, limit: int) -> DataFrame:
        rows = hits.select("id", "score", "session_id", "occurrences").collect()
        page = self.spark.createDataFrame(rows, "id string, score double, session_id string, occurrences long")
        ids, owners = [r["id"] for r in rows], list({r["session_id"] for r in rows if r["session_id"]})
        s = self.store
        text = s.messages.filter(F.col("message_id").isin(ids)).select(F.col("message_id").alias("id"), "text")
        if any(i.startswith("ses_v1_") for i in ids):
            text = text.unionByName(sessions.search_text(self._sessions([i for i in ids if i.startswith("ses_v1_")])).select(F.col("session_id").alias("id"), "text"))
        claims = places.resume_available(s.resume_claims.filter(F.col("session_id").isin(owners))).groupBy("session_id").agg(F.bool_or("available").alias("resume_available"))
        full = page.join(text, "id", "left").join(claims, "session_id", "left")
        order = [F.col("score").desc(), F.col("id")]
        full = full.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy()))
        kept = budgets.clamp(full.filter(F.col("_n") <= limit), order, budgets.hit_cost(), limit, q.budget.max_bytes)
        kept = kept.withColumn("has_more", F.col("_all") > F.count(F.lit(1)).over(Window.partitionBy())).drop("_n", "_all")
        terms = literal_terms(F.lit(q.query))
        shown = kept.withColumn("snippet", snippet(F.col("text"), terms, q.budget.max_snippet_chars))
        shown = shown.withColumn("why_matched", why_matched(terms, F.col("text"), F.col("snippet"))).withColumn("suggested", suggested_commands(F.col("id"), F.col("session_id")))
        return shown.withColumn("resume_available", F.coalesce("resume_available", F.lit(False))).orderBy(*order)

    def _sessions(self, ids: list[str]) -> Store:
        """The store with what it has of a few sessions, found by their ids."""
        s, own = self.store, F.col("session_id").isin(ids)
        placed = s.placements.filter(own)
        said = s.messages.join(placed.select("message_id").distinct(), "message_id", "left_semi")
        return s.with_tables(sessions=s.sessions.filter(own), placements=placed, messages=said, resume_claims=s.resume_claims.filter(own))

    def digest(self, q: Search) -> str:
        return cursors.query_digest(query=q.query, mode=q.mode, providers=filters.canonical_providers(q.providers), since=q.since, until=q.until, repo=q.repo, current_repo=q.current_repo, sidechain=q.sidechain, tool_kind=q.tool_kind, tool_name=q.tool_name, include_system=q.include_system, group=q.group_by_session, floor=q.similarity_floor, window=ranking.RANK_WINDOW, factor=ranking.GROUP_FACTOR, model=MODEL_ID)

    def cursor(self, q: Search, next_offset: int) -> str:
        return cursors.issue(cursors.Claims(cursors.MAJOR, self.generation, self.digest(q), "score_desc", next_offset, "search", self.now_ms, self.now_ms + cursors.TTL_MS))

    def resume_page(self, q: Search, token: str, now_ms: int) -> Search:
        """The search that a cursor continues, in the generation that it began in; ages are those of the first page."""
        claims = cursors.verify(token, now_ms=now_ms, generation=self.generation, query=self.digest(q), sort="score_desc", result_set="search")
        self.now_ms = claims.issued_at_ms
        return Search(**{**q.__dict__, "offset": claims.offset})

    # --- lookups ----------------------------------------------------------------------

    def get(self, wire_id: str) -> DataFrame:
        found = {"msg": lambda: merge.get(merge.payloads(self.store), wire_id), "ses": lambda: merge.get(self.store.sessions, wire_id, "session_id"), "doc": lambda: merge.get(self.store.documents, wire_id, "document_id")}.get(wire_id[:3])
        out = found() if found else None
        if out is None or out.isEmpty():
            raise NotFound(wire_id)
        return out

    show = get

    def get_many(self, ids: list[str]) -> DataFrame:
        return merge.get_many(self.store.messages, ids)

    def list_entities(self, limit: int = 20, after: str | None = None, kind: str = "message") -> DataFrame:
        if kind == "session":
            page = [r[0] for r in merge.list_page(self.store.sessions.select("session_id"), limit, after, "session_id").collect()]
            s = self._sessions(page)
            told = sessions.titles(s).join(sessions.peek(sessions.occurrences(s)), "session_id", "left").join(sessions.latest_activity(s), "session_id", "left")
            return told.orderBy("session_id")
        return merge.list_page(self.store.messages, limit, after)

    def message_contexts(self, message_id: str) -> DataFrame:
        one = self.store.with_tables(placements=self.store.placements.filter(F.col("message_id") == message_id))
        return sessions.message_contexts(one)

    def session_resume(self, session_id: str) -> DataFrame:
        claims = places.resume_available(self.store.resume_claims.filter(F.col("session_id") == session_id))
        command = F.when(F.col("available"), places.resume_command(F.col("provider_id"), F.col("provider_session_id"), F.col("cwd")))
        return claims.withColumn("command", command)

    # --- branches ---------------------------------------------------------------------

    def _session(self, session_id: str) -> Store:
        s = self.store
        placed = s.placements.filter(F.col("session_id") == session_id)
        if placed.isEmpty():
            raise NotFound(session_id)
        of = placed.select("message_id").distinct()
        return s.with_tables(placements=placed, messages=s.messages.join(of, "message_id", "left_semi"), edges=s.edges.join(placed.select(F.col("placement_id").alias("child_placement_id")), "child_placement_id", "left_semi"))

    def _chain(self, one: Store, policy: str) -> DataFrame:
        if policy not in ("mainline", "full"):
            raise InvalidRequest("policy is mainline or full")
        if policy == "full":
            order = graph.full_order(one).select("placement_id", "position")
        else:
            order = graph.mainline(one)
            if not order.filter("error IS NOT NULL").isEmpty():
                raise InvalidRequest("ambiguous parent on the branch")
            order = order.select("placement_id", "position")
        return sessions.occurrences(one).join(order, "placement_id")

    def context(self, session_id: str, policy: str = "mainline", level: str = "raw", max_messages: int = 500, max_bytes: int = 4 << 20, require_complete: bool = False) -> DataFrame:
        """A session's branch: its messages (raw), its talks, or its summary; without a user message the messages stand in for talks.

        Messages are a prefix of the branch that fits; ``reason`` is the knob that cut it.
        """
        one = self._session(session_id)
        if require_complete:
            of = one.placements.select("document_id").distinct()
            if not self.store.source_scans.filter("NOT relation_complete").join(of, "document_id", "left_semi").isEmpty():
                raise InvalidRequest("a source of the session was not read in full")
        chain = self._chain(one, policy)
        if level == "sessions":
            return sessions.summary(chain)
        if level == "talks" and not chain.filter("role = 'user'").isEmpty():
            return sessions.talks(chain)
        page = chain.orderBy("position").limit(max_messages + 1)
        kept = budgets.clamp(page, [F.col("position")], json_string_bytes(F.coalesce("text", F.lit(""))), max_messages, max_bytes)
        acts = self.store.tool_activities.join(kept.select("message_id").distinct(), "message_id", "left_semi")
        grouped = acts.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("kind", "name", "target", "status", "actor"))).alias("activities"))
        return kept.join(grouped, "message_id", "left").orderBy("position")

    def message_window(self, message_id: str, around: int = 3, session_id: str | None = None, max_messages: int = 500, max_bytes: int = 4 << 20) -> DataFrame:
        """A message and its neighbours on the mainline; what does not fit is cut from the ends, never the message itself."""
        if session_id is None:
            owners = [r[0] for r in self.store.placements.filter(F.col("message_id") == message_id).select("session_id").distinct().orderBy("session_id").limit(sessions.MAX_CANDIDATES + 1).collect()]
            if not owners:
                raise NotFound(message_id)
            if len(owners) > 1:
                raise InvalidRequest("message is in several sessions: " + ", ".join(owners[: sessions.MAX_CANDIDATES]))
            session_id = owners[0]
        window = sessions.message_window(self._chain(self._session(session_id), "mainline"), message_id, around)
        anchor = window.filter(F.col("message_id") == message_id).first()["position"]
        cost = json_string_bytes(F.coalesce("text", F.lit("")))
        return budgets.keep_around(window.withColumn("_cost", cost), anchor, "_cost", max_messages, max_bytes).drop("_cost").orderBy("position")

    # --- aggregates, packs, jobs ------------------------------------------------------

    def status(self) -> DataFrame:
        s = self.store
        counts = s.messages.agg(F.count(F.lit(1)).alias("messages")).crossJoin(s.placements.agg(F.count(F.lit(1)).alias("placements"))).crossJoin(s.documents.agg(F.count(F.lit(1)).alias("documents")))
        return counts.crossJoin(usage.totals(s)).crossJoin(merge.orphan_counts(s).withColumnsRenamed({"activities": "orphaned_activities", "usage_events": "orphaned_usage"}))  # one row each

    def repositories(self) -> DataFrame:
        return usage.repo_totals(self.store)

    def handoff(self, q: Search, **budget: int) -> dict:
        page = self.search(Search(**{**q.__dict__, "limit": handoff.HIT_LIMIT, "offset": 0, "group_by_session": False}))
        hits = page.select("id", "score", "session_id", "text", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).alias("rank"))
        return handoff.build_pack(hits, self.store, query=q.query, generation=self.generation, **budget)

    def hook_context(self, prompt: str, max_tokens: int = 2000, decay_days: int | None = None) -> list[str]:
        """Redacted texts of the best sessions for a prompt, four characters a token."""
        from palaver.functions.redact import redact

        since = f"{decay_days}d" if decay_days else None
        page = self.search(Search(prompt, limit=10, group_by_session=True, since=since))
        return [r[0][: max_tokens * 4] for r in page.filter("text IS NOT NULL").select(redact(F.col("text"))).collect()]

    def build_vectors(self) -> DataFrame:
        """(message_id, model_id, embedding) of every message with text."""
        said = self.store.messages.filter("trim(text) != ''")
        return said.select("message_id", F.lit(MODEL_ID).alias("model_id"), embed(F.col("text")).alias("embedding"))

    def purge(self) -> Store:
        """The store without what hangs on messages and sessions that are gone; ``purge`` of the module publishes it."""
        return merge.purge_orphans(self.store)

    def relocate(self, old_root: str, new_root: str) -> Store:
        """The store with the paths of sources moved; identities stay."""
        moved = self.store.source_scans.withColumn("source_path", places.remap(F.col("source_path"), old_root, new_root))
        folders = self.store.resume_claims.withColumn("cwd", places.remap(F.col("cwd"), old_root, new_root))
        return self.store.with_tables(source_scans=moved, resume_claims=folders)


def hook_query(event: str, payload: dict) -> str:
    """What to search for when a hook fires: the prompt of a prompt event, else the name of the folder."""
    prompt = payload.get("prompt")
    if event == "user_prompt_submit" and isinstance(prompt, str) and prompt.strip():
        return prompt.strip()
    folder = payload.get("cwd")
    return folder.replace("\\", "/").rstrip("/").rpartition("/")[2] if isinstance(folder, str) else ""


def doctor(store: Store) -> DataFrame:
    from palaver.schema import violations

    return violations(store)


def capabilities(spark: SparkSession) -> DataFrame:
    """What each variant can tell; declared providers without a parser tell nothing."""
    rows = [(v.provider_id, v.variant_id, True, v.edges, v.tools, v.usage, v.spans, v.provider_id in places.RESUME) for v in providers.VARIANTS]
    rows += [(p, None, False, False, False, False, False, False) for p in providers.DEFERRED]
    return spark.createDataFrame(rows, "provider_id string, variant_id string, parsed boolean, edges boolean, tools boolean, usage boolean, spans boolean, resume boolean")


def sync(spark: SparkSession, home: str, generations: ingest.Generations, only: Iterable[str] | None = None) -> bool:
    """Read what is new or changed in the providers' folders below a home, and publish a generation if anything differs; whether it did.

    Sources of the length and time that a former scan saw are carried over unread, and so
    are known ones whose end is torn just now.  Files are parsed once, into a table that
    all others are projections of; what changed while it was read is left for the next run.
    A known source that is gone takes its entities along, unless another source has them;
    but only in folders that were scanned: one that does not exist says nothing about its
    sources.  Sources that contradict each other about a message are refused.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for provider, root, extension in providers.roots(home):
        path = jvm.org.apache.hadoop.fs.Path(root)
        if (only is None or provider in only) and path.getFileSystem(conf).exists(path):
            found.append((provider, root, extension))
    if not found:
        return False

    def listed() -> DataFrame:
        every = [reading.discover(spark, root, extension).withColumn("provider_id", F.lit(provider)) for provider, root, extension in found]
        return reduce(DataFrame.unionByName, every)

    before = generations.current(spark)
    prior = Store.empty(spark) if before is None else generations.open(spark)
    scans = prior.source_scans
    with generations.scratch(spark) as work:
        listed().select("source_path", "len_bytes", "modified_ms", "provider_id").write.parquet(f"{work}/files")
        files = spark.read.parquet(f"{work}/files")
        gone = merge.tombstones(scans, files, spark.createDataFrame([(p,) for p, _, _ in found], "provider_id string")).select("source_path")
        same = reading.unchanged(files, scans, ingest.PARSER_VERSION).select("source_path")
        todo = files.join(same, "source_path", "left_anti")
        if todo.isEmpty() and gone.isEmpty():
            return False
        read = reading.snapshot(listed().join(todo.select("source_path", "len_bytes", "modified_ms"), ["source_path", "len_bytes", "modified_ms"], "left_semi"))
        held = reading.torn(read).join(scans.select("source_path"), "source_path", "left_semi")
        held.write.parquet(f"{work}/held")
        held = spark.read.parquet(f"{work}/held")
        ingest.parse_files(read.join(held, "source_path", "left_anti")).write.parquet(f"{work}/parsed")
        late = reading.changed_since(files, listed().select("source_path", "len_bytes", "modified_ms"))
        late.write.parquet(f"{work}/late")
        events = spark.read.parquet(f"{work}/parsed").join(spark.read.parquet(f"{work}/late"), "source_path", "left_anti")
        taken = events.filter("kind = 'source'").select("source_path", "fingerprint")
        stay = scans.join(gone, "source_path", "left_anti").join(taken.select("source_path"), "source_path", "left_anti")
        digest = ingest.content_digest(taken.unionByName(stay.select("source_path", "fingerprint")))
        if before is not None and before["content"] == digest:
            return False
        new = ingest.canonicalize(events)
        ingest.refuse_conflicts(ingest.claimed(events))
        kept = ingest.carried_over(prior, stay)
        return generations.commit(new if before is None else ingest.renewed(kept, new), digest)


def discovery(spark: SparkSession, home: str, scans: DataFrame | None = None) -> DataFrame:
    """A row a provider that keeps files below a home: its folder, whether that was scanned, how many files were found, and of known sources how many are not seen before or are gone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    roots = [(p, r, e, bool(jvm.org.apache.hadoop.fs.Path(r).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(r)))) for p, r, e in providers.roots(home)]
    out = spark.createDataFrame([(p, r, c) for p, r, _, c in roots], "provider_id string, root string, complete boolean")
    files = [reading.discover(spark, r, e).select(F.lit(p).alias("provider_id"), "source_path") for p, r, e, c in roots if c]
    files = reduce(DataFrame.unionByName, files) if files else spark.createDataFrame([], "provider_id string, source_path string")
    known = (Store.empty(spark).source_scans if scans is None else scans).select("provider_id", "source_path", F.lit(True).alias("known"))
    both = files.withColumn("here", F.lit(True)).join(known, ["provider_id", "source_path"], "full")
    counts = both.groupBy("provider_id").agg(F.count("here").alias("found"), F.count_if(F.col("known").isNull()).alias("new"), F.count_if(F.col("here").isNull()).alias("gone"))
    told = out.join(counts, "provider_id", "left").na.fill(0, ["found", "new", "gone"])
    return told.withColumn("gone", F.when(F.col("complete"), F.col("gone")).otherwise(0)).orderBy("provider_id")


def _mapping(old_root: str, new_root: str) -> str:
    return cursors.query_digest(old=places.normalize_path(old_root), new=places.normalize_path(new_root))


def plan_relocation(spark: SparkSession, generations: ingest.Generations, old_root: str, new_root: str, now_ms: int) -> tuple[DataFrame, str]:
    """What moving one root would change, (source_path, moved_to), and a token that lets it be done: for a quarter of an hour, and for this generation and these roots only."""
    scans = generations.open(spark).source_scans.select("source_path", places.remap(F.col("source_path"), old_root, new_root).alias("moved_to"))
    claims = cursors.Claims(cursors.MAJOR, generations.current(spark)["generation"], _mapping(old_root, new_root), "path", 0, "relocation", now_ms, now_ms + cursors.TTL_MS)
    return scans.filter("source_path != moved_to").orderBy("source_path"), cursors.issue(claims)


def apply_relocation(spark: SparkSession, generations: ingest.Generations, old_root: str, new_root: str, token: str, now_ms: int) -> bool:
    """Publish a generation with the paths moved; identities stay, and so does the folder of the generation before, as a backup."""
    current = generations.current(spark)
    cursors.verify(token, now_ms=now_ms, generation=current["generation"], query=_mapping(old_root, new_root), sort="path", result_set="relocation")
    moved = Engine(spark, generations.open(spark), now_ms=now_ms).relocate(old_root, new_root)
    return generations.commit(moved, f"{current['content']} moved {_mapping(old_root, new_root)}")


def add_facts(spark: SparkSession, generations: ingest.Generations, facts: list[tuple[str, str]]) -> bool:
    """Publish a generation with plain facts (fact, text) as messages; one that is known stays as it is; whether anything is new."""
    before = generations.current(spark)
    prior = Store.empty(spark) if before is None else generations.open(spark)
    new = ingest.index_facts(spark, facts).dropDuplicates(["message_id"]).join(prior.messages, "message_id", "left_anti")
    ids = sorted(r[0] for r in new.select("message_id").collect())  # as many as were given
    if not ids:
        return False
    digest = hashlib.sha256("\n".join([before["content"] if before else "", *ids]).encode()).hexdigest()
    return generations.commit(prior.with_tables(messages=prior.messages.unionByName(new)), digest)


def purge(spark: SparkSession, generations: ingest.Generations) -> bool:
    """Publish the current generation without what hangs on messages and sessions that are gone; False where nothing does."""
    store = generations.open(spark)
    lost = merge.orphan_counts(store).first()
    stray = store.resume_claims.join(store.placements.select("session_id").distinct(), "session_id", "left_anti")
    if lost["activities"] == 0 and stray.isEmpty():
        return False
    return generations.commit(merge.purge_orphans(store), f"{generations.current(spark)['content']} purged")


__all__ = ["DIMENSIONS", "Engine", "InvalidRequest", "NotFound", "Search", "add_facts", "apply_relocation", "capabilities", "discovery", "doctor", "estimate_tokens", "plan_relocation", "purge", "sync"]
