"""From files to the canonical tables, and from one generation of a store to the next.

Executors read, recognise and parse whole files; what they emit is one table of events,
from which the canonical tables follow by projections.  A generation is written to a
folder of its own and then named in a pointer file, so readers see all of it or none.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import identity, places
from palaver.functions.instants import order_instant
from palaver.operators.graph import relation_of
from palaver.operators import lexical
from palaver.operators.merge import merge_conflicts, merge_messages
from palaver.operators.sessions import search_text
from palaver.schema import Store
from palaver.sources import providers

PARSER_VERSION = 1
PROJECTION_VERSION = 1

_EVENT = {
    "kind": "string", "source_path": "string", "provider_id": "string", "variant_id": "string", "fingerprint": "string", "len_bytes": "long", "place": "long", "native_session": "string", "native_id": "string", "parent": "string",
    "role": "string", "text": "string", "ts_raw": "string", "is_sidechain": "boolean", "span_start": "long", "span_end": "long", "name": "string", "tool_kind": "string", "target": "string", "actor": "string", "status": "string",
    "counts": "array<long>", "token_source": "string", "id_state": "string", "cwd": "string", "pair_observed": "boolean", "committed": "long", "skipped": "long", "note": "string", "modified_ms": "long", "remote": "string",
}


def parse_files(files: DataFrame, hint: str | None = None) -> DataFrame:
    """Events of files (source_path, len_bytes, fingerprint, content, and provider_id and modified_ms where known): messages, activities, usage, titles, and one ``source`` row a file.

    A file that no parser takes gives its source row alone, with the reason as ``note``
    and no ``committed``.
    """

    def rows_of(path: str, content: bytes, known: str | None) -> Iterator[dict]:
        try:
            variant = providers.select(content, known or hint)
            parsed = variant.parse(content)
        except Exception as e:  # noqa: BLE001 - one bad source must not stop the others
            yield {"kind": "source", "note": f"{type(e).__name__}: {e}"[:500], "provider_id": known}
            return
        base = {"provider_id": variant.provider_id, "variant_id": variant.variant_id}
        for k, m in enumerate(parsed.messages):
            start, end = m.span or (None, None)
            yield base | {"kind": "message", "place": k, "native_session": m.session or parsed.session_id, "native_id": m.native_id, "parent": m.parent, "role": m.role, "text": m.text, "ts_raw": m.timestamp, "is_sidechain": m.is_sidechain, "span_start": start, "span_end": end}
        for k, (anchor, kind, name, target, actor, status) in enumerate(parsed.activities):
            yield base | {"kind": "activity", "place": k, "native_id": anchor, "tool_kind": kind, "name": name, "target": target, "actor": actor, "status": status}
        for k, (anchor, counts, source) in enumerate(parsed.usage):
            yield base | {"kind": "usage", "place": k, "native_id": anchor, "native_session": parsed.session_id, "counts": list(counts), "token_source": source}
        for native, title in parsed.titles.items():
            yield base | {"kind": "title", "native_session": native or parsed.session_id, "text": title}
        yield base | {"kind": "source", "native_session": parsed.session_id, "remote": parsed.remote, "id_state": parsed.id_state, "cwd": parsed.cwd, "pair_observed": parsed.pair_observed, "committed": len(parsed.messages), "skipped": parsed.skipped, "note": "\n".join(parsed.notes[:20])}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in frame.itertuples(index=False):
                rows = [r | {"source_path": f.source_path, "fingerprint": f.fingerprint, "len_bytes": f.len_bytes, "modified_ms": f.modified_ms} for r in rows_of(f.source_path, bytes(f.content), f.provider_id)]
                yield pd.DataFrame(rows, columns=list(_EVENT)).astype(object).where(lambda d: d.notna(), None)

    for name, kind in (("provider_id", "string"), ("modified_ms", "long")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    schema = ", ".join(f"{n} {t}" for n, t in _EVENT.items())
    return files.select("source_path", "len_bytes", "fingerprint", "content", "provider_id", "modified_ms").mapInPandas(run, schema)


def claimed(events: DataFrame) -> DataFrame:
    """Message events with the id of their message."""
    c = F.col
    document = identity.derive("document", F.coalesce("provider_id", F.lit("")), F.coalesce("variant_id", F.lit("")), c("fingerprint"))
    said = events.filter("kind = 'message'").withColumn("document_id", document)
    return said.withColumn("message_id", F.coalesce(identity.native("message", c("native_id")), identity.derive("message", c("provider_id"), c("variant_id"), c("document_id"), c("place"))))


def canonicalize(events: DataFrame, namespace: str = "") -> Store:
    """The canonical tables of parsed files, which the caller has written once: every table is a projection of them.

    A message with several claims keeps the longest text; placements keep all.  A session
    has the last title that its sources give it, and the slug of the repository that they
    name, or else that its folder lies in.
    """
    c = F.col
    document = identity.derive("document", F.coalesce("provider_id", F.lit("")), F.coalesce("variant_id", F.lit("")), c("fingerprint"))
    events = events.withColumn("document_id", document)
    session = identity.session_id(c("provider_id"), F.lit(namespace), c("native_session"), c("document_id"))
    said = claimed(events).withColumn("session_id", session)
    said = said.withColumn("placement_id", identity.placement_id(c("session_id"), c("document_id"), c("message_id"), c("place")))
    merged = merge_messages(said)
    at = order_instant(c("ts_raw"))
    messages = merged.select("message_id", "role", "text", "ts_raw", at["sec"].alias("ts_sec"), at["nanos"].alias("ts_nanos"), "provider_id")
    placements = said.select("placement_id", "session_id", "document_id", "message_id", c("place").alias("ordinal"), "is_sidechain", "span_start", "span_end")
    edges = said.filter("parent IS NOT NULL").select(c("placement_id").alias("child_placement_id"), F.concat(F.lit(identity.PREFIXES["message"]), "parent").alias("parent_message_id"), c("parent").alias("parent_native_id"), relation_of(c("is_sidechain")).alias("relation"))
    sources = events.filter("kind = 'source' AND committed IS NOT NULL")
    documents = sources.select("document_id", "provider_id", "variant_id", "fingerprint", c("len_bytes").alias("len")).dropDuplicates(["document_id"])
    titled = events.filter("kind = 'title'").withColumn("session_id", session).groupBy("session_id").agg(F.max_by("text", F.struct("source_path", "text")).alias("title"))
    folders = sources.filter("native_session IS NOT NULL").withColumn("session_id", session).select("session_id", "remote", "cwd")
    found = folders.join(places.remotes(folders).withColumnRenamed("remote", "found"), "cwd", "left")
    slugs = found.groupBy("session_id").agg(places.repo_slug(F.coalesce(F.min("remote"), F.min("found"))).alias("repo_slug"))
    sessions = placements.select("session_id").distinct().join(titled, "session_id", "left").join(slugs, "session_id", "left").select("session_id", "title", "repo_slug")
    # Observations hang on the first message of their native id in their source.
    anchor = said.filter("native_id != ''").groupBy("source_path", "native_id").agg(F.min_by("message_id", "place").alias("message_id"), F.min_by("session_id", "place").alias("session_id"))
    only = said.groupBy("source_path").agg(F.when(F.countDistinct("session_id") == 1, F.min("session_id")).alias("only_session"))
    activities = events.filter("kind = 'activity'").join(anchor, ["source_path", "native_id"]).select("message_id", c("tool_kind").alias("kind"), "actor", "name", "target", "status")
    counted = events.filter("kind = 'usage'").join(anchor, ["source_path", "native_id"], "left").join(only, "source_path", "left")
    usage = counted.filter("message_id IS NOT NULL OR (native_id = '' AND only_session IS NOT NULL)").select(
        F.coalesce("session_id", "only_session").alias("session_id"), "message_id", *(c("counts")[k].alias(n) for k, n in enumerate(("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"))), "token_source"
    )
    claims = sources.filter("native_session IS NOT NULL").withColumn("session_id", session).select(
        "session_id", "provider_id", c("native_session").alias("provider_session_id"), "cwd", "id_state", F.when(c("cwd").isNull(), "missing").otherwise("resolved").alias("cwd_state"), "pair_observed"
    )
    scans = sources.select("source_path", "provider_id", "document_id", "len_bytes", "fingerprint", F.lit(PARSER_VERSION).alias("parser_version"), (c("skipped") == 0).alias("relation_complete"), c("committed").alias("message_count"), "modified_ms")
    return Store(messages, placements, edges, documents, sessions, activities, usage, claims, scans)


def carried_over(prior: Store, scans: DataFrame) -> Store:
    """What a former generation has from the sources in ``scans`` (rows of its source scans)."""
    of = scans.select("document_id").distinct()
    placements = prior.placements.join(of, "document_id", "left_semi")
    messages, sessions = placements.select("message_id").distinct(), placements.select("session_id").distinct()
    own = placements.select(F.col("placement_id").alias("child_placement_id"))
    return Store(
        prior.messages.join(messages, "message_id", "left_semi"),
        placements,
        prior.edges.join(own, "child_placement_id", "left_semi"),
        prior.documents.join(of, "document_id", "left_semi"),
        prior.sessions.join(sessions, "session_id", "left_semi"),
        prior.tool_activities.join(messages, "message_id", "left_semi"),
        prior.usage_events.join(sessions, "session_id", "left_semi"),
        prior.resume_claims.join(sessions, "session_id", "left_semi"),
        scans.select(*prior.source_scans.columns),
    )


def renewed(kept: Store, new: Store) -> Store:
    """Both together.  The longer text of a message stays; what was observed of a message, and of a session without one, is that of the sources read last."""
    said = kept.messages.withColumn("source_path", F.lit("0")).unionByName(new.messages.withColumn("source_path", F.lit("1")))
    at = order_instant(F.col("ts_raw"))
    messages = merge_messages(said).select("message_id", "role", "text", "ts_raw", at["sec"].alias("ts_sec"), at["nanos"].alias("ts_nanos"), "provider_id")
    fresh, sessions = new.messages.select("message_id"), new.sessions.select("session_id")
    old_usage = kept.usage_events.join(fresh, "message_id", "left_anti")
    old_usage = old_usage.filter("message_id IS NOT NULL").unionByName(old_usage.filter("message_id IS NULL").join(sessions, "session_id", "left_anti"))
    both = kept.union(new)
    both = both.with_tables(sessions=kept.sessions.withColumn("_new", F.lit(False)).unionByName(new.sessions.withColumn("_new", F.lit(True))))
    return both.with_tables(
        messages=messages,
        placements=both.placements.dropDuplicates(["placement_id"]),
        edges=both.edges.dropDuplicates(["child_placement_id"]),
        documents=both.documents.dropDuplicates(["document_id"]),
        sessions=both.sessions.groupBy("session_id").agg(*(F.coalesce(F.max(F.when(F.col("_new"), F.col(x))), F.max(x)).alias(x) for x in ("title", "repo_slug"))),
        tool_activities=kept.tool_activities.join(fresh, "message_id", "left_anti").unionByName(new.tool_activities),
        usage_events=old_usage.unionByName(new.usage_events),
        resume_claims=kept.resume_claims.join(sessions, "session_id", "left_anti").unionByName(new.resume_claims),
    )


def report(events: DataFrame) -> DataFrame:
    """(source_path, provider_id, committed, skipped, note) of every file that was read."""
    return events.filter("kind = 'source'").select("source_path", "provider_id", "committed", "skipped", "note")


class Conflict(ValueError):
    """Sources contradict each other, or themselves, about a message."""


def refuse_conflicts(claims: DataFrame) -> None:
    """Claims (source_path, message_id, role, text, ts_raw, provider_id) must not give one id two contents within a source, nor other stable fields across sources."""
    found = [tuple(r) for r in merge_conflicts(claims).orderBy("message_id", "rule").limit(20).collect()]
    if found:
        raise Conflict("; ".join(f"{i}: {rule}" for i, rule in found))


def index_facts(spark: SparkSession, facts: list[tuple[str, str]]) -> DataFrame:
    """Messages out of plain facts (fact, text): the identity follows from the fact alone."""
    rows = spark.createDataFrame(facts, "fact string, text string")
    nothing = F.lit(None)
    return rows.select(identity.derive("message", F.col("fact")).alias("message_id"), F.lit("user").alias("role"), "text", nothing.cast("string").alias("ts_raw"), nothing.cast("long").alias("ts_sec"), nothing.cast("int").alias("ts_nanos"), F.lit("facts").alias("provider_id"))


class Busy(RuntimeError):
    """Another writer holds the store."""


class StaleProjection(RuntimeError):
    """The store was written for another version of the projections and must be rebuilt."""


@dataclass
class Generations:
    """Generations of a store below a folder that driver and executors share, on any file system that Spark writes to.

    ``CURRENT`` names the one that readers see; ``WRITER`` is there while one is written, and
    says whose it is and until when: one that a dead writer left is taken over after that.
    A generation holds the tables and, under ``index``, the postings of what search reads.
    A path without a scheme is of the default file system of Hadoop.
    """

    root: str
    lease_seconds: int = 6 * 3600

    def _at(self, spark: SparkSession, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _write(self, spark: SparkSession, name: str, text: str) -> None:
        """A new file; an existing one is an error."""
        fs, path = self._at(spark, name)
        out = fs.create(path, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, spark: SparkSession, name: str) -> str | None:
        fs, path = self._at(spark, name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def current(self, spark: SparkSession) -> dict | None:
        found = self._read(spark, "CURRENT")
        return None if found is None else json.loads(found)

    def _folder(self, spark: SparkSession) -> str:
        now = self.current(spark)
        if now is None:
            raise FileNotFoundError("the store has no generation")
        if now["projection_version"] != PROJECTION_VERSION:
            raise StaleProjection("rebuild the store")
        return f"{self.root.rstrip('/')}/{now['folder']}"

    def open(self, spark: SparkSession) -> Store:
        return Store.read(spark, self._folder(spark))

    def index(self, spark: SparkSession) -> str:
        """The folder of the current generation's postings."""
        self._folder(spark)
        return f"{self.root.rstrip('/')}/{self.current(spark)['index']}"

    def _activate(self, spark: SparkSession, expected: dict | None, new: dict) -> bool:
        """Name a new generation, by one rename, if the current one is still the expected."""
        if self.current(spark) != expected:
            return False
        temporary = f"CURRENT-{uuid.uuid4().hex}"
        self._write(spark, temporary, json.dumps(new))
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        (_, source), (_, target) = self._at(spark, temporary), self._at(spark, "CURRENT")
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        qualified = [p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p) for p in (source, target)]
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(*qualified, how)
        return True

    def _expired(self, spark: SparkSession) -> bool:
        try:
            held = json.loads(self._read(spark, "WRITER") or "{}")
            return time.time() > held["until"]
        except (ValueError, KeyError):
            return False  # just being written, or by hand

    @contextmanager
    def writing(self, spark: SparkSession) -> Iterator[None]:
        """Hold the store's lease; ``Busy`` while another holds one that has not run out."""
        fs, lease = self._at(spark, "WRITER")
        mine = json.dumps({"owner": uuid.uuid4().hex, "until": time.time() + self.lease_seconds})
        if self._expired(spark):
            fs.delete(lease, False)
        try:
            self._write(spark, "WRITER", mine)
        except Exception as e:
            if fs.exists(lease):
                raise Busy("another writer holds the store") from None
            raise e
        try:
            yield
        finally:
            if self._read(spark, "WRITER") == mine:
                fs.delete(lease, False)

    @contextmanager
    def scratch(self, spark: SparkSession) -> Iterator[str]:
        """A folder beside the generations for what is written once while one is made."""
        fs, path = self._at(spark, f"work-{uuid.uuid4().hex[:8]}")
        try:
            yield path.toString()
        finally:
            fs.delete(path, True)

    def _write_index(self, spark: SparkSession, folder: str, name: str) -> None:
        store = Store.read(spark, f"{self.root.rstrip('/')}/{folder}")
        corpora = {"messages": (store.messages, "message_id"), "sessions": (search_text(store), "session_id")}
        with ThreadPoolExecutor(len(corpora)) as pool:
            list(pool.map(lambda c: lexical.write_index(*corpora[c], "text", f"{self.root.rstrip('/')}/{name}/{c}"), corpora))

    def commit(self, store: Store, content: str) -> bool:
        """Write a generation with its index and name it; False, and nothing written, where the content is that of the current one."""
        spark = store.messages.sparkSession
        with self.writing(spark):
            before = self.current(spark)
            if before is not None and before["content"] == content:
                return False
            number = (before["generation"] if before else 0) + 1
            folder = f"generation-{number}-{uuid.uuid4().hex[:8]}"  # what an interrupted writer left is never named
            store.write(f"{self.root.rstrip('/')}/{folder}")
            self._write_index(spark, folder, f"{folder}/index")
            return self._activate(spark, before, {"generation": number, "folder": folder, "index": f"{folder}/index", "content": content, "projection_version": PROJECTION_VERSION})

    def rebuild(self, spark: SparkSession) -> None:
        """Write the postings of the current generation anew, from its tables, and name them."""
        with self.writing(spark):
            before = self.current(spark)
            if before is None:
                raise FileNotFoundError("the store has no generation")
            name = f"{before['folder']}/index-{uuid.uuid4().hex[:8]}"
            self._write_index(spark, before["folder"], name)
            self._activate(spark, before, before | {"index": name, "projection_version": PROJECTION_VERSION})


def content_digest(files: DataFrame) -> str:
    """One digest of all snapshots: the same files give the same digest, in whatever order."""
    row = files.agg(F.count(F.lit(1)), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\0", "source_path", "fingerprint"), 256), 1, 12), 16, 10).cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}:{PARSER_VERSION}"
