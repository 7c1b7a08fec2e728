"""Conversations of the driver's tables told as transcripts of each format, parsed again, and what SQL says must come of them."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Iterator
from contextlib import closing
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.plans.canonical import EPOCH, table
from palaver.plans.scratch import scratch
from palaver.sources import ingest
from palaver.sources.sqlite_files import BUBBLE, CHATS, COMPOSER

Turn = tuple[int, str, str]  # number, role, text


def _seconds(conv: int, turn: int) -> int:
    return EPOCH + conv * 131 + turn * 60


def _iso(conv: int, turn: int) -> str:
    return datetime.fromtimestamp(_seconds(conv, turn), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _json_lines(*records: object) -> bytes:
    return "".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) + "\n" for r in records).encode()


def _claude(conv: int, turns: list[Turn]) -> bytes:
    """Every fifth transcript has a line that was not written to its end."""
    out: list[object] = [{"type": "custom-title", "customTitle": f"Work {conv}"}] if conv % 2 == 0 else []
    for k, (turn, role, text) in enumerate(turns):
        parent = f"c{conv}t{turns[k - 1][0]}" if k else None
        content = text if turn % 2 == 0 else [{"type": "text", "text": text}]
        message: dict = {"role": role, "content": content}
        if role == "assistant":
            message["usage"] = {"input_tokens": turn + 1, "output_tokens": 2 * turn, "cache_read_input_tokens": 3}
        out.append({"type": role, "uuid": f"c{conv}t{turn}", "parentUuid": parent, "isSidechain": turn % 7 == 5, "sessionId": f"S{conv}", "cwd": f"/w/{conv}", "timestamp": _iso(conv, turn), "message": message})
        out += ['{"type": "user", "uu\n'] if conv % 5 == 0 and k == 0 else []
    return _json_lines(*out)


def _codex(conv: int, turns: list[Turn]) -> bytes:
    head = {"timestamp": "t", "type": "session_meta", "payload": {"session_id": f"C{conv}", "cwd": f"/c/{conv}", "git": {"repository_url": f"https://github.com/acme/r{conv % 7}.git"}}}
    item = lambda t, r, x: {"timestamp": "t", "type": "response_item", "payload": {"type": "message", "role": r, "id": f"x{conv}t{t}", "content": [{"type": "input_text", "text": x}]}}
    return _json_lines(head, *(item(*t) for t in turns))


def _grok(conv: int, turns: list[Turn]) -> bytes:
    """A message of the assistant comes in two chunks."""
    out = []
    for turn, role, text in turns:
        if role == "system":
            continue
        kind, meta = ("user_message_chunk", {"promptIndex": turn}) if role == "user" else ("agent_message_chunk", {"promptId": f"p{turn}"})
        for part in [text] if role == "user" else [text[:7], text[7:]]:
            out.append({"params": {"sessionId": f"G{conv}", "update": {"sessionUpdate": kind, "content": {"type": "text", "text": part}}, "_meta": meta}})
    return _json_lines(*out)


def _antigravity(conv: int, turns: list[Turn]) -> bytes:
    source = {"user": "USER_EXPLICIT", "assistant": "MODEL", "system": "SYSTEM"}
    return _json_lines(*({"step_index": t, "source": source[r], "content": x, "created_at": _iso(conv, t)} for t, r, x in turns))


def _session(conv: int, turns: list[Turn]) -> bytes:
    said = ({"type": "message", "timestamp": _iso(conv, t), "message": {"role": r, "content": [{"type": "text", "text": x}]}} for t, r, x in turns)
    return _json_lines({"type": "session", "id": f"P{conv}", "cwd": "/p"}, *said)


def _kimi(conv: int, turns: list[Turn]) -> bytes:
    said = lambda t, r, x: {"type": "turn.prompt", "input": [{"type": "text", "text": x}]} if r == "user" else {"type": "context.append_message", "message": {"role": r, "content": x}}
    return _json_lines(*({**said(*t), "timestamp": _iso(conv, t[0])} for t in turns))


def _qoder(conv: int, turns: list[Turn]) -> bytes:
    said = ({"type": r, "message": {"role": r, "content": x, "timestamp": _iso(conv, t)}} for t, r, x in turns)
    return _json_lines({"type": "session_meta", "payload": {"session_id": f"Q{conv}", "cwd": "/q"}}, *said)


def _codebuddy(conv: int, turns: list[Turn]) -> bytes:
    start = {"type": "message", "role": "user", "content": "code", "sessionId": f"B{conv}"}
    return _json_lines(start, *({"type": "message", "role": r, "content": x, "sessionId": f"B{conv}", "timestamp": _iso(conv, t)} for t, r, x in turns))


def _hermes(conv: int, turns: list[Turn]) -> bytes:
    return json.dumps({"session_id": f"H{conv}", "session_start": "s", "messages": [{"role": r, "content": x, "timestamp": _iso(conv, t)} for t, r, x in turns]}).encode()


def _cline(conv: int, turns: list[Turn]) -> bytes:
    return json.dumps([{"role": r, "content": [{"type": "text", "text": x}], "timestamp": _iso(conv, t)} for t, r, x in turns if r != "system"]).encode()


def _aider(conv: int, turns: list[Turn]) -> bytes:
    out = [f"# aider chat started at {_iso(conv, 0)}", ""]
    for _, role, text in turns:
        if role != "system":
            out += [*(f"#### {x}" if role == "user" else x for x in text.split("\n")), ""]
    return "\n".join(out).encode()


def _database(script: str, *rows: tuple[str, list[tuple]]) -> bytes:
    with closing(sqlite3.connect(":memory:")) as db:
        db.executescript(script)
        for sql, values in rows:
            db.executemany(sql, values)
        db.commit()
        return db.serialize()


def _opencode(conv: int, turns: list[Turn]) -> bytes:
    return _database(
        "CREATE TABLE session(id, title, directory, time_created, time_updated); CREATE TABLE message(id, session_id, data, time_created); CREATE TABLE part(id, message_id, data, time_created);",
        ("INSERT INTO session VALUES (?,?,?,?,?)", [(f"o{conv}", f"Title {conv}", "/d", 1, 2)]),
        ("INSERT INTO message VALUES (?,?,?,?)", [(f"m{t}", f"o{conv}", json.dumps({"role": r}), _seconds(conv, t) * 1000) for t, r, _ in reversed(turns)]),
        ("INSERT INTO part VALUES (?,?,?,?)", [(f"p{t}", f"m{t}", json.dumps({"type": "text", "text": x}), t) for t, _, x in turns]),
    )


def _hermes_state(conv: int, turns: list[Turn]) -> bytes:
    return _database(
        "CREATE TABLE sessions(id, source, model, title, started_at REAL); CREATE TABLE messages(id INTEGER, session_id, role, content, tool_calls, tool_call_id, tool_name, reasoning, timestamp REAL);",
        ("INSERT INTO sessions(id) VALUES (?)", [(f"h{conv}",)]),
        ("INSERT INTO messages(id, session_id, role, content, timestamp) VALUES (?,?,?,?,?)", [(t, f"h{conv}", r, x, float(_seconds(conv, t))) for t, r, x in turns]),
    )


def _cursor_chats(conv: int, turns: list[Turn]) -> bytes:
    bubbles = [{"type": "user" if r == "user" else "ai", "text": x, "timingInfo": {"startTime": _seconds(conv, t)}} for t, r, x in reversed(turns) if r != "system"]
    return _database("CREATE TABLE ItemTable(key, value);", ("INSERT INTO ItemTable VALUES (?,?)", [(CHATS, json.dumps({"tabs": [{"id": f"t{conv}", "createdAt": 1, "bubbles": bubbles}]}))]))


def _cursor_composers(conv: int, turns: list[Turn]) -> bytes:
    heard = [(t, 1 if r == "user" else 2, x) for t, r, x in turns if r != "system"]
    head = {"fullConversationHeadersOnly": [{"bubbleId": str(t), "type": k} for t, k, _ in heard]}
    rows = [(f"{COMPOSER}k{conv}", json.dumps(head)), *((f"{BUBBLE}k{conv}:{t}", json.dumps({"text": x})) for t, _, x in heard)]
    return _database("CREATE TABLE cursorDiskKV(key, value);", ("INSERT INTO cursorDiskKV VALUES (?,?)", rows))


_ZULU = f"strftime(make_timestamp(({EPOCH} + conv_id * 131 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_MILLIS = f"strftime(make_timestamp(({EPOCH} + conv_id * 131 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"
_HEARD = "role IN ('user', 'assistant')"

#: By query: provider, writer of a transcript, which turns are messages, the time that a message keeps.
FORMATS: dict[str, tuple[str, Callable[[int, list[Turn]], bytes], str, str]] = {
    "parse_claude_code": ("claude-code", _claude, "true", _ZULU),
    "parse_codex": ("codex", _codex, "true", "NULL"),
    "parse_grok_build": ("grok-build", _grok, _HEARD, "NULL"),
    "parse_antigravity": ("antigravity", _antigravity, _HEARD, _ZULU),
    "parse_opencode": ("opencode", _opencode, _HEARD, _MILLIS),
    "parse_pi": ("pi", _session, _HEARD, _ZULU),
    "parse_openclaw": ("openclaw", _session, _HEARD, _ZULU),
    "parse_hermes_json": ("hermes", _hermes, _HEARD, _ZULU),
    "parse_hermes_state": ("hermes", _hermes_state, "true", _MILLIS),
    "parse_cursor_chats": ("cursor", _cursor_chats, _HEARD, f"({EPOCH} + conv_id * 131 + turn * 60)::VARCHAR"),
    "parse_cursor_composers": ("cursor", _cursor_composers, _HEARD, "NULL"),
    "parse_kimi_code": ("kimi-code", _kimi, _HEARD, _ZULU),
    "parse_qoder": ("qoder", _qoder, _HEARD, _ZULU),
    "parse_codebuddy": ("tencent-codebuddy", _codebuddy, _HEARD, _ZULU),
    "parse_cline": ("cline", _cline, _HEARD, _ZULU),
    "parse_aider": ("aider", _aider, _HEARD, "NULL"),
}


def written(spark: SparkSession, sf_dir: str, write: Callable[[int, list[Turn]], bytes], provider: str) -> DataFrame:
    """Every conversation as a transcript: what ``parse_files`` takes.  A conversation is a file, and so fits in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs = batch.column(0).to_pylist()
            files = [write(c, [(t["turn"], t["role"], t["text"] or "") for t in turns]) for c, turns in zip(convs, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"/t/{c}" for c in convs]), pa.array([len(f) for f in files], pa.int64()), pa.array(files, pa.binary())], ["source_path", "len_bytes", "content"])

    said = table(spark, sf_dir, "conversations")
    convs = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    files = convs.mapInArrow(run, "source_path string, len_bytes long, content binary")
    return files.withColumn("fingerprint", F.sha2("content", 256)).withColumn("provider_id", F.lit(provider))


def parsed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    provider, write, _, _ = FORMATS[name]
    said = ingest.parse_files(written(spark, sf_dir, write, provider)).filter("kind = 'message'")
    return said.select(F.substring("source_path", 4, 20).cast("long").alias("conv_id"), F.col("place"), "role", "text", "ts_raw")


def parsed_sql(name: str) -> str:
    _, _, which, at = FORMATS[name]
    return f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, text, {at}::VARCHAR AS ts_raw FROM conversations WHERE {which}"


def committed(spark: SparkSession, sf_dir: str) -> ingest.Generations:
    """A store of all conversations as transcripts of two providers: parsed into one table, committed with its index."""
    generations = ingest.Generations(scratch(spark, "store"))
    with generations.scratch(spark) as work:
        for k, name in enumerate(("parse_claude_code", "parse_codex")):
            provider, write, _, _ = FORMATS[name]
            ingest.parse_files(written(spark, sf_dir, write, provider)).write.parquet(f"{work}/{k}")
        events = spark.read.parquet(f"{work}/0").unionByName(spark.read.parquet(f"{work}/1"))
        ingest.refuse_conflicts(ingest.claimed(events))
        generations.commit(ingest.canonicalize(events), "conversations")
    return generations
