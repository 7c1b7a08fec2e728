import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from palaver import api
from palaver.functions import cursors
from palaver.operators import budgets
from palaver.sources import ingest, json_lines, providers, reading, sqlite_files, whole_files


def jl(*records):
    return "\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records).encode() + b"\n"


CLAUDE = jl(
    {"type": "custom-title", "customTitle": "My work", "sessionId": "S1"},
    {"type": "user", "uuid": "u1", "parentUuid": None, "sessionId": "S1", "cwd": "/w", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "Wie läuft 😀 it?"}},
    "{torn",
    "",
    {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "sessionId": "S1", "timestamp": "2024-01-01T00:00:05Z", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "I look"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "a.py"}}], "usage": {"input_tokens": 5, "output_tokens": 2}}},
    {"type": "user", "uuid": "u2", "parentUuid": "a1", "sessionId": "S1", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done", "is_error": True}]}},
    {"type": "assistant", "uuid": "s1", "parentUuid": "a1", "isSidechain": True, "sessionId": "S1", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "t2", "name": "mcp__x", "input": {"path": "p"}}], "usage": {"input_tokens": -1}}},
    {"type": "user", "uuid": "n1", "sessionId": "S1", "message": {"role": "user", "content": "<system-reminder>x</system-reminder>"}},
    {"type": "user", "uuid": "n2", "sessionId": "S1", "message": {"role": "user", "content": "<command-name>/clear</command-name><command-message>c</command-message><command-args> </command-args>"}},
)
CODEX = jl(
    {"timestamp": "t", "type": "session_meta", "payload": {"session_id": "C1", "cwd": "/c", "git": {"repository_url": "git@github.com:acme/parser.git"}}},
    {"timestamp": "t", "type": "response_item", "payload": {"type": "message", "role": "user", "id": "m0", "content": [{"type": "input_text", "text": "# AGENTS.md instructions"}]}},
    {"timestamp": "t", "type": "response_item", "payload": {"type": "message", "role": "user", "id": "m1", "content": [{"type": "input_text", "text": "fix the parser"}]}},
    {"timestamp": "t", "type": "event_msg", "payload": {"type": "agent_message", "message": "mirror"}},
    {"timestamp": "t", "type": "response_item", "payload": {"type": "message", "role": "assistant", "id": "m2", "content": [{"type": "output_text", "text": "running"}]}},
    {"timestamp": "t", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{\"command\": \"ls\"}", "call_id": "c1"}},
    {"timestamp": "t", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "error"}},
    {"timestamp": "t", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 3}}}},
    {"timestamp": "t", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 25, "cached_input_tokens": 6, "output_tokens": 5}}}},
)


def test_claude():
    p = json_lines.claude(CLAUDE)
    assert [(m.role, m.text, m.native_id, m.parent, m.is_sidechain) for m in p.messages] == [
        ("user", "Wie läuft 😀 it?", "u1", None, False), ("assistant", "hm\nI look\nRead(a.py)", "a1", "u1", False), ("user", "done", "u2", "a1", False), ("assistant", "mcp__x(p)", "s1", "a1", True),
    ]
    assert p.skipped == 3 and p.session_id == "S1" and p.cwd == "/w" and p.id_state == "resolved"
    assert p.activities == [("u2", "file", "Read", "a.py", "main", "error"), ("s1", "unknown", "mcp__x", None, "subagent", "unknown")]
    assert p.usage == [("a1", (5, 2, 0, 0, 0), "observed")]
    for m in p.messages:
        assert json.loads(CLAUDE[slice(*m.span)])["uuid"] == m.native_id


def test_codex():
    p = json_lines.codex(CODEX)
    assert [(m.role, m.text, m.timestamp) for m in p.messages] == [("user", "fix the parser", None), ("assistant", "running", None)] and p.skipped == 1
    assert p.activities == [("m2", "command", "shell", "ls", "main", "success")]
    assert p.usage == [("m2", (6, 3, 4, 0, 0), "derived"), ("m2", (13, 2, 2, 0, 0), "derived")]


def grok(kind, text=None, target=None, **meta):
    return {"params": {"sessionId": "G", "update": {"sessionUpdate": kind, "content": {"type": "text", "text": text} if text else None, "targetPromptIndex": target}, "_meta": meta}}


def test_grok_merges_and_rewinds():
    c = jl(grok("user_message_chunk", "he", promptIndex=0), grok("user_message_chunk", "llo", promptIndex=0), grok("agent_message_chunk", "a", promptId="p"), grok("user_message_chunk", "two", promptIndex=1), grok("agent_message_chunk", "b", promptId="q"), grok("rewind_marker", target=1), grok("user_message_chunk", "three", promptIndex=1))
    assert [(m.role, m.text) for m in json_lines.grok(c).messages] == [("user", "hello"), ("assistant", "a"), ("user", "three")]


def test_line_formats():
    a = jl({"step_index": 0, "source": "USER_EXPLICIT", "content": "q", "created_at": "2024-01-01T00:00:00Z"}, {"step_index": 1, "source": "MODEL", "thinking": "t", "created_at": "soon"}, {"source": "SYSTEM", "content": "x"}, {"source": "MODEL", "type": "CONVERSATION_HISTORY", "content": "y"})
    assert [(m.role, m.text, m.timestamp) for m in json_lines.antigravity(a).messages] == [("user", "q", "2024-01-01T00:00:00Z"), ("assistant", "t", None)]
    s = jl({"type": "session", "id": "P", "cwd": "/p"}, {"type": "message", "parentId": "z", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "th"}, {"type": "text", "text": "tx"}]}})
    assert json_lines.pi(s).messages[0].text == "th\ntx" and json_lines.openclaw(s).messages[0].text == "tx" and json_lines.pi(s).cwd == "/p"
    k = jl({"type": "turn.prompt", "input": [{"type": "text", "text": "go"}]}, {"type": "context.append_message", "message": {"role": "assistant", "content": "ok"}}, {"type": "context.append_loop_event"})
    assert [(m.role, m.text) for m in json_lines.kimi(k).messages] == [("user", "go"), ("assistant", "ok")]
    q = jl({"type": "session_meta", "payload": {"session_id": "Q", "cwd": "/q"}}, {"type": "user", "timestamp": "r", "message": {"content": "hi", "timestamp": "m"}})
    assert json_lines.qoder(q).messages[0].timestamp == "m" and json_lines.qoder(q).session_id == "Q"
    b = jl({"type": "message", "role": "user", "content": "code", "sessionId": "B"}, {"type": "message", "role": "user", "content": "code", "sessionId": "B"}, {"type": "file"})
    assert [m.text for m in json_lines.codebuddy(b).messages] == ["code"] and json_lines.codebuddy(b).skipped == 1


def test_documents():
    h = json.dumps({"session_id": "H", "session_start": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "reasoning": "r", "timestamp": "t"}, {"role": "assistant", "content": "", "reasoning": "r"}]}).encode()
    p = whole_files.hermes_json(h)
    assert [(m.text, m.timestamp) for m in p.messages] == [("q", "s"), ("[thinking]\nr\n[/thinking]\na", "t")] and p.skipped == 1
    c = json.dumps([{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "image"}], "timestamp": 5}, {"role": "assistant", "content": "y"}]).encode()
    assert [(m.text, m.timestamp) for m in whole_files.cline(c).messages] == [("x", ""), ("y", None)]
    a = b"# aider chat started at 2024-01-01 10:00:00\n\n#### do this\n#### and that\n> Applied edit\nplain\n\nmore\n#### next\n"
    p = whole_files.aider(a)
    assert [(m.role, m.text) for m in p.messages] == [("user", "do this\nand that"), ("assistant", "Applied edit\nplain\n\nmore"), ("user", "next")] and p.session_id == "2024-01-01 10:00:00"


def database(tmp_path, script, rows=()):
    path = tmp_path / "x.db"
    db = sqlite3.connect(path)
    db.executescript(script)
    for sql, values in rows:
        db.executemany(sql, values)
    db.commit()
    db.close()
    return path.read_bytes()


def test_sqlite(tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir(), (tmp_path / "c").mkdir()
    o = database(tmp_path / "a", "CREATE TABLE session(id, title, directory, time_created, time_updated); CREATE TABLE message(id, session_id, data, time_created); CREATE TABLE part(id, message_id, data, time_created);", [
        ("INSERT INTO session VALUES (?,?,?,?,?)", [("s", "t", "/d", 1, 2)]), ("INSERT INTO message VALUES (?,?,?,?)", [("m2", "s", '{"role":"assistant"}', 2000), ("m1", "s", '{"role":"user"}', 1000), ("m3", "s", '{"role":"tool"}', 3000)]),
        ("INSERT INTO part VALUES (?,?,?,?)", [("p2", "m1", '{"type":"text","text":"b"}', 2), ("p1", "m1", '{"type":"text","text":"a"}', 1), ("p3", "m2", '{"type":"text","text":"c"}', 1), ("p4", "m3", '{"type":"file"}', 1)]),
    ])
    p = sqlite_files.opencode(o)
    assert [(m.role, m.text, m.timestamp) for m in p.messages] == [("user", "a\nb", "1970-01-01T00:00:01.000Z"), ("assistant", "c", "1970-01-01T00:00:02.000Z")] and p.skipped == 1 and p.cwd == "/d"
    h = database(tmp_path / "b", "CREATE TABLE sessions(id, source, model, title, started_at REAL); CREATE TABLE messages(id INTEGER, session_id, role, content, tool_calls, tool_call_id, tool_name, reasoning, timestamp REAL);", [
        ("INSERT INTO sessions(id) VALUES (?)", [("b",), ("a",)]), ("INSERT INTO messages(id, session_id, role, content, reasoning, timestamp) VALUES (?,?,?,?,?,?)", [(2, "a", "assistant", None, "r", 2.5), (1, "a", "user", "q", None, 1.0), (3, "b", "tool", "out", None, None), (4, "b", "alien", "x", None, 1.0)]),
    ])
    p = sqlite_files.hermes_state(h)
    assert [(m.role, m.text, m.timestamp, m.session) for m in p.messages] == [("user", "q", "1970-01-01T00:00:01.000Z", "a"), ("assistant", "[thinking]\nr\n[/thinking]", "1970-01-01T00:00:02.500Z", "a"), ("tool", "out", None, "b")] and p.id_state == "ambiguous"
    chats = json.dumps({"tabs": [{"id": "late", "bubbles": [{"type": "ai", "text": "z"}]}, {"id": "t", "createdAt": 5, "bubbles": [{"type": "ai", "rawText": "y", "timingInfo": {"startTime": 9}}, {"type": "user", "text": "x", "timingInfo": {"startTime": 3}}]}]})
    prompts = json.dumps([{"prompt": "p", "response": "r", "createdAt": 7, "conversationId": "c"}])
    composer = json.dumps({"fullConversationHeadersOnly": [{"bubbleId": "1", "type": 1}, {"bubbleId": "2", "type": 2}, {"bubbleId": "1", "type": 1}, {"bubbleId": "9", "type": 2}]})
    cur = database(tmp_path / "c", "CREATE TABLE ItemTable(key, value); CREATE TABLE cursorDiskKV(key, value);", [
        ("INSERT INTO ItemTable VALUES (?,?)", [(sqlite_files.CHATS, chats), (sqlite_files.PROMPTS, prompts)]), ("INSERT INTO cursorDiskKV VALUES (?,?)", [("composerData:k", composer), ("bubbleId:k:1", '{"text": "hi"}'), ("bubbleId:k:2", '{"text": "", "toolFormerData": {"name": "run", "rawArgs": "{}"}}')]),
    ])
    assert [(m.role, m.text, m.timestamp, m.session) for m in sqlite_files.cursor_chats(cur).messages] == [("user", "x", "3", "t"), ("assistant", "y", "9", "t"), ("assistant", "z", None, "late"), ("user", "p", "7", "c"), ("assistant", "r", "7", "c")]
    p = sqlite_files.cursor_composers(cur)
    assert [(m.role, m.text) for m in p.messages] == [("user", "hi"), ("assistant", "run({})")] and p.skipped == 2
    assert providers.select(cur).variant_id == "vscdb-chat-v1" and providers.select(o).provider_id == "opencode" and providers.select(h).variant_id == "sqlite-state-v1"


def test_lines_keep_byte_places():
    content = b"\xef\xbb\xbfa\r\n\nb\xe2\x80\xa8c\nlast"
    got = list(reading.lines(content))
    assert [(line.number, line.start, line.end, line.data) for line in got] == [(1, 0, 4, b"a"), (2, 6, 6, b""), (3, 7, 12, b"b\xe2\x80\xa8c"), (4, 13, 17, b"last")]
    with pytest.raises(reading.RecordTooLong):
        list(reading.lines(b"x" * 11, 10))


def test_file_health():
    assert [reading.file_health(c) for c in (b'{"a":1}\n', b'{"a"\n{"a":1}\n', b'{"a":1}\n{"a', b"junk", b"")] == ["clean", "partial", "invalid", "invalid", "clean"]


def test_selection():
    assert providers.select(CLAUDE).provider_id == "claude-code" and providers.select(CODEX).provider_id == "codex"
    with pytest.raises(providers.Unrecognised):
        providers.select(b"nothing of the kind")
    pi = jl({"type": "session", "id": "P"}, {"type": "message", "message": {"role": "user", "content": "x"}})
    with pytest.raises(providers.Unrecognised, match="tie"):
        providers.select(pi)
    assert providers.select(pi, "openclaw").variant_id == "session-jsonl-v3"
    assert providers.provider_of_path("/h/.pi/x/f", [("/h/.pi", "pi"), ("/h/.pi/x", "q")]) == "q"


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    """A home folder as ``sync`` finds it."""
    base = tmp_path_factory.mktemp("home")
    for root, name, content in ((".claude/projects/p", "a.jsonl", CLAUDE), (".codex/sessions/d", "r.jsonl", CODEX), (".claude/projects/p", "bad.jsonl", b"junk\n")):
        (base / root).mkdir(parents=True, exist_ok=True)
        (base / root / name).write_bytes(content)
    return base


def test_sync_and_search(spark, home, tmp_path):
    generations = ingest.Generations(f"file://{tmp_path}/store")
    assert api.sync(spark, f"file://{home}", generations)
    assert not api.sync(spark, f"file://{home}", generations) and generations.current(spark)["generation"] == 1
    store = generations.open(spark)
    assert store.messages.count() == 6 and api.doctor(store).filter("n > 0").count() == 0
    (tmp_path / "store/WRITER").touch()
    with pytest.raises(ingest.Busy):
        generations.commit(store, "other")
    (tmp_path / "store/WRITER").write_text(json.dumps({"owner": "dead", "until": 1}))  # what a dead writer left is taken over
    with generations.writing(spark):
        with pytest.raises(ingest.Busy), generations.writing(spark):
            pass
    assert not (tmp_path / "store/WRITER").exists() and not list((tmp_path / "store").glob("work-*"))
    now = 1_704_067_200_000 + 86_400_000
    engine = api.Engine.open(spark, generations, now_ms=now)
    scanning = api.Engine(spark, store, now_ms=now)
    for words in ("parser", "S1"):
        told = [[(r["id"], round(r["score"], 9), r["has_more"]) for r in e.search(api.Search(words, limit=2)).collect()] for e in (engine, scanning)]
        assert told[0] == told[1]
    assert sorted((r["title"] or "", r["repo_slug"] or "") for r in store.sessions.collect()) == [("", "github.com/acme/parser"), ("My work", "")]
    assert [r["sessions"] for r in engine.repositories().collect()] == [1]
    assert {r["id"] for r in engine.search(api.Search("parser", repo="github.com/acme/parser")).collect()} >= {"msg_v1_m1"} and engine.search(api.Search("läuft", repo="github.com/acme/parser")).count() == 0
    first = engine.search(api.Search("a", limit=1, budget=budgets.Budget(max_bytes=4096))).collect()
    assert len(first) <= 1
    generations.rebuild(spark)
    assert "index-" in generations.index(spark) and [r["id"] for r in api.Engine.open(spark, generations, now_ms=now).search(api.Search("parser")).collect()] == [r["id"] for r in engine.search(api.Search("parser")).collect()]
    listed = engine.list_entities(5, kind="session").collect()
    assert [r["session_id"] for r in listed] == sorted(r["session_id"] for r in store.sessions.collect()) and "My work" in [r["title"] for r in listed]
    hits = engine.search(api.Search("parser")).collect()
    assert [h["id"] for h in hits][0].startswith(("msg_v1_m1", "ses_v1_")) and {h["id"] for h in hits} >= {"msg_v1_m1"}
    assert engine.search(api.Search("look", providers=("codex",))).count() == 0
    assert [r["id"] for r in engine.search(api.Search("läuft", since="2d")).collect()] == ["msg_v1_u1"]
    assert engine.search(api.Search("läuft", until="2024-01-01T00:00:00Z")).count() == 0
    assert [r["id"] for r in engine.search(api.Search("Read a.py", tool_kind="file")).collect()] == []
    assert [r["id"] for r in engine.search(api.Search("done", tool_kind="file", tool_name="Read")).collect()] == ["msg_v1_u2"]
    session = store.placements.filter("message_id = 'msg_v1_u1'").first()["session_id"]
    chain = [r["message_id"] for r in engine.context(session).collect()]
    assert chain == ["msg_v1_u1", "msg_v1_a1", "msg_v1_u2"]
    assert [r["message_id"] for r in engine.message_window("msg_v1_a1", 1).collect()] == chain
    assert [(r["message_id"], r["reason"]) for r in engine.context(session, max_messages=1).collect()] == [("msg_v1_u1", "max_items")]
    assert [r["message_id"] for r in engine.message_window("msg_v1_a1", 1, max_messages=1).collect()] == ["msg_v1_a1"]
    assert api.hook_query("session_start", {"cwd": "/a/proj/"}) == "proj" and api.hook_query("user_prompt_submit", {"prompt": " x "}) == "x"
    assert engine.context(session, level="talks").count() == 2 and engine.context(session, level="sessions").first()["turn_count"] == 2
    with pytest.raises(api.InvalidRequest):
        engine.context(session, require_complete=True)
    with pytest.raises(api.NotFound):
        engine.get("msg_v1_zzz")
    assert engine.get("msg_v1_a1").first()["parent_message_id"] == "msg_v1_u1"
    assert engine.session_resume(session).first()["command"] == "(cd /w && claude --resume S1)"
    assert engine.status().first()["observed_events"] == 1 and engine.status().first()["derived_events"] == 2
    pack = engine.handoff(api.Search("parser"))
    assert pack["evidence"] and pack["confidence"]["overall"] in ("high", "medium")
    with_vectors = api.Engine(spark, store, now_ms=0, vectors=engine.build_vectors())
    assert with_vectors.search(api.Search("fix the parser", mode="semantic", limit=1)).first()["id"] == "msg_v1_m1"
    assert with_vectors.search(api.Search("parser", mode="hybrid")).first()["retrieval"] == "hybrid"
    assert engine.search(api.Search("parser", mode="semantic")).first()["retrieval"] == "lexical_fallback"
    grouped = engine.search(api.Search("parser", group_by_session=True)).collect()
    assert len({g["session_id"] for g in grouped}) == len(grouped)
    q = api.Search("parser", limit=1)
    assert engine.resume_page(q, engine.cursor(q, 1), engine.now_ms).offset == 1
    (home / ".codex/sessions/d/r.jsonl").write_bytes(CODEX + jl({"type": "response_item", "payload": {"type": "message", "role": "user", "id": "m9", "content": [{"type": "input_text", "text": "again"}]}}))
    assert api.sync(spark, f"file://{home}", generations) and generations.open(spark).messages.count() == 7
    again = generations.open(spark)
    assert again.usage_events.count() == 3 and again.tool_activities.count() == 3 and api.doctor(again).filter("n > 0").count() == 0
    # A torn end leaves what was read before.
    whole = (home / ".codex/sessions/d/r.jsonl").read_bytes()
    (home / ".codex/sessions/d/r.jsonl").write_bytes(whole[:-30])
    assert not api.sync(spark, f"file://{home}", generations) and generations.open(spark).messages.count() == 7
    (home / ".codex/sessions/d/r.jsonl").write_bytes(whole)
    # A source that is gone takes what only it had; a folder that is gone says nothing.
    copy = home / ".claude/projects/p/copy.jsonl"
    copy.write_bytes(CLAUDE.split(b"\n")[1] + b"\n")
    (home / ".claude/projects/p/a.jsonl").rename(home / "a.kept")
    (home / ".codex").rename(home / ".codex-kept")
    assert api.sync(spark, f"file://{home}", generations)
    assert {r["message_id"] for r in generations.open(spark).messages.collect()} == {"msg_v1_u1", "msg_v1_m1", "msg_v1_m2", "msg_v1_m9"}
    copy.unlink(), (home / "a.kept").rename(home / ".claude/projects/p/a.jsonl"), (home / ".codex-kept").rename(home / ".codex")


def test_conflicts_are_refused(spark, tmp_path):
    """One id with two contents in a source, and sources that disagree about a stable field."""
    (tmp_path / ".claude/projects/p").mkdir(parents=True)
    one = {"type": "user", "uuid": "u1", "parentUuid": None, "sessionId": "S", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "a"}}
    generations = ingest.Generations(f"file://{tmp_path}/store")
    (tmp_path / ".claude/projects/p/a.jsonl").write_bytes(jl(one, one | {"message": {"role": "user", "content": "b"}}))
    with pytest.raises(ingest.Conflict, match="two contents"):
        api.sync(spark, f"file://{tmp_path}", generations)
    (tmp_path / ".claude/projects/p/a.jsonl").write_bytes(jl(one))
    (tmp_path / ".claude/projects/p/b.jsonl").write_bytes(jl(one | {"timestamp": "2024-01-02T00:00:00Z", "message": {"role": "user", "content": "a and more"}}))
    with pytest.raises(ingest.Conflict, match="disagree"):
        api.sync(spark, f"file://{tmp_path}", generations)
    (tmp_path / ".claude/projects/p/b.jsonl").write_bytes(jl(one | {"message": {"role": "user", "content": "a and more"}}))
    assert api.sync(spark, f"file://{tmp_path}", generations)
    assert [r["text"] for r in generations.open(spark).messages.collect()] == ["a and more"]


def test_facts_purge_and_discovery(spark, home, tmp_path):
    generations = ingest.Generations(f"file://{tmp_path}/store")
    assert api.add_facts(spark, generations, [("k1", "the kettle is blue"), ("k1", "told again"), ("k2", "tea")])
    assert not api.add_facts(spark, generations, [("k2", "tea")])
    engine = api.Engine.open(spark, generations, now_ms=0)
    assert [r["text"] for r in engine.search(api.Search("kettle")).collect()] == ["the kettle is blue"]
    assert not api.purge(spark, generations)
    store = generations.open(spark)
    lost = spark.createDataFrame([("msg_v1_none", "file", "main", "Read", None, "success")], store.tool_activities.schema)
    assert generations.commit(store.with_tables(tool_activities=lost), "other") and api.purge(spark, generations)
    assert generations.open(spark).tool_activities.count() == 0 and generations.open(spark).messages.count() == 2
    scan = spark.createDataFrame([("/a/x.jsonl", "pi", "doc_v1_1", 1, "f", 1, True, 1, 1), ("/ab/x.jsonl", "pi", "doc_v1_2", 1, "f", 1, True, 1, 1)], generations.open(spark).source_scans.schema)
    assert generations.commit(generations.open(spark).with_tables(source_scans=scan), "with scans")
    preview, token = api.plan_relocation(spark, generations, "/a", "/b/c", 1000)
    assert [tuple(r) for r in preview.collect()] == [("/a/x.jsonl", "/b/c/x.jsonl")]
    for wrong in (("/a", "/b/d", token, 2000), ("/a", "/b/c", token, 1000 + cursors.TTL_MS), ("/a", "/b/c", token + "0", 2000)):
        with pytest.raises(cursors.CursorError):
            api.apply_relocation(spark, generations, *wrong)
    before = generations.open(spark)
    assert api.apply_relocation(spark, generations, "/a", "/b/c", token, 2000)
    assert sorted(r["source_path"] for r in generations.open(spark).source_scans.collect()) == ["/ab/x.jsonl", "/b/c/x.jsonl"] and before.source_scans.count() == 2
    with pytest.raises(cursors.CursorError, match="generation"):
        api.apply_relocation(spark, generations, "/a", "/b/c", token, 2000)
    told = {r["provider_id"]: r for r in api.discovery(spark, f"file://{home}").collect()}
    assert (told["claude-code"]["complete"], told["claude-code"]["found"], told["claude-code"]["new"]) == (True, 2, 2) and (told["pi"]["complete"], told["pi"]["found"]) == (False, 0)


def test_lines_of_no_interest_are_not_parsed():
    content = b'{"type": "progress", "data": 1}\n{"type": "user", "message": {}}\n{torn\n[1]\n'
    assert [(line.number, value) for line, value in reading.json_lines(content, (b'"message"',))] == [(2, {"type": "user", "message": {}}), (3, None), (4, [1])]


def test_remotes_of_folders(tmp_path):
    from palaver.functions.places import git_remote

    (tmp_path / "r/.git").mkdir(parents=True)
    (tmp_path / "r/in/side").mkdir(parents=True)
    (tmp_path / "r/.git/config").write_text('[core]\n\tbare = false\n[remote "up"]\n\turl = x\n[remote "origin"]\n\turl = https://h.org/o/n.git\n\tfetch = y\n')
    assert git_remote(str(tmp_path / "r/in/side")) == "https://h.org/o/n.git" and git_remote("relative") is None and git_remote("/none/such") is None


def test_reports(spark, home):
    files = reading.snapshot(reading.discover(spark, f"file://{home}/.*", "jsonl"))
    told = {r["source_path"].rsplit("/", 1)[1]: r for r in ingest.report(ingest.parse_files(files)).collect()}
    assert sorted(told) == ["a.jsonl", "bad.jsonl", "r.jsonl"]
    assert told["a.jsonl"]["committed"] == 4 and told["a.jsonl"]["skipped"] == 3 and told["bad.jsonl"]["committed"] is None


def test_stream_follows_new_files(spark, home, tmp_path):
    from palaver.streaming.incremental import event_windows, follow

    seen = []
    q = follow(spark, f"file://{home}/.claude", "jsonl", lambda df, n: seen.append(df.filter("kind = 'message'").count()), f"{tmp_path}/cp")
    q.awaitTermination()
    assert sum(seen) == 4
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:11:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert event_windows(events).count() == 2
