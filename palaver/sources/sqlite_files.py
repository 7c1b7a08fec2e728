"""Parsers of transcripts in SQLite files: the bytes are opened in memory, so any file system that Spark reads will do."""

from __future__ import annotations

import json
import sqlite3
from collections import defaultdict
from contextlib import closing
from datetime import datetime, timedelta, timezone

from palaver.sources.events import Message, Parsed
from palaver.sources.reading import MAX_SQLITE_BYTES
from palaver.sources.whole_files import thought

# Keys under which an editor keeps chats.
CHATS, PROMPTS = "workbench.panel.aichat.view.aichat.chatdata", "aiService.prompts"
COMPOSER, BUBBLE = "composerData:", "bubbleId:"


def opened(content: bytes) -> sqlite3.Connection:
    if len(content) > MAX_SQLITE_BYTES:
        raise ValueError("source is too large")
    db = sqlite3.connect(":memory:")
    if content[18:20] == b"\x02\x02":  # a copy in write-ahead mode can't be opened in memory; its pages are the same
        content = content[:18] + b"\x01\x01" + content[20:]
    db.deserialize(content)
    return db


def tables(db: sqlite3.Connection) -> set[str]:
    return {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def _json(value: object) -> object:
    if isinstance(value, bytes):
        value = value.decode("utf-8", "strict")
    return json.loads(value) if isinstance(value, str) else None


def _millis(value: object) -> str | None:
    if not isinstance(value, int | float):
        return None
    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=int(value))
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03}Z"


def opencode(content: bytes) -> Parsed:
    """Text parts of a message joined in their order; messages by time and id, over all sessions."""
    out = Parsed()
    with closing(opened(content)) as db:
        sessions = dict(db.execute("SELECT id, directory FROM session"))
        titled = any(c[1] == "title" for c in db.execute("PRAGMA table_info(session)"))
        titles = dict(db.execute("SELECT id, title FROM session")) if titled else {}
        texts: dict[str, list[str]] = defaultdict(list)
        for message, data in db.execute("SELECT message_id, data FROM part ORDER BY time_created, id"):
            part = _json(data)
            if isinstance(part, dict) and part.get("type") == "text" and isinstance(part.get("text"), str):
                texts[message].append(part["text"])
        for native, session, data, at in db.execute("SELECT id, session_id, data, time_created FROM message ORDER BY time_created, id"):
            if session not in sessions:
                raise ValueError("message of an unknown session")
            head = _json(data)
            role = head.get("role") if isinstance(head, dict) else None
            text = "\n".join(texts[native])
            if role not in ("user", "assistant") or not text.strip():
                out.skip(0, "no text of a user or assistant")
                continue
            out.see_session(session, sessions[session])
            out.entitle(session, titles.get(session))
            out.messages.append(Message(role, text, native, timestamp=_millis(at), session=session))
    return out


#: Rows beyond which a source is refused.
HERMES_ROWS = 1_000_000


def hermes_state(content: bytes) -> Parsed:
    out = Parsed()
    with closing(opened(content)) as db:
        if db.execute("SELECT count(*) FROM messages").fetchone()[0] > HERMES_ROWS:
            raise ValueError("source has too many rows")
        known = [r[0] for r in db.execute("SELECT id FROM sessions ORDER BY id")]
        for session in known:
            rows = db.execute("SELECT id, role, content, reasoning, timestamp FROM messages WHERE session_id = ? ORDER BY timestamp, id", (session,))
            for _, role, text, reasoning, at in rows:
                reasoned = isinstance(reasoning, str) and reasoning.strip()
                if role not in ("user", "assistant", "system", "developer", "tool") or not (reasoned or (isinstance(text, str) and text.strip())):
                    out.skip(0, "not a message with text")
                    continue
                text = text if isinstance(text, str) and text.strip() else None
                out.see_session(session, None)
                out.messages.append(Message(role, thought(reasoning, text) if reasoned else text, timestamp=_millis(at * 1000 if isinstance(at, int | float) else None), session=session))
    return out


def _late(value: object) -> float:
    return value if isinstance(value, int | float) else float("inf")


def cursor_chats(content: bytes) -> Parsed:
    """Tabs by their time with their bubbles by theirs; then prompts with responses, by conversation."""
    out = Parsed()
    with closing(opened(content)) as db:
        kept = dict(db.execute("SELECT key, value FROM ItemTable WHERE key IN (?, ?)", (CHATS, PROMPTS)))
    for key in (CHATS, PROMPTS):
        try:
            value = _json(kept.get(key)) if kept.get(key) else None
        except ValueError:
            out.skip(0, f"{key} is no JSON")
            continue
        if key == CHATS and isinstance(value, dict):
            for tab in sorted(value.get("tabs") or (), key=lambda t: _late(t.get("createdAt"))):
                bubbles = [(b, b.get("text") if b.get("text") is not None else b.get("rawText")) for b in tab.get("bubbles") or () if b.get("type")]
                bubbles = [(b, t, (b.get("timingInfo") or {}).get("startTime")) for b, t in bubbles if isinstance(t, str) and t.strip()]
                for b, t, at in sorted(bubbles, key=lambda x: _late(x[2])):
                    out.see_session(tab.get("id"), None)
                    out.messages.append(Message("user" if b["type"] == "user" else "assistant", t, timestamp=None if at is None else str(at), session=tab.get("id")))
        elif key == PROMPTS and isinstance(value, list):
            groups: dict[str, list[dict]] = defaultdict(list)
            for row in value:
                if isinstance(row, dict):
                    groups[row.get("conversationId") or "default"].append(row)
            for session, rows in sorted(groups.items(), key=lambda g: min(_late(r.get("createdAt")) for r in g[1])):
                for row in sorted(rows, key=lambda r: _late(r.get("createdAt"))):
                    at = row.get("createdAt")
                    for role, t in (("user", row.get("prompt")), ("assistant", row.get("response"))):
                        if isinstance(t, str) and t.strip():
                            out.see_session(session, None)
                            out.messages.append(Message(role, t, timestamp=None if at is None else str(at), session=session))
    return out


def cursor_composers(content: bytes) -> Parsed:
    """A composer's header lists its bubbles in order; a bubble is a row of its own.  Slots without a usable row are counted as skipped."""
    out = Parsed()
    with closing(opened(content)) as db:
        rows = {(k.decode() if isinstance(k, bytes) else k): v for k, v in db.execute("SELECT key, value FROM cursorDiskKV")}
    for key in sorted((k for k in rows if isinstance(k, str) and k.startswith(COMPOSER)), key=str.encode):
        composer = key.removeprefix(COMPOSER)
        try:
            headers = _json(rows[key]).get("fullConversationHeadersOnly")
            headers = headers if isinstance(headers, list) else []
        except (ValueError, AttributeError):
            out.skip(0, f"composer {composer} is malformed")
            continue
        seen = set()
        for slot in headers:
            native = slot.get("bubbleId") if isinstance(slot, dict) else None
            role = {1: "user", 2: "assistant"}.get(slot.get("type")) if isinstance(slot, dict) else None
            try:
                bubble = _json(rows.get(f"{BUBBLE}{composer}:{native}"))
            except ValueError:
                bubble = None
            if not isinstance(native, str) or native in seen or role is None or not isinstance(bubble, dict):
                out.skip(0, "slot without a usable bubble")
                continue
            seen.add(native)
            text = bubble.get("text") if isinstance(bubble.get("text"), str) else ""
            tool = bubble.get("toolFormerData")
            if not text.strip() and isinstance(tool, dict) and isinstance(tool.get("name"), str):
                args = tool.get("rawArgs") or tool.get("params") or ""
                text = f"{tool['name']}({args})" if isinstance(args, str) and args else tool["name"]
            if not text.strip():
                out.skip(0, "bubble without text")
                continue
            out.see_session(composer, None)
            out.messages.append(Message(role, text, session=composer))
    return out
