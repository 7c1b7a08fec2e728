"""Parsers of transcripts that are one JSON document or Markdown."""

from __future__ import annotations

import json

from palaver.sources.events import Message, Parsed, block_texts
from palaver.sources.reading import MAX_WHOLE_BYTES, lines


def _load(content: bytes) -> object:
    if len(content) > MAX_WHOLE_BYTES:
        raise ValueError("source is too large")
    return json.loads(content)


def thought(reasoning: str, text: str | None) -> str:
    head = f"[thinking]\n{reasoning}\n[/thinking]"
    return f"{head}\n{text}" if text is not None else head


def hermes_json(content: bytes) -> Parsed:
    out = Parsed()
    whole = _load(content)
    if not isinstance(whole, dict) or not isinstance(whole.get("messages"), list):
        raise ValueError("not a session document")
    out.see_session(whole.get("session_id"), whole.get("cwd"))
    for k, m in enumerate(whole["messages"], 1):
        text = m.get("content") if isinstance(m, dict) else None
        if not isinstance(m, dict) or m.get("role") not in ("user", "assistant") or not isinstance(text, str) or not text.strip():
            out.skip(k, "not a message with text")
            continue
        reasoning = m.get("reasoning")
        text = thought(reasoning, text) if isinstance(reasoning, str) and reasoning.strip() else text
        at = m.get("timestamp") or whole.get("session_start")
        out.messages.append(Message(m["role"], text, timestamp=at if isinstance(at, str) else None))
    return out


def cline(content: bytes) -> Parsed:
    out = Parsed()
    whole = _load(content)
    if not isinstance(whole, list):
        raise ValueError("not a list of messages")
    for k, m in enumerate(whole, 1):
        if not isinstance(m, dict) or m.get("role") not in ("user", "assistant"):
            out.skip(k, "not a message")
            continue
        text = "\n".join(block_texts(m.get("content")))
        if not text.strip():
            out.skip(k, "no text")
            continue
        at = m.get("timestamp", m.get("ts"))
        out.messages.append(Message(m["role"], text, timestamp=at if isinstance(at, str) else None if at is None else ""))
    return out


_RUN = "# aider chat started at "


def aider(content: bytes) -> Parsed:
    """Lines are the user's, of tools, or plain; a message ends where the speaker changes.  Tool lines belong to the assistant."""
    out = Parsed()
    role, parts, start, end = None, [], 0, 0

    def flush() -> None:
        nonlocal role, parts
        text = "\n".join(parts).strip("\n")
        if role is not None and text.strip():
            out.messages.append(Message(role, text, span=(start, end)))
        role, parts = None, []

    for line in lines(content):
        text = line.data.decode("utf-8")
        bare = text.rstrip()
        if bare.startswith("# aider chat started at"):
            flush()
            out.see_session(bare.removeprefix(_RUN).strip() if out.session_id is None else None, None)
            continue
        if bare == "####" or bare.startswith("#### "):
            speaker, said = "user", bare[5:]
        elif bare == ">" or bare.startswith("> "):
            speaker, said = "assistant", bare[2:]
        elif bare:
            speaker, said = "assistant", text
        elif role == "assistant":
            speaker, said = role, ""
        else:
            continue
        if speaker != role:
            flush()
            role, start = speaker, line.start
        parts.append(said)
        end = line.end
    flush()
    return out
