"""Parsers of transcripts that are JSON lines: a function of a file's bytes each."""

from __future__ import annotations

from palaver.functions.tools import target_of_input
from palaver.operators.usage import fold_totals, observation
from palaver.sources.events import Calls, Message, Parsed, block_texts
from palaver.sources.reading import json_lines

# Beginnings of user records that a program and not a user wrote.
CLAUDE_NOISE = ("<system-reminder>", "<system-reminder ", "<local-command-caveat>", "Caveat:", "<local-command-stdout>", "<local-command-stderr>", "<bash-input>", "<bash-stdout>", "<bash-stderr>", "<user-prompt-submit-hook>", "<task-notification>")
CLAUDE_INTERRUPTS = ("[Request interrupted by user]", "[Request interrupted by user for tool use]")
CODEX_NOISE = ("# AGENTS.md", "<environment_context>")
# Names of token counts in records.
CLAUDE_USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
CODEX_USAGE = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_read_input_tokens", "reasoning_output_tokens")
SUMMARY_TARGET_CHARS = 512


def claude_noise(text: str) -> bool:
    if text.startswith(CLAUDE_NOISE) or text in CLAUDE_INTERRUPTS or (text.startswith("[Image:") and text.endswith("]")):
        return True
    if not text.startswith("<command-name>"):
        return False
    _, opened, rest = text.partition("<command-args>")
    args, closed, _ = rest.partition("</command-args>")
    return bool(opened and closed and not args.strip())


def _command_envelope(text: str) -> str | None:
    if text.startswith("<command-name>") and "<command-message>" in text and "<command-args>" in text:
        return text.removesuffix("\n")
    return None


def _claude_block(block: dict) -> str | None:
    if isinstance(block.get("text"), str):
        return block["text"]
    if block.get("type") == "thinking" and isinstance(block.get("thinking"), str) and block["thinking"].strip():
        return block["thinking"]
    inner = block.get("content")
    if isinstance(inner, str):
        return inner
    if isinstance(inner, list):
        return "\n".join(t for b in inner if isinstance(b, dict) and (t := _claude_block(b)) is not None) or None
    return None


def _claude_text(content: object, generated: bool) -> str:
    if isinstance(content, str):
        return _command_envelope(content) or content
    blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
    if generated and [b.get("type") for b in blocks] == ["text", "text", "image", "text"]:
        return blocks[3].get("text") or ""  # what a prompt was before a program enriched its copy
    texts = [t for b in blocks if (t := _claude_block(b)) is not None]
    if texts and (envelope := _command_envelope(texts[0])) is not None:
        return envelope
    for b in blocks:
        name = b.get("name")
        if b.get("type") == "tool_use" and isinstance(name, str) and name.strip():
            target = target_of_input(b.get("input"))
            texts.append(f"{name.strip()}({target[:SUMMARY_TARGET_CHARS]})" if target else name.strip())
    return "\n".join(texts)


def _counts(value: object, names: tuple[str, ...]) -> list[int] | None:
    """Counts by name, 0 for those that lack; None if one isn't a whole number of at least 0."""
    if not isinstance(value, dict):
        return None
    out = [value.get(n, 0) for n in names]
    return out if all(type(n) is int and n >= 0 for n in out) else None


def claude(content: bytes) -> Parsed:
    out = Parsed()
    calls = Calls(out)
    for line, r in json_lines(content, (b'"sessionId"', b'"message"', b'"customTitle"', b'"user"', b'"assistant"', b"\\u")):
        if not isinstance(r, dict):
            out.skip(line.number, "not a record")
            continue
        out.see_session(r.get("sessionId"), r.get("cwd"))
        kind, message = r.get("type"), r.get("message")
        if kind == "custom-title":
            out.entitle(None, r.get("customTitle"))
        if kind not in ("user", "assistant") and not (kind == "system" and message is not None):
            continue
        if not isinstance(message, dict):
            out.skip(line.number, "conversational record without a message")
            continue
        body, uuid, side, meta = message.get("content"), r.get("uuid") or "", bool(r.get("isSidechain")), bool(r.get("isMeta"))
        if body is not None and not isinstance(body, str | list):
            out.skip(line.number, "unsupported content")
            continue
        role = message.get("role") or kind
        text = _claude_text(body, meta and r.get("sessionKind") is not None)
        if role == "user" and claude_noise(text.strip()):
            out.skip(line.number, "injected user record")
            continue
        out.messages.append(Message(role, text, uuid, r.get("parentUuid") or None, None if meta else r.get("timestamp"), side, (line.start, line.end)))
        for b in body if isinstance(body, list) else ():
            if isinstance(b, dict) and b.get("type") == "tool_use":
                calls.called(b.get("id"), b.get("name"), b.get("input"), uuid, side)
            elif isinstance(b, dict) and b.get("type") == "tool_result":
                calls.answered(b.get("tool_use_id"), bool(b.get("is_error")), uuid)
        counts = _counts(message.get("usage"), CLAUDE_USAGE)
        if role == "assistant" and counts is not None:
            out.usage.append((uuid, (*counts, 0), "observed"))
    calls.close()
    return out


def codex(content: bytes) -> Parsed:
    out = Parsed()
    calls = Calls(out)
    reports: list[tuple] = []
    anchors: list[str] = []
    forked, last_id = False, ""

    def quad(value: object) -> tuple[int, int, int, int] | None:
        c = _counts(value, CODEX_USAGE)
        return (c[0], c[1], max(c[2], c[3]), c[4]) if c and any(c) else None

    for line, r in json_lines(content, (b'"session_meta"', b'"response_item"', b'"token_count"', b"\\u")):
        if not isinstance(r, dict):
            out.skip(line.number, "not a record")
            continue
        p = r.get("payload")
        p = p if isinstance(p, dict) else {}
        if r.get("type") == "session_meta":
            out.see_session(p.get("session_id") or p.get("id"), p.get("cwd"))
            git = p.get("git")
            if isinstance(git, dict) and isinstance(git.get("repository_url"), str):
                out.remote = out.remote or git["repository_url"]
            forked = forked or bool(p.get("forked_from_id"))
        elif r.get("type") == "event_msg" and p.get("type") == "token_count" and isinstance(p.get("info"), dict):
            reports.append((len(anchors), quad(p["info"].get("total_token_usage")), quad(p["info"].get("last_token_usage"))))
            anchors.append(last_id)
        elif r.get("type") == "response_item":
            kind = p.get("type")
            if kind == "message" and p.get("role") in ("user", "assistant", "developer", "system"):
                text = "\n".join(b["text"] for b in p.get("content") or () if isinstance(b, dict) and isinstance(b.get("text"), str))
                if p["role"] == "user" and text.strip().startswith(CODEX_NOISE):
                    out.skip(line.number, "injected user record")
                    continue
                last_id = p.get("id") or ""
                out.messages.append(Message(p["role"], text, last_id, span=(line.start, line.end)))
            elif kind in ("function_call", "custom_tool_call"):
                value = p.get("input") if kind == "custom_tool_call" else _arguments(p.get("arguments"))
                calls.called(p.get("call_id"), p.get("name"), value, last_id, False)
            elif kind in ("function_call_output", "custom_tool_call_output"):
                calls.answered(p.get("call_id"), bool(p.get("is_error")), None)
    calls.close()
    for place, delta in fold_totals(reports, forked):
        out.usage.append((anchors[place], observation(delta), "derived"))
    return out


def _arguments(text: object) -> object:
    from palaver.functions.tools import loads

    return loads(text) if isinstance(text, str) else text


def grok(content: bytes) -> Parsed:
    """Chunks of one prompt are one message; a rewind drops all from the prompt it names."""
    out = Parsed()
    made: list[tuple[Message, object]] = []  # message, its prompt's number

    def text_of(value: object) -> str:
        return value if isinstance(value, str) else "".join(block_texts([value] if isinstance(value, dict) else value))

    for line, r in json_lines(content):
        if not isinstance(r, dict):
            out.skip(line.number, "not a record")
            continue
        params = r.get("params") if isinstance(r.get("params"), dict) else {}
        update = params.get("update") if isinstance(params.get("update"), dict) else {}
        meta = params.get("_meta") if isinstance(params.get("_meta"), dict) else {}
        out.see_session(params.get("sessionId"), None)
        kind = update.get("sessionUpdate")
        if kind == "rewind_marker":
            target = update.get("targetPromptIndex")
            at = next((k for k, (m, index) in enumerate(made) if m.role == "user" and index == target), None)
            if at is not None:
                del made[at:]
            continue
        chunk = update.get("content")
        shell = isinstance(chunk, dict) and isinstance(chunk.get("_meta"), dict) and "bashCommand" in chunk["_meta"]
        if kind not in ("user_message_chunk", "agent_message_chunk") or shell:
            continue
        role, mark = ("user", meta.get("promptIndex")) if kind.startswith("user") else ("assistant", meta.get("promptId"))
        text = text_of(chunk)
        if not text:
            continue
        if made and made[-1][0].role == role and made[-1][1] == mark:
            made[-1][0].text += text
        else:
            made.append((Message(role, text, span=(line.start, line.end)), mark))
    out.messages = [m for m, _ in made]
    return out


def antigravity(content: bytes) -> Parsed:
    out = Parsed()
    for line, r in json_lines(content):
        if not isinstance(r, dict):
            out.skip(line.number, "not a record")
            continue
        role = {"USER_EXPLICIT": "user", "MODEL": "assistant"}.get(r.get("source"))
        if role is None or r.get("type") == "CONVERSATION_HISTORY":
            continue
        text = next((r[k] for k in ("content", "thinking") if isinstance(r.get(k), str) and r[k].strip()), "")
        if not text:
            out.skip(line.number, "no text")
            continue
        at = r.get("created_at")
        rfc = isinstance(at, str) and len(at) >= 20 and at[4:5] == "-" and at[10:11] == "T" and (at.endswith("Z") or at[-6:-5] in "+-")
        out.messages.append(Message(role, text, timestamp=at if rfc else None, span=(line.start, line.end)))
    return out


def _session_lines(content: bytes, kinds: tuple[str, ...]) -> Parsed:
    out = Parsed()
    for line, r in json_lines(content):
        if not isinstance(r, dict):
            out.skip(line.number, "not a record")
        elif r.get("type") == "session":
            out.see_session(r.get("id"), r.get("cwd"))
        elif r.get("type") == "message":
            m = r.get("message") if isinstance(r.get("message"), dict) else {}
            if m.get("role") not in ("user", "assistant"):
                continue
            text = "\n".join(block_texts(m.get("content"), kinds))
            if not text.strip():
                out.skip(line.number, "no text")
                continue
            if r.get("parentId"):
                out.notes.append(f"line {line.number}: lineage")
            out.messages.append(Message(m["role"], text, timestamp=r.get("timestamp") if isinstance(r.get("timestamp"), str) else None, span=(line.start, line.end)))
    return out


def pi(content: bytes) -> Parsed:
    return _session_lines(content, ("text", "thinking"))


def openclaw(content: bytes) -> Parsed:
    return _session_lines(content, ("text",))


def kimi(content: bytes) -> Parsed:
    out = Parsed()
    for line, r in json_lines(content):
        if not isinstance(r, dict):
            out.skip(line.number, "not a record")
            continue
        kind = r.get("type")
        if kind == "context.append_message" and isinstance(r.get("message"), dict):
            role, parts = r["message"].get("role"), r["message"].get("content")
        elif kind in ("turn.prompt", "turn.steer"):
            role, parts = "user", r.get("input")
        else:
            continue
        text = "\n".join(block_texts(parts))
        if role not in ("user", "assistant") or not text.strip():
            out.skip(line.number, "no text of a user or assistant")
            continue
        at = r.get("timestamp")
        out.messages.append(Message(role, text, timestamp=at if isinstance(at, str) else None, span=(line.start, line.end)))
    return out


def qoder(content: bytes) -> Parsed:
    out = Parsed()
    for line, r in json_lines(content):
        if not isinstance(r, dict):
            out.skip(line.number, "not a record")
            continue
        kind = r.get("type")
        if kind == "session_meta":
            head = r.get("payload") if isinstance(r.get("payload"), dict) else r
            out.see_session(head.get("session_id") or head.get("id"), head.get("cwd"))
        elif kind in ("user", "assistant"):
            m = r.get("message") if isinstance(r.get("message"), dict) else {}
            text = "\n".join(block_texts(m.get("content")))
            if not text.strip():
                out.skip(line.number, "no text")
                continue
            at = m.get("timestamp") or r.get("timestamp")
            out.messages.append(Message(kind, text, r.get("uuid") or "", r.get("parentUuid") or None, at if isinstance(at, str) else None, span=(line.start, line.end)))
    return out


#: The literal first message that a program sends to start a session.
CODEBUDDY_START = "code"


def codebuddy(content: bytes) -> Parsed:
    out = Parsed()
    first = True
    for line, r in json_lines(content):
        if not isinstance(r, dict):
            out.skip(line.number, "not a record")
            continue
        out.see_session(r.get("sessionId"), r.get("cwd"))
        if r.get("type") != "message" or r.get("role") not in ("user", "assistant"):
            continue
        text = "\n".join(block_texts(r.get("content"), ("text", "input_text", "output_text")))
        if r["role"] == "user" and first:
            first = False
            if text.strip() == CODEBUDDY_START:
                out.skip(line.number, "startup record")
                continue
        at = r.get("timestamp")
        out.messages.append(Message(r["role"], text, r.get("id") or "", timestamp=at if isinstance(at, str) else None, span=(line.start, line.end)))
    return out
