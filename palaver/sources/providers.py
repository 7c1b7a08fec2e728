"""The providers: where their files are, how a format is recognised, what it can tell, and its parser."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from palaver.sources import json_lines, sqlite_files, whole_files
from palaver.sources.events import Parsed
from palaver.sources.reading import PROBE_LINES, lines

CONFIRMED, HIGH, LOW, NO = 3, 2, 1, 0


@dataclass(frozen=True)
class Variant:
    provider_id: str
    variant_id: str
    parse: Callable[[bytes], Parsed]
    probe: Callable[[bytes], int]
    root: str | None = None  # below the home folder
    extension: str | None = None
    edges: bool = False
    tools: bool = False
    usage: bool = False
    spans: bool = True


def _records(content: bytes) -> list[dict]:
    out = []
    for k, line in enumerate(lines(content)):
        if k >= PROBE_LINES:
            break
        try:
            value = json.loads(line.data)
        except ValueError:
            continue
        if isinstance(value, dict):
            out.append(value)
    return out


def _share(test: Callable[[dict], bool], sure: Callable[[dict], bool] | None = None) -> Callable[[bytes], int]:
    """Confirmed by a record that only this format has, likely by one that looks like it."""

    def probe(content: bytes) -> int:
        records = _records(content)
        if sure is not None and any(map(sure, records)):
            return CONFIRMED
        return HIGH if any(map(test, records)) else NO

    return probe


def _message(r: dict) -> dict:
    return r["message"] if isinstance(r.get("message"), dict) else {}


def _whole(test: Callable[[object], bool]) -> Callable[[bytes], int]:
    def probe(content: bytes) -> int:
        try:
            return CONFIRMED if test(json.loads(content)) else NO
        except ValueError:
            return NO

    return probe


def _tables(*names: str, key: str | None = None, score: int = CONFIRMED) -> Callable[[bytes], int]:
    def probe(content: bytes) -> int:
        if not content.startswith(b"SQLite format 3\0"):
            return NO
        db = sqlite_files.opened(content)
        try:
            if not set(names) <= sqlite_files.tables(db):
                return NO
            return score if key is None or db.execute(key).fetchone() else NO
        finally:
            db.close()

    return probe


def _markdown(content: bytes) -> int:
    head = content[:65536]
    return CONFIRMED if b"# aider chat started at " in head else LOW if b"\n#### " in b"\n" + head else NO


_session_file = _share(lambda r: r.get("type") == "message" and bool(_message(r).get("role")), lambda r: r.get("type") == "session" and "id" in r)

VARIANTS = (
    Variant("claude-code", "jsonl-v1", json_lines.claude, _share(lambda r: r.get("type") in ("user", "assistant") and "message" in r and "role" in _message(r) and "uuid" in r, lambda r: "uuid" in r and "sessionId" in r and "parentUuid" in r), ".claude/projects", "jsonl", True, True, True),
    Variant("codex", "rollout-jsonl-v1", json_lines.codex, _share(lambda r: r.get("type") == "response_item" and isinstance(r.get("payload"), dict), lambda r: r.get("type") == "session_meta" and isinstance(r.get("payload"), dict) and "timestamp" in r), ".codex/sessions", "jsonl", False, True, True),
    Variant("grok-build", "acp-updates-v1", json_lines.grok, _share(lambda r: False, lambda r: isinstance(r.get("params"), dict) and isinstance(r["params"].get("update"), dict) and "sessionUpdate" in r["params"]["update"]), ".grok/sessions", "jsonl"),
    Variant("antigravity", "transcript-jsonl-v1", json_lines.antigravity, _share(lambda r: False, lambda r: "step_index" in r and r.get("source") in ("USER_EXPLICIT", "MODEL", "SYSTEM")), ".gemini/antigravity-cli/brain", "jsonl"),
    Variant("opencode", "sqlite-v1", sqlite_files.opencode, _tables("session", "message", "part"), ".local/share/opencode", "db", spans=False),
    Variant("pi", "session-jsonl-v1", json_lines.pi, _session_file, ".pi/agent/sessions", "jsonl"),
    Variant("openclaw", "session-jsonl-v3", json_lines.openclaw, _session_file, ".openclaw/agents", "jsonl"),
    Variant("hermes", "session-json-v1", whole_files.hermes_json, _whole(lambda v: isinstance(v, dict) and isinstance(v.get("messages"), list) and "session_id" in v), ".hermes/sessions", "json", spans=False),
    Variant("hermes", "sqlite-state-v1", sqlite_files.hermes_state, _tables("sessions", "messages", key="SELECT 1 FROM pragma_table_info('messages') WHERE name = 'reasoning'"), spans=False),
    Variant("cursor", "vscdb-chat-v1", sqlite_files.cursor_chats, _tables("ItemTable", key=f"SELECT 1 FROM ItemTable WHERE key IN ('{sqlite_files.CHATS}', '{sqlite_files.PROMPTS}')"), spans=False),
    Variant("cursor", "disk-kv-v1", sqlite_files.cursor_composers, _tables("cursorDiskKV", key=f"SELECT 1 FROM cursorDiskKV WHERE key LIKE '{sqlite_files.COMPOSER}%'", score=HIGH), spans=False),
    Variant("kimi-code", "wire-jsonl-v1", json_lines.kimi, _share(lambda r: False, lambda r: r.get("type") in ("context.append_message", "turn.prompt", "turn.steer")), ".kimi-code/sessions", "jsonl"),
    Variant("qoder", "transcript-jsonl-v1", json_lines.qoder, _share(lambda r: False, lambda r: r.get("type") == "session_meta" and "timestamp" not in r), ".qoder/projects", "jsonl"),
    Variant("tencent-codebuddy", "cli-jsonl-v1", json_lines.codebuddy, _share(lambda r: False, lambda r: r.get("type") == "message" and r.get("role") in ("user", "assistant") and "sessionId" in r and "message" not in r), ".codebuddy/projects", "jsonl"),
    Variant("cline", "api-conversation-history-v1", whole_files.cline, _whole(lambda v: isinstance(v, list) and bool(v) and all(isinstance(m, dict) and m.get("role") in ("user", "assistant") for m in v[:5])), ".cline/data/tasks", "json", spans=False),
    Variant("aider", "chat-history-md-v1", whole_files.aider, _markdown, None, "md"),
)
#: Providers that are declared and not read.
DEFERRED = ("deepseek-harness", "zcode")


class Unrecognised(ValueError):
    pass


def select(content: bytes, hint: str | None = None) -> Variant:
    """The variant of the highest confidence; a tie of different variants is refused.  A provider known from the path leaves only its own."""
    scored = []
    for v in VARIANTS:
        if hint in (None, v.provider_id):
            try:
                scored.append((v.probe(content), v))
            except Exception:  # noqa: BLE001 - whatever a probe stumbles over, the file isn't of its format
                continue
    best = max((s for s, _ in scored), default=NO)
    winners = [v for s, v in scored if s == best]
    if best == NO or len(winners) != 1:
        raise Unrecognised("no format recognised" if best == NO else "formats tie: " + ", ".join(v.variant_id for v in winners))
    return winners[0]


def roots(home: str) -> list[tuple[str, str, str]]:
    """(provider, folder, extension) of the providers that keep files below the home folder."""
    return [(v.provider_id, f"{home.rstrip('/')}/{v.root}", v.extension) for v in VARIANTS if v.root]


def provider_of_path(path: str, known: list[tuple[str, str]]) -> str | None:
    """By the longest of the folders (root, provider) that the path lies in, by segments; none if two providers claim it."""
    inside = [(len(r), p) for r, p in known if path == r.rstrip("/") or path.startswith(r.rstrip("/") + "/")]
    best = {p for n, p in inside if n == max(inside)[0]}
    return best.pop() if len(best) == 1 else None
