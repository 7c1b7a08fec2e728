"""The older reading of tool activities out of stored payloads.

Its kinds, keys and guesses differ from those of ``tools`` on purpose: both are in use,
and a query names the one it means.
"""

from __future__ import annotations

from collections.abc import Iterator

from palaver.functions.tools import loads

# Tools by kind, and keys that name a target, in this reading.
FILE_NAMES = ("Read", "read", "Write", "write", "Edit", "edit", "MultiEdit")
COMMAND_NAMES = ("Bash", "bash", "Execute", "execute", "Shell")
SEARCH_NAMES = ("Grep", "grep", "Glob", "glob", "Search", "search")
TARGET_KEYS = ("file_path", "command", "query", "pattern", "path", "filename")
FAILURE_WORDS = ("error", "failed", "exception")
LOOKED_AT = 200

SCHEMA = "kind string, actor string, name string, target string, status string, message string"


def _kind(name: str) -> str:
    named = {"file_operation": FILE_NAMES, "command": COMMAND_NAMES, "search": SEARCH_NAMES}
    return next((k for k, names in named.items() if name in names), "tool_call")


def _outcome(content: object) -> tuple[str, str | None]:
    if isinstance(content, list):
        content = "\n".join(b["text"] for b in content if isinstance(b, dict) and isinstance(b.get("text"), str))
    if not isinstance(content, str) or not content:
        return "unknown", None
    start = content[:LOOKED_AT]
    return ("failure", start) if any(w in start.lower() for w in FAILURE_WORDS) else ("success", None)


def activities(value: object) -> Iterator[tuple]:
    """(kind, actor, name, target, status, message) of the calls and results anywhere in a payload."""
    if isinstance(value, list):
        for item in value:
            if isinstance(item, dict):
                yield from activities(item)
    elif isinstance(value, dict):
        if value.get("type") == "tool_use":
            name = value["name"] if isinstance(value.get("name"), str) else "unknown"
            given = value.get("input") if isinstance(value.get("input"), dict) else {}
            target = next((given[k] for k in TARGET_KEYS if isinstance(given.get(k), str) and given[k]), None)
            yield _kind(name), "assistant", name, target, "unknown", None
        elif value.get("type") == "tool_result":
            yield "tool_result", "assistant", "tool_result", None, *_outcome(value.get("content"))
        else:
            for inner in value.values():
                yield from activities(inner)


def extract(payloads, id_col: str = "message_id", payload: str = "payload"):
    """A row for each activity in a column of JSON payloads; payloads that aren't JSON have none."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = [(i, *a) for i, p in zip(frame[id_col], frame[payload], strict=True) for a in activities(loads(p) if isinstance(p, str) else None)]
            yield pd.DataFrame(rows, columns=[id_col, *(c.split()[0] for c in SCHEMA.split(", "))])

    return payloads.select(id_col, payload).mapInPandas(run, f"{id_col} string, {SCHEMA}")


def targets(found, kind: str):
    """What the activities of a kind were aimed at."""
    return found.filter(found["kind"] == kind).filter("target IS NOT NULL").select("target")
