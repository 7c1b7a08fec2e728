"""Tool calls: their kind by the tool's name, and what they were aimed at."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of tools by kind; names are compared with case, others are of unknown kind.
COMMAND_TOOLS = ("Bash", "PowerShell", "shell", "shell_command", "exec", "exec_command")
FILE_TOOLS = ("Read", "Write", "Edit", "MultiEdit", "NotebookEdit", "ApplyPatch", "apply_patch", "view_image")
QUERY_TOOLS = ("Glob", "Grep", "Task", "Agent", "spawn_agent")
WEB_TOOLS = ("WebFetch", "WebSearch", "web_fetch", "web_search")
# Keys of a call's input that may name its target, the first that does counts.
TARGET_KEYS = ("path", "file_path", "filePath", "target", "command", "cmd", "url", "query", "pattern", "glob", "glob_pattern", "regex", "description")
# Lines of a patch that name a file.
PATCH_HEAD = "*** Begin Patch"
PATCH_FILES = ("*** Update File: ", "*** Add File: ", "*** Delete File: ")

KINDS = {"command": COMMAND_TOOLS, "file": FILE_TOOLS, "query": QUERY_TOOLS, "web": WEB_TOOLS}


def kind_of_tool(name: str) -> str:
    return next((k for k, names in KINDS.items() if name in names), "unknown")


def tool_kind(name: Column) -> Column:
    out = F.lit("unknown")
    for kind, names in KINDS.items():
        out = F.when(name.isin(*names), F.lit(kind)).otherwise(out)
    return out


def target_of_input(value: object) -> str | None:
    """What an input that was read from JSON is aimed at: a string itself, or the file of a patch in it; of an object, the first target key with text."""
    if isinstance(value, str):
        text = value.strip()
        lines = text.splitlines()
        if lines and lines[0].strip() == PATCH_HEAD:
            for line in map(str.lstrip, lines[1:]):
                for head in PATCH_FILES:
                    if line.startswith(head) and (path := line[len(head) :].strip()):
                        return path
        return text or None
    if isinstance(value, dict):
        texts = (value.get(k) for k in TARGET_KEYS)
        return next((t.strip() for t in texts if isinstance(t, str) and t.strip()), None)
    return None


def activity(name: str, value: object) -> tuple[str, str | None]:
    """(kind, target); a tool of unknown kind has no target."""
    kind = kind_of_tool(name)
    return kind, None if kind == "unknown" else target_of_input(value)


def json_target(text: Column) -> Column:
    """``target_of_input`` over a column of JSON objects, without leaving the JVM; null for what is no object."""
    parsed = F.try_parse_json(text)
    named = [F.nullif(F.trim(F.try_variant_get(parsed, f"$.{k}", "string")), F.lit("")) for k in TARGET_KEYS]
    return F.coalesce(*named)


def loads(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None
