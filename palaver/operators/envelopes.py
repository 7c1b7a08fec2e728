"""Frames that carry results to other programs: versioned JSON, redacted, a line each; and plain lines for people."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.redact import redact, redact_tree, redact_value

SCHEMA_VERSION = "v1"


def lines(df: DataFrame, command: str) -> DataFrame:
    """A frame a row (value), with every top-level string redacted: for results that are written and not collected."""
    told = [redact(F.col(n)).alias(n) if t == "string" and not n.endswith("_id") else F.col(n) for n, t in df.dtypes]
    frame = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("item").alias("frame_type"), F.lit(command).alias("command"), F.struct(*told).alias("data"))
    return df.select(F.to_json(frame).alias("value"))


def response(command: str, data: object, *, retrieval_mode: str = "none", next_cursor: str | None = None, has_more: bool = False, warnings: tuple[str, ...] = (), duration_ms: int = 0, generation: int | None = None, request_id: str | None = None, partial: bool = False) -> str:
    """One frame of a request's whole answer, a page at most."""
    clean, n = redact_tree(data)
    return json.dumps(
        {
            "schema_version": SCHEMA_VERSION, "frame_type": "response", "command": command, "request_id": request_id, "ok": True, "outcome": "partial" if partial else "success", "data": clean, "retrieval_mode": retrieval_mode,
            "redaction": {"mode": "default", "status": "applied" if n else "none", "redacted_count": n}, "warnings": list(warnings), "page": {"next_cursor": next_cursor, "has_more": has_more}, "meta": {"duration_ms": duration_ms, "generation": generation},
        },
        ensure_ascii=False,
    )


def failure(command: str, code: str, message: str, details: object = None, request_id: str | None = None) -> str:
    clean, _ = redact_tree(details)
    return json.dumps({"schema_version": SCHEMA_VERSION, "frame_type": "error", "command": command, "request_id": request_id, "ok": False, "error": {"code": code, "message": redact_value(message), "details": clean}}, ensure_ascii=False)


def width(text: str) -> int:
    """Columns on a terminal: wide characters take two, marks none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def cut(text: str, columns: int) -> str:
    if width(text) <= columns:
        return text
    out, used = "", 1
    for c in text:
        used += width(c)
        if used > columns:
            break
        out += c
    return out + "…"


def shown(rows: list[dict], columns: list[str], widths: list[int]) -> str:
    """A page as a plain table."""
    text = lambda v: "" if v is None else " ".join(str(v).split())
    out = []
    for row in [dict(zip(columns, columns, strict=True)), *rows]:
        cells = [cut(text(row[c]), w) for c, w in zip(columns, widths, strict=True)]
        out.append("  ".join(c + " " * (w - width(c)) for c, w in zip(cells, widths, strict=True)).rstrip())
    return "\n".join(out)

