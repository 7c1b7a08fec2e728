"""Page cursors: claims about the first page, signed by a digest, checked in a fixed order."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import asdict, dataclass

TTL_MS = 15 * 60 * 1000
MAJOR = 1
_DOMAIN = b"palaver-cursor-v1"


@dataclass(frozen=True)
class Claims:
    major: int
    generation: int
    query_digest: str
    sort: str
    offset: int
    result_set: str
    issued_at_ms: int
    expires_at_ms: int


class CursorError(ValueError):
    """``args[0]`` names the first check that failed."""


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def query_digest(**inputs: object) -> str:
    """Of everything that decides which results there are and how they are ordered."""
    return digest(json.dumps(inputs, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _sign(body: bytes) -> str:
    return hashlib.sha256(_DOMAIN + body).hexdigest()[:16]


def issue(claims: Claims) -> str:
    body = base64.urlsafe_b64encode(json.dumps(asdict(claims), sort_keys=True, separators=(",", ":")).encode()).rstrip(b"=")
    return f"{body.decode()}.{_sign(body)}"


def verify(token: str, *, now_ms: int, generation: int, query: str, sort: str, result_set: str) -> Claims:
    body, dot, signature = token.partition(".")
    if not dot or not body or "." in signature:
        raise CursorError("structure")
    if _sign(body.encode()) != signature:
        raise CursorError("digest")
    try:
        claims = Claims(**json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))))
    except (ValueError, TypeError):
        raise CursorError("json") from None
    for name, fine in (
        ("major", claims.major == MAJOR),
        ("expired", now_ms < claims.expires_at_ms),
        ("generation", claims.generation == generation),
        ("query", claims.query_digest == query),
        ("sort", claims.sort == sort),
        ("result_set", claims.result_set == result_set),
    ):
        if not fine:
            raise CursorError(name)
    return claims
