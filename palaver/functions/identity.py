"""Stable identities: a prefix that tells the kind, and a native suffix or a digest of framed facts.

Digests are SHA-256 cut to 32 hexadecimal digits.  A fact is framed by its length, so
that ("ab", "c") and ("a", "bc") differ.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the identity kinds.
PREFIXES = {"source": "src_v1_", "document": "doc_v1_", "session": "ses_v1_", "message": "msg_v1_", "placement": "plc_v1_"}
MAX_NATIVE_CHARS = 256


def derive(kind: str, *facts: Column) -> Column:
    """The identity of a kind from facts; null if a fact is null."""
    prefix = PREFIXES[kind]
    framed = [F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in facts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(prefix), *framed), 256), 1, 32))


def derive_value(kind: str, *facts: object) -> str:
    """``derive`` for one row in Python."""
    prefix = PREFIXES[kind]
    framed = "".join(f"{len(str(f).encode())}:{f}" for f in facts)
    return prefix + hashlib.sha256((prefix + framed).encode()).hexdigest()[:32]


def native(kind: str, raw: Column) -> Column:
    """A provider's own id as the suffix, if it may be one: not empty, not too long, without white space and control characters."""
    fine = raw.isNotNull() & (F.length(raw) > 0) & (F.length(raw) <= MAX_NATIVE_CHARS) & ~raw.rlike(r"[\s\p{Cntrl}]")
    return F.when(fine, F.concat(F.lit(PREFIXES[kind]), raw))


def kind_of(wire: Column) -> Column:
    """The kind that an identity's prefix tells, else null."""
    out = F.lit(None).cast("string")
    for kind, prefix in PREFIXES.items():
        out = F.when(wire.startswith(prefix) & (F.length(wire) > len(prefix)), F.lit(kind)).otherwise(out)
    return out


def session_id(provider: Column, namespace: Column, native_id: Column, document_id: Column) -> Column:
    """From the provider's session id within its installation, else from the document."""
    known = native_id.isNotNull() & (F.trim(native_id) != "")
    return F.when(known, derive("session", provider, namespace, native_id)).otherwise(derive("session", document_id))


def placement_id(session: Column, document: Column, message: Column, ordinal: Column) -> Column:
    return derive("placement", session, document, message, ordinal)
