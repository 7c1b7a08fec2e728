"""Excerpts around the earliest hit of a query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.binding import bind


def _lowered(text: str) -> tuple[str, list[int]]:
    """Lower-case text, and of each of its characters the place in the original: lower-casing can make one character two."""
    out, places = [], []
    for k, c in enumerate(text):
        low = c.lower()
        out.append(low)
        places += [k] * len(low)
    return "".join(out), places


def excerpt(text: str | None, terms: list[str] | None, max_chars: int) -> str | None:
    """At most ``max_chars`` around the earliest hit, two characters to the right for each to the left; the start of the text without a hit."""
    if text is None:
        return None
    low, places = _lowered(text)
    hits = [(low.find(t.lower()), k) for k, t in enumerate(terms or ()) if t]
    hits = [h for h in hits if h[0] >= 0]
    if not hits:
        return text[:max_chars]
    at, which = min(hits)
    start = places[at]
    end = places[at + len(terms[which].lower()) - 1] + 1
    if end - start >= max_chars:
        return text[start : start + max_chars]
    room = max_chars - (end - start)
    right = min(len(text) - end, room - room // 3)
    left = min(start, room - right)
    right = min(len(text) - end, room - left)
    return text[start - left : end + right]


def snippet(text: Column, terms: Column, max_chars: int) -> Column:
    """``excerpt`` on columns: in the JVM, but for texts and terms whose length changes in lower case, which alone go to Python."""

    @F.pandas_udf("string")
    def changed(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([excerpt(t, None if x is None else list(x), max_chars) for t, x in zip(texts, lists, strict=True)], dtype="object")

    def around(hit: Column) -> Column:
        end = hit["start"] + hit["size"]
        room = F.lit(max_chars) - hit["size"]
        rest = F.length(text) - end
        right = F.least(rest, room - F.floor(room / 3))
        left = F.least(hit["start"], room - right)
        right = F.least(rest, room - left)
        near = F.substring(text, (hit["start"] - left + 1).cast("int"), (left + hit["size"] + right).cast("int"))
        cut = F.substring(text, (hit["start"] + 1).cast("int"), F.lit(max_chars))
        return F.when(hit.isNull(), F.substring(text, 1, max_chars)).when(hit["size"] >= max_chars, cut).otherwise(near)

    def located(low: Column) -> Column:
        spots = F.transform(terms, lambda t, k: F.struct((F.position(F.lower(t), low) - 1).alias("start"), k.alias("k"), F.length(t).alias("size")))
        return bind(F.array_min(F.filter(spots, lambda s: (s["start"] >= 0) & (s["size"] > 0))), around)

    same = bind(F.lower(text), lambda low: F.length(low) == F.length(text)) & F.coalesce(F.forall(terms, lambda t: F.length(F.lower(t)) == F.length(t)), F.lit(True))
    return F.when(same, bind(F.lower(text), located)).otherwise(changed(F.when(~same, text), terms))
