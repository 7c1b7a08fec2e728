"""Tokens, Han runs, evidence of a match, token estimates: columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.binding import bind

#: Characters that are indexed one by one and in pairs.
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
INDEX_CHARS = 16_000
MAX_TERMS = 8


def _h(pattern: str) -> str:
    return pattern.replace("HAN", HAN)


def has_han(text: Column) -> Column:
    return text.rlike(_h("[HAN]"))


def bounded_index_text(text: Column) -> Column:
    """What search sees of a text; the catalog keeps all of it."""
    return F.substring(text, 1, INDEX_CHARS)


def _han_pieces(run: Column, singles: bool) -> Column:
    return bind(F.regexp_extract_all(run, F.lit("(?s)."), F.lit(0)), lambda chars: _pieces(chars, singles))


def _pieces(chars: Column, singles: bool) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - 2, F.lit(0))), lambda k: F.concat(F.get(chars, k), F.get(chars, k + 1)))
    pairs = F.when(F.size(chars) > 1, pairs).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(chars, pairs) if singles else pairs, " ")


def _spread(text: Column, singles: bool) -> Column:
    def one(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(_h("[HAN]+|[^HAN]+")), F.lit(0))
        spread = F.transform(runs, lambda r: F.when(r.rlike(_h("^[HAN]")), _han_pieces(r, singles)).otherwise(F.trim(r)))
        return F.when(has_han(t), F.array_join(F.filter(spread, lambda s: s != ""), " ")).otherwise(t)

    return bind(text, one)


def index_text(text: Column) -> Column:
    """Text with each run of Han characters as its characters and then its pairs; other text is left as it is."""
    return _spread(text, True)


def bigram_text(text: Column) -> Column:
    """The same with pairs alone: a single Han character gives nothing."""
    return _spread(text, False)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def literal_terms(query: Column) -> Column:
    """The words of a query that evidence is looked up for: with a letter or digit, each once, at most 8."""
    words = F.split(F.trim(bigram_text(query)), r"\s+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}]"))), 1, MAX_TERMS)


def why_matched(terms: Column, *haystacks: Column) -> Column:
    """The terms that the first haystack with any of them contains, whatever their case."""

    def found(text: Column) -> Column:
        return bind(F.lower(bigram_text(F.coalesce(text, F.lit("")))), lambda low: F.filter(terms, lambda t: F.contains(low, F.lower(t))))

    out = F.array().cast("array<string>")
    for text in reversed(haystacks):
        out = bind(found(text), lambda hits, other=out: F.when(F.size(hits) > 0, hits).otherwise(other))
    return out


def estimate_tokens(text: Column) -> Column:
    """A Han character is a token, four bytes of anything else are one, rounded up."""
    count = lambda other: (F.length(text) - F.length(other) + F.ceil(F.octet_length(other) / 4)).cast("long")
    return bind(F.regexp_replace(text, _h("[HAN]"), ""), count)


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def json_string_bytes(text: Column) -> Column:
    """Bytes of the text as a JSON string, quotes included."""
    two = F.length(text) - F.length(F.regexp_replace(text, r'["\\\x08\x0C\n\r\t]', ""))
    six = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x07\x0B\x0E-\x1F]", ""))
    return (F.octet_length(text) + two + 5 * six + 2).cast("long")


def shell_quote(text: Column) -> Column:
    """Bare if it needs no quotes, else in single quotes."""
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(text.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), text).otherwise(quoted)


def suggested_commands(message_id: Column, session_id: Column) -> Column:
    """At most two commands that open a hit and its session."""
    show = F.concat(F.lit("show "), shell_quote(message_id))
    context = F.when(session_id.isNotNull(), F.concat(F.lit("context "), shell_quote(session_id)))
    return F.filter(F.array(show, context), lambda c: c.isNotNull())
