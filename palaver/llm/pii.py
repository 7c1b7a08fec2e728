"""Personal data: exact patterns, and a conditional random field that adds what they don't cover.

The field labels words by their shapes and by the shapes of the words around them, and
is trained here on the small labelled table of ``personal_data``.  It scores every word of
every text.  Where a word's scores make it certain that it is outside of any span, whatever
its neighbours are, the chain falls apart, and decoding the parts by themselves is decoding
the whole text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crf import Crf, train
from .memory import settle, shrink
from .personal_data import FIRST_NAMES, KINDS, LONG, STREET_TYPES, luhn
from .personal_data import table as labelled_table
from .tables import bound_batches, table

STATES = ("O", *(f"{p}-{k}" for k in KINDS for p in ("B", "I") if p == "B" or k in LONG))
#: Code points of a text whose words are scored at once.
PIECE = 1 << 18
#: Words of chains that are held to be decoded, and cells of chain times longest that are decoded at once.
HELD_WORDS, BATCH_CELLS = 1 << 16, 1 << 13
#: Rows whose spans a worker holds at once, and words that it remembers the scores of.
SLICE_ROWS, REMEMBERED = 256, 1 << 16

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

_ODD = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern: for each at sign, the run of local characters before it and the domain behind it, in one pass."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_SET:
            start -= 1
        floor = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", floor)


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[Span]:
    if not _ODD.search(text):
        return []
    out: list[Span] = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_part_ok, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


_SPACE = re.compile(r"[\x20\x09-\x0D]")
_OPENS, _CLOSES = re.compile(r"[\w+(@]"), re.compile(r"[\w)]")
_LETTERS = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d]+")


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Words that tell what stands beside them.
_TELLING = {
    "title": _words("mr mrs ms dr prof sir madam herr frau monsieur madame senor"),
    "name": _words("name contact signed regards sincerely patient met"),
    "dear": _words("dear is am by from to"),
    "first name": frozenset(FIRST_NAMES),
    "street": _words(" ".join(STREET_TYPES)) | _words("strasse straße rue calle allee"),
    "place": _words("address lives live ship deliver send apt suite floor at"),
    "secret": _words("token key secret password apikey api_key passwd passphrase pwd"),
    "phone": _words("tel phone call mobile fax"),
    "card": _words("card visa pay paid credit"),
    "dot": _words("dot"),
    "domain": _words("com org net de uk io edu"),
    "bank": _words("iban account konto transfer"),
    "id": _words("ssn social security id passport"),
}
_SHAPES = (
    re.compile(r"[^@]+@[^@]+\.[^@.]+"), re.compile(r"[0-9]+(\.[0-9]+){3}"), re.compile(r"[0-9A-Fa-f]{32,}"), re.compile(r"\([0-9]+\)"), re.compile(r"[0-9]+-[0-9-]+"),
    re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), re.compile(r"[A-Z]{2}[0-9]{2}[0-9A-Z]{0,30}"), re.compile(r"[0-9A-Z]{1,4}"), re.compile(r"[^\W\d_a-zß-ÿ][a-zß-ÿ'’-]+"), re.compile(r"[^\W\d_a-zß-ÿ]{2,}"), re.compile(r"[A-Z]"), re.compile(r"[^\W\d_A-ZÀ-Þ]+"), re.compile(r"[0-9]{1,5}"),
)
_OWN = 26 + len(_SHAPES) + len(_TELLING)
#: Shapes of a word, of the two before it and of the two behind it, and of how far a name for its kind is.
_FEATURES = 5 * _OWN


def _core(token: str) -> tuple[int, int]:
    """The ends of a word, or of words, without the marks around."""
    found = _OPENS.search(token)
    start = found.start() if found else len(token)
    stop = len(token)
    while stop > start and not _CLOSES.match(token, stop - 1):
        stop -= 1
    return start, stop


def _shape(token: str) -> tuple[int, ...]:
    """The features of a word by itself."""
    start, stop = _core(token)
    core = token[start:stop]
    digits = "".join(c for c in core if "0" <= c <= "9")
    letters = len(_LETTERS.findall(core))
    n, size = len(digits), len(core)
    low = _NOT_LETTERS.sub("", core.lower())
    tail = token[stop:] if core else token
    f = [
        True, "@" in core, n <= 2 and n > 0, 3 <= n <= 4, 5 <= n <= 8, 9 <= n <= 11, 12 <= n <= 19, n > 19, letters > 0,
        size >= 24 and letters > 0 and n > 2 and re.fullmatch(r"[0-9A-Za-z_-]+", core) is not None, core.startswith("+"), 12 <= n <= 19 and not letters and luhn(digits), n == 4 and size == 4,
        token[:1] in "\"'", any(c in ".!?" for c in tail), any(c in ",;" for c in tail), any(c in ":=" for c in tail), any(c in "#%$&*!" for c in tail[1:] or tail.strip(".,;:!?)\"'")),
        size >= 8, letters > 0 and n > 0, letters > 0 and _NOT_LETTERS.sub("", core) != core and not n, size == 1, not size, all(map(_part_ok, core.split("."))) if core.count(".") == 3 and n + 3 == size else False, size >= 14, n > 0 and letters == 0,
    ]
    f += [s.fullmatch(core) is not None for s in _SHAPES]
    f += [low in words for words in _TELLING.values()]
    return tuple(k for k, x in enumerate(f) if x)


_PLAIN = re.compile(r"([a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)[.,;:!?]?")
_TELLS = frozenset().union(*_TELLING.values())


def _like(word: str) -> str:
    """A word of the same shape, one for the many plain words whose lengths the features don't tell apart."""
    if len(word) < 32 and (m := _PLAIN.fullmatch(word)) and (low := m[1].lower()) not in _TELLS:
        size = len(low)
        return ("x" if m[1] == low else "X") + "x" * ((13 if size >= 14 else 7 if size >= 8 else 1) if size > 1 else 0) + word[size:]
    return word


def _features(words: list[str]) -> list[tuple[int, np.ndarray]]:
    """(0, features) of all words of a text; nothing for none."""
    if not words:
        return []
    f = np.zeros((len(words), _FEATURES), np.float32)
    for k, word in enumerate(words):
        shape = _shape(word)
        for block, row in enumerate((k, k + 1, k + 2, k - 1, k - 2)):
            if 0 <= row < len(words):
                f[row, [block * _OWN + x for x in shape]] = 1
    return [(0, f)]


def _cuts(text: str) -> Iterator[int]:
    """Places between words that cut a text into pieces, its end the last."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + PIECE)
        at = m.start() if m else len(text)
        yield at


class Field:
    """Scores of words by a trained field: what words of a shape add to their own states and to those of their neighbours is made once, and the shapes of words are remembered."""

    def __init__(self, crf: Crf) -> None:
        self.crf = crf
        self._weights = crf.weights.reshape(5, _OWN, -1).astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self._rows: dict[str, int] = {}
        self._shapes: dict[tuple[int, ...], int] = {}
        self._told = np.zeros((1024, *self._weights[:, 0].shape), np.float32)  # by the number of a shape; 0: no word

    def _row(self, word: str) -> int:
        """The number of a word's shape."""
        row = self._rows.get(word)
        if row is not None:
            return row
        like = _like(word)
        row = self._rows.get(like)
        if row is None:
            shape = _shape(like)
            row = self._shapes.get(shape)
            if row is None:
                row = self._shapes[shape] = len(self._shapes) + 1
                if row == len(self._told):
                    self._told = np.concatenate([self._told, np.zeros_like(self._told)])
                self._told[row] = self._weights[:, list(shape)].sum(1)
            if len(like) <= 64:
                self._rows[like] = row
        if len(word) <= 64:
            self._rows[word] = row
        return row

    def _told_by(self, words: list[str]) -> np.ndarray:
        """What each word adds [word, place, state]."""
        if len(self._shapes) > REMEMBERED:
            self._forget()
        shrink(self._rows, REMEMBERED, REMEMBERED // 2)
        rows = list(map(self._rows.get, words))
        if None in rows:
            rows = [self._row(w) if r is None else r for w, r in zip(words, rows, strict=True)]
        return self._told.take(np.array(rows, np.intp), 0)

    def scores(self, text: str) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, scores [word, state]) of the pieces of a text: every word is scored, with those beside it, also of the next piece."""
        nothing = self._told[[0, 0]]
        before, held = nothing, None
        words, begin, at = [], 0, 0
        for end in _cuts(text):
            words += _WORD.findall(text, at, end)
            at = end
            if len(words) < 2 and end < len(text):
                continue
            told = self._told_by(words)
            if held:
                yield *held[:2], self._sum(before, held[2], np.concatenate([told[:2], nothing])[:2])
                before = held[2][-2:]
            held = begin, end, told
            words, begin = [], end
        if held:
            yield *held[:2], self._sum(before, held[2], nothing)

    @staticmethod
    def _sum(before: np.ndarray, told: np.ndarray, behind: np.ndarray) -> np.ndarray:
        x = np.concatenate([before, told, behind])
        return x[2:-2, 0] + x[1:-3, 1] + x[:-4, 2] + x[3:-1, 3] + x[4:, 4]

    def runs(self, words: list[str]) -> list[tuple[int, np.ndarray]]:
        """(0, scores [word, state]) of all words of a text; nothing for none."""
        parts = [x for _, _, x in self.scores(" ".join(words))]
        return [(0, np.concatenate(parts))] if parts else []


def _labelled(text: str, spans: list[tuple[int, str, int]]) -> tuple[list[str], list[int]]:
    """The words of a sentence and their states."""
    words = list(_WORD.finditer(text))
    states = []
    for m in words:
        start, end = (m.start() + x for x in _core(m[0]))
        own = next((s for s in spans if s[0] < max(end, start + 1) and start < s[2]), None)
        states.append("O" if own is None or start == end else f"{'B' if start <= own[0] < end or own[1] not in LONG else 'I'}-{own[1]}")
    return [m[0] for m in words], [STATES.index(x) for x in states]


@lru_cache(1)
def model() -> Field:
    runs = []
    for text, spans in labelled_table():
        words, states = _labelled(text, spans)
        runs += [(f, states[k : k + len(f)]) for k, f in _features(words)]
    lengths = np.array([len(f) for f, _ in runs])
    features = np.zeros((len(runs), lengths.max(), _FEATURES))
    states = np.zeros((len(runs), lengths.max()), int)
    for row, (f, s) in enumerate(runs):
        features[row, : len(f)], states[row, : len(f)] = f, s
    return Field(train(features, lengths, states, len(STATES), steps=120))


_AT = re.compile(r"@|\bat\b.*(\bdot\b|\.)", re.I | re.S)


def _valid(kind: str, span: str) -> bool:
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        return 15 <= sum(c.isalnum() for c in span) <= 34
    if kind == "name":
        return len(set(span.split())) >= 2
    if kind == "email":
        return _AT.search(span) is not None
    if kind == "address":
        return digits != ""
    return len(span) >= 6 if kind == "secret" else True


class _Words:
    """Places of the words of a text by their number."""

    def __init__(self, text: str) -> None:
        self._text = text
        self._firsts: list[int] = []  # numbers of the first words of the pieces
        self._pieces: list[tuple[int, int]] = []
        self._found: tuple[int, list[tuple[int, int]]] = -1, []
        self.count = 0

    def add(self, start: int, end: int, count: int) -> None:
        self._firsts.append(self.count)
        self._pieces.append((start, end))
        self.count += count

    def place(self, number: int) -> tuple[int, int]:
        piece = bisect_right(self._firsts, number) - 1
        if self._found[0] != piece:
            self._found = piece, [m.span() for m in _WORD.finditer(self._text, *self._pieces[piece])]
        return self._found[1][number - self._firsts[piece]]


def _chains(text: str, words: _Words, field: Field) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first word, scores) of the chains that a text falls apart into; every word that is in none is outside of spans on every best path.

    The scores of a text of several pieces are made twice rather than held.
    """
    found = list(field.scores(text)) if len(text) <= PIECE else None
    gains = []
    for start, end, scores in found or field.scores(text):
        words.add(start, end, len(scores))
        gains.append(field.crf.gains(scores))
    if not words.count:
        return
    edges = np.flatnonzero(np.diff(field.crf.open(np.concatenate(gains)), prepend=False, append=False)).tolist()
    first, at, held = 0, 0, []
    for _, _, scores in found or field.scores(text):
        stop = first + len(scores)
        while at < len(edges) and edges[at] < stop:
            begin, end = edges[at : at + 2]
            held.append(scores[max(0, begin - first) : end - first])
            if end > stop:
                break
            yield begin, np.concatenate(held) if len(held) > 1 else held[0]
            held, at = [], at + 2
        first = stop


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans that the field finds in each of the texts: a best path over all of their words."""
    out: list[list[Span]] = [[] for _ in texts]
    words = [_Words(t) for t in texts]

    def decode(chains: list[tuple[int, int, np.ndarray]]) -> None:
        chains.sort(key=lambda c: len(c[2]))
        at = 0
        while at < len(chains):
            end = at + 1
            while end < len(chains) and len(chains[end][2]) * (end + 1 - at) <= BATCH_CELLS:
                end += 1
            part, at = chains[at:end], end
            lengths = np.array([len(c[2]) for c in part])
            scores = np.zeros((len(part), lengths.max(), len(STATES)), np.float32)
            for row, c in enumerate(part):
                scores[row, : len(c[2])] = c[2]
            states = field.crf.decode(scores, lengths)
            for row in np.flatnonzero(states.any(1)).tolist():
                k, first, _ = part[row]
                out[k] += _read(texts[k], words[k], first, states[row, : lengths[row]].tolist())

    chains, size = [], 0
    for k, text in enumerate(texts):
        for first, scores in _chains(text, words[k], field):
            chains.append((k, first, scores))
            size += len(scores)
            if size >= HELD_WORDS:
                decode(chains)
                chains, size = [], 0
    decode(chains)
    return out


def _read(text: str, words: _Words, first: int, states: list[int]) -> Iterator[Span]:
    """The spans that the states of a chain tell."""
    t = 0
    while t < len(states):
        name = STATES[states[t]]
        if name == "O":
            t += 1
            continue
        kind, stop = name[2:], t + 1
        while stop < len(states) and STATES[states[stop]] == f"I-{kind}":
            stop += 1
        start, close = words.place(first + t)[0], words.place(first + stop - 1)[1]
        start, close = (start + x for x in _core(text[start:close]))
        if start < close and _valid(kind, text[start:close]):
            yield start, KINDS.index(kind), close
        t = stop


def find_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, all spans) of each text: what the field adds overlaps no span of a pattern."""
    out = []
    for text, added in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(text)
        spans, floor, at, taken = list(base), 0, 0, 0
        for s, kind, e in sorted(added):
            if s < floor:
                continue
            while at < len(base) and base[at][0] < e:  # those that begin before its end, and how far they reach
                taken = max(taken, base[at][2])
                at += 1
            if taken <= s:
                spans.append((s, kind, e))
                floor = e
        out.append((base, sorted(spans)))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of few enough rows that their words fit beside them in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of (doc_id, text): counts and digest of the pattern spans, and all spans.

    Null texts count as empty and have no spans; whole texts are searched, however long;
    repeated rows give repeated results; an empty table gives no rows; other columns are
    not read.
    """
    bound_batches(docs.sparkSession)
    field = model()  # trained on the driver; some thousand numbers go to the executors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = find_spans([t.as_py() or "" for t in batch.column(1)], field)
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(4)]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([written(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *counts, digests, spans], [c.split()[0] for c in _FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


def redact_column(docs: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns with personal data in ``column`` replaced; nulls stay null."""
    bound_batches(docs.sparkSession)
    field, place = model(), docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(place).to_pylist()
            found = find_spans([t or "" for t in texts], field)
            clean = pa.array([None if t is None else redact(t, every) for t, (_, every) in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([clean if k == place else c for k, c in enumerate(batch.columns)], batch.schema.names)
        settle()

    return docs.mapInArrow(run, docs.schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``redact_column`` over the texts of documents; ``n_chars``, where there is one, is restated for texts that changed or not."""
    clean = redact_column(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean


def op8_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
