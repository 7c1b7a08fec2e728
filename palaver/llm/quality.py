"""Quality rules under weak supervision.

Each rule looks at one measure of a text and votes for good, for bad, or abstains.
Expectation-maximisation over the counts of vote patterns estimates how often each
rule is right about good and about bad documents; a document's posterior probability
of being good then decides, in place of a demand that it pass every rule.

The texts are read once.  There are at most 3^(number of rules) vote patterns, so
the table of counts that the driver fits, and the table of posteriors that is
broadcast, have a fixed bound at any number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import settle
from .tables import bound_batches, stash, table
from .words import IS_SPACE, SPACES, blocks, table_of, windows, word_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5
MAX_FALSE_ALARMS = 0.03

_SYMBOLS = table_of(b"#*$%&|<>")
_UPPER = table_of(bytes(range(65, 91)))
_LETTER = table_of(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
_DIGIT = table_of(bytes(range(48, 58)))
_STOP = table_of(b".!?")
_SHOUT = table_of(b"!")
_MARK = table_of(bytes(b for b in range(33, 127) if not chr(b).isalnum()))

#: (name, measure, good range or None, bad below, bad above): a vote is good inside the range, bad beyond the outer bounds, else withheld.
#: Each kind of bad text has two rules at least, so that their agreement shows; rules for one kind say nothing of texts that are not of it.
RULES: tuple[tuple[str, str, tuple[float, float] | None, float, float], ...] = (
    ("length", "n_words", (100, float("inf")), MIN_WORDS, float("inf")),
    ("sentences", "stop_share", (0.02, 0.35), 0.005, 0.6),
    ("word length", "mean_word", (3, 9), 2.2, 12),
    ("symbols", "symbols_a_word", None, -1, 0.1),
    ("marks after words", "mark_share", None, -1, 0.5),
    ("capitals", "upper_share", None, -1, 0.4),
    ("exclamations", "shout_share", None, -1, 0.3),
    ("repeated lines", "dup_line_share", None, -1, 0.3),
    ("repeated words", "repeat_share", None, -1, 0.3),
    ("digits", "digit_share", None, -1, 0.25),
)


def measure(text: str | None) -> dict[str, float]:
    """The base counts of a whole text and the measures that the rules look at."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n_spaces = n_points = n_ascii = n_symbols = n_upper = n_letters = n_digits = n_stops = n_shouts = n_marked = 0
    for part in blocks(data):
        a = np.frombuffer(part, np.uint8)
        n_spaces += int(IS_SPACE[a].sum())
        n_points += int(((a & 0xC0) != 0x80).sum())
        n_ascii += int((a < 0x80).sum())
        n_symbols += int(_SYMBOLS[a].sum())
        n_upper += int(_UPPER[a].sum())
        n_letters += int(_LETTER[a].sum())
        n_digits += int(_DIGIT[a].sum())
        n_stops += int(_STOP[a].sum())
        n_shouts += int(_SHOUT[a].sum())
        n_marked += int((_MARK[a[:-1]] & IS_SPACE[a[1:]]).sum()) + int(len(a) > 0 and _MARK[a[-1]])
    words = word_hashes(data)
    n_words = len(words)
    seen: set[bytes] = set()
    n_lines = n_dup_lines = 0
    for line in data.split(b"\n"):
        if line.strip(SPACES):
            n_lines += 1
            if line in seen:
                n_dup_lines += 1
            else:
                seen.add(line)
    n_repeat = 0
    triples = windows(words, 3)
    if len(triples):
        _, inverse, counts = np.unique(triples, return_inverse=True, return_counts=True)
        again = np.zeros(n_words, bool)
        twice = counts[inverse] > 1
        for k in range(3):
            again[k : k + len(twice)] |= twice
        n_repeat = int(again.sum())
    word_chars = n_points - n_spaces
    per_word = max(1, n_words)
    # Text that is mostly not ASCII ends its sentences and words by marks of its own: those rules say nothing of it.
    ascii_share = 1.0 if not word_chars else (word_chars - (n_points - n_ascii)) / word_chars
    known = 1.0 if ascii_share >= 0.5 else float("nan")
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "symbols_a_word": n_symbols / per_word,
        "upper_share": n_upper / max(1, n_letters),
        "dup_line_share": n_dup_lines / max(1, n_lines),
        "repeat_share": n_repeat / per_word,
        "mark_share": n_marked / per_word,
        "shout_share": n_shouts / per_word,
        "mean_word": known * word_chars / per_word,
        "stop_share": known * n_stops / per_word,
        "digit_share": n_digits / max(1, word_chars),
    }


def votes(measures: dict[str, float]) -> int:
    """The votes of all rules as one number to base 3: 0 abstains, as every rule does on a measure that is not a number, 1 is bad, 2 is good."""
    code = 0
    for _, name, good, bad_below, bad_above in RULES:
        x = measures[name]
        vote = 1 if x < bad_below or x > bad_above else 2 if good and good[0] <= x <= good[1] else 0
        code = code * 3 + vote
    return code


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _BASE) + ", votes int"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t.as_py()) for t in batch.column(1)]
        columns = [batch.column(0).cast(pa.int64()), *(pa.array([r[c] for r in rows], pa.int64()) for c in _BASE), pa.array([votes(r) for r in rows], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_BASE, "votes"])
    settle()


def fit(patterns: np.ndarray, counts: np.ndarray, steps: int = 500, tolerance: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns: (share of good, rates [class, rule, vote], posterior of being good by pattern).

    ``rates`` are the shares of abstentions, bad votes and good votes that a rule
    gives to bad (0) and to good (1) documents; its accuracies follow from them.
    Rules are taken as independent within a class.  One constraint gives the classes
    their meaning: no rule votes bad on more than ``MAX_FALSE_ALARMS`` of good
    documents.  The first guess is that bad votes are right 9 times in 10.
    """
    rules = len(RULES)
    digits = (patterns[:, None] // 3 ** np.arange(rules - 1, -1, -1)) % 3
    cast = np.stack([digits == v for v in range(3)], 2).astype(float)  # pattern, rule, vote
    posterior = 1 - 0.9 * (digits == 1).any(1) - 0.05
    share, rates = 0.5, np.full((2, rules, 3), 1 / 3)
    for _ in range(steps):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        before = rates.copy()
        rates = (np.einsum("cp,prv->crv", weight, cast) + 1) / (weight.sum(1)[:, None, None] + 3)
        alarms = np.minimum(rates[1, :, 1], MAX_FALSE_ALARMS)
        rates[1, :, [0, 2]] *= (1 - alarms) / (1 - rates[1, :, 1])
        rates[1, :, 1] = alarms
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        odds = np.log(share / (1 - share)) + np.einsum("prv,rv->p", cast, np.log(rates[1]) - np.log(rates[0]))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        if np.abs(before - rates).max() < tolerance:
            break
    return share, rates, posterior


def _posteriors(measured: DataFrame) -> dict[int, float]:
    """The posterior of every vote pattern in a table with a column ``votes``, fitted over all of its rows."""
    seen = measured.groupBy("votes").count().orderBy("votes").collect()  # at most 3^10 rows
    _, _, posterior = fit(np.array([r["votes"] for r in seen], np.int64), np.array([r["count"] for r in seen], float))
    return {r["votes"]: float(p) for r, p in zip(seen, posterior, strict=True)}


def _base_failed(n_words, n_repeat_words):
    """On numbers or columns alike."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def judge_documents(docs: DataFrame) -> DataFrame:
    """Base counts, verdict and posterior of each row of ``docs`` (doc_id, text), in any order.

    A null or empty text has no words and fails the base rule; a repeated row is
    judged, and counted in the fit, as often as it occurs; an empty table gives no
    rows; columns other than these two are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    measured, _ = stash(docs.select("doc_id", "text").mapInArrow(_measured, _SCHEMA), "measures")
    known = spark.createDataFrame(list(_posteriors(measured).items()), "votes int, posterior double")
    joined = measured.join(F.broadcast(known), "votes").withColumn("base_failed", _base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return joined.select("doc_id", *_BASE, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= KEEP_AT)).alias("kept"), "posterior")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge_documents`` keeps, with all their columns, whatever their names.

    Null and empty texts go, as they have no words; of repeated rows all stay or none;
    whole texts are measured, however long; an empty table stays empty.
    The texts are measured twice, for the fit and for the verdict, which moves no text
    between tasks.
    """
    bound_batches(docs.sparkSession)
    measured, _ = stash(docs.select("doc_id", "text").mapInArrow(_measured, _SCHEMA).select("votes"), "votes")
    posterior, place = _posteriors(measured), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(place):
                m = measure(text.as_py())
                keep.append(bool(not _base_failed(m["n_words"], m["n_repeat_words"]) and posterior[votes(m)] >= KEEP_AT))
            yield batch.filter(pa.array(keep, pa.bool_()))
        settle()

    return docs.mapInArrow(run, docs.schema)


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))
