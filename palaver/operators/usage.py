"""Token usage: totals, and deltas out of cumulative counters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.schema import Store

BUCKETS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")
# Fixed value: a total that falls by less than this share is an old report told again.
STALE_PERCENT = 98


def totals(store: Store) -> DataFrame:
    """One row; 0 sessions means that nothing is known, not that nothing was used."""
    source = F.col("token_source")
    sums = [F.coalesce(F.sum(b), F.lit(0)).cast("long").alias(b) for b in BUCKETS]
    return store.usage_events.agg(F.countDistinct("session_id").alias("sessions"), *sums, F.count_if(source == "observed").alias("observed_events"), F.count_if(source == "derived").alias("derived_events"))


def repo_totals(store: Store) -> DataFrame:
    return store.sessions.filter("repo_slug IS NOT NULL").groupBy("repo_slug").agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.col("sessions").desc(), "repo_slug")


def fold_totals(reports: list[tuple], forked: bool) -> list[tuple[int, tuple[int, int, int, int]]]:
    """(place, delta) of the reports (place, total or None, last or None) of one source, in order.

    Totals are (input, output, cached, reasoning) since the session began.  The base
    moves only when a report is taken: a report that repeats it, or falls behind it by
    little, is passed over.  A provider's own delta is preferred to a difference.  The
    first report of a fork tells what it inherited and becomes the base.
    """
    out, base = [], None
    for place, total, last in reports:
        if forked:
            forked = False
            base = total or last or base
            continue
        if total is None:
            if last is not None:
                base = last if base is None else tuple(x + y for x, y in zip(base, last, strict=True))
                out.append((place, last))
            continue
        if base is None:
            out.append((place, last or total))
            base = total
            continue
        if total == base:
            continue
        fell = any(t < b for t, b in zip(total, base, strict=True))
        if last is None:
            if fell:
                continue
            out.append((place, tuple(t - b for t, b in zip(total, base, strict=True))))
        else:
            now, was, turn = sum(total), sum(base), sum(last)
            if fell and min(now, was, turn) > 0 and (now * 100 >= was * STALE_PERCENT or now + 2 * turn >= was):
                continue
            out.append((place, last))
        base = total
    return out


def observation(delta: tuple[int, int, int, int]) -> tuple[int, int, int, int, int]:
    """Buckets of the model: what was read from a cache is not counted as input again."""
    read, output, cached, reasoning = delta
    from_cache = max(0, min(cached, read))
    return max(0, read - from_cache), max(0, output), from_cache, 0, max(0, reasoning)


def cumulative_deltas(reports: DataFrame) -> DataFrame:
    """Usage events out of reports (source, place, forked, total, last), where total and last are arrays of four numbers or null.

    Sources are sorted within tasks and streamed; one that any report calls forked is a
    fork, which a window tells each of its reports.  A source's reports are held together.
    """
    marked = reports.withColumn("forked", F.max("forked").over(Window.partitionBy("source")))
    names = ["source", "place", *BUCKETS, "token_source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.select(["source", "place", "forked", "total", "last"]).to_pylist())
        quad = lambda x: None if x is None else tuple(x)
        events: list[tuple] = []
        for source, own in groupby(rows, key=lambda r: r["source"]):
            told = list(own)
            deltas = fold_totals([(r["place"], quad(r["total"]), quad(r["last"])) for r in told], bool(told[0]["forked"]))
            events += [(source, place, *observation(d), "derived") for place, d in deltas]
            if len(events) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, e, strict=True)) for e in events], schema)
                events = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, e, strict=True)) for e in events], schema)

    schema = pa.schema([("source", pa.string()), ("place", pa.int64()), *((b, pa.int64()) for b in BUCKETS), ("token_source", pa.string())])
    told = "source string, place long, " + ", ".join(f"{b} long" for b in BUCKETS) + ", token_source string"
    return marked.repartition("source").sortWithinPartitions("source", "place").mapInArrow(run, told)
