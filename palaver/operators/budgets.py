"""Budgets of a response: items, then bytes; a prefix is kept, and the cut says why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import json_string_bytes

RESERVED_BYTES = 1024


@dataclass(frozen=True)
class Budget:
    # Defaults of a response.
    max_bytes: int = 4 * 1024 * 1024
    max_items: int = 1000
    max_snippet_chars: int = 2000
    max_messages: int = 500
    max_spans: int = 1000

    def __post_init__(self) -> None:
        if self.max_bytes < 4096 or min(self.max_items, self.max_snippet_chars, self.max_messages, self.max_spans) < 1:
            raise ValueError("budget below its floor")


def clamp(items: DataFrame, order: list, cost, max_items: int, max_bytes: int) -> DataFrame:
    """Items (few: a page) that fit, with ``reason``, null or the knob that cut the list: the same for all rows.

    Items first, then bytes; after the first item that exceeds the bytes, none is kept.
    """
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = items.withColumn("_cost", cost).withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("_sum", F.sum("_cost").over(window))
    whole = Window.partitionBy()
    too_many = F.count(F.lit(1)).over(whole) > max_items
    too_long = F.max(F.when(F.col("_n") <= max_items, F.col("_sum"))).over(whole) > max_bytes - RESERVED_BYTES
    reason = F.when(too_long, "max_bytes").when(too_many, "max_items")
    return numbered.withColumn("reason", reason).filter((F.col("_n") <= max_items) & (F.col("_sum") <= max_bytes - RESERVED_BYTES)).drop("_n", "_sum", "_cost")


def hit_cost():
    """Bytes of a hit as JSON: its id and text, and what is always there."""
    return json_string_bytes(F.coalesce("id", F.lit(""))) + json_string_bytes(F.coalesce("text", F.lit(""))) + 64


def keep_around(window: DataFrame, anchor_position: int, cost: str, max_messages: int, max_bytes: int) -> DataFrame:
    """A message window cut from its ends: the nearest to the anchor first, the anchor always."""
    away = F.abs(F.col("position") - anchor_position)
    order = [away, F.col("position")]
    run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = window.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("_sum", F.sum(cost).over(run))
    fits = (F.col("_n") <= max_messages) & (F.col("_sum") <= max_bytes)
    return kept.filter(fits | (F.col("position") == anchor_position)).drop("_n", "_sum")
