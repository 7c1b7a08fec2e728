"""One-dimensional cutting stock by column generation, on numpy alone.

Items come as a histogram over sizes 1..capacity, so the work here has a fixed bound
at any number of items.  The linear program over patterns is solved by the revised
simplex method; new patterns come from an unbounded knapsack that dynamic programming
solves for the current prices.  Whole parts of the solution are kept, and what they
leave over is packed best-fit decreasing, again by counts.
"""

from __future__ import annotations

import numpy as np

Pattern = tuple[dict[int, int], int]  # items of each size in one bin, number of such bins


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = sizes <= room
        if not fits.any():
            continue
        worth = np.where(fits, prices + value[np.maximum(room - sizes, 0)], -1.0)
        k = int(worth.argmax())
        if worth[k] > value[room - 1] + 1e-12:
            value[room], last[room] = worth[k], k
        else:
            value[room], last[room] = value[room - 1], -2
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] >= 0:
            counts[last[room]] += 1
            room -= int(sizes[last[room]])
        else:
            room -= 1
    return float(value[capacity]), counts


def linear_program(demand: np.ndarray, sizes: np.ndarray, capacity: int, max_steps: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, bins of each): least bins, fractions allowed, that hold the demand.  Each step keeps a feasible solution, so stopping at ``max_steps`` only costs bins, and so do rounding errors: what is packed is counted again from the whole patterns."""
    m = len(sizes)
    patterns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(patterns))
    bins = inverse @ demand
    for _ in range(max_steps):
        prices = inverse.sum(0)
        worth, column = _best_pattern(np.maximum(prices, 0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ column
        positive = direction > 1e-10
        ratio = np.where(positive, bins / np.where(positive, direction, 1), np.inf)
        leaving = int(ratio.argmin())
        bins -= ratio[leaving] * direction
        bins[leaving] = ratio[leaving]
        bins = np.maximum(bins, 0)
        patterns[:, leaving] = column
        row = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, row)
        inverse[leaving] = row
    return patterns, bins


def _fill(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Bins for the counts in ``left``, largest sizes first; a bin that can be repeated at once is."""
    out: list[Pattern] = []
    while any(left.values()):
        content: dict[int, int] = {}
        room = capacity
        for size in sorted((s for s, n in left.items() if n), reverse=True):
            if take := min(left[size], room // size):
                content[size] = take
                room -= take * size
        times = min(left[s] // n for s, n in content.items())
        for s, n in content.items():
            left[s] -= n * times
        out.append((content, times))
    return out


def plan_bins(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold at least the items of ``histogram`` (size to count); those they have room for beyond it stay empty."""
    histogram = {s: n for s, n in histogram.items() if n > 0}
    if not histogram:
        return []
    if min(histogram) < 1 or max(histogram) > capacity:
        raise ValueError("sizes must lie in 1..capacity")
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes], float)
    patterns, bins = linear_program(demand, sizes, capacity)
    whole = np.floor(bins + 1e-6).astype(int)
    out: list[Pattern] = []
    left = dict(histogram)
    for k in np.flatnonzero(whole):
        content = {int(s): int(n) for s, n in zip(sizes, np.rint(patterns[:, k]), strict=True) if n > 0}
        out.append((content, int(whole[k])))
        for s, n in content.items():
            left[s] = max(0, left[s] - n * int(whole[k]))
    return out + _fill(left, capacity)
