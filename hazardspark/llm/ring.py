"""Pigeonring filtering of 64-bit fingerprints.

Two fingerprints within ``radius`` differing bits, seen as a ring of m segments, have a
segment from which every run of l segments differs in at most l * radius / m bits, rounded down
(the strong form of the pigeonhole principle on a ring). Runs are tested one by one, each against its proportional
budget, before the full Hamming distance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64


def ring(radius: int, segments: int) -> tuple[list[tuple[int, int]], list[int], int]:
    """Segments as (shift, width), the budget of each run length from 1, and how many leading budgets are zero."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    parts = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(segments)]
    budgets = [n * radius // segments for n in range(1, segments + 1)]
    return parts, budgets, sum(b == 0 for b in budgets)


def signed(x: int) -> int:
    x &= (1 << BITS) - 1
    return x - (1 << BITS) if x >> (BITS - 1) else x


def masks(parts: list[tuple[int, int]], start: int, runs: range) -> list[int]:
    """Bit masks of the runs of segments from start, by length."""
    out, mask = [], 0
    for n in range(1, runs.stop):
        shift, width = parts[(start + n - 1) % len(parts)]
        mask |= ((1 << width) - 1) << shift
        if n in runs:
            out.append(signed(mask))
    return out


def chained(diff: Column, parts: list[tuple[int, int]], budgets: list[int], start: int, known: int = 0) -> Column:
    """Whether all runs from start that are longer than ``known`` segments keep their budgets, in the differing bits diff."""
    ok = F.lit(True)
    for n, mask in zip(range(known + 1, len(parts) + 1), masks(parts, start, range(known + 1, len(parts) + 1))):
        ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(mask))) <= budgets[n - 1])
    return ok


def within(diff: Column, radius: int, segments: int) -> Column:
    """Whether diff has at most radius bits, tested by chains first."""
    parts, budgets, _ = ring(radius, segments)
    chain = F.lit(False)
    for start in range(segments):
        chain = chain | chained(diff, parts, budgets, start)
    return chain & (F.bit_count(diff) <= radius)
