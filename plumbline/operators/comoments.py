"""Co-moments of all column pairs from one scan.

Every task turns its rows into blocks: for a block of ``p`` by ``q`` columns the counts, means, squared
deviations and cross products of all its pairs come from a handful of matrix products. Missing values are
masks, so every pair is counted over the rows where both are known. Blocks are merged in two steps by the rule
for combining deviations of two parts around their own means, which does not cancel digits. A block is
a fixed number of bytes, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sketches import MERGE_GROUPS

#: Columns on a side of a block: 64 by 64 pairs of 11 numbers are 360 kB.
SIDE = 64

#: A block: the columns on its left and on its right side.
Block = tuple[list[str], list[str]]

_PARTS = ("n", "mean_x", "mean_y", "cross", "dev_x", "dev_y", "low_x", "high_x", "low_y", "high_y", "endless")
_SCHEMA = "block int, task_group int, stats binary"


def square_blocks(columns: list[str]) -> list[Block]:
    """Blocks that together hold every pair of columns."""
    sides = [columns[at : at + SIDE] for at in range(0, len(columns), SIDE)]
    return list(combinations_with_replacement(sides, 2))


def no_stats(p: int, q: int) -> np.ndarray:
    """The statistics of no rows."""
    stats = np.zeros((len(_PARTS), p, q))
    stats[[_PARTS.index("low_x"), _PARTS.index("low_y")]] = np.inf
    stats[[_PARTS.index("high_x"), _PARTS.index("high_y")]] = -np.inf
    return stats


def _ends(x: np.ndarray, x_known: np.ndarray, y_known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest ``x`` over the rows where ``y`` is known, once per different mask of ``y``."""
    low, high = (np.empty((x.shape[1], y_known.shape[1])) for _ in range(2))
    small, large = np.where(x_known, x, np.inf), np.where(x_known, x, -np.inf)
    seen: dict[bytes, int] = {}
    for j in range(y_known.shape[1]):
        mask = y_known[:, j]
        same = seen.setdefault(mask.tobytes(), j)
        if same < j:
            low[:, j], high[:, j] = low[:, same], high[:, same]
        elif mask.all():
            low[:, j], high[:, j] = small.min(axis=0), large.max(axis=0)
        else:
            low[:, j], high[:, j] = small[mask].min(axis=0, initial=np.inf), large[mask].max(axis=0, initial=-np.inf)
    return low, high


def _centred(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which values are known, which of them finite, the finite ones around a centre (else 0), and the centre."""
    known = ~np.isnan(x)
    finite = np.isfinite(x)
    counted = finite.sum(axis=0)
    centre = np.divide(np.where(finite, x, 0.0).sum(axis=0), counted, out=np.zeros(x.shape[1]), where=counted > 0)
    return known, finite.astype(np.float64), np.where(finite, x - centre, 0.0), centre


def rows_stats(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The statistics of some rows; missing values are NaN."""
    if not len(x):
        return no_stats(x.shape[1], y.shape[1])
    with np.errstate(all="ignore"):
        x_known, x_in, x_at, x_centre = _centred(x)
        y_known, y_in, y_at, y_centre = _centred(y)
        n = x_in.T @ y_in
        sum_x, sum_y = x_at.T @ y_in, x_in.T @ y_at
        some = np.maximum(n, 1)
        endless = x_known.astype(np.float64).T @ y_known - n
        return np.stack([
            n, sum_x / some + x_centre[:, None], sum_y / some + y_centre[None, :], x_at.T @ y_at - sum_x * sum_y / some,
            np.maximum((x_at * x_at).T @ y_in - sum_x * sum_x / some, 0), np.maximum(x_in.T @ (y_at * y_at) - sum_y * sum_y / some, 0),
            *_ends(x, x_known, y_known), *[e.T for e in _ends(y, y_known, x_known)], endless,
        ])


def merged_stats(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The statistics of the rows of both."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    with np.errstate(all="ignore"):
        step_x, step_y = b[1] - a[1], b[2] - a[2]
        # A part without rows has no mean.
        step_x, step_y = (np.where((a[0] > 0) & (b[0] > 0), s, 0.0) for s in (step_x, step_y))
        weight = a[0] * b[0] / some
        base_x, base_y = (np.where(a[0] > 0, a[i], b[i]) for i in (1, 2))
        return np.stack([
            n, base_x + step_x * b[0] / some, base_y + step_y * b[0] / some, a[3] + b[3] + step_x * step_y * weight,
            a[4] + b[4] + step_x * step_x * weight, a[5] + b[5] + step_y * step_y * weight,
            np.minimum(a[6], b[6]), np.maximum(a[7], b[7]), np.minimum(a[8], b[8]), np.maximum(a[9], b[9]), a[10] + b[10],
        ])


def correlations(stats: np.ndarray) -> np.ndarray:
    """Per pair the correlation; None if one side does not vary, NaN with infinite values."""
    n, _, _, cross, dev_x, dev_y, low_x, high_x, low_y, high_y, endless = stats
    with np.errstate(all="ignore"):
        spread = np.sqrt(dev_x) * np.sqrt(dev_y)
        found = np.where(endless > 0, np.nan, cross / spread).astype(object)
    flat = (low_x >= high_x) | (low_y >= high_y) | ((endless == 0) & ~(spread > 0))
    found[flat] = None
    return found


def from_bytes(stats: bytes, block: Block) -> np.ndarray:
    return np.frombuffer(stats, dtype=np.float64).reshape(len(_PARTS), len(block[0]), len(block[1]))


class Gathered:
    """What a task has seen so far of every block."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        self.stats = [no_stats(len(left), len(right)) for left, right in blocks]

    def add(self, columns: dict[str, np.ndarray]) -> None:
        for i, (left, right) in enumerate(self.blocks):
            x, y = (np.stack([columns[c] for c in side], axis=1) for side in (left, right))
            self.stats[i] = merged_stats(self.stats[i], rows_stats(x, y))

    def rows(self) -> pa.RecordBatch:
        group = TaskContext.get().partitionId() % MERGE_GROUPS
        n = len(self.blocks)
        return pa.RecordBatch.from_arrays(
            [pa.array(range(n), pa.int32()), pa.array([group] * n, pa.int32()), pa.array([s.tobytes() for s in self.stats], pa.binary())],
            ["block", "task_group", "stats"],
        )


def _total(group: pa.Table, blocks: list[Block]) -> tuple[int, np.ndarray]:
    block = group["block"][0].as_py()
    total = None
    for stats in group["stats"].to_pylist():
        own = from_bytes(stats, blocks[block])
        total = own if total is None else merged_stats(total, own)
    return block, total


def _by_group(parts: DataFrame, blocks: list[Block]) -> DataFrame:
    """The first step of merging: one row per block and group of tasks, also for a table without rows."""

    def merge(group: pa.Table) -> pa.Table:
        block, total = _total(group, blocks)
        arrays = [pa.array([block], pa.int32()), group["task_group"].slice(0, 1).combine_chunks(), pa.array([total.tobytes()], pa.binary())]
        return pa.table(arrays, ["block", "task_group", "stats"])

    nothing = [(i, 0, bytearray(no_stats(len(a), len(b)).tobytes())) for i, (a, b) in enumerate(blocks)]
    whole = parts.unionAll(parts.sparkSession.createDataFrame(nothing, _SCHEMA))
    return whole.groupBy("block", "task_group").applyInArrow(merge, _SCHEMA)


def co_moments(doubles: DataFrame, blocks: list[Block]) -> DataFrame:
    """``block, task_group, stats``: what every task finds of the blocks over double columns, in one scan."""
    names = list(dict.fromkeys(c for left, right in blocks for c in (*left, *right)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Gathered(blocks)
        for batch in batches:
            seen.add({c: batch[c].to_numpy(zero_copy_only=False) for c in names})
        yield seen.rows()

    return doubles.select(*names).mapInArrow(run, _SCHEMA)


def pair_correlations(parts: DataFrame, blocks: list[Block], shown: dict[str, tuple[int, str]]) -> DataFrame:
    """``(column_a, column_b, correlation)`` per pair of different columns, from what the tasks found.

    ``shown`` gives the place and the name of the column that a member of a block stands for.
    """

    def pairs(block: Block) -> list[tuple[int, int, str, str]]:
        found = []
        for i, a in enumerate(block[0]):
            for j, b in enumerate(block[1]):
                (first, name_a), (second, name_b) = shown[a], shown[b]
                # A block of columns with themselves holds each pair twice.
                if first < second or (first > second and block[0] != block[1]):
                    found.append((i, j, *((name_a, name_b) if first < second else (name_b, name_a))))
        return found

    def finish(group: pa.Table) -> pa.Table:
        block, total = _total(group, blocks)
        found = correlations(total)
        rows = [(a, b, found[i, j]) for i, j, a, b in pairs(blocks[block])]
        arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))]
        return pa.table(arrays, ["column_a", "column_b", "correlation"])

    schema = "column_a string, column_b string, correlation double"
    return _by_group(parts, blocks).groupBy("block").applyInArrow(finish, schema)
