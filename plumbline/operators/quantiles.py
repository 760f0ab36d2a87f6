"""Exact quantiles of many columns by radix selection: a fixed number of passes, no sort, no shuffle of rows.

The bits of a double, read as a whole number with the negative ones turned round, have the order of the values.
A pass counts values by their next bits (``DIGITS``) within the places that hold a wanted rank, for all columns
and ranks at once, and notes the least and greatest value of every count. The place of a rank is settled when
these are equal, and at the latest when all bits are read: after three passes, however many the rows, and after two
if no open place holds more rows than a digit has values, as then all bits left make the second digit. Every
task adds up its counts by itself. A column has at most as many counts as a digit has values, per wanted rank;
sign, exponent and eight more bits make the first digit, so real columns have some thousands.

The median absolute deviation is selected the same way among the distances from the median, which are made
from the same columns inside the pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits read by the first and by a later pass, and counts that a task gathers before it adds up equal ones.
DIGITS = (20, 22)
GATHERED = 1 << 20

_HALF = np.int64(0x7FFFFFFFFFFFFFFF)
_COUNTS = "measure int, parent bigint, place bigint, n bigint, low bigint, high bigint"


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & _HALF)


def from_ordered_bits(number: int) -> float:
    bits = np.int64(number)
    return float((bits ^ ((bits >> np.int64(63)) & _HALF)).view(np.float64))


class _Counts:
    """Counts by place of one column, with the least and greatest number of each."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, numbers: np.ndarray, shift: int) -> None:
        """Counts ``numbers`` by their bits above ``shift``."""
        if not len(numbers):
            return
        numbers = np.sort(numbers)
        places = numbers >> np.int64(shift)
        starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        ends = np.append(starts[1:], len(numbers))
        self.parts.append(np.stack([places[starts], ends - starts, numbers[starts], numbers[ends - 1]]))
        self.size += len(starts)
        if self.size > GATHERED:
            self.parts = [self.summed()]
            self.size = self.parts[0].shape[1]

    def summed(self) -> np.ndarray:
        whole = np.concatenate(self.parts, axis=1) if self.parts else np.empty((4, 0), np.int64)
        whole = whole[:, np.argsort(whole[0], kind="stable")]
        starts = np.flatnonzero(np.concatenate([[True], whole[0, 1:] != whole[0, :-1]])) if whole.shape[1] else np.empty(0, np.int64)
        if not len(starts):
            return whole
        return np.stack([
            whole[0, starts], np.add.reduceat(whole[1], starts), np.minimum.reduceat(whole[2], starts), np.maximum.reduceat(whole[3], starts)
        ])


def _counted(
    values: DataFrame, names: list[str], seen: int, digit: int, within: dict[int, np.ndarray],
    centres: dict[int, float],
) -> DataFrame:
    """One pass: counts of the columns by ``digit`` bits after the ``seen`` first, inside the parents ``within``."""
    shift = 64 - seen - digit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {m: _Counts() for m in within}
        for batch in batches:
            for m, counts in found.items():
                column = batch[names[m]].to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                column = column[~np.isnan(column)]
                if m in centres:
                    with np.errstate(invalid="ignore"):
                        column = np.abs(column - centres[m])
                    column = column[~np.isnan(column)]
                numbers = ordered_bits(column)
                if seen:
                    parents, asked = numbers >> np.int64(shift + digit), within[m]
                    at = np.minimum(np.searchsorted(asked, parents), len(asked) - 1)
                    numbers = numbers[asked[at] == parents]
                counts.add(numbers, shift)
        for m, counts in found.items():
            place, n, low, high = counts.summed()
            parent = place >> np.int64(digit) if seen else np.zeros_like(place)
            arrays = [pa.array(np.full(len(place), m, dtype=np.int32)), *map(pa.array, (parent, place, n, low, high))]
            yield pa.RecordBatch.from_arrays(arrays, ["measure", "parent", "place", "n", "low", "high"])

    counted = values.select(*[names[m] for m in within]).mapInArrow(run, _COUNTS)
    return counted.groupBy("measure", "parent", "place").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def _selected(counts: DataFrame, wanted: DataFrame) -> list:
    """``measure, rank, left, place, low, high, total`` of every wanted rank.

    ``wanted`` has ``measure, parent`` and either ``rank`` and ``left``, the rank inside the parent, or a ``share``.
    """
    # At most as many counts per column and parent as the digit has values.
    whole = Window.partitionBy("measure", "parent")
    upto = F.sum("n").over(whole.orderBy("place"))
    running = counts.withColumns({"upto": upto, "total": F.sum("n").over(whole)})
    joined = running.join(F.broadcast(wanted), ["measure", "parent"])
    if "share" in wanted.columns:
        spot = F.col("share") * (F.col("total") - 1)
        ranks = F.array(F.floor(spot).cast("bigint"), F.ceil(spot).cast("bigint"))
        joined = joined.withColumn("rank", F.explode(F.array_distinct(ranks)))
        joined = joined.withColumn("left", F.col("rank"))
    before = F.col("upto") - F.col("n")
    return (
        joined.where((before <= F.col("left")) & (F.col("left") < F.col("upto")))
        .select("measure", "rank", (F.col("left") - before).alias("left"), "place", "n", "low", "high", "total")
        .collect()
    )


def _select(
    values: DataFrame, names: list[str], shares: list[float], centres: dict[int, float] | None = None
) -> dict[int, dict[float, float | None]]:
    """The quantiles of the columns, or of their distances from ``centres``."""
    spark, centres = values.sparkSession, centres or {}
    measures = sorted(centres) if centres else list(range(len(names)))
    wanted = spark.createDataFrame(
        [(m, 0, float(s)) for m in measures for s in shares], "measure int, parent bigint, share double"
    )
    within = {m: np.zeros(1, dtype=np.int64) for m in measures}
    at_rank: dict[tuple[int, int], float] = {}
    totals: dict[int, int] = {}
    seen, digit = 0, DIGITS[0]
    while True:
        rows = _selected(_counted(values, names, seen, digit, within, centres), wanted)
        if not seen:
            totals = {r["measure"]: r["total"] for r in rows}
        at_rank.update({(r["measure"], r["rank"]): from_ordered_bits(r["low"]) for r in rows if r["low"] == r["high"]})
        # Several shares can ask for one rank.
        open_ = list({(r["measure"], r["rank"]): r for r in rows if r["low"] != r["high"]}.values())
        if not open_:
            break
        seen += digit
        digit = 64 - seen if max(r["n"] for r in open_) <= 1 << DIGITS[1] else DIGITS[1]
        wanted = spark.createDataFrame(
            [(r["measure"], r["place"], r["rank"], r["left"]) for r in open_], "measure int, parent bigint, rank bigint, left bigint"
        )
        within = {m: np.unique([r["place"] for r in open_ if r["measure"] == m]) for m in sorted({r["measure"] for r in open_})}

    def quantile(m: int, share: float) -> float | None:
        if m not in totals:
            return None
        spot = share * (totals[m] - 1)
        low, high = at_rank[m, math.floor(spot)], at_rank[m, math.ceil(spot)]
        return low if low == high else low + (high - low) * (spot - math.floor(spot))

    return {m: {s: quantile(m, s) for s in shares} for m in measures}


def exact_quantiles(
    df: DataFrame, measures: dict[str, Column], shares: list[float], deviation: bool = False
) -> dict[str, dict]:
    """Quantiles with linear interpolation of numeric expressions; NULLs and NaN are skipped.

    With ``deviation`` the key ``"mad"`` holds the median distance from the median, of which ``shares`` must have 0.5.
    """
    names = [f"v{i}" for i in range(len(measures))]
    values = df.select(*[c.cast("double").alias(v) for v, c in zip(names, measures.values(), strict=True)])
    found: dict[int, dict] = _select(values, names, shares) if names else {}
    if deviation:
        centres = {m: q[0.5] for m, q in found.items() if q[0.5] is not None and math.isfinite(q[0.5])}
        around = _select(values, names, [0.5], centres) if centres else {}
        for m, q in found.items():
            q["mad"] = around[m][0.5] if m in around else (None if q[0.5] is None else math.nan)
    return {c: found[i] for i, c in enumerate(measures)}
