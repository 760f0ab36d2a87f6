"""Row samples of an exact size.

Every row has a place, a whole number of 62 bits. The sample is the rows with the smallest places. The place up
to which they reach is found by nested histograms: rows are counted by the first bits of their place, then those in
the bucket that holds the end by the next bits, and so on. The sample is a filter on the input, as spread over the
cluster as the input is; only where rows at the very end share a place are some of these picked in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col, row_fields

PLACE_BITS = 62
#: Bits of a histogram, which has at most 65,536 buckets.
BUCKET_BITS = 16


def _end(placed: DataFrame, size: int) -> tuple[int, int, int] | None:
    """``(place, wanted, there)``: the place of the last row of the sample, how many of the rows there it takes, and how many there are.

    None if the table has no more rows than the sample.
    """
    low, width, left = 0, PLACE_BITS, size
    while True:
        step = max(0, width - BUCKET_BITS)
        inside = placed.where((F.col("place") >= F.lit(low)) & (F.col("place") < F.lit(low + (1 << width))))
        buckets = inside.groupBy(F.shiftright(F.col("place") - F.lit(low), step).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        # At most 65,536 rows.
        upto = buckets.withColumn("upto", F.sum("n").over(Window.orderBy("bucket")))
        found = upto.where(F.col("upto") >= left).orderBy("bucket").first()
        if found is None:
            return None
        left -= found["upto"] - found["n"]
        low += found["bucket"] << step
        if not step:
            return low, left, found["n"]
        if left == found["n"]:
            return low + (1 << step) - 1, 0, 0
        width = step


def smallest_places(df: DataFrame, place: Column, size: int) -> DataFrame:
    """The ``size`` rows with the smallest ``place``; of those at the last place the first in order of all columns."""
    if size <= 0:
        return df.limit(0)
    end = _end(df.select(place.alias("place")), size)
    if end is None:
        return df
    last, wanted, there = end
    if wanted == there:
        return df.where(place <= F.lit(last))
    ties = df.where(place == F.lit(last)).orderBy(*[col(f.name) for f in row_fields(df)]).limit(wanted)
    return df.where(place < F.lit(last)).unionAll(ties)


def sample_rows(df: DataFrame, size: int | None, seed: int = 42) -> DataFrame:
    """``size`` random rows; the whole dataset if it has no more than that.

    The same rows on every run over the same files.
    """
    if not size:
        return df
    return smallest_places(df, F.floor(F.rand(seed) * F.lit(float(1 << PLACE_BITS))).cast("bigint"), size)


def sample_by_key(df: DataFrame, key: list[str], size: int) -> DataFrame:
    """The same ``size`` rows on every run and in every layout: those with the smallest hash of the key columns.

    If rows of the last key do not all fit, those first in order of all columns are taken.
    """
    return smallest_places(df, F.xxhash64(*[col(c) for c in key]).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)), size)
