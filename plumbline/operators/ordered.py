"""Running totals over a globally ordered column, without a single-task window.

Rows are first reduced to one row per distinct value. The values are then cut into buckets of about
equal numbers of distinct values, whatever the rows of a single value. The bucket is a fixed function
of the value, so a task that is lost and run again puts every row where it was before. Windows run
inside a bucket; the totals of the buckets before it come from a table of one row per bucket.
"""

from __future__ import annotations

from math import inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.columns import col
from plumbline.operators.batches import first_row
from plumbline.operators.sketches import SKETCH_SIZE
from plumbline.operators.stats import estimated_bytes

# 65,536 buckets of 64 MB: 4 TiB of distinct values of one column.
MAX_BUCKETS = 1 << 16
SAMPLED_PER_BUCKET = 64
BYTES_PER_BUCKET = 64 * 1024**2


def bucket_count(df: DataFrame) -> int:
    """At least one bucket per shuffle partition, more for large input.

    The size is the optimizer's estimate of ``df``. The upper bound also limits the table of buckets.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_BUCKETS, max(partitions, estimated_bytes(df) // BYTES_PER_BUCKET)))


def split_points(
    df: DataFrame, columns: list[str], buckets: int, distinct: dict[str, int] | None = None
) -> dict[str, list[float]]:
    """At most ``buckets - 1`` places per column that cut its distinct values in about equal parts.

    Values are chosen by their hash, so that one with many rows counts as often as one with a single
    row: about ``SAMPLED_PER_BUCKET`` different values for each bucket are sketched per column. ``distinct``
    says about how many a column has, if that is known.
    """
    if not columns:
        return {}
    if distinct is None:
        distinct = first_row(df, [F.approx_count_distinct(col(c)).alias(c) for c in columns], 2)
    entries = []
    for i, c in enumerate(columns):
        share = min(1.0, SAMPLED_PER_BUCKET * buckets / max(1, distinct[c]))
        place = F.xxhash64(col(c)).bitwiseAND(F.lit((1 << 62) - 1))
        chosen = F.when(place < F.lit(int(share * (1 << 62))), col(c).cast("double"))
        entries.append(F.struct(F.lit(i).alias("i"), chosen.alias("v")))
    # One scan for all columns; what is not chosen goes before anything is shuffled.
    melted = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("v").isNotNull()).distinct()
    sketched = melted.groupBy("i").agg(F.expr(f"kll_sketch_agg_double(v, {SKETCH_SIZE})").alias("s"))
    shares = ", ".join(f"{k / buckets!r}D" for k in range(1, buckets))
    rows = sketched.selectExpr("i", f"kll_sketch_get_quantile_double(s, array({shares})) AS q").collect()
    found = {columns[r["i"]]: sorted({p for p in r["q"] if abs(p) != inf}) for r in rows}
    return {c: found.get(c, []) for c in columns}


def bucketed(df: DataFrame, columns: list[str], splits: dict[str, list[float]]) -> DataFrame:
    """Adds ``b_<column>`` for every double column: the bucket of its value, a fixed function of it; never NULL."""
    cut = [c for c in columns if splits[c]]
    if cut:
        placer = Bucketizer(
            splitsArray=[[-inf, *splits[c], inf] for c in cut], inputCols=cut, outputCols=[f"b_{c}" for c in cut], handleInvalid="keep"
        )
        df = placer.transform(df)
    return df.withColumns({f"b_{c}": F.coalesce(F.col(f"b_{c}"), F.lit(-1.0)) if c in cut else F.lit(0.0) for c in columns})


def with_bucket(df: DataFrame, value: str, splits: list[float]) -> DataFrame:
    if not splits:
        return df.withColumn("bucket", F.lit(0.0))
    place = Bucketizer(
        splits=[-inf, *splits, inf], inputCol="bucket_value", outputCol="bucket", handleInvalid="keep"
    )
    placed = place.transform(df.withColumn("bucket_value", F.col(value).cast("double"))).drop("bucket_value")
    # Never NULL: a join on the bucket then adds no filter below it, and the table of values has the
    # same plan, and one shuffle, in both of its uses.
    return placed.withColumn("bucket", F.coalesce("bucket", F.lit(-1.0)))


def running_totals(
    values: DataFrame, value: str, weights: list[str], splits: list[float]
) -> DataFrame:
    """Adds ``<w>_upto`` (sum over all values up to this one), ``<w>_total`` and ``next_value``.

    ``values`` has one row per distinct ``value``.
    """
    placed = with_bucket(values, value, splits)
    per_bucket = placed.groupBy("bucket").agg(
        F.min(value).alias("first_value"), *[F.sum(w).alias(f"{w}_here") for w in weights]
    )
    # At most MAX_BUCKETS + 1 rows: a window without a partition is bounded here.
    in_order = Window.orderBy("bucket")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select(
        "bucket",
        F.lead("first_value").over(in_order).alias("next_first"),
        *[F.coalesce(F.sum(f"{w}_here").over(earlier), F.lit(0)).alias(f"{w}_start") for w in weights],
        *[F.sum(f"{w}_here").over(Window.partitionBy()).alias(f"{w}_total") for w in weights],
    )
    inside = Window.partitionBy("bucket").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(F.broadcast(starts), "bucket").select(
        *[F.col(c) for c in values.columns],
        F.coalesce(F.lead(value).over(inside), F.col("next_first")).alias("next_value"),
        *[(F.sum(w).over(upto) + F.col(f"{w}_start")).alias(f"{w}_upto") for w in weights],
        *[F.col(f"{w}_total") for w in weights],
    )


def mid_rank(count: str) -> Column:
    """Average rank of tied values, counted from 1, after :func:`running_totals`."""
    return F.col(f"{count}_upto") - (F.col(count) - 1) / 2.0
