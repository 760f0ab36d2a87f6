"""Exact distinct counting.

Each column is its own branch: a columnar scan of that column alone, counted by value on the map
side before the shuffle. All branches together read the same bytes as one scan of all columns, and
no row is multiplied as it would be with several distinct aggregates in one ``agg``. Sources that
must be read whole for every branch (CSV, JSON) use ``single_scan``, which takes all columns' keys from one scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.columns import (
    METADATA_COLUMNS,
    group_key,
    key_fields,
    text_key,
    union_all,
    without_metadata,
)


def distinct_rows(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """One row ``(row_count, distinct_count)`` over the given columns, from a single scan."""
    keys = [group_key(f).alias(f"k{i}") for i, f in enumerate(fields)]
    copies = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_count"),
    )


def _one_pass(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """The counts from one scan: every batch of rows gives the different keys of each of its columns.

    Keys of all columns are one table ``(column, key)``, combined by every task before the shuffle. No row is copied.
    """
    names = [f"k{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for i, name in enumerate(names):
                keys = pc.unique(batch[name])
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(keys), pa.int32()), keys, pa.nulls(len(keys), pa.int64())], ["i", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.string()), pa.array([rows], pa.int64())], ["i", "key", "n"])

    found = df.select(*[text_key(f).alias(n) for f, n in zip(fields, names)]).mapInArrow(run, "i int, key string, n bigint")
    by_column = found.groupBy("i", "key").agg(F.sum("n").alias("n")).groupBy("i").agg(
        F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("n")
    )
    # One row per column and one for the number of rows.
    rows = F.coalesce(F.max("n").over(Window.partitionBy()), F.lit(0))
    listed = df.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(fields)] + [(-1, None)], "i int, column string")
    return listed.join(by_column, "i", "left").select(
        "column", F.col("i").alias("ordinal"), rows.cast("bigint").alias("row_count"), F.coalesce("distinct_count", F.lit(0)).alias("distinct_count")
    ).where("ordinal >= 0")


def distinct_counts(
    df: DataFrame, fields: list[T.StructField] | None = None, single_scan: bool = False
) -> DataFrame:
    """``(column, ordinal, row_count, distinct_count)``, highest count first, then column order."""
    fields = key_fields(df) if fields is None else fields
    if not fields:
        return df.sparkSession.createDataFrame(
            [], "column string, ordinal int, row_count bigint, distinct_count bigint"
        )
    if single_scan:
        counted = _one_pass(df, fields)
    else:
        counted = union_all(
            [
                distinct_rows(df, [f]).select(
                    F.lit(f.name).alias("column"), F.lit(i).alias("ordinal"), "row_count", "distinct_count"
                )
                for i, f in enumerate(fields)
            ]
        )
    return counted.orderBy(F.desc("distinct_count"), "ordinal")


def key_candidates(df: DataFrame, ignored: tuple[str, ...] = METADATA_COLUMNS, single_scan: bool = False) -> DataFrame:
    """Columns whose values are all different, load metadata left out."""
    eligible = set(without_metadata(df.columns, ignored))
    fields = [f for f in key_fields(df) if f.name in eligible]
    unique = (F.col("distinct_count") == F.col("row_count")) & (F.col("row_count") > 0)
    return distinct_counts(df, fields, single_scan).where(unique)
