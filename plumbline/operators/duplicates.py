"""Duplicate analysis over a set of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import except_columns, is_orderable, percent, select_fields
from plumbline.operators.distinct import distinct_rows


def duplicates(
    df: DataFrame,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    label: str | None = None,
) -> DataFrame:
    """Rows equal to an earlier row on the ``include`` columns, or on all columns but ``exclude``."""
    names = include if include is not None else except_columns(df, exclude or [])
    fields = [f for f in select_fields(df, names) if is_orderable(f.dataType)]
    label = label or ("Include Columns" if include is not None else "Exclude Columns")
    shown = [
        F.lit(label).alias("label"),
        F.array(*[F.lit(f.name) for f in fields]).cast("array<string>").alias("columns"),
        F.array(*[F.lit(c) for c in exclude or []]).cast("array<string>").alias("excluded_columns"),
    ]
    if not fields:
        return df.sparkSession.range(1).select(
            *shown,
            F.lit(None).cast("bigint").alias("row_count"),
            F.lit(None).cast("bigint").alias("duplicate_count"),
            F.lit(None).cast("double").alias("duplicate_percent"),
            F.lit("SKIPPED").alias("status"),
        )
    repeated = F.col("row_count") - F.col("distinct_count")
    filled = F.col("row_count") > 0
    return distinct_rows(df, fields).select(
        *shown,
        "row_count",
        F.when(filled, repeated).alias("duplicate_count"),
        F.when(filled, F.round(percent(repeated, F.col("row_count")), 2)).alias("duplicate_percent"),
        F.when(filled, "SUCCESS").otherwise("SKIPPED").alias("status"),
    )
