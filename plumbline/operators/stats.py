"""Size of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, is_text

_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def value_bytes(field: T.StructField) -> Column:
    """Bytes of one value: the width of its type, or the length of its text; NULL for a NULL."""
    c, dtype = col(field.name), field.dataType
    if is_text(dtype) or isinstance(dtype, T.BinaryType):
        return F.octet_length(c).cast("bigint")
    if type(dtype) in _WIDTH:
        return F.when(c.isNotNull(), F.lit(_WIDTH[type(dtype)]).cast("bigint"))
    if isinstance(dtype, T.DecimalType):
        return F.when(c.isNotNull(), F.lit(8 if dtype.precision <= 18 else 16).cast("bigint"))
    if isinstance(dtype, T.ArrayType) and type(dtype.elementType) in _WIDTH:
        return F.when(c.isNotNull(), F.size(c).cast("bigint") * _WIDTH[type(dtype.elementType)])
    return F.octet_length(F.to_json(F.struct(c.alias("v")))).cast("bigint")


def dataset_stats(df: DataFrame) -> DataFrame:
    """``(total_rows, total_columns, total_bytes, total_gb, total_tb)`` in one pass."""
    sizes = [F.coalesce(F.sum(value_bytes(f)), F.lit(0)) for f in df.schema.fields]
    whole = sizes[0] if sizes else F.lit(0)
    for s in sizes[1:]:
        whole = whole + s
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), whole.cast("bigint").alias("total_bytes")
    ).select(
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        "total_bytes",
        (F.col("total_bytes") / 1024**3).alias("total_gb"),
        (F.col("total_bytes") / 1024**4).alias("total_tb"),
    )


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of the plan; no data is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
