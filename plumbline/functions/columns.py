"""Column helpers shared by every operator: naming, type families, missing values, grouping keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WILDCARD = "*"

# Load-metadata columns that never take part in a key search (fixed values).
METADATA_COLUMNS = ("dh_upload", "dh_uploaded_at", "uploaded_at")

# A text key of this many bytes or more is replaced by its SHA-256 hex digest, which has exactly
# this length; shorter texts stay as they are, so a digest can never equal a plain value.
DIGEST_LENGTH = 64

_FLOATING = (T.FloatType, T.DoubleType)
_COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """Top-level column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATING)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TEMPORAL)


def is_complex(dtype: T.DataType) -> bool:
    return isinstance(dtype, _COMPLEX)


def is_orderable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType))


def field_of(df: DataFrame, name: str) -> T.StructField:
    """The field called ``name``; a missing column is reported before any job starts."""
    if name not in df.columns:
        raise KeyError(f"column {name!r} not found; available: {', '.join(df.columns)}")
    return df.schema[name]


def numeric_field(df: DataFrame, name: str) -> T.StructField:
    field = field_of(df, name)
    if not is_numeric(field.dataType):
        raise TypeError(f"column {name!r} is {field.dataType.simpleString()}, a number is needed")
    return field


def select_fields(df: DataFrame, columns: Iterable[str], family=None) -> list[T.StructField]:
    """Requested fields that exist. ``*`` stands for all of ``family`` (a test on the data type)."""
    wanted = list(columns)
    if WILDCARD in wanted:
        return [f for f in df.schema.fields if family is None or family(f.dataType)]
    return [df.schema[c] for c in wanted if c in df.columns]


def except_columns(df: DataFrame, excluded: Iterable[str]) -> list[str]:
    dropped = set(excluded)
    return [c for c in df.columns if c not in dropped]


def without_metadata(columns: Iterable[str], ignored: Iterable[str] = METADATA_COLUMNS) -> list[str]:
    dropped = {c.lower() for c in ignored}
    return [c for c in columns if c.lower() not in dropped]


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return sorted(set(left.columns) & set(right.columns))


def is_missing(field: T.StructField) -> Column:
    """NULL, and NaN for floating types."""
    c = col(field.name)
    return c.isNull() | F.isnan(c) if is_floating(field.dataType) else c.isNull()


def known(field: T.StructField) -> Column:
    """The value, with NaN turned into NULL so that aggregates skip it and groups join it to NULL."""
    c = col(field.name)
    return F.when(~F.isnan(c), c) if is_floating(field.dataType) else c


def group_key(field: T.StructField) -> Column:
    """Equality key of a value for counting distinct values: long text shuffles as a digest."""
    c = known(field)
    if is_text(field.dataType):
        return F.when(F.octet_length(c) >= DIGEST_LENGTH, F.sha2(c, 256)).otherwise(c)
    if isinstance(field.dataType, T.BinaryType):
        digest = F.sha2(c, 256).cast("binary")
        return F.when(F.octet_length(c) >= DIGEST_LENGTH, digest).otherwise(c)
    return c


def text_key(field: T.StructField) -> Column:
    """The same key as text: different values have different texts, both zeros have one."""
    key = group_key(field)
    if is_floating(field.dataType):
        key = key + F.lit(0.0).cast(field.dataType)
    if isinstance(field.dataType, T.TimestampType):
        # The text of a time can stand for two moments where clocks are put back.
        key = F.unix_micros(key)
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(key)
    return F.to_json(F.struct(key)) if is_complex(field.dataType) else key.cast("string")


def key_fields(df: DataFrame) -> list[T.StructField]:
    """Fields that take part in distinct and key operators when nothing is named."""
    return [f for f in df.schema.fields if not is_complex(f.dataType)]


def row_fields(df: DataFrame) -> list[T.StructField]:
    """Fields that can be compared as part of a whole row."""
    return [f for f in df.schema.fields if is_orderable(f.dataType)]


def union_all(parts: list[DataFrame]) -> DataFrame:
    whole, *rest = parts
    for part in rest:
        whole = whole.unionAll(part)
    return whole


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)
