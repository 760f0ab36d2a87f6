"""Semantic type of every column, and comparison with an expected schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    col,
    is_complex,
    is_floating,
    is_temporal,
    is_text,
    known,
)
from plumbline.functions.parsing import DATE_FORMATS, looks_boolean, looks_numeric
from plumbline.operators.batches import first_row
from plumbline.operators.dates import shape_evidence
from plumbline.operators.distinct import distinct_counts

SCHEMA_OF_SCHEMA = "column string, source_type string, inferred_type string"

CATEGORY_COUNT = 20
CATEGORY_SHARE = 0.1

# A sketched distinct count settles a threshold only if it is at least this factor away from it;
# with a standard error of 2 % that is more than ten standard errors. Anything nearer is counted.
_SKETCH_ERROR = 0.02
_SKETCH_MARGIN = 1.25

_LONG_RANGE = float(2**63)


def column_types(df: DataFrame) -> DataFrame:
    """``(column, source_type)`` as stored."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, source_type string")


def _text_evidence(i: int, field: T.StructField) -> list[Column]:
    c = col(field.name)
    return [
        F.count_if(looks_boolean(c)).alias(f"bool_{i}"),
        F.count_if(looks_numeric(c)).alias(f"num_{i}"),
    ]


def _fraction_evidence(i: int, field: T.StructField) -> list[Column]:
    c = known(field)
    whole = c == F.floor(c) if not is_floating(field.dataType) else (c == F.rint(c)) & (F.abs(c) < _LONG_RANGE)
    return [F.count_if(whole).alias(f"whole_{i}")]


def _categories(df: DataFrame, fields: list[T.StructField], present: dict[str, int]) -> dict[str, bool]:
    """Which text columns repeat few values: sketched first, counted exactly where it is close."""
    if not fields:
        return {}
    sketch = first_row(
        df, [F.approx_count_distinct(col(f.name), _SKETCH_ERROR).alias(f"d{i}") for i, f in enumerate(fields)], 10
    )
    verdict, close = {}, []
    for i, f in enumerate(fields):
        # Categorical means: fewer than 20 values, or fewer than a tenth of the known rows.
        limit = max(CATEGORY_COUNT, CATEGORY_SHARE * present[f.name])
        if sketch[f"d{i}"] * _SKETCH_MARGIN < limit:
            verdict[f.name] = True
        elif sketch[f"d{i}"] > limit * _SKETCH_MARGIN:
            verdict[f.name] = False
        else:
            close.append(f)
    if close:
        for row in distinct_counts(df, close).collect():
            missing = 1 if present[row["column"]] < row["row_count"] else 0
            distinct = row["distinct_count"] - missing
            share = distinct / present[row["column"]]
            verdict[row["column"]] = distinct < CATEGORY_COUNT or share < CATEGORY_SHARE
    return verdict


def infer_types(df: DataFrame) -> dict[str, str]:
    """Column name to semantic type.

    One fused pass, one over texts that are neither booleans nor numbers for their date shapes, and a distinct pass for
    text that is no date.
    """
    evidence: list[Column] = []
    simple: dict[str, str] = {}
    for i, f in enumerate(df.schema.fields):
        dtype = f.dataType
        if is_complex(dtype):
            simple[f.name] = "complex"
            continue
        evidence.append(F.count(known(f)).alias(f"n_{i}"))
        if is_text(dtype):
            evidence += _text_evidence(i, f)
        elif is_floating(dtype) or isinstance(dtype, T.DecimalType):
            evidence += _fraction_evidence(i, f)
    counts = first_row(df, evidence)

    types: dict[str, str] = {}
    undecided: list[T.StructField] = []
    present: dict[str, int] = {}
    for i, f in enumerate(df.schema.fields):
        dtype, n = f.dataType, counts.get(f"n_{i}", 0)
        present[f.name] = n
        if f.name in simple:
            types[f.name] = simple[f.name]
        elif n == 0:
            types[f.name] = "string"
        elif isinstance(dtype, T.BooleanType):
            types[f.name] = "boolean"
        elif isinstance(dtype, T.IntegralType):
            types[f.name] = "integer"
        elif f"whole_{i}" in counts:
            types[f.name] = "integer" if counts[f"whole_{i}"] == n else "float"
        elif is_temporal(dtype):
            types[f.name] = "datetime"
        elif not is_text(dtype):
            types[f.name] = "string"
        elif counts[f"bool_{i}"] == n:
            types[f.name] = "boolean"
        elif counts[f"num_{i}"] == n:
            types[f.name] = "float"
        else:
            undecided.append(f)
    fits = shape_evidence(df, undecided)
    dated = {f.name for f in undecided if any(fits[f.name].fits[j] == present[f.name] for j in range(len(DATE_FORMATS)))}
    types.update(dict.fromkeys(dated, "datetime"))
    undecided = [f for f in undecided if f.name not in dated]
    few = _categories(df, undecided, present)
    types.update({c: "categorical" if yes else "string" for c, yes in few.items()})
    return {f.name: types[f.name] for f in df.schema.fields}


def infer_schema(df: DataFrame) -> DataFrame:
    """``(column, source_type, inferred_type)``, one row per column."""
    types = infer_types(df)
    rows = [(f.name, f.dataType.simpleString(), types[f.name]) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, SCHEMA_OF_SCHEMA)


def expected_schema(spark: SparkSession, expected: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(expected.items()), "column string, expected string")


def schema_drift(actual: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``(column, expected, actual, issue)``; issue is missing, extra, type_mismatch or NULL."""
    wanted = expected_schema(actual.sparkSession, expected)
    found = actual.select("column", F.col("inferred_type").alias("actual"))
    issue = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "extra")
        .when(F.col("expected") != F.col("actual"), "type_mismatch")
    )
    return wanted.join(found, "column", "full_outer").select("column", "expected", "actual", issue.alias("issue"))


def missing_columns(actual: DataFrame, expected: dict[str, str]) -> DataFrame:
    return expected_schema(actual.sparkSession, expected).join(actual, "column", "left_anti").orderBy("column")


def extra_columns(actual: DataFrame, expected: dict[str, str]) -> DataFrame:
    wanted = expected_schema(actual.sparkSession, expected)
    return actual.join(wanted, "column", "left_anti").orderBy("column")


def type_mismatches(actual: DataFrame, expected: dict[str, str]) -> DataFrame:
    drift = schema_drift(actual, expected).where(F.col("issue") == "type_mismatch")
    return drift.select("column", "expected", "actual").orderBy("column")


def schema_status(drift: DataFrame) -> DataFrame:
    """FAIL if a column is missing or has another type; extra columns do not matter."""
    counts = [F.count_if(F.col("issue") == i).alias(f"{i}_columns") for i in ("missing", "extra", "type_mismatch")]
    clean = (F.col("missing_columns") == 0) & (F.col("type_mismatch_columns") == 0)
    return drift.agg(*counts).withColumn("status", F.when(clean, "PASS").otherwise("FAIL"))
