"""The uniform check result row, the quality score, and the extraction of failed checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("check_type", T.StringType()),
        T.StructField("target", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("observed", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Checks reported next to the score without being part of it.
UNSCORED = ("group_by_check",)


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float | int | None) -> str:
    return "cast(null as double)" if value is None else f"double('{float(value)!r}')"


def pass_if(condition: str) -> str:
    """PASS or FAIL; an undefined condition (a share of zero rows) passes."""
    return f"if(coalesce({condition}, true), 'PASS', 'FAIL')"


def result(
    check_type: str,
    target: list[str] | str,
    status: str,
    observed: str,
    row_count: str,
    threshold: float | None = None,
    details: dict[str, str] | None = None,
    dataset: str = "",
) -> str:
    """SQL of one check result as a struct of ``RESULT_SCHEMA``.

    ``status``, ``observed``, ``row_count`` and the details are SQL over one aggregated row;
    ``target`` is a list of column names or the SQL of an array.
    """
    if not isinstance(target, str):
        target = f"array({', '.join(text(t) for t in target)})"
    entries = ", ".join(f"{text(k)}, cast({v} as string)" for k, v in (details or {}).items())
    return (
        f"named_struct('dataset', {text(dataset)}, 'check_type', {text(check_type)}, "
        f"'target', cast({target} as array<string>), 'status', {status}, "
        f"'observed', cast({observed} as double), 'threshold', {number(threshold)}, "
        f"'row_count', cast({row_count} as bigint), 'details', cast(map({entries}) as map<string,string>))"
    )


def as_rows(aggregated: DataFrame, results: list[str]) -> DataFrame:
    """Turns result structs over aggregated rows into rows; NULL structs are not emitted."""
    exploded = aggregated.selectExpr(f"explode(array({', '.join(results)})) as r")
    return exploded.where("r is not null").select("r.*")


def no_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT_SCHEMA)


def score(check_results: DataFrame, schema_status: str | Column = "PASS") -> DataFrame:
    """``100 * passed / (checks + 1)``; the extra check is the schema comparison. WARN is no pass."""
    status = F.lit(schema_status) if isinstance(schema_status, str) else schema_status
    scored = check_results.where(~F.col("check_type").isin(*UNSCORED)).select("status")
    schema_row = check_results.sparkSession.range(1).select(status.alias("status"))
    return scored.unionAll(schema_row).agg(
        F.round(100.0 * F.count_if(F.col("status") == "PASS") / F.count(F.lit(1)), 2).alias("score"),
        F.count_if(F.col("status") == "PASS").alias("passed_checks"),
        F.count(F.lit(1)).alias("total_checks"),
    )


def failed_checks(check_results: DataFrame) -> DataFrame:
    return check_results.where(F.col("status") == "FAIL")
