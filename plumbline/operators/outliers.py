"""Z-score outliers: mean and deviation first, then one counting pass for all columns.

The statistics are a scalar subquery of the counting pass, so both are one lazy plan and nothing is
joined. Example values only look at rows that are outliers in some column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.columns import col, is_numeric, known, select_fields
from plumbline.functions.predicates import any_of, z_score
from plumbline.operators.batches import no_rows
from plumbline.operators.results import as_rows, no_results, result

EXAMPLES = 5


def outlier_fields(df: DataFrame, columns: list[str]) -> list[T.StructField]:
    return [f for f in select_fields(df, columns, is_numeric) if is_numeric(f.dataType)]


def _moments(df: DataFrame, fields: list[T.StructField]) -> Column:
    """Struct of mean and sample deviation of every column, as a scalar subquery."""
    parts = [F.avg(known(f)).alias(f"mean_{i}") for i, f in enumerate(fields)]
    parts += [F.stddev_samp(known(f)).alias(f"std_{i}") for i, f in enumerate(fields)]
    return df.agg(F.struct(*parts).alias("moments")).scalar()


def _scores(fields: list[T.StructField], moments: Column) -> list[Column]:
    return [z_score(f, moments[f"mean_{i}"], moments[f"std_{i}"]) for i, f in enumerate(fields)]


def outlier_moments(df: DataFrame, columns: list[str], z: float = 3.0) -> DataFrame:
    """``(column, mean, std, outlier_count, row_count)`` per numeric column."""
    fields = outlier_fields(df, columns)
    if not fields:
        return no_rows(df, outlier_moments, "double")
    moments = _moments(df, fields)
    hits = [F.count_if(s > z).alias(f"n{i}") for i, s in enumerate(_scores(fields, moments))]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *hits)
    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            moments[f"mean_{i}"].cast("double").alias("mean"),
            moments[f"std_{i}"].cast("double").alias("std"),
            col(f"n{i}").alias("outlier_count"),
            col("rows").alias("row_count"),
        )
        for i, f in enumerate(fields)
    ]
    return counted.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def outlier_examples(df: DataFrame, columns: list[str], z: float = 3.0, k: int = EXAMPLES) -> DataFrame:
    """The ``k`` most distant different values per column: ``(column, value, z_score, rank)``."""
    fields = outlier_fields(df, columns)
    if not fields:
        return no_rows(df, outlier_examples, "double")
    scores = _scores(fields, _moments(df, fields))
    entries = [
        F.when(
            s > z,
            F.struct(F.lit(f.name).alias("column"), known(f).cast("double").alias("value"), s.alias("z_score")),
        )
        for f, s in zip(fields, scores)
    ]
    far = (
        df.where(any_of([F.coalesce(s > z, F.lit(False)) for s in scores]))
        .select(F.explode(F.array(*entries)).alias("r"))
        .where(F.col("r").isNotNull())
        .select("r.*")
    )
    # Different values are counted before ranking, and the rank limit is applied per task before
    # the shuffle, so at most k values per column and task are moved.
    nearest_last = Window.partitionBy("column").orderBy(F.desc("z_score"), "value")
    return (
        far.groupBy("column", "value")
        .agg(F.max("z_score").alias("z_score"))
        .withColumn("rank", F.row_number().over(nearest_last))
        .where(F.col("rank") <= k)
    )


def outlier_check(df: DataFrame, columns: list[str], z: float = 3.0, dataset: str = "") -> DataFrame:
    """One FAIL row per column with outliers; clean, constant and non-numeric columns give none."""
    fields = outlier_fields(df, columns)
    if not fields:
        return no_results(df.sparkSession)
    names = [f.name for f in fields]
    examples = (
        outlier_examples(df, names, z)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("shown"))
        .select("column", F.to_json(F.col("shown.value")).alias("examples"))
    )
    counted = outlier_moments(df, names, z).where(F.col("outlier_count") > 0)
    row = result(
        "outlier_check", "array(column)", "'FAIL'", "outlier_count", "row_count", z,
        {"mean": "mean", "std": "std", "examples": "examples"}, dataset,
    )
    return as_rows(counted.join(examples, "column", "left"), [row])
