"""Distribution drift of a current dataset against a baseline.

Per column both sides are reduced together to one row per distinct value with a baseline and a
current count. Every test is an aggregate over that table; only finished statistics, one row per
column, reach the driver for their tail probability and verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    common_columns,
    group_key,
    is_complex,
    is_numeric,
    is_temporal,
    known,
    union_all,
)
from plumbline.functions.tails import chi_square_upper, kolmogorov_two_sided, normal_two_sided
from plumbline.operators.batches import first_row, packed
from plumbline.operators.ordered import bucket_count, running_totals, split_points
from plumbline.operators.sketches import MERGE_GROUPS

# Verdict thresholds, the most values of a number that is compared as a category, and the
# largest baseline for which the family "by_size" uses hypothesis tests.
SMALL_BASELINE = 1000
FEW_VALUES = 5
P_VALUE = 0.05
DISTANCE = 0.1
DRIFTED_SHARE = 0.5
LEAST_NORM = 0.001

# A sketched number of distinct values above this is certainly more than a few.
SKETCHED_FEW = 100

DRIFT_SCHEMA = (
    "column string, test string, statistic double, p_value double, threshold double, drifted boolean"
)


def _comparable(baseline: DataFrame, current: DataFrame, column: str) -> Callable[[Column], Column]:
    """Turns values of both sides into one type: kept if it is the same, else numbers, else text."""
    types = [df.schema[column].dataType for df in (baseline, current)]
    if types[0] == types[1]:
        return lambda v: v
    return (lambda v: v.cast("double")) if all(is_numeric(t) for t in types) else (lambda v: v.cast("string"))


def as_number(field: T.StructField) -> Column:
    """A number as a double, a date or time as its microseconds."""
    if is_temporal(field.dataType):
        return F.unix_micros(known(field).cast("timestamp")).cast("double")
    return known(field).cast("double")


def value_pairs(baseline: DataFrame, current: DataFrame, column: str, numeric: bool) -> DataFrame:
    """``(value, b, c)``: rows of each side per distinct known value."""
    comparable = _comparable(baseline, current, column)

    def side(df: DataFrame, b: int, c: int) -> DataFrame:
        field = df.schema[column]
        value = as_number(field) if numeric else comparable(group_key(field))
        return df.select(value.alias("value"), F.lit(b).alias("is_b"), F.lit(c).alias("is_c"))

    both = side(baseline, 1, 0).unionAll(side(current, 0, 1)).where(F.col("value").isNotNull())
    return both.groupBy("value").agg(F.sum("is_b").alias("b"), F.sum("is_c").alias("c"))


def _statistic(
    rows: DataFrame, column: str, test: str, value: Column, b: Column, c: Column, dof: Column | None = None
) -> DataFrame:
    return rows.agg(
        value.cast("double").alias("statistic"),
        (F.lit(None) if dof is None else dof).cast("bigint").alias("dof"),
        b.cast("bigint").alias("baseline_rows"),
        c.cast("bigint").alias("current_rows"),
    ).select(F.lit(column).alias("column"), F.lit(test).alias("test"), "statistic", "dof", "baseline_rows", "current_rows")


def _numeric_splits(baseline: DataFrame, current: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    if not columns:
        return {}

    def doubles(df: DataFrame) -> DataFrame:
        return df.select(*[as_number(df.schema[c]).alias(f"v{i}") for i, c in enumerate(columns)])

    both = doubles(baseline).unionAll(doubles(current))
    names = [f"v{i}" for i in range(len(columns))]
    found = split_points(both, names, bucket_count(both))
    return {c: found[n] for c, n in zip(columns, names)}


def _ordered(baseline: DataFrame, current: DataFrame, column: str, splits: list[float] | None) -> DataFrame:
    if splits is None:
        splits = _numeric_splits(baseline, current, [column])[column]
    return running_totals(value_pairs(baseline, current, column, True), "value", ["b", "c"], splits)


def _share_b() -> Column:
    return F.try_divide(F.col("b_upto"), F.col("b_total"))


def _share_c() -> Column:
    return F.try_divide(F.col("c_upto"), F.col("c_total"))


def kolmogorov_smirnov(
    baseline: DataFrame, current: DataFrame, column: str, splits: list[float] | None = None
) -> DataFrame:
    """Largest distance between the two empirical distribution functions."""
    rows = _ordered(baseline, current, column, splits)
    gap = F.max(F.abs(_share_b() - _share_c()))
    return _statistic(rows, column, "ks", gap, F.max("b_total"), F.max("c_total"))


def wasserstein(
    baseline: DataFrame,
    current: DataFrame,
    column: str,
    splits: list[float] | None = None,
    normalise: bool = True,
    std: float | None = None,
) -> DataFrame:
    """Area between the distribution functions, in standard deviations (``std``) of the baseline."""
    rows = _ordered(baseline, current, column, splits)
    width = F.col("next_value") - F.col("value")
    area = F.coalesce(F.sum(F.abs(_share_b() - _share_c()) * width), F.lit(0.0))
    if normalise:
        spread = baseline.agg(F.stddev_pop(as_number(baseline.schema[column]))).scalar() if std is None else F.lit(std)
        area = area / F.greatest(spread, F.lit(LEAST_NORM))
    return _statistic(rows, column, "wasserstein", area, F.max("b_total"), F.max("c_total"))


def _with_totals(baseline: DataFrame, current: DataFrame, column: str) -> tuple[DataFrame, Column, Column]:
    pairs = value_pairs(baseline, current, column, False)
    totals = pairs.agg(F.struct(F.sum("b").alias("b"), F.sum("c").alias("c"))).scalar()
    return pairs, totals["b"], totals["c"]


def chi_square(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Pearson's statistic of the table (dataset x value)."""
    pairs, nb, nc = _with_totals(baseline, current, column)
    both = (F.col("b") + F.col("c")).cast("double")
    expected_b, expected_c = both * nb / (nb + nc), both * nc / (nb + nc)
    parts = F.try_divide((F.col("b") - expected_b) ** 2, expected_b) + F.try_divide(
        (F.col("c") - expected_c) ** 2, expected_c
    )
    dof = F.count(F.lit(1)) - 1
    return _statistic(pairs, column, "chi_square", F.sum(parts), F.sum("b"), F.sum("c"), dof)


def proportion_z(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Difference of the share of one of two values, in pooled standard errors."""
    pairs, _, _ = _with_totals(baseline, current, column)
    nb, nc = F.sum("b"), F.sum("c")
    # The larger value in text order; the sign is dropped, so either of the two would do.
    hit_b, hit_c = F.max_by("b", "value"), F.max_by("c", "value")
    pooled = (hit_b + hit_c) / (nb + nc)
    error = F.sqrt(pooled * (1 - pooled) * (1.0 / nb + 1.0 / nc))
    z = F.coalesce(F.try_divide(F.abs(hit_b / nb - hit_c / nc), error), F.lit(0.0))
    return _statistic(pairs, column, "proportion_z", z, nb, nc)


def jensen_shannon(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Jensen-Shannon distance of the value shares, base 2."""
    pairs, nb, nc = _with_totals(baseline, current, column)
    p, q = F.col("b") / nb, F.col("c") / nc
    mean = (p + q) / 2
    parts = F.when(p > 0, p * F.log2(p / mean)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / mean)).otherwise(0.0)
    distance = F.sqrt(F.greatest(F.sum(parts) / 2, F.lit(0.0)))
    return _statistic(pairs, column, "jensen_shannon", distance, F.sum("b"), F.sum("c"))


TESTS = {
    "ks": kolmogorov_smirnov,
    "wasserstein": wasserstein,
    "chi_square": chi_square,
    "proportion_z": proportion_z,
    "jensen_shannon": jensen_shannon,
}


def choose_test(numeric: bool, distinct: int, baseline_rows: int, family: str = "distances") -> str:
    """The test of a column: ``distances`` or ``hypotheses``, or with ``by_size`` the one that fits the baseline."""
    if family in TESTS:
        return family
    if family == "by_size":
        family = "hypotheses" if baseline_rows <= SMALL_BASELINE else "distances"
    if family not in ("distances", "hypotheses"):
        raise ValueError(f"unknown drift tests: {family}")
    if numeric and distinct > FEW_VALUES:
        return "ks" if family == "hypotheses" else "wasserstein"
    if family == "distances":
        return "jensen_shannon"
    return "chi_square" if distinct > 2 else "proportion_z"


def verdict(test: str, statistic: float, dof: int | None, b: int, c: int) -> tuple[float | None, float, bool]:
    """``(p_value, threshold, drifted)`` of a finished statistic."""
    if test == "ks":
        p = kolmogorov_two_sided(statistic, b, c)
    elif test == "chi_square":
        p = chi_square_upper(statistic, dof or 0)
    elif test == "proportion_z":
        p = normal_two_sided(statistic)
    else:
        return None, DISTANCE, statistic >= DISTANCE
    return p, P_VALUE, p < P_VALUE


class Drift(NamedTuple):
    columns: DataFrame
    summary: DataFrame


def drift_columns(baseline: DataFrame, current: DataFrame) -> list[str]:
    """Common columns that can be compared; arrays, maps, structs and bytes are left out."""
    return [
        c
        for c in common_columns(baseline, current)
        if not is_complex(baseline.schema[c].dataType) and not is_complex(current.schema[c].dataType)
    ]


class _Size(NamedTuple):
    baseline_rows: int
    current_rows: int
    distinct: int


def _sizes(baseline: DataFrame, current: DataFrame, numeric: dict[str, bool]) -> dict[str, _Size]:
    """Known rows of both sides and distinct values per column.

    The tests only depend on whether there are a few distinct values. One pass sketches the number;
    a second one collects the values of the columns that have few, exactly. Neither shuffles data.
    """
    columns = list(numeric)

    def side(df: DataFrame, is_b: bool) -> DataFrame:
        values = []
        for i, c in enumerate(columns):
            field = df.schema[c]
            value = as_number(field) if numeric[c] else _comparable(baseline, current, c)(group_key(field))
            values.append(value.alias(f"v{i}"))
        return df.select(F.lit(is_b).alias("is_b"), *values)

    both = side(baseline, True).unionAll(side(current, False))
    seen: dict[str, int] = {}
    for batch in packed(range(len(columns)), lambda _: 3):
        seen.update(
            both.agg(
                *[F.expr(f"count_if(is_b and v{i} is not null) as b{i}") for i in batch],
                *[F.expr(f"count_if(not is_b and v{i} is not null) as c{i}") for i in batch],
                *[F.expr(f"approx_count_distinct(v{i}) as d{i}") for i in batch],
            )
            .first()
            .asDict()
        )
    few = [i for i in range(len(columns)) if seen[f"d{i}"] <= SKETCHED_FEW]
    if few:
        # At most about SKETCHED_FEW keys of bounded size per column, merged in groups of tasks and then once more.
        by_group = both.withColumn("task_group", F.spark_partition_id() % MERGE_GROUPS).groupBy("task_group").agg(
            *[F.expr(f"collect_set(v{i}) as s{i}") for i in few]
        )
        values = by_group.agg(*[F.expr(f"size(array_distinct(flatten(collect_list(s{i})))) as d{i}") for i in few])
        seen.update(values.first().asDict())
    return {c: _Size(seen[f"b{i}"], seen[f"c{i}"], seen[f"d{i}"]) for i, c in enumerate(columns)}


def data_drift(baseline: DataFrame, current: DataFrame, tests: str | dict[str, str] = "distances") -> Drift:
    """Tests every common column: small passes pick the tests, one job computes all statistics.

    ``tests`` is a family, or one for each column (others: ``distances``). ``distances`` are the Wasserstein and
    Jensen-Shannon distances and ``hypotheses`` the tests with p-values, at every size; ``by_size`` takes hypotheses
    for baselines of at most 1000 known rows. The name of a single test is possible, too. Dates and times
    are compared as ordered numbers.
    """
    spark = baseline.sparkSession

    def both(c: str, family: Callable[[T.DataType], bool]) -> bool:
        return family(baseline.schema[c].dataType) and family(current.schema[c].dataType)

    numeric = {c: both(c, is_numeric) or both(c, is_temporal) for c in drift_columns(baseline, current)}
    wanted = tests if isinstance(tests, dict) else dict.fromkeys(numeric, tests)
    if not numeric:
        return _drift_result(spark, [], "SKIPPED")
    chosen = {
        c: choose_test(numeric[c], size.distinct, size.baseline_rows, wanted.get(c, "distances"))
        for c, size in _sizes(baseline, current, numeric).items()
        if size.baseline_rows > 0 and size.current_rows > 0
    }
    if not chosen:
        return _drift_result(spark, [], "SKIPPED")
    splits = _numeric_splits(baseline, current, [c for c, t in chosen.items() if t in ("ks", "wasserstein")])
    scaled = [c for c, t in chosen.items() if t == "wasserstein"]
    spreads = first_row(
        baseline, [F.stddev_pop(as_number(baseline.schema[c])).alias(f"s{i}") for i, c in enumerate(scaled)], 3
    )
    options = {c: {"std": spreads[f"s{i}"]} for i, c in enumerate(scaled)}
    parts = [
        TESTS[t](baseline, current, c, splits[c], **options.get(c, {})) if c in splits else TESTS[t](baseline, current, c)
        for c, t in chosen.items()
    ]
    rows = []
    for r in union_all(parts).collect():
        p, threshold, drifted = verdict(
            r["test"], r["statistic"], r["dof"], r["baseline_rows"], r["current_rows"]
        )
        rows.append((r["column"], r["test"], r["statistic"], p, threshold, drifted))
    return _drift_result(spark, sorted(rows), "SUCCESS")


def _drift_result(spark: SparkSession, rows: list[tuple], status: str) -> Drift:
    columns = spark.createDataFrame(rows, DRIFT_SCHEMA)
    return Drift(columns, drift_summary(columns, status))


def drift_summary(columns: DataFrame, status: str = "SUCCESS") -> DataFrame:
    """Number and share of drifted columns; the dataset drifts from a share of one half on."""
    drifted = F.count_if("drifted")
    share = F.coalesce(F.try_divide(drifted, F.count(F.lit(1))), F.lit(0.0))
    return columns.agg(
        F.lit(status).alias("status"),
        F.count(F.lit(1)).alias("compared_columns"),
        drifted.alias("number_of_drifted_columns"),
        share.alias("share_of_drifted_columns"),
        (share >= DRIFTED_SHARE).alias("dataset_drift"),
    )
