"""Group counts, group metrics with thresholds, and group distributions."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    col,
    field_of,
    is_missing,
    known,
    numeric_field,
    percent,
    select_fields,
    union_all,
)
from plumbline.functions.predicates import any_of
from plumbline.operators.results import as_rows, pass_if, result

SHOWN_GROUPS = 10
SEPARATOR = " | "

# A sum or mean beyond 38 digits is NULL.
METRICS = {"sum": F.try_sum, "avg": F.try_avg, "min": F.min, "max": F.max}


def _summable(field: T.StructField, metric: str) -> Column:
    """Whole numbers are summed as decimals, which hold any sum of a table's bigints."""
    whole = isinstance(field.dataType, T.IntegralType) and metric == "sum"
    return known(field).cast("decimal(38,0)") if whole else known(field)


def _group_names(rule: dict[str, Any]) -> list[str]:
    names = rule["group_by"]
    return [names] if isinstance(names, str) else list(names)


def group_metrics(df: DataFrame, rule: dict[str, Any]) -> DataFrame:
    """``count`` and the requested metrics per group; groups with a missing key are left out.

    ``rule``: ``group_by``, ``metrics`` (of count, sum, avg, min, max) and ``columns``, the numeric
    columns the metrics apply to. A metric column is called ``<metric>_<column>``.
    """
    keys = [field_of(df, c) for c in _group_names(rule)]
    metrics = [m for m in rule.get("metrics", ["count"]) if m != "count"]
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    values = [numeric_field(df, c) for c in rule.get("columns", [])] if metrics else []
    aggregates = [METRICS[m](_summable(v, m)).alias(f"{m}_{v.name}") for v in values for m in metrics]
    return (
        df.where(~any_of([is_missing(k) for k in keys]))
        .groupBy(*[col(k.name) for k in keys])
        .agg(F.count(F.lit(1)).alias("count"), *aggregates)
    )


def _breaches(rule: dict[str, Any], measured: list[str]) -> Column:
    """TRUE for a group outside ``min_<metric>`` or ``max_<metric>``."""
    tests = []
    for metric in ("count", *METRICS):
        targets = [c for c in measured if c == metric or c.startswith(f"{metric}_")]
        low, high = rule.get(f"min_{metric}"), rule.get(f"max_{metric}")
        tests += [F.coalesce(col(c) < low, F.lit(False)) for c in targets if low is not None]
        tests += [F.coalesce(col(c) > high, F.lit(False)) for c in targets if high is not None]
    return reduce(or_, tests, F.lit(False))


def group_summary(df: DataFrame, rule: dict[str, Any], k: int = SHOWN_GROUPS) -> DataFrame:
    """The first ``k`` groups in key order."""
    keys = [col(c) for c in _group_names(rule)]
    return group_metrics(df, rule).orderBy(*keys).limit(k)


def group_check(df: DataFrame, rules: list[dict[str, Any]], dataset: str = "") -> DataFrame:
    """Per rule: FAIL if any group breaks a threshold; observed is the smallest group's count."""
    parts = []
    for rule in rules:
        names = _group_names(rule)
        grouped = group_metrics(df, rule)
        measured = [c for c in grouped.columns if c not in names]
        whole = grouped.agg(
            F.min("count").alias("smallest"),
            F.count(F.lit(1)).alias("groups"),
            F.count_if(_breaches(rule, measured)).alias("failing"),
            F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
        )
        listed = group_summary(df, rule).agg(
            F.to_json(F.sort_array(F.collect_list(F.struct(*[col(c) for c in grouped.columns])))).alias("shown")
        )
        row = result(
            "group_by_check", names, pass_if("failing = 0"), "smallest", "rows", rule.get("min_count"),
            {"groups": "groups", "failing_groups": "failing", "summary": "summary"}, dataset,
        )
        parts.append(as_rows(whole.withColumn("summary", listed.scalar()), [row]))
    return union_all(parts)


def group_specs(groups: Any) -> list[list[str]]:
    """A list of names is one composite group; otherwise each entry is a group of its own."""
    entries = [groups] if isinstance(groups, str) else list(groups)
    if entries and all(isinstance(g, str) for g in entries):
        return [entries]
    return [list(g) if isinstance(g, (list, tuple)) else [g] for g in entries]


def group_distribution(df: DataFrame, groups: Any, k: int = SHOWN_GROUPS) -> DataFrame:
    """Most frequent value combinations per group: ``(columns, values, count, percent)``.

    A missing value is a value of its own, shown as ``nan``. Ties are ordered by the values.
    """
    parts = []
    for spec in group_specs(groups):
        fields = select_fields(df, spec)
        if not fields:
            continue
        names = [f"g{i}" for i in range(len(fields))]
        counted = (
            df.select(*[known(f).alias(n) for f, n in zip(fields, names)])
            .groupBy(*names)
            .agg(F.count(F.lit(1)).alias("count"))
        )
        total = counted.agg(F.sum("count")).scalar()
        shown = [F.coalesce(F.col(n).cast("string"), F.lit("nan")) for n in names]
        parts.append(
            counted.orderBy(F.desc("count"), *names)
            .limit(k)
            .select(
                F.lit(SEPARATOR.join(f.name for f in fields)).alias("columns"),
                F.concat_ws(SEPARATOR, *shown).alias("values"),
                "count",
                F.round(percent(F.col("count"), total), 2).alias("percent"),
            )
        )
    if not parts:
        return df.sparkSession.createDataFrame([], "columns string, values string, count bigint, percent double")
    return union_all(parts)
