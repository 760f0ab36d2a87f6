"""Packing aggregates into passes that stay inside generated code.

Spark leaves generated code when an operator has more than ``spark.sql.codegen.maxFields`` (100)
fields, and an aggregation needs one to five fields per function. Wide sets of aggregates therefore
run as several branches of one plan. Branches read different columns, so columnar input is still
read about once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import union_all

FIELDS_PER_PASS = 90

Item = TypeVar("Item")


def packed(items: Iterable[Item], width: Callable[[Item], int]) -> list[list[Item]]:
    """Consecutive items in batches of at most ``FIELDS_PER_PASS`` fields."""
    batches: list[list[Item]] = [[]]
    used = 0
    for item in items:
        if batches[-1] and used + width(item) > FIELDS_PER_PASS:
            batches.append([])
            used = 0
        batches[-1].append(item)
        used += width(item)
    return batches if batches[-1] else []


def aggregate_rows(
    df: DataFrame,
    items: Iterable[Item],
    width: Callable[[Item], int],
    aggregates: Callable[[int, Item], list[Column]],
    row: Callable[[int, Item], Column],
) -> DataFrame:
    """One output row per item: ``aggregates`` over ``df``, then a ``row`` struct made from them."""
    parts = []
    for batch in packed(items, width):
        made = df.agg(*[a for i, item in enumerate(batch) for a in aggregates(i, item)])
        entries = F.array(*[row(i, item) for i, item in enumerate(batch)])
        parts.append(made.select(F.explode(entries).alias("r")).select("r.*"))
    return union_all(parts)


def no_rows(df: DataFrame, operator: Callable[..., DataFrame], kind: str, columns: int = 1) -> DataFrame:
    """The empty result of an operator for a table without fitting columns.

    Its columns are those that the operator gives for an empty table with ``columns`` columns of ``kind``.
    """
    names = [f"c{i}" for i in range(columns)]
    fitting = df.sparkSession.createDataFrame([], ", ".join(f"{n} {kind}" for n in names))
    return df.sparkSession.createDataFrame([], operator(fitting, names).schema)


def first_row(df: DataFrame, aggregates: list[Column], width: int = 1) -> dict:
    """All aggregates of a one-row result, by name, computed in passes of bounded width."""
    parts = packed(aggregates, lambda _: width)
    found: dict = {}
    for batch in parts:
        found.update(df.agg(*batch).first().asDict())
    return found
