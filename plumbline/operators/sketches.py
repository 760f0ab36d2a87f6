"""Quantile sketches of several columns at once, merged in two steps.

Every task sketches its rows. Sketches are first merged in a fixed number of groups and then once
more, so no single task receives the sketches of all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Size parameter of the sketch; its rank error is about 0.04 %.
SKETCH_SIZE = 8000
RANK_ERROR = 0.0004
MERGE_GROUPS = 256


@dataclass
class Sketched:
    """Known values of one expression: their exact number, least, greatest and asked quantiles."""

    n: int
    low: float | None
    high: float | None
    quantiles: list[float]


def sketched_quantiles(values: DataFrame, asked: dict[str, list[float]]) -> dict[str, Sketched]:
    """Approximate quantiles of double columns, each at its own shares, in one job.

    A share outside 0..1 is moved to the nearest end. A column without values has no quantiles.
    """
    names = [f"`{c}`" for c in asked]
    groups = values.select(*asked).withColumn("task_group", F.spark_partition_id() % MERGE_GROUPS)
    by_group = groups.groupBy("task_group").agg(
        *[F.expr(f"kll_sketch_agg_double({c}, {SKETCH_SIZE}) as s{i}") for i, c in enumerate(names)]
    )
    merged = by_group.agg(
        *[F.expr(f"kll_merge_agg_double(s{i}, {SKETCH_SIZE}) as s{i}") for i in range(len(names))]
    )
    answers = []
    for i, shares in enumerate(asked.values()):
        listed = ", ".join(f"{min(1.0, max(0.0, s))!r}D" for s in [0.0, 1.0, *shares])
        count = f"kll_sketch_get_n_double(s{i})"
        answers.append(f"{count} as n{i}")
        answers.append(f"if({count} > 0, kll_sketch_get_quantile_double(s{i}, array({listed})), null) as q{i}")
    row = merged.selectExpr(*answers).first()
    found = {}
    for i, c in enumerate(asked):
        low, high, *quantiles = row[f"q{i}"] or [None, None]
        found[c] = Sketched(row[f"n{i}"] or 0, low, high, quantiles)
    return found
