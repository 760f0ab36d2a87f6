"""Registered queries: a Spark callable per name and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The tables hold no missing or blank values, so some queries read this view of ``events``.
EVENTS_D = """(
  SELECT event_id, user_id,
         CASE WHEN value < 5 THEN NULL ELSE value END AS v,
         CASE event_type WHEN 'view' THEN '  ' WHEN 'error' THEN NULL ELSE event_type END AS t,
         'const' AS k
  FROM events)"""


def events_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(F.col("value") >= 5, F.col("value")).alias("v"),
        F.when(kind == "view", "  ").when(kind != "error", kind).alias("t"),
        F.lit("const").alias("k"),
    )


def flat(results: DataFrame) -> DataFrame:
    """Check results without nested columns."""
    return results.select(
        "check_type",
        F.array_join("target", ",").alias("target"),
        "status",
        F.round("observed", 4).alias("observed"),
        "threshold",
        "row_count",
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def check_row(
    source: str, check_type: str, target: str, observed: str, passed: str, threshold: str = "NULL", status: str = ""
) -> str:
    """One check result over ``source``; ``observed`` and ``passed`` are aggregates."""
    shown = status or f"CASE WHEN {passed} THEN 'PASS' ELSE 'FAIL' END"
    return (
        f"SELECT '{check_type}' AS check_type, '{target}' AS target, {shown} AS status, "
        f"round(CAST({observed} AS DOUBLE), 4) AS observed, CAST({threshold} AS DOUBLE) AS threshold, "
        f"count(*) AS row_count FROM {source}"
    )
