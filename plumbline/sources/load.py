"""Loading a dataset from a source description."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.schema import infer_schema
from plumbline.sources.csv import read_csv

_SCAN_KEYS = ("columns", "where", "limit", "order_by")
_FILE_TYPES = ("parquet", "orc", "json")


def scan(
    df: DataFrame,
    columns: list[str] | None = None,
    where: str | None = None,
    limit: int | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Filter, projection and row limit of a table scan. Without ``order_by`` a limit is arbitrary."""
    if where:
        df = df.where(F.expr(where))
    if order_by:
        df = df.orderBy(*[col(c) for c in order_by])
    if columns:
        df = df.select(*[col(c) for c in columns])
    return df if limit is None else df.limit(limit)


def _table(spark: SparkSession, source: dict[str, Any]) -> DataFrame:
    parts = [source.get("project"), source.get("dataset"), source["table"]]
    return spark.table(".".join(p for p in parts if p))


def _warehouse(spark: SparkSession, source: dict[str, Any]) -> DataFrame:
    """A warehouse table through its Spark connector, which pushes the scan down."""
    name = f"{source['project']}.{source['dataset']}.{source['table']}"
    return spark.read.format("bigquery").option("table", name).load()


def load_source(spark: SparkSession, source: dict[str, Any]) -> DataFrame:
    """A DataFrame from ``{"type": "csv" | "parquet" | "orc" | "json" | "table" | "bigquery", ...}``."""
    kind = str(source.get("type", "")).lower()
    scan_options = {k: source[k] for k in _SCAN_KEYS if k in source}
    if kind == "csv":
        options = {k: v for k, v in source.items() if k not in ("type", "file", *_SCAN_KEYS)}
        return scan(read_csv(spark, source["file"], **options), **scan_options)
    if kind in _FILE_TYPES:
        return scan(spark.read.format(kind).load(source["file"]), **scan_options)
    if kind == "table":
        return scan(_table(spark, source), **scan_options)
    if kind == "bigquery":
        return scan(_warehouse(spark, source), **scan_options)
    raise ValueError(f"Unsupported source type: {kind}")


def dataset_name(source: dict[str, Any]) -> str:
    return source.get("table") or os.path.basename(str(source.get("file", "unknown_dataset")).rstrip("/"))


def is_row_source(source: dict[str, Any]) -> bool:
    """Sources that are read whole even for one column."""
    return str(source.get("type", "")).lower() in ("csv", "json")


def infer_source_schema(spark: SparkSession, source_type: str, path_or_table: str) -> DataFrame:
    """Schema of a file, or of a table named ``catalog.schema.table``, without any checks."""
    kind = source_type.lower()
    if kind == "bigquery":
        project, dataset, table = path_or_table.split(".")
        source = {"type": kind, "project": project, "dataset": dataset, "table": table}
    elif kind == "table":
        source = {"type": kind, "table": path_or_table}
    else:
        source = {"type": kind, "file": path_or_table}
    return infer_schema(load_source(spark, source))
