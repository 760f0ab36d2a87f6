"""Search for primary keys: unique columns first, then growing prefixes of the widest columns; or all minimal keys."""

from __future__ import annotations

from itertools import combinations
from math import prod
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import METADATA_COLUMNS, group_key, key_fields, union_all, without_metadata
from plumbline.operators.distinct import distinct_counts, distinct_rows

KEY_SCHEMA = (
    "status string, key_type string, columns array<string>, distinct_count bigint, "
    "row_count bigint, message string"
)
MINIMAL_SCHEMA = "size int, columns array<string>, distinct_count bigint, row_count bigint"
#: Sets of columns are searched for repeats in one of so many slices of the rows, few rows first, before all rows are looked at.
SLICES = (1024, 32)
#: A value with more than this share of the rows (and more rows than that) keeps rows from being dealt out by its column.
HOT_SHARE, HOT_ROWS = 0.001, 10_000
HISTORY_SCHEMA = "attempt int, columns array<string>, distinct_count bigint, row_count bigint, is_key boolean"


class KeySearch(NamedTuple):
    """``key`` holds one row, ``history`` one row per composite attempt, ``counts`` one per column."""

    key: DataFrame
    history: DataFrame
    counts: DataFrame


def detect_keys(
    df: DataFrame,
    ignored: tuple[str, ...] = METADATA_COLUMNS,
    max_columns: int | None = 5,
    single_scan: bool = False,
) -> KeySearch:
    """Runs one job for the single columns and, only if none is unique, one per composite attempt.

    Only counts come back to the driver: at most one row per column or attempt. ``max_columns=None``
    lets a composite grow to all columns.
    """
    spark = df.sparkSession
    eligible = set(without_metadata(df.columns, ignored))
    by_name = {f.name: f for f in key_fields(df) if f.name in eligible}
    ranked = distinct_counts(df, list(by_name.values()), single_scan).collect()
    counts = spark.createDataFrame(
        [(r["column"], r["ordinal"], r["row_count"], r["distinct_count"]) for r in ranked],
        "column string, ordinal int, row_count bigint, distinct_count bigint",
    )
    history: list[tuple] = []

    def finish(status, kind=None, columns=(), distinct=None, total=None, message=None) -> KeySearch:
        found = [(status, kind, list(columns), distinct, total, message)]
        return KeySearch(
            spark.createDataFrame(found, KEY_SCHEMA),
            spark.createDataFrame(history, HISTORY_SCHEMA),
            counts,
        )

    if not ranked:
        if df.isEmpty():
            return finish("SKIPPED", total=0, message="the dataset has no rows")
        return finish("FAIL", message="no column is eligible for a key")
    total = ranked[0]["row_count"]
    if total == 0:
        return finish("SKIPPED", total=0, message="the dataset has no rows")
    unique = [r["column"] for r in ranked if r["distinct_count"] == total]
    if unique:
        return finish("SUCCESS", "SINGLE", unique, total, total)

    order = [r["column"] for r in ranked]
    depth = len(order) if max_columns is None else min(len(order), max_columns)
    for size in range(2, depth + 1):
        prefix = order[:size]
        distinct = distinct_rows(df, [by_name[c] for c in prefix]).first()["distinct_count"]
        history.append((size - 1, prefix, distinct, total, distinct == total))
        if distinct == total:
            return finish("SUCCESS", "COMPOSITE", prefix, distinct, total)
    return finish("FAIL", total=total, message=f"no unique combination among the top {depth} columns")


def key_not_run(df: DataFrame, single_scan: bool = False) -> KeySearch:
    """Distinct counts of all columns without a search."""
    spark = df.sparkSession
    none = [("NOT_RUN", None, [], None, None, None)]
    return KeySearch(
        spark.createDataFrame(none, KEY_SCHEMA),
        spark.createDataFrame([], HISTORY_SCHEMA),
        distinct_counts(df, single_scan=single_scan),
    )


def _hashes(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Two independent hashes of every value; a missing one has hashes of its own."""
    return df.select(*[
        F.xxhash64(F.lit(f"{seed}{i}"), group_key(f).isNull(), group_key(f)).alias(f"{seed}{i}")
        for seed in "gh" for i, f in enumerate(fields)
    ])


def _repeated(df: DataFrame, sets: list[tuple[int, ...]], fields: list[T.StructField], single: list[int], slices: int) -> set[int]:
    """Which sets repeat a row within one slice of the table, or anywhere with one slice; each row is shuffled once per leading column.

    The leading column of a set is the one with most values. Equal rows of a set agree in it, so its hash chooses the
    slice and the partition: a row that repeats in a slice repeats in the table, and all copies meet without a shuffle per
    set. Rows are known by 128 bits: rows with different hashes are different.
    """
    hashed = _hashes(df, fields)
    by_lead: dict[int, list[int]] = {}
    for n, chosen in enumerate(sets):
        by_lead.setdefault(max(chosen, key=lambda i: single[i]), []).append(n)
    found = []
    for lead, numbers in by_lead.items():
        used = sorted({i for n in numbers for i in sets[n]})
        rows = hashed.select(*[f"{seed}{i}" for seed in "gh" for i in used])
        keys = ["n", "g", "h"]
        if slices > 1:
            rows = rows.where(F.pmod(F.col(f"g{lead}"), F.lit(slices)) == 0)
        elif not _hot(df, fields[lead]):
            rows, keys = rows.repartition(f"g{lead}"), [f"g{lead}", *keys]
        entries = [
            F.struct(F.lit(n).alias("n"), *[F.xxhash64(*[f"{seed}{i}" for i in sets[n]]).alias(seed) for seed in "gh"]) for n in numbers
        ]
        single_rows = rows.select(f"g{lead}", F.explode(F.array(*entries)).alias("e")).select(f"g{lead}", "e.*")
        found.append(single_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("n"))
    return {r["n"] for r in union_all(found).distinct().collect()}


def _hot(df: DataFrame, field: T.StructField) -> bool:
    """Whether one value of a column holds so many rows that they should not meet in one task."""
    copies = df.select(group_key(field).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    seen = copies.agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    return seen["most"] > max(HOT_ROWS, HOT_SHARE * seen["rows"])


def minimal_keys(df: DataFrame, ignored: tuple[str, ...] = METADATA_COLUMNS, max_columns: int = 3) -> DataFrame:
    """All sets of at most ``max_columns`` columns that are unique and hold no smaller unique set.

    The lattice of column sets is climbed by size. Sets above a key are never looked at; neither are sets whose
    columns have too few distinct values for all rows. The rest of a level is searched for repeated rows in ever larger
    slices of the table and at last in all rows, where each row is shuffled once for all sets with the same leading
    column. Equal rows have equal hashes, so no set is called a key that is none. Missing values count as one value.
    One number per refuted set reaches the driver. A table without rows has no keys.
    """
    spark = df.sparkSession
    eligible = set(without_metadata(df.columns, ignored))
    fields = [f for f in key_fields(df) if f.name in eligible]
    counted = {r["column"]: r for r in distinct_counts(df, fields).collect()} if fields else {}
    total = max((r["row_count"] for r in counted.values()), default=0)
    single = [counted[f.name]["distinct_count"] for f in fields] if total else []
    found = [(1, (i,), total) for i, n in enumerate(single) if n == total]
    for size in range(2, max_columns + 1) if total else ():
        keys = [set(chosen) for _, chosen, _ in found]
        sets = [
            chosen for chosen in combinations(range(len(fields)), size)
            if prod(single[i] for i in chosen) >= total and not any(k <= set(chosen) for k in keys)
        ]
        for slices in (*SLICES, 1):
            refuted = _repeated(df, sets, fields, single, slices) if sets else set()
            sets = [c for n, c in enumerate(sets) if n not in refuted]
        found += [(size, chosen, total) for chosen in sets]
    return spark.createDataFrame(
        [(size, [fields[i].name for i in chosen], n, total) for size, chosen, n in found], MINIMAL_SCHEMA
    )
