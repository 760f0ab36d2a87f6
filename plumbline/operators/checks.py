"""Validation checks. Everything that is a plain aggregate of the input shares a single pass.

A check builder returns probes, one per rule: the aggregates it needs and the result row made from
them. :func:`evaluate` runs any number of probes of any kind together.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import predicates as P
from plumbline.functions.columns import (
    DIGEST_LENGTH,
    WILDCARD,
    col,
    field_of,
    is_complex,
    is_missing,
    is_orderable,
    is_text,
    known,
    numeric_field,
    select_fields,
    union_all,
)
from plumbline.operators.batches import aggregate_rows, packed
from plumbline.operators.distinct import distinct_rows
from plumbline.operators.results import as_rows, no_results, number, pass_if, result

ROWS = "rows"


class Probe(NamedTuple):
    """``result`` is the SQL of the row; ``{name}`` in it stands for one of the aggregates.

    ``text_buffer`` marks aggregates that keep a text. They run in a pass of their own, because one
    such buffer takes the whole pass off the hash aggregation.
    """

    column: str
    aggregates: dict[str, Column]
    result: str
    text_buffer: bool = False


def evaluate(df: DataFrame, probes: list[Probe]) -> DataFrame:
    """All probes over ``df`` in one pass, or one per batch of columns; one row per result.

    Probes of the same column run in the same pass, so every column is read about once.
    """
    position = {c: i for i, c in enumerate(df.columns)}
    ordered = sorted(probes, key=lambda p: position.get(p.column, -1))
    parts = []
    for text_buffer in (False, True):
        for batch in packed([p for p in ordered if p.text_buffer == text_buffer], lambda p: len(p.aggregates)):
            names = [{k: f"{k}_{i}" for k in p.aggregates} for i, p in enumerate(batch)]
            aggregates = [a.alias(n[k]) for p, n in zip(batch, names) for k, a in p.aggregates.items()]
            results = [_with_names(p.result, n) for p, n in zip(batch, names)]
            parts.append(as_rows(df.agg(F.count(F.lit(1)).alias(ROWS), *aggregates), results))
    return union_all(parts) if parts else no_results(df.sparkSession)


def _with_names(sql: str, names: dict[str, str]) -> str:
    for short, name in names.items():
        sql = sql.replace(f"{{{short}}}", name)
    return sql


def null_probes(df: DataFrame, rules: list[dict[str, Any]], dataset: str = "") -> list[Probe]:
    probes = []
    share = f"try_divide(100.0D * {{nulls}}, {ROWS})"
    for rule in rules:
        field = field_of(df, rule["column"])
        limit = float(rule.get("max_percent", 0))
        row = result(
            "null_check", [field.name], pass_if(f"{share} <= {number(limit)}"), share, ROWS, limit,
            {"null_count": "{nulls}"}, dataset,
        )
        probes.append(Probe(field.name, {"nulls": F.count_if(is_missing(field))}, row))
    return probes


def _count_probes(
    kind: str, masks: list[tuple[str, Column]], dataset: str, always: bool
) -> list[Probe]:
    """Counts violating rows; without ``always`` a clean column gives no row."""
    probes = []
    for name, mask in masks:
        row = result(kind, [name], pass_if("{hits} = 0"), "{hits}", ROWS, 0.0, None, dataset)
        probes.append(Probe(name, {"hits": F.count_if(mask)}, row if always else f"if({{hits}} > 0, {row}, null)"))
    return probes


def domain_probes(df: DataFrame, rules: list[dict[str, Any]], dataset: str = "") -> list[Probe]:
    masks = [(r["column"], P.domain_mask(field_of(df, r["column"]), r)) for r in rules]
    return _count_probes("domain_check", masks, dataset, always=True)


def numeric_probes(df: DataFrame, rules: list[dict[str, Any]], dataset: str = "") -> list[Probe]:
    masks = [(r["column"], P.numeric_mask(numeric_field(df, r["column"]), r)) for r in rules]
    return _count_probes("numeric_check", masks, dataset, always=True)


def empty_string_probes(df: DataFrame, columns: list[str], dataset: str = "") -> list[Probe]:
    masks = [(f.name, P.blank(f)) for f in select_fields(df, columns, is_text)]
    return _count_probes("empty_string_check", masks, dataset, always=False)


def _sql(value: int | None) -> str:
    return "null" if value is None else str(value)


def volume_probes(
    min_rows: int | None = None, max_rows: int | None = None, dataset: str = ""
) -> list[Probe]:
    # A bound that is not given compares as unknown, which passes.
    inside = f"({ROWS} >= {_sql(min_rows)}) and ({ROWS} <= {_sql(max_rows)})"
    bounds = {"min_rows": _sql(min_rows), "max_rows": _sql(max_rows)}
    return [Probe("", {}, result("volume_check", [], pass_if(inside), ROWS, ROWS, None, bounds, dataset))]


#: Characters that a result shows of a long text.
SHOWN_CHARACTERS = 40


def _bounded(field: T.StructField) -> tuple[Column, str]:
    """A key of bounded size that is equal for equal values, and the SQL that shows the value of key ``{low}``.

    Long texts and bytes are their digest and their beginning, so that no task gathers whole texts.
    """
    value = known(field)
    if is_text(field.dataType):
        long = F.concat(F.sha2(value, 256), F.left(value, F.lit(SHOWN_CHARACTERS)))
        key = F.when(F.octet_length(value) >= DIGEST_LENGTH, long).otherwise(value)
        return key, f"if(octet_length({{low}}) >= {DIGEST_LENGTH}, concat(substring({{low}}, {DIGEST_LENGTH + 1}), '...'), {{low}})"
    if isinstance(field.dataType, T.BinaryType):
        return F.when(F.octet_length(value) >= DIGEST_LENGTH, F.sha2(value, 256).cast("binary")).otherwise(value), "hex({low})"
    if is_complex(field.dataType):
        return F.sha2(F.to_json(F.struct(value)), 256), "{low}"
    return value, "{low}"


def constant_probes(df: DataFrame, columns: list[str], dataset: str = "") -> list[Probe]:
    """Exactly one value, a missing value counting as one: least = greatest and all or none missing."""
    probes = []
    for field in [f for f in select_fields(df, columns) if is_orderable(f.dataType)]:
        value, shown = _bounded(field)
        row = result(
            "constant_check", [field.name], "'WARN'", "1", ROWS, 1.0, {"value": shown}, dataset,
        )
        single = f"coalesce({{known}} = {ROWS} and {{low}} = {{high}}, false)"
        probes.append(
            Probe(
                field.name,
                {"low": F.min(value), "high": F.max(value), "known": F.count(value)},
                f"if({ROWS} > 0 and ({{known}} = 0 or {single}), {row}, null)",
                text_buffer=is_text(field.dataType) or is_complex(field.dataType),
            )
        )
    return probes


def null_check(df: DataFrame, rules: list[dict[str, Any]], dataset: str = "") -> DataFrame:
    """Share of missing values per rule ``{column, max_percent}``."""
    return evaluate(df, null_probes(df, rules, dataset))


def default_null_rules(df: DataFrame) -> list[dict[str, Any]]:
    return [{"column": c} for c in df.columns]


def null_listing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values per requested column; an absent column is listed with status SKIPPED."""
    wanted = df.columns if WILDCARD in columns else columns
    there = [c for c in wanted if c in df.columns]
    absent = [(c, None, "SKIPPED") for c in wanted if c not in df.columns]
    parts = []
    if there:
        parts.append(
            aggregate_rows(
                df,
                there,
                lambda c: 1,
                lambda i, c: [F.count_if(is_missing(df.schema[c])).alias(f"n{i}")],
                lambda i, c: F.struct(
                    F.lit(c).alias("column"),
                    col(f"n{i}").alias("null_count"),
                    F.expr(pass_if(f"n{i} = 0")).alias("status"),
                ),
            )
        )
    if absent or not there:
        parts.append(df.sparkSession.createDataFrame(absent, "column string, null_count bigint, status string"))
    return union_all(parts)


def domain_check(df: DataFrame, rules: list[dict[str, Any]], dataset: str = "") -> DataFrame:
    """Rows outside ``allowed_values``, inside ``forbidden_values`` or not matching ``regex``."""
    return evaluate(df, domain_probes(df, rules, dataset))


def numeric_check(df: DataFrame, rules: list[dict[str, Any]], dataset: str = "") -> DataFrame:
    """Rows below ``min``, above ``max`` or negative where ``allow_negative`` is false."""
    return evaluate(df, numeric_probes(df, rules, dataset))


def volume_check(
    df: DataFrame, min_rows: int | None = None, max_rows: int | None = None, dataset: str = ""
) -> DataFrame:
    return evaluate(df, volume_probes(min_rows, max_rows, dataset))


def constant_check(df: DataFrame, columns: list[str], dataset: str = "") -> DataFrame:
    return evaluate(df, constant_probes(df, columns, dataset))


def empty_string_check(df: DataFrame, columns: list[str], dataset: str = "") -> DataFrame:
    return evaluate(df, empty_string_probes(df, columns, dataset))


def uniqueness_check(df: DataFrame, keys: list[str], dataset: str = "") -> DataFrame:
    """Rows that repeat an earlier key. Missing key parts equal each other."""
    fields = [field_of(df, k) for k in keys]
    duplicates = "(row_count - distinct_count)"
    row = result(
        "uniqueness_check", keys, pass_if(f"{duplicates} = 0"), duplicates, "row_count", 0.0,
        {"distinct_count": "distinct_count"}, dataset,
    )
    return as_rows(distinct_rows(df, fields), [row])


def cardinality_check(df: DataFrame, rules: list[dict[str, Any]], dataset: str = "") -> DataFrame:
    """Distinct values per rule ``{column, min_distinct, max_distinct}``, missing counting as one."""
    parts = []
    for rule in rules:
        field = field_of(df, rule["column"])
        low, high = _sql(rule.get("min_distinct")), _sql(rule.get("max_distinct"))
        inside = f"(distinct_count >= {low}) and (distinct_count <= {high})"
        row = result(
            "cardinality_check", [field.name], pass_if(inside), "distinct_count", "row_count", None,
            {"min_distinct": low, "max_distinct": high}, dataset,
        )
        parts.append(as_rows(distinct_rows(df, [field]), [row]))
    return union_all(parts)


def violations(df: DataFrame, rule: dict[str, Any]) -> DataFrame:
    """The rows a domain or numeric rule rejects."""
    field = field_of(df, rule["column"])
    masks = [P.domain_mask(field, rule)]
    if any(k in rule for k in ("min", "max", "allow_negative")):
        masks.append(P.numeric_mask(numeric_field(df, field.name), rule))
    return df.where(P.any_of(masks))
