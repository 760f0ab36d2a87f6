"""Row predicates of the rules. Every mask is TRUE for a violating row and never NULL."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col, is_floating, is_missing, is_numeric, is_text, known

# A character that is not white space; the four separators x1c-x1f count as white space too.
_VISIBLE = r"(?U)[^\s\x1c-\x1f]"


def _comparable(field: T.StructField, values: list[Any]) -> list[Any]:
    """Listed values that can equal a value of the column; others never match."""
    present = [v for v in values if v is not None and v == v]
    if is_text(field.dataType):
        return [v for v in present if isinstance(v, str)]
    if is_numeric(field.dataType):
        return [v for v in present if isinstance(v, (int, float)) or hasattr(v, "as_tuple")]
    if isinstance(field.dataType, T.BooleanType):
        return [bool(v) for v in present if isinstance(v, (bool, int, float)) and v in (0, 1)]
    return present


def in_list(field: T.StructField, values: list[Any]) -> Column:
    """TRUE where the value is listed; a missing value only if a missing value is listed."""
    listed = _comparable(field, values)
    hit = F.coalesce(known(field).isin(listed), F.lit(False)) if listed else F.lit(False)
    if any(v is None or v != v for v in values):
        return hit | is_missing(field)
    return hit


def not_allowed(field: T.StructField, values: list[Any]) -> Column:
    return ~in_list(field, values)


def forbidden(field: T.StructField, values: list[Any]) -> Column:
    return in_list(field, values)


def as_text(field: T.StructField) -> Column:
    """The text form of a value; floating numbers from 0.0001 to 1e16 in plain decimal notation."""
    c = known(field)
    if not is_floating(field.dataType):
        return c.cast("string")
    plain = F.regexp_replace(c.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(c).between(1e-4, 9.999999999999998e15), plain).otherwise(c.cast("string"))


def not_matching(field: T.StructField, pattern: str) -> Column:
    """TRUE unless the text form matches from its start; a missing value never matches."""
    return ~F.coalesce(as_text(field).rlike(f"^(?:{pattern})"), F.lit(False))


def below(field: T.StructField, bound: Any) -> Column:
    return F.coalesce(known(field) < F.lit(bound), F.lit(False))


def above(field: T.StructField, bound: Any) -> Column:
    return F.coalesce(known(field) > F.lit(bound), F.lit(False))


def negative(field: T.StructField) -> Column:
    return below(field, 0)


def blank(field: T.StructField) -> Column:
    """A text without any visible character; a missing value is not blank."""
    if not is_text(field.dataType):
        return F.lit(False)
    return F.coalesce(~col(field.name).rlike(_VISIBLE), F.lit(False))


def z_score(field: T.StructField, mean: Column, std: Column) -> Column:
    """Distance from the mean in standard deviations; NULL where it is undefined."""
    z = F.abs((known(field) - mean) / F.when(std > 0, std))
    return F.when(~F.isnan(z), z)


def any_of(masks: list[Column]) -> Column:
    return reduce(or_, masks) if masks else F.lit(False)


def domain_mask(field: T.StructField, rule: dict[str, Any]) -> Column:
    """Violations of ``allowed_values``, ``forbidden_values`` and ``regex``; empty means not given."""
    masks = []
    if rule.get("allowed_values"):
        masks.append(not_allowed(field, rule["allowed_values"]))
    if rule.get("forbidden_values"):
        masks.append(forbidden(field, rule["forbidden_values"]))
    if rule.get("regex"):
        masks.append(not_matching(field, rule["regex"]))
    return any_of(masks)


def numeric_mask(field: T.StructField, rule: dict[str, Any]) -> Column:
    """Violations of ``min``, ``max`` and ``allow_negative``."""
    masks = []
    if rule.get("min") is not None:
        masks.append(below(field, rule["min"]))
    if rule.get("max") is not None:
        masks.append(above(field, rule["max"]))
    if not rule.get("allow_negative", True):
        masks.append(negative(field))
    return any_of(masks)
