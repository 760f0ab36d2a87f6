"""Latest dates and records per calendar day."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import WILDCARD, col, field_of, is_temporal, is_text, select_fields
from plumbline.functions.parsing import DATE_FORMATS, KNOWN_SHAPES, LONGEST_DATE, DateFormat, date_shape, parse_as, parse_with

SHOWN_DAYS = 10


def date_kind(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.TimestampType):
        return "TIMESTAMP"
    if isinstance(dtype, T.TimestampNTZType):
        return "DATETIME"
    if isinstance(dtype, T.DateType):
        return "DATE"
    return None


def date_fields(df: DataFrame, columns: list[str]) -> list[T.StructField]:
    """Date columns; text columns only if they are named and not reached through ``*``."""
    if WILDCARD in columns:
        return select_fields(df, columns, is_temporal)
    return [f for f in select_fields(df, columns) if is_temporal(f.dataType) or is_text(f.dataType)]


@dataclass
class Evidence:
    """How many values of a text column each format of ``DATE_FORMATS`` (by its number) reads, the latest of them, and all known ones."""

    known: int = 0
    fits: Counter = field(default_factory=Counter)
    latest: dict[int, str] = field(default_factory=dict)


def different_texts(df: DataFrame, texts: list[T.StructField]) -> DataFrame:
    """``i, text, n``: the different texts of every column, with how often each is there; those too long for a date or without a digit as one.

    Days are few and rows many, so texts are counted before they are parsed: reading a text, and above all refusing
    it, takes far longer than counting it.
    """
    # The test stands behind the explode, where one expression serves all columns. Shapes are taken of different texts only.
    entries = [F.struct(F.lit(i).alias("i"), col(f.name).cast("string").alias("text")) for i, f in enumerate(texts)]
    melted = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("text IS NOT NULL")
    melted = melted.select("i", F.when((F.length("text") <= LONGEST_DATE) & F.rlike("text", F.lit("[0-9]")), F.col("text")).alias("text"))
    return melted.groupBy("i", "text").agg(F.count(F.lit(1)).alias("n"))


def shape_evidence(df: DataFrame, texts: list[T.StructField]) -> dict[str, Evidence]:
    """What the formats read of each text column.

    Different texts are grouped by shape, which is one of a fixed list or none, in one pass over all columns; a text is only
    parsed by the formats that accept its shape. What reaches the driver has one row per column and known shape.
    """
    if not texts:
        return {}
    candidates = {s: [j for j, fmt in enumerate(DATE_FORMATS) if s in fmt.shapes] for s in KNOWN_SHAPES}
    most = max(map(len, candidates.values()))
    shaped = different_texts(df, texts).withColumn("shape", F.when(date_shape(F.col("text")).isin(*KNOWN_SHAPES), date_shape(F.col("text"))))

    def read(turn: int) -> Column:
        formats = sorted({found[turn] for found in candidates.values() if turn < len(found)})
        return F.coalesce(F.lit(None), *[
            F.when(F.col("shape").isin(*[s for s, found in candidates.items() if found[turn:turn + 1] == [j]]), parse_with(F.col("text"), F.col("shape"), DATE_FORMATS[j]))
            for j in formats
        ]).cast("timestamp_ntz").alias(f"read_{turn}")

    parsed = shaped.select("i", "shape", "n", *[read(t) for t in range(most)])
    rows = parsed.groupBy("i", "shape").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col(f"read_{t}").isNotNull(), F.col("n"))).alias(f"fits_{t}") for t in range(most)],
        *[F.max(f"read_{t}").cast("string").alias(f"latest_{t}") for t in range(most)],
    ).collect()
    evidence = {f.name: Evidence() for f in texts}
    for r in rows:
        found = evidence[texts[r["i"]].name]
        found.known += r["n"]
        for turn, j in enumerate(candidates.get(r["shape"], [])):
            if r[f"fits_{turn}"]:
                found.fits[j] += r[f"fits_{turn}"]
                found.latest[j] = max(found.latest.get(j, ""), r[f"latest_{turn}"])
    return evidence


def best_format(found: Evidence) -> int | None:
    """The format with a day that fits most values, the earlier one in ``DATE_FORMATS`` (day before month) if several fit as many."""
    best = max((j for j, fmt in enumerate(DATE_FORMATS) if fmt.has_day), key=lambda j: (found.fits[j], -j))
    return best if found.fits[best] else None


def text_formats(df: DataFrame, fields: list[T.StructField]) -> dict[str, DateFormat]:
    """The one format that each text column is read with, see :func:`best_format`. A column that no format fits has none."""
    found = {name: best_format(e) for name, e in shape_evidence(df, [f for f in fields if is_text(f.dataType)]).items()}
    return {name: DATE_FORMATS[best] for name, best in found.items() if best is not None}


def moment(field: T.StructField, formats: dict[str, DateFormat]) -> Column:
    c = col(field.name)
    if not is_text(field.dataType):
        return c.cast("timestamp_ntz")
    return parse_as(c, formats[field.name]) if field.name in formats else F.lit(None).cast("timestamp_ntz")


def _named(date_format: str) -> int:
    """The number of a format."""
    patterns = [f.pattern for f in DATE_FORMATS]
    if date_format not in patterns:
        raise ValueError(f"unknown date format {date_format!r}; known: {', '.join(patterns)}")
    return patterns.index(date_format)


def date_max(df: DataFrame, columns: list[str], date_format: str | None = None) -> DataFrame:
    """``(column, kind, max_date, unparsed)`` of every column with a date, in one aggregation and one of different texts.

    Text columns are read with ``date_format``, or each with the format that fits it best; ``unparsed`` counts the
    known values that are not dates of that format.
    """
    fields = date_fields(df, columns)
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, kind string, max_date timestamp_ntz, unparsed bigint")
    named = None if date_format is None else _named(date_format)
    evidence = shape_evidence(df, [f for f in fields if is_text(f.dataType)])
    entries, aggregates = [], []
    for i, f in enumerate(fields):
        if f.name in evidence:
            found = evidence[f.name]
            j = best_format(found) if named is None else named
            latest, unparsed = F.lit(found.latest.get(j)).cast("timestamp_ntz"), F.lit(found.known - found.fits[j]).cast("bigint")
        else:
            aggregates.append(F.max(moment(f, {})).alias(f"m{i}"))
            latest, unparsed = F.col(f"m{i}"), F.lit(0).cast("bigint")
        kind = F.lit(date_kind(f.dataType) or "TEXT")
        entries.append(F.struct(F.lit(f.name).alias("column"), kind.alias("kind"), latest.alias("max_date"), unparsed.alias("unparsed")))
    one = df.agg(*aggregates) if aggregates else df.sparkSession.range(1)
    rows = one.select(F.explode(F.array(*entries)).alias("r")).select("r.*")
    return rows.where(F.col("max_date").isNotNull())


def _per_day(df: DataFrame, column: str, date_format: str | None) -> DataFrame:
    """Known values per day; the day of those that are no dates of the format is NULL. Different texts are read once."""
    of = field_of(df, column)
    if not is_text(of.dataType):
        day = F.to_date(moment(of, {}))
        return df.where(col(column).isNotNull()).groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("count"))
    formats = text_formats(df, [of]) if date_format is None else {of.name: DATE_FORMATS[_named(date_format)]}
    text = T.StructField("text", T.StringType())
    day = F.to_date(moment(text, {"text": formats[of.name]} if of.name in formats else {}))
    return different_texts(df, [of]).groupBy(day.alias("date")).agg(F.sum("n").alias("count"))


def date_distribution(
    df: DataFrame, column: str, k: int | None = SHOWN_DAYS, date_format: str | None = None
) -> DataFrame:
    """Records per day, latest first; ``k=None`` lists every day. Values that are no dates are in none."""
    days = _per_day(df, column, date_format).where(F.col("date").isNotNull()).orderBy(F.desc("date"))
    return days if k is None else days.limit(k)


def date_distribution_total(df: DataFrame, column: str, date_format: str | None = None) -> DataFrame:
    """Every day plus a TOTAL row over the days, and an UNPARSED row if known values are no dates of the format.

    The rollup runs on the daily counts, not on the records.
    """
    days = _per_day(df, column, date_format)
    # The group of the total adds up the days only.
    dated = F.when(F.col("date").isNotNull(), F.col("count"))
    return (
        days.select(F.coalesce(F.col("date").cast("string"), F.lit("UNPARSED")).alias("date"), "count", dated.alias("dated"))
        .rollup("date")
        .agg(F.sum("count").alias("count"), F.sum("dated").alias("dated"), F.grouping("date").alias("total"))
        .select(
            F.when(F.col("total") == 1, "TOTAL").otherwise(F.col("date")).alias("date"),
            F.coalesce(F.when(F.col("total") == 1, F.col("dated")).otherwise(F.col("count")), F.lit(0)).cast("bigint").alias("count"),
        )
        .orderBy(F.desc("date"))
    )
