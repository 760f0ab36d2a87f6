"""Deep profile: overview, distributions, frequent values, missing patterns and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    DIGEST_LENGTH,
    col,
    group_key,
    is_floating,
    is_missing,
    is_numeric,
    is_orderable,
    is_text,
    key_fields,
    known,
    percent,
    row_fields,
    select_fields,
    union_all,
)
from plumbline.operators.association import pearson
from plumbline.operators.batches import aggregate_rows, no_rows
from plumbline.operators.distinct import distinct_counts, distinct_rows
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.sketches import sketched_quantiles

PROFILE_SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]

# Alert thresholds (fixed values, all can be overridden).
ALERT_LIMITS = {"missing": 0.05, "zeros": 0.05, "correlation": 0.9, "skewness": 20.0}


def _numeric(df: DataFrame, columns: list[str]) -> list[T.StructField]:
    return [f for f in select_fields(df, columns, is_numeric) if is_numeric(f.dataType)]


def _melt(one_row: DataFrame, entries: list[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def profile_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows of the table."""
    width = len(df.columns)
    missing = F.lit(0)
    for f in df.schema.fields:
        missing = missing + is_missing(f).cast("int")
    cells = df.agg(F.coalesce(F.sum(missing), F.lit(0)).cast("bigint")).scalar()
    repeated = F.col("row_count") - F.col("distinct_count")
    return distinct_rows(df, row_fields(df)).select(
        "row_count",
        F.lit(width).cast("bigint").alias("column_count"),
        cells.alias("missing_cells"),
        F.round(percent(cells, F.col("row_count") * width), 4).alias("missing_percent"),
        repeated.alias("duplicate_rows"),
        F.round(percent(repeated, F.col("row_count")), 4).alias("duplicate_percent"),
    )


#: Whole numbers of more digits are summed in two parts: with fewer, no table has the rows to fill 38 digits.
WIDE_DIGITS = 28
_LOW_DIGITS = 20


def _long_sum(v: Column) -> Column:
    """The sum of whole decimals as text, however long: of the digits above the twentieth and of those below apart."""
    one = F.lit("1" + "0" * _LOW_DIGITS).cast("decimal(38,0)")
    rest = v % one
    low = F.when(rest < 0, rest + one).otherwise(rest)
    high = (v.cast("decimal(38,0)") - rest) / one
    high = F.when(rest < 0, high - 1).otherwise(high).cast("decimal(20,0)")
    low_sum = F.sum(low.cast("decimal(21,0)"))
    # Divided without a rest, as quotients of decimals are rounded.
    lower = low_sum % one
    upper = F.sum(high) + ((low_sum - lower) / one).cast("decimal(38,0)")
    # Below zero: the distance from zero has the complement of the lower digits.
    borrowed = (upper < 0) & (lower > 0)
    upper = F.when(borrowed, upper + 1).otherwise(upper).cast("decimal(38,0)")
    lower = F.when(borrowed, one - lower).otherwise(lower).cast("decimal(38,0)")
    sign = F.when(borrowed | (upper < 0), "-").otherwise("")
    lead, tail = F.abs(upper).cast("string"), lower.cast("string")
    return F.concat(sign, F.when(upper == 0, tail).otherwise(F.concat(lead, F.lpad(tail, _LOW_DIGITS, "0"))))


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range, moments, zeros and negatives of every numeric column.

    ``min_exact``, ``max_exact`` and ``sum_exact`` are texts: the values in the column's own type, and the
    sum of whole and decimal numbers without rounding; the others are doubles. The sum of whole numbers may have more
    than 38 digits; that of decimals with a fraction is NULL beyond them.
    """
    fields = _numeric(df, columns)
    if not fields:
        return no_rows(df, profile_numeric, "double")
    measures = {
        "n": lambda v: F.count(v),
        "min": lambda v: F.min(v),
        "max": lambda v: F.max(v),
        "mean": lambda v: F.avg(v),
        "std": lambda v: F.stddev_samp(v),
        "variance": lambda v: F.var_samp(v),
        "skewness": lambda v: F.skewness(v),
        "kurtosis": lambda v: F.kurtosis(v),
        "sum": lambda v: F.sum(v),
        "zeros": lambda v: F.count_if(v == 0),
        "negatives": lambda v: F.count_if(v < 0),
    }
    exact = {"min_exact": F.min, "max_exact": F.max, "sum_exact": F.try_sum}

    def exactly(f: T.StructField, measure: str) -> Column:
        v, scale = known(f), getattr(f.dataType, "scale", 0)
        if measure != "sum_exact" or is_floating(f.dataType):
            return exact[measure](v).cast("string")
        if getattr(f.dataType, "precision", 0) > WIDE_DIGITS and not scale:
            return _long_sum(v)
        return exact[measure](v.cast(f"decimal(38,{scale})")).cast("string")

    return aggregate_rows(
        df,
        fields,
        lambda f: 29,
        lambda i, f: [make(known(f).cast("double")).alias(f"{m}_{i}") for m, make in measures.items()]
        + [exactly(f, m).alias(f"{m}_{i}") for m in exact],
        lambda i, f: F.struct(
            F.lit(f.name).alias("column"), *[col(f"{m}_{i}").alias(m) for m in (*measures, *exact)]
        ),
    )


def profile_quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact 5/25/50/75/95 % quantiles, interquartile range, range and median absolute deviation."""
    fields = _numeric(df, columns)
    if not fields:
        return no_rows(df, profile_quantiles, "double")
    values = {f.name: known(f) for f in fields}
    found = exact_quantiles(df, values, [0.0, *PROFILE_SHARES, 1.0], deviation=True)

    def minus(a: float | None, b: float | None) -> float | None:
        return None if a is None or b is None else a - b

    rows = []
    for c, q in found.items():
        rows.append(
            (c, *[q[s] for s in PROFILE_SHARES], minus(q[0.75], q[0.25]), minus(q[1.0], q[0.0]), q["mad"])
        )
    return df.sparkSession.createDataFrame(
        rows,
        "column string, q05 double, q25 double, q50 double, q75 double, q95 double, "
        "iqr double, range double, mad double",
    )


def profile_quantiles_approx(df: DataFrame, columns: list[str]) -> DataFrame:
    """The quantiles from one pass of sketches merged in two steps; their rank error is about 0.04 %."""
    fields = _numeric(df, columns)
    if not fields:
        return no_rows(df, profile_quantiles_approx, "double")
    names = {f"v{i}": f.name for i, f in enumerate(fields)}
    doubles = df.select(*[known(f).cast("double").alias(v) for f, v in zip(fields, names)])
    found = sketched_quantiles(doubles, {v: PROFILE_SHARES for v in names})
    rows = [(c, *(found[v].quantiles or [None] * len(PROFILE_SHARES))) for v, c in names.items()]
    return df.sparkSession.createDataFrame(
        rows, "column string, q05 double, q25 double, q50 double, q75 double, q95 double"
    )


def profile_histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """``(column, bin, lower, upper, count)`` with ``bins`` equal widths, empty bins included.

    Infinite values are in no bin. Every column is a branch of its own: it reads one column and
    counts its rows by bin, so no row is multiplied.
    """
    fields = _numeric(df, columns)
    if not fields:
        return no_rows(df, profile_histogram, "double")

    def finite(f: T.StructField) -> Column:
        v = known(f).cast("double")
        return F.when(F.abs(v) < F.lit(float("inf")), v)

    ends = [F.min(finite(f)).alias(f"low_{i}") for i, f in enumerate(fields)]
    ends += [F.max(finite(f)).alias(f"high_{i}") for i, f in enumerate(fields)]
    bounds = df.agg(F.struct(*ends).alias("bounds"))
    edge = bounds.scalar()
    parts = []
    for i, f in enumerate(fields):
        v, low, high = finite(f), edge[f"low_{i}"], edge[f"high_{i}"]
        place = F.coalesce(F.try_divide(v - low, (high - low) / bins), F.lit(0.0))
        bin_ = F.least(F.floor(place).cast("int"), F.lit(bins - 1))
        counted = df.select(F.when(v.isNotNull(), bin_).alias("bin")).where("bin IS NOT NULL").groupBy("bin")
        parts.append(counted.agg(F.count(F.lit(1)).alias("count")).select(F.lit(i).alias("i"), "bin", "count"))
    filled = union_all(parts)
    grid = bounds.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"),
                        F.lit(f.name).alias("column"),
                        F.col("bounds")[f"low_{i}"].alias("low"),
                        F.col("bounds")[f"high_{i}"].alias("high"),
                    )
                    for i, f in enumerate(fields)
                ]
            )
        ).alias("g")
    ).select("g.*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("high") - F.col("low")) / bins
    return grid.join(filled, ["i", "bin"], "left").select(
        "column",
        "bin",
        (F.col("low") + width * F.col("bin")).alias("lower"),
        (F.col("low") + width * (F.col("bin") + 1)).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def _is_bytes(dtype: T.DataType) -> bool:
    return is_text(dtype) or isinstance(dtype, T.BinaryType)


def _long_values(df: DataFrame, field: T.StructField, keys: DataFrame) -> DataFrame:
    """``(key, value)`` of the digests among ``keys``, a table of bounded size."""
    rows = df.where(F.octet_length(col(field.name)) >= DIGEST_LENGTH).select(
        group_key(field).alias("key"), col(field.name).alias("value")
    )
    return rows.join(F.broadcast(keys), "key", "left_semi").distinct()


def profile_top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """``(column, value, count, share)`` of the ``k`` most frequent known values per column.

    Ties are ordered by the value, long texts among them by their digest. The values of the digests
    among the ``k`` winners are read back by a second scan.
    """
    fields = select_fields(df, columns, lambda t: not isinstance(t, T.ArrayType) and is_orderable(t))
    if not fields:
        return no_rows(df, profile_top_values, "string")
    parts = []
    for f in fields:
        counted = (
            df.select(group_key(f).alias("key"))
            .where(F.col("key").isNotNull())
            .groupBy("key")
            .agg(F.count(F.lit(1)).alias("count"))
        )
        total = counted.agg(F.sum("count")).scalar()
        top = counted.orderBy(F.desc("count"), "key").limit(k)
        value = F.col("key")
        if _is_bytes(f.dataType):
            top = top.join(_long_values(df, f, top.select("key")), "key", "left")
            value = F.coalesce("value", "key")
        parts.append(
            top.select(
                F.lit(f.name).alias("column"),
                value.cast("string").alias("value"),
                "count",
                F.try_divide(F.col("count"), total).alias("share"),
            )
        )
    return union_all(parts)


def profile_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shortest, mean and longest text in characters."""
    fields = [f for f in select_fields(df, columns, is_text) if is_text(f.dataType)]
    if not fields:
        return no_rows(df, profile_text, "string")
    measures = {"n": F.count, "min_length": F.min, "mean_length": F.avg, "max_length": F.max}
    return aggregate_rows(
        df,
        fields,
        lambda f: 5,
        lambda i, f: [make(F.length(col(f.name))).alias(f"{m}_{i}") for m, make in measures.items()],
        lambda i, f: F.struct(F.lit(f.name).alias("column"), *[col(f"{m}_{i}").alias(m) for m in measures]),
    )


def profile_missing(df: DataFrame) -> DataFrame:
    """``(missing_columns, missing_count, row_count, percent)`` per pattern of missing values."""
    fields = df.schema.fields
    flags = F.concat(*[F.when(is_missing(f), "1").otherwise("0") for f in fields])
    counted = df.select(flags.alias("flags")).groupBy("flags").agg(F.count(F.lit(1)).alias("row_count"))
    total = counted.agg(F.sum("row_count")).scalar()
    listed = F.concat_ws(
        ", ", *[F.when(F.substring("flags", i + 1, 1) == "1", F.lit(f.name)) for i, f in enumerate(fields)]
    )
    return counted.select(
        listed.alias("missing_columns"),
        F.length(F.replace("flags", F.lit("0"), F.lit(""))).cast("bigint").alias("missing_count"),
        "row_count",
        F.round(percent(F.col("row_count"), total), 4).alias("percent"),
    )


def profile_missing_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of missingness per column pair; pairs without variation give no row."""
    fields = select_fields(df, columns)
    flags = df.select(*[is_missing(f).cast("int").alias(f.name) for f in fields])
    return pearson(flags, [f.name for f in fields]).where(F.col("correlation").isNotNull())


def profile_duplicates(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` rows with most copies: the columns and ``copies``.

    Rows are counted by their keys, in which long text is a digest, so whole texts are not shuffled.
    The values of the ``k`` winners are read back by a second scan against that bounded table.
    """
    wanted = columns or [f.name for f in row_fields(df)]
    fields = [f for f in select_fields(df, wanted) if is_orderable(f.dataType)]
    keys = [f"k{i}" for i in range(len(fields))]
    keyed = df.select(*[group_key(f).alias(k_) for f, k_ in zip(fields, keys)])
    top = (
        keyed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .orderBy(F.desc("copies"), *keys)
        .limit(k)
    )
    if not any(_is_bytes(f.dataType) for f in fields):
        return top.select(*[F.col(k_).alias(f.name) for f, k_ in zip(fields, keys)], "copies")
    names = [f"v{i}" for i in range(len(fields))]
    rows = df.select(
        *[group_key(f).alias(f"r_{k_}") for f, k_ in zip(fields, keys)],
        *[known(f).alias(n) for f, n in zip(fields, names)],
    )
    same = [F.col(f"r_{k_}").eqNullSafe(F.col(k_)) for k_ in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    matched = rows.join(F.broadcast(top), condition)
    return (
        matched.groupBy(*names, "copies")
        .agg(F.count(F.lit(1)).alias("read"))
        .select(*[F.col(n).alias(f.name) for f, n in zip(fields, names)], "copies")
    )


def _alerts(found: DataFrame, tests: list[tuple[str, Column, Column, float]]) -> DataFrame:
    """Rows of ``found`` turned into one alert per test ``(name, condition, value, threshold)`` that holds."""
    entries = [
        F.when(
            condition,
            F.struct(
                "column",
                F.lit(name).alias("alert"),
                value.cast("double").alias("value"),
                F.lit(float(threshold)).alias("threshold"),
            ),
        )
        for name, condition, value, threshold in tests
    ]
    return found.select(F.explode(F.array(*entries)).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def profile_alerts(df: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """``(column, alert, value, threshold)``: constant, unique, missing, zeros, skewed, correlated."""
    limit = {**ALERT_LIMITS, **(limits or {})}
    numeric = [f.name for f in _numeric(df, ["*"])]
    n, d = F.col("row_count"), F.col("distinct_count")
    parts = [
        _alerts(
            distinct_counts(df, key_fields(df)),
            [("constant", (d == 1) & (n > 1), d, 1), ("unique", (d == n) & (n > 1), d, 1)],
        )
    ]
    missing = aggregate_rows(
        df,
        df.schema.fields,
        lambda f: 2,
        lambda i, f: [F.try_divide(F.count_if(is_missing(f)), F.count(F.lit(1))).alias(f"m{i}")],
        lambda i, f: F.struct(F.lit(f.name).alias("column"), col(f"m{i}").alias("share")),
    )
    share = F.col("share")
    parts.append(_alerts(missing, [("missing", share > limit["missing"], share, limit["missing"])]))
    if numeric:
        zeros, skew = F.try_divide(F.col("zeros"), F.col("n")), F.col("skewness")
        parts.append(
            _alerts(
                profile_numeric(df, numeric),
                [
                    ("zeros", zeros > limit["zeros"], zeros, limit["zeros"]),
                    ("skewed", (F.abs(skew) > limit["skewness"]) & ~F.isnan(skew), skew, limit["skewness"]),
                ],
            )
        )
    if len(numeric) > 1:
        pairs = pearson(df, numeric).select(
            F.concat_ws(" | ", "column_a", "column_b").alias("column"), "correlation"
        )
        r = F.col("correlation")
        parts.append(_alerts(pairs, [("correlated", F.abs(r) > limit["correlation"], r, limit["correlation"])]))
    return union_all(parts)


def profile_sample(df: DataFrame, key: list[str], k: int = 10) -> DataFrame:
    """First and last ``k`` rows in key order, marked ``head`` or ``tail``."""
    head = df.orderBy(*[col(c) for c in key]).limit(k)
    tail = df.orderBy(*[col(c).desc() for c in key]).limit(k)
    return head.withColumn("part", F.lit("head")).unionAll(tail.withColumn("part", F.lit("tail")))
