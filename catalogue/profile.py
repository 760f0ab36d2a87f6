"""Queries of the deep profile."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalogue.registry import EVENTS_D, events_d, query, rounded, table, union_sql
from plumbline.functions.columns import union_all
from plumbline.operators import association as A
from plumbline.operators import profile as P

EVENTS_D_COLUMNS = ("event_id", "user_id", "v", "t", "k")
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _overview(source: str, columns: tuple[str, ...]) -> str:
    missing = " + ".join(f"CAST({c} IS NULL AS INT)" for c in columns)
    keys = ", ".join(columns)
    return (
        f"SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST({len(columns)} AS BIGINT) AS column_count, "
        f"CAST(sum(n * m) AS BIGINT) AS missing_cells, round(100.0 * sum(n * m) / (sum(n) * {len(columns)}), 4) AS missing_percent, "
        f"CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, round(100.0 * (sum(n) - count(*)) / sum(n), 4) AS duplicate_percent "
        f"FROM (SELECT count(*) AS n, any_value({missing}) AS m FROM {source} GROUP BY {keys})"
    )


@query(
    union_sql(
        [
            _overview("documents", ("doc_id", "text", "lang", "source", "n_chars")),
            _overview(EVENTS_D, EVENTS_D_COLUMNS),
            _overview("(SELECT user_id, t, k FROM " + EVENTS_D + ")", ("user_id", "t", "k")),
        ]
    )
)
def profile_overview(spark, sf_dir):
    events = events_d(spark, sf_dir)
    frames = [table(spark, sf_dir, "documents"), events, events.select("user_id", "t", "k")]
    return union_all([P.profile_overview(df) for df in frames])


def _numeric(source: str, c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    moments = f"(SELECT {v} AS x, avg({v}) OVER () AS m FROM {source} WHERE {c} IS NOT NULL)"
    return (
        f"SELECT '{c}' AS \"column\", count(x) AS n, min(x) AS min, max(x) AS max, round(avg(x), 4) AS mean, "
        f"round(stddev_samp(x), 4) AS std, round(var_samp(x), 4) AS variance, "
        f"round(avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5), 4) AS skewness, "
        f"round(avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3, 4) AS kurtosis, round(sum(x), 2) AS sum, "
        f"count(*) FILTER (WHERE x = 0) AS zeros, count(*) FILTER (WHERE x < 0) AS negatives FROM {moments}"
    )


@query(
    union_sql([_numeric("lineitem", c) for c in ("l_partkey", *NUMBERS)] + [_numeric("customer", "c_acctbal"), _numeric(EVENTS_D, "v")])
)
def profile_numeric(spark, sf_dir):
    found = union_all(
        [
            P.profile_numeric(table(spark, sf_dir, "lineitem"), ["l_partkey", *NUMBERS]),
            P.profile_numeric(table(spark, sf_dir, "customer"), ["c_acctbal"]),
            P.profile_numeric(events_d(spark, sf_dir), ["v"]),
        ]
    )
    return found.select(
        "column", "n", "min", "max",
        *[F.round(c, 4).alias(c) for c in ("mean", "std", "variance", "skewness", "kurtosis")],
        F.round("sum", 2).alias("sum"), "zeros", "negatives",
    )


def _quantiles(source: str, c: str) -> str:
    q = {n: f"quantile_cont({c}, {s})" for n, s in (("q05", 0.05), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95))}
    shown = ", ".join(f"round({e}, 4) AS {n}" for n, e in q.items())
    return (
        f"SELECT '{c}' AS \"column\", {shown}, round({q['q75']} - {q['q25']}, 4) AS iqr, round(max({c}) - min({c}), 4) AS range, "
        f"round((SELECT median(abs(x - m)) FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source}), "
        f"(SELECT median(CAST({c} AS DOUBLE)) AS m FROM {source})), 4) AS mad FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM {source})"
    )


@query(union_sql([_quantiles("lineitem", c) for c in NUMBERS] + [_quantiles("events", "value"), _quantiles(EVENTS_D, "v")]))
def profile_quantiles(spark, sf_dir):
    found = P.profile_quantiles(table(spark, sf_dir, "lineitem"), list(NUMBERS))
    events = P.profile_quantiles(table(spark, sf_dir, "events"), ["value"])
    derived = P.profile_quantiles(events_d(spark, sf_dir), ["v"])
    return rounded(union_all([found, events, derived]), 4)


def _exact(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS min_exact, CAST(max({c}) AS VARCHAR) AS max_exact, "
        f"CAST(sum({c}) AS VARCHAR) AS sum_exact FROM (SELECT CAST(o_orderkey AS BIGINT) + 9007199254740992 AS big, "
        f"CAST(o_totalprice AS DECIMAL(18, 2)) AS price FROM orders)"
    )


@query(union_sql([_exact("big"), _exact("price")]))
def profile_exact_numbers(spark, sf_dir):
    """Whole numbers beyond the doubles, and decimals, keep every digit."""
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 9007199254740992).alias("big"), F.col("o_totalprice").cast("decimal(18,2)").alias("price")
    )
    return P.profile_numeric(orders, ["*"]).select("column", "min_exact", "max_exact", "sum_exact")


_SHARES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


@query(union_sql([
    "SELECT c AS \"column\", n > 0 AS q05, n > 0 AS q25, n > 0 AS q50, n > 0 AS q75, n > 0 AS q95 FROM "
    f"(SELECT unnest({list(NUMBERS)}) AS c, n FROM (SELECT count(*) AS n FROM lineitem))"
]))
def profile_quantiles_approx(spark, sf_dir):
    """Whether every sketched quantile lies within the rank error of 0.1 % around its share."""
    lineitem = table(spark, sf_dir, "lineitem")
    found = {r["column"]: r for r in P.profile_quantiles_approx(lineitem, list(NUMBERS)).collect()}
    parts = []
    for c in NUMBERS:
        n = F.count(F.lit(1))
        fits = [
            ((F.count_if(F.col(c) < found[c][q]) <= (s + 0.001) * n) & (F.count_if(F.col(c) <= found[c][q]) >= (s - 0.001) * n)).alias(q)
            for q, s in _SHARES.items()
        ]
        parts.append(lineitem.agg(*fits).select(F.lit(c).alias("column"), *_SHARES))
    return union_all(parts)


def _histogram(source: str, c: str, bins: int) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return (
        f"SELECT '{c}' AS \"column\", CAST(b AS INTEGER) AS bin, round(lo + w * b, 4) AS lower, round(lo + w * (b + 1), 4) AS upper, "
        f"(SELECT count(*) FROM {source} WHERE least(CAST(floor(({v} - lo) / w) AS INTEGER), {bins - 1}) = b) AS count "
        f"FROM (SELECT min({v}) AS lo, (max({v}) - min({v})) / {bins} AS w FROM {source}), range({bins}) r(b)"
    )


@query(union_sql([_histogram("lineitem", "l_extendedprice", 10), _histogram("events", "value", 20), _histogram("customer", "c_acctbal", 10)]))
def profile_histogram(spark, sf_dir):
    return rounded(
        union_all(
            [
                P.profile_histogram(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], 10),
                P.profile_histogram(table(spark, sf_dir, "events"), ["value"], 20),
                P.profile_histogram(table(spark, sf_dir, "customer"), ["c_acctbal"], 10),
            ]
        ),
        4,
    )


_DIGEST = "CASE WHEN octet_length(encode(text)) >= 64 THEN sha256(text) ELSE text END"


def _top(source: str, c: str, k: int, order: str = "") -> str:
    return (
        f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count, "
        f"round(count(*) / CAST((SELECT count({c}) FROM {source}) AS DOUBLE), 6) AS share FROM {source} WHERE {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY count(*) DESC, {order or c} LIMIT {k})"
    )


@query(
    union_sql(
        [_top("documents", "lang", 10), _top("documents", "text", 10, _DIGEST), _top("documents", "source", 10), _top("events", "user_id", 10), _top(EVENTS_D, "t", 10)]
    )
)
def profile_top_values(spark, sf_dir):
    return rounded(
        union_all(
            [
                P.profile_top_values(table(spark, sf_dir, "documents"), ["lang", "source", "text"]),
                P.profile_top_values(table(spark, sf_dir, "events"), ["user_id"]),
                P.profile_top_values(events_d(spark, sf_dir), ["t"]),
            ]
        )
    )


def _text(source: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS n, CAST(min(length({c})) AS INTEGER) AS min_length, "
        f"round(avg(length({c})), 4) AS mean_length, CAST(max(length({c})) AS INTEGER) AS max_length FROM {source}"
    )


TEXT_COLUMNS = {"documents": ("text", "lang", "source"), "conversations": ("role", "text"), "pages": ("url", "html")}


@query(union_sql([_text(t, c) for t, columns in TEXT_COLUMNS.items() for c in columns] + [_text(EVENTS_D, "t")]))
def profile_text(spark, sf_dir):
    frames = [table(spark, sf_dir, t) for t in TEXT_COLUMNS]
    found = [P.profile_text(df, ["*"]) for df in frames] + [P.profile_text(events_d(spark, sf_dir), ["t"])]
    return rounded(union_all(found), 4)


def _pearson(source: str, columns: tuple[str, ...]) -> list[str]:
    return [
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM {source}"
        for a, b in combinations(columns, 2)
    ]


@query(
    union_sql(
        _pearson("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMBERS))
        + _pearson(EVENTS_D, ("event_id", "user_id", "v"))
    )
)
def profile_corr(spark, sf_dir):
    found = A.pearson(table(spark, sf_dir, "lineitem"), ["*"]).unionAll(A.pearson(events_d(spark, sf_dir), ["*"]))
    return rounded(found)


def _spearman(source: str, columns: tuple[str, ...]) -> list[str]:
    def rank(x: str) -> str:
        return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"

    return [
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(ra, rb), 6) AS correlation FROM "
        f"(SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a, b in combinations(columns, 2)
    ]


@query(
    union_sql(
        _spearman("lineitem", ("l_quantity", "l_extendedprice", "l_discount")) + _spearman(EVENTS_D, ("user_id", "v"))
    )
)
def profile_spearman(spark, sf_dir):
    lineitem = A.spearman(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(lineitem.unionAll(A.spearman(events_d(spark, sf_dir), ["user_id", "v"])))


def _cramers(source: str, a: str, b: str) -> str:
    known = f"(SELECT {a} AS a, {b} AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    cells = (
        f"(SELECT o, CAST(sum(o) OVER (PARTITION BY a) AS DOUBLE) AS oa, CAST(sum(o) OVER (PARTITION BY b) AS DOUBLE) AS ob, "
        f"(SELECT count(DISTINCT a) FROM {known}) AS r, (SELECT count(DISTINCT b) FROM {known}) AS c "
        f"FROM (SELECT a, b, count(*) AS o FROM {known} GROUP BY a, b))"
    )
    sums = f"(SELECT CAST(sum(o) AS BIGINT) AS n, greatest(sum(o * o / (oa * ob)) - 1, 0) AS p, any_value(r) AS r, any_value(c) AS c FROM {cells})"
    corrected = (
        "sqrt(greatest(p - (r - 1.0) * (c - 1) / (n - 1), 0) / "
        "(least(r - (r - 1.0) * (r - 1) / (n - 1), c - (c - 1.0) * (c - 1) / (n - 1)) - 1))"
    )
    return (
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, n, round(p * n, 4) AS chi_square, "
        f"round(sqrt(p / (least(r, c) - 1)), 6) AS cramers_v, round({corrected}, 6) AS cramers_v_corrected FROM {sums}"
    )


@query(
    union_sql(
        [
            _cramers("documents", "lang", "source"),
            _cramers("lineitem", "l_returnflag", "l_linestatus"),
            _cramers(EVENTS_D, "t", "user_id"),
        ]
    )
)
def profile_cramers_v(spark, sf_dir):
    found = union_all(
        [
            A.cramers_v(table(spark, sf_dir, "documents"), ["lang", "source"]),
            A.cramers_v(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]),
            A.cramers_v(events_d(spark, sf_dir), ["t", "user_id"]),
        ]
    )
    return found.withColumns(
        {
            "chi_square": F.round("chi_square", 4),
            "cramers_v": F.round("cramers_v", 6),
            "cramers_v_corrected": F.round("cramers_v_corrected", 6),
        }
    )


_FLAGS = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in EVENTS_D_COLUMNS)


@query(
    f"SELECT concat_ws(', ', {_FLAGS}) AS missing_columns, "
    f"CAST({' + '.join(f'CAST({c} IS NULL AS INT)' for c in EVENTS_D_COLUMNS)} AS BIGINT) AS missing_count, "
    f"count(*) AS row_count, round(100.0 * count(*) / (SELECT count(*) FROM events), 4) AS percent FROM {EVENTS_D} GROUP BY 1, 2"
)
def profile_missing(spark, sf_dir):
    return P.profile_missing(events_d(spark, sf_dir))


@query(
    "SELECT 'v' AS column_a, 't' AS column_b, round(corr(CAST(v IS NULL AS INT), CAST(t IS NULL AS INT)), 6) AS correlation "
    f"FROM {EVENTS_D}"
)
def profile_missing_corr(spark, sf_dir):
    return rounded(P.profile_missing_correlation(events_d(spark, sf_dir), ["*"]))


@query(
    "SELECT text, lang, copies FROM (SELECT text, lang, count(*) AS copies FROM documents GROUP BY text, lang HAVING count(*) > 1 "
    f"ORDER BY copies DESC, {_DIGEST}, lang LIMIT 10)"
)
def profile_duplicates(spark, sf_dir):
    return P.profile_duplicates(table(spark, sf_dir, "documents"), ["text", "lang"])


@query(
    "SELECT l_quantity, l_discount, l_tax, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1 "
    "ORDER BY copies DESC, l_quantity, l_discount, l_tax LIMIT 10"
)
def profile_duplicates_numeric(spark, sf_dir):
    return P.profile_duplicates(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


def _alert(name: str, column: str, value: str, threshold: float, test: str, source: str = EVENTS_D) -> str:
    return (
        f"SELECT '{column}' AS \"column\", '{name}' AS alert, round(CAST({value} AS DOUBLE), 6) AS value, "
        f"CAST({threshold} AS DOUBLE) AS threshold FROM {source} HAVING {test}"
    )


def _alerts() -> str:
    rows = []
    for c in EVENTS_D_COLUMNS:
        n = f"(count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS INT))"
        gaps = f"(count(*) FILTER (WHERE {c} IS NULL) / CAST(count(*) AS DOUBLE))"
        rows.append(_alert("constant", c, n, 1, f"{n} = 1"))
        rows.append(_alert("unique", c, n, 1, f"{n} = count(*)"))
        rows.append(_alert("missing", c, gaps, 0.05, f"{gaps} > 0.05"))
    for c in ("event_id", "user_id", "v"):
        zeros = f"(count(*) FILTER (WHERE {c} = 0) / CAST(count({c}) AS DOUBLE))"
        rows.append(_alert("zeros", c, zeros, 0.005, f"{zeros} > 0.005"))
        m = f"(SELECT avg({c}) FROM {EVENTS_D})"
        skew = f"(avg(power({c} - {m}, 3)) / power(avg(power({c} - {m}, 2)), 1.5))"
        rows.append(_alert("skewed", c, skew, 1, f"abs({skew}) > 1"))
    for a, b in combinations(("event_id", "user_id", "v"), 2):
        rows.append(_alert("correlated", f"{a} | {b}", f"corr({a}, {b})", 0.9, f"abs(corr({a}, {b})) > 0.9"))
    return union_sql(rows)


@query(_alerts())
def profile_alerts(spark, sf_dir):
    return rounded(P.profile_alerts(events_d(spark, sf_dir), {"zeros": 0.005, "skewness": 1.0}))


@query(
    "SELECT * FROM (SELECT c_custkey, c_name, c_acctbal, 'head' AS part FROM customer ORDER BY c_custkey LIMIT 10) "
    "UNION ALL SELECT * FROM (SELECT c_custkey, c_name, c_acctbal, 'tail' AS part FROM customer ORDER BY c_custkey DESC LIMIT 10)"
)
def profile_sample(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return P.profile_sample(customer, ["c_custkey"])



@query(
    "SELECT 'big' AS \"column\", CAST(9 * count(*) AS VARCHAR) || lpad(CAST(sum(o_custkey) AS VARCHAR), 37, '0') AS sum_exact FROM orders "
    "UNION ALL SELECT 'negative', '-' || CAST(9 * count(*) AS VARCHAR) || lpad(CAST(sum(o_custkey) AS VARCHAR), 37, '0') FROM orders"
)
def profile_sum_of_wide_numbers(spark, sf_dir):
    """Sums of numbers of 38 digits have more digits than any number type."""
    big = F.lit("9" + "0" * 37).cast("decimal(38,0)") + F.col("o_custkey")
    # Not the negative of the other: a minus rounds decimals to 34 digits.
    negative = F.lit("-9" + "0" * 37).cast("decimal(38,0)") - F.col("o_custkey")
    orders = table(spark, sf_dir, "orders").select(big.cast("decimal(38,0)").alias("big"), negative.cast("decimal(38,0)").alias("negative"))
    return P.profile_numeric(orders, ["*"]).select("column", "sum_exact")
