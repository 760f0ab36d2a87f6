"""Queries of the validation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import (
    EVENTS_D,
    check_row,
    events_d,
    flat,
    query,
    rounded,
    table,
    union_sql,
)
from plumbline.functions.columns import union_all
from plumbline.operators import checks as C
from plumbline.operators import groups as G
from plumbline.operators import outliers as O
from plumbline.operators.results import failed_checks as failed
from plumbline.operators.results import score
from plumbline.plans.run import run_checks


def _null_row(source: str, column: str, limit: float) -> str:
    share = f"100.0 * count(*) FILTER (WHERE {column} IS NULL) / count(*)"
    return check_row(source, "null_check", column, share, f"{share} <= {limit}", str(limit))


@query(
    union_sql(
        [_null_row(EVENTS_D, c, m) for c, m in (("v", 30), ("v", 1), ("t", 0), ("k", 0), ("user_id", 0))]
    )
)
def null_check(spark, sf_dir):
    rules = [
        {"column": "v", "max_percent": 30},
        {"column": "v", "max_percent": 1},
        {"column": "t"},
        {"column": "k"},
        {"column": "user_id", "max_percent": 0},
    ]
    return flat(C.null_check(events_d(spark, sf_dir), rules))


@query(
    union_sql(
        [_null_row("customer", c, 0) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]
    )
)
def default_null_check(spark, sf_dir):
    return flat(run_checks_with_defaults(table(spark, sf_dir, "customer"), {}))


def run_checks_with_defaults(df, validations):
    from plumbline.plans.run import with_default_rules

    return run_checks(df, with_default_rules(df, validations))


@query(
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
            f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM {EVENTS_D}"
            for c in ("event_id", "user_id", "v", "t", "k")
        ]
    )
)
def null_listing(spark, sf_dir):
    return C.null_listing(events_d(spark, sf_dir), ["*"])


def _unique_row(source: str, keys: str) -> str:
    copies = f"(SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys})"
    found = "sum(n) - count(*)"
    return (
        f"SELECT 'uniqueness_check' AS check_type, '{keys}' AS target, "
        f"CASE WHEN {found} = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST({found} AS DOUBLE) AS observed, "
        f"CAST(0 AS DOUBLE) AS threshold, CAST(sum(n) AS BIGINT) AS row_count FROM {copies}"
    )


KEY_SETS = (
    ("lineitem", "l_orderkey,l_linenumber"),
    ("lineitem", "l_orderkey,l_partkey,l_linenumber"),
    ("orders", "o_orderkey"),
    ("documents", "text"),
)


@query(union_sql([_unique_row(t, k) for t, k in KEY_SETS]))
def uniqueness_check(spark, sf_dir):
    return union_all([flat(C.uniqueness_check(table(spark, sf_dir, t), k.split(","))) for t, k in KEY_SETS])


def _mask_row(source: str, kind: str, column: str, mask: str) -> str:
    hits = f"count(*) FILTER (WHERE {mask})"
    return check_row(source, kind, column, hits, f"{hits} = 0", "0")


@query(
    union_sql(
        [
            _mask_row("orders", "domain_check", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O')"),
            _mask_row("orders", "domain_check", "o_orderpriority", "NOT regexp_matches(o_orderpriority, '^(?:[1-3]-)')"),
            _mask_row("orders", "domain_check", "o_orderkey", "NOT regexp_matches(CAST(o_orderkey AS VARCHAR), '^(?:[0-9]+$)')"),
            _mask_row(EVENTS_D, "domain_check", "t", "coalesce(t NOT IN ('click', 'signup'), true)"),
            _mask_row(EVENTS_D, "domain_check", "t", "coalesce(t IN ('click'), false)"),
            _mask_row(EVENTS_D, "domain_check", "t", "NOT coalesce(regexp_matches(t, '^(?:c|p)'), false)"),
            _mask_row("documents", "domain_check", "text", "NOT regexp_matches(text, '^(?:[A-Z])')"),
        ]
    )
)
def domain_check(spark, sf_dir):
    orders = [
        {"column": "o_orderstatus", "allowed_values": ["F", "O"]},
        {"column": "o_orderpriority", "regex": "[1-3]-"},
        {"column": "o_orderkey", "regex": "[0-9]+$"},
    ]
    events = [
        {"column": "t", "allowed_values": ["click", "signup"]},
        {"column": "t", "forbidden_values": ["click"]},
        {"column": "t", "regex": "c|p"},
    ]
    return union_all(
        [
            flat(C.domain_check(table(spark, sf_dir, "orders"), orders)),
            flat(C.domain_check(events_d(spark, sf_dir), events)),
            flat(C.domain_check(table(spark, sf_dir, "documents"), [{"column": "text", "regex": "[A-Z]"}])),
        ]
    )


@query(
    union_sql(
        [
            _mask_row("customer", "numeric_check", "c_acctbal", "c_acctbal < 0"),
            _mask_row("part", "numeric_check", "p_size", "p_size < 1 OR p_size > 50"),
            _mask_row("lineitem", "numeric_check", "l_discount", "l_discount > 0.05"),
            _mask_row(EVENTS_D, "numeric_check", "v", "coalesce(v < 10 OR v > 200, false)"),
        ]
    )
)
def numeric_check(spark, sf_dir):
    return union_all(
        [
            flat(C.numeric_check(df, [rule]))
            for df, rule in (
                (table(spark, sf_dir, "customer"), {"column": "c_acctbal", "allow_negative": False}),
                (table(spark, sf_dir, "part"), {"column": "p_size", "min": 1, "max": 50}),
                (table(spark, sf_dir, "lineitem"), {"column": "l_discount", "max": 0.05}),
                (events_d(spark, sf_dir), {"column": "v", "min": 10, "max": 200}),
            )
        ]
    )


@query(
    union_sql(
        [
            check_row("lineitem", "volume_check", "", "count(*)", "count(*) >= 1"),
            check_row("lineitem", "volume_check", "", "count(*)", "count(*) >= 1 AND count(*) <= 100"),
        ]
    )
)
def volume_check(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return flat(C.volume_check(lineitem, 1).unionAll(C.volume_check(lineitem, 1, 100)))


@query(
    union_sql(
        [
            f"SELECT 'constant_check' AS check_type, '{c}' AS target, 'WARN' AS status, CAST(1 AS DOUBLE) AS observed, "
            f"CAST(1 AS DOUBLE) AS threshold, count(*) AS row_count, CAST(min({c}) AS VARCHAR) AS value FROM {EVENTS_D} "
            f"HAVING count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS INT) = 1"
            for c in ("event_id", "user_id", "v", "t", "k")
        ]
    )
)
def constant_check(spark, sf_dir):
    found = C.constant_check(events_d(spark, sf_dir), ["*"])
    return found.select(
        "check_type",
        F.array_join("target", ",").alias("target"),
        "status",
        "observed",
        "threshold",
        "row_count",
        F.col("details")["value"].alias("value"),
    )


OUTLIER_COLUMNS = (("events", "value"), ("documents", "n_chars"), ("lineitem", "l_quantity"), ("orders", "o_totalprice"))


def _moments(source: str, column: str) -> str:
    return (
        f"(SELECT {column} AS x, avg({column}) OVER () AS m, stddev_samp({column}) OVER () AS s FROM {source})"
    )


@query(
    union_sql(
        [
            f"SELECT 'outlier_check' AS check_type, '{c}' AS target, 'FAIL' AS status, "
            f"CAST(count(*) FILTER (WHERE abs((x - m) / s) > 3) AS DOUBLE) AS observed, CAST(3 AS DOUBLE) AS threshold, "
            f"count(*) AS row_count FROM {_moments(t, c)} HAVING count(*) FILTER (WHERE abs((x - m) / s) > 3) > 0"
            for t, c in OUTLIER_COLUMNS
        ]
    )
)
def outlier_check(spark, sf_dir):
    return union_all([flat(O.outlier_check(table(spark, sf_dir, t), [c])) for t, c in OUTLIER_COLUMNS])


@query(
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, "
            f"count(*) FILTER (WHERE abs((x - m) / s) > 3) AS outlier_count, count(*) AS row_count FROM {_moments(t, c)}"
            for t, c in OUTLIER_COLUMNS
        ]
    )
)
def outlier_moments(spark, sf_dir):
    return union_all([rounded(O.outlier_moments(table(spark, sf_dir, t), [c]), 4) for t, c in OUTLIER_COLUMNS])


@query(
    union_sql(
        [
            f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST(x AS DOUBLE) AS value, round(z, 4) AS z_score, "
            f"CAST(row_number() OVER (ORDER BY z DESC, x) AS INTEGER) AS rank FROM (SELECT DISTINCT x, abs((x - m) / s) AS z "
            f"FROM {_moments(t, c)} WHERE abs((x - m) / s) > 3)) WHERE rank <= 5"
            for t, c in OUTLIER_COLUMNS
        ]
    )
)
def outlier_examples(spark, sf_dir):
    return union_all([rounded(O.outlier_examples(table(spark, sf_dir, t), [c]), 4) for t, c in OUTLIER_COLUMNS])


@query(
    union_sql(
        [
            check_row(
                EVENTS_D, "empty_string_check", c, f"count(*) FILTER (WHERE regexp_matches({c}, '^\\s*$'))", "false", "0"
            )
            + f" HAVING count(*) FILTER (WHERE regexp_matches({c}, '^\\s*$')) > 0"
            for c in ("t", "k")
        ]
    )
)
def empty_string_check(spark, sf_dir):
    return flat(C.empty_string_check(events_d(spark, sf_dir), ["*"]))


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_discount < 0.01 OR l_discount > 0.09"
)
def violations_rows(spark, sf_dir):
    found = C.violations(table(spark, sf_dir, "lineitem"), {"column": "l_discount", "min": 0.01, "max": 0.09})
    return found.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT event_id, v, t FROM " + EVENTS_D + " WHERE coalesce(t NOT IN ('click', 'signup'), true)")
def violations_domain_rows(spark, sf_dir):
    rule = {"column": "t", "allowed_values": ["click", "signup"]}
    return C.violations(events_d(spark, sf_dir), rule).select("event_id", "v", "t")


def _group_row(source: str, keys: str, passed: str, threshold: str = "NULL", values: str = "") -> str:
    present = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(","))
    grouped = f"(SELECT {keys}, count(*) AS n{values} FROM {source} WHERE {present} GROUP BY {keys})"
    return (
        f"SELECT 'group_by_check' AS check_type, '{keys}' AS target, CASE WHEN {passed} THEN 'PASS' ELSE 'FAIL' END AS status, "
        f"CAST(min(n) AS DOUBLE) AS observed, CAST({threshold} AS DOUBLE) AS threshold, CAST(sum(n) AS BIGINT) AS row_count FROM {grouped}"
    )


@query(
    union_sql(
        [
            _group_row("orders", "o_orderstatus", "min(n) >= 1", "1"),
            _group_row("orders", "o_orderstatus", "min(n) >= 100000000", "100000000"),
            _group_row(EVENTS_D, "t", "min(n) >= 10", "10"),
            _group_row("lineitem", "l_returnflag,l_linestatus", "max(q) <= 20", values=", avg(l_quantity) AS q"),
        ]
    )
)
def group_check(spark, sf_dir):
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    by_flag = {
        "group_by": ["l_returnflag", "l_linestatus"],
        "metrics": ["count", "avg"],
        "columns": ["l_quantity"],
        "max_avg": 20,
    }
    rules = [{"group_by": ["o_orderstatus"], "min_count": 1}, {"group_by": ["o_orderstatus"], "min_count": 100000000}]
    return union_all(
        [
            flat(G.group_check(orders, rules)),
            flat(G.group_check(events_d(spark, sf_dir), [{"group_by": ["t"], "min_count": 10}])),
            flat(G.group_check(lineitem, [by_flag])),
        ]
    )


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 10")
def group_summary(spark, sf_dir):
    return G.group_summary(table(spark, sf_dir, "orders"), {"group_by": ["o_custkey"]})


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, "
    "round(avg(l_extendedprice), 4) AS avg_l_extendedprice, min(l_extendedprice) AS min_l_extendedprice, "
    "max(l_extendedprice) AS max_l_extendedprice FROM lineitem GROUP BY l_returnflag, l_linestatus"
)
def group_metrics(spark, sf_dir):
    rule = {
        "group_by": ["l_returnflag", "l_linestatus"],
        "metrics": ["count", "sum", "avg", "min", "max"],
        "columns": ["l_extendedprice"],
    }
    found = G.group_metrics(table(spark, sf_dir, "lineitem"), rule)
    return found.withColumns(
        {
            "sum_l_extendedprice": F.round("sum_l_extendedprice", 2),
            "avg_l_extendedprice": F.round("avg_l_extendedprice", 4),
        }
    )


def _cardinality_row(source: str, column: str, passed: str) -> str:
    n = f"(count(DISTINCT {column}) + CAST(bool_or({column} IS NULL) AS INT))"
    return check_row(source, "cardinality_check", column, n, passed.format(n=n))


@query(
    union_sql(
        [
            _cardinality_row("lineitem", "l_returnflag", "{n} >= 3 AND {n} <= 3"),
            _cardinality_row("lineitem", "l_orderkey", "{n} <= 100"),
            _cardinality_row(EVENTS_D, "t", "{n} >= 6"),
            _cardinality_row("documents", "text", "{n} >= 10"),
        ]
    )
)
def cardinality_check(spark, sf_dir):
    lineitem = [
        {"column": "l_returnflag", "min_distinct": 3, "max_distinct": 3},
        {"column": "l_orderkey", "max_distinct": 100},
    ]
    return union_all(
        [
            flat(C.cardinality_check(table(spark, sf_dir, "lineitem"), lineitem)),
            flat(C.cardinality_check(events_d(spark, sf_dir), [{"column": "t", "min_distinct": 6}])),
            flat(C.cardinality_check(table(spark, sf_dir, "documents"), [{"column": "text", "min_distinct": 10}])),
        ]
    )


# The rule set of the flagship query: every kind of check on ``lineitem``.
LINEITEM_RULES = {
    "null_checks": [{"column": "l_orderkey"}, {"column": "l_shipdate", "max_percent": 1}],
    "primary_key": ["l_orderkey", "l_linenumber"],
    "domain_checks": [
        {"column": "l_returnflag", "allowed_values": ["A", "N", "R"]},
        {"column": "l_linestatus", "forbidden_values": ["X"]},
        {"column": "l_returnflag", "regex": "[AN]"},
    ],
    "numeric_checks": [
        {"column": "l_quantity", "min": 1, "max": 50},
        {"column": "l_discount", "max": 0.05},
        {"column": "l_tax", "allow_negative": False},
    ],
    "volume_checks": {"min_rows": 1000},
    "constant_checks": ["*"],
    "empty_string_checks": ["*"],
    "outlier_checks": ["l_extendedprice", "l_quantity"],
    "group_by_checks": [{"group_by": ["l_returnflag"], "min_count": 10}],
}

LINEITEM_SQL = union_sql(
    [
        _null_row("lineitem", "l_orderkey", 0),
        _null_row("lineitem", "l_shipdate", 1),
        _unique_row("lineitem", "l_orderkey,l_linenumber"),
        _mask_row("lineitem", "domain_check", "l_returnflag", "l_returnflag NOT IN ('A', 'N', 'R')"),
        _mask_row("lineitem", "domain_check", "l_linestatus", "l_linestatus IN ('X')"),
        _mask_row("lineitem", "domain_check", "l_returnflag", "NOT regexp_matches(l_returnflag, '^(?:[AN])')"),
        _mask_row("lineitem", "numeric_check", "l_quantity", "l_quantity < 1 OR l_quantity > 50"),
        _mask_row("lineitem", "numeric_check", "l_discount", "l_discount > 0.05"),
        _mask_row("lineitem", "numeric_check", "l_tax", "l_tax < 0"),
        check_row("lineitem", "volume_check", "", "count(*)", "count(*) >= 1000"),
        _group_row("lineitem", "l_returnflag", "min(n) >= 10", "10"),
    ]
    + [
        f"SELECT 'outlier_check', '{c}', 'FAIL', CAST(count(*) FILTER (WHERE abs((x - m) / s) > 3) AS DOUBLE), "
        f"CAST(3 AS DOUBLE), count(*) FROM {_moments('lineitem', c)} HAVING count(*) FILTER (WHERE abs((x - m) / s) > 3) > 0"
        for c in ("l_extendedprice", "l_quantity")
    ]
)


@query(LINEITEM_SQL)
def all_checks(spark, sf_dir):
    return flat(run_checks(table(spark, sf_dir, "lineitem"), LINEITEM_RULES))


@query(
    "SELECT round(100.0 * (count(*) FILTER (WHERE status = 'PASS') + 1) / (count(*) + 1), 2) AS score, "
    "count(*) FILTER (WHERE status = 'PASS') + 1 AS passed_checks, count(*) + 1 AS total_checks "
    f"FROM ({LINEITEM_SQL}) WHERE check_type <> 'group_by_check'"
)
def quality_score(spark, sf_dir):
    return score(run_checks(table(spark, sf_dir, "lineitem"), LINEITEM_RULES), "PASS")


@query(f"SELECT check_type, target, observed FROM ({LINEITEM_SQL}) WHERE status = 'FAIL'")
def failed_checks(spark, sf_dir):
    found = failed(run_checks(table(spark, sf_dir, "lineitem"), LINEITEM_RULES))
    return flat(found).select("check_type", "target", "observed")
