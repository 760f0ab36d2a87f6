"""Queries of the distribution drift tests."""

from __future__ import annotations

from catalogue.registry import query, rounded, table, union_sql
from plumbline.functions.columns import union_all
from plumbline.operators import drift as R

EVENTS_SPLIT = ("(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16')", "(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16')")
LANG_SPLIT = ("(SELECT * FROM documents WHERE lang = 'de')", "(SELECT * FROM documents WHERE lang = 'en')")
QUANTITY_SPLIT = ("(SELECT * FROM lineitem WHERE l_quantity <= 30)", "(SELECT * FROM lineitem WHERE l_quantity > 20)")
LABEL_SPLIT = ("(SELECT * FROM labels WHERE quality = 0)", "(SELECT * FROM labels WHERE quality = 1)")
SHIP_SPLIT = (
    "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')",
    "(SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')",
)


def split(df, condition):
    return df.where(condition), df.where(f"NOT ({condition})")


def events_split(spark, sf_dir):
    return split(table(spark, sf_dir, "events"), "ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'")


def lang_split(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.where("lang = 'de'"), documents.where("lang = 'en'")


def quantity_split(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.where("l_quantity <= 30"), lineitem.where("l_quantity > 20")


def label_split(spark, sf_dir):
    return split(table(spark, sf_dir, "labels"), "quality = 0")


def ship_split(spark, sf_dir):
    return split(table(spark, sf_dir, "lineitem"), "l_shipdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'")


def _number(c: str) -> str:
    return f"epoch_us({c})" if c == "l_shipdate" else c


def _counts(sides: tuple[str, str], c: str, kind: str = "DOUBLE") -> str:
    c = _number(c) if kind == "DOUBLE" else c
    return (
        f"(SELECT value, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(c) AS DOUBLE) AS c FROM ("
        f"SELECT CAST({c} AS {kind}) AS value, 1 AS b, 0 AS c FROM {sides[0]} UNION ALL "
        f"SELECT CAST({c} AS {kind}), 0, 1 FROM {sides[1]}) GROUP BY value)"
    )


def _cumulative(sides: tuple[str, str], c: str) -> str:
    return (
        f"(SELECT abs(sum(b) OVER w / sum(b) OVER () - sum(c) OVER w / sum(c) OVER ()) AS gap, "
        f"lead(value) OVER w - value AS width FROM {_counts(sides, c)} WINDOW w AS (ORDER BY value))"
    )


def _shares(sides: tuple[str, str], c: str) -> str:
    return (
        f"(SELECT b, c, sum(b) OVER () AS nb, sum(c) OVER () AS nc, value FROM {_counts(sides, c, 'VARCHAR')})"
    )


def _ks(sides, c):
    return f"(SELECT max(gap) FROM {_cumulative(sides, c)})"


def _wasserstein(sides, c):
    return (
        f"((SELECT coalesce(sum(gap * width), 0) FROM {_cumulative(sides, c)}) / "
        f"(SELECT greatest(stddev_pop(CAST({_number(c)} AS DOUBLE)), 0.001) FROM {sides[0]}))"
    )


def _chi_square(sides, c):
    e_b, e_c = "((b + c) * nb / (nb + nc))", "((b + c) * nc / (nb + nc))"
    return f"(SELECT sum(power(b - {e_b}, 2) / {e_b} + power(c - {e_c}, 2) / {e_c}) FROM {_shares(sides, c)})"


def _proportion_z(sides, c):
    pooled = "((hb + hc) / (nb + nc))"
    return (
        f"(SELECT abs(hb / nb - hc / nc) / sqrt({pooled} * (1 - {pooled}) * (1 / nb + 1 / nc)) FROM "
        f"(SELECT arg_max(b, value) AS hb, arg_max(c, value) AS hc, any_value(nb) AS nb, any_value(nc) AS nc FROM {_shares(sides, c)}))"
    )


def _jensen_shannon(sides, c):
    p, q = "(b / nb)", "(c / nc)"
    m = f"(({p} + {q}) / 2)"
    return (
        f"(SELECT sqrt(greatest(sum(CASE WHEN b > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + "
        f"CASE WHEN c > 0 THEN {q} * log2({q} / {m}) ELSE 0 END) / 2, 0)) FROM {_shares(sides, c)})"
    )


_SQL = {
    "ks": _ks, "wasserstein": _wasserstein, "chi_square": _chi_square, "proportion_z": _proportion_z,
    "jensen_shannon": _jensen_shannon,
}


def _row(sides: tuple[str, str], column: str, test: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", '{test}' AS test, round({_SQL[test](sides, column)}, 6) AS statistic, "
        f"(SELECT count(*) FROM {sides[0]}) AS baseline_rows, (SELECT count(*) FROM {sides[1]}) AS current_rows"
    )


def _shown(found):
    return rounded(found.select("column", "test", "statistic", "baseline_rows", "current_rows"))


@query(union_sql([_row(EVENTS_SPLIT, "value", "ks"), _row(LANG_SPLIT, "n_chars", "ks"), _row(SHIP_SPLIT, "l_extendedprice", "ks")]))
def drift_ks(spark, sf_dir):
    return _shown(
        union_all(
            [
                R.kolmogorov_smirnov(*events_split(spark, sf_dir), "value"),
                R.kolmogorov_smirnov(*lang_split(spark, sf_dir), "n_chars"),
                R.kolmogorov_smirnov(*ship_split(spark, sf_dir), "l_extendedprice"),
            ]
        )
    )


@query(union_sql([_row(LANG_SPLIT, "n_chars", "wasserstein"), _row(QUANTITY_SPLIT, "l_quantity", "wasserstein")]))
def drift_wasserstein(spark, sf_dir):
    return _shown(
        R.wasserstein(*lang_split(spark, sf_dir), "n_chars").unionAll(
            R.wasserstein(*quantity_split(spark, sf_dir), "l_quantity")
        )
    )


@query(union_sql([_row(LANG_SPLIT, "source", "jensen_shannon"), _row(EVENTS_SPLIT, "event_type", "jensen_shannon")]))
def drift_js(spark, sf_dir):
    return _shown(
        R.jensen_shannon(*lang_split(spark, sf_dir), "source").unionAll(
            R.jensen_shannon(*events_split(spark, sf_dir), "event_type")
        )
    )


@query(union_sql([_row(LANG_SPLIT, "source", "chi_square"), _row(EVENTS_SPLIT, "event_type", "chi_square")]))
def drift_chi2(spark, sf_dir):
    return _shown(
        R.chi_square(*lang_split(spark, sf_dir), "source").unionAll(
            R.chi_square(*events_split(spark, sf_dir), "event_type")
        )
    )


@query(union_sql([_row(LABEL_SPLIT, "toxic", "proportion_z"), _row(SHIP_SPLIT, "l_linestatus", "proportion_z")]))
def drift_prop_z(spark, sf_dir):
    return _shown(
        R.proportion_z(*label_split(spark, sf_dir), "toxic").unionAll(
            R.proportion_z(*ship_split(spark, sf_dir), "l_linestatus")
        )
    )


# Distances: every verdict is one of at least 0.1.
SHIP_TESTS = {
    "l_discount": "wasserstein", "l_extendedprice": "wasserstein", "l_linenumber": "wasserstein",
    "l_linestatus": "jensen_shannon", "l_orderkey": "wasserstein", "l_partkey": "wasserstein", "l_quantity": "wasserstein",
    "l_returnflag": "jensen_shannon", "l_shipdate": "wasserstein", "l_suppkey": "wasserstein", "l_tax": "wasserstein",
}
_SHIP_SQL = union_sql(
    [
        f"SELECT '{c}' AS \"column\", '{t}' AS test, round({_SQL[t](SHIP_SPLIT, c)}, 6) AS statistic, "
        f"CAST(NULL AS DOUBLE) AS p_value, CAST(0.1 AS DOUBLE) AS threshold, {_SQL[t](SHIP_SPLIT, c)} >= 0.1 AS drifted"
        for c, t in SHIP_TESTS.items()
    ]
)


def _ship_drift(spark, sf_dir):
    return R.data_drift(*ship_split(spark, sf_dir))


@query(_SHIP_SQL)
def drift_columns(spark, sf_dir):
    return rounded(_ship_drift(spark, sf_dir).columns)


@query(
    "SELECT 'SUCCESS' AS status, count(*) AS compared_columns, count(*) FILTER (WHERE drifted) AS number_of_drifted_columns, "
    "count(*) FILTER (WHERE drifted) / CAST(count(*) AS DOUBLE) AS share_of_drifted_columns, "
    f"count(*) FILTER (WHERE drifted) / CAST(count(*) AS DOUBLE) >= 0.5 AS dataset_drift FROM ({_SHIP_SQL})"
)
def drift_summary(spark, sf_dir):
    return _ship_drift(spark, sf_dir).summary


# Hypothesis tests. The p-value of the Kolmogorov distribution is
# a series; the two-sided normal one is not available in SQL, so only the statistic is compared.
@query(
    f"SELECT 'doc_id' AS \"column\", 'ks' AS test, round({_ks(LABEL_SPLIT, 'doc_id')}, 6) AS statistic "
    f"UNION ALL SELECT 'quality', 'proportion_z', round({_proportion_z(LABEL_SPLIT, 'quality')}, 6) "
    f"UNION ALL SELECT 'toxic', 'proportion_z', round({_proportion_z(LABEL_SPLIT, 'toxic')}, 6)"
)
def drift_columns_small(spark, sf_dir):
    found = R.data_drift(*label_split(spark, sf_dir), tests="hypotheses").columns
    return rounded(found.select("column", "test", "statistic"))


@query(
    f"SELECT 'doc_id' AS \"column\", round(least(1, greatest(0, 2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * l * l)))), 6) AS p_value "
    f"FROM (SELECT {_ks(LABEL_SPLIT, 'doc_id')} * sqrt((SELECT count(*) FROM {LABEL_SPLIT[0]}) * (SELECT count(*) FROM {LABEL_SPLIT[1]}) "
    "/ CAST((SELECT count(*) FROM labels) AS DOUBLE)) AS l), range(1, 101) r(k)"
)
def drift_ks_p_value(spark, sf_dir):
    found = R.data_drift(*label_split(spark, sf_dir), tests="hypotheses").columns.where("column = 'doc_id'")
    return rounded(found.select("column", "p_value"))
