"""Queries of the schema, discovery and scan operators."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalogue.registry import EVENTS_D, events_d, query, table, union_sql
from plumbline.functions.columns import union_all
from plumbline.functions.parsing import MISSING_TOKENS
from plumbline.operators import dates as D
from plumbline.operators import schema as S
from plumbline.operators.distinct import distinct_counts as count_distinct
from plumbline.operators.distinct import key_candidates
from plumbline.operators.duplicates import duplicates
from plumbline.operators.groups import group_distribution as distribute
from plumbline.operators.keys import detect_keys, key_not_run, minimal_keys
from plumbline.operators.stats import dataset_stats as measure
from plumbline.sources.csv import blank_out, typed
from plumbline.sources.load import load_source
from plumbline.sources.sampling import sample_by_key as by_key
from plumbline.sources.sampling import sample_rows as at_random
from plumbline.sources.sampling import smallest_places

# ``orders`` with values written as text, so that every inference rule has a column to find.
ORDERS_T = """(
  SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS whole_double, o_totalprice,
         strftime(o_orderdate, '%Y-%m-%d') AS iso_day, strftime(o_orderdate, '%d/%m/%Y') AS day_first,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS iso_time, CAST(o_custkey AS VARCHAR) AS digits,
         CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS flag_text,
         o_orderstatus = 'F' AS flag, o_orderpriority, 'Order ' || CAST(o_orderkey AS VARCHAR) AS label,
         CASE WHEN o_totalprice < 0 THEN 'x' END AS nothing, o_orderdate
  FROM orders)"""


def orders_t(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("double").alias("whole_double"),
        "o_totalprice",
        F.date_format(day, "yyyy-MM-dd").alias("iso_day"),
        F.date_format(day, "dd/MM/yyyy").alias("day_first"),
        F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("iso_time"),
        F.col("o_custkey").cast("string").alias("digits"),
        F.when(F.col("o_orderstatus") == "F", "true").otherwise("false").alias("flag_text"),
        (F.col("o_orderstatus") == "F").alias("flag"),
        "o_orderpriority",
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("label"),
        F.when(F.col("o_totalprice") < 0, "x").alias("nothing"),
        "o_orderdate",
    )


_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_DATE_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y-%m-%d %H:%M:%S")


def _text_type(c: str) -> str:
    dates = " OR ".join(f"bool_and(try_strptime({c}, '{f}') IS NOT NULL)" for f in _DATE_FORMATS)
    return (
        f"CASE WHEN count({c}) = 0 THEN 'string' "
        f"WHEN bool_and({c} IN ('True', 'False', 'true', 'false', 'T', 'F', '1', '0')) THEN 'boolean' "
        f"WHEN bool_and(regexp_matches({c}, '{_NUMBER}')) THEN 'float' WHEN {dates} THEN 'datetime' "
        f"WHEN count(DISTINCT {c}) < 20 OR count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE) < 0.1 THEN 'categorical' "
        f"ELSE 'string' END"
    )


def _type_row(source: str, column: str, stored: str) -> str:
    rules = {
        "string": _text_type(column),
        "double": f"CASE WHEN bool_and({column} = round({column})) THEN 'integer' ELSE 'float' END",
        "timestamp_ntz": "'datetime'",
        "boolean": "'boolean'",
    }
    rule = rules.get(stored, "'complex'" if "array" in stored else "'integer'")
    scanned = f" FROM {source}" if stored in ("string", "double") else ""
    return f"SELECT '{column}' AS \"column\", '{stored}' AS source_type, {rule} AS inferred_type{scanned}"


def _types(source: str, columns: dict[str, str]) -> str:
    return union_sql([_type_row(source, c, t) for c, t in columns.items()])


DOCUMENT_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
EVENT_TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double",
    "props": "string",
}
ORDERS_T_TYPES = {
    "o_orderkey": "bigint", "whole_double": "double", "o_totalprice": "double", "iso_day": "string",
    "day_first": "string", "iso_time": "string", "digits": "string", "flag_text": "string", "flag": "boolean",
    "o_orderpriority": "string", "label": "string", "nothing": "string", "o_orderdate": "timestamp_ntz",
}
EMBEDDING_TYPES = {"vec_id": "bigint", "embedding": "array<float>", "label": "int"}


def _stored(columns: dict[str, str]) -> str:
    return union_sql([f"SELECT '{c}' AS \"column\", '{t}' AS source_type" for c, t in columns.items()])


@query(_stored(EVENT_TYPES))
def column_types(spark, sf_dir):
    return S.column_types(table(spark, sf_dir, "events"))


@query(_types("documents", DOCUMENT_TYPES) + "\nUNION ALL\n" + _types("events", EVENT_TYPES))
def schema_infer(spark, sf_dir):
    return S.infer_schema(table(spark, sf_dir, "documents")).unionAll(S.infer_schema(table(spark, sf_dir, "events")))


@query(_types("embeddings", EMBEDDING_TYPES))
def schema_infer_complex(spark, sf_dir):
    return S.infer_schema(table(spark, sf_dir, "embeddings"))


@query(_types(ORDERS_T, ORDERS_T_TYPES))
def schema_infer_text(spark, sf_dir):
    return S.infer_schema(orders_t(spark, sf_dir))


EXPECTED = {
    "event_id": "integer", "ts": "datetime", "user_id": "string", "event_type": "categorical", "value": "float",
    "session_id": "string",
}
_DRIFT_SQL = (
    'SELECT coalesce(e.c, a."column") AS "column", e.t AS expected, a.inferred_type AS actual, '
    "CASE WHEN a.\"column\" IS NULL THEN 'missing' WHEN e.c IS NULL THEN 'extra' "
    "WHEN e.t <> a.inferred_type THEN 'type_mismatch' END AS issue "
    f"FROM (VALUES {', '.join(repr(i) for i in EXPECTED.items())}) e(c, t) "
    f'FULL OUTER JOIN ({_types("events", EVENT_TYPES)}) a ON e.c = a."column"'
)


@query(_DRIFT_SQL)
def schema_drift(spark, sf_dir):
    return S.schema_drift(S.infer_schema(table(spark, sf_dir, "events")), EXPECTED)


@query(
    "SELECT count(*) FILTER (WHERE issue = 'missing') AS missing_columns, "
    "count(*) FILTER (WHERE issue = 'extra') AS extra_columns, "
    "count(*) FILTER (WHERE issue = 'type_mismatch') AS type_mismatch_columns, "
    f"CASE WHEN count(*) FILTER (WHERE issue IN ('missing', 'type_mismatch')) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({_DRIFT_SQL})"
)
def schema_status(spark, sf_dir):
    return S.schema_status(S.schema_drift(S.infer_schema(table(spark, sf_dir, "events")), EXPECTED))


@query(f"SELECT issue, \"column\" FROM ({_DRIFT_SQL}) WHERE issue IS NOT NULL")
def schema_differences(spark, sf_dir):
    actual = S.infer_schema(table(spark, sf_dir, "events"))
    kinds = {
        "missing": S.missing_columns(actual, EXPECTED),
        "extra": S.extra_columns(actual, EXPECTED),
        "type_mismatch": S.type_mismatches(actual, EXPECTED),
    }
    return union_all([found.select(F.lit(kind).alias("issue"), "column") for kind, found in kinds.items()])


@query(
    "SELECT count(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns, "
    "CAST(sum(8 + 8 + octet_length(encode(o_orderstatus)) + 8 + 8 + octet_length(encode(o_orderpriority))) AS BIGINT) AS total_bytes FROM orders "
    "UNION ALL SELECT count(*), CAST(5 AS BIGINT), CAST(sum(8 + octet_length(encode(text)) + octet_length(encode(lang)) "
    "+ octet_length(encode(source)) + 8) AS BIGINT) FROM documents"
)
def dataset_stats(spark, sf_dir):
    found = [measure(table(spark, sf_dir, t)) for t in ("orders", "documents")]
    return union_all(found).select("total_rows", "total_columns", "total_bytes")


def _distinct_row(source: str, column: str, ordinal: int) -> str:
    return (
        f"SELECT '{column}' AS \"column\", CAST({ordinal} AS INTEGER) AS ordinal, count(*) AS row_count, "
        f"count(DISTINCT {column}) + CAST(bool_or({column} IS NULL) AS INT) AS distinct_count FROM {source}"
    )


LINEITEM_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
EVENTS_D_COLUMNS = ("event_id", "user_id", "v", "t", "k")


@query(union_sql([_distinct_row("lineitem", c, i) for i, c in enumerate(LINEITEM_COLUMNS)]))
def distinct_counts(spark, sf_dir):
    return count_distinct(table(spark, sf_dir, "lineitem"))


@query(union_sql([_distinct_row(EVENTS_D, c, i) for i, c in enumerate(EVENTS_D_COLUMNS)]))
def distinct_counts_single_scan(spark, sf_dir):
    return count_distinct(events_d(spark, sf_dir), single_scan=True)


def _unique_columns(source: str, columns: tuple[str, ...]) -> str:
    rows = union_sql([_distinct_row(source, c, i) for i, c in enumerate(columns)])
    return f"SELECT '{source}' AS dataset, \"column\" FROM ({rows}) WHERE distinct_count = row_count"


KEY_TABLES = {
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
}


@query(union_sql([_unique_columns(t, c) for t, c in KEY_TABLES.items()]))
def key_single(spark, sf_dir):
    return union_all(
        [key_candidates(table(spark, sf_dir, t)).select(F.lit(t).alias("dataset"), "column") for t in KEY_TABLES]
    )


def _ranked(source: str, columns: tuple[str, ...]) -> str:
    """The columns by falling distinct count, ties in table order."""
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS c, {i} AS place, count(DISTINCT {c}) AS d, count(*) AS n FROM {source}" for i, c in enumerate(columns)
    )
    return f"(SELECT *, row_number() OVER (ORDER BY d DESC, place) AS rank FROM ({rows}))"


def _prefix_row(source: str, columns: tuple[str, ...], size: int) -> str:
    """Distinct rows of the ``size`` leading columns, counted over texts that keep values apart."""
    values = ", ".join(f"struct_pack(c := '{c}', v := CAST({c} AS VARCHAR))" for c in columns)
    chosen = f"(SELECT list(c ORDER BY rank) AS names FROM ranked WHERE rank <= {size})"
    kept = f"list_filter([{values}], lambda x: list_contains(names, x.c))"
    return (
        f"SELECT {size - 1} AS attempt, array_to_string(any_value(names), ',') AS columns, "
        f"count(DISTINCT {kept}) AS distinct_count, count(*) AS row_count FROM {source}, {chosen}"
    )


ORDERS_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _search_sql(source: str, columns: tuple[str, ...]) -> str:
    """All attempts up to and with the first key."""
    attempts = " UNION ALL ".join(_prefix_row(source, columns, size) for size in range(2, 6))
    return (
        f"WITH ranked AS {_ranked(source, columns)}, tried AS ({attempts}) "
        "SELECT CAST(attempt AS INTEGER) AS attempt, columns, distinct_count, row_count, distinct_count = row_count AS is_key FROM tried "
        "WHERE NOT EXISTS (SELECT 1 FROM ranked WHERE d = n) AND attempt <= coalesce("
        "(SELECT min(attempt) FROM tried WHERE distinct_count = row_count), 99)"
    )


@query(_search_sql("lineitem", LINEITEM_COLUMNS))
def key_composite(spark, sf_dir):
    history = detect_keys(table(spark, sf_dir, "lineitem")).history
    return history.withColumn("columns", F.array_join("columns", ","))


@query(
    f"WITH tried AS ({_search_sql('lineitem', LINEITEM_COLUMNS)}), "
    f"singles AS (SELECT * FROM {_ranked('orders', ORDERS_COLUMNS)} WHERE d = n) "
    "SELECT CASE WHEN bool_or(is_key) THEN 'SUCCESS' ELSE 'FAIL' END AS status, CASE WHEN bool_or(is_key) THEN 'COMPOSITE' END AS key_type, "
    "coalesce(max(columns) FILTER (WHERE is_key), '') AS columns, max(distinct_count) FILTER (WHERE is_key) AS distinct_count, "
    "max(row_count) AS row_count FROM tried "
    "UNION ALL SELECT 'SUCCESS', 'SINGLE', string_agg(c, ',' ORDER BY rank), max(d), max(n) FROM singles"
)
def key_search(spark, sf_dir):
    found = [detect_keys(table(spark, sf_dir, t)).key for t in ("lineitem", "orders")]
    return union_all(found).select(
        "status", "key_type", F.array_join("columns", ",").alias("columns"), "distinct_count", "row_count"
    )


def _minimal_sql(source: str, columns: tuple[str, ...], depth: int) -> tuple[str, str]:
    """Minimal keys of at most ``depth`` columns, and the table of all keys, whose sets are counted one by one."""
    sets = [c for size in range(1, depth + 1) for c in combinations(columns, size)]
    rows = " UNION ALL ".join(
        f"SELECT {len(c)} AS size, '{','.join(c)}' AS columns, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} FROM {source})) AS distinct_count"
        for c in sets
    )
    return (
        f"SELECT '{source}' AS dataset, size, columns, distinct_count, distinct_count AS row_count FROM keys_{source} k WHERE NOT EXISTS "
        f"(SELECT 1 FROM keys_{source} o WHERE o.size < k.size AND list_has_all(string_split(k.columns, ','), string_split(o.columns, ',')))",
        f"keys_{source} AS MATERIALIZED (SELECT * FROM ({rows}) WHERE distinct_count = (SELECT count(*) FROM {source}) AND distinct_count > 0)",
    )


MINIMAL_TABLES = {"lineitem": LINEITEM_COLUMNS, "orders": ORDERS_COLUMNS, "conversations": ("conv_id", "turn", "role", "text")}
_MINIMAL = [_minimal_sql(t, c, 3) for t, c in MINIMAL_TABLES.items()]


@query("WITH " + ", ".join(k for _, k in _MINIMAL) + " " + " UNION ALL ".join(q for q, _ in _MINIMAL))
def key_minimal(spark, sf_dir):
    return union_all([
        minimal_keys(table(spark, sf_dir, t)).select(
            F.lit(t).alias("dataset"), "size", F.array_join("columns", ",").alias("columns"), "distinct_count", "row_count"
        ) for t in MINIMAL_TABLES
    ])


def _duplicate_row(label: str, source: str, columns: str) -> str:
    copies = f"(SELECT {columns}, count(*) AS n FROM {source} GROUP BY {columns})"
    return (
        f"SELECT '{label}' AS label, '{columns}' AS columns, CAST(sum(n) AS BIGINT) AS row_count, "
        f"CAST(sum(n) - count(*) AS BIGINT) AS duplicate_count, "
        f"round(100.0 * (sum(n) - count(*)) / sum(n), 2) AS duplicate_percent, 'SUCCESS' AS status FROM {copies}"
    )


def _flat_duplicates(found):
    return found.select(
        "label", F.array_join("columns", ",").alias("columns"), "row_count", "duplicate_count", "duplicate_percent", "status"
    )


@query(
    union_sql(
        [
            _duplicate_row("Include Columns", "documents", "text"),
            _duplicate_row("Include Columns", "lineitem", "l_orderkey,l_linenumber"),
            _duplicate_row("Include Columns", EVENTS_D, "t,k"),
        ]
    )
)
def duplicates_include(spark, sf_dir):
    return _flat_duplicates(
        union_all(
            [
                duplicates(table(spark, sf_dir, "documents"), include=["text", "absent"]),
                duplicates(table(spark, sf_dir, "lineitem"), include=["l_orderkey", "l_linenumber"]),
                duplicates(events_d(spark, sf_dir), include=["t", "k"]),
            ]
        )
    )


@query(
    union_sql(
        [
            _duplicate_row("Exclude Columns", "documents", "text,lang,source,n_chars"),
            _duplicate_row("Exclude Columns", "lineitem", ",".join(LINEITEM_COLUMNS[4:])),
        ]
    )
)
def duplicates_exclude(spark, sf_dir):
    return _flat_duplicates(
        duplicates(table(spark, sf_dir, "documents"), exclude=["doc_id"]).unionAll(
            duplicates(table(spark, sf_dir, "lineitem"), exclude=list(LINEITEM_COLUMNS[:4]))
        )
    )


def _distribution(source: str, columns: tuple[str, ...], total: str) -> str:
    keys = ", ".join(columns)
    shown = " || ' | ' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in columns)
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in columns)
    return (
        f"SELECT * FROM (SELECT '{' | '.join(columns)}' AS columns, {shown} AS values, count(*) AS count, "
        f"round(100.0 * count(*) / (SELECT count(*) FROM {total}), 2) AS percent FROM {source} GROUP BY {keys} "
        f"ORDER BY count(*) DESC, {order} LIMIT 10)"
    )


@query(
    union_sql(
        [
            _distribution(EVENTS_D, ("t",), "events"),
            _distribution("lineitem", ("l_returnflag", "l_linestatus"), "lineitem"),
            _distribution("lineitem", ("l_suppkey",), "lineitem"),
        ]
    )
)
def group_distribution(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return distribute(events_d(spark, sf_dir), "t").unionAll(
        distribute(lineitem, [["l_returnflag", "l_linestatus"], ["absent"], "l_suppkey"])
    )


@query(
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", 'DATETIME' AS kind, max({c}) AS max_date FROM {t}"
            for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
        ]
    )
)
def date_max(spark, sf_dir):
    return union_all([D.date_max(table(spark, sf_dir, t), ["*"]) for t in ("orders", "lineitem", "events")]).drop("unparsed")


@query(
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", 'TEXT' AS kind, max(o_orderdate) AS max_date FROM orders"
            for c in ("iso_day", "day_first", "iso_time")
        ]
    )
)
def date_max_text(spark, sf_dir):
    return D.date_max(orders_t(spark, sf_dir), ["iso_day", "day_first", "iso_time", "o_orderpriority"]).drop("unparsed")


# Days written in eight ways, of which one has values in another format.
ORDERS_WRITTEN = """(
  SELECT strftime(o_orderdate, '%-d %b %Y') AS short_month, strftime(o_orderdate, '%B %-d, %Y') AS long_month,
    strftime(o_orderdate, '%d-%b-%Y') AS dashed, strftime(o_orderdate, '%m/%d/%y') AS two_digits,
    strftime(o_orderdate, '%m/%d/%Y %I:%M %p') AS half_days, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+0000') AS zoned,
    CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed,
    o_orderdate, o_orderkey
  FROM orders)"""
WRITTEN = {
    "short_month": "d MMM yyyy", "long_month": "MMMM d, yyyy", "dashed": "dd-MMM-yyyy", "two_digits": "MM/dd/yy",
    "half_days": "MM/dd/yyyy hh:mm a", "zoned": "yyyy-MM-dd'T'HH:mm:ss'+0000'",
}


def orders_written(spark, sf_dir):
    day = F.col("o_orderdate")
    other = F.when(F.col("o_orderkey") % 7 == 0, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(
        *[F.date_format(day, pattern).alias(c) for c, pattern in WRITTEN.items()], other.alias("mixed"), "o_orderdate"
    )


@query(
    union_sql([
        f"SELECT '{c}' AS \"column\", 'TEXT' AS kind, max(o_orderdate) AS max_date, CAST(0 AS BIGINT) AS unparsed FROM {ORDERS_WRITTEN}"
        for c in WRITTEN
    ] + [
        "SELECT 'mixed', 'TEXT', max(o_orderdate) FILTER (WHERE o_orderkey % 7 <> 0), count(*) FILTER (WHERE o_orderkey % 7 = 0) FROM orders"
    ])
)
def date_unparsed(spark, sf_dir):
    """Latest days of texts written in many ways, and how many values are not of their column's format."""
    return D.date_max(orders_written(spark, sf_dir), [*WRITTEN, "mixed"])


@query(
    union_sql([f"SELECT '{c}' AS \"column\", 'string' AS source_type, 'datetime' AS inferred_type" for c in WRITTEN] + [
        "SELECT 'mixed', 'string', CASE WHEN count(DISTINCT mixed) < 20 OR count(DISTINCT mixed) / CAST(count(mixed) AS DOUBLE) < 0.1 "
        f"THEN 'categorical' ELSE 'string' END FROM {ORDERS_WRITTEN}"
    ])
)
def schema_infer_dates(spark, sf_dir):
    """Types of the same texts; a column in two formats is no date."""
    return S.infer_schema(orders_written(spark, sf_dir).drop("o_orderdate"))


@query(
    "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'UNPARSED' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, count(*) AS count "
    "FROM orders GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM orders WHERE o_orderkey % 7 <> 0"
)
def date_distribution_unparsed(spark, sf_dir):
    """Days of a column in two formats, with what stands in no day."""
    return D.date_distribution_total(orders_written(spark, sf_dir), "mixed")


def _per_day(limit: str = "") -> str:
    return f"SELECT CAST(ts AS DATE) AS date, count(*) AS count FROM events GROUP BY 1 ORDER BY 1 DESC {limit}"


@query(_per_day("LIMIT 10"))
def date_distribution(spark, sf_dir):
    return D.date_distribution(table(spark, sf_dir, "events"), "ts")


@query(_per_day())
def date_distribution_full(spark, sf_dir):
    return D.date_distribution(table(spark, sf_dir, "events"), "ts", None)


@query(
    "SELECT coalesce(CAST(d AS VARCHAR), 'TOTAL') AS date, count(*) AS count "
    "FROM (SELECT CAST(ts AS DATE) AS d FROM events) GROUP BY ROLLUP (d)"
)
def date_distribution_total(spark, sf_dir):
    return D.date_distribution_total(table(spark, sf_dir, "events"), "ts")


@query(
    "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F' "
    "ORDER BY o_orderkey LIMIT 100"
)
def scan_limit(spark, sf_dir):
    # The limit is the feature here: the row limit of a scan, made deterministic by an order.
    source = {
        "type": "parquet",
        "file": f"{sf_dir.rstrip('/')}/orders.parquet",
        "columns": ["o_orderkey", "o_totalprice", "o_orderpriority"],
        "where": "o_totalprice > 250000 AND o_orderstatus = 'F'",
        "order_by": ["o_orderkey"],
        "limit": 100,
    }
    return load_source(spark, source)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice < 100000 AND o_orderpriority LIKE '1%'")
def scan_filtered(spark, sf_dir):
    source = {
        "type": "parquet",
        "file": f"{sf_dir.rstrip('/')}/orders.parquet",
        "columns": ["o_orderkey", "o_custkey", "o_totalprice"],
        "where": "o_totalprice < 100000 AND o_orderpriority LIKE '1%'",
    }
    return load_source(spark, source)


@query("SELECT count(*) AS sampled, count(DISTINCT o_orderkey) AS different FROM (SELECT o_orderkey FROM orders LIMIT 500)")
def sample_rows(spark, sf_dir):
    # The operator is a sample: its size and the absence of repeats are what can be compared.
    return at_random(table(spark, sf_dir, "orders"), 500).agg(
        F.count(F.lit(1)).alias("sampled"), F.count_distinct("o_orderkey").alias("different")
    )


@query(
    "SELECT count(*) AS sampled, count(DISTINCT o_orderkey) AS different, true AS repeats FROM (SELECT o_orderkey FROM orders LIMIT 500)"
)
def sample_by_key(spark, sf_dir):
    """Size and absence of repeats, and whether another order of the rows gives the same sample."""
    orders = table(spark, sf_dir, "orders")
    digest = lambda df: df.agg(F.sum(F.xxhash64("o_orderkey").cast("decimal(20,0)")))
    found = by_key(orders, ["o_orderkey"], 500)
    again = by_key(orders.orderBy(F.desc("o_totalprice")), ["o_orderkey"], 500)
    return found.agg(
        F.count(F.lit(1)).alias("sampled"), F.count_distinct("o_orderkey").alias("different"),
        (F.sum(F.xxhash64("o_orderkey").cast("decimal(20,0)")) == digest(again).scalar()).alias("repeats"),
    )


_TEXT_ORDERS = """(
  SELECT CAST(9000000000000000000 + o_orderkey AS VARCHAR) AS id19, CAST(o_orderkey AS VARCHAR) || '00000000000000000000' AS id25,
    CASE WHEN o_orderstatus = 'O' THEN 'NA' ELSE CAST(o_custkey AS VARCHAR) END AS gaps,
    CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'False' END AS flag, 'n/a' AS nothing, CAST(o_orderpriority AS VARCHAR) AS word
  FROM orders)"""


def _typed_sql(c: str, kind: str, sql: str) -> str:
    known = f"CASE WHEN {c} IN ('NA', 'n/a') THEN NULL ELSE {c} END"
    return (
        f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count({known}) AS known, count(DISTINCT {known}) AS different, "
        f"CAST(max(CAST({known} AS {sql})) AS VARCHAR) AS largest FROM {_TEXT_ORDERS}"
    )


@query(union_sql([
    _typed_sql("id19", "bigint", "BIGINT"), _typed_sql("id25", "decimal(38,0)", "HUGEINT"), _typed_sql("gaps", "bigint", "BIGINT"),
    _typed_sql("flag", "boolean", "BOOLEAN"), _typed_sql("nothing", "string", "VARCHAR"), _typed_sql("word", "string", "VARCHAR"),
]))
def text_typing(spark, sf_dir):
    """Missing tokens and types of a table that is all text, as the CSV source treats it."""
    orders = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    text = orders.select(
        (F.col("o_orderkey") + 9000000000000000000).cast("string").alias("id19"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("0" * 20)).alias("id25"),
        F.when(status == "O", "NA").otherwise(F.col("o_custkey").cast("string")).alias("gaps"),
        F.when(status == "F", "true").otherwise("False").alias("flag"),
        F.lit("n/a").alias("nothing"), F.col("o_orderpriority").alias("word"),
    )
    found = typed(blank_out(text, list(MISSING_TOKENS)))
    return union_all([
        found.agg(
            F.lit(c).alias("column"), F.lit(t).alias("kind"), F.count(c).alias("known"), F.count_distinct(c).alias("different"),
            F.max(c).cast("string").alias("largest"),
        )
        for c, t in found.dtypes
    ])


@query(
    "SELECT 'none' AS dataset, 'NOT_RUN' AS status, CAST(NULL AS BIGINT) AS row_count FROM orders HAVING count(*) > 0 "
    "UNION ALL SELECT 'empty', 'SKIPPED', count(*) FROM orders WHERE o_orderkey < 0 "
    "UNION ALL SELECT 'repeated', CASE WHEN count(*) = (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)) "
    "THEN 'SUCCESS' ELSE 'FAIL' END, count(*) FROM orders "
    "UNION ALL SELECT 'unlimited', CASE WHEN count(*) = (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) "
    "THEN 'SUCCESS' ELSE 'FAIL' END, count(*) FROM lineitem"
)
def key_outcomes(spark, sf_dir):
    """Searches that do not run, have no rows, find nothing, and go as deep as there are columns; metadata is ignored."""
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    few = orders.select("o_orderstatus", "o_orderpriority", F.col("o_orderkey").alias("DH_Upload"))
    found = {
        "none": key_not_run(orders).key, "empty": detect_keys(orders.where("o_orderkey < 0")).key,
        "repeated": detect_keys(few).key, "unlimited": detect_keys(lineitem, max_columns=None).key,
    }
    return union_all([df.select(F.lit(name).alias("dataset"), "status", "row_count") for name, df in found.items()])


@query(
    "SELECT count(*) AS sampled, CAST(sum(place) AS VARCHAR) AS places FROM ("
    "SELECT ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT AS place FROM orders ORDER BY place LIMIT 700)"
)
def sample_smallest_places(spark, sf_dir):
    """The sample is the rows with the smallest places, here those of a digest that SQL knows, too."""
    place = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 15), 16, 10).cast("bigint")
    found = smallest_places(table(spark, sf_dir, "orders"), place, 700)
    return found.agg(F.count(F.lit(1)).alias("sampled"), F.sum(place.cast("decimal(28,0)")).cast("string").alias("places"))
