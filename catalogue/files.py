"""Queries that write a given table as files, read them back as a source, and publish results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import check_row, flat, query, table, union_sql
from plumbline.operators import checks as C
from plumbline.operators import results as R
from plumbline.operators.stats import dataset_stats as measure
from plumbline.plans.run import run_checks
from plumbline.sources import sinks
from plumbline.sources.csv import read_csv
from plumbline.sources.load import infer_source_schema, load_source
from plumbline.sources.staging import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors reach; a temporary one on a local master only."""
    folder = shared_folder(spark)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='plumbline-')).rstrip('/')}/files-{uuid.uuid4().hex}"


def quoted(c: str):
    """A field in quotes, those inside it twice."""
    return F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))


def written(df: DataFrame, fields: list, header: str, sep: str) -> str:
    """The rows as text files with a header line each."""
    path = scratch(df.sparkSession)
    lines = df.select(F.concat_ws(sep, *fields).alias("line"))
    # Every file starts with the header, as files of one source do.
    parts = lines.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part")
    parts.mapInArrow(lambda batches: _headed(batches, header), "line string").write.text(path)
    return path


def _headed(batches, header: str):
    import pyarrow as pa

    first = True
    for batch in batches:
        lines = batch["line"].to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([header] * first + lines, pa.string())], ["line"])
        first = False


# A size with an inch mark, and a note with quotes, delimiters and a line break.
_ORDERS_NOTED = """(
  SELECT o_orderkey, o_totalprice, o_orderpriority, CAST(o_orderkey % 12 AS VARCHAR) || '" pipe' AS size,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'say "' || o_orderstatus || '", twice'
      WHEN 2 THEN o_orderstatus || chr(10) || '"line" two' ELSE 'plain' END AS note
  FROM orders)"""


def orders_noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    note = (
        F.when(key % 4 == 1, F.concat(F.lit('say "'), "o_orderstatus", F.lit('", twice')))
        .when(key % 4 == 2, F.concat("o_orderstatus", F.lit('\n"line" two')))
        .when(key % 4 == 3, "plain")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", F.concat((key % 12).cast("string"), F.lit('" pipe')).alias("size"), note.alias("note")
    )


def noted_file(spark: SparkSession, sf_dir: str, sep: str) -> str:
    fields = [F.col(c).cast("string") for c in ("o_orderkey", "o_totalprice", "o_orderpriority", "size")]
    note = F.coalesce(quoted("note"), F.lit("N/A"))
    return written(orders_noted(spark, sf_dir), [*fields, note], sep.join(("o_orderkey", "o_totalprice", "o_orderpriority", "size", "note")), sep)


@query(f"SELECT * FROM {_ORDERS_NOTED}")
def csv_scan(spark, sf_dir):
    """A file whose delimiter, types, missing tokens and quoted line breaks are found by looking at it."""
    return read_csv(spark, noted_file(spark, sf_dir, ";"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, nullif(size, '0\" pipe') AS size FROM {_ORDERS_NOTED}")
def csv_options(spark, sf_dir):
    """The same file with named options: columns, types and a further missing token."""
    return read_csv(
        spark, noted_file(spark, sf_dir, "|"), sep="|", usecols=["o_orderkey", "size"], dtype={"o_orderkey": "str"},
        na_values=['0" pipe'], multiline=True,
    )


@query(f"SELECT o_orderkey, note FROM {_ORDERS_NOTED} WHERE o_totalprice > 200000 AND note IS NOT NULL")
def csv_source_filtered(spark, sf_dir):
    """Columns and rows of a file through the source description."""
    return load_source(
        spark,
        {"type": "csv", "file": noted_file(spark, sf_dir, ","), "columns": ["o_orderkey", "note"], "where": "o_totalprice > 200000 AND note IS NOT NULL"},
    )


@query(
    "SELECT 'o_orderkey' AS \"column\", 'bigint' AS source_type, 'integer' AS inferred_type UNION ALL "
    "SELECT 'o_totalprice', 'double', 'float' UNION ALL SELECT 'o_orderpriority', 'string', 'categorical' UNION ALL "
    "SELECT 'size', 'string', 'categorical' UNION ALL SELECT 'note', 'string', 'categorical'"
)
def csv_schema(spark, sf_dir):
    """Types of a file by the entry that only infers."""
    return infer_source_schema(spark, "csv", noted_file(spark, sf_dir, ";"))


_PUBLISHED = union_sql([
    check_row("orders", "null_check", c, f"100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)", f"count({c}) = count(*)", "0")
    for c in ("o_orderkey", "o_totalprice")
])


@query(_PUBLISHED)
def published_run(spark, sf_dir):
    """Results as the latest published run gives them, after an older one and one that has another table."""
    path, orders = scratch(spark), table(spark, sf_dir, "orders")
    sinks.write_results({"checks": C.null_check(orders, [{"column": "o_custkey"}])}, path, "2024-01-01_00h00m00s")
    found = C.null_check(orders, [{"column": "o_orderkey"}, {"column": "o_totalprice"}])
    sinks.write_results({"checks": found, "schema": measure(orders)}, path, "2024-01-02_00h00m00s")
    return flat(sinks.read_run(spark, path, "checks").drop("run_id"))


@query(
    "SELECT 'documents' AS dataset, round(100.0 * (2 + (count(lang) = count(*))::INT) / 4, 2) AS score, "
    "CAST(3 AS BIGINT) AS checks, CAST(1 + (count(lang) <> count(*))::INT AS BIGINT) AS failed FROM documents"
)
def result_documents(spark, sf_dir):
    """What the two JSON documents of a run say."""
    rules = {"null_checks": [{"column": c} for c in ("doc_id", "lang")], "numeric_checks": [{"column": "n_chars", "max": -1}]}
    checks = run_checks(table(spark, sf_dir, "documents"), rules)
    score = R.score(checks)
    whole, metrics = sinks.results_document("documents", checks, score), sinks.metrics_document(checks, score)
    failed = metrics.select(F.json_array_length(F.get_json_object("document", "$.failed_checks"))).scalar()
    return whole.select(
        F.get_json_object("document", "$.dataset").alias("dataset"),
        F.get_json_object("document", "$.data_quality_score").cast("double").alias("score"),
        F.json_array_length(F.get_json_object("document", "$.checks")).cast("bigint").alias("checks"), failed.cast("bigint").alias("failed"),
    )


@query(
    "SELECT count(*) AS total_rows, round(sum(8 + 8 + octet_length(encode(o_orderstatus)) + 8 + 8 + octet_length(encode(o_orderpriority))) / 1024.0 ** 3, 9) AS total_gb, "
    "round(sum(8 + 8 + octet_length(encode(o_orderstatus)) + 8 + 8 + octet_length(encode(o_orderpriority))) / 1024.0 ** 4, 12) AS total_tb FROM orders"
)
def dataset_sizes(spark, sf_dir):
    return measure(table(spark, sf_dir, "orders")).select("total_rows", F.round("total_gb", 9).alias("total_gb"), F.round("total_tb", 12).alias("total_tb"))
