"""Result tables by run, published at once, with a view of the latest run, and JSON documents.

A run writes its tables to a folder of its own and then one manifest, a small JSON file that names the folder and the
tables. The manifest is written beside its place and renamed, so a reader finds the whole run or nothing of it; what
a run that died has left is in no manifest. Writing a run again makes a new folder, to which the renamed manifest points.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_FORMAT = "%Y-%m-%d_%Hh%Mm%Ss"
MANIFESTS, DATA = "manifests", "data"


def run_id(at: datetime | None = None) -> str:
    """A name that sorts by time, to the second, and differs between runs of the same second."""
    return f"{(at or datetime.now()).strftime(RUN_FORMAT)}-{uuid.uuid4().hex[:6]}"


def _publish(spark: SparkSession, folder: str, run: str, content: dict) -> None:
    """Puts the manifest in its place by a rename that replaces an older one."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{folder}/{run}.json")
    beside = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{run}-{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    out = place.getFileSystem(conf).create(beside)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(beside, place, options)


def write_results(tables: dict[str, DataFrame], path: str, run: str, fmt: str = "parquet") -> None:
    """Writes all tables of a run and publishes them together, in place of what the run has published before."""
    if not tables:
        return
    spark, root = next(iter(tables.values())).sparkSession, path.rstrip("/")
    folder = f"{DATA}/{run}-{uuid.uuid4().hex[:6]}"
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run)).write.format(fmt).save(f"{root}/{folder}/{name}")
    schemas = {name: df.withColumn("run_id", F.lit(run)).schema.jsonValue() for name, df in tables.items()}
    _publish(spark, f"{root}/{MANIFESTS}", run, {"run": run, "folder": folder, "tables": schemas})


def published_runs(spark: SparkSession, path: str) -> list[dict]:
    """The manifests of all published runs, latest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MANIFESTS}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    # One small file per run; names with a leading dot are not read.
    rows = spark.read.text(f"{path.rstrip('/')}/{MANIFESTS}", wholetext=True, pathGlobFilter="*.json").collect()
    return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["run"], reverse=True)


def read_run(spark: SparkSession, path: str, name: str, run: str | None = None, fmt: str = "parquet") -> DataFrame:
    """One result table of a run; of the latest run if none is named.

    A table that the run did not write has no rows, and the columns it had in the latest run that wrote it.
    """
    runs = published_runs(spark, path)
    chosen = next((m for m in runs if run is None or m["run"] == run), None)
    writer = chosen if chosen and name in chosen["tables"] else next((m for m in runs if name in m["tables"]), None)
    if writer is None:
        raise KeyError(f"no published run has a table {name!r}")
    schema = T.StructType.fromJson(writer["tables"][name])
    if writer is not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).load(f"{path.rstrip('/')}/{chosen['folder']}/{name}")


def results_document(dataset: str, check_results: DataFrame, score: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """One row with one JSON text: dataset, score, checks and, if given, schema differences."""
    # Bounded by the number of rules and columns, not by the data.
    row = F.struct(
        "check_type", "target", "status", "observed", "threshold", "row_count", F.to_json("details").alias("details")
    )
    checks = check_results.agg(F.sort_array(F.collect_list(row))).scalar()
    parts = [F.lit(dataset).alias("dataset"), F.col("score").alias("data_quality_score"), checks.alias("checks")]
    if drift is not None:
        differing = drift.where(F.col("issue").isNotNull())
        listed = differing.agg(F.sort_array(F.collect_list(F.struct("issue", "column", "expected", "actual"))).alias("v"))
        parts.append(listed.scalar().alias("schema_drift"))
    return score.select(F.to_json(F.struct(*parts)).alias("document"))


def metrics_document(check_results: DataFrame, score: DataFrame) -> DataFrame:
    """One row with one JSON text: score and failed checks."""
    failed = check_results.where(F.col("status") == "FAIL").agg(
        F.sort_array(F.collect_list(F.struct("check_type", "target", "status", "observed", "threshold"))).alias("v")
    )
    return score.select(F.to_json(F.struct("score", failed.scalar().alias("failed_checks"))).alias("document"))


def write_document(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").text(path)
