"""One call from a rule description to result tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import WILDCARD, union_all
from plumbline.operators import checks as C
from plumbline.operators.dates import SHOWN_DAYS, date_distribution, date_fields, date_max
from plumbline.operators.drift import Drift, data_drift
from plumbline.operators.duplicates import duplicates
from plumbline.operators.groups import SHOWN_GROUPS, group_check, group_distribution
from plumbline.operators.keys import KeySearch, detect_keys, key_not_run
from plumbline.operators.outliers import outlier_check
from plumbline.operators.results import RESULT_SCHEMA, no_results, score
from plumbline.operators.schema import infer_schema, schema_drift, schema_status
from plumbline.operators.stats import dataset_stats
from plumbline.sources.load import dataset_name, is_row_source, load_source
from plumbline.sources.staging import release, stage


def run_checks(df: DataFrame, validations: dict[str, Any], dataset: str = "") -> DataFrame:
    """Every configured check. All plain counts share one pass; keys and groups shuffle on their own."""
    v = validations
    probes: list[C.Probe] = []
    probes += C.null_probes(df, v.get("null_checks") or [], dataset)
    probes += C.domain_probes(df, v.get("domain_checks") or [], dataset)
    probes += C.numeric_probes(df, v.get("numeric_checks") or [], dataset)
    if "volume_checks" in v:
        bounds = v["volume_checks"] or {}
        probes += C.volume_probes(bounds.get("min_rows"), bounds.get("max_rows"), dataset)
    probes += C.constant_probes(df, v.get("constant_checks") or [], dataset)
    probes += C.empty_string_probes(df, v.get("empty_string_checks") or [], dataset)
    parts = [C.evaluate(df, probes)] if probes else []
    if v.get("primary_key"):
        parts.append(C.uniqueness_check(df, v["primary_key"], dataset))
    if v.get("cardinality_checks"):
        parts.append(C.cardinality_check(df, v["cardinality_checks"], dataset))
    if v.get("outlier_checks"):
        parts.append(outlier_check(df, v["outlier_checks"], dataset=dataset))
    if v.get("group_by_checks"):
        parts.append(group_check(df, v["group_by_checks"], dataset))
    return union_all(parts) if parts else no_results(df.sparkSession)


def with_default_rules(df: DataFrame, validations: dict[str, Any]) -> dict[str, Any]:
    """A null check of every column where neither null, group nor schema rules are given."""
    if any(validations.get(k) for k in ("null_checks", "group_by_checks", "schema")):
        return validations
    return {**validations, "null_checks": C.default_null_rules(df)}


@dataclass
class Discovery:
    stats: DataFrame
    keys: KeySearch
    duplicates: DataFrame | None = None
    groups: DataFrame | None = None
    date_max: DataFrame | None = None
    date_distribution: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        found = {
            "stats": self.stats,
            "key": self.keys.key,
            "key_history": self.keys.history,
            "distinct_counts": self.keys.counts,
            "duplicates": self.duplicates,
            "groups": self.groups,
            "date_max": self.date_max,
            "date_distribution": self.date_distribution,
        }
        return {k: t for k, t in found.items() if t is not None}


def run_discovery(df: DataFrame, config: dict[str, Any], single_scan: bool = False) -> Discovery:
    """Size, keys, duplicates, group distributions and dates, as configured.

    ``shown_groups`` and ``shown_days`` (None: all) set the length of the lists.
    """
    if config.get("detect_keys"):
        keys = detect_keys(df, max_columns=config.get("max_key_columns", 5), single_scan=single_scan)
    else:
        keys = key_not_run(df, single_scan)
    found = Discovery(dataset_stats(df), keys)
    repeated = []
    if config.get("dedupIncludeColumns"):
        repeated.append(duplicates(df, include=config["dedupIncludeColumns"]))
    if config.get("dedupExcludeColumns"):
        repeated.append(duplicates(df, exclude=config["dedupExcludeColumns"]))
    if repeated:
        found.duplicates = union_all(repeated)
    if config.get("group_by"):
        found.groups = group_distribution(df, config["group_by"], config.get("shown_groups", SHOWN_GROUPS))
    wanted = config.get("date_analysis")
    if wanted:
        columns = wanted if isinstance(wanted, list) else [WILDCARD]
        fields = date_fields(df, columns)
        found.date_max = date_max(df, columns)
        if fields:
            found.date_distribution = union_all(
                [
                    date_distribution(df, f.name, config.get("shown_days", SHOWN_DAYS)).select(F.lit(f.name).alias("column"), "date", "count")
                    for f in fields
                ]
            )
    return found


@dataclass
class QualityRun:
    """Result tables of one run; ``score`` has one row, ``checks`` one per check."""

    dataset: str
    schema: DataFrame
    schema_drift: DataFrame | None
    schema_status: str
    checks: DataFrame
    score: DataFrame
    discovery: Discovery
    drift: Drift | None = None
    drift_status: str = "NOT_RUN"
    messages: list[str] = field(default_factory=list)
    staged: list[str] = field(default_factory=list)

    def release(self) -> None:
        """Removes the staged copies; call it when the result tables have been read or written."""
        while self.staged:
            release(self.schema.sparkSession, self.staged.pop())

    def tables(self) -> dict[str, DataFrame]:
        found = {"schema": self.schema, "checks": self.checks, "score": self.score, **self.discovery.tables()}
        if self.schema_drift is not None:
            found["schema_drift"] = self.schema_drift
        if self.drift is not None:
            found["data_drift"] = self.drift.columns
            found["data_drift_summary"] = self.drift.summary
        return found


def _load(spark: SparkSession, source: dict[str, Any], staged: list[str]) -> DataFrame:
    df = load_source(spark, source)
    if not is_row_source(source):
        return df
    df, path = stage(df)
    if path:
        staged.append(path)
    return df


def run_rules(spark: SparkSession, config: dict[str, Any], df: DataFrame | None = None) -> QualityRun:
    """Loads the source, infers and compares the schema, runs checks, discovery and drift.

    ``config`` has the sections ``source``, ``validations``, ``discovery`` and ``reference``, and ``drift_tests``
    as in :func:`plumbline.operators.drift.data_drift`. Staged copies are removed if the run fails.
    ``df`` replaces the source. A drift that cannot be computed does not stop the run.
    """
    staged: list[str] = []
    try:
        return _run(spark, config, df, staged)
    except BaseException:
        while staged:
            release(spark, staged.pop())
        raise


def _run(spark: SparkSession, config: dict[str, Any], df: DataFrame | None, staged: list[str]) -> QualityRun:
    source = config.get("source", {})
    data = _load(spark, source, staged) if df is None else df
    by_column = bool(staged) or not is_row_source(source)
    dataset = dataset_name(source)
    validations = config.get("validations") or {}
    schema = infer_schema(data)

    expected = (validations.get("schema") or {}).get("expected_columns")
    drifted, status = None, "PASS"
    if expected:
        drifted = schema_drift(schema, expected)
        status = schema_status(drifted).first()["status"]

    # One row per check: brought in once, so that the score does not run the checks again.
    found = run_checks(data, with_default_rules(data, validations), dataset).collect()
    checks = spark.createDataFrame(found, RESULT_SCHEMA)
    run = QualityRun(
        dataset=dataset,
        schema=schema,
        schema_drift=drifted,
        schema_status=status,
        checks=checks,
        score=score(checks, status),
        discovery=run_discovery(data, config.get("discovery") or {}, single_scan=not by_column),
        staged=staged,
    )
    if "reference" in config:
        try:
            run.drift = data_drift(
                _load(spark, config["reference"], staged), data, config.get("drift_tests", "distances")
            )
            run.drift_status = run.drift.summary.first()["status"]
        except Exception as error:  # reported, as the run's other results stand on their own
            run.drift_status = "FAIL"
            run.messages.append(str(error))
    return run
