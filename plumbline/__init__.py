"""Data quality checks, discovery, drift and profiling as Spark DataFrame operators."""

from plumbline.operators.association import cramers_v, pearson, spearman
from plumbline.operators.checks import (
    cardinality_check,
    constant_check,
    domain_check,
    empty_string_check,
    null_check,
    null_listing,
    numeric_check,
    uniqueness_check,
    violations,
    volume_check,
)
from plumbline.operators.dates import date_distribution, date_distribution_total, date_max
from plumbline.operators.distinct import distinct_counts, key_candidates
from plumbline.operators.drift import data_drift
from plumbline.operators.duplicates import duplicates
from plumbline.operators.groups import group_check, group_distribution, group_metrics, group_summary
from plumbline.operators.keys import detect_keys, minimal_keys
from plumbline.operators.outliers import outlier_check, outlier_examples, outlier_moments
from plumbline.operators.profile import (
    profile_alerts,
    profile_duplicates,
    profile_histogram,
    profile_missing,
    profile_missing_correlation,
    profile_numeric,
    profile_overview,
    profile_quantiles,
    profile_quantiles_approx,
    profile_sample,
    profile_text,
    profile_top_values,
)
from plumbline.operators.results import failed_checks, score
from plumbline.operators.schema import (
    column_types,
    extra_columns,
    infer_schema,
    missing_columns,
    schema_drift,
    schema_status,
    type_mismatches,
)
from plumbline.operators.stats import dataset_stats, estimated_bytes
from plumbline.plans.run import run_checks, run_discovery, run_rules
from plumbline.sources.csv import read_csv
from plumbline.sources.load import infer_source_schema, load_source, scan
from plumbline.sources.sampling import sample_by_key, sample_rows
from plumbline.sources.sinks import read_run, run_id, write_results
