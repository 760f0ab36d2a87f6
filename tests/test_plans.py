"""What the physical plans of the registered queries must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

import plumbline as q
from __spark_entry__ import queries
from plumbline.operators import association as A
from plumbline.operators import drift as R
from plumbline.operators import outliers as O

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df):
    """The plan after adaptive execution."""
    df.collect()
    text = plan_of(df)
    return text[text.index("== Final Plan") : text.rindex("== Initial Plan")]


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_join_and_no_python_rows(spark, name):
    plan = plan_of(queries()[name](spark, SF_DIR))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert unwanted not in plan


@pytest.fixture
def lineitem(spark):
    return spark.read.parquet(f"{SF_DIR}/lineitem.parquet")


def test_checks_share_one_scan_of_the_checked_columns(lineitem):
    rules = {
        "null_checks": [{"column": "l_tax"}, {"column": "l_discount"}],
        "numeric_checks": [{"column": "l_tax", "min": 0}],
        "domain_checks": [{"column": "l_returnflag", "allowed_values": ["A"]}],
        "volume_checks": {"min_rows": 1},
    }
    plan = plan_of(q.run_checks(lineitem, rules))
    assert len(re.findall("FileScan", plan)) == 1
    assert "ReadSchema: struct<l_discount:double,l_tax:double,l_returnflag:string>" in plan


def test_filters_of_violations_reach_the_scan(lineitem):
    plan = plan_of(lineitem.where("l_quantity > 49").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan


def test_value_counts_are_shuffled_once(lineitem):
    left, right = lineitem.where("l_linenumber < 4"), lineitem.where("l_linenumber >= 4")
    for found in (
        R.kolmogorov_smirnov(left, right, "l_extendedprice"),
        A.cramers_v(lineitem, ["l_returnflag", "l_linestatus"]),
        q.group_distribution(lineitem, "l_returnflag"),
        R.jensen_shannon(left, right, "l_returnflag"),
    ):
        assert "ReusedExchange" in final_plan_of(found)


def own_scans(plan):
    """Scans that run; those of a reused shuffle do not."""
    return len(re.findall(r"FileScan|Scan parquet", plan))


def test_correlation_of_60_columns_is_one_scan(spark, tmp_path):
    wide = spark.range(500).select(*[F.when(F.col("id") % (i + 2) > 0, F.rand(i)).alias(f"c{i}") for i in range(60)])
    wide.write.parquet(str(tmp_path / "wide"))
    stored = spark.read.parquet(str(tmp_path / "wide"))
    for found in (q.pearson(stored, ["*"]), q.profile_missing_correlation(stored, ["*"])):
        plan = plan_of(found)
        assert own_scans(plan) == 1 and plan.count("Exchange") == 2


def test_rank_correlation_does_not_scan_per_column_or_pair(spark, lineitem):
    few, many = ["l_quantity", "l_discount"], ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_partkey", "l_suppkey"]
    plans = [final_plan_of(q.spearman(lineitem, c)) for c in (few, many)]
    assert own_scans(plans[0]) == own_scans(plans[1]) == 2
    assert plans[0].count("Exchange hashpartitioning") == plans[1].count("Exchange hashpartitioning")


def test_contingency_tables_of_all_pairs_are_one_scan(lineitem):
    columns = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]
    assert own_scans(final_plan_of(A.cramers_v(lineitem, columns))) == 1


def test_distinct_counts_of_one_scan_copy_no_row(lineitem):
    plan = plan_of(q.distinct_counts(lineitem, single_scan=True))
    assert own_scans(plan) == 1 and "Expand" not in plan and "Generate" not in plan


def test_samples_are_filters(spark, lineitem):
    plan = plan_of(q.sample_rows(lineitem, 100))
    assert "TakeOrdered" not in plan and "Exchange" not in plan and "Limit" not in plan


def test_top_k_is_cut_before_the_shuffle(lineitem):
    assert "TakeOrderedAndProject" in plan_of(q.date_distribution(lineitem, "l_shipdate"))
    assert "TakeOrderedAndProject" in plan_of(q.group_summary(lineitem, {"group_by": ["l_suppkey"]}))
    limited = plan_of(O.outlier_examples(lineitem, ["l_quantity"]))
    assert re.search(r"WindowGroupLimit .*Partial", limited)


def test_long_text_is_not_shuffled(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = plan_of(q.duplicates(documents, include=["text"]))
    keys = re.search(r"partial_count\(1\)\].*\)\s+\+- Project \[(.*)\]", plan).group(1)
    assert "sha2" in keys


def test_hot_value_keeps_results_whole(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"),
    )
    assert q.duplicates(rows, include=["k", "t"]).first().duplicate_count == 2999
    top = q.group_distribution(rows, "t").first()
    assert (top["values"], top["count"], top.percent) == ("hot", 3000, 33.33)
    assert q.profile_duplicates(rows).first().copies == 3000
