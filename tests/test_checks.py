import pytest
from pyspark.sql import functions as F

import plumbline as q
from plumbline.functions import predicates as P


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_null_check_thresholds(unit):
    share = 100.0 / unit.count()
    for limit, status in ((50, "PASS"), (share, "PASS"), (share - 0.01, "FAIL"), (0, "FAIL")):
        found = one(q.null_check(unit, [{"column": "level", "max_percent": limit}]))
        assert (found.status, found.details["null_count"]) == (status, "1") and found.observed == pytest.approx(share)


def test_null_check_counts_nan_and_survives_zero_rows(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,)], "v double")
    assert one(q.null_check(df, [{"column": "v"}])).observed == 50.0
    empty = one(q.null_check(df.where("false"), [{"column": "v"}]))
    assert (empty.status, empty.observed, empty.row_count) == ("PASS", None, 0)


def test_unknown_column_is_reported_early(unit):
    with pytest.raises(KeyError, match="absent"):
        q.null_check(unit, [{"column": "absent"}])
    with pytest.raises(KeyError, match="absent"):
        q.uniqueness_check(unit, ["absent"])
    with pytest.raises(KeyError, match="absent"):
        q.group_check(unit, [{"group_by": ["absent"]}])
    assert q.constant_check(unit, ["absent"]).count() == 0
    assert q.empty_string_check(unit, ["absent"]).count() == 0
    assert q.outlier_check(unit, ["absent"]).count() == 0


def test_uniqueness(unit):
    assert one(q.uniqueness_check(unit, ["id"])).status == "PASS"
    repeated = one(q.uniqueness_check(unit.unionAll(unit.where("id = 30")), ["id"]))
    assert (repeated.status, repeated.observed) == ("FAIL", 1.0)
    assert one(q.uniqueness_check(unit, ["place", "noted"])).status == "PASS"


def test_uniqueness_treats_missing_as_equal(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), (None, None)], "a string, v double")
    assert one(q.uniqueness_check(df, ["a"])).observed == 2.0
    assert one(q.uniqueness_check(df, ["v"])).observed == 1.0


def test_long_text_keys_are_exact(spark):
    long = "x" * 100
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",), ("short",)], "t string")
    digest = df.select(F.sha2("t", 256).alias("t"))
    assert one(q.uniqueness_check(df, ["t"])).observed == 1.0
    # A text that is itself a digest is no longer than a digest and is digested again.
    assert one(q.uniqueness_check(df.unionAll(digest), ["t"])).observed == 2.0


def test_numeric_check(unit):
    assert one(q.numeric_check(unit, [{"column": "id", "min": 0, "max": 50}])).status == "PASS"
    assert one(q.numeric_check(unit, [{"column": "id", "min": 15}])).observed == 2.0
    with pytest.raises(TypeError, match="place"):
        q.numeric_check(unit, [{"column": "place", "min": 2}])


def test_numeric_check_ignores_missing_and_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (5.0,), (-1.0,), (float("inf"),)], "v double")
    assert one(q.numeric_check(df, [{"column": "v", "max": 10}])).observed == 1.0
    assert one(q.numeric_check(df, [{"column": "v", "allow_negative": False}])).observed == 1.0


def test_domain_check_missing_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert one(q.domain_check(df, [{"column": "c", "allowed_values": ["a", "b"]}])).observed == 1.0
    assert one(q.domain_check(df, [{"column": "c", "allowed_values": ["a", "b", None]}])).observed == 0.0
    assert one(q.domain_check(df, [{"column": "c", "forbidden_values": ["a"]}])).observed == 1.0
    assert one(q.domain_check(df, [{"column": "c", "allowed_values": []}])).observed == 0.0
    # Listed values of another type never match.
    assert one(q.domain_check(df, [{"column": "c", "allowed_values": [1, 2]}])).observed == 3.0


def test_regex_matches_from_the_start(spark):
    df = spark.createDataFrame([("abc",), ("xabc",), ("ab",), (None,)], "c string")
    assert one(q.domain_check(df, [{"column": "c", "regex": "ab"}])).observed == 2.0
    assert one(q.domain_check(df, [{"column": "c", "regex": "x|a"}])).observed == 1.0
    numbers = spark.createDataFrame([(12,), (345,)], "n int")
    assert one(q.domain_check(numbers, [{"column": "n", "regex": r"\d{2}$"}])).observed == 1.0


def test_volume_check(unit):
    assert one(q.volume_check(unit, 6, 6)).status == "PASS"
    assert one(q.volume_check(unit, min_rows=7)).status == "FAIL"
    assert one(q.volume_check(unit, max_rows=5)).status == "FAIL"
    assert one(q.volume_check(unit)).status == "PASS"


def test_constant_check(spark):
    df = spark.createDataFrame(
        [("a", None, 1.0, "x", None), ("a", None, 1.0, "y", "b")],
        "same string, empty string, number double, two string, half string",
    )
    found = {r.target[0]: r.details["value"] for r in q.constant_check(df, ["*"]).collect()}
    assert found == {"same": "a", "empty": None, "number": "1.0"}
    assert {r.status for r in q.constant_check(df, ["*"]).collect()} == {"WARN"}
    assert q.constant_check(df.where("false"), ["*"]).count() == 0


def test_blank_texts(spark):
    blanks = ["", " ", "\t", " ", "\x1c", " \n "]
    df = spark.createDataFrame([(b,) for b in blanks] + [("x",), (" x ",), (None,)], "t string")
    assert one(q.empty_string_check(df, ["*"])).observed == float(len(blanks))
    assert q.empty_string_check(df.where("t = 'x'"), ["t"]).count() == 0


def test_outliers_need_eleven_rows(spark):
    ten = spark.createDataFrame([(float(v),) for v in [1] * 9 + [1000]], "v double")
    assert q.outlier_check(ten, ["v"]).count() == 0
    eleven = spark.createDataFrame([(float(v),) for v in [1] * 10 + [1000]], "v double")
    found = one(q.outlier_check(eleven, ["*"]))
    assert (found.observed, found.details["examples"]) == (1.0, "[1000.0]")


def test_outliers_of_degenerate_columns(spark):
    df = spark.createDataFrame(
        [(1.0, 5, True, float("inf") if i == 0 else float(i)) for i in range(20)],
        "same double, five int, flag boolean, infinite double",
    )
    assert q.outlier_check(df, ["*"]).count() == 0
    assert q.outlier_check(df.limit(1), ["*"]).count() == 0
    assert q.outlier_check(df, ["flag"]).count() == 0


def test_outlier_examples_are_distinct_and_ranked(spark):
    values = [0.0] * 500 + [100.0, 100.0, 101.0, 102.0, 103.0, 104.0, 105.0, -90.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shown = q.outlier_examples(df, ["v"]).orderBy("rank").collect()
    assert [r.value for r in shown] == [105.0, 104.0, 103.0, 102.0, 101.0]
    assert one(q.outlier_moments(df, ["v"])).outlier_count == 8


def test_group_check(unit, spark):
    assert one(q.group_check(unit, [{"group_by": ["place"], "min_count": 2}])).status == "PASS"
    failed = one(q.group_check(unit.where("id < 40"), [{"group_by": ["place"], "min_count": 2}]))
    assert (failed.status, failed.observed) == ("FAIL", 1.0)
    with_missing = spark.createDataFrame([("a",), (None,), ("a",)], "g string")
    kept = one(q.group_check(with_missing, [{"group_by": "g", "min_count": 2}]))
    assert (kept.status, kept.row_count) == ("PASS", 2)


def test_group_summary_is_in_key_order(spark):
    df = spark.range(30).select((F.col("id") % 15).alias("g"))
    assert [r.g for r in q.group_summary(df, {"group_by": ["g"]}).collect()] == list(range(10))


def test_group_metric_thresholds(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "g string, v double")
    rule = {"group_by": ["g"], "metrics": ["sum", "avg"], "columns": ["v"]}
    assert one(q.group_check(df, [{**rule, "max_avg": 10}])).status == "PASS"
    assert one(q.group_check(df, [{**rule, "min_sum": 5}])).status == "FAIL"
    with pytest.raises(ValueError, match="median"):
        q.group_metrics(df, {**rule, "metrics": ["median"]})


def test_cardinality_counts_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "c string")
    assert one(q.cardinality_check(df, [{"column": "c", "min_distinct": 3, "max_distinct": 3}])).status == "PASS"
    assert one(q.cardinality_check(df, [{"column": "c", "max_distinct": 2}])).status == "FAIL"


def test_violations_returns_rows(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b"), (9, "c")], "n int, c string")
    assert [r.n for r in q.violations(df, {"column": "n", "min": 2, "max": 8}).collect()] == [1, 9]
    assert [r.c for r in q.violations(df, {"column": "c", "allowed_values": ["a"]}).collect()] == ["b", "c"]


def test_many_rules_run_in_several_passes(spark):
    df = spark.range(10).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(120)])
    found = q.null_check(df, [{"column": c} for c in df.columns])
    assert found.count() == 120
    assert found.where("status <> 'PASS'").count() == 0


def test_quotes_in_names_and_values(spark):
    df = spark.createDataFrame([("it's", 1)], ["a'b.c", "x\\y"])
    found = {r.target[0] for r in q.run_checks(df, {"constant_checks": ["*"]}, "d'x").collect()}
    assert found == {"a'b.c", "x\\y"}


def test_constant_check_of_long_texts_keeps_no_texts(spark):
    long = "né " * 5000
    rows = [(long, bytearray(b"z" * 90), long, [1, 2])] * 3 + [(long, bytearray(b"z" * 90), long + "!", [1, 2])]
    df = spark.createDataFrame(rows, "same string, bytes binary, other string, list array<int>")
    found = {r.target[0]: r.details["value"] for r in q.constant_check(df, ["*"]).collect()}
    assert set(found) == {"same", "bytes", "list"} and found["same"] == long[:40] + "..."


def test_group_sums_beyond_38_digits_are_null(spark):
    big = "9" * 38
    df = spark.createDataFrame([("a", big), ("a", big), ("b", "7")], "g string, t string").select("g", F.col("t").cast("decimal(38,0)").alias("v"))
    found = {r.g: (r.sum_v, r.max_v) for r in q.group_metrics(df, {"group_by": "g", "metrics": ["sum", "avg", "max"], "columns": ["v"]}).collect()}
    assert found["a"][0] is None and str(found["a"][1]) == big and int(found["b"][0]) == 7


def test_score_counts_schema_and_skips_groups(unit):
    rules = {
        "null_checks": [{"column": c} for c in unit.columns],
        "numeric_checks": [{"column": "id", "max": 0}],
        "group_by_checks": [{"group_by": ["place"], "min_count": 99}],
    }
    checks = q.run_checks(unit, rules)
    # Of five checks without the groups, one has a missing value and one is out of range.
    for schema, passed in (("PASS", 4), ("FAIL", 3)):
        assert one(q.score(checks, schema)).score == pytest.approx(100 * passed / 6, abs=0.005)
    assert {r.check_type for r in q.failed_checks(checks).collect()} >= {"null_check", "numeric_check"}


def test_masks_are_never_null(spark):
    df = spark.createDataFrame([(None, None)], "n double, t string")
    number, word = df.schema["n"], df.schema["t"]
    masks = [
        P.below(number, 1), P.above(number, 1), P.negative(number), P.blank(word),
        P.not_allowed(word, ["a"]), P.forbidden(word, ["a"]), P.not_matching(word, "a"),
    ]
    assert None not in tuple(df.select(*[m.alias(str(i)) for i, m in enumerate(masks)]).first())


def test_regex_sees_plain_decimals(spark):
    df = spark.createDataFrame([(12345678.0,), (0.00025,), (1.5,)], "v double")
    texts = [r.t for r in df.select(P.as_text(df.schema["v"]).alias("t")).collect()]
    assert texts == ["12345678.0", "0.00025", "1.5"]
    assert one(q.domain_check(df.limit(1), [{"column": "v", "regex": r"\d{8}"}])).status == "PASS"
