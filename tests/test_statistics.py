"""Distributed statistics against brute force on small frames with ties, gaps and one hot value."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import plumbline as q
from plumbline.functions.tails import chi_square_upper, kolmogorov_two_sided, normal_two_sided
from plumbline.operators import drift as R
from plumbline.operators import ordered
from plumbline.operators.ordered import mid_rank, running_totals
from plumbline.operators import comoments
from plumbline.operators import quantiles as Q
from plumbline.operators.quantiles import exact_quantiles


def hot_values(seed, n, missing=0.1):
    """A third of the values equal, many ties, some missing."""
    rng = random.Random(seed)
    values = []
    for _ in range(n):
        u = rng.random()
        values.append(7.0 if u < 1 / 3 else round(rng.gauss(0, 50), 1))
        if rng.random() < missing:
            values[-1] = None if rng.random() < 0.5 else float("nan")
    return values


def frame(spark, values, partitions=5):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(partitions)


def clean(values):
    return [v for v in values if v is not None and not math.isnan(v)]


@pytest.mark.parametrize("digits", [(20, 22), (2, 5), (12, 8)])
def test_exact_quantiles(spark, monkeypatch, digits):
    monkeypatch.setattr(Q, "DIGITS", digits)
    values = hot_values(1, 3000)
    df = frame(spark, values)
    shares = [0.0, 0.05, 0.25, 0.5, 0.613, 0.95, 1.0]
    known = F.when(~F.isnan("v"), F.col("v"))
    found = exact_quantiles(df, {"v": known, "neg": -known}, shares, deviation=True)
    expected = np.quantile(clean(values), shares)
    assert [found["v"][s] for s in shares] == pytest.approx(list(expected))
    assert [found["neg"][s] for s in shares] == pytest.approx(list(np.quantile([-v for v in clean(values)], shares)))
    mad = np.median(np.abs(np.array(clean(values)) - np.median(clean(values))))
    assert found["v"]["mad"] == found["neg"]["mad"] == pytest.approx(mad)


def test_bits_have_the_order_of_values():
    values = np.array([-np.inf, -1e300, -2.5, -2.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    bits = Q.ordered_bits(values)
    assert (np.diff(bits) >= 0).all() and bits[5] == bits[6] and len(set(bits.tolist())) == len(values) - 1
    assert [Q.from_ordered_bits(b) for b in bits.tolist()] == values.tolist()


@pytest.mark.parametrize("rows", [500, 5000, 50_000])
def test_passes_of_quantiles_do_not_grow_with_rows(spark, monkeypatch, rows):
    passes, counted = [], Q._counted
    monkeypatch.setattr(Q, "_counted", lambda *a: passes.append(a[2:4]) or counted(*a))
    monkeypatch.setattr(Q, "DIGITS", (20, 6))
    df = spark.range(rows).select(F.xxhash64("id").cast("double").alias("v"))
    exact_quantiles(df, {"v": F.col("v")}, [0.25, 0.5, 0.75])
    # 20 bits, then 6 bits a pass at most.
    assert len(passes) <= 1 + 8 and sum(d for _, d in passes) <= 64


def test_infinite_values_and_quantiles(spark):
    inf = math.inf
    found = exact_quantiles(frame(spark, [-inf, 1.0, 2.0, inf, inf]), {"v": F.col("v")}, [0.0, 0.5, 1.0], deviation=True)
    assert [found["v"][s] for s in (0.0, 0.5, 1.0)] == [-inf, 2.0, inf] and found["v"]["mad"] == inf
    endless = exact_quantiles(frame(spark, [inf, inf, 1.0]), {"v": F.col("v")}, [0.5], deviation=True)
    assert endless["v"][0.5] == inf and math.isnan(endless["v"]["mad"])


def test_quantiles_of_nothing_and_of_one(spark):
    empty = frame(spark, [None, None])
    assert exact_quantiles(empty, {"v": F.col("v")}, [0.5]) == {"v": {0.5: None}}
    assert exact_quantiles(frame(spark, [4.0]), {"v": F.col("v")}, [0.1, 0.9]) == {"v": {0.1: 4.0, 0.9: 4.0}}


def test_profile_quantiles_against_numpy(spark):
    values = hot_values(2, 1000, missing=0)
    row = q.profile_quantiles(frame(spark, values), ["v"]).first()
    assert row.q25 == pytest.approx(np.quantile(values, 0.25))
    assert row.mad == pytest.approx(np.median(np.abs(np.array(values) - np.median(values))))
    assert row.range == pytest.approx(max(values) - min(values))


@pytest.mark.parametrize("splits", [[], [7.0], [-40.0, 0.0, 7.0, 30.0], [1000.0]])
def test_running_totals(spark, splits):
    values = clean(hot_values(3, 800))
    counts = Counter(values)
    df = spark.createDataFrame(list(counts.items()), "v double, n bigint")
    found = running_totals(df, "v", ["n"], splits).withColumn("rank", mid_rank("n")).orderBy("v").collect()
    upto = 0
    order = sorted(counts)
    ranks = dict(zip(values, pd.Series(values).rank()))
    for i, row in enumerate(found):
        upto += counts[row.v]
        assert (row.v, row.n_upto, row.n_total) == (order[i], upto, len(values))
        assert row.next_value == (order[i + 1] if i + 1 < len(order) else None)
        assert row["rank"] == pytest.approx(ranks[row.v])


def brute_ks(a, b):
    points = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


def brute_wasserstein(a, b):
    points = sorted(set(a) | set(b))
    area = 0.0
    for low, high in zip(points, points[1:]):
        area += abs(sum(x <= low for x in a) / len(a) - sum(x <= low for x in b) / len(b)) * (high - low)
    return area


def test_ks_and_wasserstein(spark):
    a, b = hot_values(4, 400), [None if v is None else v + 3 for v in hot_values(5, 300)]
    left, right = frame(spark, a), frame(spark, b)
    ks = R.kolmogorov_smirnov(left, right, "v").first()
    assert ks.statistic == pytest.approx(brute_ks(clean(a), clean(b)))
    assert (ks.baseline_rows, ks.current_rows) == (len(clean(a)), len(clean(b)))
    plain = R.wasserstein(left, right, "v", normalise=False).first().statistic
    assert plain == pytest.approx(brute_wasserstein(clean(a), clean(b)))
    scaled = R.wasserstein(left, right, "v").first().statistic
    assert scaled == pytest.approx(plain / np.std(clean(a)))


def test_drift_of_a_table_against_itself_is_zero(spark):
    df = spark.createDataFrame([(v, str(i % 4)) for i, v in enumerate(hot_values(6, 1500))], "v double, c string")
    found = q.data_drift(df, df)
    assert {r.column: r.test for r in found.columns.collect()} == {"v": "wasserstein", "c": "jensen_shannon"}
    assert [r.statistic for r in found.columns.collect()] == pytest.approx([0.0, 0.0], abs=1e-9)
    summary = found.summary.first()
    assert (summary.number_of_drifted_columns, summary.share_of_drifted_columns, summary.dataset_drift) == (0, 0.0, False)


def test_small_baseline_uses_hypothesis_tests(spark):
    rows = [(float(i), "abc"[i % 3], i % 2 == 0) for i in range(200)]
    left = spark.createDataFrame(rows, "v double, c string, f boolean")
    right = spark.createDataFrame([(v + 500, "a", f) for v, _, f in rows], "v double, c string, f boolean")
    found = {r.column: r for r in q.data_drift(left, right, tests="by_size").columns.collect()}
    assert {c: r.test for c, r in found.items()} == {"v": "ks", "c": "chi_square", "f": "proportion_z"}
    assert {c: r.drifted for c, r in found.items()} == {"v": True, "c": True, "f": False}
    assert found["f"].p_value == pytest.approx(1.0)


def test_drift_without_common_columns(spark):
    found = q.data_drift(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "b int"))
    summary = found.summary.first()
    assert (summary.status, summary.compared_columns, summary.dataset_drift) == ("SKIPPED", 0, False)


def test_chi_square_and_jensen_shannon(spark):
    a, b = ["x"] * 30 + ["y"] * 20 + ["z"] * 10, ["x"] * 10 + ["y"] * 20 + ["w"] * 40
    left = spark.createDataFrame([(v,) for v in a], "c string")
    right = spark.createDataFrame([(v,) for v in b], "c string")
    table = np.array([[a.count(v), b.count(v)] for v in "wxyz"], dtype=float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    chi = R.chi_square(left, right, "c").first()
    assert (chi.statistic, chi.dof) == (pytest.approx(((table - expected) ** 2 / expected).sum()), 3)
    p, r = table[:, 0] / len(a), table[:, 1] / len(b)
    m = (p + r) / 2
    part = sum(x * math.log2(x / y) for x, y in zip(p, m) if x) + sum(x * math.log2(x / y) for x, y in zip(r, m) if x)
    assert R.jensen_shannon(left, right, "c").first().statistic == pytest.approx(math.sqrt(part / 2))


def test_tail_probabilities():
    # Closed forms: exp(-x/2) for two degrees of freedom, the normal tail for one.
    for x in (0.1, 1.0, 5.0, 30.0):
        assert chi_square_upper(x, 2) == pytest.approx(math.exp(-x / 2))
        assert chi_square_upper(x, 1) == pytest.approx(normal_two_sided(math.sqrt(x)))
        assert chi_square_upper(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
    assert chi_square_upper(0.0, 3) == 1.0
    assert chi_square_upper(1000.0, 1000) == pytest.approx(0.494, abs=0.001)
    assert normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    # 5 % point of the Kolmogorov law: 1.3581.
    assert kolmogorov_two_sided(1.3581 / math.sqrt(500), 1000, 1000) == pytest.approx(0.05, abs=1e-4)
    assert kolmogorov_two_sided(0.0, 10, 10) == 1.0


def test_correlations_with_gaps(spark):
    x, y = hot_values(7, 500), hot_values(8, 500)
    z = [None if a is None or b is None else a * 2 + b for a, b in zip(x, y)]
    df = spark.createDataFrame(list(zip(x, y, z)), "x double, y double, z double").repartition(4)
    data = pd.DataFrame({"x": x, "y": y, "z": z}, dtype=float)
    for method, found in (("pearson", q.pearson(df, ["*"])), ("spearman", q.spearman(df, ["*"]))):
        expected = data.corr(method=method)
        rows = {(r.column_a, r.column_b): r.correlation for r in found.collect()}
        for a, b in combinations("xyz", 2):
            assert rows[a, b] == pytest.approx(expected.loc[a, b])


def test_correlation_of_constant_columns_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, 4.0), (1.0, 4.0, None)], "a double, b double, c double")
    assert {r.correlation for r in q.pearson(df, ["*"]).collect()} == {None}
    assert q.spearman(df, ["a", "b"]).first().correlation is None


def test_correlation_of_many_gapped_columns(spark, monkeypatch):
    """Several blocks, classes of columns with the same gaps, offsets that would cancel, ties."""
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (400, 1))
    data = pd.DataFrame(np.round(base + rng.normal(0, 1, (400, 7)), 1) + np.arange(7) * 1e7, columns=list("abcdefg"))
    data.loc[rng.random(400) < 0.3, ["b", "c"]] = np.nan
    data.loc[rng.random(400) < 0.2, "e"] = np.nan
    data.loc[data.index > 5, "g"] = np.nan
    monkeypatch.setattr(comoments, "SIDE", 3)
    monkeypatch.setattr("plumbline.operators.association.SIDE", 2)
    monkeypatch.setattr("plumbline.operators.association.RANKS_AT_ONCE", 50)
    df = spark.createDataFrame(data).repartition(6)
    for method, found in (("pearson", q.pearson(df, ["*"])), ("spearman", q.spearman(df, ["*"]))):
        expected = data.corr(method=method)
        rows = {(r.column_a, r.column_b): r.correlation for r in found.collect()}
        assert sorted(rows) == list(combinations("abcdefg", 2))
        for a, b in rows:
            assert rows[a, b] == pytest.approx(expected.loc[a, b], abs=1e-7), (method, a, b)


def test_correlation_with_infinite_values_and_none(spark):
    rows = [(1.0, 2.0, math.inf), (2.0, 4.0, 1.0), (3.0, 6.5, 2.0), (4.0, None, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r.column_a, r.column_b): r.correlation for r in q.pearson(df, ["*"]).collect()}
    assert found["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1]) and math.isnan(found["a", "c"])
    empty = df.limit(0)
    assert {r.correlation for r in q.pearson(empty, ["*"]).collect()} == {None}
    assert {r.correlation for r in q.spearman(empty, ["*"]).collect()} == {None}


def test_cramers_v_of_many_kinds(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        a = rng.randrange(4)
        b = a if rng.random() < 0.5 else rng.randrange(3)
        rows.append((a, None if rng.random() < 0.1 else f"t{b}" + "x" * 80, rng.choice([0.0, -0.0, 1.5, float("nan")]), b > 1, None))
    df = spark.createDataFrame(rows, "a int, b string, c double, d boolean, e string").repartition(5)
    found = {(r.column_a, r.column_b): r for r in q.cramers_v(df, ["*"]).collect()}
    assert len(found) == 10 and found["a", "e"].n is None and found["d", "e"].cramers_v is None
    for x, y in combinations(range(4), 2):
        both = [(r[x], r[y]) for r in rows if r[x] is not None and r[y] is not None and r[x] == r[x] and r[y] == r[y]]
        table = pd.crosstab(*map(pd.Series, zip(*both))).to_numpy()
        expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
        chi = ((table - expected) ** 2 / expected).sum()
        row = found["abcd"[x], "abcd"[y]]
        assert row.n == len(both) and row.chi_square == pytest.approx(chi)
        assert row.cramers_v == pytest.approx(math.sqrt(chi / len(both) / (min(table.shape) - 1)))


def test_cramers_v(spark):
    same = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x"), ("b", "y")], "p string, r string")
    assert q.cramers_v(same, ["p", "r"]).first().cramers_v == pytest.approx(1.0)
    apart = spark.createDataFrame([(p, r) for p in "ab" for r in "xy"], "p string, r string")
    assert q.cramers_v(apart, ["p", "r"]).first().cramers_v == pytest.approx(0.0)


def test_sums_of_long_whole_numbers_are_exact(spark):
    rng = random.Random(12)
    for values in ([10**38 - 1] * 3, [-(10**38 - 1)] * 3, [10**37, -(10**37)], [-(10**20), 5], [10**20, -5], [-3], [10**20 - 1, 1, 0],
                   [rng.randrange(-(10**38) + 1, 10**38) for _ in range(50)]):
        df = spark.createDataFrame([(str(v),) for v in values] + [(None,)], "t string").select(F.col("t").cast("decimal(38,0)").alias("v"))
        assert q.profile_numeric(df, ["v"]).first().sum_exact == str(sum(values)), values


def test_overview_counts(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "n int, t string")
    row = q.profile_overview(df).first()
    assert (row.row_count, row.column_count, row.missing_cells, row.duplicate_rows) == (3, 2, 2, 1)


def test_histogram_keeps_every_row(spark):
    values = hot_values(9, 700)
    found = q.profile_histogram(frame(spark, values), ["v"], bins=7).orderBy("bin").collect()
    assert len(found) == 7
    assert [r["count"] for r in found] == list(np.histogram(clean(values), 7)[0])
    same = q.profile_histogram(frame(spark, [3.0, 3.0]), ["v"], bins=4).orderBy("bin").collect()
    assert [r["count"] for r in same] == [2, 0, 0, 0]


def test_most_frequent_duplicates(spark):
    long = "é" * 60
    df = spark.createDataFrame([(long, 1)] * 3 + [("b", None)] * 2 + [("c", 1)], "t string, n int")
    found = {(r.t, r.n): r.copies for r in q.profile_duplicates(df).collect()}
    assert found == {(long, 1): 3, ("b", None): 2}


def test_missing_patterns(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, "a"), (3, None)], "n int, t string")
    found = {r.missing_columns: (r.missing_count, r.row_count, r.percent) for r in q.profile_missing(df).collect()}
    assert found == {"t": (1, 2, 50.0), "n, t": (2, 1, 25.0), "": (0, 1, 25.0)}


def test_alerts(spark):
    rows = [(i, 1, float(i), float(i) * 2, None if i < 10 else "x", 0.0 if i < 50 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, same int, a double, b double, gap string, z double")
    found = {(r.column, r.alert) for r in q.profile_alerts(df).collect()}
    assert {("id", "unique"), ("same", "constant"), ("gap", "missing"), ("z", "zeros"), ("a | b", "correlated")} <= found
    assert ("same", "correlated") not in found


def test_bucket_count_grows_with_the_input(spark, monkeypatch):
    from plumbline.operators import ordered

    df = spark.range(10)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ordered.bucket_count(df) == partitions
    monkeypatch.setattr(ordered, "estimated_bytes", lambda _: 10**11)
    assert ordered.bucket_count(df) == 10**11 // ordered.BYTES_PER_BUCKET
    monkeypatch.setattr(ordered, "estimated_bytes", lambda _: 10**14)
    assert ordered.bucket_count(df) == ordered.MAX_BUCKETS


def test_many_buckets_give_the_same_result(spark, monkeypatch):
    from plumbline.operators import ordered

    a, b = hot_values(10, 3000), hot_values(11, 3000)
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    few = q.spearman(df, ["a", "b"]).first().correlation
    monkeypatch.setattr(ordered, "bucket_count", lambda _: ordered.MAX_BUCKETS)
    monkeypatch.setattr("plumbline.operators.association.bucket_count", lambda _: ordered.MAX_BUCKETS)
    assert q.spearman(df, ["a", "b"]).first().correlation == pytest.approx(few)


def test_estimated_bytes_reads_no_data(spark):
    assert q.estimated_bytes(spark.range(1000)) >= 1000


def test_drift_between_columns_of_different_types(spark):
    left = spark.createDataFrame([(i % 3, str(i % 2)) for i in range(60)], "n int, c string")
    right = spark.createDataFrame([(float(i % 3), i % 2) for i in range(60)], "n double, c int")
    found = {r.column: r for r in q.data_drift(left, right).columns.collect()}
    assert found["n"].statistic == pytest.approx(0.0) and found["c"].statistic == pytest.approx(0.0)


@pytest.mark.parametrize("n", [999, 1001])
def test_drift_tests_do_not_change_with_the_size(spark, n):
    df = spark.createDataFrame([(float(i % 50), str(i % 4)) for i in range(n)], "v double, c string")
    assert {r.column: r.test for r in q.data_drift(df, df).columns.collect()} == {"v": "wasserstein", "c": "jensen_shannon"}
    found = q.data_drift(df, df, tests="hypotheses").columns.collect()
    assert {r.column: r.test for r in found} == {"v": "ks", "c": "chi_square"}


def test_a_small_shift_of_dates_is_no_drift(spark):
    times = spark.range(2000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("at"))
    shifted = times.select((F.col("at") + F.expr("INTERVAL 0.001 SECOND")).alias("at"))
    row = q.data_drift(times, shifted).columns.first()
    assert row.test == "wasserstein" and not row.drifted


def test_a_hot_value_leaves_the_buckets_even(spark):
    hot = spark.range(200_000).select(F.when(F.col("id") < 2000, F.col("id")).otherwise(0).cast("double").alias("v"))
    splits = ordered.split_points(hot, ["v"], 64)["v"]
    values = hot.distinct()
    sizes = [r["count"] for r in ordered.with_bucket(values, "v", splits).groupBy("bucket").count().collect()]
    assert len(sizes) >= 60 and max(sizes) <= 4 * 2000 / 64


def test_counts_beyond_the_square_root_of_a_bigint(spark, monkeypatch):
    cells = spark.createDataFrame([("a", 4 * 10**9, 10**9), ("b", 3 * 10**9, 4 * 10**9)], "value string, b bigint, c bigint")
    monkeypatch.setattr(R, "value_pairs", lambda *_: cells)
    assert R.chi_square(spark.range(1), spark.range(1), "id").first().statistic > 0
    sums = spark.createDataFrame([("g", 9 * 10**18)] * 3, "k string, v bigint")
    assert int(q.group_metrics(sums, {"group_by": "k", "metrics": ["sum"], "columns": ["v"]}).first().sum_v) == 27 * 10**18
    exact = q.profile_numeric(sums, ["v"]).first()
    assert (exact.max_exact, exact.sum_exact) == (str(9 * 10**18), str(27 * 10**18))


EMPTY_SELECTIONS = [
    (q.profile_numeric, "c string", ["*"]), (q.profile_quantiles, "c string", ["*"]), (q.profile_quantiles_approx, "c string", ["*"]),
    (q.profile_histogram, "c string", ["*"]), (q.profile_text, "c int", ["*"]), (q.profile_top_values, "c array<int>", ["*"]),
    (q.spearman, "c string", ["*"]), (q.cramers_v, "c int", ["c"]), (q.pearson, "c string", ["*"]),
    (q.outlier_moments, "c string", ["*"]), (q.outlier_examples, "c string", ["*"]),
]


@pytest.mark.parametrize(("operator", "schema", "columns"), EMPTY_SELECTIONS)
def test_tables_without_a_fitting_column(spark, operator, schema, columns):
    found = operator(spark.createDataFrame([], schema), columns)
    assert found.columns and found.collect() == []


def test_infinite_values_are_in_no_bin(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, float("inf"), float("-inf"), None)], "v double")
    bins = q.profile_histogram(df, ["v"], 2).orderBy("bin").collect()
    assert [(r.lower, r.upper, r["count"]) for r in bins] == [(1.0, 1.5, 1), (1.5, 2.0, 1)]
