import datetime as dt
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import plumbline as q
from plumbline.operators.schema import infer_types


def test_distinct_counts_and_candidates(spark):
    df = spark.createDataFrame(
        [(1, "a", None, 1.0), (2, "b", "x", float("nan")), (3, "b", None, None)],
        "id int, c string, h string, v double",
    )
    for single in (False, True):
        found = [(r.column, r.distinct_count) for r in q.distinct_counts(df, single_scan=single).collect()]
        assert found == [("id", 3), ("c", 2), ("h", 2), ("v", 2)]
    assert [r.column for r in q.key_candidates(df).collect()] == ["id"]


def test_complex_columns_are_left_out_of_keys(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "id int, e array<double>")
    assert [r.column for r in q.distinct_counts(df).collect()] == ["id"]
    assert infer_types(df)["e"] == "complex"


def test_key_search_statuses(spark):
    two = spark.createDataFrame([(a, b, 0) for a in range(3) for b in range(4)], "a int, b int, c int")
    found = q.detect_keys(two)
    key = found.key.first()
    assert (key.status, key.key_type, key.columns) == ("SUCCESS", "COMPOSITE", ["b", "a"])
    assert [tuple(r) for r in found.history.collect()] == [(1, ["b", "a"], 12, 12, True)]

    single = q.detect_keys(spark.range(5).withColumn("copy", F.col("id")))
    assert single.key.first().columns == ["id", "copy"]
    assert single.history.count() == 0

    none = q.detect_keys(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")).key.first()
    assert none.status == "FAIL"
    assert q.detect_keys(two.where("false")).key.first().status == "SKIPPED"
    stamp = spark.createDataFrame([(1,)], "DH_Upload int")
    assert q.detect_keys(stamp).key.first().status == "FAIL"


def minimal_by_hand(rows, names, depth):
    keys = []
    for size in range(1, depth + 1):
        for chosen in combinations(range(len(names)), size):
            if len({tuple(r[i] for i in chosen) for r in rows}) == len(rows) > 0 and not any(set(k) <= set(chosen) for k in keys):
                keys.append(chosen)
    return {tuple(names[i] for i in k) for k in keys}


def test_minimal_keys(spark):
    rng = random.Random(5)
    names = ("a", "b", "c", "d", "e")
    rows = [(i // 20, i % 20, None if i == 7 else i // 40, rng.choice("xyz"), i % 2) for i in range(400)]
    rows.append((None, 3, 1, "x", None))
    frame = spark.createDataFrame(rows, "a int, b int, c int, d string, e int")
    expected = minimal_by_hand(rows, names, 3)
    assert ("a", "b") in expected
    found = q.minimal_keys(frame).collect()
    assert {tuple(r.columns) for r in found} == expected
    assert all(r.size == len(r.columns) and r.distinct_count == r.row_count == 401 for r in found)
    assert {tuple(r.columns) for r in q.minimal_keys(frame, max_columns=4).collect()} == minimal_by_hand(rows, names, 4)
    assert q.minimal_keys(frame.limit(0)).collect() == []
    assert q.minimal_keys(frame.unionAll(frame)).collect() == []


def test_minimal_keys_tell_missing_values_from_each_other(spark):
    """(NULL, 1) and (1, NULL) are two rows; sketches that mix them up would rule the key out."""
    rows = [(i, None) for i in range(300)] + [(None, i) for i in range(300)]
    found = q.minimal_keys(spark.createDataFrame(rows, "a int, b int")).collect()
    assert [r.columns for r in found] == [["a", "b"]]


def test_minimal_keys_leave_supersets_and_metadata_out(spark):
    frame = spark.range(50).select("id", (F.col("id") % 5).alias("v"), F.col("id").alias("insert_date"))
    found = [r.columns for r in q.minimal_keys(frame, ignored=("insert_date",)).collect()]
    assert found == [["id"]]


def test_key_search_depth(spark):
    rows = [(a, b, c) for a in range(2) for b in range(2) for c in range(2)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    assert q.detect_keys(df, max_columns=2).key.first().status == "FAIL"
    assert q.detect_keys(df, max_columns=None).key.first().columns == ["a", "b", "c"]


def test_load_metadata_is_ignored_whatever_its_case(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 2, 5)], "id int, DH_Upload int, x int")
    assert [r.column for r in q.key_candidates(df).collect()] == ["id"]
    assert q.distinct_counts(df).count() == 3


def test_duplicates_of_copied_parcels(spark, files, shipments):
    df = q.read_csv(spark, files["copies"], sep=";")
    n = len(shipments.rows)
    copied = sum(i % 4 == 1 for i in range(n))
    for found in (q.duplicates(df, include=["parcel", "kilos"]), q.duplicates(df, exclude=["depot", "priority", "sent", "zone", "paid"])):
        row = found.first()
        assert (row.duplicate_count, row.status, row.columns) == (copied, "SUCCESS", ["parcel", "kilos"])
        assert row.duplicate_percent == pytest.approx(100 * copied / (n + copied), abs=0.005)
    search = q.detect_keys(df)
    assert search.key.first().status == "FAIL" and max(r.distinct_count for r in search.history.collect()) == n
    depots = Counter(d for i, d in enumerate(shipments.column("depot")) for _ in range(1 + (i % 4 == 1)))
    groups = {r["values"]: (r["count"], r.percent) for r in q.group_distribution(df, ["depot"]).collect()}
    assert groups == {d: (k, pytest.approx(100 * k / (n + copied), abs=0.005)) for d, k in depots.items()}


def test_duplicates_excluding_the_id(spark, files, shipments):
    df = q.read_csv(spark, files["commas"])
    rows = list(zip(shipments.column("depot"), shipments.column("zone")))
    row = q.duplicates(df, exclude=["parcel", "kilos", "priority", "sent", "paid"]).first()
    assert row.duplicate_count == len(rows) - len(set(rows))


def test_duplicates_without_columns_or_rows(unit):
    assert q.duplicates(unit, include=["absent"]).first().status == "SKIPPED"
    assert q.duplicates(unit.where("false"), include=["id"]).first().duplicate_count is None


def test_group_distribution_specs(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "g string, n int")
    composite = q.group_distribution(df, ["g", "n"]).collect()
    assert [(r["columns"], r["values"], r["count"]) for r in composite] == [("g | n", "a | 1", 2), ("g | n", "nan | 2", 1)]
    several = q.group_distribution(df, [["g"], ["n"], ["absent"]])
    assert {r["columns"] for r in several.collect()} == {"g", "n"}
    assert q.group_distribution(df, ["absent"]).count() == 0


def test_group_distribution_top_ten_ties(spark):
    df = spark.range(36).select((F.col("id") % 12).alias("g"))
    assert [r["values"] for r in q.group_distribution(df, "g").collect()] == [str(i) for i in range(10)]


def test_dates(spark):
    df = spark.createDataFrame(
        [
            (dt.date(2025, 1, 2), "02/01/2025", 7, "x"),
            (dt.date(2025, 1, 3), "not a date", 8, "y"),
            (None, None, 9, None),
        ],
        "d date, t string, n int, w string",
    )
    named = {r.column: (r.kind, r.max_date) for r in q.date_max(df, ["d", "t", "n", "w", "absent"]).collect()}
    assert named == {
        "d": ("DATE", dt.datetime(2025, 1, 3)),
        "t": ("TEXT", dt.datetime(2025, 1, 2)),
    }
    assert [r.column for r in q.date_max(df, ["*"]).collect()] == ["d"]
    assert [tuple(r) for r in q.date_distribution(df, "t").collect()] == [(dt.date(2025, 1, 2), 1)]
    total = [tuple(r) for r in q.date_distribution_total(df, "d").collect()]
    assert total == [("TOTAL", 2), ("2025-01-03", 1), ("2025-01-02", 1)]


def test_ten_latest_days(spark):
    df = spark.range(15).select(F.expr("date_add(date'2025-01-01', cast(id as int))").alias("d"))
    days = q.date_distribution(df, "d").collect()
    assert len(days) == 10 and days[0].date == dt.date(2025, 1, 15)
    assert q.date_distribution(df, "d", None).count() == 15


def test_schema_of_the_unit_frame(unit):
    assert infer_types(unit) == {"id": "integer", "level": "float", "place": "categorical", "noted": "datetime"}


def test_schema_rules(spark):
    n = 30
    columns = {
        "nothing": ("string", [None] * n),
        "flags": ("boolean", [True, None] * (n // 2)),
        "flag_text": ("string", ["true", "F"] * (n // 2)),
        "bits": ("string", ["0", "1"] * (n // 2)),
        "digits": ("string", [str(i) for i in range(n)]),
        "suffixed": ("string", [f"{i}d" for i in range(n)]),
        "years": ("string", ["2025", "2026"] * (n // 2)),
        "times": ("string", ["12:30"] * n),
        "whole": ("double", [float(i) for i in range(n)]),
        "whole_nan": ("double", [float("nan")] + [1.0] * (n - 1)),
        "infinite": ("double", [float("inf")] + [1.0] * (n - 1)),
        "parts": ("double", [i + 0.5 for i in range(n)]),
        "us": ("string", ["01/31/2025"] * n),
        "mixed_dates": ("string", ["31/01/2025", "01/31/2025"] * (n // 2)),
        "iso_time": ("string", ["2025-01-02 03:04:05.123"] * n),
        "zoned": ("string", ["2025-01-02T03:04:05Z"] * n),
        "few": ("string", ["a", "b", "c"] * (n // 3)),
        "many": ("string", [f"name {i}" for i in range(n)]),
    }
    names = list(columns)
    rows = list(zip(*[columns[c][1] for c in names]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} {columns[c][0]}" for c in names))
    assert infer_types(df) == {
        "nothing": "string", "flags": "boolean", "flag_text": "boolean", "bits": "boolean", "digits": "float",
        "suffixed": "string", "years": "float", "times": "categorical", "whole": "integer", "whole_nan": "integer",
        "infinite": "float", "parts": "float", "us": "datetime", "mixed_dates": "categorical",
        "iso_time": "datetime", "zoned": "datetime", "few": "categorical", "many": "string",
    }


@pytest.mark.parametrize("distinct, rows, expected", [(19, 100, "categorical"), (20, 100, "string"), (99, 1000, "categorical"), (100, 1000, "string")])
def test_category_thresholds_are_exact(spark, distinct, rows, expected):
    df = spark.range(rows).select(F.concat(F.lit("v"), (F.col("id") % distinct).cast("string")).alias("c"))
    missing = df.unionAll(spark.createDataFrame([(None,)], "c string"))
    assert infer_types(df)["c"] == expected
    assert infer_types(missing)["c"] == expected


def test_decimal_follows_the_float_rule(spark):
    df = spark.sql("SELECT cast(2.00 as decimal(10,2)) AS whole, cast(2.50 as decimal(10,2)) AS part")
    assert infer_types(df) == {"whole": "integer", "part": "float"}


def test_schema_drift(unit):
    actual = q.infer_schema(unit)
    expected = {"id": "integer", "level": "integer", "place": "categorical", "new": "string"}
    assert [r.column for r in q.missing_columns(actual, expected).collect()] == ["new"]
    assert [r.column for r in q.extra_columns(actual, expected).collect()] == ["noted"]
    assert [tuple(r) for r in q.type_mismatches(actual, expected).collect()] == [("level", "integer", "float")]
    assert q.schema_status(q.schema_drift(actual, expected)).first().status == "FAIL"
    extra_only = {"id": "integer", "level": "float"}
    assert q.schema_status(q.schema_drift(actual, extra_only)).first().status == "PASS"


def test_dataset_stats(spark):
    df = spark.createDataFrame([(1, "é", [1.0, 2.0]), (2, None, [])], "n bigint, t string, e array<double>")
    row = q.dataset_stats(df).first()
    assert (row.total_rows, row.total_columns, row.total_bytes) == (2, 3, 8 + 8 + 2 + 16)


def test_one_date_format_for_a_column(spark):
    df = spark.createDataFrame(
        [("01/02/2025", "1/2/2025", "Jan 5, 2024", "2024-01-01T10:00"), ("01/25/2025", "13/2/2025", "Dec 15, 2024", "2024-03-01T09:30")],
        "a string, b string, c string, d string",
    )
    assert set(infer_types(df).values()) == {"datetime"}
    found = {r.column: str(r.max_date) for r in q.date_max(df, ["a", "b", "c", "d"]).collect()}
    assert found == {
        "a": "2025-01-25 00:00:00", "b": "2025-02-13 00:00:00", "c": "2024-12-15 00:00:00", "d": "2024-03-01 09:30:00",
    }
    assert str(q.date_max(df, ["b"], date_format="M/d/yyyy").first().max_date) == "2025-01-02 00:00:00"


def test_long_digit_texts_are_recognised_in_time(spark):
    df = spark.createDataFrame([("1" * 20_000 + "x",)] * 4, "t string")
    assert infer_types(df) == {"t": "categorical"}


def test_dates_in_words_and_other_clocks(spark):
    written = {
        "a": ["5 Jan 2024", "17 may 2023"], "b": ["January 5, 2024", "May 17, 2023"], "c": ["05-JAN-2024", "17-May-2023"],
        "d": ["01/02/25", "28/12/69"], "e": ["10:00 PM", "9:15:30 am"], "f": ["2025-01-02T03:04:05+0000", "2025-01-02T03:04:05.123-0300"],
        "g": ["2025-01-02 03:04:05 +0000", "2025-01-02 03:04:05+0100"], "h": ["5 January 2024", "17 May 2023"],
        "i": ["01/31/2025 10:00 PM", "02/01/2025 01:30 am"], "j": ["Mayday", "June bug"],
    }
    df = spark.createDataFrame(list(zip(*written.values())), list(written))
    types = infer_types(df)
    assert types.pop("j") == "categorical" and set(types.values()) == {"datetime"}
    found = {r.column: (str(r.max_date), r.unparsed) for r in q.date_max(df, list(written)).collect()}
    assert {c: found[c][0] for c in "abcdgi"} == {
        "a": "2024-01-05 00:00:00", "b": "2024-01-05 00:00:00", "c": "2024-01-05 00:00:00", "d": "2025-02-01 00:00:00",
        "g": "2025-01-02 03:04:05", "i": "2025-02-01 01:30:00",
    }
    # A time of day is of no day.
    assert "e" not in found


def test_values_off_the_format_are_counted(spark):
    df = spark.createDataFrame([("2025-01-02",), ("2025-01-03",), ("2025/01/09",), (None,)], "t string")
    row = q.date_max(df, ["t"]).first()
    assert (str(row.max_date), row.unparsed) == ("2025-01-03 00:00:00", 1)
    total = {r.date: r["count"] for r in q.date_distribution_total(df, "t").collect()}
    assert total == {"2025-01-02": 1, "2025-01-03": 1, "UNPARSED": 1, "TOTAL": 2}
    assert q.date_distribution(df, "t").count() == 2


def test_dates_are_parsed_once_per_different_text(spark):
    """The plan counts texts before it reads them, so many copies cost no more than one."""
    from plumbline.operators import dates

    rows = [("2024-01-05", "x" * 100)] * 40 + [("2024-02-30", "no"), (None, None), ("2024-03-01", "5 May 2020")]
    df = spark.createDataFrame(rows, "d string, t string")
    texts = dates.different_texts(df, df.schema.fields).collect()
    assert {(r.i, r.text, r.n) for r in texts} == {(0, "2024-01-05", 40), (0, "2024-02-30", 1), (0, "2024-03-01", 1), (1, None, 41), (1, "5 May 2020", 1)}
    found = {r.column: (str(r.max_date), r.unparsed) for r in q.date_max(df, ["d", "t"]).collect()}
    assert found == {"d": ("2024-03-01 00:00:00", 1), "t": ("2020-05-05 00:00:00", 41)}


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_of_all_sets_from_one_shuffle(spark, monkeypatch, hot):
    from plumbline.functions.columns import key_fields
    from plumbline.operators import keys

    monkeypatch.setattr(keys, "_hot", lambda df, field: hot)
    rows = [(i, i % 7, i // 7, None if i % 2 else i) for i in range(200)] + [(199, 0, 0, 1)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    sets = [(0,), (0, 1), (1, 2), (1, 3), (0, 3)]
    single = [len({r[i] for r in rows}) for i in range(4)]
    wanted = {n for n, s in enumerate(sets) if len({tuple(r[i] for i in s) for r in rows}) < len(rows)}
    assert keys._repeated(df, sets, key_fields(df), single, 1) == wanted == {0, 2, 3}
    assert keys._repeated(df, sets, key_fields(df), single, 4) <= wanted
