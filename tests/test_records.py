"""Quotes and line breaks in delimited files, over several splits, against the csv module."""

import csv
import io
import random

import pytest

import plumbline as q
from plumbline.sources.records import Dialect


def written(path, rows, **dialect):
    with open(path, "w", newline="") as file:
        csv.writer(file, lineterminator="\n", **dialect).writerows(rows)
    return str(path)


def test_inch_marks_are_characters(spark, tmp_path):
    path = tmp_path / "pipes.csv"
    path.write_text('part,size,note\n1,5" pipe,plain\n2,"6"" pipe, long",x\n3,a "b" c,y\n4,7" to 8" hose,z\n')
    rows = [tuple(r) for r in q.read_csv(spark, str(path)).collect()]
    assert rows == [(1, '5" pipe', "plain"), (2, '6" pipe, long', "x"), (3, 'a "b" c', "y"), (4, '7" to 8" hose', "z")]


def test_inch_marks_do_not_hide_delimiters(spark, tmp_path):
    path = tmp_path / "hoses.csv"
    path.write_text('a;b;c\n1;2";3"\n4;5";6\n7;8;9"\n')
    assert q.read_csv(spark, str(path)).columns == ["a", "b", "c"]


def test_state_after_a_line():
    after = Dialect().state_after()
    for line, outside, inside in [
        ("a,b", False, True), ('a,"b', True, False), ('"a', True, False), ('a"', False, False), ('a","b', True, True),
        ('"a""', True, False), ('""', False, True), ('a,5" x', False, False), ('","', False, True), ('",', True, False),
    ]:
        assert (after(line, False), after(line, True)) == (outside, inside), line
    assert Dialect(escape="\\").state_after()('"a\\"', False)
    assert Dialect(skip_space=True).state_after()('a,  "b', False) and not Dialect().state_after()('a,  "b', False)


@pytest.mark.parametrize("seed", range(3))
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, seed):
    rng = random.Random(seed)
    parts = ["x", "5\" y", "line\nbreak", "\n\n", "a,b", "\"", "\"\"", "end\n", " lead", "é\n\"q\"\n,"]
    rows = [["id", "t", "u"]] + [[str(i), rng.choice(parts) * rng.randrange(1, 4), rng.choice(parts)] for i in range(400)]
    files = [written(tmp_path / "one.csv", rows), written(tmp_path / "two.csv", rows[:1] + rows[200:])]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        found = q.read_csv(spark, files, sep=",", multiline=True, keep_default_na=False)
        assert found.rdd.getNumPartitions() > 50
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((int(a), b, c) for a, b, c in rows[1:] + rows[200:])


def test_line_breaks_are_noticed_without_being_told(spark, tmp_path):
    path = written(tmp_path / "t.csv", [["a", "b"], ["1", "two\nlines"], ["2", "one"]])
    assert sorted(tuple(r) for r in q.read_csv(spark, path).collect()) == [(1, "two\nlines"), (2, "one")]


def test_options_across_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("# note\r\na;b\r\n\r\n1;'x\r\nção'\r\n# more\r\n2;\r\n".encode("latin-1"))
    found = q.read_csv(spark, str(path), quotechar="'", comment="#", encoding="latin1", sep=";")
    assert sorted(map(tuple, found.collect())) == [(1, "x\r\nção"), (2, None)]
    wide = tmp_path / "wide.csv"
    wide.write_text('a,b\n1,"x\ny"\n2,3,4\n5\n')
    with pytest.raises(ValueError, match="more fields"):
        q.read_csv(spark, str(wide))
    assert sorted(map(tuple, q.read_csv(spark, str(wide), on_bad_lines="skip").collect())) == [(1, "x\ny"), (5, None)]
    named = q.read_csv(spark, str(wide), names=["x", "y", "z"], header=None)
    assert named.count() == 4


def test_an_open_quote_is_refused(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text('a,b\n1,"never closed\n2,3\n')
    with pytest.raises(ValueError, match="open at the end"):
        q.read_csv(spark, str(path))


def test_long_quoted_text(spark, tmp_path):
    rows = [["a", "b"], ["1", "word \n" * 60_000], ["2", "x"]]
    got = sorted(map(tuple, q.read_csv(spark, written(tmp_path / "long.csv", rows)).collect()))
    assert got == [(1, rows[1][1]), (2, "x")]
    assert next(iter(Dialect().parsed(io.StringIO('"a""b",c\n')))) == ['a"b', "c"]
