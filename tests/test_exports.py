"""Real exports: headers by file, quoted cells, malformed records, key guard."""

import os

import pytest
from pyspark.sql import Observation

from wavepanel.plans.inspect import physical_plan
from wavepanel.sources import exports as X

A = 'id,q_T0,"note, long"\n1,NA,"a ""quoted"" cell"\n2, NA,"two\nlines"\n3,,x\n'
B = '"note, long",id,extra\n"z",4,e\n,5,\n'


def put(path, **files):
    os.makedirs(path, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(path, f"{name}.csv"), "w", newline="") as f:
            f.write(text)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_headers_are_reconciled_by_name(spark, tmp_path):
    path = put(tmp_path / "x", a=A, b=B, empty="")
    files = X.export_files(spark, path)
    assert [os.path.basename(f) for f in files] == ["a.csv", "b.csv"]  # an empty file is not listed
    assert [len(v) for v in X.headers(spark, files).values()] == [1, 1]
    for mode in ("FAILFAST", "PERMISSIVE"):
        got = X.read_exports(spark, path, mode=mode)
        assert got.rows.columns == ["id", "q_T0", "note, long", "extra"]
        assert rows(got.rows) == [("1", "NA", 'a "quoted" cell', None), ("2", " NA", "two\nlines", None), ("3", None, "x", None),
                                  ("4", None, "z", "e"), ("5", None, None, None)]
        assert got.bad.count() == 0


def test_malformed_records_are_split_off_and_counted(spark, tmp_path):
    path = put(tmp_path / "x", a=A + "6,few\n7,NA,ok\n8,too,many,cells\n", b=B + "lonely\n")
    seen = Observation("records")
    got = X.read_exports(spark, path, mode="PERMISSIVE", observation=seen)
    assert seen.get == {"n_records": 9, "n_bad": 3}
    assert sorted(r.record for r in got.bad.collect()) == ["6,few", "8,too,many,cells", "lonely"]
    assert {os.path.basename(r.file) for r in got.bad.select("file").collect()} == {"a.csv", "b.csv"}
    assert {r.id for r in got.rows.collect()} == {"1", "2", "3", "4", "5", "7"}
    with pytest.raises(Exception, match="MALFORMED|[Mm]alformed"):
        X.read_exports(spark, path).rows.collect()


@pytest.mark.parametrize("text", ["id,id\n1,2\n", "id,\n1,2\n", "id,_corrupt_record\n1,2\n"])
def test_unusable_headers_are_refused(spark, tmp_path, text):
    with pytest.raises(ValueError):
        X.read_exports(spark, put(tmp_path / "x", a=text))


def test_a_path_without_headers_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        X.read_exports(spark, put(tmp_path / "x", a=""))


@pytest.fixture
def sides(spark):
    new = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "b"), ("3", "c"), ("3", "d"), (None, "x"), (None, "x")], "id string, q string")
    old = spark.createDataFrame([("1", "o", "p"), ("2", "o", "r"), ("3", "o", "s"), ("4", "o", "t")], "id string, q string, gone string")
    return new, old


def test_guard_reports_in_the_same_pass(spark, sides):
    new, old = sides
    n, o = Observation("n"), Observation("o")
    got = X.load_wide(new, old, "id", on_duplicates="report", observe={"new": n, "old": o})
    assert rows(got) == [("1", "a", "p"), ("2", "b", "r"), ("3", "c", "s")]
    assert n.get == {"n_rows": 5, "n_keys": 3, "n_duplicate_keys": 2, "n_conflicting_keys": 1}
    assert o.get == {"n_rows": 4, "n_keys": 4, "n_duplicate_keys": 0, "n_conflicting_keys": 0}
    assert X.key_report(new, "id").first().asDict() == n.get
    assert len(rows(X.load_wide(new, old, "id"))) == 5  # allowed: they multiply
    assert rows(X.duplicate_keys(new.na.drop(), "id")) == [("2", 2), ("3", 2)]


def test_guard_fails_naming_the_key(spark, sides):
    new, old = sides
    with pytest.raises(Exception, match="duplicate id in the new export: [23]"):
        X.load_wide(new, old, "id", on_duplicates="fail").collect()
    assert len(rows(X.load_wide(new.dropDuplicates(["id"]), old, "id", on_duplicates="fail"))) == 3
    with pytest.raises(ValueError):
        X.load_wide(new, old, "id", on_duplicates="other")


@pytest.mark.parametrize("mode", ["fail", "report"])
def test_guard_adds_no_scan_and_no_shuffle(spark, tmp_path, mode):
    for name in ("new", "old"):
        spark.range(1000).selectExpr("cast(id as string) as id", f"id as {name}").write.parquet(str(tmp_path / name))
    new, old = (spark.read.parquet(str(tmp_path / name)) for name in ("new", "old"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    saved = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = physical_plan(X.load_wide(new, old, "id", on_duplicates=mode))
        assert plan.count("FileScan") == 2
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set(key, saved)


def test_hot_duplicate_collapses_before_the_shuffle(spark):
    rows_ = spark.range(0, 60000, numPartitions=4).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as id", "'x' as q")
    got = X.guard_key(rows_, "id", "report")
    assert got.count() == 40001
    per = X._per_key(rows_, "id").filter("id = 'hot'").first()
    assert (per["_n"], per["_differ"]) == (20000, False)
