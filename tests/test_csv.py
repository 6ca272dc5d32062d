"""Exports as CSV: what analysts' files hold comes through unchanged."""

import pytest

from wavepanel.sources.readers import read_export_csv, write_export_csv


def test_quotes_commas_line_breaks_and_spaces(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,q,r\n1,"say ""a,b"" now",z\n2,"two\nlines", NA\n3,,"x"\n')
    got = {r.id: (r.q, r.r) for r in read_export_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"1": ('say "a,b" now', "z"), "2": ("two\nlines", " NA"), "3": (None, "x")}


def test_round_trip_is_the_identity(spark, tmp_path):
    rows = [("1", ' NA', 'a "b", c'), ("2", "two\nlines", None), ("3", "tail ", "\\ back")]
    df = spark.createDataFrame(rows, "id string, q string, r string")
    write_export_csv(df, str(tmp_path / "out"))
    back = read_export_csv(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == rows


def test_a_different_header_order_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,q,r\n1,a,b\n")
    (tmp_path / "in" / "b.csv").write_text("id,r,q\n2,b,a\n")
    with pytest.raises(Exception):
        read_export_csv(spark, str(tmp_path / "in"), columns=["id", "q", "r"]).collect()
