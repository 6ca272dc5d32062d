"""Statistics (B19-B23, B25) and exact quantiles."""

import random

import numpy as np
import pytest

from wavepanel.operators.quantiles import exact_quantiles
from wavepanel.operators.stats import (association_matrix, cramers_v, group_describe,
                                       histogram_equal_width, histogram_fixed_width)


def _v(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return cramers_v(df, "a", "b").collect()[0].cramers_v


def test_cramers_v_cases(spark):
    assert _v(spark, [("x", "x"), ("y", "y"), ("x", "x")]) == pytest.approx(1.0)
    indep = [(a, b) for a in "xy" for b in "uv" for _ in range(5)]
    assert _v(spark, indep) == pytest.approx(0.0, abs=1e-12)
    assert _v(spark, [("x", "u")]) == 0.0
    assert _v(spark, [("x", "u"), ("x", "v"), ("x", "u")]) is None
    assert _v(spark, [("x", "x"), ("y", "y"), ("NA", "x"), (None, "y"), ("x", "NA")]) == pytest.approx(1.0)


def test_association_matrix_symmetric_in_unit_interval(spark):
    rnd = random.Random(1)
    rows = [(str(i), rnd.choice("abc"), rnd.choice(["u", "v", "NA"]), rnd.choice("pq")) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x string, y string, z string")
    m = {(r.var1, r.var2): r.cramers_v for r in association_matrix(df, ["x", "y", "z"], "k").collect()}
    assert len(m) == 9
    for (a, b), v in m.items():
        assert 0.0 <= v <= 1.0 + 1e-12
        assert v == pytest.approx(m[(b, a)])
        if a == b:
            assert v == 1.0


def test_histogram_equal_width(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    out = histogram_equal_width(df, "v", bins=5).orderBy("bin").collect()
    assert [r["count"] for r in out] == [3, 2, 2, 2, 2]
    assert [r.breakpoint for r in out] == [2.0, 4.0, 6.0, 8.0, 10.0]
    assert out[-1].cum_count == 11 and out[-1].cum_pct == pytest.approx(100.0)
    same = histogram_equal_width(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", bins=3).collect()
    assert sorted((r.bin, r["count"]) for r in same) == [(1, 2), (2, 0), (3, 0)]


def test_histogram_fixed_width(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 499.9, 500.0, 9999.0, 10000.0, -1.0]], "v double")
    got = sorted((r.bin_start, r["count"]) for r in histogram_fixed_width(df, "v").collect())
    assert got == [(0.0, 2), (500.0, 1), (9500.0, 1)]


def test_exact_quantiles_match_numpy_with_hot_group(spark):
    rnd = np.random.default_rng(5)
    hot = [("hot", float(x)) for x in rnd.integers(0, 50, 3000)]       # many ties
    cold = [("cold", float(x)) for x in rnd.normal(0, 1, 301)]
    one = [("one", 7.0)]
    df = spark.createDataFrame(hot + cold + one, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, ["g"], "v", probs, accuracy=50).collect()}
    for g, vals in (("hot", [v for _, v in hot]), ("cold", [v for _, v in cold]), ("one", [7.0])):
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)
    whole = {r.p: r.q for r in exact_quantiles(df, [], "v", [0.5]).collect()}
    assert whole[0.5] == pytest.approx(float(np.quantile([v for _, v in hot + cold + one], 0.5)))


def test_group_describe(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", 3.0)], "g string, v double")
    got = {(r.g, r.statistic): r.value for r in group_describe(df, "v", ["g"]).collect()}
    assert got[("a", "count")] == 3 and got[("a", "null_count")] == 1
    assert got[("a", "50%")] == 2.0 and got[("a", "25%")] == 1.5 and got[("a", "max")] == 4.0
    assert got[("b", "std")] is None and got[("b", "75%")] == 3.0


def test_group_describe_keeps_null_nan_and_empty_groups(spark):
    nan = float("nan")
    rows = [(None, 1.0), (None, 3.0), ("empty", None), ("empty", nan), ("one", 5.0), ("mixed", 2.0), ("mixed", nan), ("mixed", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {}
    for r in group_describe(df, "v", by=["g"]).collect():
        got.setdefault(r.g, {})[r.statistic] = r.value
    assert {g: len(s) for g, s in got.items()} == {None: 9, "empty": 9, "one": 9, "mixed": 9}
    assert got[None]["50%"] == 2.0 and got[None]["25%"] == 1.5
    assert got["empty"]["count"] == 0 and got["empty"]["null_count"] == 2 and got["empty"]["50%"] is None
    assert (got["one"]["25%"], got["one"]["max"]) == (5.0, 5.0)
    assert (got["mixed"]["mean"], got["mixed"]["max"], got["mixed"]["75%"], got["mixed"]["null_count"]) == (3.0, 4.0, 3.5, 1.0)


def test_cramers_v_with_large_marginals(spark):
    from wavepanel.operators.stats import _v_from_cells

    big = 10**10
    cells = spark.createDataFrame([("a", "x", big), ("b", "y", big)], "v1 string, v2 string, o long")
    r = _v_from_cells(cells, []).first()
    assert r.n == 2 * big and abs(r.cramers_v - 1.0) < 1e-9


def test_association_matrix_is_complete(spark):
    df = spark.createDataFrame([(1, "a", "x", "NA"), (2, "b", "y", None), (3, "a", "x", "NA")], "k int, p string, q string, r string")
    got = {(r.var1, r.var2): (r.n, r.cramers_v) for r in association_matrix(df, ["p", "q", "r"], "k").collect()}
    assert len(got) == 9
    assert got["r", "r"] == (0, 1.0) and got["p", "r"] == got["r", "q"] == (0, 0.0)
