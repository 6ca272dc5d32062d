"""Every registered query equals its independent DuckDB oracle (sf0.001),
and key golden numbers (FIXTURES.md section 5, sf0.01)."""

import duckdb
import pytest

SF_SMALL = "/root/testdata/sf0.001"
SF_GOLDEN = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    from tools.check_oracle import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _names():
    from wavepanel.plans.catalog import QUERIES
    return sorted(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from tools.check_oracle import compare

    problems, *_ = compare(spark, duck, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert problems == []


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert {"question", "time", "answer", "n", "pct"} <= set(df.columns)


def test_golden_numbers(spark):
    from wavepanel.plans.catalog import QUERIES

    dist = {(r.time_first, r.time_last): r["count"] for r in QUERIES["period_distribution"](spark, SF_GOLDEN).collect()}
    assert dist == {(0, 3): 842, (0, 2): 558, (1, 3): 37}
    freq = {(r.question, r.time, r.answer): (r.n, r.pct) for r in
            QUERIES["frequency_all_questions"](spark, SF_GOLDEN).filter("question = 'Status'").collect()}
    assert freq[("Status", "FIRST", "F")] == (445, pytest.approx(30.967293, abs=1e-6))
    assert freq[("Status", "LAST", "P")] == (501, pytest.approx(34.864301, abs=1e-6))
    miss = {r.question: (r.count_first, r.count_last, r.pct_last) for r in
            QUERIES["missing_table"](spark, SF_GOLDEN).collect()}
    assert miss["Income"] == (0, 45, pytest.approx(3.131524, abs=1e-6))
    assert miss["Priority"][:2] == (130, 135)
    trans = {(r.first_answer, r.last_answer): r.n for r in QUERIES["transition_matrix"](spark, SF_GOLDEN).collect()}
    assert trans[("F", "F")] == 149 and trans[("P", "P")] == 174
    v = {(r.var1, r.var2): r.cramers_v for r in QUERIES["association_matrix"](spark, SF_GOLDEN).collect()}
    assert v[("source", "quality")] == pytest.approx(0.290324, abs=1e-6)
    assert v[("lang", "source")] == pytest.approx(0.223438, abs=1e-6)
    li = QUERIES["cramers_v_pair"](spark, SF_GOLDEN).collect()[0]
    assert li.cramers_v == pytest.approx(0.001262, abs=1e-6)
    hist = [r["count"] for r in QUERIES["hist_fixed_width_orders"](spark, SF_GOLDEN).orderBy("bin_start").collect()]
    assert hist == [1460, 1497, 1533, 1456, 1506, 1515, 1495, 1560, 1485, 1493]
    pc = {r.time: r for r in QUERIES["income_per_capita"](spark, SF_GOLDEN)
          .groupBy("time").agg({"per_capita": "avg", "*": "count"}).collect()}
    assert pc["FIRST"]["count(1)"] == 1400 and pc["LAST"]["count(1)"] == 1357
    assert pc["FIRST"]["avg(per_capita)"] == pytest.approx(247574.334716, abs=1e-5)


def test_more_golden_numbers(spark):
    from pyspark.sql import functions as F

    from wavepanel.operators.stats import group_describe
    from wavepanel.plans import fixture as fx
    from wavepanel.plans.catalog import QUERIES
    from wavepanel.sources.readers import table

    pc = {r.time: (r.n, r.mean) for r in QUERIES["income_per_capita"](spark, SF_GOLDEN)
          .groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.avg("per_capita").alias("mean")).collect()}
    assert pc["LAST"][0] == 1357 and pc["LAST"][1] == pytest.approx(228848.330023, abs=1e-5)

    wide = fx.export(spark, SF_GOLDEN)
    flags = {(f, r[f]): r["count"] for f in ["flag_a", "flag_b", "flag_c", "flag_d"]
             for r in wide.groupBy(f).count().collect()}
    assert flags[("flag_a", "NA")] == 89 and flags[("flag_a", "nao")] == 459
    assert flags[("flag_a", "sim")] == 843 and flags[("flag_a", "talvez")] == 109
    assert (flags[("flag_b", "NA")], flags[("flag_b", "nao")], flags[("flag_b", "sim")]) == (79, 734, 687)
    assert (flags[("flag_c", "nao")], flags[("flag_c", "sim")]) == (1016, 484)
    assert (flags[("flag_d", "nao")], flags[("flag_d", "sim")]) == (1378, 122)

    miss = {r.question: (r.count_first, r.count_last, r.pct_first, r.pct_last)
            for r in QUERIES["missing_table"](spark, SF_GOLDEN).collect()}
    assert miss["Items"] == (63, 63, pytest.approx(3.234086, abs=1e-6), pytest.approx(3.767943, abs=1e-6))
    assert miss["Priority"][2:] == (pytest.approx(9.046625, abs=1e-6), pytest.approx(9.394572, abs=1e-6))
    assert miss["HowMany"] == (0, 0, 0.0, 0.0) and miss["Status"] == (0, 0, 0.0, 0.0)

    d = {r.statistic: r.value for r in group_describe(table(spark, SF_GOLDEN, "orders"), "o_totalprice").collect()}
    assert d["count"] == 15000 and d["min"] == 1013.7 and d["max"] == 499978.59
    assert d["mean"] == pytest.approx(250562.641337, abs=1e-6)
    assert d["std"] == pytest.approx(143990.004194, abs=1e-6)
    assert (d["25%"], d["50%"], d["75%"]) == (pytest.approx(125475.5), pytest.approx(251485.485),
                                              pytest.approx(374367.44))
