"""Grouped histograms, many-to-many flows, narrowing quantiles, the panel store,
co-partitioned storage and the contingency file."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wavepanel import schema as S
from wavepanel.operators import quantiles as Q
from wavepanel.operators import stats as ST
from wavepanel.operators import transitions as TR
from wavepanel.operators.incremental import PanelStore
from wavepanel.operators.panel import first_last_wave, panel_first_last
from wavepanel.plans.inspect import physical_plan
from wavepanel.sources.exports import load_wide
from wavepanel.sources.readers import write_bucketed

PANEL = "family string, question string, time string, answer string, grp string"


def test_histogram_by_group(spark):
    rows = [("a", x) for x in (0.0, 1.0, 5.0, 10.0, 99.0)] + [("b", 3.0)] * 4 + [(None, 1.0), (None, 2.0), ("c", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.bin): r for r in ST.histogram_equal_width(df, F.col("v"), bins=2, upper_limit=50, by=["g"]).collect()}
    assert {k: r["count"] for k, r in got.items()} == {("a", 1): 3, ("a", 2): 1, ("b", 1): 4, ("b", 2): 0, (None, 1): 1, (None, 2): 1}
    assert (got["a", 1].breakpoint, got["a", 2].breakpoint, got["b", 2].breakpoint) == (5.0, 10.0, 3.0)
    assert (got["a", 1].percentage, got["a", 2].cum_count, got["b", 2].cum_pct) == (75.0, 4, 100.0)
    whole = ST.histogram_equal_width(df, F.col("v"), bins=3).collect()
    assert [r["count"] for r in sorted(whole)] == [10, 0, 1]
    assert ST.histogram_equal_width(df.limit(0), F.col("v"), by=["g"]).collect() == []


def brute_flows(rows, listed=None):
    at = {}
    for f, q, t, a, g in rows:
        if listed is None or a in listed:
            at.setdefault((f, q), {"FIRST": {}, "LAST": {}})[t].setdefault(a, []).append(g)
    flows = Counter()
    for (_, q), w in at.items():
        groups = [g for gs in w["FIRST"].values() for g in gs]
        for a in w["FIRST"]:
            for b in w["LAST"] or ([] if listed else [None]):
                flows[q, min(groups), a, b] += 1
    return flows


@pytest.mark.parametrize("answers", [4, 150])
def test_many_to_many_flows(spark, answers):
    r = random.Random(answers)
    rows = [(f"f{r.randrange(60)}", r.choice("QR"), r.choice(["FIRST", "LAST"]), f"x{r.randrange(answers)}", r.choice("gh")) for _ in range(500)]
    rows += rows[:50] + [("two", "Q", t, a, "g") for t, a in (("FIRST", "x0"), ("FIRST", "x1"), ("LAST", "x2"), ("LAST", "x3"))]
    rows += [("hot", "Q", "FIRST" if i % 2 else "LAST", f"x{i % 3}", "g") for i in range(600)]
    panel = spark.createDataFrame(rows, PANEL)
    got = {(x.question, x.grp, x.first_answer, x.last_answer): x for x in TR.transition_flows(panel, dims=["grp"]).collect()}
    assert {k: x.n for k, x in got.items()} == dict(brute_flows(rows))
    for (q, g, a, _), x in got.items():
        total = sum(y.n for (q2, g2, a2, _), y in got.items() if (q2, g2, a2) == (q, g, a))
        assert x.row_pct == pytest.approx(100 * x.n / total)
    listed = [f"x{i}" for i in range(3)]
    order = spark.createDataFrame([(q, 0, a, i) for q in "QR" for i, a in enumerate(listed)], "question string, variant int, answer string, rank int")
    got = {(x.question, x.grp, x.first_answer, x.last_answer): x.n for x in TR.transition_flows(panel, order=order, dims=["grp"]).collect()}
    assert got == dict(brute_flows(rows, listed))


def test_two_by_two_answers_give_four_flows(spark):
    rows = [("f", "Q", t, a, "g") for t, a in (("FIRST", "a"), ("FIRST", "b"), ("LAST", "c"), ("LAST", "d"))]
    flows = TR.transition_flows(spark.createDataFrame(rows, PANEL), ["Q"]).collect()
    assert {(x.first_answer, x.last_answer, x.n) for x in flows} == {(a, b, 1) for a in "ab" for b in "cd"}
    assert TR.transition_flows(spark.createDataFrame([], PANEL)).collect() == []


def test_paired_scores_count_answers(spark):
    rows = [("f", "Q", "FIRST", "2", "g"), ("f", "Q", "FIRST", "10", "g"), ("f", "Q", "LAST", "3", "g"), ("h", "Q", "FIRST", "1", "g")]
    got = sorted(map(tuple, TR.paired_scores(spark.createDataFrame(rows, PANEL), "Q").collect()))
    assert got == [("f", 2.0, 3.0, 2, 1), ("h", 1.0, None, 1, 0)]
    assert TR.paired_scores_summary(TR.paired_scores(spark.createDataFrame(rows, PANEL), "Q")).first().n_conflicts == 1


def test_quantile_brackets_narrow(spark):
    """Brackets shrink until a task has few values to sort, also in a group
    that holds most of the rows; the quantiles stay exact."""
    r = random.Random(1)
    data = [("big", r.gauss(0, 1)) for _ in range(40000)] + [("ties", float(r.choice([1, 1, 1, 2, 7]))) for _ in range(9000)]
    data += [("small", float(i)) for i in range(30)] + [(None, r.random()) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    probs, accuracy, inside = [0.1, 0.25, 0.5, 0.99], 200, 60
    vals = df.select("g", Q.number(F.col("v")).alias("_x"))
    first = vals.groupBy("g").agg(*Q.brackets(F.col("_x"), probs, accuracy))
    narrow = Q.narrowed(vals, first, ["g"], probs, accuracy, inside)
    by = {}
    for g, v in data:
        by.setdefault(g, []).append(v)
    for s in narrow.collect():
        if s["_n"] > accuracy:
            for i in range(len(probs)):
                low, high = s["_s"][2 * i], s["_s"][2 * i + 1]
                held = [v for v in by[s["g"]] if low <= v <= high]
                assert len(held) <= inside or len(set(held)) <= 3
    got = {(x.g, x.p): x.q for x in Q.exact_quantiles(df, ["g"], "v", probs, accuracy, inside=inside).collect()}
    for g, vs in by.items():
        vs.sort()
        for p in probs:
            h = p * (len(vs) - 1)
            lo = int(h)
            want = vs[lo] + (h - lo) * (vs[min(lo + 1, len(vs) - 1)] - vs[lo])
            assert got[g, p] == pytest.approx(want, abs=1e-12)
    one = {x.p: x.q for x in Q.exact_quantiles(df.filter("g = 'big'"), [], "v", probs, accuracy, inside=inside).collect()}
    assert one == {p: got["big", p] for p in probs}


def test_a_quantile_outside_its_bracket_is_an_error(spark):
    vals = spark.range(1000).selectExpr("cast(id as double) as _x")
    wrong = spark.createDataFrame([(1000, [10.0, 20.0])], "_n long, _s array<double>")
    with pytest.raises(Exception, match="outside its bracket"):
        Q.from_brackets(vals, wrong, [], [0.5], accuracy=100).collect()


LONG = "family string, time int, question string, answer string"


def test_panel_store_equals_the_full_run_after_each_load(spark, tmp_path):
    r = random.Random(3)
    waves = {w: [(f"f{i}", w, q, r.choice(["NA", "a", "b"])) for i in range(40) for q in ("Status", "Q") if r.random() < 0.8] for w in range(4)}
    store = PanelStore(spark, str(tmp_path / "panel"), "Status")
    loads = [(f"w{w}", waves[w]) for w in (2, 0, 3, 1)]
    changed = [(f, w, q, "NA" if q == "Status" else a) for f, w, q, a in waves[3]]
    loads += [("w0", waves[0]), ("w3", changed)]  # delivered again; corrected
    now, sizes = {}, []
    for name, rows in loads:
        store.load(name, spark.createDataFrame(rows, LONG))
        now[name] = rows
        whole = spark.createDataFrame([x for y in now.values() for x in y], LONG)
        want = first_last_wave(whole, "Status")
        columns = [S.FAMILY, S.TIME, S.QUESTION, S.ANSWER, S.TIME_FIRST, S.TIME_LAST]
        assert sorted(store.periods().select(columns).collect()) == sorted(want.select(columns).collect())
        panel = sorted(store.panel().select(S.FAMILY, S.TIME, S.QUESTION, S.ANSWER).collect())
        assert panel == sorted(panel_first_last(want).select(S.FAMILY, S.TIME, S.QUESTION, S.ANSWER).collect())
        sizes.append(len(panel))
    assert sizes[0] == 0 and sizes[3] == sizes[4] > sizes[5] > 0


def test_panel_store_reads_bounds_not_answers(spark, tmp_path):
    store = PanelStore(spark, str(tmp_path / "panel"), "Status")
    store.load("a", spark.createDataFrame([("f", 0, "Status", "x")], LONG))
    store.load("b", spark.createDataFrame([("f", 3, "Status", "x")], LONG))
    plan = physical_plan(store.bounds())
    assert "time_first" in plan and "answer" not in plan
    assert [tuple(x) for x in store.bounds().collect()] == [("f", 0, 3)]


def test_co_partitioned_tables_need_no_shuffle(spark, tmp_path):
    key = "spark.sql.autoBroadcastJoinThreshold"
    saved = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rows = [(f"f{i}", t, "Status", "NA" if (i + t) % 5 == 0 else "a") for i in range(200) for t in range(4)]
        long = spark.createDataFrame(rows, LONG)
        stored = write_bucketed(long, f"long_{uuid.uuid4().hex}", S.FAMILY, 4, str(tmp_path / "long"))
        got = first_last_wave(stored, "Status", colocated=True)
        assert "Exchange" not in physical_plan(got)
        columns = sorted(got.columns)
        assert sorted(got.select(columns).collect()) == sorted(first_last_wave(long, "Status").select(columns).collect())
        sides = [write_bucketed(spark.range(100).selectExpr("cast(id as string) as id", f"id as {n}"), f"{n}_{uuid.uuid4().hex}", "id", 4,
                                str(tmp_path / n)) for n in ("fresh", "stale")]
        for mode in ("allow", "fail"):
            merged = load_wide(*sides, "id", on_duplicates=mode)
            assert "Exchange" not in physical_plan(merged)
            assert merged.count() == 100
    finally:
        spark.conf.set(key, saved)


def test_contingency_file_has_any_number_of_categories(spark):
    n = 20_000
    df = spark.range(n + 500).selectExpr("if(id % 2 = 0, 'even', 'odd, or') as r", f"concat('c', id % {n}) as c")
    header, lines = ST.contingency_lines(df, "r", "c")
    cats = sorted(f"c{i}" for i in range(n))
    assert header == ",".join(["r", *cats])
    counts = Counter((i % 2, f"c{i % n}") for i in range(n + 500))
    got = {x.row: x.line for x in lines.collect()}
    assert set(got) == {"even", "odd, or"}
    assert got["even"] == ",".join(["even", *[str(counts[0, c]) for c in cats]])
    assert got["odd, or"] == ",".join(['"odd, or"', *[str(counts[1, c]) for c in cats]])
