"""A family holding over a third of all rows: results stay exact and the
family join is split by AQE's skew handling instead of landing in one task."""

import pytest

from wavepanel.operators.panel import family_waves, first_last_wave
from wavepanel.operators.tables import frequency_table
from wavepanel.operators.transitions import transition_matrix, transition_pairs

LONG = "family string, territory string, time int, question string, answer string"


def _skewed_long(spark):
    rows = []
    for f in range(300):
        for t in range(4):
            rows.append((f"f{f}", "T", t, "Status", "NA" if (f + t) % 7 == 0 else "E1"))
            rows.append((f"f{f}", "T", t, "Q", ["a", "b", "c"][(f * t) % 3]))
    for t in (0, 3):
        rows.append(("hot", "T", t, "Status", "E1"))
    for i in range(2000):  # the hot family's long list of ticked assertions
        rows.append(("hot", "T", i % 4, "M", f"x{i % 50}"))
    # many input splits, as with real files (AQE splits a skewed partition
    # along map outputs, so one map task holding all hot rows could not be split)
    return spark.createDataFrame(rows, LONG).repartition(8), rows


@pytest.fixture
def skew_conf(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    saved = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in saved.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_first_last_wave_with_hot_family(spark, skew_conf):
    long, rows = _skewed_long(spark)
    assert sum(1 for r in rows if r[0] == "hot") * 3 > len(rows)
    periods = first_last_wave(long, "Status")
    got = len(periods.collect())  # executes this plan, so its final adaptive plan is inspectable
    waves = {}
    for fam, _, t, q, a in rows:
        if q == "Status" and a != "NA":
            waves.setdefault(fam, []).append(t)
    kept = {f for f, ts in waves.items() if max(ts) - min(ts) >= 2}
    assert got == sum(1 for r in rows if r[0] in kept)
    plan = periods._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan and "AQEShuffleRead skewed" in plan


def test_aggregates_exact_with_hot_family(spark):
    long, rows = _skewed_long(spark)
    panel = long.withColumnRenamed("time", "wave").selectExpr("*", "CASE WHEN wave = 0 THEN 'FIRST' ELSE 'LAST' END AS time")
    freq = {(r.question, r.time, r.answer): r.n for r in frequency_table(panel, questions=["M"]).collect()}
    brute = {}
    for fam, _, t, q, a in rows:
        if q == "M":
            key = (q, "FIRST" if t == 0 else "LAST", a)
            brute[key] = brute.get(key, 0) + 1
    assert freq == brute
    pairs = transition_pairs(panel, ["M"])
    hot = pairs.filter("family = 'hot'").collect()[0]
    assert (hot.n_first, hot.n_last) == (500, 1500)
    assert sum(r.n for r in transition_matrix(pairs).collect()) == 1
    assert family_waves(long, "Status").filter("family = 'hot'").count() == 1
