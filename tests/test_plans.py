"""Plan tests: no Python UDF, no all-pairs join, no shuffled dictionary."""

import pytest

SF = "/root/testdata/sf0.001"


def _queries():
    from wavepanel.plans.catalog import QUERIES
    return sorted(q for q in QUERIES if q not in ("long_parquet_roundtrip", "csv_export_roundtrip"))


@pytest.mark.parametrize("name", _queries())
def test_plan_is_jvm_side_and_pair_free(spark, name):
    from wavepanel.plans.catalog import QUERIES
    from wavepanel.plans.inspect import problems
    from wavepanel.session import checkpoint_dir

    checkpoint_dir(spark)
    assert problems(QUERIES[name](spark, SF)) == []


@pytest.mark.parametrize("name", _queries())
def test_no_single_partition_exchange_over_raw_rows(spark, name):
    from wavepanel.plans.catalog import QUERIES
    from wavepanel.plans.inspect import single_partition_over_raw_rows

    assert single_partition_over_raw_rows(QUERIES[name](spark, SF)) == []


def test_panel_from_export_has_one_shuffle_only(spark):
    """The panel is map-only after the single aggregate of orders per customer."""
    from wavepanel.plans import fixture as fx
    from wavepanel.plans.inspect import physical_plan

    plan = physical_plan(fx.panel(spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plan


def test_scan_prunes_columns(spark):
    from wavepanel.plans.catalog import QUERIES
    from wavepanel.plans.inspect import physical_plan

    plan = physical_plan(QUERIES["association_matrix"](spark, SF))
    assert "documents" in plan and "text:" not in plan  # the document text is never read


def test_size_for_cluster_sets_partitioning(spark):
    from wavepanel.session import size_for_cluster

    saved = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    try:
        got = size_for_cluster(spark, total_cores=8000, shuffle_bytes=2 * 10**12)
        assert int(got["spark.sql.shuffle.partitions"]) == 24000
        small = size_for_cluster(spark, total_cores=8, shuffle_bytes=10**6)
        assert int(small["spark.sql.shuffle.partitions"]) == 24
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
        for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",
                  "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                  "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"):
            spark.conf.unset(k)


def test_single_partition_check_flags_raw_rows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from wavepanel.plans.inspect import single_partition_over_raw_rows
    from wavepanel.sources.readers import table

    orders = table(spark, SF, "orders")
    bad = orders.withColumn("share", F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy()))
    assert single_partition_over_raw_rows(bad) != []
    good = orders.groupBy("o_orderstatus").count().withColumn("t", F.sum("count").over(Window.partitionBy()))
    assert single_partition_over_raw_rows(good) == []


def test_gathering_aggregates_are_flagged(spark):
    from pyspark.sql import functions as F

    from wavepanel.plans.inspect import problems
    from wavepanel.sources.readers import table

    orders = table(spark, SF, "orders")
    assert "collect_list" in problems(orders.groupBy("o_orderstatus").agg(F.collect_list("o_orderkey")))
    assert "percentile" in problems(orders.groupBy("o_orderstatus").agg(F.percentile("o_totalprice", 0.5)))
    assert problems(orders.groupBy("o_orderstatus").agg(F.percentile_approx("o_totalprice", 0.5))) == []


def test_panel_generates_stay_in_codegen(spark):
    """Unpivot, explode and FIRST/LAST tagging run inside whole-stage codegen
    (no lambda functions, which would fall back to interpreted evaluation)."""
    from wavepanel.plans import fixture as fx

    df = fx.panel(spark, SF).select("*")
    df.collect()  # executes this plan itself, so its final adaptive plan is inspectable
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    generates = [line for line in final.splitlines() if "Generate " in line]
    assert len(generates) == 3
    assert all("*(" in line for line in generates), generates


def test_question_filter_prunes_stored_long_table(spark):
    import os
    import uuid

    from wavepanel.operators.tables import frequency_table
    from wavepanel.plans import fixture as fx
    from wavepanel.plans.inspect import physical_plan
    from wavepanel.session import checkpoint_dir
    from wavepanel.sources.readers import read_long, write_long

    path = os.path.join(checkpoint_dir(spark), f"pruning-{uuid.uuid4().hex}")
    write_long(fx.panel(spark, SF), path)
    table = frequency_table(read_long(spark, path), questions=["Status"], recode=fx.recode(spark))
    plan = physical_plan(table)
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "PartitionFilters: [isnotnull(question" in scan and "(question" in scan and "Status" in scan
    assert "family" not in scan.split("ReadSchema:")[1]  # only the columns the table needs are read
    assert {r.question for r in table.collect()} == {"Status"}


def test_every_query_has_a_description_and_an_oracle():
    import __spark_entry__ as E
    from wavepanel.plans.catalog import DESCRIPTIONS, QUERIES

    assert set(DESCRIPTIONS) == set(QUERIES)
    assert set(QUERIES) <= set(E.oracle_sql()) and set(QUERIES) <= set(E.queries())


def test_question_pruning_reaches_the_unpivot(spark):
    """A single-question table reads and unpivots that question's columns only."""
    from wavepanel.plans.catalog import QUERIES
    from wavepanel.plans.inspect import physical_plan

    plan = physical_plan(QUERIES["transition_matrix"](spark, SF))
    assert "Status_T0" in plan and "Priority_T0" not in plan and "Income_T0" not in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("name", ["frequency_all_questions", "frequency_by_territory", "frequency_by_flag",
                                  "transition_matrix", "transitions_by_group", "descriptive_table"])
def test_totals_are_no_windows(spark, name):
    from wavepanel.plans.catalog import QUERIES
    from wavepanel.plans.inspect import physical_plan

    assert "Window" not in physical_plan(QUERIES[name](spark, SF))
