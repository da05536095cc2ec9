"""Plan shape: how many exchanges move row-level data (not yet aggregated).

The executed plan (after adaptive re-planning) is walked, cached plans
included; an exchange counts when a file scan is reachable below it without
passing an aggregate.
"""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

AGGREGATES = {"HashAggregateExec", "SortAggregateExec", "ObjectHashAggregateExec"}


def _children(node):
    name = node.getClass().getSimpleName()
    if name == "InMemoryTableScanExec":
        return [node.relation().cachedPlan()]
    if name.endswith("QueryStageExec"):  # shuffle, broadcast, table-cache and result stages
        return [node.plan()]
    if name == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if name == "ReusedExchangeExec":
        return [node.child()]
    ch = node.children()
    return [ch.apply(i) for i in range(ch.size())]


def row_level_exchanges(plan):
    found = {}

    def reach(node):
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            return True
        kids = [reach(c) for c in _children(node)]
        r = any(kids) and name not in AGGREGATES
        if name == "ShuffleExchangeExec" and any(kids):
            found[node.id()] = node.outputPartitioning().toString()
        return r

    reach(plan)
    return sorted(found.values())


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    spark.catalog.clearCache()
    return row_level_exchanges(plan)


def test_episodes_on_plain_table_shuffle_rows_once(spark):
    ex = _plan(spark, "lineitem_episodes")
    assert len(ex) == 1 and "_id" in ex[0] and "_c" in ex[0], ex


@pytest.mark.parametrize("name", ["primary_outcome", "alarm_duration", "desat_area_episode", "desat_area_rows"])
def test_outcomes_shuffle_rows_once_after_fixture(spark, name):
    ex = _plan(spark, name)
    # the fixture's one-row-per-tick exchange, then the (id, chunk) exchange
    assert len(ex) == 2, ex
    assert any("_id" in e and "_c" in e for e in ex), ex


def row_level_sorts(plan):
    """Sort-based aggregates that rows reach without passing another aggregate."""
    found = []

    def reach(node):
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            return True
        below = any([reach(c) for c in _children(node)])
        if name in ("SortAggregateExec", "ObjectHashAggregateExec") and below:
            found.append(name)
        return below and name not in AGGREGATES

    reach(plan)
    return found


@pytest.mark.parametrize("name", ["first_row", "alarms_all", "alarms_appropriate", "cluster_size_randomized", "nurse_right_join"])
def test_first_rows_are_hash_aggregates(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    assert row_level_sorts(df._jdf.queryExecution().executedPlan()) == []


@pytest.mark.parametrize("name", ["alarms_all", "cluster_size_analyzed", "units"])
def test_other_queries_shuffle_rows_once(spark, name):
    # only the fixture's one-row-per-tick exchange moves rows
    ex = _plan(spark, name)
    assert len(ex) == 1, ex


def test_ingest_moves_rows_once_for_each_clock(spark):
    """One-row-per-second, then one exchange by (recording, day) for the monitor's
    clock and one for the tablet's (nurse log and events together), with
    broadcasts of the small day tables switched off."""
    from tocsin.plans.ingest import ObserverSheets, ingest
    from tocsin.sources import literals
    rows = spark.read.parquet(f"{SF_SMALL}/events.parquet").selectExpr(
        "printf('E%03d', user_id) AS id", "event_id AS line", "CAST(date_trunc('hour', ts) AS timestamp) AS datetime")
    text = "id string, row int, {} string, time string"
    sheet = lambda name: spark.createDataFrame([("E001", 1, "x", "01/01/2024 00:00:00")], text.format(name))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = ingest(rows, ObserverSheets(sheet("device"), sheet("nurse"), sheet("event")), literals.allocation(spark))
        df.write.format("noop").mode("overwrite").save()
        ex = row_level_exchanges(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set(key, before)
    days = [e for e in ex if "_day" in e]
    assert len(days) == 2 and len(ex) == 3, ex


def test_building_the_ingest_only_reads_schemas(spark):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    E.queries()["ingest_series"](spark, SF_SMALL)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert jobs <= 4, jobs


@pytest.mark.parametrize("name", ["primary_outcome", "alarm_duration", "alarms_all", "cluster_size_analyzed"])
def test_exclusion_never_moves_the_series(spark, name):
    """With broadcasts off, as for a long exclusion list: the fixture's exchange, the fold's
    for outcomes with episodes, and no other."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = E.queries()[name](spark, SF_SMALL)
        df.write.format("noop").mode("overwrite").save()
        ex = row_level_exchanges(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set(key, before)
        spark.catalog.clearCache()
    series = [e for e in ex if "patient" not in e and "_ex" not in e]
    assert len(series) == (1 if name in ("alarms_all", "cluster_size_analyzed") else 2), ex
