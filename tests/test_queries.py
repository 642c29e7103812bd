"""Every named query against its SQL counterpart."""

import pytest

from plans import final_plan
from oracle import compare, connect
from isotrend.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(medium):
    return connect(medium)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, medium, name):
    rows, problem = compare(spark, con, medium, QUERIES[name], ORACLES[name])
    assert problem is None
    assert rows > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql_without_broadcasts(spark, con, medium, name):
    """The plans meant for scale: no automatic broadcast, small partitions, skewed ones split early."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows, problem = compare(spark, con, medium, QUERIES[name], ORACLES[name])
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert problem is None
    assert rows > 0


@pytest.mark.parametrize("name", ["period_change", "trend_test", "entity_series", "year_snapshot"])
def test_orders_are_scanned_once_with_the_dates_pushed(spark, medium, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = final_plan(QUERIES[name](spark, medium))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = [line for line in plan.split("FileScan parquet ")[1:] if "o_totalprice" in line.split("]")[0]]
    assert len(scans) == 1
    pushed = scans[0].split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "(o_orderdate,19" in pushed or "(o_orderdate,20" in pushed


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert contract.oracle_sql().keys() <= contract.queries().keys()
    assert set(QUERIES) <= set(contract.queries())
