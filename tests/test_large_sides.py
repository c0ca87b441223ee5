"""Sides of joins that hold every document aren't sent out whole, however small an estimate takes them for."""

import pytest

from vellum.plans import carried, redlines


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 7), (2, 8), (35, 9)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("query", [redlines.gate_collateral, carried.remarks_done, carried.remarks_removed])
def test_no_side_is_broadcast(spark, orders, query):
    text = query(spark, orders)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text, text


def test_properties_meet_in_one_join(spark, orders):
    text = redlines.gate_collateral(spark, orders)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join Left") < 8, text.count("Join Left")
