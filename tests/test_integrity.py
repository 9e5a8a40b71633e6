"""The count of edges whose ends are no nodes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tidemill import registry

from .duck import TABLES, compare


@pytest.fixture
def torn(spark, sf, tmp_path):
    """Tables with missing, null and repeated keys."""
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    customer, part, orders, lines = map(read, ("customer", "part", "orders", "lineitem"))
    null_if = lambda c, every: F.when(F.col(c) % every != 0, F.col(c)).alias(c)
    made = {
        "customer": customer.where("c_custkey % 7 <> 1").union(customer.where("c_custkey % 3 = 0")),
        "part": part.where("p_partkey % 5 <> 2").union(part.where("p_partkey % 4 = 0")),
        "orders": orders.select(*[null_if("o_custkey", 11) if c == "o_custkey" else c for c in orders.columns]),
        "lineitem": lines.select(*[null_if("l_partkey", 13) if c == "l_partkey" else c for c in lines.columns]),
    }
    for name in TABLES:
        if name in made:
            made[name].write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            (tmp_path / f"{name}.parquet").symlink_to(Path(sf) / f"{name}.parquet")
    return str(tmp_path)


def test_missing_null_and_repeated_ends(spark, torn):
    got = compare(spark, torn, registry.QUERIES["g_integrity"], registry.ORACLES["g_integrity"])
    assert len(got) == 7 and sum(n > 0 for n, _ in got) == 4


def test_edges_are_not_sorted_to_meet_nodes(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES["g_integrity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin [src" in plan and "SortMergeJoin [src" not in plan
