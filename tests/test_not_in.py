"""NOT IN with nulls on either side, as SQL answers it."""

import pytest
from tidemill.plans.relational_queries import not_in


@pytest.mark.parametrize("listed", [[], [None], [1, None], [1], [7], [1, 1, 2]])
def test_not_in(spark, listed):
    keys = [1, 2, 3, None, 3]
    df = spark.createDataFrame([(k, 0) for k in keys], "k int, n int")
    other = spark.createDataFrame([(x,) for x in listed], "x int")
    got = sorted((r.k is not None, r.k or 0) for r in not_in(df, "k", other, "x").collect())
    want = [k for k in keys if not listed or (k is not None and None not in listed and k not in listed)]
    assert got == sorted((k is not None, k or 0) for k in want)
