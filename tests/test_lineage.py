from __future__ import annotations

import os

from fojas.plans import lineage


def test_written_and_cleared(spark):
    df = lineage.written(spark.range(5), "t")
    path = lineage._written[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    lineage.clear(spark)
    assert not os.path.exists(path) and not lineage._written


def test_broadcast_only_small(spark):
    small = lineage.broadcast_if_small(spark.range(5), 10)
    large = lineage.broadcast_if_small(spark.range(50), 10)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(small) and "ResolvedHint" not in plan(large)
