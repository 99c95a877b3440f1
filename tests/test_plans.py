"""Physical-plan properties that matter at scale."""

import os

from cardpulse.operators import churn
from cardpulse.sources import files
from cardpulse.sources import fixtures as fx

from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_month_scan_prunes_partitions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "prime")
    files.write_partitioned(fx.prime(spark, SF001), path, ["SNAP_MONTH"])
    prime = spark.read.parquet(path)
    out = churn.activation_lifecycle(prime)
    plan = _plan(out)
    assert "PartitionFilters: [isnotnull(SNAP_MONTH" in plan and "= 2026-01-01" in plan
    expect = churn.activation_lifecycle(fx.prime(spark, SF001))
    key = lambda r: (str(r["RIMNO"]), str(r["ROW_ID"]), r["ACTIVATION_CHURN_TYPE"])
    assert sorted(map(key, out.collect())) == sorted(map(key, expect.collect()))


def test_lifecycle_aggregates_before_the_shuffle(spark):
    plan = _plan(churn.activation_flags(fx.prime(spark, SF001)))
    # partial aggregation on the map side: two HashAggregate nodes around one exchange
    assert plan.count("HashAggregate") >= 2 and "Exchange hashpartitioning(RIMNO" in plan
