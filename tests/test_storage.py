"""Tables stored by id: equal results, no exchange on the joined sides, hot ids apart."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from cardpulse.functions import norm
from cardpulse.operators import identity
from cardpulse.sources import storage


def tables(spark, rows=900, hot_share=0.4):
    rng = random.Random(4)
    prime, txn = [], []
    for n in range(rows):
        i = "7" if rng.random() < hot_share else rng.choice([None, "x9", *map(str, range(100, 160))])
        prime.append((n, i, rng.choice("PQ") if rng.random() > 0.05 else None, dt.date(2025, rng.randint(1, 3), 1),
                      rng.choice([None, dt.date(1980, 1, 1), dt.date(1990, 1, 1)]), rng.choice(["NORM", "CLSB"]), rng.choice(["NORM", "CLSB"])))
    for n in range(rows):
        i = "101" if rng.random() < hot_share else rng.choice([None, "7", *map(str, range(90, 170))])
        txn.append((n, i, rng.choice(["P", "Q", None])))
    return (spark.createDataFrame(prime, "ROW_ID long, RIMNO string, PRODUCT_NAME string, SNAP_MONTH date, DOB date, STATUS string, CARD_STATUS string"),
            spark.createDataFrame(txn, "TXN_ID long, RIMNO string, PRODUCT_NAME string"))


def bag(df):
    return Counter(tuple(str(v) for v in r) for r in df.collect())


def nodes(df):
    """Operators of the plan before adaptive execution, by depth-first text."""
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_results_equal_the_shuffled_chain(spark):
    prime, txn = tables(spark)
    seg = identity.segment(identity.assign_customer_ids(prime))
    mapped = identity.map_transactions(txn, identity.customer_lookup(seg))
    got = storage.identify(prime, txn, buckets=8, hot_factor=2)
    assert bag(got.segmented.select(seg.columns)) == bag(seg)
    assert bag(got.mapped.select(mapped.columns)) == bag(mapped)


def test_hot_ids_are_apart_in_all_tables(spark):
    prime, txn = tables(spark)
    hot = storage.hot_ids([prime, txn], 8, factor=2)
    assert hot == ["101", "7"]
    rows = storage.store(prime, 8, hot)
    assert rows.cold.where(F.col("RIMNO").isin(hot) | F.col("RIMNO").isNull()).count() == 0
    assert bag(rows.all()) == bag(prime)
    per_bucket = rows.cold.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_bucket < prime.count() / 3
    rows.drop()


def test_joined_sides_need_no_exchange(spark):
    prime, txn = tables(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = storage.identify(prime, txn, buckets=8, hot_factor=2)
        for df in (got.cold_segmented, got.cold_mapped):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
            assert "Exchange" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_tables(spark):
    prime, txn = tables(spark, 5)
    got = storage.identify(prime.limit(0), txn.limit(0), buckets=4)
    assert got.segmented.count() == 0 and got.mapped.count() == 0


def test_filters_on_ids_work_out_a_raw_id_few_times(spark):
    """Every mention of the raw id in a plan is trimmed anew for each row: there were over twenty."""
    raw = spark.createDataFrame([(" 1,234 ",), ("007.0",), ("0",), ("x9",), ("",), (" ",), (None,), ("12.5",), ("00x",)], "RIMNO string")
    ids = raw.withColumn("RIMNO", norm.norm_id("RIMNO")).withColumn("RIMNO", norm.numeric_id("RIMNO"))
    kept = ids.where(F.col("RIMNO").isNotNull() & ~F.col("RIMNO").isin(["5"]))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") <= 4, plan
    assert [r[0] for r in kept.collect()] == ["1234", "7", "0"]
    assert [r[0] for r in raw.select(norm.norm_id("RIMNO")).collect()] == ["1234", "7", "0", "x9", None, None, None, "12.5", "0x"]
