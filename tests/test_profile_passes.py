"""Heavy hitters against full counts, correlations against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardpulse.operators import profile


def plain_top(values, k):
    counts = pd.Series([v for v in values if v is not None]).value_counts()
    return sorted(((str(v), int(n)) for v, n in counts.items()), key=lambda x: (-x[1], x[0]))[:k]


def got(df):
    return [(r["VALUE"], r["N"]) for r in df.collect()]


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_heavy_hitters_equal_full_counts(spark, size):
    rng = np.random.default_rng(1)
    values = [f"v{int(x)}" for x in rng.zipf(1.3, 20_000) % 5000] + [None] * 50
    df = spark.createDataFrame([(v,) for v in rng.permutation(values).tolist()], "A string").repartition(7)
    report = {}
    assert got(profile.heavy_hitters(df, "A", 10, size, report)) == plain_top(values, 10)
    assert report["scans"] == (1 if report["error"] == 0 else 2)


def test_ties_at_the_end_of_the_list(spark):
    values = [f"t{i:03d}" for i in range(400) for _ in range(3)] + ["big"] * 50
    df = spark.createDataFrame([(v,) for v in values], "A string").repartition(5)
    assert got(profile.heavy_hitters(df, "A", 12, 16)) == plain_top(values, 12)


def test_equally_rare_values_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(profile, "WIDEST_SUMMARY", 64)
    df = spark.range(3000).select(F.col("id").cast("string").alias("A"))
    report = {}
    assert got(profile.heavy_hitters(df, "A", 3, 16, report)) == [("0", 1), ("1", 1), ("10", 1)]
    assert report["scans"] is None


def test_a_column_of_millions_of_values(spark):
    n = 3_000_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.concat(F.lit("w"), F.col("id") % 1700))
                               .otherwise(F.col("id").cast("string")).alias("A"))
    report = {}
    top = got(profile.heavy_hitters(df, "A", 8, report=report))
    assert top[0] == ("hot", n // 3) and report["scans"] == 2
    want = df.groupBy("A").count().orderBy(F.desc("count"), "A").limit(8).collect()
    assert top == [tuple(r) for r in want]


def test_fewer_values_than_asked_and_none(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "A string")
    assert got(profile.heavy_hitters(df, "A", 5)) == [("a", 2), ("b", 1)]
    assert got(profile.heavy_hitters(df.where("A = 'z'"), "A", 5)) == []
    assert got(profile.heavy_hitters(df.where("A IS NULL"), "A", 5)) == []


def test_correlations_with_nulls(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 4)) @ rng.normal(size=(4, 4)) + [0, 1e6, -5, 3]
    x[rng.random(x.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=list("ABCD"))
    pdf["E"], pdf["F"] = 7.0, np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    df = spark.createDataFrame(rows, "A double, B double, C double, D double, E double, F double").repartition(6)
    want = pdf.corr(min_periods=2)
    for r in profile.correlation(df, list("ABCDEF")).collect():
        w = want.loc[r["COL_A"], r["COL_B"]]
        if "E" in (r["COL_A"], r["COL_B"]) or np.isnan(w):
            assert r["CORR"] is None
        else:
            assert r["CORR"] == pytest.approx(w, abs=2e-6)


def test_one_plan_for_all_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, 3.0), (None, 4.0, 5.0)], "A double, B double, C double")
    g = profile.gram(df, ["A", "B", "C"])
    assert g[:3, :3].tolist() == [[2, 2, 1], [2, 3, 2], [1, 2, 2]]
    assert [tuple(r) for r in profile.correlation(df, ["A", "B", "Z"]).collect()] == [("B", "A", -1.0)]
    assert profile.correlation(df.limit(0), ["A", "B"]).first()["CORR"] is None


def test_heavy_hitters_of_equally_rare_values_take_one_summary(spark, monkeypatch):
    """Summaries that no widening can make decide are not taken again: one scan, then all values are counted."""
    taken = []
    whole = profile.frequent_items
    monkeypatch.setattr(profile, "WIDEST_SUMMARY", 64)
    monkeypatch.setattr(profile, "frequent_items", lambda df, col, size: taken.append(size) or whole(df, col, size))
    df = spark.range(60_000).select(F.col("id").cast("string").alias("A"))
    assert got(profile.heavy_hitters(df, "A", 3, 16)) == [("0", 1), ("1", 1), ("10", 1)]
    assert taken == [16]
