"""Months as bits against plain sets, beyond one word; the mergeable state against full runs."""

import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cardpulse.functions import monthmask as mm
from cardpulse.functions.months import label_of
from cardpulse.operators import audit, churn, state

MANY = [dt.date(2010 + i // 12, i % 12 + 1, 1) for i in range(130)]   # three words


def plain_presence(seed, months, ids=40):
    rng = random.Random(seed)
    return {f"c{i}": sorted(rng.sample(range(1, len(months) + 1), rng.randint(1, min(9, len(months))))) for i in range(ids)}


def rows_of(spark, seen, months, extra=()):
    rows = [(i, months[r - 1]) for i, ranks in seen.items() for r in ranks for _ in range(2)]
    return spark.createDataFrame(rows + list(extra), "RIMNO string, SNAP_MONTH date")


def test_masks_of_many_months(spark):
    seen = plain_presence(1, MANY)
    masks = mm.presence_masks(rows_of(spark, seen, MANY, [(None, MANY[3]), ("c1", None)]), MANY, "RIMNO")
    out = masks.select("RIMNO", mm.ranks_of(F.col("MASK"), len(MANY)).alias("r"), mm.last_rank(F.col("MASK")).alias("l"),
                       mm.last_rank(mm.below(F.col("MASK"), 63)).alias("b"), mm.empty(F.col("MASK")).alias("e"),
                       mm.has(F.col("MASK"), 0).alias("h0"), mm.has(F.col("MASK"), 500).alias("h500")).collect()
    assert {r["RIMNO"]: r["r"] for r in out} == seen
    for r in out:
        ranks = seen[r["RIMNO"]]
        assert r["l"] == ranks[-1] and r["b"] == max((x for x in ranks if x < 63), default=None)
        assert not r["e"] and not r["h0"] and not r["h500"]


def test_audits_against_sets(spark):
    seen = plain_presence(2, MANY[:70])
    months = MANY[:70]
    prime = rows_of(spark, seen, months, [(None, months[0]), (None, months[1])])
    at = {r: {i for i, x in seen.items() if r in x} for r in range(1, 71)}
    got = {(r["TO_MONTH"]): (r["N_PREV"], r["N_CURR"], r["N_NEW"], r["N_MISSING"]) for r in audit.month_new_missing(prime, months=months).collect()}
    assert got == {label_of(months[r - 1]): (len(at[r - 1]), len(at[r]), len(at[r] - at[r - 1]), len(at[r - 1] - at[r])) for r in range(2, 71)}
    want = Counter((label_of(months[r - 1]), label_of(months[s - 1])) for r in range(2, 71) for i in at[r - 1] - at[r]
                   for s in seen[i] if s not in (r, r - 1))
    again = audit.missing_reappearance(prime, months=months).collect()
    assert {(r["TO_MONTH"], r["IN_MONTH"]): r["N_IDS"] for r in again} == dict(want)
    ids = Counter((r["TO_MONTH"], r["IN_MONTH"]) for r in audit.reappearing_ids(prime, months=months).collect())
    assert ids == want
    per = audit.presence_matrix(prime, months=months).collect()
    assert Counter({(r["FIRST_MONTH"], r["LAST_MONTH"], r["MONTHS_PRESENT"], r["GAPS"]): r["N_IDS"] for r in per}) == Counter(
        (label_of(months[x[0] - 1]), label_of(months[x[-1] - 1]), len(x), x[-1] - x[0] + 1 - len(x)) for x in seen.values())


def test_no_ids_at_all(spark):
    prime = rows_of(spark, {}, MANY[:3], [(None, MANY[0]), (None, MANY[1])])
    out = audit.month_new_missing(prime, months=MANY[:3]).collect()
    assert [(r["N_PREV"], r["N_CURR"], r["N_NEW"], r["N_MISSING"]) for r in out] == [(0, 0, 0, 0)] * 2
    assert audit.missing_reappearance(prime, months=MANY[:3]).count() == 0


def test_set_report(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,), ("x",)], "RIMNO string")
    b = spark.createDataFrame([("y",), ("z",)], "RIMNO string")
    c = spark.createDataFrame([("y",), (None,)], "RIMNO string")
    got = {r["TABLES"]: r["N_IDS"] for r in audit.set_report({"a": a, "b": b, "c": c}).collect()}
    assert got == {"a": 1, "a+b+c": 1, "b": 1}
    assert [r["RIMNO"] for r in audit.common_ids(a, b).collect()] == ["y"]




def snapshots(spark, seed, months):
    from cardpulse.functions import contract
    rng = random.Random(seed)
    flags = [contract.ACTIVE_VALUE, *list(contract.INACTIVE_VALUES)[:2], None, "other"]
    codes = [*list(contract.CHURN_STATUSES)[:3], "other", None]
    rows = []
    for n in range(220):
        i = None if rng.random() < 0.05 else f"c{rng.randint(0, 40)}"
        rows.append((n, i, rng.choice(months), rng.choice(flags), rng.choice(codes), rng.choice("pq")))
    rows += [(1000 + k, "anchor", m, flags[0], "other", "p") for k, m in enumerate(months)]
    return spark.createDataFrame(rows, "ROW_ID long, RIMNO string, SNAP_MONTH date, ACTIVATED string, STATUS string, CARD_STATUS string")


def merged(spark, prime, order, tmp, **options):
    path, out = None, None
    for k, m in enumerate(order):
        part = prime.where(F.col("SNAP_MONTH") == F.lit(m))
        out = state.advance(spark, part, path, f"{tmp}/s{k}", **options)
        path = f"{tmp}/s{k}"
    return out


def labels(df, churn_col):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.asDict().items())) for r in df.collect())


def test_any_month_order_gives_the_full_run(spark, tmp_dir):
    months = [dt.date(2025, 11, 1), dt.date(2025, 12, 1), dt.date(2026, 2, 1)]   # a calendar gap, across a year
    prime = snapshots(spark, 5, months).cache()
    latest = prime.where(F.col("SNAP_MONTH") == F.lit(months[-1]))
    want_a, want_s = labels(churn.activation_lifecycle(prime), "A"), labels(churn.status_lifecycle(prime), "S")
    for k, order in enumerate(itertools.permutations(months)):
        s = merged(spark, prime, order, f"{tmp_dir}/{k}")
        assert state.state_months(s) == months
        assert labels(state.activation_lifecycle(latest, s), "A") == want_a
        assert labels(state.status_lifecycle(latest, s), "S") == want_s
    for window in (1, 2):
        full = churn.churn_lookback(prime, window, "RIMNO")
        assert labels(state.churn_lookback(s, window, "RIMNO"), "") == labels(full, "")
    base = prime.where(F.col("SNAP_MONTH") == F.lit(months[0]))
    assert labels(state.churn_between(base, s, months[-1]), "") == labels(churn.churn_between(prime, months[0], months[-1]), "")


def test_merging_twice_or_in_parts_changes_nothing(spark):
    months = [dt.date(2024, 12, 1), dt.date(2025, 1, 1), dt.date(2025, 2, 1), dt.date(2030, 3, 1)]   # two eras
    prime = snapshots(spark, 9, months).cache()
    parts = [state.month_state(prime.where(F.col("ROW_ID") % 3 == k)) for k in range(3)]
    once, twice = state.merge(*parts), state.merge(*parts, parts[1], state.month_state(prime))
    key = lambda df: Counter(tuple(r) for r in df.collect())
    assert key(once) == key(twice) == key(state.month_state(prime))
    latest = prime.where(F.col("SNAP_MONTH") == F.lit(months[-1]))
    assert labels(state.status_lifecycle(latest, once), "") == labels(churn.status_lifecycle(prime), "")


@pytest.mark.parametrize("lacking", ["ACTIVATED", "STATUS"])
def test_months_that_lack_a_column(spark, lacking):
    months = [dt.date(2025, k, 1) for k in (1, 2, 3, 4)]
    absent = {months[1]: {lacking}, months[2]: {lacking}}
    prime = snapshots(spark, 11, months)
    prime = prime.withColumn(lacking, F.when(~F.col("SNAP_MONTH").isin(list(absent)), F.col(lacking))).cache()
    s = state.merge(*[state.month_state(prime.where(F.col("SNAP_MONTH") == F.lit(m)), absent=absent) for m in months])
    latest = prime.where(F.col("SNAP_MONTH") == F.lit(months[-1]))
    assert labels(state.activation_lifecycle(latest, s), "") == labels(churn.activation_lifecycle(prime, absent=absent), "")
    assert labels(state.status_lifecycle(latest, s), "") == labels(churn.status_lifecycle(prime, absent=absent), "")


def test_the_audit_needs_no_join_and_one_shuffle_of_ids(spark):
    seen = plain_presence(3, MANY[:5])
    plan = mm.patterns(mm.presence_masks(rows_of(spark, seen, MANY[:5]), MANY[:5], "RIMNO"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "bit_or" in plan
