
import datetime as dt
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from cardpulse.functions import norm
from cardpulse.functions.months import month_from_path
from cardpulse.functions import stats
from cardpulse.functions.stats import exact_quantiles
from cardpulse.operators import audit, churn, compare, features, identity
from cardpulse.functions import contract

M = [dt.date(2025, 7, 1), dt.date(2025, 8, 1), dt.date(2025, 9, 1)]
SCHEMA = "SNAP_MONTH date, ROW_ID long, RIMNO string, PRODUCT_NAME string, ACTIVATED string, STATUS string"


def test_norm_functions(spark):
    df = spark.createDataFrame([("  12,345\t",), ("007",), ("12.0",), ("  ",), (None,), ("AB1",)], "x string")
    got = [r[0] for r in df.select(norm.norm_id("x")).collect()]
    assert got == ["12345", "7", "12", None, None, "AB1"]
    nums = spark.createDataFrame([("1,234.5",), ("1.0d",), ("1e5",), (" 12 ",), ("x",), ("12.5",)], "x string")
    d = [r[0] for r in nums.select(norm.try_double("x")).collect()]
    assert d == [1234.5, None, 100000.0, 12.0, None, 12.5]
    i = [r[0] for r in nums.select(norm.try_long("x")).collect()]
    assert i == [None, None, 100000, 12, None, None]


def test_excel_serial(spark):
    df = spark.createDataFrame([("45000",), ("1.5",), ("-3",), ("x",), ("200000",)], "s string")
    got = [r[0] for r in df.select(norm.excel_serial_to_timestamp("s")).collect()]
    assert got[0] == dt.datetime(2023, 3, 15)
    assert got[1] == dt.datetime(1899, 12, 31, 12, 0)
    assert got[2:] == [None, None, None]


def test_month_from_file_name(spark):
    df = spark.createDataFrame([("a/prime_JUL_2025.csv",), ("FEB2026.csv",), ("2025_aug.csv",), ("x.csv",)], "p string")
    got = [r[0] for r in df.select(month_from_path("p")).collect()]
    assert got == [dt.date(2025, 7, 1), dt.date(2026, 2, 1), dt.date(2025, 8, 1), dt.date(1900, 1, 1)]


def test_activation_edge_cases(spark):
    rows = [
        (M[0], 1, "1", "C", "A", "NORM"), (M[1], 2, "1", "C", "I", "NORM"), (M[2], 3, "1", "C", "D", "NORM"),  # deact
        (M[1], 4, "2", "C", "A", "NORM"), (M[2], 5, "2", "C", "I", "NORM"),                                   # recent
        (M[0], 6, "3", "C", "I", "NORM"), (M[2], 7, "3", "C", "D", "NORM"),                                   # always
        (M[0], 8, "4", "C", "A", "NORM"),                                                                     # gone
        (M[2], 9, "5", "C", "I", "NORM"),                                                                     # new
        (M[1], 10, "6", "C", "I", "NORM"), (M[2], 11, "6", "C", None, "NORM"),                                # null flag
        (M[2], 12, None, "C", "I", "NORM"),                                                                   # no id
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {(r["RIMNO"], r["ROW_ID"]): (r["ACTIVATION_CHURN_TYPE"], r["ACTIVATION_CHURN"])
           for r in churn.activation_lifecycle(df).collect()}
    assert out[("1", 3)] == ("deactivated_recent", 1)
    assert out[("2", 5)] == ("recently_active", 0)
    assert out[("3", 7)] == ("always_inactive", 1)
    assert out[("4", None)] == ("disappeared", 1)
    assert out[("5", 9)] == ("new_customer", 0)
    assert out[("6", 11)] == ("still_active", 0)
    assert out[(None, 12)] == ("still_active", 0)


def _brute_activation(rows):
    """Set-based restatement on plain Python data."""
    months = sorted({r[0] for r in rows})
    latest, prev = months[-1], months[-2]
    ids = lambda pred: {r[2] for r in rows if r[2] is not None and pred(r)}
    hist, lat = ids(lambda r: r[0] < latest), ids(lambda r: r[0] == latest)
    ever_a = ids(lambda r: r[0] < latest and r[4] == "A")
    def all_inactive(month, pool):
        out = set()
        for i in pool:
            vals = [r[4] for r in rows if r[2] == i and r[0] == month]
            if vals and all(v in ("I", "D") for v in vals):
                out.add(i)
        return out
    inl = all_inactive(latest, hist & lat)
    inp = all_inactive(prev, ids(lambda r: True))
    res = {}
    for i in hist | lat:
        if i in hist and i not in lat:
            res[i] = "disappeared"
        elif i not in hist:
            res[i] = "new_customer"
        elif i in inl and i not in ever_a:
            res[i] = "always_inactive"
        elif i in inl and i in inp:
            res[i] = "deactivated_recent"
        elif i in inl:
            res[i] = "recently_active"
        else:
            res[i] = "still_active"
    return res


def test_activation_property(spark):
    rnd = random.Random(7)
    for _ in range(3):
        rows = []
        for n in range(300):
            rows.append((rnd.choice(M), n, rnd.choice([None, "1", "2", "3", "4", "5", "6", "7", "8"]), "C",
                         rnd.choice(["A", "I", "D", None]), "NORM"))
        got = {r["RIMNO"]: r["ACTIVATION_CHURN_TYPE"] for r in churn.activation_flags(
            spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == _brute_activation(rows)


def test_dense_ids_distributed(spark):
    keys = spark.createDataFrame([(str(i % 37) if i % 11 else None, i % 5) for i in range(500)], "k string, d int") \
        .distinct()
    out = identity.dense_ids(keys, [F.col("k").asc_nulls_first(), F.col("d").asc_nulls_first()], "ID", 6).collect()
    expect = sorted({(r["k"], r["d"]) for r in out}, key=lambda t: (t[0] is not None, t[0] or "", t[1]))
    got = {(r["k"], r["d"]): r["ID"] for r in out}
    assert [got[k] for k in expect] == list(range(1, len(expect) + 1))


def test_change_counts_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for n in range(120):
        rows.append((rnd.choice(M), n, rnd.choice(["1", "2", None]), rnd.choice(["A", "B"]),
                     rnd.choice(["A", "I", None]), rnd.choice(["X", "Y"])))
    df = spark.createDataFrame(rows, SCHEMA)
    rates = {(r["FROM_MONTH"], r["COLUMN"]): r["CHANGED_ROWS"]
             for r in audit.change_rates(df, ["ACTIVATED", "STATUS"]).collect()}
    log = audit.change_log(df, ["ACTIVATED", "STATUS"], pairing="all")
    log_counts = {(r["FROM_MONTH"], r["COLUMN"]): r["count"] for r in log.groupBy("FROM_MONTH", "COLUMN").count().collect()}
    brute = {}
    for a, b in itertools.product(rows, rows):
        if b[0] != {M[0]: M[1], M[1]: M[2]}.get(a[0]) or a[2] is None or a[2] != b[2] or a[3] != b[3]:
            continue
        for col, i in (("ACTIVATED", 4), ("STATUS", 5)):
            if a[i] != b[i]:
                key = (a[0].strftime("%Y-%b").upper(), col)
                brute[key] = brute.get(key, 0) + 1
    assert rates == brute
    assert log_counts == brute


def test_bands_right_closed(spark):
    df = spark.createDataFrame([(18,), (19,), (25,), (26,), (65,), (66,), (101,), (None,)], "a int")
    got = [r[0] for r in df.select(features.band(F.col("a"), contract.AGE_BANDS)).collect()]
    assert got == [None, "18-25", "18-25", "26-35", "51-65", "65+", None, None]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 2.5), [None] * 10])
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in vals], "x double")
    clean = np.array([v for v in vals if v is not None], dtype=float)
    probs = [0, 0.1, 0.25, 0.5, 0.9, 0.99, 1]
    got = exact_quantiles(df, "x", probs)
    assert np.allclose(got, np.quantile(clean, probs), rtol=0, atol=1e-12)


def test_exact_quantiles_with_ties_nulls_and_a_missed_bracket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=60_000), np.full(30_000, 0.25), rng.integers(0, 5, 20_000).astype(float)])
    rng.shuffle(x)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 100 + [(float("nan"),)] * 5, "x double")
    probs = [0, 0.01, 0.25, 0.5, 0.75, 0.99, 0.9999, 1]
    assert np.allclose(stats.exact_quantiles(df, "x", probs), np.quantile(x, probs), rtol=0, atol=1e-12)
    # a sketch so rough that brackets miss must widen, not fail
    monkeypatch.setattr(stats, "ACCURACY", 3)
    monkeypatch.setattr(stats, "MARGIN", 0)
    assert np.allclose(stats.exact_quantiles(df, "x", probs), np.quantile(x, probs), rtol=0, atol=1e-12)
    empty = stats.exact_quantiles(df.where("x is null"), "x", [0.5])
    assert empty == [None]


def test_grouped_quantiles_of_many_groups(spark):
    rng = np.random.default_rng(4)
    group, x = rng.integers(0, 1000, 60_000), np.round(rng.normal(size=60_000), 2)
    group[:30_000] = 7  # one group holds half of the rows
    rows = [(int(g) if g else None, float(v)) for g, v in zip(group, x)] + [(5, None), (2000, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r["g"]: (r["a"], r["b"]) for r in stats.grouped_exact_quantiles(df, "g", "x", {"a": 0.25, "b": 0.99}).collect()}
    want = {int(g) if g else None: tuple(np.quantile(x[group == g], [0.25, 0.99])) for g in np.unique(group)}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[g], want[g], rtol=0, atol=1e-12) for g in want)


def test_rows_without_id_do_not_multiply(spark):
    rows = [(M[0], i, None, "A", "A", "X") for i in range(300)] + [(M[1], 1000 + i, None, "A", "I", "X") for i in range(200)] + \
        [(M[0], 1, "1", "A", "A", "X"), (M[1], 2, "1", "A", "I", "X")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert audit.change_log(df, ["ACTIVATED", "STATUS"]).count() == 1
    report = audit.idless_report(df).collect()
    assert [(r["N_OLD"], r["N_NEW"], r["N_PAIRS"]) for r in report] == [(300, 200, 60_000)]
    lookup = spark.createDataFrame([(None, "A", k) for k in range(50)] + [("1", "A", 99)], "RIMNO string, PRODUCT_NAME string, CUSTOMER_ID long")
    mapped = identity.map_transactions(df.select("RIMNO", "PRODUCT_NAME", "ROW_ID"), lookup)
    assert mapped.count() == len(rows) and mapped.where("CUSTOMER_ID is not null").count() == 2


def test_change_log_counted_and_absent_columns(spark):
    rows = [(M[0], i, "1", "A", "A" if i % 2 else "I", "X") for i in range(20)] + [(M[1], 50 + i, "1", "A", "D", "Y") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["COLUMN"], r["OLD_VALUE"], r["NEW_VALUE"]): r["N_PAIRS"] for r in audit.change_log_counted(df, ["ACTIVATED", "STATUS"]).collect()}
    assert got == {("ACTIVATED", "A", "D"): 50, ("ACTIVATED", "I", "D"): 50, ("STATUS", "X", "Y"): 100}
    absent = {M[1]: {"STATUS"}}
    assert {r["COLUMN"] for r in audit.change_log(df, ["ACTIVATED", "STATUS"], absent=absent).collect()} == {"ACTIVATED"}
    assert {r["COLUMN"] for r in audit.change_rates(df, ["ACTIVATED", "STATUS"], absent=absent).collect()} == {"ACTIVATED"}
    assert {r["COLUMN"] for r in audit.change_log_counted(df, ["ACTIVATED", "STATUS"], absent=absent).collect()} == {"ACTIVATED"}


def test_text_image_of_large_and_close_values(spark):
    df = spark.createDataFrame([(1e40, 1.0000001)], "a double, b double")
    assert audit.text_image(df, ["a", "b"]).first()[0] == "1.0E40"


def test_compare_labels(spark):
    s = spark.createDataFrame([("1", 1, "always_churned"), ("2", 0, "not_churned"), ("3", 1, "disappeared"),
                               (None, 0, "not_churned")], "RIMNO string, CHURN int, CHURN_TYPE string")
    a = spark.createDataFrame([("1", 1, "always_inactive"), ("2", 1, "deactivated_recent"), ("4", 0, "new_customer"),
                               (None, 0, "still_active")],
                              "RIMNO string, ACTIVATION_CHURN int, ACTIVATION_CHURN_TYPE string")
    out = {r["RIMNO"]: (r["MERGE"], r["AGREE"], r["DISAGREE_TYPE"]) for r in compare.compare_labels(s, a).collect()}
    assert out == {"1": ("both", True, "both_churn"), "2": ("both", False, "ACTIVATION_churn_only"),
                   "3": ("left_only", False, "only_in_status_file"), "4": ("right_only", False, "only_in_activation_file"),
                   None: ("both", True, "both_not_churn")}


def test_change_log_last_pairing(spark):
    rows = [(M[0], 1, "1", "A", "A", "X"), (M[0], 2, "1", "A", "I", "X"), (M[1], 3, "1", "A", "D", "Y"),
            (M[1], 4, "1", "A", "I", "X")]
    df = spark.createDataFrame(rows, SCHEMA)
    full = audit.change_log(df, ["ACTIVATED", "STATUS"], pairing="all")
    assert full.count() == 5  # 2x2 pairs: A->D X->Y, A->I, I->D X->Y, no change
    last = {(r["COLUMN"], r["OLD_VALUE"], r["NEW_VALUE"]) for r in
            audit.change_log(df, ["ACTIVATED", "STATUS"], pairing="last").collect()}
    assert last == set()  # last rows (2: I,X) and (4: I,X) agree


def test_latest_lookup_and_wide_crosstab(spark):
    seg = spark.createDataFrame([(M[0], "1", "C", 5, "active"), (M[1], "1", "C", 7, "active"),
                                 (M[1], "1", "C", 6, "active"), (M[1], "2", "C", 9, "historical")],
                                "SNAP_MONTH date, RIMNO string, PRODUCT_NAME string, CUSTOMER_ID long, SEGMENT string")
    got = {(r["RIMNO"], r["PRODUCT_NAME"]): r["CUSTOMER_ID"] for r in identity.latest_lookup(seg).collect()}
    assert got == {("1", "C"): 6}
    s = spark.createDataFrame([("1", 1, "always_churned"), ("2", 0, "not_churned")],
                              "RIMNO string, CHURN int, CHURN_TYPE string")
    a = spark.createDataFrame([("1", 1, "always_inactive"), ("3", 0, "new_customer")],
                              "RIMNO string, ACTIVATION_CHURN int, ACTIVATION_CHURN_TYPE string")
    wide = {r["CHURN_TYPE"]: r.asDict() for r in compare.label_crosstab_wide(compare.compare_labels(s, a)).collect()}
    assert wide["All"]["All"] == 3 and wide["always_churned"]["always_inactive"] == 1
    assert wide["(missing)"]["new_customer"] == 1 and wide["not_churned"]["(missing)"] == 1


def test_ids_that_are_no_number_are_no_customer(spark):
    rows = [(M[0], 1, "A17", "C", "A", "X"), (M[0], 2, "17", "C", "A", "X"), (M[0], 3, None, "C", "A", "X")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("DOB", F.lit(None).cast("date"))
    got = {r["ROW_ID"]: (r["RIMNO"], r["CUSTOMER_ID"]) for r in identity.assign_customer_ids(df).collect()}
    assert got[2][0] == "17" and got[1][0] is None and got[1][1] == got[3][1] != got[2][1]


def test_change_audits_of_hot_and_other_ids_agree(spark, monkeypatch):
    """Ids of few rows are paired where they meet, others by value counts or a plain join: equal rows either way, and together."""
    rows = [(m, i, p, ("A", "B", None)[(n + m.month) % 3], n % 2 * 0.5) for m in (dt.date(2025, 1, 1), dt.date(2025, 2, 1), dt.date(2025, 3, 1))
            for i, k in (("1", 5), ("2", 2), ("3", 1), (None, 2)) for p in ("X", None) for n in range(k)]
    df = spark.createDataFrame(rows, "SNAP_MONTH date, RIMNO string, PRODUCT_NAME string, S string, D double").withColumn("ROW_ID", F.monotonically_increasing_id())
    absent = {dt.date(2025, 3, 1): {"D"}}
    results = []
    for most in (0, 7, 100):                     # all hot, one id hot, none
        monkeypatch.setattr(audit, "HOT_ROWS", most)
        results.append([sorted(map(str, f(df, ["S", "D"], absent=absent).collect())) for f in (
            audit.change_rates, audit.change_summary, audit.change_log_counted, lambda *a, **k: audit.change_log(*a, pairing="all", **k))])
    assert results[0] == results[1] == results[2] and all(results[0])


def test_change_counts_move_rows_once(spark):
    """Rows of few-row ids are not exploded by column before they move: one exchange by the id, read by both sides."""
    rows = [(dt.date(2025, m, 1), str(i), "X", "A") for m in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "SNAP_MONTH date, RIMNO string, PRODUCT_NAME string, S string")
    plan = audit.change_counts(df, ["S"])._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("SortMergeJoin"):]
    assert "Generate" not in below and "REPARTITION_BY_NUM" in below
