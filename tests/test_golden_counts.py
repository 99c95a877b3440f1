"""Golden counts of the fixture views (FIXTURES.md) at sf0.001."""

from collections import Counter

from pyspark.sql import functions as F

from cardpulse.functions.months import snapshot_months
from cardpulse.operators import audit, churn, identity
from cardpulse.sources import fixtures as fx

from conftest import SF001


def _counts(df, col):
    return Counter({r[0]: r[1] for r in df.groupBy(col).count().collect()})


def test_rows_per_snapshot(spark):
    p = fx.prime(spark, SF001)
    per = [r[1] for r in p.groupBy("SNAP_MONTH").count().orderBy("SNAP_MONTH").collect()]
    assert per == [231, 229, 219, 246, 236, 217, 122]
    assert fx.txn(spark, SF001).count() == 6000


def test_identity_segments(spark):
    p = fx.prime(spark, SF001)
    keys = identity.customer_keys(p)
    assert keys.count() == 260
    ids = [r[0] for r in keys.select("CUSTOMER_ID").collect()]
    assert sorted(ids) == list(range(1, 261))
    seg = identity.segment(identity.assign_customer_ids(p, keys))
    assert _counts(seg, "SEGMENT") == Counter(active=868, historical=615, relative=17)
    lookup = identity.customer_lookup(seg)
    assert lookup.count() == 440
    assert lookup.select("RIMNO", "PRODUCT_NAME").distinct().count() == 389
    mapped = identity.map_transactions(fx.txn(spark, SF001), lookup)
    assert mapped.count() == 6694  # rows without an id match no customer
    assert mapped.where(F.col("CUSTOMER_ID").isNotNull()).count() == 5751


def test_lookback_churn(spark):
    p = fx.prime(spark, SF001)
    seg = identity.segment(identity.assign_customer_ids(p))
    active = seg.where("SEGMENT = 'active'")
    assert _counts(churn.churn_lookback(active, 1), "CHURN") == Counter({0: 60, 1: 144})
    assert _counts(churn.churn_lookback(active, 2), "CHURN") == Counter({0: 113, 1: 78})


def test_first_last_churn(spark):
    p = fx.prime(spark, SF001)
    m = snapshot_months(p)
    assert _counts(churn.churn_between(p, m[0], m[-1]), "churn") == Counter({0: 65, 1: 51})


def test_lifecycle_classes(spark):
    p = fx.prime(spark, SF001)
    act = _counts(churn.activation_flags(p), "ACTIVATION_CHURN_TYPE")
    assert act == Counter(always_inactive=1, deactivated_recent=20, disappeared=65, recently_active=25,
                          still_active=39)
    st = _counts(churn.status_flags(p), "CHURN_TYPE")
    assert st == Counter(always_churned=1, became_churned_old=13, became_churned_recent=29, disappeared=65,
                         not_churned=42)
    rows = _counts(churn.activation_lifecycle(p), "ACTIVATION_CHURN_TYPE")
    assert rows == Counter(always_inactive=1, deactivated_recent=26, disappeared=65, recently_active=33,
                           still_active=62)


def test_presence_audit(spark):
    p = fx.prime(spark, SF001)
    nm = audit.month_new_missing(p).orderBy("TO_MONTH").collect()
    m = snapshot_months(p)
    first = p.where(F.col("SNAP_MONTH") == m[0]).select("RIMNO").where("RIMNO IS NOT NULL").distinct().count()
    assert first == 116
    rows = {r["TO_MONTH"]: r for r in nm}
    from cardpulse.functions.months import label_of
    assert [rows[label_of(x)]["N_NEW"] for x in m[1:]] == [30, 20, 28, 30, 21, 16]
    assert [rows[label_of(x)]["N_MISSING"] for x in m[1:]] == [26, 23, 27, 27, 22, 51]


def test_common_ids_and_serials(spark):
    assert audit.common_ids(fx.prime(spark, SF001), fx.txn(spark, SF001)).count() == 150
    from cardpulse.functions import norm
    raw = fx.prime_raw(spark, SF001)
    assert raw.where(norm.excel_serial_to_timestamp("DOB_SERIAL").isNotNull()).count() == 1472
