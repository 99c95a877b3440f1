"""Churn and lifecycle labelling over a multi-month snapshot DataFrame.

Plan shape for the lifecycle labels (K8/K9): one scan of the id/flag columns of
all months -> one ``groupBy(id)`` with partial (map-side) aggregation of boolean
flags -> label per id -> left join back to the latest month only (literal month
filter, so the scan of that side is pruned) -> union of stub rows for ids that
disappeared.  Rows without an id never enter the join (they would all hash to
one partition); they are unioned back with the default label.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardpulse.functions import contract
from cardpulse.functions.monthmask import below, has, last_rank, presence_masks
from cardpulse.functions.months import MONTH_COL, label_of, snapshot_months


def _in(c: str, values) -> Column:
    return F.coalesce(F.col(c).isin(list(values)), F.lit(False))


def spread_null_key(c: str) -> Column:
    """Join key equal to ``c``, except that a null becomes a unique text that matches
    nothing: id-less rows then spread over all join partitions instead of piling into
    the single partition of the null key (they keep the default label)."""
    return F.coalesce(F.col(c), F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string")))


def attach_labels(latest: DataFrame, labels: DataFrame, id_col: str, churn_col: str, type_col: str,
                   default_type: str) -> DataFrame:
    """latest rows + (churn, type) by id (one scan of the latest month, one left join);
    id-less rows keep the default label."""
    present = labels.where("IN_LATEST").select(F.col(id_col).alias("_JK"), churn_col, type_col)
    joined = (latest.withColumn("_JK", spread_null_key(id_col)).join(present, "_JK", "left")
              .withColumn(churn_col, F.coalesce(churn_col, F.lit(0)))
              .withColumn(type_col, F.coalesce(type_col, F.lit(default_type))))
    cols = latest.columns + [churn_col, type_col]
    stubs = labels.where("IN_HIST AND NOT IN_LATEST").select(id_col, churn_col, type_col)
    return joined.select(cols).unionByName(stubs, allowMissingColumns=True).select(cols)


def months_with(prime: DataFrame, cols, absent: dict[dt.date, set[str]] | None) -> DataFrame:
    """Rows of the months that carry all ``cols`` (``absent``: month -> columns its file lacks)."""
    cut = [m for m, gone in (absent or {}).items() if set(cols) & set(gone)]
    return prime.where(~F.col(MONTH_COL).isin(cut)) if cut else prime


def activation_flags(prime: DataFrame, months: list[dt.date] | None = None, id_col: str = "RIMNO",
                     flag_col: str = "ACTIVATED", absent: dict[dt.date, set[str]] | None = None) -> DataFrame:
    """One row per id with the ACTIVATED-based class (single partial aggregate).  A history
    month whose file lacks the id or the flag is skipped whole."""
    months = months or snapshot_months(prime, at_least=2)
    prime = months_with(prime, [id_col, flag_col], {m: c for m, c in (absent or {}).items() if m != months[-1]})
    latest, prev = months[-1], months[-2]
    m = F.col(MONTH_COL)
    inactive = _in(flag_col, contract.INACTIVE_VALUES)
    is_a = F.coalesce(F.col(flag_col) == contract.ACTIVE_VALUE, F.lit(False))
    flags = (prime.where(F.col(id_col).isNotNull())
             .groupBy(id_col)
             .agg(F.bool_or(m < F.lit(latest)).alias("IN_HIST"),
                  F.bool_or(m == F.lit(latest)).alias("IN_LATEST"),
                  F.bool_or((m < F.lit(latest)) & is_a).alias("EVER_A"),
                  F.bool_and(F.when(m == F.lit(latest), inactive)).alias("LATEST_ALL_INACTIVE"),
                  F.bool_and(F.when(m == F.lit(prev), inactive)).alias("PREV_ALL_INACTIVE")))
    return activation_classes(flags)


def activation_classes(flags: DataFrame) -> DataFrame:
    """``flags`` (IN_HIST, IN_LATEST, EVER_A, LATEST_ALL_INACTIVE, PREV_ALL_INACTIVE) with class and churn."""
    both = F.col("IN_HIST") & F.col("IN_LATEST")
    now_inactive = both & F.coalesce(F.col("LATEST_ALL_INACTIVE"), F.lit(False))
    prev_inactive = F.coalesce(F.col("PREV_ALL_INACTIVE"), F.lit(False))
    ctype = (F.when(F.col("IN_HIST") & ~F.col("IN_LATEST"), "disappeared")
             .when(~F.col("IN_HIST"), "new_customer")
             .when(now_inactive & ~F.col("EVER_A"), "always_inactive")
             .when(now_inactive & prev_inactive, "deactivated_recent")
             .when(now_inactive, "recently_active")
             .otherwise("still_active"))
    churn = F.when(ctype.isin("disappeared", "always_inactive", "deactivated_recent"), 1).otherwise(0)
    return flags.withColumn("ACTIVATION_CHURN_TYPE", ctype).withColumn("ACTIVATION_CHURN", churn)


def activation_lifecycle(prime: DataFrame, months: list[dt.date] | None = None, id_col: str = "RIMNO",
                         flag_col: str = "ACTIVATED", absent: dict[dt.date, set[str]] | None = None) -> DataFrame:
    """Latest snapshot + ACTIVATION_CHURN / ACTIVATION_CHURN_TYPE, plus stub rows for
    ids present in history but absent from the latest month."""
    months = months or snapshot_months(prime, at_least=2)
    labels = activation_flags(prime, months, id_col, flag_col, absent)
    latest = prime.where(F.col(MONTH_COL) == F.lit(months[-1]))
    return attach_labels(latest, labels, id_col, "ACTIVATION_CHURN", "ACTIVATION_CHURN_TYPE", "still_active")


def status_flags(prime: DataFrame, months: list[dt.date] | None = None, id_col: str = "RIMNO",
                 status_col: str = "STATUS", churn_codes=None, absent: dict[dt.date, set[str]] | None = None) -> DataFrame:
    """One row per id with the STATUS-based class.  A history month whose file lacks the id is
    skipped; one that lacks STATUS counts its ids as history but tells nothing of activity."""
    months = months or snapshot_months(prime, at_least=2)
    earlier = {m: set(c) for m, c in (absent or {}).items() if m != months[-1]}
    prime = months_with(prime, [id_col], earlier)
    mute = [m for m, c in earlier.items() if status_col in c]
    codes = churn_codes or contract.CHURN_STATUSES
    latest = months[-1]
    recent = [m for m in months[-3:-1]]  # last two history months
    m = F.col(MONTH_COL)
    churned = _in(status_col, codes)
    hist = m < F.lit(latest)
    live = ~churned & ~m.isin(mute) if mute else ~churned
    flags = (prime.where(F.col(id_col).isNotNull())
             .groupBy(id_col)
             .agg(F.bool_or(hist).alias("IN_HIST"),
                  F.bool_or(m == F.lit(latest)).alias("IN_LATEST"),
                  F.bool_or(hist & live).alias("EVER_ACTIVE"),
                  F.bool_or(m.isin(recent) & live).alias("RECENT_ACTIVE"),
                  F.bool_and(F.when(m == F.lit(latest), churned)).alias("LATEST_ALL_CHURNED")))
    return status_classes(flags)


def status_classes(flags: DataFrame) -> DataFrame:
    """``flags`` (IN_HIST, IN_LATEST, EVER_ACTIVE, RECENT_ACTIVE, LATEST_ALL_CHURNED) with class and churn."""
    both = F.col("IN_HIST") & F.col("IN_LATEST")
    c_latest = both & F.coalesce(F.col("LATEST_ALL_CHURNED"), F.lit(False))
    ctype = (F.when(F.col("IN_HIST") & ~F.col("IN_LATEST"), "disappeared")
             .when(~F.col("IN_HIST"), "new_customer")
             .when(c_latest & ~F.col("EVER_ACTIVE"), "always_churned")
             .when(c_latest & F.col("RECENT_ACTIVE"), "became_churned_recent")
             .when(c_latest, "became_churned_old")
             .otherwise("not_churned"))
    churn = F.when(ctype.isin("disappeared", "always_churned", "became_churned_recent", "became_churned_old"),
                   1).otherwise(0)
    return flags.withColumn("CHURN_TYPE", ctype).withColumn("CHURN", churn)


def status_lifecycle(prime: DataFrame, months: list[dt.date] | None = None, id_col: str = "RIMNO",
                     status_col: str = "STATUS", churn_codes=None, absent: dict[dt.date, set[str]] | None = None) -> DataFrame:
    """Latest snapshot + CHURN / CHURN_TYPE from STATUS codes, plus disappeared stubs."""
    months = months or snapshot_months(prime, at_least=2)
    labels = status_flags(prime, months, id_col, status_col, churn_codes, absent)
    latest = prime.where(F.col(MONTH_COL) == F.lit(months[-1]))
    return attach_labels(latest, labels, id_col, "CHURN", "CHURN_TYPE", "not_churned")


def class_summary(labelled: DataFrame, type_col: str, churn_col: str, classes) -> DataFrame:
    """Rows per class in fixed order, zero classes included, share of all rows."""
    spark = labelled.sparkSession
    spine = spark.createDataFrame([(i + 1, name, flag) for i, (name, flag) in enumerate(classes)],
                                  f"CLASS_ORDER int, {type_col} string, {churn_col} int")
    counts = labelled.groupBy(type_col).agg(F.count(F.lit(1)).alias("N_ROWS"))
    joined = F.broadcast(spine).join(counts, type_col, "full")  # spine: fixed class list
    total = F.sum("N_ROWS").over(Window.partitionBy())  # over the handful of class rows
    return (joined.where(F.col("CLASS_ORDER").isNotNull())
            .withColumn("TOTAL", total).withColumn("N_ROWS", F.coalesce("N_ROWS", F.lit(0)))
            .select("CLASS_ORDER", type_col, churn_col, F.col("N_ROWS").cast("bigint").alias("N_ROWS"),
                    F.round(F.try_divide(F.col("N_ROWS") * 100.0, F.col("TOTAL")), 4).alias("PCT_ROWS")))


def label_totals(labelled: DataFrame, churn_col: str) -> DataFrame:
    """TOTAL rows, rows with churn 1 and rows with churn 0."""
    return labelled.agg(F.count(F.lit(1)).alias("TOTAL"), F.count_if(F.col(churn_col) == 1).alias("CHURN_1"),
                        F.count_if(F.col(churn_col) == 0).alias("CHURN_0"))


def lookback_labels(masks: DataFrame, months: list[dt.date], window: int = 1, id_col: str = "CUSTOMER_ID") -> DataFrame:
    """Look-back churn (id, LAST_SEEN, CHURN) from masks of months (id, MASK)."""
    if window not in (1, 2):
        raise ValueError("window must be 1 or 2")
    n, mask = len(months), F.col("MASK")
    in_last, in_second = has(mask, n), has(mask, n - 1)
    per_id = masks.withColumn("_EARLIER", last_rank(below(mask, n - window + 1))).where("_EARLIER IS NOT NULL")
    last_l, second_l = label_of(months[-1]), label_of(months[-2])
    if window == 1:
        kept, seen = in_last, F.lit(last_l)
    else:
        kept = in_last | in_second
        seen = F.when(in_last & in_second, f"{second_l} & {last_l}").when(in_last, last_l).otherwise(second_l)
    labels = F.array(*[F.lit(label_of(m)) for m in months])
    return per_id.select(id_col, F.when(kept, seen).otherwise(F.get(labels, F.col("_EARLIER") - 1)).alias("LAST_SEEN"),
                         F.when(kept, 0).otherwise(1).alias("CHURN"))


def churn_lookback(active: DataFrame, window: int = 1, id_col: str = "CUSTOMER_ID",
                   months: list[dt.date] | None = None) -> DataFrame:
    """Look-back churn: ids seen before the last ``window`` snapshots are churned (1)
    when absent from all of them.  LAST_SEEN is the label of the last earlier month
    for churned ids and the buffer month(s) where the id appears otherwise.
    One mask of months per id; ids first seen inside the buffer are excluded."""
    months = months or snapshot_months(active, at_least=window + 1)
    return lookback_labels(presence_masks(active, months, id_col), months, window, id_col)


def churn_between(prime: DataFrame, base_month: dt.date, ref_month: dt.date, id_col: str = "RIMNO",
                  status_col: str = "CARD_STATUS", order_col: str = "ROW_ID") -> DataFrame:
    """Base-month customers (last row per id by ``order_col``) labelled churn=1 when the
    id is absent from the reference month."""
    m = F.col(MONTH_COL)
    base = (prime.where((m == F.lit(base_month)) & F.col(id_col).isNotNull())
            .groupBy(id_col)
            .agg(F.max_by(F.col(status_col), F.col(order_col)).alias(status_col)))
    ref_ids = prime.where((m == F.lit(ref_month)) & F.col(id_col).isNotNull()).select(id_col).distinct()
    ref_ids = ref_ids.withColumn("_IN_REF", F.lit(True))
    return (base.join(ref_ids, id_col, "left")
            .select(id_col, status_col, F.when(F.col("_IN_REF"), 0).otherwise(1).alias("churn")))


def churn_rate(labelled: DataFrame, churn_col: str = "churn") -> DataFrame:
    """Total / churned / retained / rate (percent)."""
    return labelled.agg(F.count(F.lit(1)).alias("TOTAL"),
                        F.coalesce(F.sum(churn_col), F.lit(0)).cast("bigint").alias("CHURNED")) \
        .select("TOTAL", "CHURNED", (F.col("TOTAL") - F.col("CHURNED")).alias("RETAINED"),
                F.round(F.try_divide(F.col("CHURNED") * 100.0, F.col("TOTAL")), 4).alias("CHURN_RATE_PCT"))
