"""Query catalogue: every operator bound to the fixture inputs of a scale-factor folder.

Each entry is ``(spark, sf_dir) -> DataFrame``.  The inputs are whole driver
tables; nothing is sub-sampled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.functions import contract
from cardpulse.functions.months import MONTH_COL, snapshot_months
from cardpulse.functions import norm
from cardpulse.functions.stats import exact_quantiles_multi
from cardpulse.operators import audit, churn, compare, features, identity, profile, quality, segment, state
from cardpulse.session import checkpoint_dir, scratch_path
from cardpulse.sources import fixtures as fx
from cardpulse.sources import files, storage

Query = Callable[[SparkSession, str], DataFrame]

# Columns compared month over month by the change audit: every snapshot column
# except the card key, the month itself and the row-order stand-in.
CHANGE_COLUMNS = [c for c in fx.PRIME_COLUMNS if c not in ("SNAP_MONTH", "ROW_ID", "RIMNO", "PRODUCT_NAME")]


# ----------------------------------------------------------------- lifecycle
def q_activation_lifecycle(spark, sf_dir):
    return churn.activation_lifecycle(fx.prime(spark, sf_dir))


def q_status_lifecycle(spark, sf_dir):
    return churn.status_lifecycle(fx.prime(spark, sf_dir))


def q_activation_summary(spark, sf_dir):
    return churn.class_summary(q_activation_lifecycle(spark, sf_dir), "ACTIVATION_CHURN_TYPE", "ACTIVATION_CHURN",
                               contract.ACTIVATION_CLASSES)


def q_status_summary(spark, sf_dir):
    return churn.class_summary(q_status_lifecycle(spark, sf_dir), "CHURN_TYPE", "CHURN", contract.STATUS_CLASSES)


# ----------------------------------------------------------------- identity
def _kept(df):
    """``df`` written once to the shared checkpoint folder, for what is read several times."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _segmented(spark, sf_dir):
    prime = fx.prime(spark, sf_dir)
    keys = identity.customer_keys(prime)
    return identity.segment(identity.assign_customer_ids(prime, keys)), keys


def q_customer_ids(spark, sf_dir):
    return identity.customer_keys(fx.prime(spark, sf_dir)).select("RIMNO", "DOB", "CUSTOMER_ID")


def q_active_historical(spark, sf_dir):
    prime = fx.prime(spark, sf_dir)
    with_ids = identity.assign_customer_ids(prime)
    return with_ids.select("ROW_ID", MONTH_COL, "RIMNO", "PRODUCT_NAME", "CUSTOMER_ID",
                           F.when(identity.is_historical(), "historical").otherwise("active").alias("SEGMENT"))


def q_relatives(spark, sf_dir):
    seg, _ = _segmented(spark, sf_dir)
    return seg.where(F.col("SEGMENT") == "relative").select("ROW_ID", MONTH_COL, "RIMNO", "PRODUCT_NAME", "DOB",
                                                            "CUSTOMER_ID")


def _mapped(spark, sf_dir):
    seg = _kept(_segmented(spark, sf_dir)[0].select("RIMNO", "PRODUCT_NAME", MONTH_COL, "CUSTOMER_ID", "SEGMENT"))
    return identity.map_transactions(fx.txn(spark, sf_dir), identity.customer_lookup(seg)), seg


def q_ambiguous_keys(spark, sf_dir):
    """The fan-out report: card keys that several customers hold."""
    return identity.ambiguous_keys(identity.customer_lookup(_segmented(spark, sf_dir)[0]))


def q_txn_mapped_latest(spark, sf_dir):
    """Transactions mapped without fan-out, to the customer of the latest month."""
    return identity.map_transactions(fx.txn(spark, sf_dir), identity.latest_lookup(_segmented(spark, sf_dir)[0])) \
        .where(F.col("CUSTOMER_ID").isNotNull()).select("TXN_ID", "RIMNO", "PRODUCT_NAME", "CUSTOMER_ID")


def q_txn_mapped(spark, sf_dir):
    mapped, _ = _mapped(spark, sf_dir)
    return mapped.where(F.col("CUSTOMER_ID").isNotNull())


def _identified(spark, sf_dir):
    cols = ["ROW_ID", MONTH_COL, "RIMNO", "PRODUCT_NAME", "DOB", "STATUS", "CARD_STATUS"]
    return storage.identify(fx.prime(spark, sf_dir).select(cols), fx.txn(spark, sf_dir))


def q_relatives_located(spark, sf_dir):
    """Relatives by the chain of joins over tables stored by id."""
    return _identified(spark, sf_dir).segmented.where("SEGMENT = 'relative'").select(
        "ROW_ID", MONTH_COL, "RIMNO", "PRODUCT_NAME", "DOB", "CUSTOMER_ID")


def q_txn_mapped_located(spark, sf_dir):
    return _identified(spark, sf_dir).mapped.where(F.col("CUSTOMER_ID").isNotNull())


def q_txn_missing(spark, sf_dir):
    mapped, _ = _mapped(spark, sf_dir)
    return mapped.where(F.col("CUSTOMER_ID").isNull())


def q_mapping_coverage(spark, sf_dir):
    mapped, seg = _mapped(spark, sf_dir)
    return identity.mapping_coverage({"prime": seg, "txn": mapped})


# ----------------------------------------------------------------- look-back churn
def _active(spark, sf_dir):
    seg, _ = _segmented(spark, sf_dir)
    return seg.where(F.col("SEGMENT") == "active")


def q_churn_1month(spark, sf_dir):
    return churn.churn_lookback(_active(spark, sf_dir), window=1, months=snapshot_months(fx.prime_raw(spark, sf_dir), at_least=2))


def q_churn_2month(spark, sf_dir):
    return churn.churn_lookback(_active(spark, sf_dir), window=2, months=snapshot_months(fx.prime_raw(spark, sf_dir), at_least=3))


def q_churn_first_last(spark, sf_dir):
    prime = fx.prime(spark, sf_dir)
    months = snapshot_months(prime, at_least=2)
    return churn.churn_between(prime, months[0], months[-1])


def q_churn_rate(spark, sf_dir):
    return churn.churn_rate(q_churn_first_last(spark, sf_dir), "churn")


# ----------------------------------------------------------------- label comparison
def _comparison(spark, sf_dir):
    prime = fx.prime(spark, sf_dir)
    months = snapshot_months(prime, at_least=2)
    return compare.compare_labels(churn.status_lifecycle(prime, months), churn.activation_lifecycle(prime, months))


def q_label_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir)


def q_agreement_stats(spark, sf_dir):
    return compare.agreement_stats(_comparison(spark, sf_dir))


def q_label_crosstab(spark, sf_dir):
    return compare.label_crosstab(_comparison(spark, sf_dir))


def q_disagreement_sample(spark, sf_dir):
    return compare.disagreement_sample(_comparison(spark, sf_dir), 20)


# ----------------------------------------------------------------- audits
def q_month_new_missing(spark, sf_dir):
    return audit.month_new_missing(fx.prime(spark, sf_dir))


def q_missing_reappearance(spark, sf_dir):
    return audit.missing_reappearance(fx.prime(spark, sf_dir))


def q_change_log(spark, sf_dir):
    return audit.change_log(fx.prime(spark, sf_dir), CHANGE_COLUMNS, pairing="all")


def q_change_rates(spark, sf_dir):
    return audit.change_rates(fx.prime(spark, sf_dir), CHANGE_COLUMNS)


def q_change_summary(spark, sf_dir):
    return audit.change_summary(fx.prime(spark, sf_dir), CHANGE_COLUMNS)


def q_change_log_counted(spark, sf_dir):
    return audit.change_log_counted(fx.prime(spark, sf_dir), CHANGE_COLUMNS)


def q_idless_report(spark, sf_dir):
    return audit.idless_report(fx.prime(spark, sf_dir))


def q_presence_changes(spark, sf_dir):
    return audit.presence_changes(fx.prime(spark, sf_dir))


def q_reappearing_ids(spark, sf_dir):
    return audit.reappearing_ids(fx.prime(spark, sf_dir))


# ----------------------------------------------------------------- months that lack columns
def q_activation_lifecycle_uneven(spark, sf_dir):
    return churn.activation_lifecycle(fx.prime_uneven(spark, sf_dir), absent=fx.ABSENT)


def q_status_lifecycle_uneven(spark, sf_dir):
    return churn.status_lifecycle(fx.prime_uneven(spark, sf_dir), absent=fx.ABSENT)


def q_label_comparison_uneven(spark, sf_dir):
    return compare.compare_labels(q_status_lifecycle_uneven(spark, sf_dir), q_activation_lifecycle_uneven(spark, sf_dir))


def q_change_log_uneven(spark, sf_dir):
    return audit.change_log(fx.prime_uneven(spark, sf_dir), CHANGE_COLUMNS, pairing="all", absent=fx.ABSENT)


def q_change_rates_uneven(spark, sf_dir):
    return audit.change_rates(fx.prime_uneven(spark, sf_dir), CHANGE_COLUMNS, absent=fx.ABSENT)


# ----------------------------------------------------------------- labels from a state that months merge into
def _merged_state(rows, months, id_col="RIMNO", **options):
    """The state after each month of ``rows`` was merged on its own, the newest first."""
    spark, path, merged = rows.sparkSession, None, None
    for month in reversed(months):
        new = scratch_path(spark)
        merged = state.advance(spark, rows.where(F.col(MONTH_COL) == F.lit(month)), path, new, id_col, **options)
        path = new
    return merged


def _state_labels(prime, **options):
    prime = _kept(prime)
    months = snapshot_months(prime, at_least=2)
    merged = _merged_state(prime, months, **options)
    latest = prime.where(F.col(MONTH_COL) == F.lit(months[-1]))
    return state.status_lifecycle(latest, merged), state.activation_lifecycle(latest, merged)


def q_status_lifecycle_state(spark, sf_dir):
    return _state_labels(fx.prime(spark, sf_dir))[0]


def q_activation_lifecycle_state(spark, sf_dir):
    return _state_labels(fx.prime(spark, sf_dir))[1]


def q_label_comparison_state(spark, sf_dir):
    return compare.compare_labels(*_state_labels(fx.prime_uneven(spark, sf_dir), absent=fx.ABSENT))


def q_churn_2month_state(spark, sf_dir):
    months = snapshot_months(fx.prime_raw(spark, sf_dir), at_least=3)
    active = _kept(_active(spark, sf_dir).select("CUSTOMER_ID", MONTH_COL))
    return state.churn_lookback(_merged_state(active, months, "CUSTOMER_ID"), 2, "CUSTOMER_ID", months)


def q_churn_first_last_state(spark, sf_dir):
    prime = _kept(fx.prime(spark, sf_dir).select("RIMNO", MONTH_COL, "CARD_STATUS", "ROW_ID"))
    months = snapshot_months(prime, at_least=2)
    base = prime.where(F.col(MONTH_COL) == F.lit(months[0]))
    return state.churn_between(base, _merged_state(prime.select("RIMNO", MONTH_COL), months), months[-1])


def q_presence_matrix(spark, sf_dir):
    return audit.presence_matrix(fx.prime(spark, sf_dir))


def q_id_set_report(spark, sf_dir):
    return audit.set_report({"prime": fx.prime(spark, sf_dir), "txn": fx.txn(spark, sf_dir)})


def q_lifecycle_totals(spark, sf_dir):
    act = churn.label_totals(q_activation_lifecycle(spark, sf_dir), "ACTIVATION_CHURN").withColumn("LABELS", F.lit("activation"))
    return act.unionByName(churn.label_totals(q_status_lifecycle(spark, sf_dir), "CHURN").withColumn("LABELS", F.lit("status")))


def q_common_ids_count(spark, sf_dir):
    return q_common_ids(spark, sf_dir).agg(F.count(F.lit(1)).alias("N_IDS"), F.min("RIMNO").alias("FIRST_ID"), F.max("RIMNO").alias("LAST_ID"))


def q_common_ids(spark, sf_dir):
    return audit.common_ids(fx.prime(spark, sf_dir), fx.txn(spark, sf_dir))


# ----------------------------------------------------------------- files
CSV_HEADERS = {"RIMNO": "RIM_NO", "PRODUCT_NAME": "NAME", "CARD_STATUS": "Card account status "}


def q_csv_scan(spark, sf_dir):
    """The snapshots written as CSV files, a folder a month, half of them with other headers and an unused
    column, and read back through the file reader and the typed contract."""
    raw, root = fx.prime_raw(spark, sf_dir), scratch_path(spark)
    folder = F.concat(F.lit("prime_"), F.upper(F.date_format(MONTH_COL, "MMM_yyyy")))
    old = F.month(raw[MONTH_COL]) % 2 == 0
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns if c != MONTH_COL], folder.alias("_folder"), old.alias("_old"))
    for part, names in ((text.where("_old"), CSV_HEADERS), (text.where("NOT _old").withColumn("TOTAL_HOLD", F.lit("1")), {})):
        part.drop("_old").withColumnsRenamed(names).write.mode("append").option("header", True).option("escape", '"') \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("encoding", "ISO-8859-1") \
            .partitionBy("_folder").csv(root)
    months = [f"{root}/{r[0]}" for r in text.select(F.concat(F.lit("_folder="), "_folder")).distinct().collect()]   # one a month
    clean = files.clean_snapshots(files.read_snapshots(spark, months, folders=True))
    return clean.select(MONTH_COL, F.col("ROW_ID").cast("long").alias("ROW_ID"), "RIMNO", "PRODUCT_NAME", "ACTIVATED", "STATUS", "CARD_STATUS",
                        "DOB", "BRANCH_NAME", "BRANCH_ID", "CREDIT_LIMIT", "DELIQUENCY", "CREATION_DATE", "CLOSURE_DATE", "ORGANIZATION",
                        F.lit("TOTAL_HOLD" in clean.columns).alias("HAS_UNUSED"))


def q_partitioned_sink(spark, sf_dir):
    """Segmented snapshots written partitioned by month and segment and read back, counted per partition."""
    path = scratch_path(spark)
    files.write_partitioned(_segmented(spark, sf_dir)[0].select("ROW_ID", "RIMNO", MONTH_COL, "SEGMENT"), path, [MONTH_COL, "SEGMENT"])
    return spark.read.parquet(path).groupBy(MONTH_COL, "SEGMENT").agg(F.count(F.lit(1)).alias("N_ROWS"), F.count_distinct("ROW_ID").alias("N_IDS"))


def q_id_report(spark, sf_dir):
    """The ids common to snapshots and transactions written as a text report and read back."""
    path = scratch_path(spark)
    files.write_ids(q_common_ids(spark, sf_dir), path, "common ids")
    return spark.read.text(path).withColumnRenamed("value", "LINE")


# ----------------------------------------------------------------- quality
def q_cast_report(spark, sf_dir):
    prime = quality.cast_and_report(fx.prime_raw(spark, sf_dir), contract.PRIME_CAST_PLAN)[1]
    txn = quality.cast_and_report(fx.txn_raw(spark, sf_dir), contract.TXN_CAST_PLAN)[1]
    return prime.withColumn("TABLE_NAME", F.lit("prime")).unionByName(txn.withColumn("TABLE_NAME", F.lit("txn")))


def q_date_formats(spark, sf_dir):
    """The vote on three text columns: one format with junk, day and month in two orders, two formats."""
    raw, row = fx.prime_raw(spark, sf_dir), F.col("ROW_ID")
    texts = raw.select("DOB", F.when(row % 50 == 0, F.date_format("CREATION_DATE", "MM/dd/yyyy"))
                       .otherwise(F.date_format("CREATION_DATE", "dd/MM/yyyy")).alias("CREATED"),
                       F.when(row % 7 == 0, F.date_format("CLOSURE_DATE", "dd.MM.yyyy"))
                       .otherwise(F.date_format("CLOSURE_DATE", "yyyyMMdd")).alias("CLOSED"))
    return quality.date_format_votes(texts, ["DOB", "CREATED", "CLOSED"])


def q_parse_numeric(spark, sf_dir):
    raw = fx.prime_raw(spark, sf_dir)
    return raw.select("ROW_ID", F.col("RIMNO").alias("RIMNO_RAW"), norm.parse_int("RIMNO").alias("RIMNO_INT"),
                      norm.parse_float("DOB_SERIAL").alias("DOB_SERIAL_FLOAT"))


def q_excel_serial_date(spark, sf_dir):
    raw = fx.prime_raw(spark, sf_dir)
    return raw.select("ROW_ID", "DOB_SERIAL", norm.excel_serial_to_timestamp("DOB_SERIAL").alias("DOB_FROM_SERIAL"))


def q_missing_profile(spark, sf_dir):
    return quality.missing_profile({"prime": fx.prime(spark, sf_dir), "txn": fx.txn(spark, sf_dir)})


def q_categorical_domain(spark, sf_dir):
    return quality.categorical_domain({"txn": (fx.txn(spark, sf_dir), contract.TXN_CATEGORICAL),
                                       "prime": (fx.prime(spark, sf_dir), contract.PRIME_CATEGORICAL)})


# ----------------------------------------------------------------- features
def _txn_capped(spark, sf_dir):
    """Transactions with BILLING_AMT and ORIG_AMOUNT capped at their p99 (the
    amounts every spend aggregate uses)."""
    t = fx.txn(spark, sf_dir)
    return features.winsorize(t, features.p99_caps(t, ["BILLING_AMT", "ORIG_AMOUNT"]))


def _features(spark, sf_dir):
    prime, txn = fx.prime(spark, sf_dir), fx.txn(spark, sf_dir)
    qs = exact_quantiles_multi(prime, {"ANNUAL_FEE": [0.5], "OVERDUEAMOUNT": [0.99]})
    fee_med, od_cap = qs["ANNUAL_FEE"][0], qs["OVERDUEAMOUNT"][0]
    return features.card_features(prime, fx.PRIME_AS_OF, features.txn_recency(txn, fx.TXN_AS_OF), fee_med, od_cap)


FEATURE_COLUMNS = ["ROW_ID", "SNAP_MONTH", "RIMNO", "GENDER", "ANNUAL_FEE", "OVERDUEAMOUNT", "ACCOUNT_TENURE_MONTHS",
                   "DAYS_SINCE_LAST_PAYMENT", "TIME_TO_CHURN_DAYS", "AGE", "AGE_GROUP", "LIMIT_BAND",
                   "UTILIZATION_RATIO", "AVAILABLE_CREDIT_RATIO", "FEE_TO_LIMIT_RATIO", "CARD_REPLACEMENT_FREQ",
                   "DAYS_SINCE_LAST_TXN"]
_ROUNDED = {"ACCOUNT_TENURE_MONTHS", "UTILIZATION_RATIO", "AVAILABLE_CREDIT_RATIO", "FEE_TO_LIMIT_RATIO",
            "ANNUAL_FEE", "OVERDUEAMOUNT"}


def q_impute_median(spark, sf_dir):
    t = fx.txn(spark, sf_dir)
    imp = features.impute_median(t.withColumn("ORIG_AMOUNT_RAW", F.col("ORIG_AMOUNT")), ["ORIG_AMOUNT"])
    return imp.select("TXN_ID", "ORIG_AMOUNT_RAW", F.round("ORIG_AMOUNT", 6).alias("ORIG_AMOUNT"))


def q_winsorize_p99(spark, sf_dir):
    t = features.impute_median(fx.txn(spark, sf_dir), ["ORIG_AMOUNT"])
    cols = ["BILLING_AMT", "SETTLEMENT_AMT", "ORIG_AMOUNT"]
    capped = features.winsorize(t, features.p99_caps(t, cols))
    return capped.select("TXN_ID", *[F.round(c, 6).alias(c) for c in cols])


def q_card_features(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select(*[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in FEATURE_COLUMNS])


def q_txn_recency(spark, sf_dir):
    return features.txn_recency(fx.txn(spark, sf_dir), fx.TXN_AS_OF)


def q_age_groups(spark, sf_dir):
    return features.band_counts(_features(spark, sf_dir), "AGE_GROUP", contract.AGE_BANDS, "AGE_GROUP")


def q_limit_bands(spark, sf_dir):
    return features.band_counts(_features(spark, sf_dir), "LIMIT_BAND", contract.LIMIT_BANDS, "LIMIT_BAND")


def _rfm(spark, sf_dir):
    return features.rfm(_txn_capped(spark, sf_dir), fx.TXN_AS_OF)


def q_rfm(spark, sf_dir):
    r = _rfm(spark, sf_dir)
    return r.select("RIMNO", "TOTAL_SPEND", "AVG_TXN", "TXN_COUNT", "RECENCY")


# ----------------------------------------------------------------- profile
def q_top_products(spark, sf_dir):
    return profile.top_values(fx.prime(spark, sf_dir), "PRODUCT_NAME", 15)


def q_top_customers(spark, sf_dir):
    """The customers with most transactions, by heavy hitters and an exact recount."""
    return profile.heavy_hitters(fx.txn(spark, sf_dir), "RIMNO", 25)


def q_top_branches(spark, sf_dir):
    return profile.top_values(fx.prime(spark, sf_dir), "BRANCH_NAME", 15)


def q_demographics(spark, sf_dir):
    return profile.demographics(fx.prime(spark, sf_dir), contract.DEMOGRAPHIC_COLUMNS, 8)


def q_delinquency_distribution(spark, sf_dir):
    p = fx.prime(spark, sf_dir)
    return (p.where(F.col("DELIQUENCY").isNotNull()).groupBy("DELIQUENCY").agg(F.count(F.lit(1)).alias("N"))
            .orderBy("DELIQUENCY").limit(10))


def q_foreign_share(spark, sf_dir):
    return profile.foreign_share(fx.txn(spark, sf_dir))


def q_top_foreign_countries(spark, sf_dir):
    t = fx.txn(spark, sf_dir)
    return profile.top_values(t.where(profile.foreign_flag() == 1), "TRXN_COUNTRY", 10)


def q_mcc_top_spend(spark, sf_dir):
    return profile.mcc_top_spend(_txn_capped(spark, sf_dir), 15)


def q_monthly_trend(spark, sf_dir):
    return profile.monthly_trend(_txn_capped(spark, sf_dir), fx.TREND_START, fx.TREND_END)


def q_correlation(spark, sf_dir):
    return profile.correlation(_features(spark, sf_dir), contract.CORR_COLUMNS)


def _per_source(spark, sf_dir, specs, make):
    """``make(table, specs, prefix=)`` of each source of the specs, as one table."""
    sources = {"prime": lambda: fx.prime(spark, sf_dir), "txn": lambda: fx.txn(spark, sf_dir),
               "features": lambda: _features(spark, sf_dir), "rfm": lambda: _rfm(spark, sf_dir)}
    out = None
    for src in dict.fromkeys(s[0] for s in specs):  # sources in spec order
        part = make(sources[src](), [tuple(spec) for s0, *spec in specs if s0 == src], prefix=f"{src}.")
        out = part if out is None else out.unionByName(part)
    return out


def q_histogram(spark, sf_dir):
    return _per_source(spark, sf_dir, contract.HIST_SPECS, profile.histograms)


def q_kde(spark, sf_dir):
    curve = _per_source(spark, sf_dir, contract.HIST_SPECS, profile.density)
    return curve.withColumns({"X": F.round("X", 6), "DENSITY": F.round("DENSITY", 9)})


def q_cap_before_after(spark, sf_dir):
    """Box statistics before and after the p99 cap.  Capping keeps the order of values, so the
    capped quartiles are the raw order statistics, capped: one quantile call per table."""
    t, p = fx.txn(spark, sf_dir), fx.prime(spark, sf_dir)
    out = None
    for src, cols in ((t, ["BILLING_AMT", "ORIG_AMOUNT"]), (p, ["OVERDUEAMOUNT"])):
        b = profile.box_stats_capped(src, cols, 0.99)
        out = b if out is None else out.unionByName(b)
    return out.select("COLUMN_NAME", "STAGE", "N", "Q1", "MEDIAN", "Q3", "WHISKER_LO", "WHISKER_HI", "N_OUTLIERS")


def q_boxplot_by_delinquency(spark, sf_dir):
    f = _features(spark, sf_dir).where(F.col("DELIQUENCY") > 0)
    return profile.grouped_box_stats(f, "DELIQUENCY", "OVERDUEAMOUNT")


# ----------------------------------------------------------------- segmentation
SEG_COLUMNS = ["TOTAL_SPEND_LOG", "AVG_TXN", "TXN_COUNT", "RECENCY"]
LOCAL_SHARE, GLOBAL_SHARE = 0.03, 0.01


def _seg_input(spark, sf_dir):
    """Per-customer numeric features (RFM of capped spend, log1p of the total)."""
    r = _rfm(spark, sf_dir)
    return r.select("RIMNO",
                    F.log1p(F.greatest(F.coalesce("TOTAL_SPEND", F.lit(0.0)), F.lit(0.0))).alias("TOTAL_SPEND_LOG"),
                    F.coalesce("AVG_TXN", F.lit(0.0)).alias("AVG_TXN"), F.col("TXN_COUNT").cast("double"),
                    F.col("RECENCY").cast("double"))


def _scaled(spark, sf_dir):
    return segment.robust_scale(_seg_input(spark, sf_dir), SEG_COLUMNS)


_FITS: dict[tuple, tuple] = {}


def _once(spark, sf_dir, what, make):
    """``make()`` once in a session for all queries on the folder."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _FITS:
        _FITS[key] = make()
    return _FITS[key]


def _seg_tables(spark, sf_dir):
    """(features, scaled features) of a folder, written once in a session."""
    def make():
        raw = _kept(_seg_input(spark, sf_dir))
        return raw, _kept(segment.robust_scale(raw, SEG_COLUMNS))
    return _once(spark, sf_dir, "tables", make)


def _fit(spark, sf_dir):
    """(table of scores, model) of a folder, fitted once in a session."""
    def make():
        table, _, model = segment.fit_best(_seg_tables(spark, sf_dir)[1], SEG_COLUMNS, "RIMNO", (2, 8))
        return table, model
    return _once(spark, sf_dir, "fit", make)


def _segments(spark, sf_dir):
    return segment.gmm_segments(_seg_tables(spark, sf_dir)[1], SEG_COLUMNS, "RIMNO", model=_fit(spark, sf_dir)[1])


def _with_vec(df):
    return df.withColumn("VEC", F.array(*[F.col(c).cast("double") for c in SEG_COLUMNS]))


def q_robust_scale(spark, sf_dir):
    return _scaled(spark, sf_dir).select("RIMNO", *[F.round(c, 6).alias(c) for c in SEG_COLUMNS])


def q_best_k(spark, sf_dir):
    return _fit(spark, sf_dir)[0]


def q_segments(spark, sf_dir):
    return _segments(spark, sf_dir).select("RIMNO", "CLUSTER")


def q_local_outliers(spark, sf_dir):
    seg = _kept(_with_vec(_segments(spark, sf_dir)).select("RIMNO", "CLUSTER", "VEC"))
    scored = segment.isolation_scores(seg, "RIMNO", "VEC", "CLUSTER")
    return segment.flag_outliers(scored, LOCAL_SHARE, "CLUSTER", "IS_LOCAL_OUTLIER")


def q_global_outliers(spark, sf_dir):
    sc = _kept(_with_vec(_seg_tables(spark, sf_dir)[1]).select("RIMNO", "VEC"))
    scored = segment.isolation_scores(sc, "RIMNO", "VEC")
    return segment.flag_outliers(scored, GLOBAL_SHARE, None, "IS_GLOBAL_OUTLIER")


def _flags(spark, sf_dir):
    """The segmentation input, written once, and its cluster and outlier labels."""
    raw = _seg_tables(spark, sf_dir)[0]
    clustered = _kept(_segments(spark, sf_dir))
    return raw, segment.outlier_flags(clustered, "RIMNO", SEG_COLUMNS, LOCAL_SHARE, GLOBAL_SHARE)


def q_cluster_profile(spark, sf_dir):
    """Mean of every feature per cluster, with the final outlier share (local OR global)."""
    raw, labels = _flags(spark, sf_dir)
    return segment.cluster_profile(raw, labels.select("RIMNO", "CLUSTER", "IS_OUTLIER"), "RIMNO", SEG_COLUMNS)


def q_band_profile(spark, sf_dir):
    """The cluster profile over a grouping that SQL knows: customers by number of transactions, outliers those of
    an average above 45,000."""
    raw = _seg_tables(spark, sf_dir)[0]
    labels = raw.select("RIMNO", F.floor(F.col("TXN_COUNT") / 10).cast("int").alias("CLUSTER"), (F.col("AVG_TXN") > 45000).alias("IS_OUTLIER"))
    out = segment.cluster_profile(raw, labels, "RIMNO", SEG_COLUMNS)
    return out.select("CLUSTER", "N", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("CLUSTER", "N")])


def q_segmentation_check(spark, sf_dir):
    """What holds for every fit: each customer once, none without a cluster, the final outlier the union of
    both, and the outlier share of each scope within one row of what was asked."""
    _, labels = _flags(spark, sf_dir)
    per = labels.groupBy("CLUSTER").agg(F.count(F.lit(1)).alias("N"), F.count_if("IS_LOCAL_OUTLIER").alias("L"),
                                        F.count_if("IS_GLOBAL_OUTLIER").alias("G"),
                                        F.count_if(F.col("IS_OUTLIER") != (F.col("IS_LOCAL_OUTLIER") | F.col("IS_GLOBAL_OUTLIER"))).alias("BAD"))
    off = F.abs(F.col("L") - LOCAL_SHARE * F.col("N"))
    totals = per.agg(F.sum("N").alias("N_CUSTOMERS"), F.sum(F.when(F.col("CLUSTER").isNull(), F.col("N")).otherwise(0)).alias("N_NO_CLUSTER"),
                     F.sum("BAD").alias("N_NOT_UNION"), F.count_if(off > 1).alias("N_LOCAL_SHARES_OFF"),
                     (F.abs(F.sum("G") - GLOBAL_SHARE * F.sum("N")) > 1).cast("int").alias("N_GLOBAL_SHARES_OFF"))
    ids = labels.agg(F.count_distinct(F.coalesce("RIMNO", F.lit("")))).first()[0]
    return totals.withColumn("N_IDS", F.lit(ids)).select("N_CUSTOMERS", "N_IDS", "N_NO_CLUSTER", "N_NOT_UNION",
                                                         "N_LOCAL_SHARES_OFF", "N_GLOBAL_SHARES_OFF")


QUERIES: dict[str, Query] = {
    "activation_lifecycle": q_activation_lifecycle,
    "status_lifecycle": q_status_lifecycle,
    "activation_summary": q_activation_summary,
    "status_summary": q_status_summary,
    "customer_ids": q_customer_ids,
    "active_historical": q_active_historical,
    "relatives": q_relatives,
    "txn_mapped": q_txn_mapped,
    "relatives_located": q_relatives_located,
    "txn_mapped_located": q_txn_mapped_located,
    "txn_missing": q_txn_missing,
    "mapping_coverage": q_mapping_coverage,
    "churn_1month": q_churn_1month,
    "churn_2month": q_churn_2month,
    "churn_first_last": q_churn_first_last,
    "churn_rate": q_churn_rate,
    "label_comparison": q_label_comparison,
    "agreement_stats": q_agreement_stats,
    "label_crosstab": q_label_crosstab,
    "disagreement_sample": q_disagreement_sample,
    "month_new_missing": q_month_new_missing,
    "missing_reappearance": q_missing_reappearance,
    "change_log": q_change_log,
    "change_rates": q_change_rates,
    "change_summary": q_change_summary,
    "common_ids": q_common_ids,
    "cast_report": q_cast_report,
    "date_formats": q_date_formats,
    "csv_scan": q_csv_scan,
    "partitioned_sink": q_partitioned_sink,
    "id_report": q_id_report,
    "band_profile": q_band_profile,
    "parse_numeric": q_parse_numeric,
    "excel_serial_date": q_excel_serial_date,
    "missing_profile": q_missing_profile,
    "categorical_domain": q_categorical_domain,
    "impute_median": q_impute_median,
    "winsorize_p99": q_winsorize_p99,
    "card_features": q_card_features,
    "txn_recency": q_txn_recency,
    "age_groups": q_age_groups,
    "limit_bands": q_limit_bands,
    "rfm": q_rfm,
    "top_products": q_top_products,
    "top_customers": q_top_customers,
    "top_branches": q_top_branches,
    "demographics": q_demographics,
    "delinquency_distribution": q_delinquency_distribution,
    "foreign_share": q_foreign_share,
    "top_foreign_countries": q_top_foreign_countries,
    "mcc_top_spend": q_mcc_top_spend,
    "monthly_trend": q_monthly_trend,
    "correlation": q_correlation,
    "histogram": q_histogram,
    "kde": q_kde,
    "cap_before_after": q_cap_before_after,
    "boxplot_by_delinquency": q_boxplot_by_delinquency,
    "robust_scale": q_robust_scale,
    "best_k": q_best_k,
    "segments": q_segments,
    "local_outliers": q_local_outliers,
    "global_outliers": q_global_outliers,
    "cluster_profile": q_cluster_profile,
    "segmentation_check": q_segmentation_check,
    "ambiguous_keys": q_ambiguous_keys,
    "txn_mapped_latest": q_txn_mapped_latest,
    "change_log_counted": q_change_log_counted,
    "idless_report": q_idless_report,
    "presence_changes": q_presence_changes,
    "reappearing_ids": q_reappearing_ids,
    "activation_lifecycle_uneven": q_activation_lifecycle_uneven,
    "status_lifecycle_uneven": q_status_lifecycle_uneven,
    "label_comparison_uneven": q_label_comparison_uneven,
    "change_log_uneven": q_change_log_uneven,
    "change_rates_uneven": q_change_rates_uneven,
    "status_lifecycle_state": q_status_lifecycle_state,
    "activation_lifecycle_state": q_activation_lifecycle_state,
    "label_comparison_state": q_label_comparison_state,
    "churn_2month_state": q_churn_2month_state,
    "churn_first_last_state": q_churn_first_last_state,
    "presence_matrix": q_presence_matrix,
    "id_set_report": q_id_set_report,
    "lifecycle_totals": q_lifecycle_totals,
    "common_ids_count": q_common_ids_count,
}
