"""Cleaning statistics and engineered features: imputation, p99 capping, ratios,
tenure/age bands, transaction recency, RFM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardpulse.functions import contract, norm
from cardpulse.functions.stats import exact_quantiles_multi


def _lit_double(v):
    return F.lit(v).cast("double")


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls of each column <- the column's exact median."""
    present = [c for c in cols if c in df.columns]
    meds = {c: v[0] for c, v in exact_quantiles_multi(df, {c: [0.5] for c in present}).items()} if present else {}
    return df.withColumns({c: F.coalesce(F.col(c), _lit_double(m)) for c, m in meds.items() if m is not None})


def p99_caps(df: DataFrame, cols: list[str], q: float = 0.99) -> dict[str, float]:
    present = [c for c in cols if c in df.columns]
    if not present:
        return {}
    return {c: v[0] for c, v in exact_quantiles_multi(df, {c: [q] for c in present}).items()}


def winsorize(df: DataFrame, caps: dict[str, float]) -> DataFrame:
    """Values above the cap -> cap; nulls stay null."""
    return df.withColumns({c: F.when(F.col(c) > F.lit(v), _lit_double(v)).otherwise(F.col(c))
                           for c, v in caps.items() if v is not None})


def band(x: Column, bands) -> Column:
    """Right-closed bins (lo, hi] -> label; outside -> null."""
    expr = None
    for lo, hi, label in bands:
        cond = x > F.lit(lo) if hi is None else (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def band_counts(df: DataFrame, col: str, bands, name: str) -> DataFrame:
    """Counts per band in display order, empty bands included."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(i + 1, b[2]) for i, b in enumerate(bands)], f"BAND_ORDER int, {name} string")
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("N")) \
        .withColumnRenamed(col, name)
    return (F.broadcast(spine).join(counts, name, "left")
            .select("BAND_ORDER", name, F.coalesce("N", F.lit(0)).cast("bigint").alias("N")))


def txn_recency(txn: DataFrame, as_of: str, id_col: str = "RIMNO", date_col: str = "TRXN_DATE") -> DataFrame:
    """Last transaction per id and whole days since it (ids without a value dropped)."""
    return (txn.where(F.col(id_col).isNotNull()).groupBy(id_col)
            .agg(F.max(date_col).alias("LAST_TXN_DATE"))
            .withColumn("DAYS_SINCE_LAST_TXN", norm.days_between(F.lit(as_of).cast("date"), F.col("LAST_TXN_DATE"))))


def card_features(prime: DataFrame, as_of: str, recency: DataFrame | None = None,
                  annual_fee_median: float | None = None, overdue_cap: float | None = None) -> DataFrame:
    """Engineered per-row features of the prime snapshots.

    GENDER null -> 'Unknown'; ANNUAL_FEE null -> median; OVERDUEAMOUNT capped at p99;
    tenure (days/30), days since last payment, lifetime (closure - creation), age
    (floor(days/365)) and its band, credit-limit band, utilisation / available /
    fee-to-limit ratios (zero limit -> null), replacement frequency (nulls as 0) and,
    when given, days since the last transaction by id (left join on the id).
    """
    asof = F.lit(as_of).cast("date")
    limit = F.nullif(F.col("CREDIT_LIMIT"), F.lit(0.0))
    out = prime
    if annual_fee_median is not None:
        out = out.withColumn("ANNUAL_FEE", F.coalesce("ANNUAL_FEE", _lit_double(annual_fee_median)))
    if overdue_cap is not None:
        out = winsorize(out, {"OVERDUEAMOUNT": overdue_cap})
    age = F.floor(F.datediff(asof, F.col("DOB")) / F.lit(365)).cast("bigint")
    rep = [c for c in ("FIRST_REPLACED_CARD", "SECOND_REPLACED_CARD", "THIRD_REPLACED_CARD") if c in prime.columns]
    out = out.withColumns({
        "GENDER": F.coalesce(F.col("GENDER"), F.lit("Unknown")),
        "ACCOUNT_TENURE_MONTHS": F.datediff(asof, F.col("CREATION_DATE")) / F.lit(30.0),
        "DAYS_SINCE_LAST_PAYMENT": F.datediff(asof, F.col("LAST_PAYMENT_DATE")).cast("bigint"),
        "TIME_TO_CHURN_DAYS": F.datediff(F.col("CLOSURE_DATE"), F.col("CREATION_DATE")).cast("bigint"),
        "AGE": age,
        "UTILIZATION_RATIO": F.col("LEDGER_BALANCE") / limit,
        "AVAILABLE_CREDIT_RATIO": F.col("AVAILABLE_LIMIT") / limit,
        "FEE_TO_LIMIT_RATIO": (F.col("JOINING_FEE") + F.col("ANNUAL_FEE")) / limit,
        "CARD_REPLACEMENT_FREQ": sum((F.coalesce(F.col(c), F.lit(0.0)) for c in rep), F.lit(0.0)),
    })
    out = out.withColumn("AGE_GROUP", band(F.col("AGE"), contract.AGE_BANDS)) \
        .withColumn("LIMIT_BAND", band(F.col("CREDIT_LIMIT"), contract.LIMIT_BANDS))
    if recency is not None:
        out = out.join(recency.select("RIMNO", "DAYS_SINCE_LAST_TXN"), "RIMNO", "left")
    return out


def rfm(txn: DataFrame, as_of: str, id_col: str = "RIMNO", amount_col: str = "BILLING_AMT",
        date_col: str = "TRXN_DATE") -> DataFrame:
    """Recency / frequency / monetary per id: one partial+final hash aggregate.  Amounts are
    added as decimals, so the totals do not depend on the order of the rows."""
    return (txn.where(F.col(id_col).isNotNull()).groupBy(id_col)
            .agg(F.sum(F.col(amount_col).cast("decimal(20,6)")).cast("double").alias("TOTAL_SPEND"),
                 F.count(amount_col).alias("TXN_COUNT"), F.max(date_col).alias("_LAST"))
            .select(id_col, "TOTAL_SPEND", F.when(F.col("TXN_COUNT") > 0, F.col("TOTAL_SPEND") / F.col("TXN_COUNT")).alias("AVG_TXN"),
                    "TXN_COUNT",
                    norm.days_between(F.lit(as_of).cast("date"), F.col("_LAST")).alias("RECENCY")))
