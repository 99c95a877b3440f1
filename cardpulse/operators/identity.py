"""Customer identity: surrogate ids, active/historical split, relatives, transaction mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardpulse.functions import contract, norm
from cardpulse.functions.months import MONTH_COL
from cardpulse.operators.churn import spread_null_key

_LOCAL_BITS = 33  # monotonically_increasing_id = partition_id << 33 | row index in partition


def dense_ids(keys: DataFrame, order_cols: list[Column], id_col: str, num_partitions: int | None = None) -> DataFrame:
    """Dense 1..N numbering of ``keys`` in ``order_cols`` order without a one-partition window.

    Range-partition + sort within partitions (a distributed sort), number rows inside
    each partition, then add the running total of the preceding partitions' sizes.
    The per-partition size table has one row per partition, so broadcasting it is
    bounded by the partition count, not by the data.
    """
    n = num_partitions or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    local = ordered.withColumn("_MID", F.monotonically_increasing_id()) \
        .withColumn("_PID", F.shiftright("_MID", _LOCAL_BITS)) \
        .withColumn("_LOCAL", F.col("_MID").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    sizes = local.groupBy("_PID").agg(F.count(F.lit(1)).alias("_SIZE"))
    offsets = sizes.withColumn(
        "_OFFSET", F.coalesce(F.sum("_SIZE").over(Window.orderBy("_PID").rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0)))
    return (local.join(F.broadcast(offsets.select("_PID", "_OFFSET")), "_PID")
            .withColumn(id_col, F.col("_OFFSET") + F.col("_LOCAL") + 1)
            .drop("_MID", "_PID", "_LOCAL", "_OFFSET"))


def customer_keys(prime: DataFrame, id_col: str = "RIMNO", dob_col: str = "DOB",
                  num_partitions: int | None = None) -> DataFrame:
    """Distinct (RIMNO, DOB) over all months -> CUSTOMER_ID, ordered by (RIMNO, DOB), nulls first."""
    keys = prime.select(norm.numeric_id(id_col).alias(id_col), dob_col).distinct()
    out = dense_ids(keys, [F.col(id_col).asc_nulls_first(), F.col(dob_col).asc_nulls_first()],
                    "CUSTOMER_ID", num_partitions)
    spark = prime.sparkSession
    # numbering is computed once and cut from lineage: a recomputation after a lost
    # executor reads the checkpoint instead of re-deriving partition offsets
    from cardpulse.session import checkpoint_dir
    checkpoint_dir(spark)
    return out.checkpoint(eager=True)


def same(a: Column, b: Column) -> Column:
    """Null-safe equality that the planner leaves as a condition on matched rows, not as one more join key: with
    both sides stored by id, the id alone decides where rows meet."""
    return F.coalesce(a == b, F.lit(False)) | (a.isNull() & b.isNull())


def assign_customer_ids(prime: DataFrame, keys: DataFrame | None = None, id_col: str = "RIMNO",
                        dob_col: str = "DOB", located: bool = False) -> DataFrame:
    """Left join with null-safe key equality (a null id or DOB matches a null).

    One scan, one join.  All id-less rows share the null join key, i.e. one shuffle
    partition; AQE's skew join (enabled in the session settings) splits that
    partition of the streamed left side across tasks at run time, each joined with
    the few id-less keys of the right side.

    ``located``: both sides are stored by id, ids are canonical and not null (``sources.storage``)."""
    keys = keys if keys is not None else customer_keys(prime, id_col, dob_col)
    k = keys.select(F.col(id_col).alias("_K_ID"), F.col(dob_col).alias("_K_DOB"), "CUSTOMER_ID")
    if located:
        cond = (F.col(id_col) == F.col("_K_ID")) & same(F.col(dob_col), F.col("_K_DOB"))
        return prime.join(k, cond, "left").drop("_K_ID", "_K_DOB")
    cond = F.col(id_col).eqNullSafe(F.col("_K_ID")) & F.col(dob_col).eqNullSafe(F.col("_K_DOB"))
    prime = prime.withColumn(id_col, norm.numeric_id(id_col))  # any other id is none
    return prime.join(k, cond, "left").drop("_K_ID", "_K_DOB")


def is_historical(status_col: str = "STATUS", card_status_col: str = "CARD_STATUS", codes=None) -> Column:
    codes = list(codes or contract.INACTIVE_STATUSES)
    return (F.coalesce(F.col(status_col).isin(codes), F.lit(False))
            & F.coalesce(F.col(card_status_col).isin(codes), F.lit(False)))


def segment(with_ids: DataFrame, id_col: str = "RIMNO", product_col: str = "PRODUCT_NAME",
            dob_col: str = "DOB", located: bool = False) -> DataFrame:
    """SEGMENT in {historical, active, relative}.

    Historical: both status columns in the inactive code list.  Among the other
    rows, a (month, id, product) card group holding more than one CUSTOMER_ID keeps
    the rows with the oldest DOB; the remaining rows are relatives.  The group
    statistics come from a partial aggregate joined back (a hot card key is split by
    AQE's skew join), and rows with a null id/product skip the join entirely.
    """
    hist = is_historical()
    base = with_ids.withColumn("_HIST", hist)
    grp_keys = [MONTH_COL, id_col, product_col]
    eligible = ~F.col("_HIST") & F.col(id_col).isNotNull() & F.col(product_col).isNotNull()
    groups = (base.where(eligible)
              .groupBy(*grp_keys)
              .agg(F.min("CUSTOMER_ID").alias("_MIN_CID"), F.max("CUSTOMER_ID").alias("_MAX_CID"),
                   F.min(dob_col).alias("_OLDEST_DOB"))
              .where(F.col("_MIN_CID") != F.col("_MAX_CID"))
              .select(*[F.col(k).alias(f"_G_{k}") for k in grp_keys], "_OLDEST_DOB"))
    relative = F.col("_OLDEST_DOB").isNotNull() & ~F.col(dob_col).eqNullSafe(F.col("_OLDEST_DOB"))
    label = F.when(F.col("_HIST"), "historical").when(relative, "relative").otherwise("active")
    if located:
        cond = F.col(id_col) == F.col(f"_G_{id_col}")
        for k in (MONTH_COL, product_col):
            cond = cond & same(F.col(k), F.col(f"_G_{k}"))
        return base.join(groups, cond & eligible, "left").withColumn("SEGMENT", label).select(*with_ids.columns, "SEGMENT")
    # rows outside any card group get a key of their own: one join, one scan of the rows
    key = F.when(eligible, F.col(id_col)).otherwise(F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string")))
    cond = (F.col("_JK") == F.col(f"_G_{id_col}")) & (F.col(MONTH_COL) == F.col(f"_G_{MONTH_COL}")) \
        & (F.col(product_col) == F.col(f"_G_{product_col}"))
    joined = base.withColumn("_JK", key).join(groups, cond, "left")
    return joined.withColumn("SEGMENT", label).select(*with_ids.columns, "SEGMENT")


def customer_lookup(segmented: DataFrame, id_col: str = "RIMNO", product_col: str = "PRODUCT_NAME") -> DataFrame:
    """Distinct (RIMNO, PRODUCT_NAME, CUSTOMER_ID) from active rows of all months."""
    return (segmented.where(F.col("SEGMENT") == "active")
            .select(id_col, product_col, "CUSTOMER_ID").distinct())


def latest_lookup(segmented: DataFrame, id_col: str = "RIMNO", product_col: str = "PRODUCT_NAME") -> DataFrame:
    """One CUSTOMER_ID per card key: the one seen in the latest month (then the
    smallest), for mapping transactions without fan-out (``on_ambiguous='latest'``)."""
    act = segmented.where(F.col("SEGMENT") == "active")
    return (act.groupBy(id_col, product_col)
            .agg(F.min_by("CUSTOMER_ID", F.struct(-F.unix_date(F.col(MONTH_COL)), F.col("CUSTOMER_ID")))
                 .alias("CUSTOMER_ID")))


def map_transactions(txn: DataFrame, lookup: DataFrame, id_col: str = "RIMNO",
                     product_col: str = "PRODUCT_NAME", located: bool = False) -> DataFrame:
    """Left join on (RIMNO, PRODUCT_NAME), the product null-safe; a key held by several
    CUSTOMER_IDs multiplies the transaction (as the studied mapping does).  A transaction
    without an id belongs to no customer: it stays one row without a CUSTOMER_ID and gets a
    key of its own, so such rows spread over all partitions.

    One scan of the transactions, one join; the lookup side is small per key and is
    broadcast by AQE once its measured size allows.  A hot key is split by AQE's skew join
    on the streamed transaction side."""
    lk = lookup.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_L_ID"), F.col(product_col).alias("_L_P"), "CUSTOMER_ID")
    if located:
        cond = (F.col(id_col) == F.col("_L_ID")) & same(F.col(product_col), F.col("_L_P"))
        return txn.join(lk, cond, "left").drop("_L_ID", "_L_P")
    cond = (F.col("_JK") == F.col("_L_ID")) & F.col(product_col).eqNullSafe(F.col("_L_P"))
    txn = txn.withColumn(id_col, norm.numeric_id(id_col))
    return txn.withColumn("_JK", spread_null_key(id_col)).join(lk, cond, "left").drop("_JK", "_L_ID", "_L_P")


def ambiguous_keys(lookup: DataFrame, id_col: str = "RIMNO", product_col: str = "PRODUCT_NAME") -> DataFrame:
    """Card keys mapped to more than one CUSTOMER_ID (they fan transactions out)."""
    return (lookup.groupBy(id_col, product_col).agg(F.count(F.lit(1)).alias("N_CUSTOMER_IDS"))
            .where("N_CUSTOMER_IDS > 1"))


def mapping_coverage(frames: dict[str, DataFrame], id_col: str = "CUSTOMER_ID") -> DataFrame:
    """Rows, assigned and unmatched counts per source."""
    out = None
    for name, df in frames.items():
        agg = df.agg(F.count(F.lit(1)).alias("N_ROWS"), F.count(id_col).alias("N_ASSIGNED"),
                     F.count_if(F.col(id_col).isNull()).alias("N_UNMATCHED")).withColumn("SOURCE", F.lit(name))
        out = agg if out is None else out.unionByName(agg)
    return out.select("SOURCE", "N_ROWS", "N_ASSIGNED", "N_UNMATCHED")
