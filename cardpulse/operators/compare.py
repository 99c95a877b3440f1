"""Reconciliation of the STATUS-based and ACTIVATED-based churn labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardpulse.functions import contract


def compare_labels(status_labels: DataFrame, activation_labels: DataFrame, id_col: str = "RIMNO") -> DataFrame:
    """Full outer join of one row per id from each side.

    Each side is first reduced to one row per id (churned wins, smallest type); the
    id-less rows form one group of their own and match each other (null-safe key).
    Missing flags become -1; AGREE compares the flags; DISAGREE_TYPE names the case.
    """
    def one_row(labels: DataFrame, flag: str, kind: str) -> DataFrame:  # flag and type of the same row
        first = F.min(F.struct((-F.col(flag)).alias("_O"), F.col(kind), F.col(flag))).alias("_R")
        return labels.groupBy(id_col).agg(first).select(id_col, F.col(f"_R.{flag}"), F.col(f"_R.{kind}"))

    s = one_row(status_labels, "CHURN", "CHURN_TYPE").withColumn("_S", F.lit(True))
    a = (one_row(activation_labels, "ACTIVATION_CHURN", "ACTIVATION_CHURN_TYPE")
         .withColumnRenamed(id_col, "_A_ID").withColumn("_A", F.lit(True)))
    j = s.join(a, F.col(id_col).eqNullSafe(F.col("_A_ID")), "full")
    merge = (F.when(F.col("_S").isNotNull() & F.col("_A").isNotNull(), "both")
             .when(F.col("_S").isNotNull(), "left_only").otherwise("right_only"))
    c = F.coalesce(F.col("CHURN"), F.lit(-1))
    ac = F.coalesce(F.col("ACTIVATION_CHURN"), F.lit(-1))
    dtype = (F.when(merge == "left_only", "only_in_status_file")
             .when(merge == "right_only", "only_in_activation_file")
             .when((c == 0) & (ac == 0), "both_not_churn")
             .when((c == 1) & (ac == 1), "both_churn")
             .when((c == 0) & (ac == 1), "ACTIVATION_churn_only")
             .when((c == 1) & (ac == 0), "STATUS_churn_only")
             .otherwise(""))
    return j.select(F.when(F.col("_S").isNotNull(), F.col(id_col)).otherwise(F.col("_A_ID")).alias(id_col),
                    c.cast("int").alias("CHURN"), F.col("CHURN_TYPE"),
                    ac.cast("int").alias("ACTIVATION_CHURN"), F.col("ACTIVATION_CHURN_TYPE"),
                    merge.alias("MERGE"), (c == ac).alias("AGREE"), dtype.alias("DISAGREE_TYPE"))


def agreement_stats(comparison: DataFrame) -> DataFrame:
    """Count and share of each DISAGREE_TYPE in fixed order (zero rows kept)."""
    spark = comparison.sparkSession
    spine = spark.createDataFrame([(i + 1, t) for i, t in enumerate(contract.DISAGREE_TYPES)],
                                  "TYPE_ORDER int, DISAGREE_TYPE string")
    counts = comparison.groupBy("DISAGREE_TYPE").agg(F.count(F.lit(1)).alias("N"))
    joined = F.broadcast(spine).join(counts, "DISAGREE_TYPE", "full")  # spine: six fixed types
    everything = Window.partitionBy()  # over at most seven type rows
    both_types = ["both_churn", "both_not_churn", "STATUS_churn_only", "ACTIVATION_churn_only"]
    n = F.coalesce("N", F.lit(0))
    return (joined.withColumn("TOTAL", F.sum(n).over(everything))
            .withColumn("N_BOTH", F.sum(F.when(F.col("DISAGREE_TYPE").isin(both_types), n)).over(everything))
            .withColumn("N_AGREE", F.sum(F.when(F.col("DISAGREE_TYPE").isin(both_types[:2]), n)).over(everything))
            .where(F.col("TYPE_ORDER").isNotNull())
            .select("TYPE_ORDER", "DISAGREE_TYPE", F.coalesce("N", F.lit(0)).cast("bigint").alias("N"),
                    F.round(F.try_divide(F.coalesce("N", F.lit(0)) * 100.0, F.col("TOTAL")), 4).alias("PCT"),
                    F.col("N_BOTH").cast("bigint"), F.col("N_AGREE").cast("bigint"),
                    (F.col("N_BOTH") - F.col("N_AGREE")).cast("bigint").alias("N_DISAGREE")))


def label_crosstab(comparison: DataFrame) -> DataFrame:
    """CHURN_TYPE x ACTIVATION_CHURN_TYPE counts with 'All' margins (long form via CUBE)."""
    r = F.coalesce(F.col("CHURN_TYPE"), F.lit("(missing)")).alias("CHURN_TYPE")
    c = F.coalesce(F.col("ACTIVATION_CHURN_TYPE"), F.lit("(missing)")).alias("ACTIVATION_CHURN_TYPE")
    cube = comparison.select(r, c).cube("CHURN_TYPE", "ACTIVATION_CHURN_TYPE") \
        .agg(F.count(F.lit(1)).alias("N"), F.grouping("CHURN_TYPE").alias("_GR"),
             F.grouping("ACTIVATION_CHURN_TYPE").alias("_GC"))
    return cube.select(F.when(F.col("_GR") == 1, "All").otherwise(F.col("CHURN_TYPE")).alias("CHURN_TYPE"),
                       F.when(F.col("_GC") == 1, "All").otherwise(F.col("ACTIVATION_CHURN_TYPE"))
                       .alias("ACTIVATION_CHURN_TYPE"),
                       F.col("N").cast("bigint"))


def disagreement_sample(comparison: DataFrame, n: int = 20, id_col: str = "RIMNO") -> DataFrame:
    """First ``n`` disagreeing ids present in both files, by id (a top-k report)."""
    return (comparison.where((F.col("MERGE") == "both") & ~F.col("AGREE"))
            .orderBy(F.col(id_col).asc_nulls_last()).limit(n)
            .select(id_col, "CHURN", "CHURN_TYPE", "ACTIVATION_CHURN", "ACTIVATION_CHURN_TYPE"))


def label_crosstab_wide(comparison: DataFrame) -> DataFrame:
    """Wide crosstab: one row per CHURN_TYPE, one column per ACTIVATION_CHURN_TYPE,
    plus 'All' margins (pivot over the fixed class list, no value discovery pass)."""
    from cardpulse.functions import contract
    cols = [c for c, _ in contract.ACTIVATION_CLASSES] + ["(missing)", "All"]
    long = label_crosstab(comparison)
    return long.groupBy("CHURN_TYPE").pivot("ACTIVATION_CHURN_TYPE", cols).agg(F.first("N")).na.fill(0, cols)
