"""Tables stored by customer id, so that a chain of joins on the id moves no rows.

Each table is written once as a table bucketed and sorted by the id; tables with the same number of
buckets meet bucket by bucket, without an exchange.  A bucket is one task, so ids that would
overfill one are kept out: an id is hot if in some table it has more than ``HOT_FACTOR`` times the rows
of an average bucket, which at most buckets / HOT_FACTOR ids of a table can have.  Rows of hot ids and
rows without an id go to a plain table beside the buckets, in all tables alike, and are joined by
shuffles that split skewed partitions.  An id is wholly in one part, so the results of both
parts together are the result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.functions import norm
from cardpulse.operators import identity
from cardpulse.session import scratch_path

HOT_FACTOR = 4


@dataclass
class Stored:
    """A table stored by id: ``cold`` in buckets, ``hot`` (hot ids and null ids) plain."""

    cold: DataFrame
    hot: DataFrame
    name: str

    def drop(self) -> None:
        """Forget the bucketed table (its files are in the shared scratch folder)."""
        self.cold.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")

    def all(self) -> DataFrame:
        return self.cold.unionByName(self.hot)


def hot_ids(tables: list[DataFrame], buckets: int, id_col: str = "RIMNO", factor: float = HOT_FACTOR) -> list:
    """Ids with more than ``factor`` times the rows of an average bucket in some table: at most
    buckets / factor ids of each table."""
    out = set()
    for t in tables:
        n = t.count()
        per = t.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_N"))
        out |= {r[0] for r in per.where(F.col("_N") > factor * n / buckets).select(id_col).collect()}
    return sorted(out)


def store(df: DataFrame, buckets: int, hot: list, id_col: str = "RIMNO") -> Stored:
    """``df`` with rows of the ids ``hot`` and of no id apart, the rest in buckets sorted by the id."""
    spark, name = df.sparkSession, f"by_id_{uuid.uuid4().hex}"
    apart = F.col(id_col).isNull() | F.col(id_col).isin(hot)
    (df.where(~apart).repartition(buckets, id_col).write.bucketBy(buckets, id_col).sortBy(id_col)
     .option("path", scratch_path(spark)).saveAsTable(name))
    plain = scratch_path(spark)
    df.where(apart).write.parquet(plain)
    return Stored(spark.table(name), spark.read.schema(df.schema).parquet(plain), name)


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class Identified:
    """What the identity chain gives: the segmented snapshots and the mapped transactions."""

    segmented: DataFrame
    mapped: DataFrame
    cold_segmented: DataFrame
    cold_mapped: DataFrame


def identify(prime: DataFrame, txn: DataFrame, buckets: int | None = None, id_col: str = "RIMNO", dob_col: str = "DOB",
             hot_factor: float = HOT_FACTOR) -> Identified:
    """Surrogate ids, segments and mapped transactions over tables stored by id.

    Snapshots, transactions and customer keys are each written once; the joins of snapshots with keys,
    of snapshots with their card groups and of transactions with the lookup then move no rows but those of hot ids."""
    spark = prime.sparkSession
    buckets = buckets or default_buckets(spark)
    prime, txn = (t.withColumn(id_col, norm.numeric_id(id_col)) for t in (prime, txn))
    hot = hot_ids([prime, txn], buckets, id_col, hot_factor)
    rows, moves = store(prime, buckets, hot, id_col), store(txn, buckets, hot, id_col)
    keys = store(identity.customer_keys(rows.all(), id_col, dob_col), buckets, hot, id_col)
    cold = identity.segment(identity.assign_customer_ids(rows.cold, keys.cold, id_col, dob_col, located=True), located=True)
    warm = identity.segment(identity.assign_customer_ids(rows.hot, keys.hot, id_col, dob_col))
    cold_mapped = identity.map_transactions(moves.cold, identity.customer_lookup(cold), located=True)
    warm_mapped = identity.map_transactions(moves.hot, identity.customer_lookup(warm))
    return Identified(cold.unionByName(warm), cold_mapped.unionByName(warm_mapped), cold, cold_mapped)
