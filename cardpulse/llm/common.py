"""Helpers shared by the training-data operators: shared scratch tables, running sums, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardpulse.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a compressed table in the shared folder and read it back: lineage
    ends there, so a lost executor costs a re-read and never a recomputation."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder, for small tables."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that starts with ``name`` and that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``most_rows`` rows; otherwise as it is, to be shuffled.
    For checkpointed tables of a few short columns."""
    return F.broadcast(df) if df.count() <= most_rows else df


def share_of(key: Column | str, salt: str) -> Column:
    """A number in [0, 1) from 53 bits of a hash of ``key``, for samples of any share."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 11) / F.lit(float(1 << 53))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that only a part's texts are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def utf8_rows(column: pa.ChunkedArray | pa.Array) -> list:
    """The column's texts as bytes (no decoding)."""
    return column.cast(pa.binary()).to_pylist()


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that precede in ``order``.

    The rows are range-partitioned by (group, order), so a group of any size spreads over
    many tasks; each task adds up its own sorted rows, and the totals of the tasks (one row
    per task and group) give the starting points.  The result is a written table.
    """
    import pandas as pd

    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = df.select("*", F.lit(0).alias("_pid"), F.lit(0).cast("long").alias("_run")).schema

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, last, total = TaskContext.get().partitionId(), None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            v = pdf[value].to_numpy(dtype="int64")
            g = pdf[group].astype(object).where(pdf[group].notna(), None)
            new = g.ne(g.shift()).to_numpy() & ~(g.isna() & g.shift().isna()).to_numpy()
            new[0] = False
            before = v.cumsum() - v
            starts = pd.Series(before).where(pd.Series(new)).ffill()
            same = g.iloc[0] == last if last is not None else False
            carry = total if same else 0
            run = before - starts.fillna(0).to_numpy(dtype="int64") + (~pd.Series(new).cummax()).to_numpy() * carry
            total, last = int(run[-1] + v[-1]), g.iloc[-1]
            yield pdf.assign(_pid=pid, _run=run)

    local = materialise(ranged.mapInPandas(add_up, schema))
    totals = local.groupBy(group, "_pid").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(group).alias("_g"), F.col("_pid").alias("_p"),
                           F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))
    return (local.join(starts, local[group].eqNullSafe(starts["_g"]) & (local["_pid"] == starts["_p"]))
            .withColumn(out, F.col("_run") + F.col("_start")).drop("_pid", "_run", "_g", "_p", "_start"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` -> (node, component); component is the least node.

    Alternating large-star and small-star rounds: each node hands its neighbours to the least
    of them, so the rows never grow beyond the edges given, and rounds grow with the logarithm
    of the longest chain.  Every round is one written table; only two counters reach the driver.
    """
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                     .where("u <> v").distinct())
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        e = checkpointed(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                         .union(small.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots.join(stars.select("node"), "node", "left_anti")).distinct()
