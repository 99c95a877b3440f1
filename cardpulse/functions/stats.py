"""Exact quantiles that stay distributed.

Spark's exact ``percentile`` keeps every distinct value of a group in one task's
memory, which does not survive a 100 TB column.  Here an exact order statistic is
found by rank: values are counted, the (value, count) rows are range-partitioned and
sorted, running counts inside each partition are added to the totals of the
partitions before it, and only the rows that hold a wanted rank are kept.  Whole
columns are first narrowed: a ``percentile_approx`` sketch on a fixed grid gives each
wanted rank a value bracket, an exact count verifies that the rank lies in it, and a
bracket that misses is widened, in the end to the whole column.  The same path runs
at every size, and the driver receives at most two rows per quantile.
Interpolation between the two neighbouring order statistics is linear (the
definition used by pandas/NumPy and DuckDB ``quantile_cont``).
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardpulse.session import checkpoint_dir

GRID = 200  # a bracket is a few grid cells, about 2.5% of the rows
ACCURACY = 5_000  # sketch rank error <= n/5000, well inside one grid cell
MARGIN = 2  # grid cells on either side of a wanted rank, widened fourfold on a miss


def _between(c: str, lo, hi) -> Column:
    inside = F.col(c).isNotNull()
    if lo is not None:
        inside = inside & (F.col(c) >= F.lit(lo))
    if hi is not None:
        inside = inside & (F.col(c) <= F.lit(hi))
    return inside


def value_ranks(counts: DataFrame, group: str, value: str, count: str) -> DataFrame:
    """``counts`` (one row per group and value) with ``_BEFORE``: how many of the group's rows hold
    a smaller value.  Groups of any size spread over the range partitions."""
    order = [F.col(group).asc_nulls_first(), F.col(value).asc()]
    checkpoint_dir(counts.sparkSession)
    # written once, so that the partition numbers below cannot change between passes
    ranged = (counts.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_PID", F.spark_partition_id())).checkpoint(eager=True)
    totals = ranged.groupBy("_PID", group).agg(F.sum(count).alias("_N"))
    earlier = Window.partitionBy(group).orderBy("_PID").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_PID").alias("_P"), F.col(group).alias("_G"),
                           F.coalesce(F.sum("_N").over(earlier), F.lit(0)).alias("_START"))
    mine = Window.partitionBy("_PID", group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_LOCAL", F.coalesce(F.sum(count).over(mine), F.lit(0)))
    return (local.join(starts, (F.col("_PID") == F.col("_P")) & F.col(group).eqNullSafe(F.col("_G")))
            .withColumn("_BEFORE", F.col("_START") + F.col("_LOCAL"))
            .drop("_PID", "_P", "_G", "_START", "_LOCAL"))


def _positions(n: int, p: float) -> tuple[int, int, float]:
    pos = p * (n - 1)
    k = math.floor(pos)
    return k, min(k + 1, n - 1), pos - k


def _brackets(x: DataFrame, wanted: list[tuple[str, int, int]], n: dict[str, int], sketches) -> list[dict]:
    """A verified value bracket for the ranks (lowest, highest) of each wanted (column, lowest, highest):
    ``below`` values of the column are smaller than its lower end."""
    out = [{"col": c, "ranks": (a, b), "margin": MARGIN} for c, a, b in wanted]
    todo = out
    while todo:
        aggs = []
        for i, b in enumerate(todo):
            qs, size = sketches[b["col"]], n[b["col"]]
            lo = math.floor(b["ranks"][0] / size * GRID) - b["margin"]
            hi = math.ceil((b["ranks"][1] + 1) / size * GRID) + b["margin"]
            b["lo"], b["hi"] = (qs[lo] if lo > 0 else None), (qs[hi] if hi < GRID else None)
            below = F.lit(False) if b["lo"] is None else F.col(b["col"]) < F.lit(b["lo"])
            aggs += [F.count_if(below).alias(f"b{i}"), F.count_if(_between(b["col"], b["lo"], b["hi"])).alias(f"i{i}")]
        row = x.agg(*aggs).first()
        missed = []
        for i, b in enumerate(todo):
            b["below"] = row[f"b{i}"]
            if not (b["below"] <= b["ranks"][0] and b["ranks"][1] < b["below"] + row[f"i{i}"]):
                b["margin"] = 4 * max(1, b["margin"])
                missed.append(b)
        todo = missed
    return out


def order_statistics(df: DataFrame, spec: dict[str, list[float]]) -> dict[str, list[tuple[float, float, float] | None]]:
    """Per column and quantile the two neighbouring order statistics and the fraction between them
    (nulls and NaN ignored per column; None for an empty column), sharing every pass over the data."""
    cols = list(spec)
    # the projected columns are kept (memory, spilling to disk) across the few passes
    # so the upstream plan is not recomputed per pass; lost blocks are recomputed
    x = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
                    for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        grid = [i / GRID for i in range(GRID + 1)]
        first = x.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                      *[F.percentile_approx(c, grid, ACCURACY).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        n = {c: first[f"n{i}"] for i, c in enumerate(cols)}
        sketches = {c: first[f"s{i}"] for i, c in enumerate(cols)}
        plan = {c: [_positions(n[c], p) if n[c] else None for p in probs] for c, probs in spec.items()}
        wanted = sorted({(c, it[0], it[1]) for c, items in plan.items() for it in items if it})
        if not wanted:
            return {c: [None] * len(items) for c, items in plan.items()}
        brackets = _brackets(x, wanted, n, sketches)
        rows = x.select(F.explode(F.array(*[
            F.when(_between(b["col"], b["lo"], b["hi"]), F.struct(F.lit(i).alias("b"), F.col(b["col"]).alias("v")))
            for i, b in enumerate(brackets)])).alias("_R")).where("_R IS NOT NULL").select("_R.b", "_R.v")
        ranked = value_ranks(rows.groupBy("b", "v").agg(F.count(F.lit(1)).alias("c")), "b", "v", "c")
        holds = F.lit(False)
        for i, b in enumerate(brackets):
            for r in set(b["ranks"]):
                at = F.lit(r - b["below"])
                holds = holds | ((F.col("b") == i) & (F.col("_BEFORE") <= at) & (at < F.col("_BEFORE") + F.col("c")))
        values = {}
        for row in ranked.where(holds).collect():  # one or two rows per quantile
            b = brackets[row["b"]]
            for r in b["ranks"]:
                if row["_BEFORE"] <= r - b["below"] < row["_BEFORE"] + row["c"]:
                    values[(b["col"], r)] = row["v"]
        return {c: [None if it is None else (values[(c, it[0])], values[(c, it[1])], it[2]) for it in items]
                for c, items in plan.items()}
    finally:
        x.unpersist()


def interpolate(stat: tuple[float, float, float] | None, cap: float = math.inf) -> float | None:
    """The quantile between two order statistics, of the values cut off at ``cap``."""
    if stat is None:
        return None
    low, high, frac = min(stat[0], cap), min(stat[1], cap), stat[2]
    return low + frac * (high - low) if frac else low


def exact_quantiles_multi(df: DataFrame, spec: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Linear-interpolated exact quantiles of several numeric columns."""
    return {c: [interpolate(s) for s in stats] for c, stats in order_statistics(df, spec).items()}


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Linear-interpolated exact quantiles of one numeric column."""
    return exact_quantiles_multi(df, {col: list(probs)})[col]


def grouped_exact_quantiles(df: DataFrame, group_col: str, col: str, probs: dict[str, float]) -> DataFrame:
    """(group_col, one column per entry of ``probs``): exact quantiles per group value, any number of groups."""
    v = F.col(col).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(F.col(group_col), v.alias("_V")).agg(F.count(F.lit(1)).alias("_C"))
    ranked = value_ranks(counts, group_col, "_V", "_C")
    checkpoint_dir(df.sparkSession)
    ranked = ranked.checkpoint(eager=True)
    sizes = ranked.groupBy(F.col(group_col).alias("_G")).agg(F.sum("_C").alias("_N"))
    both = ranked.join(sizes, F.col(group_col).eqNullSafe(F.col("_G")))
    aggs, result = [], []
    for i, (name, p) in enumerate(probs.items()):
        pos = F.lit(p) * (F.col("_N") - 1)
        low = F.floor(pos)
        high = F.least(low + 1, F.col("_N") - 1)
        for side, rank in (("a", low), ("b", high)):
            held = (F.col("_BEFORE") <= rank) & (rank < F.col("_BEFORE") + F.col("_C"))
            aggs.append(F.max(F.when(held, F.col("_V"))).alias(f"_{side}{i}"))
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        frac = F.lit(p) * (F.col("_N") - 1) - F.floor(F.lit(p) * (F.col("_N") - 1))
        result.append(F.when(frac != 0, a + frac * (b - a)).otherwise(a).alias(name))
    return both.groupBy(group_col, "_N").agg(*aggs).select(group_col, *result)
