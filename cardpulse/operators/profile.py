"""Profiling frames behind the studied figures: top-k counts, histograms with a
density curve, box-plot statistics, correlations, monthly trend, MCC spend."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardpulse.functions import contract
from cardpulse.functions.blocks import ordered_sums
from cardpulse.functions.stats import exact_quantiles_multi, grouped_exact_quantiles, interpolate, order_statistics
from cardpulse.session import checkpoint_dir


SUMMARY_SIZE = 1024
WIDEST_SUMMARY = 1 << 18


def frequent_items(df: DataFrame, col: str, size: int) -> DataFrame:
    """(VALUE, LOWER, P, ERROR): a frequent-items summary (Misra and Gries) of every task of a scan.

    A task keeps at most ``size`` values with lower bounds of their counts; what it takes off all of them
    to stay within is its ERROR, so a value's count in the task is in [LOWER, LOWER + ERROR], LOWER being 0
    for values that are not kept.  Summaries add up: lower bounds by value, errors over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, error = None, 0
        for batch in batches:
            counts = pc.value_counts(batch.column(0))
            part = pa.table({"VALUE": counts.field(0), "LOWER": counts.field(1)})
            held = part if held is None else pa.concat_tables([held, part]).group_by("VALUE").aggregate([("LOWER", "sum")]) \
                .rename_columns({"LOWER_sum": "LOWER"}).select(["VALUE", "LOWER"])
            if len(held) > size:
                n = held["LOWER"].to_numpy()
                cut = int(np.partition(n, len(n) - size - 1)[len(n) - size - 1])     # the greatest that goes
                error += cut
                held = held.filter(pc.greater(held["LOWER"], cut))
                held = held.set_column(1, "LOWER", pc.subtract(held["LOWER"], cut))
        if held is None:
            return
        pid = TaskContext.get().partitionId()
        held = held.combine_chunks()
        rows = len(held)
        # a row without a value carries the error of a task, whether or not values are left
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array([None], pa.string()), *held["VALUE"].cast(pa.string()).chunks]),
             pa.concat_arrays([pa.array([0], pa.int64()), *held["LOWER"].cast(pa.int64()).chunks]),
             pa.array([pid] * (rows + 1), pa.int32()), pa.array([error] + [0] * rows, pa.int64())], ["VALUE", "LOWER", "P", "ERROR"])

    values = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("VALUE"))
    return values.mapInArrow(run, "VALUE string, LOWER long, P int, ERROR long")


def heavy_hitters(df: DataFrame, col: str, k: int, size: int = SUMMARY_SIZE, report: dict | None = None) -> DataFrame:
    """(VALUE, N) of the ``k`` most frequent non-null values, exact, ties broken by value.

    One scan gives summaries of the tasks.  With E the sum of their errors and L the k-th greatest lower bound,
    a value whose lower bound plus E is below L cannot be among the first k, nor tie with them; if E itself is
    below L that holds for all values that no task kept.  Then the values left are counted exactly in a second scan.
    Otherwise the summaries are widened fourfold and taken again; where ``WIDEST_SUMMARY`` values do not decide, or
    cannot be expected to (errors shrink about as summaries widen, and E is that many times L and more: all values are
    about equally rare), all values are counted.  Neither way shuffles the values of a column with many, except the last."""
    text = F.col(col).cast("string").alias("VALUE")
    while size <= WIDEST_SUMMARY:
        marks = _written(frequent_items(df, col, size))
        error = marks.agg(F.coalesce(F.sum("ERROR"), F.lit(0))).first()[0]
        lower = marks.where("VALUE IS NOT NULL").groupBy("VALUE").agg(F.sum("LOWER").alias("LOWER"))
        best = [r["LOWER"] for r in lower.orderBy(F.desc("LOWER")).limit(k).collect()]       # k numbers
        least = best[-1] if len(best) == k else 0
        if error == 0 or error < least:
            if report is not None:
                report.update(size=size, error=error, scans=1 if error == 0 else 2)
            if error == 0:      # nothing was taken off: lower bounds are counts
                return lower.select("VALUE", F.col("LOWER").alias("N")).orderBy(F.desc("N"), F.asc("VALUE")).limit(k)
            left = lower.where(F.col("LOWER") + error >= least).select(F.col("VALUE").alias("_V"))
            # at most (number of rows) / (least - error) values; few, but joined as the planner sees fit
            counts = (df.where(F.col(col).isNotNull()).select(text).join(left, F.col("VALUE") == F.col("_V"), "left_semi")
                      .groupBy("VALUE").agg(F.count(F.lit(1)).alias("N")))
            return counts.orderBy(F.desc("N"), F.asc("VALUE")).limit(k)
        if error >= max(least, 1) * (WIDEST_SUMMARY // size):
            break
        size *= 4
    if report is not None:
        report.update(size=None, error=None, scans=None)
    return _all_counted(df, col, k)


def _written(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _all_counted(df: DataFrame, col: str, k: int) -> DataFrame:
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("VALUE"))
            .agg(F.count(F.lit(1)).alias("N")).orderBy(F.desc("N"), F.asc("VALUE")).limit(k))


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """Most frequent non-null values (ties broken by value): a top-k report."""
    return heavy_hitters(df, col, k)


def demographics(df: DataFrame, cols: list[str], k: int = 8) -> DataFrame:
    """Top-k values per categorical column with share of the shown values and of all
    non-null values of the column: one aggregate over (column, value) pairs, then windows
    over the columns' distinct values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("COLUMN_NAME"), F.col(c).cast("string").alias("VALUE"))
                                for c in cols if c in df.columns])).alias("_P")
    counts = (df.select(pairs).select("_P.*").where(F.col("VALUE").isNotNull())
              .groupBy("COLUMN_NAME", "VALUE").agg(F.count(F.lit(1)).alias("N")))
    col = Window.partitionBy("COLUMN_NAME")
    ranked = (counts.withColumn("_ALL", F.sum("N").over(col))
              .withColumn("_R", F.row_number().over(col.orderBy(F.desc("N"), F.asc("VALUE")))).where(F.col("_R") <= k))
    return ranked.select("COLUMN_NAME", "VALUE", "N",
                         F.round(F.col("N") * 100.0 / F.sum("N").over(col), 4).alias("PCT_OF_SHOWN"),
                         F.round(F.col("N") * 100.0 / F.col("_ALL"), 4).alias("PCT_OF_ALL"))


def foreign_flag(country_col: str = "TRXN_COUNTRY", home: str = contract.HOME_COUNTRY):
    return F.coalesce(F.col(country_col) != F.lit(home), F.lit(False)).cast("int")


def foreign_share(txn: DataFrame) -> DataFrame:
    counts = txn.groupBy(foreign_flag().alias("IS_FOREIGN")).agg(F.count(F.lit(1)).alias("N"))
    total = F.sum("N").over(Window.partitionBy())  # two rows
    return counts.select("IS_FOREIGN", F.when(F.col("IS_FOREIGN") == 1, "Foreign").otherwise("Domestic").alias("LABEL"),
                         "N", F.round(F.col("N") * 100.0 / total, 4).alias("PCT"))


def _trimmed(df: DataFrame, specs):
    """A function from (column, trim quantile, strict) to the column as double, null where it is trimmed."""
    trims = {c: [q] for c, _, q, _ in specs if q is not None}
    caps = {c: v[0] for c, v in exact_quantiles_multi(df, trims).items()} if trims else {}

    def kept(c, q, strict):
        x = F.col(c).cast("double")
        cond = x.isNotNull()
        if q is not None and caps.get(c) is not None:
            cond = cond & ((x < F.lit(caps[c])) if strict else (x <= F.lit(caps[c])))
        return F.when(cond, x)

    return kept


def histograms(df: DataFrame, specs, prefix: str = "") -> DataFrame:
    """Several equal-width histograms of one table with shared passes: one exact
    quantile call for all trims, one aggregate for all bounds, one counting pass
    (explode of (column, bin) pairs).  ``specs``: (column, bins, trim quantile or None,
    strict trim)."""
    spark = df.sparkSession
    specs = [s for s in specs if s[0] in df.columns]
    kept = _trimmed(df, specs)

    bounds = df.agg(*[agg(kept(c, q, st)).alias(f"{k}{i}") for i, (c, _, q, st) in enumerate(specs)
                      for k, agg in (("lo", F.min), ("hi", F.max))]).first()
    live, bins_of = [], {}
    for i, (c, bins, q, st) in enumerate(specs):
        lo, hi = bounds[f"lo{i}"], bounds[f"hi{i}"]
        if lo is None:
            continue
        x = kept(c, q, st)
        w = F.lit(hi) - F.lit(lo)
        idx = F.when(w > 0, F.least(F.floor((x - F.lit(lo)) * F.lit(float(bins)) / w), F.lit(bins - 1))) \
            .otherwise(F.lit(0)).cast("int")
        live.append(F.struct(F.lit(f"{prefix}{c}").alias("COLUMN_NAME"), F.when(x.isNotNull(), idx).alias("BIN")))
        bins_of[f"{prefix}{c}"] = (bins, lo, hi)
    if not live:
        return spark.createDataFrame([], "COLUMN_NAME string, BIN int, BIN_LO double, BIN_HI double, N bigint")
    counts = (df.select(F.explode(F.array(*live)).alias("_B")).select("_B.*").where(F.col("BIN").isNotNull())
              .groupBy("COLUMN_NAME", "BIN").agg(F.count(F.lit(1)).alias("N")))
    spine_rows = [(name, b, float(lo), float(hi), float(bins)) for name, (bins, lo, hi) in bins_of.items()
                  for b in range(bins)]
    spine = spark.createDataFrame(spine_rows, "COLUMN_NAME string, BIN int, _LO double, _HI double, _NB double")
    edge = lambda i: F.col("_LO") + i * (F.col("_HI") - F.col("_LO")) / F.col("_NB")
    return (F.broadcast(spine).join(counts, ["COLUMN_NAME", "BIN"], "left")  # spine: bins of a few columns
            .select("COLUMN_NAME", "BIN", F.round(edge(F.col("BIN")), 6).alias("BIN_LO"),
                    F.round(edge(F.col("BIN") + 1), 6).alias("BIN_HI"),
                    F.coalesce("N", F.lit(0)).cast("bigint").alias("N")))


CELLS_PER_BANDWIDTH = 8
MOMENTS = 8
REACH = 9.0            # bandwidths; the kernel beyond is below 3e-18 of its height


def _hermite(k: int) -> list[int]:
    """Coefficients, lowest power first, of the probabilists' Hermite polynomial of degree k."""
    before, now = [0], [1]
    for n in range(k):
        up = [0, *now]
        before, now = now, [c - n * (before[i] if i < len(before) else 0) for i, c in enumerate(up)]
    return now


def density_error() -> float:
    """Bound of a curve's error in parts of the greatest density that one row alone would have: the first
    term left out of the expansion, |t| <= 1 / (2 cells), times the largest value of its Hermite function."""
    t = 0.5 / CELLS_PER_BANDWIDTH
    u = [i / 100 for i in range(-900, 901)]
    top = max(abs(sum(c * x ** p for p, c in enumerate(_hermite(MOMENTS)))) * math.exp(-x * x / 2) for x in u)
    return 1.1 * t ** MOMENTS / math.factorial(MOMENTS) * top


def density(df: DataFrame, specs, points: int = 200, prefix: str = "") -> DataFrame:
    """Gaussian density curves of the rows themselves on ``points`` values from least to greatest, bandwidth
    by Scott's rule (sample standard deviation times n^(-1/5)).  ``specs`` as in ``histograms``.

    The rows are summed up in cells of 1 / CELLS_PER_BANDWIDTH of a bandwidth by their first MOMENTS
    power sums about the cell's middle, one partial aggregate for all columns; a cell's rows act on a point
    through the Hermite expansion of the kernel, which with these numbers is within ``density_error()`` (below
    1e-12) of the sum over all rows.  Linear binning is the same with two moments.  Cells reach
    only the points within REACH bandwidths.  A column with fewer than two rows or without spread has no curve.
    """
    spark = df.sparkSession
    specs = [s for s in specs if s[0] in df.columns]
    kept = _trimmed(df, specs)
    found = df.agg(*[agg(kept(c, q, st)).alias(f"{k}{i}") for i, (c, _, q, st) in enumerate(specs)
                     for k, agg in (("n", F.count), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))]).first()
    live, curves = [], []
    for i, (c, _, q, st) in enumerate(specs):
        n, std, lo, hi = (found[f"{k}{i}"] for k in ("n", "s", "lo", "hi"))
        if not std:
            continue
        h = std * n ** -0.2
        x, name = kept(c, q, st), f"{prefix}{c}"
        cell = F.floor((x - F.lit(lo)) * F.lit(CELLS_PER_BANDWIDTH / h))
        t = (x - F.lit(lo)) / F.lit(h) - (cell + 0.5) / F.lit(float(CELLS_PER_BANDWIDTH))
        live.append(F.when(x.isNotNull(), F.struct(F.lit(name).alias("COLUMN_NAME"), cell.alias("CELL"), t.alias("T"))))
        curves.append((name, float(n), float(h), float(lo), float(hi)))
    if not live:
        return spark.createDataFrame([], "COLUMN_NAME string, I int, X double, DENSITY double")
    cells = (df.select(F.explode(F.array_compact(F.array(*live))).alias("_C")).select("_C.*").groupBy("COLUMN_NAME", "CELL")
             .agg(*[F.sum(F.pow("T", F.lit(float(k))) if k else F.lit(1.0)).alias(f"M{k}") for k in range(MOMENTS)]))
    spine = spark.createDataFrame(curves, "COLUMN_NAME string, _N double, _H double, _LO double, _HI double")
    middle = (F.col("CELL") + 0.5) / F.lit(float(CELLS_PER_BANDWIDTH))                # in bandwidths from the least value
    step = (F.col("_HI") - F.col("_LO")) / F.lit(points - 1) / F.col("_H")            # as is the points' distance
    first = F.greatest(F.lit(0), F.ceil((middle - REACH) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((middle + REACH) / step)).cast("int")
    near = (cells.join(F.broadcast(spine), "COLUMN_NAME")                           # a row for each of a few columns
            .withColumns({"_FIRST": first, "_LAST": last}).where("_FIRST <= _LAST")
            .withColumn("I", F.explode(F.sequence("_FIRST", "_LAST"))).withColumn("_U", F.col("I") * step - middle))
    terms = []
    for k in range(MOMENTS):
        value = F.lit(0.0)
        for c in reversed(_hermite(k)):
            value = value * F.col("_U") + F.lit(float(c))
        terms.append(F.col(f"M{k}") * value / F.lit(float(math.factorial(k))))
    kernel = F.exp(-0.5 * F.col("_U") * F.col("_U")) * reduce(lambda a, b: a + b, terms)
    sums = near.groupBy("COLUMN_NAME", "I").agg(F.sum(kernel).alias("_SUM"))
    grid = F.broadcast(spine).withColumn("I", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return (grid.join(sums, ["COLUMN_NAME", "I"], "left")
            .select("COLUMN_NAME", "I", (F.col("_LO") + F.col("I") * (F.col("_HI") - F.col("_LO")) / F.lit(points - 1)).alias("X"),
                    (F.coalesce("_SUM", F.lit(0.0)) / (F.col("_N") * F.col("_H") * F.lit(math.sqrt(2 * math.pi)))).alias("DENSITY")))


def box_stats_capped(df: DataFrame, cols: list[str], cap_at: float) -> DataFrame:
    """Box statistics of several columns before and after a cut at the ``cap_at`` quantile (STAGE before /
    after).  Cutting keeps the order, so all quartiles come from the same order statistics; one
    aggregate then gives every whisker and outlier count."""
    stats = order_statistics(df, {c: [0.25, 0.5, 0.75, cap_at] for c in cols})
    aggs, structs = [], []
    for i, (c, stage) in enumerate((c, stage) for c in cols for stage in ("before", "after")):
        cap = interpolate(stats[c][3])
        q1, med, q3 = (interpolate(s, cap if stage == "after" and cap is not None else math.inf) for s in stats[c][:3])
        x = F.col(c) if stage == "before" else F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(cap).cast("double")))
        lo_f, hi_f = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        aggs += [F.count(x).alias(f"n{i}"),
                 F.min(F.when(x >= F.lit(lo_f), x)).alias(f"wl{i}"),
                 F.max(F.when(x <= F.lit(hi_f), x)).alias(f"wh{i}"),
                 F.count_if((x < F.lit(lo_f)) | (x > F.lit(hi_f))).alias(f"o{i}")]
        structs.append(F.struct(
            F.lit(c).alias("COLUMN_NAME"), F.lit(stage).alias("STAGE"), F.col(f"n{i}").alias("N"),
            F.lit(q1).cast("double").alias("Q1"), F.lit(med).cast("double").alias("MEDIAN"), F.lit(q3).cast("double").alias("Q3"),
            F.col(f"wl{i}").alias("WHISKER_LO"), F.col(f"wh{i}").alias("WHISKER_HI"), F.col(f"o{i}").alias("N_OUTLIERS")))
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("_R")).select("_R.*")


def grouped_box_stats(df: DataFrame, group_col: str, col: str) -> DataFrame:
    """Box statistics per group, any number of groups: exact quartiles by rank, then one
    aggregate over the groups' value counts with each group's fences joined on."""
    x = df.where(F.col(col).isNotNull())
    qs = grouped_exact_quantiles(x, group_col, col, {"Q1": 0.25, "MEDIAN": 0.5, "Q3": 0.75}).withColumnRenamed(group_col, "_G")
    counts = x.groupBy(group_col, F.col(col).alias("_X")).agg(F.count(F.lit(1)).alias("_C"))
    lo_f, hi_f = (F.col("Q1") - 1.5 * (F.col("Q3") - F.col("Q1")), F.col("Q3") + 1.5 * (F.col("Q3") - F.col("Q1")))
    v = F.col("_X")
    return (counts.join(qs, F.col(group_col).eqNullSafe(F.col("_G"))).groupBy(group_col, "Q1", "MEDIAN", "Q3")
            .agg(F.sum("_C").alias("N"), F.min(F.when(v >= lo_f, v)).alias("WHISKER_LO"),
                 F.max(F.when(v <= hi_f, v)).alias("WHISKER_HI"),
                 F.sum(F.when((v < lo_f) | (v > hi_f), F.col("_C")).otherwise(0)).alias("N_OUTLIERS"))
            .select(group_col, "N", "Q1", "MEDIAN", "Q3", "WHISKER_LO", "WHISKER_HI", "N_OUTLIERS"))


def gram(df: DataFrame, cols: list[str]) -> np.ndarray:
    """G = W'W over the rows of W = [m, x, x * x], m telling which columns are present and x (0 where absent)
    taken around the columns' means: all pairwise-complete counts, sums, squares and products at once.

    Each task multiplies blocks of rows, so a row costs one matrix product and what is shuffled are
    3d rows of 3d numbers a task, added in the order of the tasks."""
    d = len(cols)
    values = [F.col(c).cast("double") for c in cols]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
    middle = np.array([means[f"m{i}"] or 0.0 for i in range(d)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((3 * d, 3 * d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            null = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.where(null, 0.0, x - middle)
            w = np.hstack([~null, x, x * x]).astype(float)
            total += w.T @ w
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(3 * d), pa.int32()), pa.array([pid] * 3 * d, pa.int32()),
                                          pa.array(total.tolist(), pa.list_(pa.float64()))], ["R", "P", "S"])

    parts = df.select(*[v.alias(f"x{i}") for i, v in enumerate(values)]).mapInArrow(run, "R int, P int, S array<double>")
    out = np.zeros((3 * d, 3 * d))
    for r in ordered_sums(parts, ["R"]).collect():      # 3d rows
        out[r["R"]] = r["S"]
    return out


def correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation, lower triangle, from one Gram matrix; null where a column has
    no spread over the pair's rows or a value is NaN."""
    cols = [c for c in cols if c in df.columns]
    d, g = len(cols), gram(df, cols)
    n, s, q, p = g[:d, :d], g[d:2 * d, :d], g[2 * d:, :d], g[d:2 * d, d:2 * d]      # [i, j]: over rows that have i and j
    with np.errstate(invalid="ignore", divide="ignore"):
        cross = p - s * s.T / n
        spread = q - s * s / n
        r = cross / np.sqrt(spread * spread.T)
    flat = spread <= 1e-12 * np.maximum(q, np.finfo(float).tiny)
    rows = [(cols[i], cols[j], None if flat[i, j] or flat[j, i] or not np.isfinite(r[i, j]) else round(float(r[i, j]), 6))
            for i in range(d) for j in range(i)]
    return df.sparkSession.createDataFrame(rows, "COL_A string, COL_B string, CORR double")


def monthly_trend(txn: DataFrame, start: str, end: str, date_col: str = "TRXN_DATE",
                  amount_col: str = "BILLING_AMT") -> DataFrame:
    """Monthly count and sum of the amount within [start, end]; months without rows
    inside the covered span appear with 0 (calendar spine)."""
    t = F.col(date_col)
    rows = txn.where((t >= F.lit(start).cast("timestamp_ntz")) & (t <= F.lit(end).cast("timestamp_ntz")))
    monthly = rows.groupBy(F.trunc(t.cast("date"), "month").alias("_M")).agg(
        F.count(amount_col).alias("TXN_COUNT"), F.sum(amount_col).alias("TOTAL_SPEND"))
    spine = monthly.agg(F.min("_M").alias("_A"), F.max("_M").alias("_B")) \
        .select(F.explode(F.sequence("_A", "_B", F.expr("interval 1 month"))).alias("_M"))
    return (spine.join(monthly, "_M", "left")
            .select(F.last_day("_M").alias("MONTH_END"),
                    F.coalesce("TXN_COUNT", F.lit(0)).cast("bigint").alias("TXN_COUNT"),
                    F.round(F.coalesce("TOTAL_SPEND", F.lit(0.0)), 2).alias("TOTAL_SPEND")))


def mcc_top_spend(txn: DataFrame, k: int = 15, amount_col: str = "BILLING_AMT") -> DataFrame:
    """Top-k merchant categories by total amount, named from the fixed code table."""
    spark = txn.sparkSession
    dim = spark.createDataFrame(sorted(contract.MCC_NAMES.items()), "MCC bigint, MCC_NAME string")
    top = (txn.where(F.col("MCC").isNotNull()).groupBy(F.col("MCC").cast("bigint").alias("MCC"))
           .agg(F.sum(amount_col).alias("TOTAL_SPEND"))
           .orderBy(F.desc("TOTAL_SPEND"), F.asc("MCC")).limit(k))
    return (top.join(F.broadcast(dim), "MCC", "left")  # fixed 16-row code table
            .select("MCC", F.coalesce("MCC_NAME", F.col("MCC").cast("string")).alias("MCC_NAME"),
                    F.round("TOTAL_SPEND", 2).alias("TOTAL_SPEND")))
