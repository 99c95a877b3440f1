"""Data-quality frames: cast report, missing-value profile, categorical domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardpulse.functions import contract, norm

_CASTERS = {
    "string": lambda c: F.col(c).cast("string"),
    "float": lambda c: norm.try_double(c),
    "int": lambda c: norm.try_long(c),
    "date": lambda c: F.coalesce(norm.parse_date(c), norm.parse_timestamp(c).cast("date")),
}


def _cast(df: DataFrame, kind: str, c: str):
    """The cast of a column to ``kind``; numbers and dates that already are such are not read from their texts again."""
    have = df.schema[c].dataType
    if kind == "date" and isinstance(have, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(c).cast("date")
    if kind == "float" and isinstance(have, T.NumericType):
        x = F.col(c).cast("double")
        return F.when(F.abs(x) < F.lit(float("inf")), x)
    if kind == "int" and isinstance(have, T.IntegralType):
        return F.col(c).cast("bigint")
    return _CASTERS[kind](c)


def cast_and_report(df: DataFrame, plan: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Apply the typed contract (columns absent from ``df`` are skipped) and report, per
    column, nulls before and after the cast and the share missing afterwards.
    One aggregate computes all counters."""
    present = [(t, c) for t, cols in plan.items() for c in cols if c in df.columns]
    casts = {c: _cast(df, t, c) for t, c in present}
    casted = df.withColumns(casts)
    cols = []
    for i, (t, c) in enumerate(present):
        cols.append(F.count_if(F.col(c).isNull()).alias(f"b{i}"))
        cols.append(F.count_if(casts[c].isNull()).alias(f"a{i}"))
    agg = df.agg(F.count(F.lit(1)).alias("_N"), *cols)
    rows = F.array(*[F.struct(F.lit(c).alias("COLUMN_NAME"), F.lit(t).alias("CAST_TYPE"),
                              F.col(f"b{i}").alias("NULLS_BEFORE"), F.col(f"a{i}").alias("NULLS_AFTER"),
                              F.round(F.try_divide(F.col(f"a{i}") * 100.0, F.col("_N")), 2).alias("PCT_MISSING"))
                     for i, (t, c) in enumerate(present)])
    report = agg.select(F.explode(rows).alias("_R")).select("_R.*")
    return casted, report


def date_format_votes(df: DataFrame, columns: list[str], candidates: list[str] = contract.DATE_FORMATS) -> DataFrame:
    """What each candidate format takes of the texts of each date column, from one aggregate.

    (COLUMN_NAME, FORMAT, N_TEXT, N_ACCEPTED, N_REJECTED, IS_WINNER, N_AMBIGUOUS): the winner of a column is
    the format that accepts most texts, the earlier candidate of equals; N_AMBIGUOUS are the texts
    that the format accepts and another candidate reads as a different day (such as 03/04/2025).  Blank
    texts do not vote.  The winner holds for the whole column, so one text never has two readings."""
    if not columns:
        return df.sparkSession.createDataFrame([], "COLUMN_NAME string, FORMAT string, N_TEXT long, N_ACCEPTED long, N_REJECTED long, "
                                                   "IS_WINNER boolean, N_AMBIGUOUS long")
    texts, days = {}, {}
    for i, c in enumerate(columns):
        x = norm.strip(F.col(c).cast("string"))
        texts[f"_t{i}"] = F.when(x != "", x)
        days |= {f"_d{i}_{j}": norm.read_as(F.col(f"_t{i}"), f).cast("date") for j, f in enumerate(candidates)}
    read = df.select(*[e.alias(n) for n, e in texts.items()]).withColumns(days)
    aggs = []
    for i in range(len(columns)):
        aggs.append(F.count(f"_t{i}").alias(f"n{i}"))
        for j in range(len(candidates)):
            mine = F.col(f"_d{i}_{j}")
            other = F.lit(False)
            for k in range(len(candidates)):
                other = other | F.coalesce(F.col(f"_d{i}_{k}") != mine, F.lit(False)) if k != j else other
            aggs += [F.count(mine).alias(f"a{i}_{j}"), F.count_if(mine.isNotNull() & other).alias(f"m{i}_{j}")]
    rows = F.array(*[F.struct(F.lit(c).alias("COLUMN_NAME"), F.lit(j).alias("_J"), F.lit(f).alias("FORMAT"), F.col(f"n{i}").alias("N_TEXT"),
                              F.col(f"a{i}_{j}").alias("N_ACCEPTED"), F.col(f"m{i}_{j}").alias("N_AMBIGUOUS"),
                              F.greatest(*[F.col(f"a{i}_{k}") for k in range(len(candidates))], F.lit(0)).alias("_BEST"),
                              F.array(*[F.col(f"a{i}_{k}") for k in range(len(candidates))]).alias("_ALL"))
                     for i, c in enumerate(columns) for j, f in enumerate(candidates)])
    return df_rows(read.agg(*aggs), rows).select(
        "COLUMN_NAME", "FORMAT", "N_TEXT", "N_ACCEPTED", (F.col("N_TEXT") - F.col("N_ACCEPTED")).alias("N_REJECTED"),
        (F.array_position("_ALL", F.col("_BEST")) == F.col("_J") + 1).alias("IS_WINNER"), "N_AMBIGUOUS")


def df_rows(one: DataFrame, rows) -> DataFrame:
    """The structs of the array ``rows`` over a one-row frame, as rows."""
    return one.select(F.explode(rows).alias("_R")).select("_R.*")


def missing_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """Share of nulls per column (only columns with some), with a severity band."""
    out = None
    for name, df in frames.items():
        agg = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns)])
        rows = F.array(*[F.struct(F.lit(name).alias("TABLE_NAME"), F.lit(c).alias("COLUMN_NAME"),
                                  F.col(f"m{i}").alias("MISSING_FRAC")) for i, c in enumerate(df.columns)])
        part = agg.select(F.explode(rows).alias("_R")).select("_R.*")
        out = part if out is None else out.unionByName(part)
    sev = (F.when(F.col("MISSING_FRAC") > contract.MISSING_RED, "red")
           .when(F.col("MISSING_FRAC") > contract.MISSING_ORANGE, "orange").otherwise("green"))
    return (out.where(F.col("MISSING_FRAC") > 0)
            .select("TABLE_NAME", "COLUMN_NAME", F.round("MISSING_FRAC", 6).alias("MISSING_FRAC"), sev.alias("SEVERITY")))


def categorical_domain(frames: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Distinct values (null included) and their counts per categorical column."""
    out = None
    for name, (df, cols) in frames.items():
        cols = [c for c in cols if c in df.columns]
        kv = F.explode(F.array(*[F.struct(F.lit(c).alias("COLUMN_NAME"), F.col(c).cast("string").alias("VALUE"))
                                 for c in cols])).alias("_KV")
        part = (df.select(kv).select("_KV.*").groupBy("COLUMN_NAME", "VALUE").agg(F.count(F.lit(1)).alias("N"))
                .withColumn("TABLE_NAME", F.lit(name)))
        out = part if out is None else out.unionByName(part)
    return out.select("TABLE_NAME", "COLUMN_NAME", "VALUE", "N")
