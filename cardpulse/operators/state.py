"""Monthly labels from a state that months merge into.

The state has one row per id and era of ``WORD`` calendar months with one bit per month in
each of a few masks.  All masks are built and merged by ``bit_or``, which is associative,
commutative and idempotent: months may come in any order, in parts, or twice.  A run for a new
month reads that month and the state, never the earlier snapshots.

Masks (a bit is set if in that month some row of the id ...):
  PRESENT  ... exists                     FLAGGED   ... exists, and the month's file carries ACTIVATED
  ANY_A    ... is activated               STATUSED  ... exists, and the month's file carries STATUS
  ANY_USED ... is not inactive            ANY_LIVE  ... has no churn status
"All rows of the month are inactive" is PRESENT without ANY_USED.  A row with a null id holds the
months that the state has seen; rows without an id are no customer and set nothing else.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.functions import contract
from cardpulse.functions.monthmask import WORD, below, empty, has, mask_of
from cardpulse.functions.months import MONTH_COL
from cardpulse.operators import churn

MASKS = ["PRESENT", "FLAGGED", "STATUSED", "ANY_A", "ANY_USED", "ANY_LIVE"]


def _number(day: dt.date) -> int:
    return day.year * 12 + day.month - 1


def month_state(rows: DataFrame, id_col: str = "RIMNO", flag_col: str = "ACTIVATED", status_col: str = "STATUS",
                churn_codes: Iterable[str] | None = None, absent: dict[dt.date, set[str]] | None = None) -> DataFrame:
    """The state (id, ERA, masks) of the snapshot rows of one or more months: one partial aggregate.

    Columns that ``rows`` lacks altogether, and those that ``absent`` names for a month, are not carried."""
    m = F.col(MONTH_COL)
    number = F.year(m) * 12 + F.month(m) - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(WORD)))

    def carried(col: str) -> Column:
        cut = [day for day, gone in (absent or {}).items() if col in gone]
        return F.lit(False) if col not in rows.columns else ~m.isin(cut) if cut else F.lit(True)

    def coded(col: str, values: Iterable[str]) -> Column:
        return F.coalesce(F.col(col).isin(list(values)), F.lit(False)) if col in rows.columns else F.lit(False)

    some = F.col(id_col).isNotNull()
    tests = {"PRESENT": F.lit(True), "FLAGGED": some & carried(flag_col), "STATUSED": some & carried(status_col),
             "ANY_A": some & coded(flag_col, [contract.ACTIVE_VALUE]),
             "ANY_USED": some & ~coded(flag_col, contract.INACTIVE_VALUES),
             "ANY_LIVE": some & ~coded(status_col, churn_codes or contract.CHURN_STATUSES)}
    dated = rows.where(m.isNotNull())
    own = dated.select(id_col, F.floor(number / WORD).cast("int").alias("ERA"), m,
                       *[F.when(test, bit).otherwise(F.lit(0).cast("long")).alias(c) for c, test in tests.items()])
    known = own.groupBy("ERA").agg(F.bit_or("PRESENT").alias("PRESENT"))   # a row per era: the months themselves
    known = known.select(F.lit(None).cast(rows.schema[id_col].dataType).alias(id_col), "ERA", "PRESENT",
                         *[F.lit(0).cast("long").alias(c) for c in MASKS[1:]])
    return merge(own.where(some).select(id_col, "ERA", *MASKS), known, id_col=id_col)


def merge(*states: DataFrame, id_col: str = "RIMNO") -> DataFrame:
    """States as one: bits OR-ed per id and era."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(id_col, "ERA").agg(*[F.bit_or(c).alias(c) for c in MASKS])


def advance(spark: SparkSession, new_rows: DataFrame, old_path: str | None, new_path: str, id_col: str = "RIMNO", **options) -> DataFrame:
    """Merge the snapshot rows of a month into the state at ``old_path`` (None: none yet), write the state
    at ``new_path`` and return it.  The old state stays, so a failed run is repeated from it."""
    state = month_state(new_rows, id_col, **options)
    if old_path is not None:
        state = merge(spark.read.parquet(old_path), state, id_col=id_col)
    state.write.mode("overwrite").parquet(new_path)
    return spark.read.schema(state.schema).parquet(new_path)


def state_months(state: DataFrame, id_col: str = "RIMNO") -> list[dt.date]:
    """The snapshot months that the state has seen, rising (one row per era at the driver)."""
    out = []
    for r in state.where(F.col(id_col).isNull()).select("ERA", "PRESENT").collect():
        out += [r["ERA"] * WORD + b for b in range(WORD) if r["PRESENT"] >> b & 1]
    return [dt.date(n // 12, n % 12 + 1, 1) for n in sorted(out)]


def ranked(state: DataFrame, months: list[dt.date], id_col: str = "RIMNO", masks: Iterable[str] = tuple(MASKS)) -> DataFrame:
    """(id, masks) with calendar bits replaced by the ranks of the snapshot ``months``."""
    known = state.where(F.col(id_col).isNotNull())
    at = F.lit(None).cast("int")
    place = F.lit(None).cast("int")
    for i, day in enumerate(months):
        here = F.col("_RANK") == i + 1
        at, place = F.when(here, _number(day) // WORD).otherwise(at), F.when(here, _number(day) % WORD).otherwise(place)
    spread = known.withColumn("_RANK", F.explode(F.sequence(F.lit(1), F.lit(len(months))))).where(F.col("ERA") == at)
    rank, n = F.col("_RANK"), len(months)
    return spread.groupBy(id_col).agg(*[mask_of(rank, n, F.getbit(F.col(c), place) == 1).alias(c) for c in masks])


def activation_labels(state: DataFrame, months: list[dt.date] | None = None, id_col: str = "RIMNO") -> DataFrame:
    """One row per id with the ACTIVATED-based class, equal to ``churn.activation_flags`` over all snapshots."""
    months = months or state_months(state, id_col)
    n, c = len(months), F.col
    seen = lambda f: ~empty(below(c(f), n))
    per = ranked(state, months, id_col, ["PRESENT", "FLAGGED", "ANY_A", "ANY_USED"])
    # a history month whose file lacks the flag is skipped whole
    flags = per.select(id_col, seen("FLAGGED").alias("IN_HIST"), has(c("PRESENT"), n).alias("IN_LATEST"),
                       seen("ANY_A").alias("EVER_A"), (~has(c("ANY_USED"), n)).alias("LATEST_ALL_INACTIVE"),
                       (has(c("FLAGGED"), n - 1) & ~has(c("ANY_USED"), n - 1)).alias("PREV_ALL_INACTIVE"))
    return churn.activation_classes(flags.where(c("IN_HIST") | c("IN_LATEST")))


def status_labels(state: DataFrame, months: list[dt.date] | None = None, id_col: str = "RIMNO") -> DataFrame:
    """One row per id with the STATUS-based class, equal to ``churn.status_flags`` over all snapshots."""
    months = months or state_months(state, id_col)
    n, c = len(months), F.col
    per = ranked(state, months, id_col, ["PRESENT", "STATUSED", "ANY_LIVE"])
    told = F.zip_with(c("STATUSED"), c("ANY_LIVE"), lambda a, b: a.bitwiseAND(b))
    flags = per.withColumn("_TOLD", told).select(
        id_col, (~empty(below(c("PRESENT"), n))).alias("IN_HIST"), has(c("PRESENT"), n).alias("IN_LATEST"),
        (~empty(below(c("_TOLD"), n))).alias("EVER_ACTIVE"), (has(c("_TOLD"), n - 1) | has(c("_TOLD"), n - 2)).alias("RECENT_ACTIVE"),
        (has(c("PRESENT"), n) & ~has(c("ANY_LIVE"), n)).alias("LATEST_ALL_CHURNED"))
    return churn.status_classes(flags)


def activation_lifecycle(latest: DataFrame, state: DataFrame, id_col: str = "RIMNO") -> DataFrame:
    """The rows of the latest month with their class, and stubs, from that month and the state."""
    return churn.attach_labels(latest, activation_labels(state, id_col=id_col), id_col, "ACTIVATION_CHURN",
                               "ACTIVATION_CHURN_TYPE", "still_active")


def status_lifecycle(latest: DataFrame, state: DataFrame, id_col: str = "RIMNO") -> DataFrame:
    return churn.attach_labels(latest, status_labels(state, id_col=id_col), id_col, "CHURN", "CHURN_TYPE", "not_churned")


def churn_lookback(state: DataFrame, window: int = 1, id_col: str = "CUSTOMER_ID", months: list[dt.date] | None = None) -> DataFrame:
    """Look-back churn of the ids of the state."""
    months = months or state_months(state, id_col)
    masks = ranked(state, months, id_col, ["PRESENT"]).withColumnRenamed("PRESENT", "MASK")
    return churn.lookback_labels(masks, months, window, id_col)


def churn_between(base_rows: DataFrame, state: DataFrame, ref_month: dt.date, id_col: str = "RIMNO",
                  status_col: str = "CARD_STATUS", order_col: str = "ROW_ID") -> DataFrame:
    """The customers of one month (last row per id) with churn 1 where the state does not have them in ``ref_month``."""
    base = base_rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max_by(status_col, order_col).alias(status_col))
    n = _number(ref_month)
    there = (state.where(F.col(id_col).isNotNull() & (F.col("ERA") == n // WORD) & (F.getbit(F.col("PRESENT"), F.lit(n % WORD)) == 1))
             .select(id_col, F.lit(True).alias("_IN_REF")))
    return base.join(there, id_col, "left").select(id_col, status_col, F.when(F.col("_IN_REF"), 0).otherwise(1).alias("churn"))
