"""Snapshot-month helpers: month from a file name, labels, month roles."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH_COL = "SNAP_MONTH"
FALLBACK_MONTH = dt.date(1900, 1, 1)
_MON = "(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"


def _month_in(name: Column) -> Column:
    """The month that an upper-case name tells, or null."""
    mon_a = F.regexp_extract(name, _MON + r"_?(\d{4})", 1)
    yr_a = F.regexp_extract(name, _MON + r"_?(\d{4})", 2)
    mon_b = F.regexp_extract(name, r"(\d{4})_?" + _MON, 2)
    yr_b = F.regexp_extract(name, r"(\d{4})_?" + _MON, 1)
    mon = F.when(mon_a != "", mon_a).otherwise(mon_b)
    yr = F.when(mon_a != "", yr_a).otherwise(yr_b)
    parsed = F.try_to_timestamp(F.concat(yr, F.lit("-"), F.initcap(mon)), F.lit("yyyy-MMM")).cast("date")
    return F.when(mon != "", parsed)


def month_from_path(path_col, folders: bool = False) -> Column:
    """``..._JUL_2025.csv`` / ``JUL2025.csv`` / ``2025_JUL.csv`` -> first day of that month;
    unmatched names -> 1900-01-01 (they sort first).  With ``folders`` a file whose own name tells no
    month has that of its folder."""
    p = F.upper(F.col(path_col) if isinstance(path_col, str) else path_col)
    parts = F.split(p, "/")
    months = [_month_in(F.element_at(parts, -1))]
    if folders:
        months.append(_month_in(F.try_element_at(parts, F.lit(-2))))
    return F.coalesce(*months, F.lit(FALLBACK_MONTH))


def month_of_name(path: str, folders: bool = False) -> dt.date:
    """The month that a path tells, as ``month_from_path``, for a path at the driver."""
    for name in path.upper().split("/")[-1:-3 if folders else -2:-1]:
        found = re.search(_MON + r"_?(?P<y>\d{4})", name) or re.search(r"(?P<y>\d{4})_?" + _MON, name)
        if found:
            return dt.datetime.strptime(found["y"] + next(g for g in found.groups() if g != found["y"]).title(), "%Y%b").date()
    return FALLBACK_MONTH


def label_of_name(path: str) -> str:
    """``2025-JUL``, or the stem of a file name that tells no month."""
    month = month_of_name(path)
    return label_of(month) if month != FALLBACK_MONTH else path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def month_label(c) -> Column:
    """Date -> ``2025-JUL``."""
    d = F.col(c) if isinstance(c, str) else c
    return F.upper(F.date_format(d, "yyyy-MMM"))


class NamedDay(dt.date):
    """A snapshot day with a label of its own, for files whose name tells no month."""

    label: str


def named(months: list[dt.date], labels: dict[dt.date, str]) -> list[dt.date]:
    """``months`` with the given labels."""
    out = []
    for m in months:
        if m in labels:
            m = NamedDay(m.year, m.month, m.day)
            m.label = labels[m]
        out.append(m)
    return out


def label_of(d: dt.date) -> str:
    return d.label if isinstance(d, NamedDay) else d.strftime("%Y-%b").upper()


def snapshot_months(df: DataFrame, month_col: str = MONTH_COL, at_least: int = 1) -> list[dt.date]:
    """Sorted distinct snapshot months.

    The result is bounded by the number of monthly snapshots (a few hundred at
    most), so it is safe to bring to the driver; it lets later filters compare
    against literals, which prunes month partitions at the scan.
    """
    months = sorted(r[0] for r in df.select(month_col).distinct().collect() if r[0] is not None)
    if len(months) < at_least:
        raise ValueError(f"need at least {at_least} snapshot months, found {len(months)}")
    return months


def rank_expr(months: list[dt.date], month_col: str = MONTH_COL) -> Column:
    """Month rank (1 = oldest) as a literal CASE expression, no join needed."""
    expr = None
    for i, m in enumerate(months):
        cond = F.col(month_col) == F.lit(m)
        expr = F.when(cond, F.lit(i + 1)) if expr is None else expr.when(cond, F.lit(i + 1))
    return expr
