"""Months as bits: one mask per id instead of one row per id and month.

A mask is an array of 64-bit words of ``WORD`` months each, so that any number of months fits;
rank 1 is the lowest bit of the first word.  Masks are built with ``bit_or`` in one partial
aggregate, and "in the month", "new", "gone" and "last seen" are bit operations on them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardpulse.functions.months import MONTH_COL, rank_expr

WORD = 62


def _rank(rank: Column | int) -> Column:
    return F.lit(rank) if isinstance(rank, int) else rank


def mask_of(rank: Column, n_months: int, when: Column | None = None) -> Column:
    """Aggregate: the mask of the ranks of the rows (where ``when`` holds), bits OR-ed."""
    words = []
    for w in range(-(-n_months // WORD)):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (rank - 1 - w * WORD).cast("int"))
        here = (rank > w * WORD) & (rank <= (w + 1) * WORD)
        words.append(F.coalesce(F.bit_or(F.when(here if when is None else here & when, bit)), F.lit(0).cast("long")))
    return F.array(*words)


def has(mask: Column, rank: Column | int) -> Column:
    """Whether the month of ``rank`` is in the mask; false for ranks outside."""
    at = _rank(rank) - 1
    word = F.get(mask, F.floor(at / WORD).cast("int"))
    return F.coalesce(F.getbit(word, F.pmod(at, F.lit(WORD)).cast("int")) == 1, F.lit(False))


def below(mask: Column, rank: int) -> Column:
    """The mask with only the months before ``rank``."""
    def part(word: Column, i: Column) -> Column:
        left = F.lit(rank - 1) - i * WORD
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.greatest(left, F.lit(0)), F.lit(WORD)).cast("int")) - 1
        return word.bitwiseAND(low)
    return F.transform(mask, part)


def last_rank(mask: Column) -> Column:
    """Rank of the latest month in the mask; null if it is empty."""
    ranks = F.transform(mask, lambda word, i: F.when(word != 0, i * WORD + F.length(F.bin(word))))
    return F.array_max(ranks)


def empty(mask: Column) -> Column:
    return F.forall(mask, lambda word: word == 0)


def ranks_of(mask: Column, n_months: int) -> Column:
    """The ranks in the mask, rising, as an array."""
    return F.filter(F.sequence(F.lit(1), F.lit(n_months)), lambda r: has(mask, r))


def presence_masks(df: DataFrame, months: list[dt.date], id_col: str, month_col: str = MONTH_COL) -> DataFrame:
    """(id, MASK) of the months in which each id has a row: one scan, one partial aggregate."""
    return (df.where(F.col(id_col).isNotNull() & F.col(month_col).isNotNull()).groupBy(id_col)
            .agg(mask_of(rank_expr(months, month_col), len(months)).alias("MASK")))


def patterns(masks: DataFrame) -> DataFrame:
    """(MASK, N_IDS): ids with the same months are one row, so that counts need no id any more."""
    return masks.groupBy("MASK").agg(F.count(F.lit(1)).alias("N_IDS"))
