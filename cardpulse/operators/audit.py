"""Month-to-month audits: id presence, column change log and change rates, common ids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardpulse.functions.monthmask import has, mask_of, patterns, presence_masks, ranks_of
from cardpulse.functions.months import rank_expr, snapshot_months
from cardpulse.session import checkpoint_dir

HOT_ROWS = 256      # an id with more rows is paired by value counts, or by a join that splits skewed partitions


def _rank_label(months: list[dt.date], rank_col):
    from cardpulse.functions.months import label_of
    expr = None
    for i, m in enumerate(months):
        cond = rank_col == F.lit(i + 1)
        expr = F.when(cond, F.lit(label_of(m))) if expr is None else expr.when(cond, F.lit(label_of(m)))
    return expr


def _new(r):
    """In the month of rank ``r`` but not in the one before."""
    return has(F.col("MASK"), r) & ~has(F.col("MASK"), r - 1)


def _gone(r):
    """In the month before rank ``r`` but not in it."""
    return has(F.col("MASK"), r - 1) & ~has(F.col("MASK"), r)


def month_new_missing(prime: DataFrame, id_col: str = "RIMNO", months: list[dt.date] | None = None) -> DataFrame:
    """Per consecutive-snapshot transition: previous/current distinct ids, new ids, missing ids.

    One partial aggregate makes a mask of months per id, a second one counts the ids of
    each mask; transitions are bit tests on the few masks there are."""
    months = months or snapshot_months(prime, at_least=2)
    r, n = F.col("TO_RANK"), F.col("N_IDS")
    per = (patterns(presence_masks(prime, months, id_col))
           .withColumn("TO_RANK", F.explode(F.sequence(F.lit(2), F.lit(len(months)))))
           .groupBy("TO_RANK").agg(*[F.sum(F.when(cond, n)).alias(c) for c, cond in (
               ("N_PREV", has(F.col("MASK"), r - 1)), ("N_CURR", has(F.col("MASK"), r)), ("N_NEW", _new(r)), ("N_MISSING", _gone(r)))]))
    spine = prime.sparkSession.createDataFrame([(i,) for i in range(2, len(months) + 1)], "TO_RANK int")
    return spine.join(per, "TO_RANK", "left").select(
        _rank_label(months, F.col("TO_RANK") - 1).alias("FROM_MONTH"),
        _rank_label(months, F.col("TO_RANK")).alias("TO_MONTH"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("N_PREV", "N_CURR", "N_NEW", "N_MISSING")])


def _reappearances(masks: DataFrame, n_months: int) -> DataFrame:
    """``masks`` once for each (TO_RANK, IN_RANK): gone at TO_RANK, seen in IN_RANK, another month than both."""
    gone = masks.withColumn("TO_RANK", F.explode(F.sequence(F.lit(2), F.lit(n_months)))).where(_gone(F.col("TO_RANK")))
    return (gone.withColumn("IN_RANK", F.explode(ranks_of(F.col("MASK"), n_months)))
            .where(F.col("IN_RANK") != F.col("TO_RANK") - 1))


def missing_reappearance(prime: DataFrame, id_col: str = "RIMNO", months: list[dt.date] | None = None) -> DataFrame:
    """For ids missing at a transition (in month i-1, not in month i): in which other
    months (not i-1, not i) they exist, with counts; empty combinations omitted."""
    months = months or snapshot_months(prime, at_least=2)
    hits = (_reappearances(patterns(presence_masks(prime, months, id_col)), len(months))
            .groupBy("TO_RANK", "IN_RANK").agg(F.sum("N_IDS").alias("N_IDS")))
    return hits.select(_rank_label(months, F.col("TO_RANK") - 1).alias("FROM_MONTH"),
                       _rank_label(months, F.col("TO_RANK")).alias("TO_MONTH"),
                       _rank_label(months, F.col("IN_RANK")).alias("IN_MONTH"),
                       F.col("N_IDS").cast("bigint"))


def presence_changes(prime: DataFrame, id_col: str = "RIMNO", months: list[dt.date] | None = None) -> DataFrame:
    """The ids behind the presence audit: (FROM_MONTH, TO_MONTH, CHANGE, id) with CHANGE 'new' (not in
    the month before) or 'missing' (not in the month after)."""
    months = months or snapshot_months(prime, at_least=2)
    at = (presence_masks(prime, months, id_col).withColumn("TO_RANK", F.explode(F.sequence(F.lit(2), F.lit(len(months)))))
          .withColumn("CHANGE", F.when(_new(F.col("TO_RANK")), "new").when(_gone(F.col("TO_RANK")), "missing")).where("CHANGE IS NOT NULL"))
    return at.select(_rank_label(months, F.col("TO_RANK") - 1).alias("FROM_MONTH"), _rank_label(months, F.col("TO_RANK")).alias("TO_MONTH"),
                     "CHANGE", id_col)


def reappearing_ids(prime: DataFrame, id_col: str = "RIMNO", months: list[dt.date] | None = None) -> DataFrame:
    """(FROM_MONTH, TO_MONTH, IN_MONTH, id) of the ids that ``missing_reappearance`` counts."""
    months = months or snapshot_months(prime, at_least=2)
    return _reappearances(presence_masks(prime, months, id_col), len(months)).select(
        _rank_label(months, F.col("TO_RANK") - 1).alias("FROM_MONTH"), _rank_label(months, F.col("TO_RANK")).alias("TO_MONTH"),
        _rank_label(months, F.col("IN_RANK")).alias("IN_MONTH"), id_col)


def presence_matrix(prime: DataFrame, id_col: str = "RIMNO", months: list[dt.date] | None = None) -> DataFrame:
    """Number of ids by (FIRST_MONTH, LAST_MONTH, MONTHS_PRESENT, GAPS): which part of the span between
    an id's first and last snapshot it misses.  Counted on masks, never on ids."""
    months = months or snapshot_months(prime, at_least=1)
    ranks = ranks_of(F.col("MASK"), len(months))
    per = (patterns(presence_masks(prime, months, id_col))
           .select("N_IDS", F.array_min(ranks).alias("_F"), F.array_max(ranks).alias("_L"), F.size(ranks).alias("MONTHS_PRESENT")))
    return (per.groupBy("_F", "_L", "MONTHS_PRESENT").agg(F.sum("N_IDS").alias("N_IDS"))
            .select(_rank_label(months, F.col("_F")).alias("FIRST_MONTH"), _rank_label(months, F.col("_L")).alias("LAST_MONTH"),
                    "MONTHS_PRESENT", (F.col("_L") - F.col("_F") + 1 - F.col("MONTHS_PRESENT")).alias("GAPS"), F.col("N_IDS").cast("bigint")))


def id_sets(tables: list[DataFrame], id_col: str = "RIMNO") -> DataFrame:
    """(id, MASK) over several tables: bit i is set if table i holds the id.  Union, intersection and
    difference of id sets are tests of this one partial aggregate, without joins."""
    tagged = None
    for i, t in enumerate(tables):
        one = t.where(F.col(id_col).isNotNull()).select(id_col, F.lit(i + 1).alias("_T"))
        tagged = one if tagged is None else tagged.union(one)
    return tagged.groupBy(id_col).agg(mask_of(F.col("_T"), len(tables)).alias("MASK"))


def set_report(tables: dict[str, DataFrame], id_col: str = "RIMNO") -> DataFrame:
    """(TABLES, N_IDS): number of ids by the tables that hold them, names joined by '+'."""
    names = list(tables)
    label = F.array_join(F.transform(ranks_of(F.col("MASK"), len(names)), lambda r: F.get(F.array(*map(F.lit, names)), r - 1)), "+")
    return patterns(id_sets(list(tables.values()), id_col)).select(label.alias("TABLES"), F.col("N_IDS").cast("bigint"))


def text_image(df: DataFrame, cols: list[str]) -> DataFrame:
    """Render compared columns as text the way a snapshot file holds them: doubles at a
    fixed 6-digit scale (engine-independent; a value beyond decimal(38,6) in its own shortest
    form), dates ISO, strings unchanged."""
    out = {}
    for c in cols:
        t = df.schema[c].dataType.typeName()
        if t in ("double", "float"):
            out[c] = F.coalesce(F.col(c).try_cast("decimal(38,6)").cast("string"), F.col(c).cast("string"))
        else:
            out[c] = F.col(c).cast("string")
    return df.withColumns(out)


Absent = dict[dt.date, set[str]]


def _compared(col: str, rank, months: list[dt.date], absent: Absent | None):
    """Whether both months of the transition that starts at ``rank`` carry ``col``."""
    cut = [i + 1 for i in range(len(months) - 1)
           if absent and (col in absent.get(months[i], ()) or col in absent.get(months[i + 1], ()))]
    return ~rank.isin(cut) if cut else F.lit(True)


def idless_report(prime: DataFrame, key_cols=("RIMNO", "PRODUCT_NAME"), months: list[dt.date] | None = None) -> DataFrame:
    """Rows without an id, which are no customer and enter no pair: per transition and product their
    number in both months and the number of pairs they would form."""
    months = months or snapshot_months(prime, at_least=2)
    id_col, product = key_cols
    per = (prime.where(F.col(id_col).isNull()).groupBy(product, rank_expr(months).alias("M_RANK"))
           .agg(F.count(F.lit(1)).alias("N")))
    both = (per.select(product, F.col("M_RANK").alias("A_RANK"), F.col("N").alias("N_OLD"), F.lit(0).cast("long").alias("N_NEW"))
            .union(per.select(product, F.col("M_RANK") - 1, F.lit(0).cast("long"), F.col("N"))))
    return (both.where(F.col("A_RANK").between(1, len(months) - 1)).groupBy(product, "A_RANK")
            .agg(F.sum("N_OLD").alias("N_OLD"), F.sum("N_NEW").alias("N_NEW"))
            .select(_rank_label(months, F.col("A_RANK")).alias("FROM_MONTH"), _rank_label(months, F.col("A_RANK") + 1).alias("TO_MONTH"),
                    product, "N_OLD", "N_NEW", (F.col("N_OLD") * F.col("N_NEW")).alias("N_PAIRS")))


def change_log(prime: DataFrame, compare_cols: list[str], key_cols=("RIMNO", "PRODUCT_NAME"),
               months: list[dt.date] | None = None, pairing: str = "counted", order_col: str = "ROW_ID",
               absent: Absent | None = None) -> DataFrame:
    """Every (old, new) value change per card key between consecutive snapshots.  Rows without
    an id are no customer and form no pairs (``idless_report`` counts them); a column that one
    of the two months does not carry (``absent``: month -> columns) is not compared.

    A card key with several rows per month pairs every old row with every new row, as in the
    studied audit.  ``pairing`` tells how the log shows them:

    * ``"counted"``: equal changes are one row with their number N_PAIRS (``change_log_counted``); what a
      key gives is bounded by its distinct values, however many rows it has.
    * ``"all"``: one row for each pair, so the output grows with the product of the row counts.  One self-join
      for all transitions (key + rank_b = rank_a + 1, null-safe product), then one ``explode`` over an array of
      (column, old, new) structs filtered to the changed ones.
    * ``"last"``: the last row (by ``order_col``) per key and month stands for the others, kept by a partial
      ``max_by`` aggregate: at most one pair per key and transition.

    Counts per column: ``change_rates``."""
    if pairing == "counted":
        return change_log_counted(prime, compare_cols, key_cols, months, absent)
    months = months or snapshot_months(prime, at_least=2)
    keys = list(key_cols)
    if pairing == "last":
        img = text_image(prime.where(F.col(keys[0]).isNotNull()), compare_cols).select(
            *keys, rank_expr(months).alias("M_RANK"), *compare_cols, order_col)
        last = F.max_by(F.struct(*compare_cols), F.col(order_col)).alias("_LAST")
        img = img.groupBy(*keys, "M_RANK").agg(last).select(*keys, "M_RANK", "_LAST.*")
        return _changes(_pairs(img, compare_cols, keys), compare_cols, keys, months, absent)
    if pairing != "all":
        raise ValueError("pairing must be 'counted', 'all' or 'last'")
    rows, hot = _by_heat(prime, compare_cols, keys, months)
    out = _changes(_near_pairs(rows, compare_cols, keys), compare_cols, keys, months, absent)
    if hot is not None:
        out = out.union(_changes(_pairs(text_image(hot, compare_cols), compare_cols, keys), compare_cols, keys, months, absent))
    return out


def _by_heat(prime: DataFrame, compare_cols: list[str], keys: list[str], months: list[dt.date]) -> tuple[DataFrame, DataFrame | None]:
    """(keys, M_RANK, compared columns) of the rows with an id and a month: those of ids with at most ``HOT_ROWS``
    rows, and the others (None if there are none)."""
    rows = prime.where(F.col(keys[0]).isNotNull()).select(*keys, rank_expr(months).alias("M_RANK"), *compare_cols).where("M_RANK IS NOT NULL")
    per = rows.groupBy(F.col(keys[0]).alias("_HOT")).agg(F.count(F.lit(1)).alias("_N")).where(F.col("_N") > HOT_ROWS).select("_HOT")
    checkpoint_dir(prime.sparkSession)
    ids = per.checkpoint(eager=True)        # one id in HOT_ROWS rows at most
    if ids.isEmpty():
        return rows, None
    return (rows.join(ids, F.col(keys[0]) == F.col("_HOT"), "left_anti"), rows.join(ids, F.col(keys[0]) == F.col("_HOT"), "left_semi"))


def _sides(img: DataFrame, compare_cols: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    values = F.array(*compare_cols)  # all text: one column through the join, short generated code behind it
    return (img.select(*keys, F.col("M_RANK").alias("_A_RANK"), values.alias("_OLD")),
            img.select(*[F.col(k).alias(f"_B_{k}") for k in keys], F.col("M_RANK").alias("_B_RANK"), values.alias("_NEW")))


def _pairs(img: DataFrame, compare_cols: list[str], keys: list[str]) -> DataFrame:
    """(keys, _A_RANK, _OLD, _NEW): every row of a month with every row of the same key in the next, by one join on all of them."""
    a, b = _sides(img, compare_cols, keys)
    cond = F.col("_B_RANK") == F.col("_A_RANK") + 1
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_B_{k}"))
    return a.join(b, cond, "inner").select(*keys, "_A_RANK", "_OLD", "_NEW")


def _near_pairs(rows: DataFrame, compare_cols: list[str], keys: list[str]) -> DataFrame:
    """As ``_pairs``, for ids of few rows: the typed rows move once, by their id, and are put as text, joined and
    later grouped where they are.  The id alone decides where rows meet; product and month are conditions on rows that met.
    The number of partitions is fixed: merged by the size of their compressed rows they would not fit a task as texts."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = _sides(text_image(rows.repartition(n, keys[0]), compare_cols), compare_cols, keys)
    cond = (F.col(keys[0]) == F.col(f"_B_{keys[0]}")) & (F.col("_B_RANK") - F.col("_A_RANK") == 1)
    for k in keys[1:]:
        x, y = F.col(k), F.col(f"_B_{k}")
        cond = cond & (F.coalesce(x == y, F.lit(False)) | (x.isNull() & y.isNull()))
    return a.hint("merge").join(b, cond, "inner").select(*keys, "_A_RANK", "_OLD", "_NEW")


def _changes(pairs: DataFrame, compare_cols: list[str], keys: list[str], months: list[dt.date], absent: Absent | None) -> DataFrame:
    """One row for each change of a pair."""
    names = F.array(*[F.lit(c) for c in compare_cols])
    changes = F.transform(F.sequence(F.lit(0), F.lit(len(compare_cols) - 1)), lambda i: F.struct(
        F.get(names, i).alias("COLUMN"), F.get(F.col("_OLD"), i).alias("OLD_VALUE"), F.get(F.col("_NEW"), i).alias("NEW_VALUE")))
    compared = {c: _compared(c, F.col("_A_RANK"), months, absent) for c in compare_cols if absent and any(c in x for x in absent.values())}

    def differs(s):
        out = ~s["OLD_VALUE"].eqNullSafe(s["NEW_VALUE"])
        for c, both in compared.items():
            out = out & ((s["COLUMN"] != c) | both)
        return out

    changed = F.filter(changes, differs)
    return (pairs.select(*keys, "_A_RANK", F.explode(changed).alias("_CH"))
            .select(*keys, "_CH.OLD_VALUE", "_CH.NEW_VALUE", "_CH.COLUMN",
                    _rank_label(months, F.col("_A_RANK")).alias("FROM_MONTH"),
                    _rank_label(months, F.col("_A_RANK") + 1).alias("TO_MONTH")))


def value_counts(rows: DataFrame, compare_cols: list[str], key_cols, months: list[dt.date]) -> DataFrame:
    """(key, COLUMN, VALUE) -> rows per month (c1, c2, ...) of (keys, M_RANK, compared columns): a hot key
    collapses to its distinct values before the shuffle."""
    keys = list(key_cols)
    long = text_image(rows, compare_cols).select(*keys, "M_RANK",
                      F.explode(F.array(*[F.struct(F.lit(c).alias("COLUMN"), F.col(c).alias("VALUE"))
                                          for c in compare_cols])).alias("_KV")) \
        .select(*keys, "M_RANK", "_KV.COLUMN", "_KV.VALUE")
    return long.groupBy(*keys, "COLUMN", "VALUE").agg(
        *[F.count_if(F.col("M_RANK") == i).alias(f"c{i}") for i in range(1, len(months) + 1)])


def _hot_counts(hot: DataFrame, compare_cols: list[str], keys: list[str], months: list[dt.date]) -> DataFrame:
    """``change_counts`` of ids with many rows, without row pairs.

    For a card key with ``n_m`` rows in month m and ``n_{m+1}`` in month m+1 there are
    ``n_m * n_{m+1}`` matched pairs; the pairs whose values agree in a column are
    ``sum_v c_{v,m} * c_{v,m+1}`` over that column's values v (null equals null, as a
    group key).  Two partial aggregates give everything: the value counts, and per
    (key, column) ``n_m = sum_v c_{v,m}`` and ``same_m = sum_v c_{v,m} c_{v,m+1}``."""
    m = len(months)
    per_col = value_counts(hot, compare_cols, keys, months).groupBy(*keys, "COLUMN").agg(
        *[F.sum(f"c{i}").alias(f"n{i}") for i in range(1, m + 1)],
        *[F.sum(F.col(f"c{i}") * F.col(f"c{i + 1}")).alias(f"s{i}") for i in range(1, m)])
    trans = F.array(*[F.struct(F.lit(i).alias("A_RANK"), (F.col(f"n{i}") * F.col(f"n{i + 1}")).alias("PAIRS"),
                               (F.col(f"n{i}") * F.col(f"n{i + 1}") - F.col(f"s{i}")).alias("CHANGED"))
                      for i in range(1, m)])
    return per_col.select(*keys, "COLUMN", F.explode(trans).alias("_T")).select(*keys, "COLUMN", "_T.*").where(F.col("PAIRS") > 0)


def _near_counts(rows: DataFrame, compare_cols: list[str], keys: list[str]) -> DataFrame:
    """``change_counts`` of ids with few rows: their pairs, counted where they meet."""
    per = (_near_pairs(rows, compare_cols, keys).groupBy(*keys, F.col("_A_RANK").alias("A_RANK"))
           .agg(F.count(F.lit(1)).alias("PAIRS"), *[F.count_if(~F.get("_OLD", F.lit(i)).eqNullSafe(F.get("_NEW", F.lit(i)))).alias(f"_d{i}")
                                                    for i in range(len(compare_cols))]))
    columns = F.array(*[F.struct(F.lit(c).alias("COLUMN"), F.col(f"_d{i}").alias("CHANGED")) for i, c in enumerate(compare_cols)])
    return per.select(*keys, "A_RANK", "PAIRS", F.explode(columns).alias("_T")).select(*keys, "_T.COLUMN", "A_RANK", "PAIRS", "_T.CHANGED")


def _count_parts(prime: DataFrame, compare_cols: list[str], key_cols, months: list[dt.date], absent: Absent | None) -> list[DataFrame]:
    """``change_counts`` in one or two parts; an id is wholly in one of them."""
    keys = list(key_cols)
    rows, hot = _by_heat(prime, compare_cols, keys, months)
    parts = [_near_counts(rows, compare_cols, keys)] + ([] if hot is None else [_hot_counts(hot, compare_cols, keys, months)])
    compared = F.lit(True)
    for c in compare_cols:
        compared = F.when(F.col("COLUMN") == c, _compared(c, F.col("A_RANK"), months, absent)).otherwise(compared)
    return [part.withColumn("CHANGED", F.when(compared, F.col("CHANGED")).otherwise(0)) for part in parts]


def _together(parts: list[DataFrame]) -> DataFrame:
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def change_counts(prime: DataFrame, compare_cols: list[str], key_cols=("RIMNO", "PRODUCT_NAME"),
                  months: list[dt.date] | None = None, absent: Absent | None = None) -> DataFrame:
    """Exact changed-pair counts per key, transition and column: PAIRS and CHANGED (0 where a month lacks the
    column); PAIRS does not depend on the column.

    Rows of an id with at most ``HOT_ROWS`` rows move once, by the id, and are paired and counted there; an id with
    more is counted by its values (``_hot_counts``), never by pairs of its rows."""
    return _together(_count_parts(prime, compare_cols, key_cols, months or snapshot_months(prime, at_least=2), absent))


def change_log_counted(prime: DataFrame, compare_cols: list[str], key_cols=("RIMNO", "PRODUCT_NAME"),
                       months: list[dt.date] | None = None, absent: Absent | None = None) -> DataFrame:
    """The change log with equal (key, transition, column, old, new) rows made one and their number N_PAIRS.  Ids
    of few rows are paired where their rows meet and equal changes counted there; for the others values meet with their
    row counts, so a key's output is bounded by its distinct values."""
    months = months or snapshot_months(prime, at_least=2)
    keys = list(key_cols)
    few, hot = _by_heat(prime, compare_cols, keys, months)
    changes = _changes(_near_pairs(few, compare_cols, keys), compare_cols, keys, months, absent)
    out = changes.groupBy(*changes.columns).agg(F.count(F.lit(1)).alias("N_PAIRS"))
    if hot is None:
        return out
    m = len(months)
    per_val = value_counts(hot, compare_cols, keys, months)
    side = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("RANK"), F.col(f"c{i}").alias("N")) for i in range(1, m + 1)]),
                              lambda x: x["N"] > 0)).alias("_S")
    rows = per_val.select(*keys, "COLUMN", "VALUE", side).select(*keys, "COLUMN", "VALUE", "_S.RANK", "_S.N")
    a = rows.select(*[F.col(k).alias(f"_A_{k}") for k in keys], F.col("COLUMN").alias("_C"), F.col("VALUE").alias("OLD_VALUE"),
                    F.col("RANK").alias("A_RANK"), F.col("N").alias("_N_OLD"))
    b = rows.withColumnRenamed("VALUE", "NEW_VALUE")
    cond = (F.col("_C") == F.col("COLUMN")) & (F.col("A_RANK") + 1 == F.col("RANK")) & ~F.col("OLD_VALUE").eqNullSafe(F.col("NEW_VALUE"))
    for k in keys:
        cond = cond & F.col(f"_A_{k}").eqNullSafe(F.col(k))
    compared = F.lit(True)
    for c in compare_cols:
        compared = F.when(F.col("COLUMN") == c, _compared(c, F.col("A_RANK"), months, absent)).otherwise(compared)
    return out.union(a.join(b, cond).where(compared).select(
        *keys, "OLD_VALUE", "NEW_VALUE", "COLUMN", _rank_label(months, F.col("A_RANK")).alias("FROM_MONTH"),
        _rank_label(months, F.col("A_RANK") + 1).alias("TO_MONTH"), (F.col("_N_OLD") * F.col("N")).alias("N_PAIRS")))


def change_rates(prime: DataFrame, compare_cols: list[str], key_cols=("RIMNO", "PRODUCT_NAME"),
                 months: list[dt.date] | None = None, absent: Absent | None = None) -> DataFrame:
    """Per transition and column: matched pairs, changed rows, percent of matched pairs (one aggregate:
    the matched pairs of a transition are the same for every column)."""
    months = months or snapshot_months(prime, at_least=2)
    changed = (change_counts(prime, compare_cols, key_cols, months, absent).groupBy("A_RANK", "COLUMN")
               .agg(F.sum("PAIRS").alias("MATCHED_PAIRS"), F.sum("CHANGED").alias("CHANGED_ROWS")).where("CHANGED_ROWS > 0"))
    return changed.select(
        _rank_label(months, F.col("A_RANK")).alias("FROM_MONTH"), _rank_label(months, F.col("A_RANK") + 1).alias("TO_MONTH"),
        "COLUMN", F.col("MATCHED_PAIRS").cast("bigint"), F.col("CHANGED_ROWS").cast("bigint"),
        F.bround(F.col("CHANGED_ROWS") * 100.0 / F.col("MATCHED_PAIRS"), 2).alias("PCT_CHANGED"))


def change_summary(prime: DataFrame, compare_cols: list[str], key_cols=("RIMNO", "PRODUCT_NAME"),
                   months: list[dt.date] | None = None, absent: Absent | None = None) -> DataFrame:
    """Per column over all transitions: total changes, distinct ids affected and their
    percent of all distinct card keys that were matched at least once (half-even, 2 dp).
    Every matched key has a row for each column, so the tracked count comes from the same
    aggregate.  Keys are counted, then their ids, where they are; only counts per column move."""
    months = months or snapshot_months(prime, at_least=2)
    keys = list(key_cols)

    def per_id(part: DataFrame) -> DataFrame:
        per_key = part.groupBy("COLUMN", *keys).agg(F.sum("CHANGED").alias("_CHANGED"))
        return per_key.groupBy("COLUMN", keys[0]).agg(F.sum("_CHANGED").alias("_CHANGED"), F.count(F.lit(1)).alias("_KEYS"))

    summ = (_together([per_id(part) for part in _count_parts(prime, compare_cols, keys, months, absent)]).groupBy("COLUMN")
            .agg(F.sum("_CHANGED").alias("total_changes"), F.sum("_KEYS").alias("TRACKED"),
                 F.count_if(F.col("_CHANGED") > 0).alias("unique_pairs_affected"))
            .where("total_changes > 0"))
    return summ.select("COLUMN", F.col("total_changes").cast("bigint"), F.col("unique_pairs_affected").cast("bigint"),
                       F.bround(F.col("unique_pairs_affected") * 100.0 / F.col("TRACKED"), 2).alias("pct_pairs_affected"))


def common_ids(a: DataFrame, b: DataFrame, id_col: str = "RIMNO") -> DataFrame:
    """Distinct non-null ids present in both inputs, sorted (one partial aggregate over both)."""
    both = id_sets([a, b], id_col)
    return both.where(has(F.col("MASK"), 1) & has(F.col("MASK"), 2)).select(id_col).orderBy(id_col)
