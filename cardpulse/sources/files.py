"""File sources and sinks for the monthly snapshot / transaction files.

* CSV files (latin-1, header, all text): one scan per distinct header, alias headers
  normalised per file, united by name, CSV null markers mapped to null, SNAP_MONTH taken
  from the file name through the ``_metadata.file_name`` column.
* typed contract: optional columns cast with the coercing parsers (absent columns
  are skipped, as the studied loaders do).
* sinks: partitioned Parquet (``SNAP_MONTH``/``SEGMENT`` or matched flag) or CSV.
"""

from __future__ import annotations

import csv
import datetime as dt
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardpulse.functions import contract, norm
from cardpulse.functions.months import FALLBACK_MONTH, MONTH_COL, label_of_name, month_from_path, month_of_name


def canonical_headers(header: list[str], aliases: dict[str, str]) -> list[str]:
    """Canonical column names of one file's header: an alias becomes its name unless the file has
    that name as well; runs of blanks and underscores become one underscore."""
    names = [aliases[c] if c in aliases and aliases[c] not in header else c for c in header]
    return [re.sub(r"[\s_]+", "_", c.strip()) for c in names]


def normalise_headers(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """``df`` with canonical column names."""
    return df.toDF(*canonical_headers(df.columns, aliases))


def _options(encoding: str, multi_line: bool) -> dict:
    # quotes inside quoted text are doubled, a backslash is an ordinary character
    return {"header": True, "encoding": encoding, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": multi_line,
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _safe_names(header: list[str]) -> list[str]:
    """Header names as the CSV reader has them: an empty one is _c and its place, a repeated one gets its place."""
    often = {k for k, n in Counter(c.lower() for c in header).items() if n > 1}
    return [f"_c{i}" if not c else f"{c}{i}" if c.lower() in often else c for i, c in enumerate(header)]


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def file_headers(spark: SparkSession, paths, encoding: str = "ISO-8859-1") -> dict[str, list[str]]:
    """Header of every file under ``paths`` that has a line: one job for all files, whatever their number.

    Every split is a task of its own that hands on lines one by one and ends with the first line of
    text, or at once where the split is not the start of its file; so only the head of a file is
    read.  As many entries as files reach the driver."""

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            line, start = batch.column(1)[0].as_py(), batch.column(2)[0].as_py()
            if start != 0:
                return
            if line.strip():
                yield batch.slice(0, 1).select(["file", "line"])
                return

    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"),
                                          F.col("_metadata.file_block_start").alias("start"))
    wide = str(1 << 30)
    with _settings(spark, {"spark.sql.files.maxPartitionBytes": wide, "spark.sql.files.openCostInBytes": wide,
                           "spark.sql.files.minPartitionNum": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}):
        found = {unquote(r["file"]): bytes(r["line"]) for r in lines.mapInArrow(first_lines, "file string, line binary").collect()}
    decoded = {f: line.removeprefix(b"\xef\xbb\xbf").decode(encoding) for f, line in sorted(found.items())}
    return {f: _safe_names(next(csv.reader([line.rstrip("\r")]))) for f, line in decoded.items()}


def read_csv_files(spark: SparkSession, paths, aliases: dict[str, str], encoding: str = "ISO-8859-1",
                   multi_line: bool = False) -> DataFrame:
    """CSV files with headers of their own, every column as text, plus SOURCE_FILE.

    Files with equal headers are one scan; each scan's columns get their canonical names, and the
    scans are united by name (a column that a file lacks is null there).  With ``multi_line``
    quoted text may hold line ends, but a file is then read by one task."""
    by_header: dict[tuple, list[str]] = {}
    for f, header in file_headers(spark, paths, encoding).items():
        by_header.setdefault(tuple(header), []).append(f)
    out = None
    for header, files in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = spark.read.options(**_options(encoding, multi_line)).schema(schema).csv(files)
        names = canonical_headers(list(header), aliases)
        part = raw.select(*[norm.null_tokens(F.col(f"`{c}`")).alias(n) for c, n in zip(header, names)],
                          F.col("_metadata.file_path").alias("SOURCE_FILE"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no files under {paths}")
    return out


def read_snapshots(spark: SparkSession, paths, aliases: dict[str, str] | None = None,
                   encoding: str = "ISO-8859-1", multi_line: bool = False, folders: bool = False) -> DataFrame:
    """All monthly snapshot CSVs, every column as text, plus SNAP_MONTH; see ``absent_columns``.  With ``folders``
    the month may stand in the name of a file's folder."""
    df = read_csv_files(spark, paths, contract.PRIME_ALIASES if aliases is None else aliases, encoding, multi_line)
    name = F.col("SOURCE_FILE")
    month = month_from_path(name, folders)
    for day, label in snapshot_labels(spark, paths, folders).items():       # files whose name tells no month
        stem = F.regexp_replace(F.url_decode(F.replace(F.element_at(F.split(name, "/"), -1), F.lit("+"), F.lit("%2B"))), r"\.[^.]*$", "")
        month = F.when(stem == label, F.lit(day)).otherwise(month)
    return df.withColumn(MONTH_COL, month).drop("SOURCE_FILE")


def _names(spark: SparkSession, paths) -> list[str]:
    """Paths of the files, from their listing: no file is opened."""
    return sorted(r[0] for r in spark.read.format("binaryFile").load(paths).select("path").collect())


def snapshot_labels(spark: SparkSession, paths, folders: bool = False) -> dict:
    """day -> label of the snapshots whose file name tells no month: each distinct stem is a snapshot of its own,
    on days from 1900-01-01 on in the order of the stems, so they come before all months.
    ``months.named(snapshot_months(df), labels)`` gives audits and labels these names."""
    stems = sorted({label_of_name(f) for f in _names(spark, paths) if month_of_name(f, folders) == FALLBACK_MONTH})
    return {FALLBACK_MONTH + dt.timedelta(days=i): stem for i, stem in enumerate(stems)}


def absent_columns(spark: SparkSession, paths, aliases: dict[str, str] | None = None,
                   encoding: str = "ISO-8859-1") -> dict:
    """month -> canonical columns that some file has and that month's files lack, for the ``absent``
    parameter of the lifecycles and the change log."""
    found: dict = {}
    days = {label: day for day, label in snapshot_labels(spark, paths).items()}
    for f, header in file_headers(spark, paths, encoding).items():
        names = canonical_headers(header, contract.PRIME_ALIASES if aliases is None else aliases)
        month = month_of_name(f)
        found.setdefault(days[label_of_name(f)] if month == FALLBACK_MONTH else month, set()).update(names)
    every = set().union(*found.values()) if found else set()
    return {m: every - has for m, has in found.items() if every - has}


def unmatched_files(spark: SparkSession, paths) -> DataFrame:
    """(FILE, LABEL, SNAP_MONTH) of the files whose name tells no month; see ``snapshot_labels``."""
    days = {label: day for day, label in snapshot_labels(spark, paths).items()}
    rows = [(f, label_of_name(f), days[label_of_name(f)]) for f in _names(spark, paths) if month_of_name(f) == FALLBACK_MONTH]
    return spark.createDataFrame(rows, f"FILE string, LABEL string, {MONTH_COL} date")


def vote_formats(raw: DataFrame, columns, candidates=contract.DATE_FORMATS) -> dict[str, str]:
    """The format of each date column that most of its texts have (``quality.date_format_votes``), for the
    ``formats`` of the contract; a column without an accepted text keeps ISO."""
    from cardpulse.operators.quality import date_format_votes
    present = [c for c in columns if c in raw.columns]
    won = date_format_votes(raw, present, candidates).where("IS_WINNER AND N_ACCEPTED > 0").select("COLUMN_NAME", "FORMAT").collect()
    return {r["COLUMN_NAME"]: r["FORMAT"] for r in won}


def apply_contract(df: DataFrame, strings=(), longs=(), doubles=(), dates=(), timestamps=(),
                   formats: dict[str, str] | None = None) -> DataFrame:
    """Cast the present columns of a text table to the declared types (unparseable -> null).  A date
    column has one format, ``formats[column]`` or ISO; ``date_rejects`` counts what it leaves out."""
    formats = formats or {}
    casts = ((strings, norm.strip), (longs, norm.try_long), (doubles, norm.try_double),
             (dates, lambda c: norm.parse_date(c, [formats.get(c, norm.ISO_DATE)])),
             (timestamps, lambda c: norm.parse_timestamp(c, [formats[c]] if c in formats else None)))
    return df.withColumns({c: cast(c) for cols, cast in casts for c in cols if c in df.columns})


def date_rejects(raw: DataFrame, typed: DataFrame, columns) -> DataFrame:
    """(COLUMN_NAME, N_TEXT, N_REJECTED) of the date columns: texts, and texts that their format did not take.
    ``typed`` is ``raw`` after ``apply_contract``."""
    present = [c for c in columns if c in raw.columns and c in typed.columns]
    text = lambda c: F.count_if(F.coalesce(norm.strip(c), F.lit("")) != "")
    n_text = raw.agg(*[text(c).alias(c) for c in present]).withColumn("_K", F.lit(1))
    n_date = typed.agg(*[F.count(c).alias(f"_D_{c}") for c in present]).withColumn("_K", F.lit(1))
    rows = F.array(*[F.struct(F.lit(c).alias("COLUMN_NAME"), F.col(c).alias("N_TEXT"),
                              (F.col(c) - F.col(f"_D_{c}")).alias("N_REJECTED")) for c in present])
    return n_text.join(n_date, "_K").select(F.explode(rows).alias("_R")).select("_R.*")


def clean_snapshots(df: DataFrame, formats: dict[str, str] | None = None) -> DataFrame:
    """Typed prime snapshot with canonical ids and normalised flag codes."""
    renamed = normalise_headers(df, contract.PRIME_ALIASES)
    typed = apply_contract(renamed, strings=contract.PRIME_STRING, longs=contract.PRIME_LONG,
                           doubles=[c.replace(" ", "_") for c in contract.PRIME_DOUBLE], dates=contract.PRIME_DATE,
                           formats=formats)
    typed = typed.drop(*[c for c in contract.PRIME_UNUSED if c in typed.columns])
    fix = {"RIMNO": norm.norm_id("RIMNO")} if "RIMNO" in typed.columns else {}
    for c in ("ACTIVATED", "STATUS", "CARD_STATUS"):
        if c in typed.columns:
            fix[c] = norm.norm_code(c)
    return typed.withColumns(fix)


def read_transactions(spark: SparkSession, paths, fmt: str = "csv", encoding: str = "ISO-8859-1",
                      formats: dict[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """Transaction files (CSV or Parquet) -> typed table with canonical RIMNO."""
    if fmt == "csv":
        df = read_csv_files(spark, paths, contract.TXN_ALIASES, encoding, multi_line).drop("SOURCE_FILE")
    else:
        df = normalise_headers(spark.read.format(fmt).load(paths), contract.TXN_ALIASES)
    df = apply_contract(df, strings=contract.TXN_STRING, longs=contract.TXN_LONG, doubles=contract.TXN_DOUBLE,
                        dates=contract.TXN_DATE, timestamps=contract.TXN_TIMESTAMP, formats=formats)
    return df.withColumn("RIMNO", norm.norm_id("RIMNO")) if "RIMNO" in df.columns else df


def write_partitioned(df: DataFrame, path: str, partition_cols: list[str], fmt: str = "parquet",
                      max_rows_per_file: int = 5_000_000) -> None:
    """One write of a whole table, partitioned (e.g. by SNAP_MONTH and SEGMENT), so later
    stages prune partitions instead of re-reading per-month files.  Rows are rebalanced by the
    partition values: small partitions share a task, a large one is split over several tasks
    and files by its size."""
    (df.hint("rebalance", *partition_cols).write.mode("overwrite").partitionBy(*partition_cols)
     .option("maxRecordsPerFile", max_rows_per_file).format(fmt).option("header", True).save(path))


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header line in every file; with ``bom`` a byte order mark leads it."""
    out = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if bom else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_ids(df: DataFrame, path: str, title: str = "ids", id_col: str = "RIMNO") -> None:
    """Id list as a text sink: a line ``title: count``, then the sorted ids (distributed sort)."""
    ids = df.select(F.col(id_col).cast("string").alias("value"), F.lit(1).alias("_O"))
    head = ids.agg(F.concat(F.lit(f"{title}: "), F.count(F.lit(1)).cast("string")).alias("value")).withColumn("_O", F.lit(0))
    ids.unionByName(head).orderBy("_O", "value").select("value").write.mode("overwrite").text(path)
