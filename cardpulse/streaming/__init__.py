"""Incremental ingest of monthly snapshot files with Structured Streaming.

Monthly snapshots arrive as new CSV files in a landing folder.  ``snapshot_ingest``
picks up only the files not processed before (the file source remembers them in
the checkpoint), reads each batch's files with the batch reader (headers may differ
from file to file), cleans them with the same contract and adds them to the
month-partitioned snapshot table.  A batch owns its partitions (INGEST_BATCH), so a
batch that is run again after a failure replaces what it wrote.  With
``trigger(availableNow=True)`` it runs as a restartable batch job; without it as a
continuous stream.  The checkpoint must live on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.functions.months import MONTH_COL
from cardpulse.sources.files import clean_snapshots, read_snapshots


def snapshot_ingest(spark: SparkSession, landing: str, table_path: str, checkpoint: str,
                    formats: dict[str, str] | None = None, encoding: str = "ISO-8859-1",
                    max_files_per_trigger: int | None = None, available_now: bool = True):
    """Add newly landed snapshot files to the partitioned snapshot table."""
    # only the path is selected, so the source lists files and opens none
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def add(batch: DataFrame, batch_id: int) -> None:
        files = [r[0] for r in batch.select("_file").distinct().collect()]  # the files of one batch
        if files:
            (clean_snapshots(read_snapshots(batch.sparkSession, files, encoding=encoding), formats)
             .withColumn("INGEST_BATCH", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(MONTH_COL, "INGEST_BATCH").parquet(table_path))

    stream = reader.load(landing).select(F.col("path").alias("_file"))
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
