"""Incremental ingest of new recordings (Structured Streaming).

The original analysis has no stream operators; its data arrive as files, one
recording (CSV) plus one observer workbook per patient.  This module runs the
batch ingest of :mod:`tocsin.plans.ingest` on each micro-batch of new
recording files: the file source tracks which files were processed (in the
stream checkpoint), each batch reads the workbooks of its recordings only,
and the output folders of those recordings are overwritten as a whole
(dynamic partition overwrite), so a replayed batch gives the same dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tocsin.operators.episodes import DAY_SECONDS
from tocsin.plans.ingest import ingest, sheets_from_workbooks
from tocsin.session import scratch
from tocsin.sources import literals
from tocsin.sources.device_csv import parse_device_lines
from tocsin.sources.workbook import read_workbooks


def _write_batch(spark: SparkSession, batch: DataFrame, workbook_dir: str, out_dir: str, skip: int) -> None:
    monitor = parse_device_lines(batch, skip=skip)
    # One workbook per recording of this batch; the batch size is bounded by
    # maxFilesPerTrigger, so the id list is small.
    ids = [r["id"] for r in monitor.select("id").distinct().collect()]
    if not ids:
        return
    glob = "{" + ",".join(f"{i}.xlsx" for i in ids) + "}"
    cells = read_workbooks(spark, workbook_dir, glob=glob)
    series = ingest(monitor, sheets_from_workbooks(cells), literals.allocation(spark))
    chunk = F.floor(F.unix_seconds("datetime") / F.lit(DAY_SECONDS))
    with scratch(spark):  # nothing that a batch leaves behind outlives it
        (series.repartition("id", chunk).sortWithinPartitions("id", "datetime")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id").parquet(out_dir))


def start_ingest_stream(spark: SparkSession, csv_dir: str, workbook_dir: str, out_dir: str, checkpoint: str,
                        *, skip: int = 6, max_files_per_trigger: int = 64, available_now: bool = False) -> StreamingQuery:
    """Watch ``csv_dir`` for new recordings and append them to the series dataset."""
    # wholetext must go through text(): the reader method overrides the option.
    files = (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
             .option("pathGlobFilter", "*.csv").text(csv_dir, wholetext=True)
             .select(F.col("_metadata.file_name").alias("file"), "value"))
    writer = files.writeStream.foreachBatch(
        lambda df, _epoch: _write_batch(spark, df, workbook_dir, out_dir, skip)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
