"""Ingest: device recordings + observer sheets -> the clean series (lifecycle A).

One DAG over all recordings: O01 scan -> O13 one row per second -> O08 clock
pairs -> O09/O10 clock fill -> O11 nurse fill -> O12 event attach -> O14 arm
-> O05 sink.  The one-row-per-second step runs first: every row of a second
meets the same clock, nurse and event readings, so the result is the same and
the later joins see fewer rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.functions.timeparse import mdy_hms
from tocsin.operators.clock import clock_fill, clock_pairs, nurse_fill
from tocsin.operators.rows import arm_lookup, one_row_per_tick
from tocsin.sources import literals


@dataclass
class ObserverSheets:
    """Observer sheets in long text form: ``id, row`` + sheet columns."""
    sync: DataFrame            # id, row, device, time
    nurse: DataFrame           # id, row, nurse, time
    interventions: DataFrame   # id, row, event, time

    def sync_readings(self) -> DataFrame:
        return self.sync.select("id", "row", "device", mdy_hms(F.col("time")).alias("time"))

    def nurse_log(self) -> DataFrame:
        return self.nurse.select("id", "row", "nurse", mdy_hms(F.col("time")).alias("time_corrected"))

    def intervention_log(self) -> DataFrame:
        return self.interventions.select("id", "row", "event", mdy_hms(F.col("time")).alias("time_corrected"))


def dedup(monitor: DataFrame) -> DataFrame:
    """O13 on device rows (rows without a date are dropped first)."""
    return one_row_per_tick(monitor.filter(F.col("datetime").isNotNull()), ["id"], "datetime", "line")


def ingest(monitor: DataFrame, sheets: ObserverSheets, allocation: DataFrame, match: str = "exact") -> DataFrame:
    """The series: one row per second with tablet time, nurse, event and arm."""
    s = dedup(monitor)
    s = clock_fill(s, clock_pairs(sheets.sync_readings()), match=match)
    s = nurse_fill(s, sheets.nurse_log(), match=match, interventions=sheets.intervention_log())
    return arm_lookup(s, allocation).drop("diff")


def sheets_from_workbooks(cells: DataFrame) -> ObserverSheets:
    """Observer sheets out of the long workbook table."""
    from tocsin.sources.workbook import sheet_frame

    return ObserverSheets(
        sync=sheet_frame(cells, ["device", "time"], sheet="Sync times"),
        nurse=sheet_frame(cells, ["nurse", "time"], sheet="Nurse ID"),
        interventions=sheet_frame(cells, ["event", "time"], sheet="Interventions"),
    )


def workbook_findings(spark: SparkSession, workbook_dir: str) -> DataFrame:
    """O47-O49 over a folder of observer workbooks, parsed once."""
    from tocsin.operators.quality import all_checks
    from tocsin.session import materialize
    from tocsin.sources.workbook import counted_rows, read_workbooks, sheet_frame, workbook_files

    cells = materialize(read_workbooks(spark, workbook_dir), "workbook-cells")
    sync = sheet_frame(cells, ["device", "time"], sheet_index=1)
    pairs = clock_pairs(sync.select("id", "row", "device", mdy_hms(F.col("time")).alias("time")))
    return all_checks(workbook_files(spark, workbook_dir), counted_rows(cells), pairs)


def ingest_folders(spark: SparkSession, csv_dir: str, workbook_dir: str, out_dir: str | None = None,
                   match: str = "exact") -> DataFrame:
    """Folder-to-dataset ingest: CSV recordings + tablet workbooks -> series."""
    from tocsin.session import materialize
    from tocsin.sources.dataset import write_series
    from tocsin.sources.device_csv import read_device_csv
    from tocsin.sources.workbook import read_workbooks

    monitor = read_device_csv(spark, csv_dir)
    sheets = sheets_from_workbooks(materialize(read_workbooks(spark, workbook_dir), "workbook-cells"))
    series = ingest(monitor, sheets, literals.allocation(spark), match=match)
    if out_dir is not None:
        write_series(series, out_dir)
    return series
