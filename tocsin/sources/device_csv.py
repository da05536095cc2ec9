"""Device CSV scan.

Each recording is one CSV file with a preamble of ``skip`` lines and no
header; ``--`` and empty fields are missing.  Files are read whole
(``wholetext``) and split into numbered lines, which gives the exact line
order that the one-row-per-second rule depends on.  One recording is one
procedure (tens of thousands of lines), so a file is a bounded unit of work;
the folder is spread over tasks file by file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tocsin.functions.timeparse import mdy_hms_of

# Column names of the device export, in file order.
DEVICE_COLUMNS = (
    "date", "time", "co2Wave", "etco2", "respRate", "ipi", "spo2", "pulseRate",
    "apneasPerHour", "oxygenDesatIndex", "etco2High", "etco2Low", "respRateHigh",
    "respRateLow", "noBreath", "ipiLow", "spo2High", "spo2Low", "pulseRateHigh",
    "pulseRateLow", "apnea10", "apnea19", "apnea29", "apnea30", "oxygenDesatProlonged",
    "co2NA", "spo2NA", "PrBatteryLow", "SecBatteryLow", "events",
)
TEXT_COLUMNS = ("date", "time", "events")
MEASURE_COLUMNS = ("co2Wave", "etco2", "respRate", "ipi", "spo2", "pulseRate", "apneasPerHour", "oxygenDesatIndex")
MISSING_TOKENS = ("--", "")


def column_type(name: str) -> str:
    if name in TEXT_COLUMNS:
        return "string"
    if name in MEASURE_COLUMNS:
        return "double"
    return "int"


def read_device_csv(spark: SparkSession, path: str, skip: int = 6, split_files: bool = False) -> DataFrame:
    """All recordings under ``path``: ``id, line`` + the 30 device columns + ``datetime``.

    ``split_files=True`` reads lines instead of whole files, so one very large
    recording is spread over several tasks; ``line`` is then an order key
    (increasing within a file) rather than the line number.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    if not split_files:
        files = reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
        return parse_device_lines(files, skip)
    lines = reader.text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_r"),
        F.col("value").alias("text"))
    # Within a file, blocks are in offset order and rows of a block in file
    # order: (block start, row id) orders the lines of each file.
    # The first ``skip`` lines of each file: a per-file top-k, cut map-side
    # (WindowGroupLimit) so only ``skip`` rows per file and task are shuffled.
    w = Window.partitionBy("file").orderBy("_b", "_r")
    preamble = (lines.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= skip)
                .select("file", "_b", "_r"))
    body = lines.join(preamble, ["file", "_b", "_r"], "left_anti")
    # One long: the block start scaled so that consecutive blocks (at least
    # the smallest split apart) stay above any row index inside a task (the
    # low 33 bits of the row id).
    def conf_bytes(key: str, default: int) -> int:
        v = str(spark.conf.get(key, str(default))).strip().lower()
        units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
        for suffix in ("b", "kb", "mb", "gb"):
            if v.endswith(suffix) and suffix != "b":
                return int(float(v[:-2]) * units[suffix[0]])
        return int(float(v.rstrip("b")))
    min_split = max(1, min(conf_bytes("spark.sql.files.maxPartitionBytes", 128 << 20),
                           conf_bytes("spark.sql.files.openCostInBytes", 4 << 20)))
    scale = -(-(1 << 33) // min_split)
    numbered = body.select("file", (F.col("_b") * F.lit(scale) + (F.col("_r") % F.lit(1 << 33))).alias("line"),
                           "text")
    return parse_numbered_lines(numbered)


def parse_device_lines(files: DataFrame, skip: int = 6) -> DataFrame:
    """``file, value`` (whole file text) -> typed device rows (see module doc)."""
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return parse_numbered_lines(lines.filter(F.col("line") >= skip))


def parse_numbered_lines(lines: DataFrame) -> DataFrame:
    """``file, line, text`` -> typed device rows; blank lines are skipped."""
    lines = lines.filter(F.length(F.trim("text")) > 0)
    ddl = ", ".join(f"`{c}` STRING" for c in DEVICE_COLUMNS)
    parsed = lines.select(
        F.regexp_replace("file", r"\.csv$", "").alias("id"),
        F.col("line").cast("long").alias("line"),
        F.from_csv("text", ddl, {"mode": "PERMISSIVE"}).alias("r"),
    )
    cols = []
    for c in DEVICE_COLUMNS:
        raw = F.col(f"r.{c}")
        clean = F.when(F.trim(raw).isin(*MISSING_TOKENS), None).otherwise(F.trim(raw))
        typ = column_type(c)
        cols.append((clean if typ == "string" else clean.try_cast(typ)).alias(c))
    out = parsed.select("id", "line", *cols)
    return out.withColumn("datetime", mdy_hms_of(F.col("date"), F.col("time")))
