"""Series dataset on disk.

The series is written as one Parquet dataset in the order of recordings and time:
in a folder for each recording (``id=<id>/``), as in the original, up to ``MOST_FOLDERS``
recordings.  More of them share files, with the id as a column: a hundred thousand small
recordings would be as many folders, and time to write and list them grows beyond
that for the rows.  Files are cut by ranges of (id, day), so one long recording is written
by several tasks, and a filter on ``id`` prunes folders, or files and row groups by their
smallest and largest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tocsin.operators.episodes import DAY_SECONDS

MOST_FOLDERS = 1000


def write_series(df: DataFrame, path: str, mode: str = "overwrite", chunk_seconds: int = DAY_SECONDS) -> None:
    """Parquet sink, sorted by recording and time.  A dataset that is appended to keeps
    its folders."""
    chunk = F.floor(F.unix_seconds("datetime") / F.lit(chunk_seconds))
    folders = mode == "append" or df.select("id").distinct().count() <= MOST_FOLDERS
    writer = df.repartitionByRange("id", chunk).sortWithinPartitions("id", "datetime").write.mode(mode)
    (writer.partitionBy("id") if folders else writer).parquet(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """The series dataset; ``id`` comes back from the folder names, or from the files
    that recordings share."""
    schema = spark.read.parquet(path).schema
    # Given as text, ids such as "007" are not taken for numbers.
    typed = StructType([StructField(f.name, StringType(), True) if f.name == "id" else f for f in schema])
    return spark.read.schema(typed).parquet(path)


def read_parquet_folders(spark: SparkSession, path: str) -> DataFrame:
    """O04 for folders that are not ``key=value`` (one folder per recording
    with the id stored inside the files)."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)
