"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.session import materialize, scratch_path
from tocsin.sources.tables import read_table

#: What separates words in most contracts: blank and the controls tab to CR.
NOT_BLANK = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    return materialize(df, f"llm-{name}")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder, freed with ``session.release``."""
    return scratch_path(spark, f"llm-{name}")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    bounded_batches(spark)
    return read_table(spark, sf_dir, "documents").select(*(columns or ("*",)))


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Python tasks get ``rows`` rows at a time, unless the session says otherwise:
    texts are long, and Spark's 10,000 of them make batches of many MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(rows))


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
