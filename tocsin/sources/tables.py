"""Readers for the driver's parquet tables.

Timestamps in the test parquet load as ``timestamp_ntz``; every reader casts
them to the session-zone ``timestamp`` so that ``unix_seconds`` and interval
arithmetic apply.  Column pruning and filters are left to Catalyst: callers
select what they need and the parquet scan reads only those columns.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    casts = [
        F.col(f.name).cast(T.TimestampType()).alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*casts)
