"""Literal dimension tables.

These are tiny, fixed-size tables: their size bound is the literal itself, so
they are the only inputs the jobs broadcast without a runtime size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cluster allocation (nurse -> arm).
ALLOCATION = (
    ("N01", "IPI enabled"),
    ("N02", "IPI disabled"),
    ("N03", "IPI disabled"),
    ("N04", "IPI enabled"),
    ("N05", "IPI disabled"),
    ("N06", "IPI disabled"),
    ("N07", "IPI enabled"),
    ("N08", "IPI enabled"),
    ("N09", "IPI disabled"),
    ("N10", "IPI enabled"),
    ("N11", "IPI disabled"),
)

# Units monitored without a device recording; in the trial two patients of
# nurse N09.  The fixture uses ids that cannot clash with derived ids.
MISSING_UNITS = (
    ("E998", "N09", "IPI disabled"),
    ("E999", "N09", "IPI disabled"),
)

ALLOCATION_SCHEMA = T.StructType([
    T.StructField("id_cluster", T.StringType(), False),
    T.StructField("randomization", T.StringType(), False),
])
UNIT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("nurse", T.StringType(), True),
    T.StructField("randomization", T.StringType(), True),
])

def local_table(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A literal table as a local relation (``VALUES``): planned on the driver,
    broadcast without a job, no RDD behind it."""
    def lit(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    names = [f.name for f in schema.fields]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def allocation(spark: SparkSession, rows=ALLOCATION) -> DataFrame:
    return local_table(spark, rows, ALLOCATION_SCHEMA)


def missing_units(spark: SparkSession, rows=MISSING_UNITS) -> DataFrame:
    return local_table(spark, rows, UNIT_SCHEMA)


def values_sql(rows, columns) -> str:
    """The same literal table as a SQL ``VALUES`` relation (for oracles)."""
    body = ",".join("(" + ",".join(f"'{v}'" for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(columns)}))"
