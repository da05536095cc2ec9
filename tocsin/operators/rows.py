"""Row-level building blocks: dedup, first row per key, lookups and joins.

First-row operators are hash aggregates (the smallest time of each different row
content), or ``row_number() == 1`` windows that Catalyst turns into a
WindowGroupLimit.  Both combine map-side, so a key holding a large share of the
rows is reduced before the shuffle instead of being sent to one task whole.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(ts_col: str, tie_col: str | None = None) -> Column:
    """Explicit row order: the device time, ties broken by the file line."""
    if tie_col is None:
        return F.col(ts_col)
    return F.struct(F.col(ts_col).alias("t"), F.col(tie_col).alias("l"))


def one_row_per_tick(df: DataFrame, keys: Sequence[str], ts_col: str, tie_col: str) -> DataFrame:
    """One row per (keys, tick); the first line of the tick is kept."""
    w = Window.partitionBy(*keys, ts_col).orderBy(F.col(tie_col))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def first_row_per_key(df: DataFrame, keys: Sequence[str], ts_col: str, columns: Sequence[str]) -> DataFrame:
    """For each key, the listed columns of its first row by ``ts_col``; of rows at one
    time, the smallest values.

    Rows are first grouped by the keys and the columns together, with the smallest
    time: a number that a hash aggregate updates in place, so no row is sorted.  A key
    has few different values there; the first of them is then picked from this table.
    """
    others = [c for c in columns if c != ts_col]
    seen = df.groupBy(*keys, *others).agg(F.min(ts_col).alias("_first"))
    return (
        seen.groupBy(*keys)
        .agg(F.min(F.struct("_first", *others)).alias("_row"))
        .select(*keys, *[F.col("_row")["_first" if c == ts_col else c].alias(c) for c in columns])
    )


def arm_lookup(df: DataFrame, allocation: DataFrame, nurse_col: str = "nurse") -> DataFrame:
    """Attach the arm of the nurse; unknown nurse -> NULL arm.

    The allocation is a literal table (one row per cluster), so broadcasting
    it is bounded by construction.
    """
    alloc = F.broadcast(allocation.select("id_cluster", "randomization"))
    return df.join(alloc, F.col(nurse_col) == alloc.id_cluster, "left").drop("id_cluster")


def anti_filter(df: DataFrame, excluded: DataFrame, col: str = "id", excluded_col: str = "id") -> DataFrame:
    """``!col %in% excluded``.  Rows with a NULL key are kept.

    No broadcast hint: the exclusion list grows with the patient forms, so the
    join strategy is left to AQE's runtime size check.
    """
    ex = excluded.select(F.col(excluded_col).alias("_ex")).distinct()
    return df.join(ex, F.col(col) == F.col("_ex"), "left_anti")


def distinct_units(series: DataFrame) -> DataFrame:
    """Units of analysis, distinct (id, randomization, nurse)."""
    return series.select("id", "randomization", "nurse").distinct()


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where NULL matches NULL (the data-frame default)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    joined = left.join(r, cond, how)
    out = [F.coalesce(left[k], r[f"_r_{k}"]).alias(k) if how in ("right", "full", "outer") else left[k]
           for k in keys]
    rest = [c for c in joined.columns if c not in keys and not c.startswith("_r_")]
    return joined.select(*out, *rest)


def right_join_units(outcome: DataFrame, units: DataFrame, value_col: str = "outcome", fill=0) -> DataFrame:
    """Every unit gets its outcome, units without one get ``fill``."""
    keys = ["id", "randomization", "nurse"]
    joined = null_safe_join(outcome, units.select(*keys), keys, "right")
    return joined.withColumn(value_col, F.coalesce(F.col(value_col), F.lit(fill)))


def append_units(df: DataFrame, missing: DataFrame, value_col: str | None = "outcome", fill=0) -> DataFrame:
    """Append literal units (row union by name), outcome ``fill``."""
    extra = missing
    if value_col is not None:
        extra = extra.withColumn(value_col, F.lit(fill).cast(df.schema[value_col].dataType))
    return df.unionByName(extra, allowMissingColumns=True)


def sort_by_cluster(df: DataFrame) -> DataFrame:
    """Output order by cluster, then id (only at the output; the sort is
    a range exchange over per-unit rows, not over the series)."""
    return df.orderBy(F.col("nurse").asc_nulls_last(), F.col("id").asc_nulls_last())
