"""Data-quality checks over the observer sheets.

Each check yields findings ``(id, check, observed, expected)``; all checks
union into one findings table instead of printed lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Expected data rows per workbook sheet.
EXPECTED_ROWS = {
    "sync_rows": 2,
    "nurse_rows": 1,
    "intervention_rows": 0,
    "adverse_rows": 1,
}

# Fixed value: largest accepted clock gap between paired readings (minutes).
MAX_SYNC_GAP_MINUTES = 5


def _finding(df: DataFrame, check: str, observed, expected) -> DataFrame:
    return df.select("id", F.lit(check).alias("check"), F.col(observed).cast("double").alias("observed"),
                     F.lit(expected).cast("double").alias("expected"))


def row_count_checks(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Workbooks whose sheets do not hold the expected number of data rows,
    all sheets in one aggregate.  ``rows``: one row ``(id, check)`` per data row
    (or with a count ``n``); a workbook with an empty or absent sheet counts 0."""
    n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    counted = rows.groupBy("id", "check").agg(n.alias("found"))
    expected = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(n).alias("expected")) for c, n in EXPECTED_ROWS.items()])
    asked = files.select("id").distinct().select("id", F.explode(expected).alias("e")).select("id", "e.*")
    checked = asked.join(counted, ["id", "check"], "left").withColumn("observed", F.coalesce("found", F.lit(0)))
    return checked.filter(F.col("observed") != F.col("expected")).select(
        "id", "check", F.col("observed").cast("double").alias("observed"), F.col("expected").cast("double").alias("expected"))


def same_day_check(pairs: DataFrame) -> DataFrame:
    """Workbooks with a clock pair whose two readings fall on different days."""
    bad = pairs.filter(F.to_date("ipad") != F.to_date("Capnostream"))
    per = bad.groupBy("id").agg(F.count(F.lit(1)).alias("observed"))
    return _finding(per, "sync_not_same_day", "observed", 0)


def gap_check(pairs: DataFrame, limit_minutes: float = MAX_SYNC_GAP_MINUTES, absolute: bool = False) -> DataFrame:
    """Clock pairs more than ``limit_minutes`` apart, signed
    (tablet minus monitor) unless ``absolute``."""
    minutes = F.col("diff") / F.lit(60.0)
    if absolute:
        minutes = F.abs(minutes)
    bad = pairs.select("id", minutes.alias("minutes")).filter(F.col("minutes") > limit_minutes)
    return _finding(bad, "sync_gap_over_limit", "minutes", limit_minutes)


def tagged(sheets: dict[str, DataFrame]) -> DataFrame:
    """Sheet rows under the names of their checks, in one table (id, check)."""
    out = None
    for check, rows in sheets.items():
        one = rows.select("id", F.lit(check).alias("check"))
        out = one if out is None else out.unionByName(one)
    return out


def all_checks(files: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every check in one findings table.  ``rows``: see ``row_count_checks``."""
    return row_count_checks(files, rows).unionByName(same_day_check(pairs)).unionByName(gap_check(pairs))
