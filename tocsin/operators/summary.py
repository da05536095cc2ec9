"""Baseline table (O38): patient characteristics by arm.

Output is long: continuous variables give ``n, p25, median, p75`` per arm
(linear-interpolated quantiles, NULLs left out); categorical variables give
``n`` and ``pct`` per level and arm (percent of non-missing values).  Rows
without an arm are left out, as the table is split by arm.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.timeparse import mdy_hms, minutes_between
from tocsin.session import materialize

# Procedure groups, tested in this order, case-insensitive; the
# first pattern found in the procedure text names the group, else "Other".
PROCEDURE_RULES = (
    ("tube", "Gastric tube"),
    ("fistula", "Fistula"),
    ("hemodialysis", "Hemodialysis line"),
    ("cvc", "Central venous cannula"),
    ("embolization", "Embolization"),
    ("biopsy", "Biopsy"),
    ("angiogram", "Angiogram"),
    ("angioplasty", "Angioplasty"),
    ("ablation", "Ablation"),
    ("pulmonary", "Pulmonary angiogram"),
    ("ptcd", "Percutaneous transhepatic cholangio drain"),
    ("Abdominal drainage", "Abdominal drain"),
    ("Abdominal drain", "Abdominal drain"),
    ("Abdominal paracentesis", "Abdominal drain"),
)
OTHER = "Other"

CONTINUOUS = ("age", "totalMidaz", "totalFent", "duration")
CATEGORICAL = ("sex", "oxygenDevice", "procedure")


def procedure_group(text: Column, rules: Sequence[tuple[str, str]] = PROCEDURE_RULES) -> Column:
    """First matching rule wins; NULL text and no match give "Other"."""
    expr = None
    for pattern, label in rules:
        cond = F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(OTHER)) if expr is not None else F.lit(OTHER)


def baseline_frame(form_units: DataFrame, rules: Sequence[tuple[str, str]] = PROCEDURE_RULES) -> DataFrame:
    """Patient rows with duration in minutes and the procedure group."""
    duration = minutes_between(mdy_hms(F.col("caseEnd")), mdy_hms(F.col("caseStart")))
    return form_units.select(
        "age", "sex", "totalMidaz", "totalFent", "oxygenDevice",
        duration.alias("duration"), "randomization",
        procedure_group(F.col("procedure"), rules).alias("procedure"),
    )


PROBABILITIES = (0.25, 0.5, 0.75)


def order_statistics(values: DataFrame, keys: Sequence[str], probabilities: Sequence[float] = PROBABILITIES) -> DataFrame:
    """(*keys, n, q): the quantiles ``q`` of ``value`` in each group, linear between
    neighbours (the exact ones, however many values a group has).

    Equal values are counted together first.  The counts are dealt to ranges of
    (keys, value) and written with the number of their range; a range's rows are
    numbered by themselves, and what stands before a range comes from the small
    table of the ranges.  A quantile is then the row that holds its rank, so neither a
    group's values nor a map of them ever meet in one task."""
    counts = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("held"))
    dealt = materialize(counts.repartitionByRange(*keys, "value")
                        .withColumn("_range", F.spark_partition_id()), "order-statistics")
    ranges = dealt.groupBy(*keys, "_range").agg(F.sum("held").alias("_all"))
    group = Window.partitionBy(*keys)
    ranges = ranges.select(*keys, "_range", (F.sum("_all").over(group.orderBy("_range")) - F.col("_all")).alias("_before"),
                           F.sum("_all").over(group).alias("n"))
    inside = F.sum("held").over(Window.partitionBy(*keys, "_range").orderBy("value")) - F.col("held")
    placed = dealt.withColumn("_inside", inside).join(ranges, [*keys, "_range"]).select(
        *keys, "value", "n", "held", (F.col("_before") + F.col("_inside")).alias("start"))
    # The two neighbours of each quantile: a row holds the ranks from start to start + held - 1.
    rank = {k: F.lit(p) * (F.col("n") - 1) for k, p in enumerate(probabilities)}
    ends = [F.max(F.when((F.col("start") <= r) & (r < F.col("start") + F.col("held")), F.col("value"))).alias(f"{k}{side}")
            for k, p in rank.items() for side, r in (("low", F.floor(p)), ("high", F.ceil(p)))]
    found = placed.groupBy(*keys, "n").agg(*ends)
    between = [F.col(f"{k}low") + (p - F.floor(p)) * (F.col(f"{k}high") - F.col(f"{k}low")) for k, p in rank.items()]
    return found.select(*keys, "n", F.array(*between).alias("q"))


def continuous_summary(frame: DataFrame, variables: Sequence[str] = CONTINUOUS, exact: bool = True,
                       accuracy: int = 100_000) -> DataFrame:
    """``exact`` finds quartiles by their ranks (linear interpolation, as the oracle);
    ``exact=False`` uses a mergeable quantile sketch of bounded size."""
    long = frame.filter(F.col("randomization").isNotNull()).select(
        "randomization",
        F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value"))
                            for v in variables])).alias("kv"))
    long = long.select("randomization", "kv.variable", "kv.value").filter(F.col("value").isNotNull())
    keys = ["randomization", "variable"]
    if exact:
        agg = order_statistics(long, keys)
    else:
        q = F.percentile_approx(F.col("value"), F.array(*map(F.lit, PROBABILITIES)), accuracy).cast("array<double>")
        agg = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return agg.select("randomization", "variable", "n", F.col("q")[0].alias("p25"),
                      F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"))


def categorical_summary(frame: DataFrame, variables: Sequence[str] = CATEGORICAL) -> DataFrame:
    long = frame.filter(F.col("randomization").isNotNull()).select(
        "randomization",
        F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level"))
                            for v in variables])).alias("kv"))
    long = long.select("randomization", "kv.variable", "kv.level").filter(F.col("level").isNotNull())
    counts = long.groupBy("randomization", "variable", "level").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("randomization", "variable"))
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / total)


def remove_variable(summary: DataFrame, variable: str) -> DataFrame:
    """Row-type removal variant: drop every row of one variable."""
    return summary.filter(F.col("variable") != variable)
