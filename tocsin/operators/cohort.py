"""Cohort rules and unit lists."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.operators.rows import anti_filter, append_units, first_row_per_key, null_safe_join


def exclusions(patient_form: DataFrame, overrides: Sequence[str] = ()) -> DataFrame:
    """Patients without sedation: midazolam 0 or missing and no other sedation.

    ``overrides`` are patients kept although the rule matches (dose missing
    although sedation was given).
    """
    midaz = F.col("totalMidaz")
    rule = ((midaz == 0) | midaz.isNull()) & F.col("totalOtherSedation").isNull()
    out = patient_form.filter(rule)
    if overrides:
        out = out.filter(~F.col("patient").isin(*overrides) | F.col("patient").isNull())
    return out.select(F.col("patient").alias("id"))


def analysed_series(series: DataFrame, excluded: DataFrame) -> DataFrame:
    """The series without excluded patients."""
    return anti_filter(series, excluded, "id", "id")


def first_unit_per_id(series: DataFrame, ts_col: str = "datetime") -> DataFrame:
    """O18 on the series: nurse and arm of the first row of each id."""
    return first_row_per_key(series, ["id"], ts_col, ["nurse", "randomization"])


def cluster_sizes(series: DataFrame, missing: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Patients per (nurse, arm); the first row of each id names its cluster.

    ``excluded`` given -> analysed sizes, else randomized sizes.  Missing units
    (monitored without a recording) are counted too.
    """
    firsts = first_unit_per_id(series).select("nurse", "id", "randomization")
    if excluded is not None:
        firsts = analysed_series(firsts, excluded)
    allu = append_units(firsts, missing.select("nurse", "id", "randomization"), value_col=None)
    return allu.groupBy("nurse", "randomization").agg(F.count(F.lit(1)).alias("n"))


def nurse_dimension(nurse_log: DataFrame, allocation: DataFrame) -> DataFrame:
    """Nurses seen in the observer logs with their arm, one row per nurse."""
    alloc = F.broadcast(allocation.select("id_cluster", "randomization"))
    logged = nurse_log.select("nurse").distinct()
    return logged.join(alloc, F.col("nurse") == alloc.id_cluster, "left").drop("id_cluster")


def units_with_nurses(series: DataFrame, nurses: DataFrame, missing: DataFrame) -> DataFrame:
    """O20 + O24: first unit per id, right-joined to the nurse dimension so
    nurses without patients stay, plus the missing units.  A missing nurse
    matches a missing nurse."""
    firsts = first_unit_per_id(series).select("nurse", "id")
    joined = null_safe_join(firsts, nurses.select("nurse", "randomization"), ["nurse"], "right")
    return append_units(joined.select("nurse", "id", "randomization"),
                        missing.select("nurse", "id", "randomization"), value_col=None)


def form_with_units(patient_form: DataFrame, units: DataFrame, excluded: DataFrame) -> DataFrame:
    """Full outer join of patient forms and units on patient = id, then
    the exclusions applied again (a unit without a form is kept)."""
    form = anti_filter(patient_form, excluded, "patient", "id")
    u = units.select(F.col("id").alias("_uid"), "nurse", "randomization")
    joined = form.join(u, form.patient == u._uid, "full")
    joined = joined.withColumn("patient", F.coalesce("patient", "_uid")).drop("_uid")
    return anti_filter(joined, excluded, "patient", "id")


def adverse_flags(adverse_form: DataFrame, units: DataFrame, key_cols: Sequence[str] = ("id",)) -> DataFrame:
    """O22 + O36: adverse-event sheet right-joined to the units on the shared
    key; the flag is 1 when any non-key column of the sheet is filled."""
    from tocsin.functions.alarm import any_not_null

    value_cols = [c for c in adverse_form.columns if c not in key_cols]
    joined = adverse_form.join(units, list(key_cols), "right")
    return joined.withColumn("adverseEvent", any_not_null(value_cols))
