"""Per-patient outcomes (O31-O35) and the zero-share summary.

Each outcome is reduced to one number per unit of analysis
``(id, randomization, nurse)``; all reductions are partial aggregations, so
the per-row work stays in the stage that reads the series.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.alarm import SPO2_THRESHOLD, any_alarm_state, event_accepted
from tocsin.operators.episodes import DAY_SECONDS, episodes_of, pieces, prepare, row_sums, units_of
from tocsin.operators.rows import anti_filter, append_units, right_join_units

UNIT = ["id", "randomization", "nurse"]


def with_state(series: DataFrame, flags=None) -> DataFrame:
    """Add the any-alarm ``state`` column."""
    return series.withColumn("state", any_alarm_state(flags) if flags else any_alarm_state())


def _without(folded: DataFrame, excluded: DataFrame | None, col: str = "_id") -> DataFrame:
    """O16 on folded rows: however long the exclusion list, the series itself doesn't
    move for it.  No series lies across two ids before the fold, so the result is that
    of leaving the rows out first, in either scope."""
    return folded if excluded is None else anti_filter(folded, excluded, col, "id")


def _per_id(ep: DataFrame, value: Column) -> DataFrame:
    """Sum per id; a NULL term makes the id NULL (no NA removal); the unit is
    the one of the first episode end of the id."""
    return ep.groupBy("id").agg(
        F.when(F.max(value.isNull().cast("int")) == 1, F.lit(None))
        .otherwise(F.sum(value)).alias("outcome"),
        F.min_by(F.struct("randomization", "nurse"), F.col("end_order")).alias("_u"),
    ).select("id", F.col("_u.randomization").alias("randomization"), F.col("_u.nurse").alias("nurse"), "outcome")


def seconds_in_alarm(series: DataFrame, units: DataFrame | None, missing: DataFrame | None, *, end: str,
                     answered_events: str = "any", scope: str = "series",
                     chunk_seconds: int = DAY_SECONDS, flags=None, excluded: DataFrame | None = None) -> DataFrame:
    """O31 (``end="answered"``) and O32 (``end="clear"``).

    Seconds from alarm start to its first end, summed per id, credited to the
    unit of the id's first episode; every other unit gets 0; missing units
    are appended with 0.  ``units=None`` takes the units of ``series`` from
    the same shuffled rows as the episodes (one exchange of the series).
    Patients ``excluded`` (id) are left out once their rows are folded.
    """
    state = any_alarm_state(flags) if flags else any_alarm_state()
    answered = event_accepted(F.col("event"), answered_events)
    pcs = _without(pieces(prepare(series, state, answered, chunk_seconds=chunk_seconds), scope), excluded)
    if units is None:
        units = units_of(pcs)
    ep = episodes_of(pcs, end=end, scope=scope)
    per_id = _per_id(ep, F.col("duration"))
    out = right_join_units(per_id, units, "outcome", 0).select(*UNIT, F.col("outcome").cast("long").alias("outcome"))
    if missing is not None:
        out = append_units(out, missing.select(*UNIT), "outcome", 0)
    return out


def event_alarm_count(series: DataFrame, missing: DataFrame | None, vocabulary: str, flags=None,
                      excluded: DataFrame | None = None) -> DataFrame:
    """Alarm rows carrying an accepted event, summed per id and repeated
    on each (id, nurse) unit (arm of the unit's first row)."""
    state = any_alarm_state(flags) if flags else any_alarm_state()
    hit = F.when((state == 1) & event_accepted(F.col("event"), vocabulary), 1).otherwise(0)
    # Hash aggregates over the rows; the unit's arm is picked from their few results.
    per_arm = series.groupBy("id", "nurse", "randomization").agg(F.sum(hit).alias("_n"), F.min("datetime").alias("_first"))
    per_arm = _without(per_arm, excluded, "id")
    per_unit = per_arm.groupBy("id", "nurse").agg(
        F.sum("_n").alias("_n"), F.min(F.struct("_first", "randomization"))["randomization"].alias("randomization"))
    out = per_unit.withColumn("outcome", F.sum("_n").over(Window.partitionBy("id")).cast("long"))
    out = out.select(*UNIT, "outcome")
    if missing is not None:
        out = append_units(out, missing.select(*UNIT), "outcome", 0)
    return out


def desaturation_area(series: DataFrame, units: DataFrame | None, *, sample: str = "episode_end",
                      threshold: int = SPO2_THRESHOLD, scope: str = "series", chunk_seconds: int = DAY_SECONDS,
                      flags=None, excluded: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Sum of (threshold - SpO2) where SpO2 is below the threshold.

    ``sample="episode_end"`` sums over the rows that end an alarm episode (as
    the outcome code does); ``sample="every_row"`` sums over every second of
    the series (as the outcome text says).  NULL SpO2 adds nothing.  The unit
    credited is the one of the id's first episode end (``episode_end``) or of
    the id's first row (``every_row``); other units get 0.  Missing units are
    not appended.

    ``columns`` of the series (``episode_end`` only) come along from the row of the
    credited unit, the first episode end, with the episode's ``alarm_start``, ``alarm_end``
    and ``duration``: that row is fetched by id and time after the aggregate, so the fold
    carries no more than it needs.
    """
    if columns and sample != "episode_end":
        raise ValueError("columns come from the episode's end row")
    t = F.lit(threshold)
    state = any_alarm_state(flags) if flags else any_alarm_state()
    # Integer SpO2 gives an exact integer area; a fractional reading keeps its fraction.
    from pyspark.sql.types import IntegralType
    kind = "long" if isinstance(series.schema["spo2"].dataType, IntegralType) else "double"
    area_row = F.when(F.col("spo2") < t, t - F.col("spo2")).otherwise(0)
    pcs = _without(pieces(prepare(series, state, None, chunk_seconds=chunk_seconds, measure="spo2",
                                  row_value=area_row.cast(kind)), scope), excluded)
    episode = ["alarm_start", "alarm_end", "duration"] if columns else []
    if units is None:
        units = units_of(pcs)
    if sample == "episode_end":
        ep = episodes_of(pcs, end="clear", scope=scope, measure="spo2")
        area = F.when(F.col("spo2") < t, t - F.col("spo2")).otherwise(F.when(F.col("spo2").isNotNull(), 0))
        per_id = ep.groupBy("id").agg(
            F.coalesce(F.sum(area), F.lit(0)).alias("outcome"),
            F.min_by(F.struct("randomization", "nurse", *episode), F.col("end_order")).alias("_u"))
    elif sample == "every_row":
        per_id = row_sums(pcs).select("id", F.coalesce("vsum", F.lit(0)).alias("outcome"), F.col("first_p").alias("_u"))
    else:
        raise ValueError(f"unknown sample {sample!r}")
    per_id = per_id.select("id", F.col("_u.randomization").alias("randomization"),
                           F.col("_u.nurse").alias("nurse"), "outcome", *[F.col("_u")[c].alias(c) for c in episode])
    if columns:
        rows = series.select(F.col("id").alias("_rid"), F.col("datetime").alias("_at"), *columns)
        per_id = per_id.join(rows, (F.col("id") == F.col("_rid")) & (F.col("alarm_end") == F.col("_at")), "left").drop("_rid", "_at")
    out = right_join_units(per_id, units, "outcome", 0)
    return out.select(*UNIT, F.col("outcome").cast(kind).alias("outcome"), *episode, *columns)


def zero_share(outcome: DataFrame) -> DataFrame:
    """Patients with zero / non-zero outcome per arm and their share."""
    zero = F.when(F.col("outcome") == 0, "Zero").otherwise("Not zero")
    counts = outcome.groupBy("randomization", zero.alias("zero")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("randomization"))
    return counts.withColumn("share", F.col("n") / total)


def nonzero(outcome: DataFrame) -> DataFrame:
    """O33 (dot figure data): units with a non-zero outcome."""
    return outcome.filter(F.col("outcome") != 0)
