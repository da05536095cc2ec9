"""Alarm-state and event-vocabulary column expressions."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ten monitor alarm flags that make up the any-alarm state,
# in the order the outcome code tests them.
ALARM_FLAGS = (
    "pulseRateLow",
    "pulseRateHigh",
    "respRateLow",
    "respRateHigh",
    "noBreath",
    "spo2Low",
    "spo2High",
    "etco2Low",
    "etco2High",
    "ipiLow",
)

# Observer event labels with a special meaning.
EVENT_ALARM_SILENCED = "Alarm silenced"
EVENT_FIX_EQUIPMENT = "Fix equipment"

# SpO2 desaturation threshold (percent).
SPO2_THRESHOLD = 90


def any_alarm_state(flags: Sequence[str] = ALARM_FLAGS) -> Column:
    """1 when any flag equals 1, else 0.  A NULL flag counts as not set."""
    cond = reduce(lambda a, b: a | b, [F.col(f) == 1 for f in flags])
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def event_accepted(event: Column, vocabulary: str) -> Column:
    """Whether a logged event counts for an alarm-count vocabulary.

    ``all`` drops "Fix equipment"; ``appropriate`` also drops "Alarm silenced";
    ``inappropriate`` keeps only "Alarm silenced"; ``any`` keeps every event.
    NULL events never count.
    """
    if vocabulary == "all":
        cond = event != F.lit(EVENT_FIX_EQUIPMENT)
    elif vocabulary == "appropriate":
        cond = ~event.isin(EVENT_FIX_EQUIPMENT, EVENT_ALARM_SILENCED)
    elif vocabulary == "inappropriate":
        cond = event == F.lit(EVENT_ALARM_SILENCED)
    elif vocabulary == "any":
        cond = event.isNotNull()
    else:
        raise ValueError(f"unknown event vocabulary {vocabulary!r}")
    return event.isNotNull() & F.coalesce(cond, F.lit(False))


def any_not_null(cols: Iterable[str]) -> Column:
    """1 if any of the columns holds a value, else 0 (``if_any(!is.na)``)."""
    cols = list(cols)
    if not cols:
        return F.lit(0)
    cond = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))
