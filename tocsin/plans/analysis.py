"""Model fits, ICCs and the results tables over a :class:`Trial` (lifecycle B/C).

Outcome -> model family, as analysed in the trial: the primary outcome
(non-zero units) with a negative binomial random-intercept model; durations
and alarm counts with zero-inflated negative binomial models; desaturation
area with a hurdle log-normal model; adverse events with a logistic model.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.operators import stats
from tocsin.operators.glmm import Fit, coef_frame, fit_models
from tocsin.plans.trial import Trial
from tocsin.session import materialize

FAMILY = {
    "primary": "negative_binomial",
    "duration": "zi_negative_binomial",
    "alarms": "zi_negative_binomial",
    "app_alarms": "zi_negative_binomial",
    "inapp_alarms": "zi_negative_binomial",
    "desat": "hurdle_lognormal",
    "adverse": "binomial",
}

# Outcome labels of the results table, in table order.
RESULT_LABELS = (
    ("duration", "Total alarm duration"),
    ("alarms", "Number of alarms"),
    ("app_alarms", "Number of appropriate alarms"),
    ("inapp_alarms", "Number of inappropriate alarms"),
)
# The slide-deck version of the table has no "Number of alarms" row.
DECK_LABELS = tuple(pair for pair in RESULT_LABELS if pair[0] != "alarms")


def outcome_table(t: Trial, name: str) -> DataFrame:
    if name == "primary":
        return t.primary().filter(F.col("outcome") != 0)
    if name == "duration":
        return t.alarm_duration()
    if name == "alarms":
        return t.alarms("all")
    if name == "app_alarms":
        return t.alarms("appropriate")
    if name == "inapp_alarms":
        return t.alarms("inappropriate")
    if name == "desat":
        return t.desaturation()
    if name == "adverse":
        return t.adverse().withColumnRenamed("adverseEvent", "outcome")
    raise KeyError(name)


# Settings of single models (a cap on the shape, log scale).
SETTINGS = {"app_alarms": {"max_log_phi": 15.0}}


def fits_with_tables(t: Trial, names: Sequence[str]) -> dict[str, tuple[Fit, DataFrame]]:
    """Models and outcome tables of several outcomes: each table is written once and read
    by the fit, the ICC and the residuals; models of one family share their jobs."""
    tables = {n: materialize(outcome_table(t, n), f"outcome-{n}") for n in names}
    done: dict[str, tuple[Fit, DataFrame]] = {}
    for family in sorted({FAMILY[n] for n in names}):
        same = [n for n in names if FAMILY[n] == family]
        caps = [SETTINGS.get(n, {}).get("max_log_phi") for n in same]
        fits = fit_models(t.spark, [tables[n] for n in same], family, max_log_phi=caps)
        done |= {n: (f, tables[n]) for n, f in zip(same, fits)}
    return done


def fit_with_table(t: Trial, name: str) -> tuple[Fit, DataFrame]:
    return fits_with_tables(t, [name])[name]


def fit(t: Trial, name: str) -> Fit:
    return fit_with_table(t, name)[0]


def model_frame(t: Trial, name: str) -> DataFrame:
    """Coefficient table of one outcome's model."""
    return coef_frame(t.spark, fit(t, name), name)


def models_frame(t: Trial, names: Sequence[str]) -> DataFrame:
    """Coefficient tables of several outcomes, fitted together."""
    fits = fits_with_tables(t, names)
    return reduce(DataFrame.unionByName, [coef_frame(t.spark, fits[n][0], n) for n in names])


def icc_of_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(outcome, icc) of each outcome table: REML from the moments, all outcomes
    in the same jobs; adverse events by the stabilised estimator."""
    parts = []
    moments = [stats.icc_components(df).withColumn("outcome", F.lit(n)) for n, df in tables.items() if n != "adverse"]
    if moments:
        parts.append(stats.icc_reml_table(materialize(reduce(DataFrame.unionByName, moments), "icc-moments")))
    if "adverse" in tables:
        counts = stats.icc_binary_counts(tables["adverse"], y="outcome")
        parts.append(stats.icc_binary_estimates(counts).select(F.lit("adverse").alias("outcome"), F.col("stabilised").alias("icc")))
    return reduce(DataFrame.unionByName, parts)


def icc_frame(t: Trial, names=("primary", "duration", "desat", "alarms", "app_alarms", "inapp_alarms", "adverse")) -> DataFrame:
    return icc_of_tables({n: outcome_table(t, n) for n in names})


def effects_frame(t: Trial, *names: str) -> DataFrame:
    """Exponentiated arm effects of the models of some outcomes."""
    fits = fits_with_tables(t, names)
    return reduce(DataFrame.unionByName, [t.spark.createDataFrame(stats.effects(fits[n][0], n)) for n in names])


def results_frame(t: Trial, labels=RESULT_LABELS, all_alarms_from: str = "alarms") -> DataFrame:
    """The alarm-performance table (one row per outcome).

    ``all_alarms_from="app_alarms"`` fills the "Number of alarms" row from the
    appropriate-alarm count, as the original result graph did; the default
    uses the all-alarm count.
    """
    source = {name: all_alarms_from if name == "alarms" else name for name, _ in labels}
    done = fits_with_tables(t, list(dict.fromkeys(source.values())))
    iccs = {r["outcome"]: r["icc"] for r in icc_of_tables({n: table for n, (_, table) in done.items()}).collect()}
    return stats.results_table(t.spark, [(label, stats.effects(done[source[n]][0], source[n]), iccs[source[n]]) for n, label in labels])


def residuals(t: Trial, name: str, kind: str = "subject_specific") -> DataFrame:
    """Quantile residuals of one outcome's model."""
    f, table = fit_with_table(t, name)
    return stats.quantile_residuals(table, f, kind=kind)
