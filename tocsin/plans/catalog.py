"""Registry of driver queries (Spark) and their DuckDB oracles."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.plans import oracle as O
from tocsin.operators.rows import sort_by_cluster
from tocsin.plans.trial import Trial
from tocsin.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Trial], DataFrame]) -> Callable[[Trial], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(Trial.from_testdata(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _epoch(c: str):
    return F.unix_seconds(F.col(c)).alias(c)


# -- O26-O30: state and episodes -------------------------------------------

@register("any_alarm_state", O._with(O.BASE) + f"SELECT id, CAST(epoch(datetime) AS BIGINT) AS datetime, {O.STATE_SQL} AS state FROM series")
def _any_alarm_state(t: Trial) -> DataFrame:
    """Any-alarm state per series row."""
    return t.state().select("id", _epoch("datetime"), "state")


def _episode_cols(df: DataFrame) -> DataFrame:
    return df.select("id", _epoch("alarm_start"), _epoch("alarm_end"), "duration", "randomization", "nurse")


@register("episodes_series", O.episodes_sql(O.CLEAR))
def _episodes_series(t: Trial) -> DataFrame:
    """Episodes ending when the alarm clears (series scope)."""
    return _episode_cols(t.episodes("clear"))


@register("episodes_answered", O.episodes_sql(O.ANSWERED))
def _episodes_answered(t: Trial) -> DataFrame:
    """Episodes ending when cleared or answered."""
    return _episode_cols(t.episodes("answered"))


@register("episodes_dataset", O.episodes_sql(O.CLEAR, O.WALK_DATASET))
def _episodes_dataset(t: Trial) -> DataFrame:
    """O27-O30 parity mode: one walk over all series in id order."""
    return _episode_cols(t.episodes("clear", scope="dataset"))


@register("episodes_answered_dataset", O.episodes_sql(O.ANSWERED, O.WALK_DATASET))
def _episodes_answered_dataset(t: Trial) -> DataFrame:
    """O29-O30 parity mode."""
    return _episode_cols(t.episodes("answered", scope="dataset"))


# -- O31-O36: outcomes -----------------------------------------------------

@register("primary_outcome", O.seconds_in_alarm_sql(O.ANSWERED))
def _primary(t: Trial) -> DataFrame:
    """Seconds in alarm until the first response, per unit."""
    return sort_by_cluster(t.primary())


@register("primary_outcome_dataset", O.seconds_in_alarm_sql(O.ANSWERED, walk=O.WALK_DATASET))
def _primary_dataset(t: Trial) -> DataFrame:
    """O31 parity mode: NULL-start rule (an id with an unknown start scores 0)."""
    return sort_by_cluster(t.primary(scope="dataset"))


@register("alarm_duration_dataset", O.seconds_in_alarm_sql(O.CLEAR, walk=O.WALK_DATASET))
def _duration_dataset(t: Trial) -> DataFrame:
    """O32 parity mode."""
    return sort_by_cluster(t.alarm_duration(scope="dataset"))


@register("alarm_duration", O.seconds_in_alarm_sql(O.CLEAR))
def _duration(t: Trial) -> DataFrame:
    """Total seconds in alarm, per unit."""
    return sort_by_cluster(t.alarm_duration())


@register("zero_share", O.zero_share_sql())
def _zero_share(t: Trial) -> DataFrame:
    """Zero / non-zero primary outcome per arm."""
    from tocsin.operators.outcomes import zero_share
    return zero_share(t.primary())


@register("nonzero_primary", f"WITH p AS ({O.seconds_in_alarm_sql(O.ANSWERED)}) SELECT * FROM p WHERE outcome <> 0")
def _nonzero(t: Trial) -> DataFrame:
    """Units with a non-zero primary outcome."""
    from tocsin.operators.outcomes import nonzero
    return nonzero(t.primary())


@register("alarms_all", O.alarms_sql("event <> 'Fix equipment'"))
def _alarms_all(t: Trial) -> DataFrame:
    """Alarm seconds with an event other than fixing equipment."""
    return sort_by_cluster(t.alarms("all"))


@register("alarms_appropriate", O.alarms_sql("event NOT IN ('Fix equipment', 'Alarm silenced')"))
def _alarms_app(t: Trial) -> DataFrame:
    """Alarm seconds answered by an intervention."""
    return sort_by_cluster(t.alarms("appropriate"))


@register("alarms_inappropriate", O.alarms_sql("event = 'Alarm silenced'"))
def _alarms_inapp(t: Trial) -> DataFrame:
    """Alarm seconds dismissed by silencing."""
    return sort_by_cluster(t.alarms("inappropriate"))


@register("desat_area_episode", O.desat_episode_sql())
def _desat_ep(t: Trial) -> DataFrame:
    """Desaturation area over episode-end rows."""
    return sort_by_cluster(t.desaturation("episode_end"))


@register("desat_area_rows", O.desat_rows_sql())
def _desat_rows(t: Trial) -> DataFrame:
    """Desaturation area over every second."""
    return sort_by_cluster(t.desaturation("every_row"))


_KEPT = ["line", "spo2", "spo2Low", "respRateHigh", "noBreath", "ipiLow", "pulseRateHigh", "event"]


@register("desat_area_columns", O.desat_columns_sql(_KEPT))
def _desat_columns(t: Trial) -> DataFrame:
    """O35 with the columns that the area's row keeps: its episode and the series' own."""
    out = t.desaturation(columns=_KEPT)
    return out.select("id", "randomization", "nurse", "outcome", _epoch("alarm_start"), _epoch("alarm_end"), "duration", *_KEPT)


@register("adverse_flag", O.adverse_sql())
def _adverse(t: Trial) -> DataFrame:
    """Adverse-event flag per unit."""
    return t.adverse()


# -- O15-O25, O37: cohort, joins, unit lists --------------------------------

@register("exclusions", O._with(O.BASE) + "SELECT id FROM excl")
def _exclusions(t: Trial) -> DataFrame:
    """Patients without sedation (minus overrides)."""
    return t.excluded()


@register("anti_filter", O._with(O.BASE) + "SELECT id, count(*) AS n FROM ds GROUP BY id")
def _anti(t: Trial) -> DataFrame:
    """Series rows per id after removing excluded patients."""
    return t.analysed().groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@register("units", O._with(O.BASE) + "SELECT id, randomization, nurse FROM units")
def _units(t: Trial) -> DataFrame:
    """Distinct units of analysis (a hand-over gives two)."""
    return t.units()


@register("first_row", O._with(O.BASE) + (
    "SELECT id, CAST(epoch(datetime) AS BIGINT) AS datetime, nurse, randomization FROM series "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY datetime) = 1"))
def _first_row(t: Trial) -> DataFrame:
    """First row per id."""
    return t.first_rows().select("id", _epoch("datetime"), "nurse", "randomization")


@register("units_right_join", O.seconds_in_alarm_sql(O.CLEAR, with_missing=False))
def _units_right(t: Trial) -> DataFrame:
    """Per-id outcome right-joined to all units (NULL-safe keys)."""
    return sort_by_cluster(t.alarm_duration(with_missing=False))


@register("nurse_right_join", O._with(O.BASE, O.NURSE_UNITS) + "SELECT nurse, id, randomization FROM nu")
def _nurse_right(t: Trial) -> DataFrame:
    """First unit per id right-joined to the nurse list, plus missing units."""
    return t.nurse_units()


@register("form_full_join", O.form_units_sql())
def _form_full(t: Trial) -> DataFrame:
    """Patient forms full-joined to the unit list, exclusions re-applied."""
    return t.form_units()


@register("append_units", O._with(O.BASE, fr=O.FIRST_PER_ID) + (
    "SELECT nurse, id, randomization FROM fr UNION ALL SELECT nurse, id, randomization FROM missing"))
def _append(t: Trial) -> DataFrame:
    """First unit per id with the missing units appended."""
    from tocsin.operators.rows import append_units
    fr = t.first_rows().select("nurse", "id", "randomization")
    return append_units(fr, t.missing().select("nurse", "id", "randomization"), value_col=None)


@register("cluster_size_randomized", O.cluster_size_sql(False))
def _cs_rand(t: Trial) -> DataFrame:
    """Patients per cluster as randomized."""
    return t.cluster_sizes(analysed=False)


@register("cluster_size_analyzed", O.cluster_size_sql(True))
def _cs_anal(t: Trial) -> DataFrame:
    """Patients per cluster as analysed."""
    return t.cluster_sizes(analysed=True)


# -- O07-O14: ingest ------------------------------------------------------

def _sheets(spark: SparkSession, sf_dir: str):
    """Fixture observer sheets; the series and clock plan they derive from
    are built once per query and kept (memory and disk) for the three sheets."""
    from tocsin.plans.ingest import ObserverSheets
    from tocsin.session import keep
    from tocsin.sources import fixtures as fx
    s = keep(fx.series(spark, sf_dir).select("id", "datetime", "nurse", "event", "line"))
    plan = keep(fx.clock_plan(s))
    return ObserverSheets(sync=fx.sync_sheet(spark, sf_dir, plan), nurse=fx.nurse_sheet(spark, sf_dir, s, plan),
                          interventions=fx.intervention_sheet(spark, sf_dir, s, plan))


def register_raw(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


_PLAN = O._with(O.BASE, plan=__import__("tocsin.sources.fixtures", fromlist=["x"]).SQL_CLOCK_PLAN)
_EXP = __import__("tocsin.sources.fixtures", fromlist=["x"]).SQL_EXPECTED_DIFF


@register_raw("clock_pairs", _PLAN + (
    "SELECT id, 1 AS sync, CAST(epoch(t1) AS BIGINT) AS Capnostream, CAST(epoch(t1) AS BIGINT) + d1 AS ipad, "
    "CAST(d1 AS BIGINT) AS diff FROM plan UNION ALL "
    "SELECT id, 2, CAST(epoch(cap2) AS BIGINT), CAST(epoch(cap2) AS BIGINT) + d2, CAST(d2 AS BIGINT) FROM plan "
    "WHERE cap2 IS NOT NULL"))
def _clock_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed sync readings paired per device, offset in seconds."""
    from tocsin.operators.clock import clock_pairs
    p = clock_pairs(_sheets(spark, sf_dir).sync_readings())
    return p.select("id", F.col("sync").cast("int").alias("sync"), _epoch("Capnostream"), _epoch("ipad"), "diff")


@register_raw("clock_fill", _PLAN + (
    f"SELECT s.id, CAST(epoch(s.datetime) AS BIGINT) AS datetime, CAST({_EXP} AS BIGINT) AS diff, "
    f"CAST(epoch(s.datetime) AS BIGINT) + {_EXP} AS time_corrected FROM series s JOIN plan p USING (id)"))
def _clock_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock offset carried over the rows (exact-second matching)."""
    from tocsin.operators.clock import clock_fill, clock_pairs
    from tocsin.plans.ingest import dedup
    from tocsin.sources import fixtures as fx
    rows = dedup(fx.monitor_rows(spark, sf_dir)).select("id", "datetime")
    out = clock_fill(rows, clock_pairs(_sheets(spark, sf_dir).sync_readings()))
    return out.select("id", _epoch("datetime"), "diff", _epoch("time_corrected"))


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tocsin.plans.ingest import ingest
    from tocsin.sources import fixtures as fx, literals
    return ingest(fx.monitor_rows(spark, sf_dir), _sheets(spark, sf_dir), literals.allocation(spark))


@register_raw("nurse_fill", O._with(O.BASE) + "SELECT id, CAST(epoch(datetime) AS BIGINT) AS datetime, nurse FROM series")
def _nurse_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nurse carried over the rows from the nurse log (tablet clock)."""
    return _ingested(spark, sf_dir).select("id", _epoch("datetime"), "nurse")


@register_raw("event_attach", O._with(O.BASE) + "SELECT id, CAST(epoch(datetime) AS BIGINT) AS datetime, event FROM series")
def _event_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interventions attached at their exact tablet second."""
    return _ingested(spark, sf_dir).select("id", _epoch("datetime"), "event")


@register_raw("one_row_per_tick", O._with(O.BASE) + "SELECT id, CAST(epoch(datetime) AS BIGINT) AS datetime, line FROM series")
def _one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (id, second), first line kept."""
    from tocsin.plans.ingest import dedup
    from tocsin.sources import fixtures as fx
    return dedup(fx.monitor_rows(spark, sf_dir)).select("id", _epoch("datetime"), "line")


@register_raw("arm_lookup", O._with(O.BASE) + (
    "SELECT id, CAST(epoch(datetime) AS BIGINT) AS datetime, nurse, randomization FROM series"))
def _arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arm of the row's nurse (unknown nurse -> NULL)."""
    return _ingested(spark, sf_dir).select("id", _epoch("datetime"), "nurse", "randomization")


_SERIES_COLS = ["id", "line", "spo2", "spo2Low", "spo2High", "respRateLow", "respRateHigh", "noBreath", "ipiLow",
                "pulseRateHigh", "pulseRateLow", "etco2Low", "etco2High", "event", "nurse", "randomization"]


@register_raw("ingest_series", _PLAN + (
    "SELECT " + ", ".join("s." + c for c in _SERIES_COLS) + ", CAST(epoch(s.datetime) AS BIGINT) AS datetime, "
    f"CAST(epoch(s.datetime) AS BIGINT) + {_EXP} AS time_corrected FROM series s JOIN plan p USING (id)"))
def _ingest_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O07-O14 chained: device rows + observer sheets -> series."""
    return _ingested(spark, sf_dir).select(*_SERIES_COLS, _epoch("datetime"), _epoch("time_corrected"))


# -- O47-O49: data-quality checks -------------------------------------------

def _fx():
    from tocsin.sources import fixtures
    return fixtures


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tocsin.operators.clock import clock_pairs
    return clock_pairs(_sheets(spark, sf_dir).sync_readings())


_CHECK_VIEWS = dict(
    plan=_fx().SQL_CLOCK_PLAN,
    files="SELECT DISTINCT id FROM series",
    sync_n="SELECT id, CASE WHEN cap2 IS NOT NULL THEN 4 ELSE 2 END AS n FROM plan",
    nurse_n="SELECT id, count(DISTINCT nurse) + CASE WHEN CAST(substr(id, 2) AS BIGINT) % 4 = 0 THEN 3 ELSE 0 END AS n "
            "FROM series WHERE nurse IS NOT NULL GROUP BY id",
    int_n="SELECT id, count(*) AS n FROM series WHERE event IS NOT NULL GROUP BY id",
    adv_n="SELECT id, count(*) AS n FROM adverse_form GROUP BY id",
    c="SELECT f.id, 'sync_rows' AS chk, coalesce(s.n, 0) AS observed, 2 AS expected FROM files f LEFT JOIN sync_n s USING (id) "
      "UNION ALL SELECT f.id, 'nurse_rows', coalesce(s.n, 0), 1 FROM files f LEFT JOIN nurse_n s USING (id) "
      "UNION ALL SELECT f.id, 'intervention_rows', coalesce(s.n, 0), 0 FROM files f LEFT JOIN int_n s USING (id) "
      "UNION ALL SELECT f.id, 'adverse_rows', coalesce(s.n, 0), 1 FROM files f LEFT JOIN adv_n s USING (id)",
    pairs="SELECT id, t1 AS cap, t1 + to_seconds(d1) AS ipad, d1 AS diff FROM plan "
          "UNION ALL SELECT id, cap2, cap2 + to_seconds(d2), d2 FROM plan WHERE cap2 IS NOT NULL",
)


@register_raw("check_counts", O._with(O.BASE, _CHECK_VIEWS) + (
    'SELECT id, chk AS "check", CAST(observed AS DOUBLE) AS observed, CAST(expected AS DOUBLE) AS expected '
    "FROM c WHERE observed <> expected"))
def _check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks whose sheets do not hold the expected number of rows."""
    from tocsin.operators.quality import row_count_checks, tagged
    fx, sheets = _fx(), _sheets(spark, sf_dir)
    return row_count_checks(fx.series(spark, sf_dir).select("id").distinct(), tagged(_checked_sheets(spark, sf_dir, sheets)))


def _checked_sheets(spark: SparkSession, sf_dir: str, sheets) -> dict[str, DataFrame]:
    return {"sync_rows": sheets.sync, "nurse_rows": sheets.nurse, "intervention_rows": sheets.interventions,
            "adverse_rows": _fx().adverse_form(spark, sf_dir)}


@register_raw("check_same_day", O._with(O.BASE, _CHECK_VIEWS) + (
    "SELECT id, 'sync_not_same_day' AS \"check\", CAST(count(*) AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS expected "
    "FROM pairs WHERE CAST(ipad AS DATE) <> CAST(cap AS DATE) GROUP BY id"))
def _check_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock pairs read on different days."""
    from tocsin.operators.quality import same_day_check
    return same_day_check(_pairs(spark, sf_dir))


@register_raw("check_gap", O._with(O.BASE, _CHECK_VIEWS) + (
    "SELECT id, 'sync_gap_over_limit' AS \"check\", diff / 60.0 AS observed, CAST(5 AS DOUBLE) AS expected "
    "FROM pairs WHERE diff / 60.0 > 5"))
def _check_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock pairs more than five minutes apart (tablet ahead)."""
    from tocsin.operators.quality import gap_check
    return gap_check(_pairs(spark, sf_dir))


# -- O38: baseline table ------------------------------------------------------

# Fixed values for the fixture: procedure groups over the part names.
FIXTURE_PROCEDURE_RULES = (("ring", "Ring"), ("widget", "Widget"), ("bolt", "Bolt"), ("gear", "Gear"))


def _proc_sql(col: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({col}, '(?i){p}') THEN '{label}'" for p, label in FIXTURE_PROCEDURE_RULES)
    return f"CASE {whens} ELSE 'Other' END"


def _baseline_sql(tail: str) -> str:
    body = O.form_units_sql()
    return (f"WITH fu AS ({body}), bf AS (SELECT age, sex, totalMidaz, totalFent, oxygenDevice, "
            "(epoch(strptime(caseEnd, '%m/%d/%Y %H:%M:%S')) - epoch(strptime(caseStart, '%m/%d/%Y %H:%M:%S'))) / 60.0 AS duration, "
            f"randomization, {_proc_sql('\"procedure\"')} AS \"procedure\" FROM fu) " + tail)


_CONT_TAIL = ("SELECT randomization, variable, count(value) AS n, quantile_cont(value, 0.25) AS p25, "
              "quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75 FROM ("
              + " UNION ALL ".join(f"SELECT randomization, '{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM bf"
                                   for v in ("age", "totalMidaz", "totalFent", "duration"))
              + ") WHERE randomization IS NOT NULL AND value IS NOT NULL GROUP BY randomization, variable")
_CAT_TAIL = ("SELECT randomization, variable, level, count(*) AS n, "
             "count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY randomization, variable) AS pct FROM ("
             + " UNION ALL ".join(f"SELECT randomization, '{v}' AS variable, CAST(\"{v}\" AS VARCHAR) AS level FROM bf"
                                  for v in ("sex", "oxygenDevice", "procedure"))
             + ") WHERE randomization IS NOT NULL AND level IS NOT NULL GROUP BY randomization, variable, level")


@register("baseline_continuous", _baseline_sql(_CONT_TAIL))
def _baseline_cont(t: Trial) -> DataFrame:
    """Continuous characteristics by arm (n, quartiles)."""
    from tocsin.operators.summary import baseline_frame, continuous_summary
    return continuous_summary(baseline_frame(t.form_units(), FIXTURE_PROCEDURE_RULES))


@register("baseline_categorical", _baseline_sql(_CAT_TAIL))
def _baseline_cat(t: Trial) -> DataFrame:
    """Categorical characteristics by arm (n, percent)."""
    from tocsin.operators.summary import baseline_frame, categorical_summary
    return categorical_summary(baseline_frame(t.form_units(), FIXTURE_PROCEDURE_RULES))


@register("procedure_group", O._with(O.BASE) + (
    f"SELECT patient, {_proc_sql('\"procedure\"')} AS procedure_group FROM patient_form"))
def _procedure_group(t: Trial) -> DataFrame:
    """Ordered case-insensitive procedure grouping."""
    from tocsin.operators.summary import procedure_group
    return t.patient_form().select("patient", procedure_group(F.col("procedure"), FIXTURE_PROCEDURE_RULES)
                                   .alias("procedure_group"))


# -- O39-O46: statistics ------------------------------------------------------

@register("icc_components", f"WITH d AS ({O.seconds_in_alarm_sql(O.CLEAR)}) " + (
    "SELECT nurse AS cluster, count(*) AS n, round(avg(outcome), 4) AS mean, round(stddev_pop(outcome), 4) AS sd "
    "FROM d WHERE nurse IS NOT NULL GROUP BY nurse"))
def _icc_components(t: Trial) -> DataFrame:
    """Per-cluster moments (total alarm duration), rounded."""
    from tocsin.operators.stats import icc_components
    return _rounded_moments(icc_components(t.alarm_duration()))


def _rounded_moments(df: DataFrame) -> DataFrame:
    return df.select("cluster", "n", F.round("mean", 4).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 4).alias("sd"))


@register("icc_components_desat", f"WITH d AS ({O.desat_episode_sql()}) " + (
    "SELECT nurse AS cluster, count(*) AS n, round(avg(outcome), 4) AS mean, round(stddev_pop(outcome), 4) AS sd "
    "FROM d WHERE nurse IS NOT NULL GROUP BY nurse"))
def _icc_components_desat(t: Trial) -> DataFrame:
    """Per-cluster moments of a fractional outcome (desaturation area), rounded."""
    from tocsin.operators.stats import icc_components
    return _rounded_moments(icc_components(t.desaturation()))


@register("icc_binary_counts", f"WITH a AS ({O.adverse_sql()}) " + (
    "SELECT nurse AS cluster, count(*) AS n, CAST(sum(adverseEvent) AS BIGINT) AS y FROM a "
    "WHERE nurse IS NOT NULL GROUP BY nurse"))
def _icc_binary(t: Trial) -> DataFrame:
    """Per-cluster units and adverse events."""
    from tocsin.operators.stats import icc_binary_counts
    return icc_binary_counts(t.adverse())


@register("glmm_likelihood_cells", f"WITH p AS ({O.seconds_in_alarm_sql(O.ANSWERED)}) " + (
    "SELECT nurse AS cluster, CASE WHEN randomization = 'IPI enabled' THEN 1 ELSE 0 END AS x, "
    "CAST(outcome AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS c FROM p "
    "WHERE outcome <> 0 AND nurse IS NOT NULL AND randomization IS NOT NULL GROUP BY ALL"))
def _cells(t: Trial) -> DataFrame:
    """Collapsed sufficient table of the primary-outcome model."""
    from tocsin.operators.glmm import collapse_cells
    return collapse_cells(t.primary().filter(F.col("outcome") != 0))


def _register_likelihoods() -> None:
    """The likelihood of each family at fixed parameters."""
    from tocsin.plans import likelihood as L

    for name, outcome_sql in L.OUTCOME_SQL.items():
        def run(t: Trial, name: str = name) -> DataFrame:
            return L.loglik(t, name)
        run.__doc__ = f"O41-O43: marginal log likelihood of the model of outcome {name} at fixed parameters."
        if name in L.AT:
            register(f"loglik_{name}", L.loglik_sql(name, outcome_sql))(run)

    for name in L.RESIDUALS_AT:
        def residuals(t: Trial, name: str = name) -> DataFrame:
            return L.residuals_at(t, name)
        residuals.__doc__ = f"O44: quantile residuals of the model of outcome {name} at fixed parameters."
        register(f"residuals_at_{name}", L.residuals_sql(name))(residuals)

    names = {"duration": "duration", "desat": "desat", "alarms": "alarms", "primary": "primary"}

    def reml(t: Trial) -> DataFrame:
        """REML intra-cluster correlations of four outcomes in the same jobs, rounded."""
        from tocsin.plans.analysis import icc_frame
        return icc_frame(t, tuple(names)).select("outcome", F.round("icc", 4).alias("icc"))
    register("icc_reml", L.reml_sql({n: L.OUTCOME_SQL[n] for n in names}))(reml)


_register_likelihoods()


@register("icc_adverse", f"WITH a AS ({O.adverse_sql()}), " + (
    "c AS (SELECT nurse, count(*) AS n, sum(adverseEvent) AS y FROM a WHERE nurse IS NOT NULL GROUP BY nurse), "
    "s AS (SELECT count(*) AS k, sum(n) AS units, sum(y) AS events, sum(n * n) AS squares FROM c), "
    "e AS (SELECT s.*, events / units AS p, (units - squares / units) / (k - 1) AS size, "
    "(SELECT sum(n / s.units * (y / n - s.events / s.units) ** 2) FROM c) AS spread, "
    "(SELECT sum(n * (y / n - s.events / s.units) ** 2) FROM c) / (k - 1) AS msb, "
    "(SELECT sum(y * (1 - y / n) ** 2 + (n - y) * (y / n) ** 2) FROM c) / (units - k) AS msw FROM s), "
    "r AS (SELECT *, (units * spread / ((k - 1) * p * (1 - p)) + 0.45 - 1) / (size - 1) AS stab FROM e) "
    "SELECT round(CASE WHEN stab BETWEEN 0 AND 1 THEN stab END, 6) AS stabilised, "
    "round((msb - msw) / (msb + (size - 1) * msw), 6) AS anova FROM r"))
def _icc_adverse(t: Trial) -> DataFrame:
    """Stabilised and analysis-of-variance ICC of the adverse-event flag, rounded."""
    from tocsin.operators.stats import icc_binary_counts, icc_binary_estimates
    found = icc_binary_estimates(icc_binary_counts(t.adverse()))
    return found.select(F.round("stabilised", 6).alias("stabilised"), F.round("anova", 6).alias("anova"))


@register("icc_table")
def _icc_table(t: Trial) -> DataFrame:
    """ICC of every outcome (REML; binary: stabilised estimator)."""
    from tocsin.plans.analysis import icc_frame
    return icc_frame(t)


@register("nb_model_primary")
def _nb_primary(t: Trial) -> DataFrame:
    """Negative binomial random-intercept model, non-zero primary outcome."""
    from tocsin.plans.analysis import model_frame
    return model_frame(t, "primary")


@register("zinb_model_duration")
def _zinb_duration(t: Trial) -> DataFrame:
    """Zero-inflated NB model, total alarm duration."""
    from tocsin.plans.analysis import model_frame
    return model_frame(t, "duration")


@register("zinb_models_alarms")
def _zinb_alarms(t: Trial) -> DataFrame:
    """Zero-inflated NB models of all, appropriate and inappropriate alarms, fitted
    in the same jobs."""
    from tocsin.plans.analysis import models_frame
    return models_frame(t, ["alarms", "app_alarms", "inapp_alarms"])


@register("results_table")
def _results(t: Trial) -> DataFrame:
    """Alarm performance: effects of four zero-inflated models, intervals, ICC."""
    from tocsin.plans.analysis import results_frame
    return results_frame(t)


_CRUDE = {"duration": ("Total alarm duration", O.seconds_in_alarm_sql(O.CLEAR)),
          "alarms": ("Number of alarms", O.alarms_sql("event <> 'Fix equipment'"))}


def _crude_sql() -> str:
    units = " UNION ALL ".join(f"SELECT '{label}' AS name, randomization, CAST(outcome AS DOUBLE) AS y FROM ({sql})" for label, sql in _CRUDE.values())
    arm = lambda f, a: f"{f} FILTER (WHERE randomization = 'IPI {a}')"
    span = "round({0} * exp(-1.959963984540054 * {1}), 2) || ' to ' || round({0} * exp(1.959963984540054 * {1}), 2)"
    return (f"WITH u AS ({units}), a AS (SELECT name, " + ", ".join(
        f"{arm('count(*)', a)} AS n{k}, {arm('avg(y)', a)} AS m{k}, {arm('var_pop(y)', a)} AS v{k}, {arm('sum(CASE WHEN y = 0 THEN 1 ELSE 0 END)', a)} AS z{k}"
        for k, a in enumerate(("disabled", "enabled"))) + " FROM u GROUP BY name), "
        "e AS (SELECT name, m1 / m0 AS irr, sqrt(v0 / (n0 * m0 * m0) + v1 / (n1 * m1 * m1)) AS s, "
        "((z1 + 0.5) / (n1 - z1 + 0.5)) / ((z0 + 0.5) / (n0 - z0 + 0.5)) AS odds, "
        "sqrt(1 / (z1 + 0.5) + 1 / (n1 - z1 + 0.5) + 1 / (z0 + 0.5) + 1 / (n0 - z0 + 0.5)) AS t FROM a) "
        f"SELECT name AS \"Outcome\", round(irr, 6) AS \"IRR\", {span.format('irr', 's')} AS \"NB_95_CI\", round(odds, 6) AS \"OR\", {span.format('odds', 't')} AS \"CI_95\" FROM e")


@register("results_crude", _crude_sql())
def _results_crude(t: Trial) -> DataFrame:
    """O46's text over effects without a model: ratios of means and odds of a zero, by arm."""
    from tocsin.operators.stats import crude_effects, formatted_results
    from tocsin.plans.analysis import outcome_table
    tables = [outcome_table(t, n).withColumn("name", F.lit(label)) for n, (label, _) in _CRUDE.items()]
    found = formatted_results(crude_effects(tables[0].unionByName(tables[1]), "name"))
    return found.select("Outcome", F.round("IRR", 6).alias("IRR"), "NB_95_CI", F.round("OR", 6).alias("OR"), "CI_95")


@register("hurdle_model_desat")
def _hurdle(t: Trial) -> DataFrame:
    """Hurdle log-normal model, desaturation area."""
    from tocsin.plans.analysis import model_frame
    return model_frame(t, "desat")


@register("logistic_model_adverse")
def _logistic(t: Trial) -> DataFrame:
    """Logistic random-intercept model, adverse events."""
    from tocsin.plans.analysis import model_frame
    return model_frame(t, "adverse")


@register("effects_primary")
def _effects(t: Trial) -> DataFrame:
    """Rate ratio of the primary outcome with 95 % interval."""
    from tocsin.plans.analysis import effects_frame
    return effects_frame(t, "primary")


@register("residuals_primary")
def _residuals(t: Trial) -> DataFrame:
    """Quantile residuals of the primary model."""
    from tocsin.plans.analysis import residuals
    return residuals(t, "primary")


@register("residual_qq_primary")
def _residual_qq(t: Trial) -> DataFrame:
    """Uniform QQ table of the primary-model residuals."""
    from tocsin.operators.stats import residual_qq
    from tocsin.plans.analysis import residuals
    return residual_qq(residuals(t, "primary"))


# -- Large series: lineitem as one series per supplier ------------------------



def lineitem_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier series: ticks are ship days, several rows per day, ordered by
    (ship day, order, line); alarm state = returned line."""
    from tocsin.sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate",
                                                      "l_returnflag")
    return li.select(F.col("l_suppkey").alias("id"), F.col("l_shipdate").alias("datetime"),
                     (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"),
                     F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("state"))


_LI_WALK = (
    "WITH st AS (SELECT l_suppkey AS id, l_shipdate AS datetime, l_orderkey * 8 + l_linenumber AS line, "
    "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS state FROM lineitem), "
    "w AS (SELECT *, lag(state, 1, 0) OVER (PARTITION BY id ORDER BY datetime, line) AS prv, "
    "lead(state, 1, 0) OVER (PARTITION BY id ORDER BY datetime, line) AS nxt FROM st), "
    "f AS (SELECT *, max(CASE WHEN state = 1 AND prv = 0 THEN struct_pack(t := datetime, l := line) END) "
    "OVER (PARTITION BY id ORDER BY datetime, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM w), "
    "e AS (SELECT id, s.t AS alarm_start, datetime AS alarm_end FROM f WHERE state = 1 AND nxt = 0) "
    "SELECT id, count(*) AS episodes, CAST(sum(epoch(alarm_end) - epoch(alarm_start)) AS BIGINT) AS seconds "
    "FROM e GROUP BY id")


@register_raw("lineitem_episodes", _LI_WALK)
def _lineitem_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O26-O30 on a large, dense series: returned-line runs per supplier."""
    from tocsin.operators.episodes import episodes
    ep = episodes(lineitem_series(spark, sf_dir), F.col("state"), None, end="clear", tie_col="line",
                  payload=(), chunk_seconds=None)  # chunk width per supplier from its density
    return ep.groupBy("id").agg(F.count(F.lit(1)).alias("episodes"), F.sum("duration").alias("seconds"))


# -- More O33 / O38 variants --------------------------------------------------

@register("zero_share_desat", f"WITH p AS ({O.desat_episode_sql()}) " + (
    "SELECT randomization, CASE WHEN outcome = 0 THEN 'Zero' ELSE 'Not zero' END AS zero, count(*) AS n, "
    "CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY randomization) AS DOUBLE) AS share "
    "FROM p GROUP BY 1, 2"))
def _zero_share_desat(t: Trial) -> DataFrame:
    """Zero / non-zero desaturation area per arm (bar-figure data)."""
    from tocsin.operators.outcomes import zero_share
    return zero_share(t.desaturation())


@register("nonzero_desat", f"WITH p AS ({O.desat_episode_sql()}) SELECT * FROM p WHERE outcome <> 0")
def _nonzero_desat(t: Trial) -> DataFrame:
    """Units whose SpO2 fell below the threshold (dot-figure data)."""
    from tocsin.operators.outcomes import nonzero
    return nonzero(t.desaturation())


@register("baseline_without_procedure",
          f"WITH b AS ({_baseline_sql(_CAT_TAIL)}) SELECT * FROM b WHERE variable <> 'procedure'")
def _baseline_without_procedure(t: Trial) -> DataFrame:
    """O38 variant: the categorical table without the procedure rows."""
    from tocsin.operators.summary import baseline_frame, categorical_summary, remove_variable
    return remove_variable(categorical_summary(baseline_frame(t.form_units(), FIXTURE_PROCEDURE_RULES)), "procedure")


@register_raw("check_findings", O._with(O.BASE, _CHECK_VIEWS) + (
    'SELECT id, chk AS "check", CAST(observed AS DOUBLE) AS observed, CAST(expected AS DOUBLE) AS expected '
    "FROM c WHERE observed <> expected "
    "UNION ALL SELECT id, 'sync_not_same_day', CAST(count(*) AS DOUBLE), CAST(0 AS DOUBLE) "
    "FROM pairs WHERE CAST(ipad AS DATE) <> CAST(cap AS DATE) GROUP BY id "
    "UNION ALL SELECT id, 'sync_gap_over_limit', diff / 60.0, CAST(5 AS DOUBLE) FROM pairs WHERE diff / 60.0 > 5"))
def _check_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every data-quality finding in one table."""
    from tocsin.operators.clock import clock_pairs
    from tocsin.operators.quality import all_checks, tagged
    fx, sheets = _fx(), _sheets(spark, sf_dir)
    files = fx.series(spark, sf_dir).select("id").distinct()
    return all_checks(files, tagged(_checked_sheets(spark, sf_dir, sheets)), clock_pairs(sheets.sync_readings()))


@register_raw("clock_fill_asof", _PLAN + (
    "SELECT s.id, CAST(epoch(s.datetime) AS BIGINT) AS datetime, "
    "CAST(CASE WHEN p.cap2 IS NOT NULL AND s.datetime >= p.cap2 THEN p.d2 ELSE p.d1 END AS BIGINT) AS diff "
    "FROM series s JOIN plan p USING (id)"))
def _clock_fill_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O09 with ``match="asof"``: every clock reading holds from its own time on,
    whether or not a row falls on that second."""
    from tocsin.operators.clock import clock_fill, clock_pairs
    from tocsin.plans.ingest import dedup
    from tocsin.sources import fixtures as fx
    rows = dedup(fx.monitor_rows(spark, sf_dir)).select("id", "datetime")
    out = clock_fill(rows, clock_pairs(_sheets(spark, sf_dir).sync_readings()), match="asof")
    return out.select("id", _epoch("datetime"), "diff")


# -- O01-O05: readers and writers, over files' contents made from the tables ------

@register_raw("device_lines", O._with(O.BASE) + (
    "SELECT id, line, CAST(epoch(datetime) AS BIGINT) AS datetime, CAST(spo2 AS DOUBLE) AS spo2, spo2Low, noBreath "
    "FROM series_raw"))
def _device_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device lines (30 comma-separated columns, ``--`` for none) parsed and typed."""
    from tocsin.sources.device_csv import DEVICE_COLUMNS, parse_numbered_lines
    raw = _fx().series_raw(spark, sf_dir)
    known = {"date": F.date_format("datetime", "MM/dd/yyyy"), "time": F.date_format("datetime", "HH:mm:ss"),
             **{c: F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in ("spo2", "spo2Low", "noBreath")}}
    text = F.concat_ws(",", *[known.get(c, F.lit("--")) for c in DEVICE_COLUMNS])
    parsed = parse_numbered_lines(raw.select(F.concat("id", F.lit(".csv")).alias("file"), "line", text.alias("text")))
    return parsed.select("id", "line", _epoch("datetime"), "spo2", "spo2Low", "noBreath")


@register("series_round_trip", O._with(O.BASE) + (
    "SELECT id, CAST(epoch(datetime) AS BIGINT) AS datetime, nurse, event, spo2 FROM series"))
def _series_round_trip(t: Trial) -> DataFrame:
    """The series written as a dataset and read back."""
    from tocsin.session import scratch_path
    from tocsin.sources.dataset import read_series, write_series
    path = scratch_path(t.spark, "series")
    write_series(t.series(), path)
    return read_series(t.spark, path).select("id", _epoch("datetime"), "nurse", "event", "spo2")


@register("patient_sheet", O._with(O.BASE) + (
    "SELECT patient AS id, CAST(1 AS INTEGER) AS \"row\", patient, CAST(age AS DOUBLE) AS age, sex, "
    "CAST(totalMidaz AS DOUBLE) AS totalMidaz, caseStart, CAST(NULL AS VARCHAR) AS absent FROM patient_form"))
def _patient_sheet(t: Trial) -> DataFrame:
    """A sheet out of the long table of workbook cells, by its header,
    with a column that no workbook has."""
    from tocsin.sources.workbook import sheet_frame
    names = ("patient", "age", "sex", "totalMidaz", "caseStart")
    cell = lambda row, col, value: F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), value.alias("value"))
    cells = [cell(1, k, F.lit(n)) for k, n in enumerate(names, 1)]
    cells += [cell(2, k, F.col(n).cast("string")) for k, n in enumerate(names, 1)]
    long = t.patient_form().select(F.col("patient").alias("id"), F.explode(F.array(*cells)).alias("c")).select(
        "id", F.lit(1).alias("sheet_index"), F.lit("Patient").alias("sheet"), "c.*").where("value IS NOT NULL")
    out = sheet_frame(long, [*names, "absent"], sheet="Patient", types={"age": "double", "totalMidaz": "double"})
    return out.withColumn("row", F.col("row").cast("int"))
