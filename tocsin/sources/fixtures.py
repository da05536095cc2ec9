"""Trial-shaped views over the driver's tables.

The trial data (device recordings, observer workbooks) are not public, so the
jobs run on views that give the driver's tables the trial's shape:

* ``series_raw``  -- device rows from ``events``: one id per user, hourly ticks,
  several rows per tick, ten alarm flags, SpO2 in halves, observer events and a
  nurse that changes mid-series for every tenth id (a hand-over) and is missing
  for every seventeenth;
* ``series``      -- one row per tick (first line kept) with the arm attached;
* ``patient_form``-- the patient sheet from ``customer`` + ``part``;
* ``adverse_form``-- the adverse-event sheet from ``customer``;
* ``clock_readings``, ``nurse_log``, ``interventions`` -- observer sheets
  derived from the series for the ingest jobs.

Each view exists twice: as a Spark builder and as DuckDB SQL (``SQL_*``) used
by the oracle queries in ``__spark_entry__.py``.  Both are written to give
identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tocsin.sources import literals
from tocsin.sources.tables import read_table

HANDOVER_FROM = "2024-01-16 00:00:00"


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select("user_id", F.col("event_id").alias("line"), F.date_trunc("hour", F.col("ts")).alias("datetime"),
                     "ts", "event_type", "value", "props")


def _derive(raw: DataFrame) -> DataFrame:
    """Trial columns of device rows from raw event rows."""
    uid, v, et, ts = F.col("user_id"), F.col("value"), F.col("event_type"), F.col("ts")
    k10 = F.get_json_object("props", "$.k").cast("int") % 10
    flag = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0))
    handover = F.when((uid % 10 == 0) & (ts >= _ts(HANDOVER_FROM)), 1).otherwise(0)
    return raw.select(
        F.format_string("E%03d", uid).alias("id"),
        "line",
        "datetime",
        (F.lit(100) - F.floor(v * 2 / 5) / 2).alias("spo2"),
        flag(v >= 55).alias("spo2Low"),
        F.lit(0).alias("spo2High"),
        flag(et == "error").alias("respRateLow"),
        flag((et == "view") & (v > 120)).alias("respRateHigh"),
        F.when((et == "signup") & (v < 10), 1).when(et == "signup", None).otherwise(0).alias("noBreath"),
        flag(v >= 100).alias("ipiLow"),
        flag((et == "purchase") & (v > 80)).alias("pulseRateHigh"),
        flag((et == "view") & (v < 2)).alias("pulseRateLow"),
        flag((et == "click") & (v < 3)).alias("etco2Low"),
        flag((et == "click") & (v > 120)).alias("etco2High"),
        F.when(k10 == 0, "Alarm silenced").when(k10 == 1, "Fix equipment")
        .when(k10 == 2, "Stimulation").when(k10 == 3, "Oxygen").alias("event"),
        F.when(uid % 17 != 0, F.concat(F.lit("N"), F.lpad(((uid + handover) % 12 + 1).cast("string"), 2, "0")))
        .alias("nurse"),
    )


def series_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(_raw_events(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tick.  The first line of each (user, hour) is chosen on the
    raw columns, so the trial columns are derived after the exchange, in
    parallel and only for the rows kept (the id is a one-to-one label of the
    user)."""
    from tocsin.operators.rows import arm_lookup, one_row_per_tick

    first = one_row_per_tick(_raw_events(spark, sf_dir), ["user_id"], "datetime", "line")
    return arm_lookup(_derive(first), literals.allocation(spark))


def patient_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = F.col("c_custkey")
    start = _ts("2024-01-01 08:00:00") + F.make_dt_interval(F.lit(0), k.cast("int") % 720)
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), (F.lit(15) + k % 45).cast("int"))
    return c.join(p, p.p_partkey == c.c_custkey, "left").select(
        F.format_string("E%03d", k).alias("patient"),
        (F.lit(20) + (k % 60).cast("int")).alias("age"),
        F.when(k % 2 == 0, "F").otherwise("M").alias("sex"),
        F.col("c_mktsegment").alias("oxygenDevice"),
        F.when(k % 9 == 0, None).otherwise((k % 7).cast("int")).alias("totalMidaz"),
        (k % 4 * 25).cast("int").alias("totalFent"),
        F.when(k % 11 == 0, "other").alias("totalOtherSedation"),
        F.col("p_name").alias("procedure"),
        F.date_format(start, "MM/dd/yyyy HH:mm:ss").alias("caseStart"),
        F.date_format(end, "MM/dd/yyyy HH:mm:ss").alias("caseEnd"),
    )


def adverse_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    bal = F.col("c_acctbal")
    return c.select(
        F.format_string("E%03d", F.col("c_custkey")).alias("id"),
        F.when(bal < 0, F.col("c_name")).alias("ae_description"),
        F.when(bal < -500, "intermediate").when(bal < 0, "minor").alias("ae_severity"),
    )


def clock_offset(uid):
    """Seconds the tablet clock runs ahead of the monitor, per user."""
    return F.lit(7) + uid % 5


# --------------------------------------------------------------------------
# DuckDB text of the same views, for the oracle queries.

SQL_ALLOCATION = literals.values_sql(literals.ALLOCATION, ["id_cluster", "randomization"])
SQL_MISSING_UNITS = literals.values_sql(literals.MISSING_UNITS, ["id", "nurse", "randomization"])

SQL_SERIES_RAW = """
SELECT printf('E%03d', user_id) AS id, event_id AS line,
  date_trunc('hour', ts) AS datetime, 100 - floor(value * 2 / 5) / 2 AS spo2,
  CASE WHEN value >= 55 THEN 1 ELSE 0 END AS spo2Low, 0 AS spo2High,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS respRateLow,
  CASE WHEN event_type = 'view' AND value > 120 THEN 1 ELSE 0 END AS respRateHigh,
  CASE WHEN event_type = 'signup' AND value < 10 THEN 1 WHEN event_type = 'signup' THEN NULL ELSE 0 END AS noBreath,
  CASE WHEN value >= 100 THEN 1 ELSE 0 END AS ipiLow,
  CASE WHEN event_type = 'purchase' AND value > 80 THEN 1 ELSE 0 END AS pulseRateHigh,
  CASE WHEN event_type = 'view' AND value < 2 THEN 1 ELSE 0 END AS pulseRateLow,
  CASE WHEN event_type = 'click' AND value < 3 THEN 1 ELSE 0 END AS etco2Low,
  CASE WHEN event_type = 'click' AND value > 120 THEN 1 ELSE 0 END AS etco2High,
  CASE CAST(json_extract_string(props, '$.k') AS INT) % 10 WHEN 0 THEN 'Alarm silenced' WHEN 1 THEN 'Fix equipment'
       WHEN 2 THEN 'Stimulation' WHEN 3 THEN 'Oxygen' END AS event,
  CASE WHEN user_id % 17 <> 0 THEN
  'N' || lpad(CAST((user_id + CASE WHEN user_id % 10 = 0 AND ts >= TIMESTAMP '2024-01-16 00:00:00'
       THEN 1 ELSE 0 END) % 12 + 1 AS VARCHAR), 2, '0') END AS nurse
FROM events
"""

SQL_SERIES = f"""
SELECT s.* EXCLUDE (rn), a.randomization FROM (
  SELECT *, row_number() OVER (PARTITION BY id, datetime ORDER BY line) AS rn FROM ({SQL_SERIES_RAW})) s
LEFT JOIN {SQL_ALLOCATION} a ON s.nurse = a.id_cluster WHERE s.rn = 1
"""

SQL_PATIENT_FORM = """
SELECT printf('E%03d', c_custkey) AS patient, 20 + CAST(c_custkey % 60 AS INT) AS age,
  CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c_mktsegment AS oxygenDevice,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 7 AS INT) END AS totalMidaz,
  CAST(c_custkey % 4 * 25 AS INT) AS totalFent,
  CASE WHEN c_custkey % 11 = 0 THEN 'other' END AS totalOtherSedation,
  p_name AS "procedure",
  strftime(TIMESTAMP '2024-01-01 08:00:00' + to_seconds(CAST(c_custkey % 720 AS BIGINT) * 3600), '%m/%d/%Y %H:%M:%S') AS caseStart,
  strftime(TIMESTAMP '2024-01-01 08:00:00' + to_seconds(CAST(c_custkey % 720 AS BIGINT) * 3600)
           + to_seconds(CAST(15 + c_custkey % 45 AS BIGINT) * 60), '%m/%d/%Y %H:%M:%S') AS caseEnd
FROM customer LEFT JOIN part ON p_partkey = c_custkey
"""

SQL_ADVERSE_FORM = """
SELECT printf('E%03d', c_custkey) AS id,
  CASE WHEN c_acctbal < 0 THEN c_name END AS ae_description,
  CASE WHEN c_acctbal < -500 THEN 'intermediate' WHEN c_acctbal < 0 THEN 'minor' END AS ae_severity
FROM customer
"""


def sql_with(**views: str) -> str:
    """``WITH name AS (...), ...`` prefix for oracle queries."""
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in views.items()) + "\n"


# --------------------------------------------------------------------------
# Observer sheets for the ingest jobs, derived from the deduplicated series.
#
# Per id (u = user number): the first pair of clock readings is taken at the
# first tick; the tablet runs 7 + u % 5 s ahead (a day more when u % 13 == 0, a
# date typo the checks must find).  Ids with u % 3 == 0 get a second pair at
# the first tick from 10 January on, with the tablet 2 s further ahead; when
# also u % 7 == 0 that Capnostream reading is half an hour off the tick grid
# and matches no row.  Nurse log: the first tick of each (id, nurse); ids with
# u % 4 == 0 also have, at their first reading, a repeated one and one without a
# nurse, and half an hour later one that matches no row (nurse N98, who has no
# patient).  Interventions: every tick with an event.  Both in tablet time.

SECOND_PAIR_FROM = "2024-01-10 00:00:00"


def user_of(id_col):
    return F.substring(id_col, 2, 20).cast("long")


def clock_plan(series_df: DataFrame) -> DataFrame:
    """Per id: first tick, second Capnostream reading, both offsets, and the
    tick from which the second offset holds (NULL if it matches no row)."""
    g = series_df.groupBy("id").agg(
        F.min("datetime").alias("t1"),
        F.min(F.when(F.col("datetime") >= _ts(SECOND_PAIR_FROM), F.col("datetime"))).alias("t2"))
    u = user_of(F.col("id"))
    off = F.lit(7) + u % 5
    has2 = (u % 3 == 0) & F.col("t2").isNotNull()
    return g.select(
        "id", "t1",
        (off + F.when(u % 13 == 0, 86400).otherwise(0)).alias("d1"),
        F.when(has2, F.timestamp_seconds(F.unix_seconds("t2") + F.when(u % 7 == 0, 1800).otherwise(0))).alias("cap2"),
        (off + 2).alias("d2"),
        F.when(has2 & (u % 7 != 0), F.col("t2")).alias("hit2"),
    )


def expected_diff(ts_col: str = "datetime"):
    return F.when(F.col("hit2").isNotNull() & (F.col(ts_col) >= F.col("hit2")), F.col("d2")).otherwise(F.col("d1"))


def monitor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device rows as the CSV scan gives them (no nurse, event or arm yet)."""
    return series_raw(spark, sf_dir).drop("nurse", "event")


def sync_sheet(spark: SparkSession, sf_dir: str, plan: DataFrame | None = None) -> DataFrame:
    """``Sync times`` sheet rows: ``id, row, device, time`` (text)."""
    from tocsin.functions.timeparse import format_mdy

    plan = clock_plan(series(spark, sf_dir)) if plan is None else plan
    sec = lambda ts, d: F.timestamp_seconds(F.unix_seconds(ts) + d)
    readings = F.array(
        F.struct(F.lit(1).alias("row"), F.lit("Capnostream").alias("device"), F.col("t1").alias("t")),
        F.struct(F.lit(2).alias("row"), F.lit("ipad").alias("device"), sec(F.col("t1"), F.col("d1")).alias("t")),
        F.struct(F.lit(3).alias("row"), F.lit("Capnostream").alias("device"), F.col("cap2").alias("t")),
        F.struct(F.lit(4).alias("row"), F.lit("ipad").alias("device"), sec(F.col("cap2"), F.col("d2")).alias("t")),
    )
    out = plan.select("id", F.explode(readings).alias("r")).filter(F.col("r.t").isNotNull())
    return out.select("id", F.col("r.row").alias("row"), F.col("r.device").alias("device"),
                      format_mdy(F.col("r.t")).alias("time"))


def nurse_sheet(spark: SparkSession, sf_dir: str, s: DataFrame | None = None,
                plan: DataFrame | None = None) -> DataFrame:
    """``Nurse ID`` sheet rows: ``id, row, nurse, time`` (text, tablet clock)."""
    from tocsin.functions.timeparse import format_mdy

    s = series(spark, sf_dir) if s is None else s
    first = s.filter(F.col("nurse").isNotNull()).groupBy("id", "nurse").agg(F.min("datetime").alias("datetime"))
    first = first.join(clock_plan(s) if plan is None else plan, "id")
    t = F.timestamp_seconds(F.unix_seconds("datetime") + expected_diff())
    w = Window.partitionBy("id").orderBy("datetime")
    log = first.select("id", F.row_number().over(w).alias("row"), "nurse", t.alias("t"))
    more = F.array(F.struct(F.lit(101).alias("row"), F.col("nurse"), F.col("t")),
                   F.struct(F.lit(102).alias("row"), F.lit(None).cast("string").alias("nurse"), F.col("t")),
                   F.struct(F.lit(103).alias("row"), F.lit("N98").alias("nurse"),
                            (F.col("t") + F.expr("INTERVAL 30 MINUTES")).alias("t")))
    own = F.struct("row", "nurse", "t")
    extra = (F.col("row") == 1) & (user_of(F.col("id")) % 4 == 0)
    log = log.select("id", F.explode(F.when(extra, F.concat(F.array(own), more)).otherwise(F.array(own))).alias("r"))
    return log.select("id", F.col("r.row").alias("row"), F.col("r.nurse").alias("nurse"), format_mdy(F.col("r.t")).alias("time"))


def intervention_sheet(spark: SparkSession, sf_dir: str, s: DataFrame | None = None,
                       plan: DataFrame | None = None) -> DataFrame:
    """``Interventions`` sheet rows: ``id, row, event, time`` (text, tablet clock)."""
    from tocsin.functions.timeparse import format_mdy

    s = series(spark, sf_dir) if s is None else s
    ev = s.filter(F.col("event").isNotNull()).select("id", "datetime", "event", "line")
    ev = ev.join(clock_plan(s) if plan is None else plan, "id")
    t = F.timestamp_seconds(F.unix_seconds("datetime") + expected_diff())
    return ev.select("id", F.col("line").alias("row"), "event", format_mdy(t).alias("time"))


SQL_CLOCK_PLAN = f"""
SELECT id, t1, 7 + u % 5 + CASE WHEN u % 13 = 0 THEN 86400 ELSE 0 END AS d1,
  CASE WHEN u % 3 = 0 AND t2 IS NOT NULL THEN t2 + to_seconds(CASE WHEN u % 7 = 0 THEN 1800 ELSE 0 END) END AS cap2,
  7 + u % 5 + 2 AS d2,
  CASE WHEN u % 3 = 0 AND t2 IS NOT NULL AND u % 7 <> 0 THEN t2 END AS hit2
FROM (SELECT id, CAST(substr(id, 2) AS BIGINT) AS u, min(datetime) AS t1,
             min(datetime) FILTER (WHERE datetime >= TIMESTAMP '{SECOND_PAIR_FROM}') AS t2
      FROM series GROUP BY id)
"""
SQL_EXPECTED_DIFF = "CASE WHEN p.hit2 IS NOT NULL AND s.datetime >= p.hit2 THEN p.d2 ELSE p.d1 END"
