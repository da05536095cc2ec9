"""DuckDB statements that state each driver query independently of Spark.

The oracle walks the series with plain ``lag``/``lead`` windows per id, the
literal reading of the outcome rules; the Spark jobs compute the same numbers
with the chunked run plan.  Column names and types are aligned with the Spark
output (integral outcomes are BIGINT, shares DOUBLE).
"""

from __future__ import annotations

from tocsin.functions.alarm import ALARM_FLAGS
from tocsin.plans.trial import FIXTURE_OVERRIDES
from tocsin.sources import fixtures

STATE_SQL = "CASE WHEN " + " OR ".join(f"{f} = 1" for f in ALARM_FLAGS) + " THEN 1 ELSE 0 END"
_OVERRIDES = ", ".join(f"'{o}'" for o in FIXTURE_OVERRIDES)

BASE = {
    "allocation": f"SELECT * FROM {fixtures.SQL_ALLOCATION}",
    "missing": f"SELECT * FROM {fixtures.SQL_MISSING_UNITS}",
    "series_raw": fixtures.SQL_SERIES_RAW,
    "series": fixtures.SQL_SERIES,
    "patient_form": fixtures.SQL_PATIENT_FORM,
    "adverse_form": fixtures.SQL_ADVERSE_FORM,
    "excl": "SELECT patient AS id FROM patient_form WHERE (totalMidaz = 0 OR totalMidaz IS NULL) "
            f"AND totalOtherSedation IS NULL AND patient NOT IN ({_OVERRIDES})",
    "ds": "SELECT * FROM series WHERE id NOT IN (SELECT id FROM excl)",
    "units": "SELECT DISTINCT id, randomization, nurse FROM ds",
}

# Literal walk of the episode rules, series scope.
WALK = {
    "st": f"SELECT id, datetime, nurse, randomization, event, spo2, {STATE_SQL} AS state FROM ds",
    "w": "SELECT *, lag(state, 1, 0) OVER (PARTITION BY id ORDER BY datetime) AS prv, "
         "lead(state, 1, 0) OVER (PARTITION BY id ORDER BY datetime) AS nxt FROM st",
    "f": "SELECT *, max(CASE WHEN state = 1 AND prv = 0 THEN datetime END) OVER (PARTITION BY id ORDER BY datetime "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alarm_start FROM w",
}

# Literal walk over all series concatenated in id order (dataset scope): no
# default for the first lag / last lead, start carried down across ids.
WALK_DATASET = {
    "st": WALK["st"],
    "w": "SELECT *, lag(state) OVER (ORDER BY id, datetime) AS prv, lead(state) OVER (ORDER BY id, datetime) AS nxt FROM st",
    "f": "SELECT *, last_value(CASE WHEN state = 1 AND prv = 0 THEN datetime END IGNORE NULLS) OVER (ORDER BY id, datetime "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alarm_start FROM w",
}


def _with(*groups: dict, **extra: str) -> str:
    views: dict[str, str] = {}
    for g in groups:
        views.update(g)
    views.update(extra)
    return fixtures.sql_with(**views)


def _episode_views(end_rule: str) -> dict:
    return {
        "e": f"SELECT * FROM f WHERE {end_rule}",
        "ep": "SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id, alarm_start ORDER BY datetime) = 1",
        "d": "SELECT *, CAST(epoch(datetime) - epoch(alarm_start) AS BIGINT) AS dur FROM ep",
        "first_ep": "SELECT id, randomization, nurse FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY datetime) = 1",
    }


CLEAR = "state = 1 AND nxt = 0"
ANSWERED = "(state = 1 AND nxt = 0) OR (state = 1 AND event IS NOT NULL)"

RIGHT_JOIN_UNITS = (
    "SELECT u.id, u.randomization, u.nurse, CAST(coalesce(p.outcome, 0) AS BIGINT) AS outcome "
    "FROM per_id p RIGHT JOIN units u ON p.id = u.id AND p.randomization IS NOT DISTINCT FROM u.randomization "
    "AND p.nurse IS NOT DISTINCT FROM u.nurse"
)
RIGHT_JOIN_AREAS = RIGHT_JOIN_UNITS.replace("BIGINT", "DOUBLE")


def seconds_in_alarm_sql(end_rule: str, with_missing: bool = True, walk: dict = WALK) -> str:
    sql = _with(BASE, walk, _episode_views(end_rule),
                sums="SELECT id, CASE WHEN count(*) = count(dur) THEN sum(dur) END AS outcome FROM d GROUP BY id",
                per_id="SELECT f.id, f.randomization, f.nurse, s.outcome FROM first_ep f JOIN sums s USING (id)",
                res=RIGHT_JOIN_UNITS)
    sql += "SELECT id, randomization, nurse, outcome FROM res"
    if with_missing:
        sql += " UNION ALL SELECT id, randomization, nurse, CAST(0 AS BIGINT) FROM missing"
    return sql


def episodes_sql(end_rule: str, walk: dict = WALK) -> str:
    return _with(BASE, walk, _episode_views(end_rule)) + (
        "SELECT id, CAST(epoch(alarm_start) AS BIGINT) AS alarm_start, CAST(epoch(datetime) AS BIGINT) AS alarm_end, "
        "dur AS duration, randomization, nurse FROM d")


def alarms_sql(accept: str) -> str:
    return _with(BASE, a=f"SELECT *, CASE WHEN ({STATE_SQL}) = 1 AND event IS NOT NULL AND ({accept}) THEN 1 ELSE 0 END AS hit FROM ds",
                 u="SELECT id, nurse, randomization FROM a QUALIFY row_number() OVER (PARTITION BY id, nurse ORDER BY datetime) = 1",
                 s="SELECT id, sum(hit) AS outcome FROM a GROUP BY id") + (
        "SELECT u.id, u.randomization, u.nurse, CAST(s.outcome AS BIGINT) AS outcome FROM u JOIN s USING (id) "
        "UNION ALL SELECT id, randomization, nurse, CAST(0 AS BIGINT) FROM missing")


def desat_episode_sql() -> str:
    return _with(BASE, WALK, _episode_views(CLEAR),
                 sums="SELECT id, coalesce(sum(CASE WHEN spo2 < 90 THEN 90 - spo2 WHEN spo2 IS NOT NULL THEN 0 END), 0) "
                      "AS outcome FROM d GROUP BY id",
                 per_id="SELECT f.id, f.randomization, f.nurse, s.outcome FROM first_ep f JOIN sums s USING (id)",
                 res=RIGHT_JOIN_AREAS) + "SELECT id, randomization, nurse, outcome FROM res"


def desat_columns_sql(columns: list[str]) -> str:
    return _with(BASE, WALK, _episode_views(CLEAR),
                 sums="SELECT id, coalesce(sum(CASE WHEN spo2 < 90 THEN 90 - spo2 WHEN spo2 IS NOT NULL THEN 0 END), 0) "
                      "AS outcome FROM d GROUP BY id",
                 p="SELECT d.*, s.outcome FROM d JOIN sums s USING (id) QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY datetime) = 1") + (
        "SELECT u.id, u.randomization, u.nurse, CAST(coalesce(p.outcome, 0) AS DOUBLE) AS outcome, "
        "CAST(epoch(p.alarm_start) AS BIGINT) AS alarm_start, CAST(epoch(p.datetime) AS BIGINT) AS alarm_end, p.dur AS duration, "
        + ", ".join(f"r.{c}" for c in columns) + " FROM p JOIN ds r ON r.id = p.id AND r.datetime = p.datetime RIGHT JOIN units u ON p.id = u.id "
        "AND p.randomization IS NOT DISTINCT FROM u.randomization AND p.nurse IS NOT DISTINCT FROM u.nurse")


def desat_rows_sql() -> str:
    return _with(BASE,
                 sums="SELECT id, coalesce(sum(CASE WHEN spo2 < 90 THEN 90 - spo2 ELSE 0 END), 0) AS outcome FROM ds GROUP BY id",
                 fr="SELECT id, randomization, nurse FROM ds QUALIFY row_number() OVER (PARTITION BY id ORDER BY datetime) = 1",
                 per_id="SELECT f.id, f.randomization, f.nurse, s.outcome FROM fr f JOIN sums s USING (id)",
                 res=RIGHT_JOIN_AREAS) + "SELECT id, randomization, nurse, outcome FROM res"


FIRST_PER_ID = "SELECT nurse, id, randomization FROM series QUALIFY row_number() OVER (PARTITION BY id ORDER BY datetime) = 1"


def cluster_size_sql(analysed: bool) -> str:
    src = "ds" if analysed else "series"
    return _with(BASE,
                 fr=f"SELECT nurse, id, randomization FROM {src} QUALIFY row_number() OVER (PARTITION BY id ORDER BY datetime) = 1",
                 allu="SELECT nurse, id, randomization FROM fr UNION ALL SELECT nurse, id, randomization FROM missing") + (
        "SELECT nurse, randomization, count(*) AS n FROM allu GROUP BY nurse, randomization")


def zero_share_sql() -> str:
    return f"WITH p AS ({seconds_in_alarm_sql(ANSWERED)}) " + (
        "SELECT randomization, CASE WHEN outcome = 0 THEN 'Zero' ELSE 'Not zero' END AS zero, count(*) AS n, "
        "CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY randomization) AS DOUBLE) AS share "
        "FROM p GROUP BY 1, 2")


NURSE_UNITS = {
    # the nurses of the observers' sheets: those of the series, and what the extra readings add
    "sheet": "SELECT DISTINCT nurse FROM series WHERE nurse IS NOT NULL UNION SELECT unnest([NULL, 'N98']) "
             "WHERE EXISTS (FROM series WHERE nurse IS NOT NULL AND CAST(substr(id, 2) AS BIGINT) % 4 = 0)",
    "nurses": "SELECT DISTINCT s.nurse, a.randomization FROM sheet s LEFT JOIN allocation a ON s.nurse = a.id_cluster",
    "fr": "SELECT nurse, id FROM series QUALIFY row_number() OVER (PARTITION BY id ORDER BY datetime) = 1",
    "nu": "SELECT n.nurse, fr.id, n.randomization FROM fr RIGHT JOIN nurses n ON fr.nurse IS NOT DISTINCT FROM n.nurse "
          "UNION ALL SELECT nurse, id, randomization FROM missing",
}


def form_units_sql() -> str:
    return _with(BASE, NURSE_UNITS,
                 form="SELECT * FROM patient_form WHERE patient NOT IN (SELECT id FROM excl)",
                 j="SELECT coalesce(form.patient, nu.id) AS patient, form.* EXCLUDE (patient), nu.nurse, nu.randomization "
                   "FROM form FULL JOIN nu ON form.patient = nu.id") + (
        "SELECT * FROM j WHERE patient IS NULL OR patient NOT IN (SELECT id FROM excl)")


def adverse_sql() -> str:
    return _with(BASE) + (
        "SELECT u.id, a.ae_description, a.ae_severity, u.randomization, u.nurse, "
        "CASE WHEN a.ae_description IS NOT NULL OR a.ae_severity IS NOT NULL THEN 1 ELSE 0 END AS adverseEvent "
        "FROM adverse_form a RIGHT JOIN units u ON a.id = u.id")
