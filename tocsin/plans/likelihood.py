"""Likelihood and residuals of the model families at fixed parameters, in Spark and as SQL.

The fits maximise this number; stating it twice checks the densities, the
quadrature and the sums over cells and clusters without an optimiser.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.operators.glmm import QUADRATURE_NODES, ClusteredModel, Fit, model_cells
from tocsin.operators.stats import quantile_residuals
from tocsin.plans import oracle as O
from tocsin.plans.analysis import FAMILY, outcome_table
from tocsin.plans.trial import Trial

# Parameters at which the likelihood is stated (any would do).
AT = {
    "primary": {"b0": 9.0, "b1": 0.3, "log_phi": -0.4, "l11": -0.9},
    "duration": {"b0": 9.5, "b1": -0.2, "g0": -1.5, "g1": 0.4, "log_phi": -0.2, "l11": -0.7, "l21": 0.1, "l22": -0.5},
    "desat": {"b0": 4.0, "b1": 0.1, "g0": -1.0, "g1": 0.2, "log_sigma": 0.1, "l11": -0.8, "l21": -0.2, "l22": -0.6},
    "adverse": {"b0": -2.0, "b1": 0.5, "l11": -0.3},
}


def loglik(t: Trial, name: str) -> DataFrame:
    """``outcome, family, units, loglik`` with nodes centred on 0, rounded."""
    cells = model_cells(outcome_table(t, name))
    model = ClusteredModel(t.spark, cells, FAMILY[name])
    value = F.lit(model.loglik(**AT[name]))
    return cells.agg(F.sum("c").cast("long").alias("units")).select(
        F.lit(name).alias("outcome"), F.lit(FAMILY[name]).alias("family"), "units", F.round(value, 3).alias("loglik"))


def _softplus(z: str) -> str:
    return f"(greatest({z}, 0) + ln(1 + exp(-abs({z}))))"


def _density(family: str, p: dict) -> str:
    """Log density of a cell's outcome y at the random effects z1 and z2."""
    eta = f"({p['b0']} + {p['b1']} * x + z1)"
    if family == "binomial":
        return f"y * {eta} - {_softplus(eta)}"
    zeta = f"({p.get('g0')} + {p.get('g1')} * x + z2)"
    log_pi, log_rest = f"(-{_softplus('-' + zeta)})", f"(-{_softplus(zeta)})"
    if family == "hurdle_lognormal":
        s = p["log_sigma"]
        area = f"(-ln(y) - {s} - {0.5 * math.log(2 * math.pi)!r} - (ln(y) - {eta}) ** 2 / (2 * exp(2 * {s})))"
        return f"CASE WHEN y = 0 THEN {log_pi} ELSE {log_rest} + {area} END"
    phi = math.exp(p["log_phi"])
    total = f"ln({phi!r} + exp({eta}))"
    none = f"({phi!r} * ({p['log_phi']} - {total}))"
    count = f"(lgamma(y + {phi!r}) - lgamma({phi!r}) - lgamma(y + 1) + {none} + y * ({eta} - {total}))"
    if family == "negative_binomial":
        return count
    return f"CASE WHEN y = 0 THEN ln(exp({log_pi}) + exp({log_rest} + {none})) ELSE {log_rest} + {count} END"


def loglik_sql(name: str, outcome_sql: str) -> str:
    """The same from the units, one by one: a product over the units of a cluster
    at each node, a weighted sum over the nodes, a sum of logs over clusters."""
    family, p = FAMILY[name], AT[name]
    x, w = (a.tolist() for a in np.polynomial.hermite.hermgauss(QUADRATURE_NODES))
    if "l22" in p:
        nodes = [(a, b, u * v * math.exp(a * a + b * b) * 2) for a, u in zip(x, w) for b, v in zip(x, w)]
    else:
        nodes = [(a, 0.0, u * math.exp(a * a) * math.sqrt(2)) for a, u in zip(x, w)]
    rows = []
    for k, (a, b, weight) in enumerate(nodes):
        z1, z2 = math.sqrt(2) * a, math.sqrt(2) * b
        u1 = z1 / math.exp(p["l11"])
        prior = math.exp(-u1 * u1 / 2) / (math.exp(p["l11"]) * math.sqrt(2 * math.pi))
        if "l22" in p:
            u2 = (z2 - p["l21"] * u1) / math.exp(p["l22"])
            prior *= math.exp(-u2 * u2 / 2) / (math.exp(p["l22"]) * math.sqrt(2 * math.pi))
        rows.append(f"({k}, {z1!r}::DOUBLE, {z2!r}::DOUBLE, {math.log(weight * prior)!r}::DOUBLE)")
    return f"""
WITH o AS ({outcome_sql}),
u AS (SELECT nurse AS cluster, CASE WHEN randomization = 'IPI enabled' THEN 1 ELSE 0 END AS x, CAST(outcome AS DOUBLE) AS y
      FROM o WHERE nurse IS NOT NULL AND randomization IS NOT NULL AND outcome IS NOT NULL),
n(q, z1, z2, lw) AS (VALUES {', '.join(rows)}),
l AS (SELECT cluster, q, any_value(lw) + sum({_density(family, p)}) AS v FROM u, n GROUP BY cluster, q),
m AS (SELECT cluster, max(v) AS top FROM l GROUP BY cluster),
c AS (SELECT cluster, any_value(top) + ln(sum(exp(v - top))) AS v FROM l JOIN m USING (cluster) GROUP BY cluster)
SELECT '{name}' AS outcome, '{family}' AS family, (SELECT count(*) FROM u) AS units, round(sum(v), 3) AS loglik FROM c
"""


OUTCOME_SQL = {
    "primary": f"SELECT * FROM ({O.seconds_in_alarm_sql(O.ANSWERED)}) WHERE outcome <> 0",
    "duration": O.seconds_in_alarm_sql(O.CLEAR),
    "desat": O.desat_episode_sql(),
    "adverse": f"SELECT nurse, randomization, adverseEvent AS outcome FROM ({O.adverse_sql()})",
    "alarms": O.alarms_sql("event <> 'Fix equipment'"),
}

# Parameters of the residuals that are stated, and what an outcome is divided by: the
# fixture's ticks are hours, so that whole hours lose nothing.
RESIDUALS_AT = {
    "duration": ({"b0": 5.2, "b1": -0.2, "g0": -1.5, "g1": 0.4, "log_phi": 1.2, "l11": -0.7, "l21": 0.1, "l22": -0.5}, 3600),
    "desat": (AT["desat"], 1),
    "alarms": ({"b0": 1.5, "b1": 0.2, "g0": -1.0, "g1": 0.3, "log_phi": 0.5, "l11": -0.7, "l21": 0.0, "l22": -0.5}, 1),
}


def residuals_at(t: Trial, name: str) -> DataFrame:
    """Residuals of the models that are checked, at fixed parameters, rounded."""
    params, unit = RESIDUALS_AT[name]
    fit = Fit(FAMILY[name], list(params), np.array(list(params.values())), np.eye(len(params)), 0.0, 0)
    table = outcome_table(t, name).withColumn("outcome", F.col("outcome") / F.lit(unit))
    found = quantile_residuals(table, fit, kind="mean_subject")
    return found.select("id", "nurse", "randomization", F.round("outcome", 4).alias("outcome"), F.round("residual", 6).alias("residual"))


def residuals_sql(name: str) -> str:
    """The same by adding up probabilities, and areas under the normal curve."""
    p, unit = RESIDUALS_AT[name]
    eta, zeta = f"({p['b0']} + {p['b1']} * x)", f"({p['g0']} + {p['g1']} * x)"
    if FAMILY[name] == "hurdle_lognormal":
        z = f"(ln(y) - {eta}) / exp({p['log_sigma']})"
        # Simpson's rule from 0 to z
        area = (f"list_sum(list_transform(range(0, 401), lambda k: (CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) "
                f"* exp(-0.5 * pow(({z}) * k / 400, 2)))) * ({z}) / 1200 / sqrt(2 * pi())")
        below, at = f"0.5 + {area}", "0"
    else:
        phi = math.exp(p["log_phi"])
        def mass(k: str) -> str:
            return (f"exp(lgamma({k} + {phi!r}) - lgamma({phi!r}) - lgamma({k} + 1) + {phi!r} * ({p['log_phi']} - ln({phi!r} + exp({eta}))) "
                    f"+ {k} * ({eta} - ln({phi!r} + exp({eta}))))")
        below = f"coalesce(list_sum(list_transform(range(0, CAST(y AS BIGINT)), lambda k: {mass('k')})), 0)"
        at = mass("y")
    number = " + ".join(f"(strpos('0123456789abcdef', substr(h, {k}, 1)) - 1) * {16 ** (8 - k)}" for k in range(1, 9))
    return f"""
WITH o AS ({OUTCOME_SQL[name]}),
u AS (SELECT id, nurse, randomization, CASE WHEN randomization = 'IPI enabled' THEN 1.0 ELSE 0.0 END AS x, CAST(outcome AS DOUBLE) / {unit} AS y,
      md5('1|' || coalesce(id, '') || '|' || coalesce(nurse, '')) AS h FROM o WHERE outcome IS NOT NULL),
q AS (SELECT *, 1 / (1 + exp(-{zeta})) AS zero, CASE WHEN y > 0 THEN {below} ELSE 0 END AS below, {at} AS point, ({number}) / 4294967296.0 AS share FROM u)
SELECT id, nurse, randomization, round(y, 4) AS outcome, round(least(1.0, CASE WHEN y > 0 THEN zero + (1 - zero) * (below + share * point)
  ELSE share * (zero + (1 - zero) * point) END), 6) AS residual FROM q
"""


def reml_sql(outcomes: dict[str, str]) -> str:
    """(outcome, icc) by three grids of the variance ratio, each around the best
    point of the one before."""
    crit = ("-0.5 * ((any_value(units) - 1) * ln((any_value(within) + sum(w * off * off) - sum(w * off) ** 2 / sum(w)) / (any_value(units) - 1)) "
            "+ sum(ln(1 + n * ratio)) + ln(sum(w)))")

    def best(grid: str) -> str:
        return (f"SELECT outcome, ratio, step, {crit} AS crit FROM (SELECT g.*, c.*, n / (1 + n * ratio) AS w FROM ({grid}) g "
                "JOIN c ON c.name = g.outcome) GROUP BY outcome, ratio, step QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY crit DESC, ratio) = 1")

    def closer(level: str) -> str:
        return f"SELECT outcome, exp(ln(ratio) + (i - 1000) * step / 1000) AS ratio, step / 1000 AS step FROM {level}, range(0, 2001) t(i)"

    units = " UNION ALL ".join(f"SELECT '{name}' AS name, nurse, CAST(outcome AS DOUBLE) AS y FROM ({sql})" for name, sql in outcomes.items())
    low, high = math.log(1e-10), math.log(1e6)
    return f"""
WITH u AS ({units}),
m AS (SELECT name, nurse, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS m2 FROM u WHERE nurse IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
c AS (SELECT name, n, mean - sum(n * mean) OVER k / sum(n) OVER k AS off, sum(n) OVER k AS units, sum(m2) OVER k AS within
      FROM m WINDOW k AS (PARTITION BY name)),
names AS (SELECT DISTINCT name AS outcome FROM c),
a AS ({best(f"SELECT outcome, exp({low} + i * ({high} - {low}) / 1000) AS ratio, ({high} - {low}) / 1000 AS step FROM names, range(0, 1001) t(i)")}),
b AS ({best(closer('a'))}), d AS ({best(closer('b'))}),
e AS ({best("SELECT outcome, ratio, 0 AS step FROM d UNION ALL SELECT outcome, 0.0, 0 FROM names")})
SELECT outcome, round(ratio / (1 + ratio), 4) AS icc FROM e
"""
