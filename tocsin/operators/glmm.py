"""Clustered (random-intercept) models fitted with Spark aggregations.

The design is intercept + arm, so the outcome table collapses losslessly to
*cells* ``(cluster, x, y, c)``: ``c`` units of arm ``x`` in ``cluster`` with
outcome ``y``.  All units of an arm of a cluster share their linear predictors, so
what the likelihood needs of them are sums: numbers of zeros and of others, the sum
of the outcomes, mean and squared deviations of their logs.  One row holds them for
both arms of a cluster, however many units it has.  The only part in which each
outcome counts by itself, log Gamma(y + phi) of the counts, depends on the shape
alone: it stands outside of the integral and is summed over the different outcomes.

The marginal likelihood of cluster ``k`` is an integral over
its random effects, approximated by adaptive Gauss-Hermite quadrature:
nodes are centred on the mode of each cluster's integrand and scaled by its
curvature there.

One evaluation is one Spark job over the clusters with their
node centres: parameter vectors and quadrature nodes are exploded onto every
row (both are short literal arrays, so every evaluation runs the same generated
code).  Log densities and their derivatives by the linear predictors and the
shape are Columns; the posterior weight of a
node turns them into the score of the cluster, and sums over the clusters
give each vector's log likelihood and score.  The search is Newton's, with the
information from differences of scores around the present point: two short jobs
a step.  The modes are found the same way, several moves chained in one job.
Several models of one family (outcomes, kept apart by a key beside the cluster)
are fitted together and share every job.  Parameters go in, one row for each
vector comes out: neither rows, nor clusters, nor nodes pass the driver.

Where a spread goes to 0 the fit ends at a smaller model: the spread is held at
``MIN_LOG_SD`` and has no interval.

Families: ``negative_binomial`` (one random intercept),
``zi_negative_binomial`` and ``hurdle_lognormal`` (random intercepts in the
count and zero parts, correlated unless ``diagonal``), ``binomial`` (logit).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.functions.special import DIGAMMA_SERIES, DIGAMMA_SHIFT, HALF_LOG_2PI, digamma, lgamma, log_sum_exp2, softplus
from tocsin.session import materialize

PARAMS = {
    "negative_binomial": ["b0", "b1", "log_phi", "l11"],
    "zi_negative_binomial": ["b0", "b1", "g0", "g1", "log_phi", "l11", "l21", "l22"],
    "hurdle_lognormal": ["b0", "b1", "g0", "g1", "log_sigma", "l11", "l21", "l22"],
    "binomial": ["b0", "b1", "l11"],
}
# Above this shape (log scale) log Gamma(y + phi) - log Gamma(phi) is taken from
# Stirling's series, where the plain difference would lose its digits.
STIRLING_LOG_PHI = 10.0
# From this outcome on log Gamma(y + phi) - log Gamma(y + 1) is, for the same reason.
STIRLING_OUTCOME = 1000.0
QUADRATURE_NODES = 11  # per dimension
ARMS = (0, 1)
SUMS = ("zeros", "some", "sum", "mean_log", "dev_log")
# Centring: moves chained in one job, longest move, most jobs, and the move (in units of
# the spread) at which all clusters have arrived.
CHAINED, LONGEST_MOVE, MOST_JOBS, ARRIVED = 4, 1.0, 16, 1e-3
# Search: a spread below 1 % (log scale) counts as none; other bounds keep a separated
# arm or a shape without limit from running away.  Longest steps, the gain in log
# likelihood below which a step no longer matters, what other nodes may change in it (and
# what at most, where the slopes get smaller), and the width of the differences.
MIN_LOG_SD, MAX_COEF, MAX_LOG_SHAPE = math.log(0.01), 25.0, 20.0
LONGEST_STEP, LONGEST_SD_STEP, RUN_AWAY_STEP, MOST_RADIUS = 2.0, 1.0, 5.0, 4.0
FINAL_GAIN, NODE_ERROR, NODE_CHANGE = 1e-5, 1e-4, 0.1
WIDTH = 1e-5
NO_INFORMATION = 1e-4  # slope and curvature below which the data say nothing about a parameter
STEADY = 0.3  # from this size on, equal steps in a row are made longer
SHORTEST = 1e-4  # radius below which no step is tried


def collapse_cells(df: DataFrame, cluster: str = "nurse", arm: str = "randomization", outcome: str = "outcome",
                   treated: str = "IPI enabled") -> DataFrame:
    """Sufficient table of an intercept + arm model: ``cluster, x, y, c``.

    Rows with a missing cluster, arm or outcome are left out (as a model
    frame drops them).
    """
    keep = df.filter(F.col(cluster).isNotNull() & F.col(arm).isNotNull() & F.col(outcome).isNotNull())
    cells = keep.groupBy(
        F.col(cluster).alias("cluster"),
        F.when(F.col(arm) == treated, 1).otherwise(0).alias("x"),
        F.col(outcome).cast("double").alias("y"),
    ).agg(F.count(F.lit(1)).cast("double").alias("c"))
    return cells


def with_constants(values: DataFrame) -> DataFrame:
    """Add the parameter-free part of the count densities, log Gamma(y + 1),
    once, so the per-evaluation expression stays small."""
    return values.withColumn("lgy1", lgamma(F.col("y") + F.lit(1.0)))


def cluster_sums(cells: DataFrame) -> DataFrame:
    """One row for each (_m, cluster) with the sums of both arms: ``zeros_<x>`` and ``some_<x>``
    (units without and with an outcome above 0), ``sum_<x>`` of the outcomes, ``mean_log_<x>`` and
    ``dev_log_<x>`` (mean and squared deviations of the logs of those above 0)."""
    y, c = F.col("y"), F.col("c")
    some = y > 0
    log = F.log(F.when(some, y))
    first = cells.groupBy("_m", "cluster", "x").agg(
        F.sum(F.when(some, 0.0).otherwise(c)).alias("zeros"), F.sum(F.when(some, c).otherwise(0.0)).alias("some"),
        F.sum(c * y).alias("sum"), (F.sum(c * log) / F.sum(F.when(some, c))).alias("mean_log"))
    # Deviations from the mean, not a difference of squares that would lose its digits.
    off = cells.join(first.select("_m", "cluster", "x", "mean_log"), ["_m", "cluster", "x"])
    off = off.groupBy("_m", "cluster", "x").agg(F.sum(c * (log - F.col("mean_log")) ** 2).alias("dev_log"))
    both = first.join(off, ["_m", "cluster", "x"])
    return both.groupBy("_m", "cluster").agg(*[
        F.coalesce(F.sum(F.when(F.col("x") == x, F.col(k))), F.lit(0.0)).alias(f"{k}_{x}") for x in ARMS for k in SUMS])


def _shape_part(y: Column, lgy1: Column, th: Column) -> tuple[Column, Column]:
    """log Gamma(y + phi) - log Gamma(phi) - log Gamma(y + 1), and phi times its derivative by phi."""
    log_phi, one = th["log_phi"], F.lit(1.0)
    phi = F.exp(F.greatest(log_phi, F.lit(-300.0)))  # never 0: it is divided by
    a, b = y + phi, y + one
    flat = ((a - F.lit(0.5)) * F.log1p(y / phi) + y * log_phi - y + (one / a - one / phi) / F.lit(12.0)) - lgy1
    far = ((b - F.lit(0.5)) * F.log1p((phi - one) / b) + (phi - one) * (F.log(a) - one) + (one / a - one / b) / F.lit(12.0)
           - (one / (a * a * a) - one / (b * b * b)) / F.lit(360.0)) - th["lg_phi"]
    value = (F.when(log_phi > F.lit(STIRLING_LOG_PHI), flat).when(y > F.lit(STIRLING_OUTCOME), far)
             .otherwise(lgamma(a) - th["lg_phi"] - lgy1))
    slope = F.when(log_phi > F.lit(STIRLING_LOG_PHI), F.log1p(y / phi) + (one / phi - one / a) / 2).otherwise(digamma(a) - th["dg_phi"])
    return value, phi * slope


def _arm_densities(family: str, arm: int, second: bool) -> tuple[list[dict[str, Column]], dict[str, Column]]:
    """Columns over rows (th, z1, z2 and the sums of :func:`cluster_sums`): the log density
    ``ll`` of the arm's outcomes at the row's random effects, its derivatives by the linear
    predictors (``d_eta``, ``d_zeta``) and the shape (``d_shape``); with ``second`` the first and
    second ones by the predictors (``ee``, ``ez``, ``zz``) instead.  Without :func:`_shape_part`.

    First come intermediate values, step by step, each worked out once."""
    steps: list[dict[str, Column]] = []
    th, nil, one = F.col("th"), F.lit(0.0), F.lit(1.0)

    def c(name: str) -> Column:
        return F.col(f"{name}_{arm}")

    def step(**values: Column) -> None:
        steps.append({f"{k}_{arm}": v for k, v in values.items()})

    zeros, some, total = c("zeros"), c("some"), c("sum")
    step(eta=th["b0"] + th["b1"] * F.lit(float(arm)) + F.col("z1"))
    if family in ("zi_negative_binomial", "hurdle_lognormal"):
        step(zeta=th["g0"] + th["g1"] * F.lit(float(arm)) + F.col("z2"))
        step(log_pi=-softplus(-c("zeta")), log_rest=-softplus(c("zeta")))
        step(pi=F.exp(c("log_pi")))
    if family == "binomial":
        units = zeros + some
        step(mean=one / (one + F.exp(-c("eta"))))
        out = {"ll": total * c("eta") - units * softplus(c("eta")), "d_eta": total - units * c("mean"), "d_zeta": nil, "d_shape": nil,
               "ee": -units * c("mean") * (one - c("mean")), "ez": nil, "zz": nil}
    elif family == "hurdle_lognormal":
        step(spread=F.exp(-th["log_sigma"]), off=c("mean_log") - c("eta"))
        step(square=c("spread") * c("spread"))
        step(squares=c("square") * (c("dev_log") + some * c("off") * c("off")))
        out = {"ll": some * (c("log_rest") - c("mean_log") - th["log_sigma"] - F.lit(HALF_LOG_2PI)) - c("squares") / 2 + zeros * c("log_pi"),
               "d_eta": some * c("square") * c("off"), "d_zeta": zeros - (zeros + some) * c("pi"), "d_shape": c("squares") - some,
               "ee": -some * c("square"), "ez": nil, "zz": -(zeros + some) * c("pi") * (one - c("pi"))}
    elif family in ("negative_binomial", "zi_negative_binomial"):
        step(phi=F.exp(F.greatest(th["log_phi"], F.lit(-300.0))), odds=c("eta") - th["log_phi"])
        step(rest=softplus(c("odds")), less=softplus(-c("odds")))  # log((phi + mu) / phi), log((phi + mu) / mu)
        step(share=F.exp(-c("less")), left=F.exp(-c("rest")), none=-c("phi") * c("rest"))
        counts = zeros + some if family == "negative_binomial" else some
        ll = counts * c("none") - total * c("less")
        by_eta = total * c("left") - counts * c("phi") * c("share")
        by_shape = counts * c("phi") * (c("share") - c("rest")) - total * c("left")
        curved = -(total + counts * c("phi")) * c("share") * c("left")
        if family == "negative_binomial":
            out = {"ll": ll, "d_eta": by_eta, "d_zeta": nil, "d_shape": by_shape, "ee": curved, "ez": nil, "zz": nil}
        else:
            step(at_zero=log_sum_exp2(c("log_pi"), c("log_rest") + c("none")), by_eta=-c("phi") * c("share"))  # of one zero
            # the probability that a zero isn't a count
            step(extra=F.exp(c("log_pi") - c("at_zero")))
            step(mixed=c("extra") * (one - c("extra")))
            out = {"ll": zeros * c("at_zero") + some * c("log_rest") + ll, "d_eta": zeros * (one - c("extra")) * c("by_eta") + by_eta,
                   "d_zeta": zeros * c("extra") - (zeros + some) * c("pi"),
                   "d_shape": zeros * (one - c("extra")) * c("phi") * (c("share") - c("rest")) + by_shape,
                   "ee": zeros * (c("mixed") * c("by_eta") * c("by_eta") - (one - c("extra")) * c("phi") * c("share") * c("left")) + curved,
                   "ez": -zeros * c("mixed") * c("by_eta"), "zz": zeros * c("mixed") - (zeros + some) * c("pi") * (one - c("pi"))}
    else:
        raise ValueError(f"unknown family {family!r}")
    return steps, {k: out[k] for k in (("d_eta", "d_zeta", "ee", "ez", "zz") if second else ("ll", "d_eta", "d_zeta", "d_shape"))}


def _densities(family: str, second: bool = False) -> tuple[list[dict[str, Column]], dict[str, Column]]:
    """The columns of both arms, and each outcome column of one as ``<name>_<x>``."""
    arms = [_arm_densities(family, x, second) for x in ARMS]
    steps = [reduce(dict.__or__, step) for step in zip(*[steps for steps, _ in arms])]
    return steps, {f"{k}_{x}": v for x, (_, out) in zip(ARMS, arms) for k, v in out.items()}


def _with_densities(rows: DataFrame, densities: tuple[list[dict[str, Column]], dict[str, Column]], keep: list[str]) -> DataFrame:
    steps, out = densities
    return reduce(DataFrame.withColumns, steps, rows).select(*keep, *[v.alias(k) for k, v in out.items()])


def _exp(v: float) -> float:
    """exp, never 0: it is divided by, and a wild step of the search must not fail."""
    return math.exp(max(v, -300.0)) if v < 700 else float("inf")


def _array(rows: list[dict[str, float]]) -> str:
    """SQL text of an array of structs: one call to the JVM instead of one a number."""
    def number(v: float) -> str:
        return f"{float(v)!r}D" if math.isfinite(v) else f"double('{v}')"
    return "array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{k}', {number(v)}" for k, v in r.items()) + ")" for r in rows) + ")"


def _lgamma(v: float) -> float:
    """log Gamma; +inf where it overflows (the step is then rejected)."""
    try:
        return math.lgamma(v)
    except (OverflowError, ValueError):
        return float("inf")


def _digamma(v: float) -> float:
    """Derivative of log Gamma, by the Column's rule."""
    if not math.isfinite(v):
        return float("inf")
    shift = sum(1.0 / (v + k) for k in range(DIGAMMA_SHIFT))
    t = v + DIGAMMA_SHIFT
    return math.log(t) - 0.5 / t - sum(c / t ** (2 * k + 2) for k, c in enumerate(DIGAMMA_SERIES)) - shift


@dataclass
class Fit:
    family: str
    names: list[str]
    theta: np.ndarray
    cov: np.ndarray
    loglik: float
    iterations: int
    converged: bool = True
    centres: DataFrame | None = None  # cluster, m1, m2: the modes of the random effects
    held: tuple[str, ...] = ()  # parameters that ended at a bound

    def coef_table(self) -> pd.DataFrame:
        """Estimates with Wald intervals; a variance that is not positive gives NaN
        bounds, and ``converged`` says whether the fit ended at an optimum."""
        var = np.diag(self.cov)
        se = np.sqrt(np.where(var > 0, var, np.nan))
        rows = []
        for i, name in enumerate(self.names):
            est = float(self.theta[i])
            z = est / se[i]
            p = math.erfc(abs(z) / math.sqrt(2.0)) if not math.isnan(z) else float("nan")
            rows.append((_part(name), _term(name), est, float(se[i]), z, p, est - 1.959963984540054 * se[i],
                         est + 1.959963984540054 * se[i], self.converged))
        return pd.DataFrame(rows, columns=["part", "term", "estimate", "std_error", "z_value", "p_value", "lower",
                                           "upper", "converged"])


def _part(name: str) -> str:
    return {"b": "count", "g": "zero"}.get(name[0], "variance" if name.startswith("l") else "dispersion")


def _term(name: str) -> str:
    return {"b0": "(Intercept)", "b1": "randomizationIPI enabled", "g0": "(Intercept)",
            "g1": "randomizationIPI enabled"}.get(name, name)


class ClusteredModels:
    """Fits of one family for several outcomes at once.  ``cells`` are those of
    :func:`collapse_cells` with the number of their model in ``_m``.

    ``max_log_phi`` caps the negative binomial shape of each model (None: no cap)."""

    def __init__(self, spark: SparkSession, cells: DataFrame, family: str, models: int, n_nodes: int = QUADRATURE_NODES,
                 diagonal: bool = False, max_log_phi: list[float | None] | None = None):
        self.spark, self.family, self.models = spark, family, models
        self.max_log_phi = max_log_phi or [None] * models
        self.names = [p for p in PARAMS[family] if not (diagonal and p == "l21")]
        self.dim = 2 if "l22" in self.names else 1
        x, w = np.polynomial.hermite.hermgauss(n_nodes)
        # The log weight of a node with its part of the change of variables.
        part = np.log(w) + x ** 2 + 0.5 * math.log(2.0)
        if self.dim == 1:
            self.nodes = [(a, 0.0, u) for a, u in zip(x, part)]
        else:
            self.nodes = [(a, b, u + v) for a, u in zip(x, part) for b, v in zip(x, part)]
        cells = cells.select("_m", "cluster", F.col("x").cast("int").alias("x"), "y", "c")
        cores = spark.sparkContext.defaultParallelism
        # Few clusters mean many rows (vectors x nodes each): they are spread over all cores.
        start = {"m1": 0.0, "m2": 0.0, "s11": 1.0, "s21": 0.0, "s22": 1.0}
        self.sums = [f"{k}_{x}" for x in ARMS for k in SUMS]
        self.centres = materialize(
            cluster_sums(cells).withColumns({k: F.lit(v) for k, v in start.items()}).repartition(cores), "glmm-centres")
        # The different outcomes, for the part of the counts that depends on the shape alone.
        self.outcomes = None
        if "log_phi" in self.names:
            counts = cells.where(F.col("y") > 0).groupBy("_m", "y").agg(F.sum("c").alias("c"))
            self.outcomes = materialize(with_constants(counts), "glmm-outcomes")
        self.jobs = 0

    def _theta(self, vector: np.ndarray, model: int = 0) -> dict[str, float]:
        t = {n: 0.0 for n in PARAMS[self.family]} | dict(zip(self.names, map(float, vector)))
        if "log_phi" in t:
            if self.max_log_phi[model] is not None:
                t["log_phi"] = min(t["log_phi"], self.max_log_phi[model])
            t["lg_phi"], t["dg_phi"] = _lgamma(_exp(t["log_phi"])), _digamma(_exp(t["log_phi"]))
        # the triangular factor of the random effects' covariance
        t |= {"a11": _exp(t["l11"]), "a21": t.get("l21", 0.0), "a22": _exp(t.get("l22", 0.0)),
              "logdet": t["l11"] + t.get("l22", 0.0)}
        return t

    def _packed(self, batches: dict[int, list[np.ndarray]]) -> Column:
        """The parameter vectors of the row's model."""
        def of(model: int) -> str:
            return _array([self._theta(t, model) for t in batches[model]])
        return F.expr(f"element_at(map({', '.join(f'{m}, {of(m)}' for m in batches)}), _m)")

    @cached_property
    def _first(self) -> tuple:
        return _densities(self.family)

    @cached_property
    def _second(self) -> tuple:
        return _densities(self.family, second=True)

    @cached_property
    def _columns(self) -> dict:
        """The columns of an evaluation, made once: they are the same for all vectors."""
        root2, th = F.lit(math.sqrt(2.0)), F.col("th")
        nodes = F.expr(_array([dict(zip(("x1", "x2", "lw"), node)) for node in self.nodes]))
        effects = {"z1": F.col("m1") + root2 * F.col("s11") * F.col("node.x1"),
                   "z2": F.col("m2") + root2 * (F.col("s21") * F.col("node.x1") + F.col("s22") * F.col("node.x2"))}
        d = {k: [F.col(f"{k}_{x}") for x in ARMS] for k in ("ll", "d_eta", "d_zeta", "d_shape")}
        own = {"ll": d["ll"][0] + d["ll"][1], "shape": d["d_shape"][0] + d["d_shape"][1], "b0": d["d_eta"][0] + d["d_eta"][1],
               "b1": d["d_eta"][1], "g0": d["d_zeta"][0] + d["d_zeta"][1], "g1": d["d_zeta"][1]}
        spread = [{"u1": F.col("z1") / th["a11"]}]
        u1, u2 = F.col("u1"), F.col("u2")
        quad, scale, own["l11"] = u1 * u1, F.log("s11"), u1 * u1 - 1
        if self.dim == 2:
            spread.append({"u2": (F.col("z2") - th["a21"] * u1) / th["a22"]})
            quad, scale = quad + u2 * u2, scale + F.log("s22")
            own |= {"l11": u1 * u1 - u2 * th["a21"] * u1 / th["a22"] - 1, "l21": u1 * u2 / th["a22"], "l22": u2 * u2 - 1}
        value = own["ll"] + F.col("node.lw") + scale - quad / 2 - th["logdet"] - F.lit(self.dim * HALF_LOG_2PI)
        scores = {n: own["shape" if n.startswith("log_") else n] for n in self.names}

        def weighted(part: str | None) -> Column:
            return F.aggregate("at", F.lit(0.0), lambda found, e: found + F.exp(e["v"] - F.col("top")) * (e[part] if part else F.lit(1.0)))

        return {"nodes": F.posexplode(nodes).alias("q", "node"), "effects": effects, "spread": spread,
                "at": F.struct(value.alias("v"), *[v.alias(n) for n, v in scores.items()]).alias("at"),
                "top": F.array_max(F.transform("at", lambda e: e["v"])),
                "weighted": [weighted(None).alias("w"), *[weighted(n).alias(n) for n in self.names]],
                "totals": [F.sum(F.col("top") + F.log("w")).alias("l"), *[F.sum(F.col(n) / F.col("w")).alias(n) for n in self.names]]}

    def _evaluate(self, batches: dict[int, list[np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Negative log likelihood and score of each model's parameter vectors -- one
        Spark job for all of them."""
        base, e = self.centres, self._columns
        if len(batches) < self.models:
            base = base.where(F.col("_m").isin(list(batches)))
        rows = base.select("*", F.posexplode(self._packed(batches)).alias("tid", "th")).select("*", e["nodes"]).withColumns(e["effects"])
        rows = _with_densities(rows, self._first, ["_m", "tid", "cluster", "th", "z1", "z2", "node", "s11", "s22"])
        once = reduce(DataFrame.withColumns, e["spread"], rows)
        per = once.select("_m", "tid", "cluster", e["at"]).groupBy("_m", "tid", "cluster").agg(F.collect_list("at").alias("at"))
        per = per.withColumn("top", e["top"]).select("_m", "tid", "top", *e["weighted"])
        totals = per.groupBy("_m", "tid").agg(*e["totals"])
        # Of the vectors around a point most have the same shape.
        shapes = {m: list(dict.fromkeys(self._theta(t, m).get("log_phi") for t in b)) for m, b in batches.items()}
        if self.outcomes is not None:
            totals = totals.withColumn("sid", F.lit(-1)).unionByName(self._shape_totals(shapes), allowMissingColumns=True)
        out = totals.collect()
        self.jobs += 1
        found = {m: (np.full(len(b), np.inf), np.full((len(b), len(self.names)), np.nan)) for m, b in batches.items()}
        of_shape = {(r["_m"], r["sid"]): (r["l"], r["log_phi"]) for r in out if self.outcomes is not None and r["sid"] >= 0}
        for r in out:
            if r["tid"] is None:
                continue
            m, tid = r["_m"], r["tid"]
            shape = self._theta(batches[m][tid], m).get("log_phi")
            # a model of which no outcome is above 0 has no such part
            extra, slope = of_shape.get((m, shapes[m].index(shape)), (0.0, 0.0))
            if r["l"] is not None and extra is not None and math.isfinite(r["l"] + extra):
                found[m][0][tid] = -(r["l"] + extra)
                found[m][1][tid] = [-(r[n] + (slope if n == "log_phi" else 0.0)) if r[n] is not None else math.nan for n in self.names]
        return found

    def _shape_totals(self, shapes: dict[int, list[float]]) -> DataFrame:
        """The part of the counts outside of the integrals, at each shape of a model."""
        def of(model: int) -> str:
            return _array([{"log_phi": v, "lg_phi": _lgamma(_exp(v)), "dg_phi": _digamma(_exp(v))} for v in shapes[model]])
        packed = F.expr(f"element_at(map({', '.join(f'{m}, {of(m)}' for m in shapes)}), _m)")
        rows = self.outcomes.where(F.col("_m").isin(list(shapes))).select("*", F.posexplode(packed).alias("sid", "th"))
        value, slope = self._shape_columns
        return rows.groupBy("_m", "sid").agg(F.sum(F.col("c") * value).alias("l"), F.sum(F.col("c") * slope).alias("log_phi"))

    @cached_property
    def _shape_columns(self) -> tuple[Column, Column]:
        return _shape_part(F.col("y"), F.col("lgy1"), F.col("th"))

    def centre(self, thetas: list[np.ndarray], settle: bool = True) -> None:
        """Moves the nodes to each cluster's mode and curvature, by Newton's steps; without
        ``settle`` one chain of them only."""
        th = F.element_at(self._packed({m: [t] for m, t in enumerate(thetas)}), 1)
        for _ in range(MOST_JOBS if settle else 1):
            state = self.centres.withColumn("th", th)
            for _ in range(CHAINED):
                state = self._moved(state)
            state = state.drop("th")
            state = materialize(state, "glmm-centres")
            self.centres = state.drop("move")
            self.jobs += 1
            if settle and (state.agg(F.max("move")).first()[0] or 0.0) < ARRIVED:
                break

    def _moved(self, state: DataFrame) -> DataFrame:
        own = ["_m", "cluster", "th", *self.sums]
        rows = state.select(*own, F.col("m1").alias("z1"), F.col("m2").alias("z2"))
        rows = _with_densities(rows, self._second, [*own, "z1", "z2"])
        at = rows.select(*own, *self._moves["sums"])
        return reduce(DataFrame.withColumns, self._moves["steps"], at).select(*own, *self._moves["out"])

    @cached_property
    def _moves(self) -> dict:
        """The columns of a Newton step of the clusters' modes."""
        c = F.col
        sums = [c("z1").alias("m1"), c("z2").alias("m2"),
                *[(c(f"{k}_0") + c(f"{k}_1")).alias(k) for k in ("d_eta", "d_zeta", "ee", "ez", "zz")]]
        a11, a21, a22 = c("th.a11"), c("th.a21"), c("th.a22")
        one = F.lit(1.0)
        if self.dim == 2:
            steps = [{"u1": c("m1") / a11}, {"u2": (c("m2") - a21 * c("u1")) / a22},
                     {"p1": c("d_eta") - c("u1") / a11 + c("u2") * a21 / (a11 * a22), "p2": c("d_zeta") - c("u2") / a22,
                      "q11": one / (a11 * a11) + a21 * a21 / (a11 * a11 * a22 * a22) - c("ee"),
                      "q21": -a21 / (a11 * a22 * a22) - c("ez"), "q22": one / (a22 * a22) - c("zz")}]
        else:
            steps = [{"p1": c("d_eta") - c("m1") / (a11 * a11), "p2": F.lit(0.0), "q11": one / (a11 * a11) - c("ee"),
                      "q21": F.lit(0.0), "q22": one}]
        # Where the surface isn't concave, a step along the slopes alone.
        steps.append({"proper": (c("q11") > 0) & (c("q22") > 0) & (c("q11") * c("q22") > c("q21") ** 2)})
        least = F.lit(1e-3)
        steps.append({k: F.when(c("proper"), c(k)).otherwise(v) for k, v in (
            ("q11", F.greatest(F.abs("q11"), least)), ("q22", F.greatest(F.abs("q22"), least)), ("q21", F.lit(0.0)))})
        steps.append({"det": c("q11") * c("q22") - c("q21") ** 2})
        steps.append({"d1": (c("q22") * c("p1") - c("q21") * c("p2")) / c("det"),
                      "d2": (c("q11") * c("p2") - c("q21") * c("p1")) / c("det"),
                      # the inverse curvature is the spread; its lower triangular factor scales the nodes
                      "s11": F.sqrt(c("q22") / c("det"))})
        steps.append({"far": F.least(one, F.lit(LONGEST_MOVE) / F.sqrt(c("d1") ** 2 + c("d2") ** 2 + 1e-300))})
        out = [(c("m1") + c("far") * c("d1")).alias("m1"), (c("m2") + c("far") * c("d2")).alias("m2"), c("s11"),
               (-c("q21") / c("det") / c("s11")).alias("s21"), (one / F.sqrt("q22")).alias("s22"),
               (c("far") * F.greatest(F.abs("d1"), F.abs("d2")) / F.least(c("s11"), one)).alias("move")]
        return {"sums": sums, "steps": steps, "out": out}

    # -- search ---------------------------------------------------------------
    def _bounds(self, model: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = [], []
        for n in self.names:
            if n in ("l11", "l22"):
                low.append(MIN_LOG_SD), high.append(MAX_COEF)
            elif n in ("log_phi", "log_sigma"):
                cap = self.max_log_phi[model] if n == "log_phi" else None
                low.append(-MAX_LOG_SHAPE), high.append(MAX_LOG_SHAPE if cap is None else min(cap, MAX_LOG_SHAPE))
            else:
                low.append(-MAX_COEF), high.append(MAX_COEF)
        return np.array(low), np.array(high)

    @cached_property
    def _longest(self) -> np.ndarray:
        return np.array([LONGEST_SD_STEP if n in ("l11", "l21", "l22") else LONGEST_STEP for n in self.names])

    def _stencil(self, theta: np.ndarray) -> list[np.ndarray]:
        return [theta, *(theta + np.eye(len(theta)) * WIDTH)]

    def _newton(self, model: int, theta: np.ndarray, values: np.ndarray, scores: np.ndarray,
                before: "_Step | None" = None) -> "_Step":
        """The step from a point with the scores around it; parameters that are at a
        bound and pushed beyond it, or of which the data say nothing, are held.

        Where a parameter runs off (an arm without zeros, a spread of nothing), the
        likelihood falls off exponentially and Newton's steps stay the same, one after the
        other: each is then made twice as long as the one ``before``."""
        p = len(theta)
        g, H = scores[0], (scores[1:] - scores[0]) / WIDTH
        H = (H + H.T) / 2
        low, high = self._bounds(model)
        free = ~(((theta <= low) & (g > 0)) | ((theta >= high) & (g < 0)))
        free &= ~((np.abs(g) < NO_INFORMATION) & (np.abs(np.diag(H)) < NO_INFORMATION))
        for a, b in (("l11", "l21"),):  # without a spread of the first effect nothing can be shared with the second
            if a in self.names and b in self.names and not free[self.names.index(a)]:
                free[self.names.index(b)] = False
        gain, proper = 0.0, bool(np.all(np.isfinite(H)) and np.all(np.isfinite(g)))
        plain = np.zeros(p)
        if proper and free.any():
            w, V = np.linalg.eigh(H[np.ix_(free, free)])
            proper = bool(np.all(w > 0))
            w, slope = _curvatures(w), V.T @ g[free]
            plain[free] = -V @ (slope / w)
            gain = float(slope @ (slope / w)) / 2
        stride = np.ones(p)
        if before is not None and gain < 1:
            same = (np.abs(plain) > STEADY) & (plain * before.plain > 0) & (np.abs(plain - before.plain) < 0.5 * np.abs(before.plain))
            stride = np.where(same, 2 * before.stride, 1.0)
        return _Step(theta, float(values[0]), g, H, free, gain, proper, plain, stride)

    def _step(self, model: int, s: "_Step", radius: float) -> np.ndarray:
        """The step of at most ``radius`` (in units of the parameters' longest steps) that the
        slopes and curvatures expect most of."""
        step = np.zeros(len(s.theta))
        if s.free.any() and np.all(np.isfinite(s.information)) and np.all(np.isfinite(s.score)):
            unit = self._longest[s.free]
            w, V = np.linalg.eigh(s.information[np.ix_(s.free, s.free)] * np.outer(unit, unit))
            slope = V.T @ (s.score[s.free] * unit)
            flat = _curvatures(w)

            def damped(more: float) -> np.ndarray:
                # where the surface isn't convex the damping at least makes up for it
                return -slope / (np.maximum(w + more, 1e-8 * np.abs(w).max() + 1e-300) if more > 0 else flat)
            at = damped(0.0)
            if np.linalg.norm(at) > radius or w.min() <= 0:
                low, high = max(0.0, -w.min()), max(0.0, -w.min()) + np.linalg.norm(slope) / radius
                for _ in range(60):
                    more = (low + high) / 2
                    low, high = (more, high) if np.linalg.norm(damped(more)) > radius else (low, more)
                at = damped(high)
            step[s.free] = unit * (V @ at)
        if radius >= 1:  # what runs off goes faster, unless that went wrong
            step = np.where(s.stride > 1, np.clip(step * s.stride, -RUN_AWAY_STEP, RUN_AWAY_STEP), step)
        low, high = self._bounds(model)
        return np.clip(step + s.theta, low, high) - s.theta

    def _begin(self) -> list[np.ndarray]:
        names = {k: [f"{k}_{x}" for x in ARMS] for k in SUMS}
        s = self.centres.groupBy("_m").agg(
            *[F.sum(v).alias(v) for k in ("zeros", "some", "sum") for v in names[k]],
            *[F.sum(F.col(some) * F.col(v)).alias(v) for some, v in zip(names["some"], names["mean_log"])]).collect()
        self.jobs += 1

        def lg(v):
            return math.log(max(v or 0.0, 1e-3))

        def logit(p):
            p = min(max(p or 0.0, 1e-3), 1 - 1e-3)
            return math.log(p / (1 - p))

        out = []
        for m in range(self.models):
            by = {}
            for r in (r for r in s if r["_m"] == m):
                for x in ARMS:
                    zeros, some, total, logs = (r[f"{k}_{x}"] for k in ("zeros", "some", "sum", "mean_log"))
                    if zeros + some:
                        by[x] = {"mean": total / (zeros + some), "pos_mean": total / some if some else None,
                                 "log_mean": logs / some if some else None, "zero": zeros / (zeros + some)}
            if not by:
                raise ValueError("no units to fit")
            r0 = by.get(0, next(iter(by.values())))
            r1 = by.get(1, r0)
            init = {"l11": math.log(0.5), "l21": 0.0, "l22": math.log(0.5), "log_phi": 0.0, "log_sigma": 0.0}
            if self.family == "binomial":
                init.update(b0=logit(r0["mean"]), b1=logit(r1["mean"]) - logit(r0["mean"]))
            elif self.family == "hurdle_lognormal":
                init.update(b0=r0["log_mean"] or 0.0, b1=(r1["log_mean"] or 0.0) - (r0["log_mean"] or 0.0))
            else:
                key = "pos_mean" if self.family != "negative_binomial" else "mean"
                init.update(b0=lg(r0[key]), b1=lg(r1[key]) - lg(r0[key]))
            init.update(g0=logit(r0["zero"]), g1=logit(r1["zero"]) - logit(r0["zero"]))
            low, high = self._bounds(m)
            out.append(np.clip(np.array([init[n] for n in self.names], dtype=float), low, high))
        return out

    def _search(self, thetas: list[np.ndarray], max_iter: int) -> tuple[list["_Step"], int]:
        """Newton's steps of all models until none gains anything; the nodes follow every
        step.  Steps are held to a radius within which the gains are about as expected; one
        that doesn't go down is taken back, with its nodes."""
        open_models, steps, taken = set(range(self.models)), {}, 0
        radius, moved = dict.fromkeys(open_models, 1.0), {}
        nodes = self.centres
        while True:
            around = self._evaluate({m: self._stencil(thetas[m]) for m in open_models})
            back = set()
            for m in set(open_models):
                old = steps.get(m)
                new = self._newton(m, thetas[m], *around[m], old)
                if old is not None:
                    step, longest = moved[m]
                    expected = -float(old.score @ step + step @ old.information @ step / 2)
                    found = old.value - new.value + NODE_ERROR
                    if found >= min(0.05 * expected, 2 * NODE_ERROR):
                        if found < 0.25 * expected:
                            radius[m] = longest / 2
                        elif found > 0.7 * expected:
                            radius[m] = min(max(radius[m], 2 * longest), MOST_RADIUS)
                    # Close to the end other nodes change the value by more than the step does.
                    elif not (old.proper and new.proper and new.gain < old.gain / 2 and found > -NODE_CHANGE):
                        back.add(m)
                        radius[m] = longest / 4
                if m not in back:
                    steps[m] = new
                    if steps[m].gain <= FINAL_GAIN:
                        open_models.discard(m)
                if radius[m] < SHORTEST:
                    open_models.discard(m)  # no step goes down any more
                step = self._step(m, steps[m], radius[m]) if m in open_models else np.zeros(len(self.names))
                if not np.any(step):
                    open_models.discard(m)
                moved[m] = step, min(radius[m], float(np.linalg.norm(step / self._longest)))
                thetas[m] = steps[m].theta + step
            nodes = self._nodes_of(nodes, back)
            if not open_models or taken >= max_iter:
                break
            taken += 1
            self.centre(thetas, settle=False)
        for m, s in steps.items():
            thetas[m] = s.theta
        return [steps[m] for m in range(self.models)], taken

    def _nodes_of(self, before: DataFrame, back: set[int]) -> DataFrame:
        """The nodes as they are, for the models that went ``back`` as they were."""
        if back:
            old = F.col("_m").isin(list(back))
            self.centres = before.where(old).unionByName(self.centres.where(~old))
        return self.centres

    def fits(self, outer: int = 3, max_iter: int = 50) -> list[Fit]:
        """All models: up to ``outer`` searches, each from settled nodes, until one has
        nothing left to do."""
        thetas, iterations = self._begin(), 0
        for _ in range(outer):
            self.centre(thetas)
            steps, taken = self._search(thetas, max_iter)
            iterations += taken
            if not taken:
                break
        out = []
        for m, s in enumerate(steps):
            p = len(self.names)
            cov = np.full((p, p), np.nan)
            if s.proper and s.free.any():
                cov[np.ix_(s.free, s.free)] = np.linalg.inv(s.information[np.ix_(s.free, s.free)])
            held = tuple(n for n, f in zip(self.names, s.free) if not f)
            centres = self.centres.where(F.col("_m") == m).select("cluster", "m1", "m2")
            out.append(Fit(self.family, self.names, s.theta, cov, -s.value, iterations, s.proper and s.gain <= 10 * FINAL_GAIN,
                           centres, held))
        return out


@dataclass
class _Step:
    theta: np.ndarray
    value: float
    score: np.ndarray
    information: np.ndarray
    free: np.ndarray
    gain: float  # expected from the whole step
    proper: bool  # the information is positive definite
    plain: np.ndarray  # Newton's own step
    stride: np.ndarray  # and how many times it is taken


def _curvatures(w: np.ndarray) -> np.ndarray:
    """Eigenvalues as they are divided by: directions without curvature are as long as the
    longest step allows."""
    return np.maximum(np.abs(w), 1e-8 * max(1.0, np.abs(w).max()))


class ClusteredModel(ClusteredModels):
    """One family on one cells table (see :func:`collapse_cells`)."""

    def __init__(self, spark: SparkSession, cells: DataFrame, family: str, n_nodes: int = QUADRATURE_NODES,
                 diagonal: bool = False, max_log_phi: float | None = None):
        super().__init__(spark, cells.withColumn("_m", F.lit(0)), family, 1, n_nodes, diagonal, [max_log_phi])

    def fit(self, outer: int = 3, max_iter: int = 50) -> Fit:
        return self.fits(outer, max_iter)[0]

    def loglik(self, **params: float) -> float:
        """Marginal log likelihood at given parameters, with the present nodes."""
        return -float(self._evaluate({0: [np.array([params[n] for n in self.names])]})[0][0][0])


def model_cells(outcome: DataFrame) -> DataFrame:
    """Cells on shared storage."""
    return materialize(collapse_cells(outcome), "glmm-model")


def fit_model(spark: SparkSession, outcome: DataFrame, family: str, **kw) -> Fit:
    """Collapse an outcome table, keep the cells on shared storage, fit."""
    return ClusteredModel(spark, model_cells(outcome), family, **kw).fit()


def fit_models(spark: SparkSession, outcomes: list[DataFrame], family: str, **kw) -> list[Fit]:
    """Models of one family for several outcome tables, fitted in the same jobs."""
    cells = reduce(DataFrame.unionByName, [collapse_cells(o).withColumn("_m", F.lit(m)) for m, o in enumerate(outcomes)])
    return ClusteredModels(spark, cells, family, len(outcomes), **kw).fits()


def coef_frame(spark: SparkSession, fit: Fit, outcome_name: str) -> DataFrame:
    pdf = fit.coef_table()
    pdf.insert(0, "outcome", outcome_name)
    pdf.insert(1, "family", fit.family)
    return spark.createDataFrame(pdf)
