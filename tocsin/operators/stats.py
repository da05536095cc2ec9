"""Intra-cluster correlation, effects and results tables, residuals.

Every statistic starts from a per-cluster table (``count, mean, squares around
it``).  The REML fit is a search over a grid of variance ratios, refined level by
level, and the binary estimators are closed forms: aggregates over the clusters,
of which one row for each outcome is left.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.functions.special import beta_below, lgamma, softplus
from tocsin.operators.glmm import Fit
from tocsin.session import materialize


def icc_components(df: DataFrame, cluster: str = "nurse", outcome: str = "outcome") -> DataFrame:
    """O39 input: per cluster ``n``, mean and the sum of squares around it.

    Moments around the mean, not raw sums: nothing is truncated, overflows or
    cancels, whatever the size of the outcome.
    """
    y = F.col(outcome).cast("double")
    keep = df.filter(F.col(cluster).isNotNull() & F.col(outcome).isNotNull())
    return keep.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count(F.lit(1))).alias("m2"))


def icc_reml(components: pd.DataFrame) -> float:
    """Random-intercept ICC s2b / (s2b + s2w) by REML from per-cluster moments.

    The REML criterion is profiled over the variance ratio and maximised by
    golden-section search on a log scale (one dimension, K terms).
    """
    n = components["n"].to_numpy(float)
    ybar = components["mean"].to_numpy(float)
    N = n.sum()
    if len(n) < 2 or N <= len(n):
        return float("nan")
    within = components["m2"].to_numpy(float)  # sum of squares around the cluster means

    def crit(lam: float) -> float:
        w = n / (1.0 + n * lam)
        mu = np.sum(w * ybar) / np.sum(w)
        q = np.sum(within) + np.sum(w * (ybar - mu) ** 2)
        s2w = q / (N - 1)
        return -0.5 * ((N - 1) * math.log(s2w) + np.sum(np.log1p(n * lam)) + math.log(np.sum(w)))

    lo, hi = math.log(1e-10), math.log(1e6)
    g = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = crit(math.exp(c)), crit(math.exp(d))
    for _ in range(200):
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = crit(math.exp(c))
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = crit(math.exp(d))
    lam = math.exp((a + b) / 2)
    if crit(0.0) >= crit(lam):
        lam = 0.0
    return lam / (1.0 + lam)


#: Range of the log variance ratio, points a level and levels of the search: the last
#: step is below 1e-7.
LOG_RATIO, GRID, LEVELS = (math.log(1e-10), math.log(1e6)), 64, 6


def icc_reml_table(components: DataFrame, key: str = "outcome") -> DataFrame:
    """REML intra-cluster correlation of each ``key`` from its clusters' moments
    (``key, cluster, n, mean, m2``); null with fewer than two clusters or without
    a cluster of two units.

    The criterion is profiled over the ratio of the variances; each level is one
    aggregate over (cluster x grid point), and the next looks closer around the best."""
    per_key = components.groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").cast("double").alias("units"), F.sum("m2").alias("within"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    per_key = per_key.where("clusters >= 2 AND units > clusters")
    clusters = materialize(components.join(per_key, F.col(key) == F.col("_key")).select(
        "_key", F.col("n").cast("double").alias("n"), (F.col("mean") - F.col("grand")).alias("off"), "units", "within"), "icc-clusters")

    def criterion(points: DataFrame) -> DataFrame:
        """``points`` (_key, ratio, ...) with the restricted log likelihood ``crit``."""
        weight = F.col("n") / (F.lit(1.0) + F.col("n") * F.col("ratio"))
        sums = points.join(clusters, "_key").withColumn("w", weight).groupBy(points.columns).agg(
            F.sum("w").alias("a"), F.sum(F.col("w") * F.col("off")).alias("b"), F.sum(F.col("w") * F.col("off") ** 2).alias("c"),
            F.sum(F.log1p(F.col("n") * F.col("ratio"))).alias("l"), F.first("units").alias("units"), F.first("within").alias("within"))
        rest = F.col("within") + F.col("c") - F.col("b") ** 2 / F.col("a")
        return sums.select(*points.columns, (-0.5 * ((F.col("units") - 1) * F.log(rest / (F.col("units") - 1)) + F.col("l")
                                                     + F.log("a"))).alias("crit"))

    state = per_key.select("_key", F.lit(LOG_RATIO[0]).alias("low"), F.lit(LOG_RATIO[1]).alias("high"))
    for _ in range(LEVELS):
        step = (F.col("high") - F.col("low")) / (GRID - 1)
        points = state.select("_key", step.alias("step"), F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(GRID - 1)), lambda k: F.col("low") + k * step)).alias("at")).withColumn("ratio", F.exp("at"))
        # equal values (a flat criterion) go to the smaller ratio
        best = criterion(points).groupBy("_key").agg(F.max(F.struct("crit", (-F.col("at")).alias("at"), "step")).alias("best"))
        state = best.select("_key", (-F.col("best.at") - F.col("best.step")).alias("low"), (-F.col("best.at") + F.col("best.step")).alias("high"))
    ends = state.select("_key", F.explode(F.array(F.lit(0.0), F.exp((F.col("low") + F.col("high")) / 2))).alias("ratio"))
    ratio = criterion(ends).groupBy("_key").agg(F.max(F.struct("crit", (-F.col("ratio")).alias("ratio"))).alias("best")).select(
        "_key", (-F.col("best.ratio")).alias("ratio"))
    keys = components.select(F.col(key)).distinct()
    return keys.join(ratio, F.col(key) == F.col("_key"), "left").select(key, (F.col("ratio") / (1 + F.col("ratio"))).alias("icc"))


def icc_binary_counts(df: DataFrame, cluster: str = "nurse", y: str = "adverseEvent") -> DataFrame:
    """O40 input: per cluster ``n`` and number of events."""
    keep = df.filter(F.col(cluster).isNotNull() & F.col(y).isNotNull())
    return keep.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("y"))


def icc_binary_anova(counts: pd.DataFrame) -> float:
    """ICC of a binary outcome, analysis-of-variance estimator."""
    n = counts["n"].to_numpy(float)
    y = counts["y"].to_numpy(float)
    k, N = len(n), n.sum()
    if k < 2 or N <= k:
        return float("nan")
    msb = (np.sum(y * y / n) - y.sum() ** 2 / N) / (k - 1)
    msw = (y.sum() - np.sum(y * y / n)) / (N - k)
    n0 = (N - np.sum(n * n) / N) / (k - 1)
    den = msb + (n0 - 1) * msw
    return float((msb - msw) / den) if den > 0 else float("nan")


#: Fixed value: the constant of the stabilised moment estimator.
KAPPA = 0.45


def icc_binary_estimates(counts: DataFrame, key: str | None = None) -> DataFrame:
    """Intra-cluster correlations of a binary outcome from per-cluster counts
    (``n, y``), one row (for each ``key``): ``stabilised``, the moment estimator with
    weights by cluster size and the constant ``KAPPA``, and ``anova``, from the mean
    squares.  An estimate is null where it isn't defined (one cluster, no or only
    events), the stabilised one also outside 0 to 1."""
    n, y = F.col("n").cast("double"), F.col("y").cast("double")
    sums = counts.groupBy(*([key] if key else [])).agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("units"), F.sum(y).alias("events"), F.sum(n * n).alias("squares"),
        F.sum(y * y / n).alias("shares"))
    k, units, events = F.col("k"), F.col("units"), F.col("events")
    p = events / units
    size = (units - F.col("squares") / units) / (k - 1)  # what a cluster counts for
    spread = F.col("shares") / units - p * p  # weighted, of the clusters' shares
    usable = (k >= 2) & (events > 0) & (events < units) & (units > k)
    stabilised = (units * spread / ((k - 1) * p * (1 - p)) + KAPPA - 1) / (size - 1)
    between, within = (F.col("shares") - events * events / units) / (k - 1), (events - F.col("shares")) / (units - k)
    total = between + (size - 1) * within
    out = {"stabilised": F.when(usable, F.when(stabilised.between(0, 1), stabilised)),
           "anova": F.when(usable & (total > 0), (between - within) / total)}
    return sums.select(*([key] if key else []), *[v.alias(c) for c, v in out.items()])


# -- O45 / O46: effects and results tables -----------------------------------

def effects(fit: Fit, outcome: str) -> pd.DataFrame:
    """Arm effect per model part, with 95 % interval and p-value.

    Count and zero parts are exponentiated (rate ratio, odds ratio); the
    log-normal part of a hurdle model and every variance term are not.
    """
    tab = fit.coef_table()
    tab = tab[tab["term"] == "randomizationIPI enabled"].copy()
    expo = ~((tab["part"] == "count") & (fit.family == "hurdle_lognormal"))
    for c in ("estimate", "lower", "upper"):
        tab.loc[expo, c] = np.exp(tab.loc[expo, c])
    tab["exponentiated"] = expo
    tab.insert(0, "outcome", outcome)
    return tab[["outcome", "part", "term", "estimate", "lower", "upper", "p_value", "exponentiated", "converged"]]


RESULT_SCHEMA = T.StructType([
    T.StructField("Outcome", T.StringType()),
    T.StructField("IRR", T.DoubleType()),
    T.StructField("NB_lo", T.DoubleType()),
    T.StructField("NB_hi", T.DoubleType()),
    T.StructField("NB_p", T.DoubleType()),
    T.StructField("OR", T.DoubleType()),
    T.StructField("Z_lo", T.DoubleType()),
    T.StructField("Z_hi", T.DoubleType()),
    T.StructField("Z_p", T.DoubleType()),
    T.StructField("icc", T.DoubleType()),
    T.StructField("converged", T.BooleanType()),
])


def results_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """One row per outcome with the count-part and zero-part effects,
    intervals as "lo to hi" text (2 decimals) and ICC ("<0.01" when small);
    ``converged`` marks rows whose model's fit ended at an optimum.

    ``rows``: ``(outcome, effects frame, icc)`` per outcome.
    """
    flat = []
    for name, eff, icc in rows:
        cnt = eff[eff["part"] == "count"].iloc[0]
        zro = eff[eff["part"] == "zero"]
        z = zro.iloc[0] if len(zro) else None
        flat.append((name, float(cnt.estimate), float(cnt.lower), float(cnt.upper), float(cnt.p_value),
                     float(z.estimate) if z is not None else None, float(z.lower) if z is not None else None,
                     float(z.upper) if z is not None else None, float(z.p_value) if z is not None else None,
                     None if icc is None else float(icc), bool(eff["converged"].all()) if "converged" in eff else None))
    return formatted_results(spark.createDataFrame(flat, RESULT_SCHEMA))


def formatted_results(df: DataFrame) -> DataFrame:
    """The table's text from effects (``RESULT_SCHEMA``)."""
    span = lambda lo, hi: F.format_string("%s to %s", F.round(lo, 2).cast("string"), F.round(hi, 2).cast("string"))
    return df.select(
        "Outcome", "IRR", span(F.col("NB_lo"), F.col("NB_hi")).alias("NB_95_CI"), F.col("NB_p").alias("NB_p_value"),
        "OR", span(F.col("Z_lo"), F.col("Z_hi")).alias("CI_95"), F.col("Z_p").alias("p_value"),
        F.when(F.col("icc") < 0.01, "<0.01").otherwise(F.round("icc", 2).cast("string")).alias("ICC"), "converged")


def crude_effects(outcomes: DataFrame, key: str, treated: str = "IPI enabled") -> DataFrame:
    """Effects by arm without a model, in the columns of ``RESULT_SCHEMA``: the ratio of
    the means and the odds ratio of a zero (half a unit added to each count), with
    intervals on the log scale; null where an arm has no units or a mean of 0."""
    y = F.col("outcome").cast("double")
    arm = F.when(F.col("randomization") == treated, 1).when(F.col("randomization").isNotNull(), 0)
    parts = outcomes.where(F.col("outcome").isNotNull()).withColumn("_arm", arm).groupBy(key).pivot("_arm", [0, 1]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("z"))
    c = F.col
    log_ratio = F.log(F.try_divide(c("1_m"), c("0_m")))
    spread = F.sqrt(sum(F.try_divide(c(f"{a}_v"), c(f"{a}_n") * c(f"{a}_m") ** 2) for a in (0, 1)))
    cells = [c(f"{a}_z") + 0.5 for a in (1, 0)], [c(f"{a}_n") - c(f"{a}_z") + 0.5 for a in (1, 0)]
    log_odds = F.log(cells[0][0] / cells[1][0]) - F.log(cells[0][1] / cells[1][1])
    width = F.sqrt(sum(F.lit(1.0) / v for side in cells for v in side))
    z, none = F.lit(1.959963984540054), F.lit(None).cast("double")
    return parts.select(F.col(key).alias("Outcome"), F.exp(log_ratio).alias("IRR"), F.exp(log_ratio - z * spread).alias("NB_lo"),
                        F.exp(log_ratio + z * spread).alias("NB_hi"), none.alias("NB_p"), F.exp(log_odds).alias("OR"),
                        F.exp(log_odds - z * width).alias("Z_lo"), F.exp(log_odds + z * width).alias("Z_hi"), none.alias("Z_p"),
                        none.alias("icc"), F.lit(None).cast("boolean").alias("converged"))


# -- O44: randomised quantile residuals ---------------------------------------

def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, by Gauss-Legendre nodes from 0 to z."""
    x, w = np.polynomial.legendre.leggauss(48)
    nodes = F.expr("array(" + ", ".join(f"named_struct('x', {float(p)!r}D, 'w', {float(q)!r}D)" for p, q in zip(x, w)) + ")")
    half = F.least(F.abs(z), F.lit(9.0)) / 2
    inside = F.aggregate(nodes, F.lit(0.0), lambda found, n: found + n["w"] * F.exp(-((half * (n["x"] + 1)) ** 2) / 2))
    return F.lit(0.5) + F.signum(z) * inside * half / F.lit(math.sqrt(2.0 * math.pi))


def _negative_binomial_below(y: Column, eta: Column, log_phi: float) -> tuple[Column, Column]:
    """P(Y < y) and P(Y = y): the incomplete beta integral, at the same cost for every y."""
    phi = F.lit(math.exp(min(max(log_phi, -300.0), 300.0)))
    odds = eta - F.lit(log_phi)  # log(mu / phi)
    rest = softplus(odds)
    at = F.exp(lgamma(y + phi) - lgamma(phi) - lgamma(y + 1) - phi * rest + y * (odds - rest))
    below = F.when(y > 0, beta_below(phi, F.greatest(y, F.lit(1.0)), -odds)).otherwise(0.0)
    return below, at


def unit_uniform(seed: int = 1) -> Column:
    """A number in [0, 1) for each unit (id, nurse), the same in every run."""
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce("id", F.lit("")), F.coalesce("nurse", F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def quantile_residuals(outcome: DataFrame, fit: Fit, kind: str = "subject_specific", seed: int = 1,
                       treated: str = "IPI enabled") -> DataFrame:
    """Where each observed outcome lies in its fitted distribution, on
    (0, 1): P(Y < y) plus a share of P(Y = y) drawn per unit.  Uniform if the
    model holds.

    This is the limit of comparing the outcome with draws from the model; it
    needs no draws.  ``kind="subject_specific"`` uses the cluster's random-effect
    estimate, ``"mean_subject"`` sets it to 0.  Output: ``id, nurse,
    randomization, outcome, residual``.
    """
    theta = {n: float(v) for n, v in zip(fit.names, fit.theta)}
    base = outcome.select("id", "nurse", "randomization", F.col("outcome").cast("double").alias("outcome"))
    base = base.filter(F.col("outcome").isNotNull())
    m1, m2 = F.lit(0.0), F.lit(0.0)
    if kind == "subject_specific" and fit.centres is not None:
        centres = fit.centres.select(F.col("cluster").alias("_cluster"), "m1", "m2")
        base = base.join(centres, F.col("nurse") == F.col("_cluster"), "left")
        m1, m2 = F.coalesce("m1", F.lit(0.0)), F.coalesce("m2", F.lit(0.0))
    x = F.when(F.col("randomization") == treated, 1.0).otherwise(0.0)
    y = F.col("outcome")
    eta = F.lit(theta["b0"]) + F.lit(theta["b1"]) * x + m1
    if fit.family == "binomial":
        one = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        below, at = F.when(y > 0, F.lit(1.0) - one).otherwise(0.0), F.when(y > 0, one).otherwise(F.lit(1.0) - one)
    elif fit.family == "hurdle_lognormal":
        below = normal_cdf((F.log(F.when(y > 0, y)) - eta) / F.lit(math.exp(theta["log_sigma"])))
        below, at = F.coalesce(below, F.lit(0.0)), F.lit(0.0)
    else:
        below, at = _negative_binomial_below(y, eta, theta["log_phi"])
    if "g0" in theta:  # a share of zeros beside the counts or areas
        zeta = F.lit(theta["g0"]) + F.lit(theta["g1"]) * x + m2
        zero = F.lit(1.0) / (F.lit(1.0) + F.exp(-zeta))
        below = F.when(y > 0, zero + (F.lit(1.0) - zero) * below).otherwise(0.0)
        at = F.when(y > 0, (F.lit(1.0) - zero) * at).otherwise(zero + (F.lit(1.0) - zero) * at)
    return base.select("id", "nurse", "randomization", "outcome",
                       F.least(F.lit(1.0), below + unit_uniform(seed) * at).alias("residual"))


def residual_qq(residuals: DataFrame, bins: int = 100) -> DataFrame:
    """Uniform QQ table of residuals: empirical CDF at ``bins`` equal steps
    against the uniform CDF, plus the largest gap (KS statistic)."""
    b = F.least(F.floor(F.col("residual") * bins), F.lit(bins - 1)).cast("int")
    counts = residuals.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = residuals.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left").fillna(0, ["n"])
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy()
    q = (full.withColumn("ecdf", F.sum("n").over(w) / F.sum("n").over(total))
         .withColumn("uniform", (F.col("bin") + 1) / F.lit(float(bins))))
    return q.withColumn("gap", F.abs(F.col("ecdf") - F.col("uniform"))).withColumn(
        "ks", F.max("gap").over(total)).select("bin", "n", "uniform", "ecdf", "ks")
