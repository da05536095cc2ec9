import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tocsin.functions.special import lgamma
from tocsin.operators.glmm import ClusteredModel
from tocsin.operators.stats import icc_binary_anova, icc_reml, residual_qq


def test_lgamma_column(spark):
    xs = [0.01, 0.3, 0.5, 1.0, 2.5, 10.0, 123.4, 1480.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(lgamma(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert abs(g - math.lgamma(x)) <= 1e-12 * max(1.0, abs(math.lgamma(x)))


def test_icc_reml_balanced_equals_anova():
    rng = np.random.default_rng(0)
    k, n = 8, 12
    b = rng.normal(0, 2, k)
    ys = [b[i] + rng.normal(0, 3, n) for i in range(k)]
    comp = pd.DataFrame({"n": [n] * k, "mean": [y.mean() for y in ys], "m2": [((y - y.mean()) ** 2).sum() for y in ys]})
    grand = np.concatenate(ys).mean()
    msb = n * sum((y.mean() - grand) ** 2 for y in ys) / (k - 1)
    msw = sum(((y - y.mean()) ** 2).sum() for y in ys) / (k * (n - 1))
    anova = (msb - msw) / (msb + (n - 1) * msw)
    assert abs(icc_reml(comp) - max(anova, 0)) < 1e-6


def test_icc_binary_no_clustering_near_zero():
    counts = pd.DataFrame({"n": [50] * 6, "y": [10] * 6})
    assert icc_binary_anova(counts) < 0


def test_logistic_model_recovers_group_logits(spark):
    # Two arms, equal clusters, no cluster effect: the fit approaches the
    # logits of the arm proportions.
    rows = []
    for k in range(6):
        x = k % 2
        for y, c in ((1, 10 + 10 * x), (0, 40 - 10 * x)):
            rows.append((f"N{k}", x, float(y), float(c)))
    cells = spark.createDataFrame(rows, "cluster string, x int, y double, c double")
    fit = ClusteredModel(spark, cells, "binomial").fit(outer=2)
    b0, b1 = fit.theta[0], fit.theta[1]
    assert abs(b0 - math.log(0.2 / 0.8)) < 0.05
    assert abs(b0 + b1 - math.log(0.4 / 0.6)) < 0.05


def test_residual_qq_uniform(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(u),) for u in rng.random(2000)], "residual double")
    q = residual_qq(df, bins=20).collect()
    assert len(q) == 20 and q[-1]["ecdf"] == 1.0 and q[0]["ks"] < 0.05


def test_results_table_formatting(spark):
    from tocsin.operators.stats import results_table
    eff = pd.DataFrame({"part": ["count", "zero"], "estimate": [1.71, 0.5], "lower": [0.9612, 0.2],
                        "upper": [3.0649, 1.25], "p_value": [0.068, 0.3]})
    rows = results_table(spark, [("Total alarm duration", eff, 0.004), ("Number of alarms", eff, 0.031)]).collect()
    assert rows[0]["NB_95_CI"] == "0.96 to 3.06" and rows[0]["CI_95"] == "0.2 to 1.25"
    assert rows[0]["ICC"] == "<0.01" and rows[1]["ICC"] == "0.03"
    assert rows[0]["IRR"] == 1.71 and rows[0]["OR"] == 0.5


def test_effects_exponentiates_count_and_zero_parts():
    from tocsin.operators.glmm import Fit
    from tocsin.operators.stats import effects
    names = ["b0", "b1", "g0", "g1", "log_sigma", "l11", "l21", "l22"]
    fit = Fit("hurdle_lognormal", names, np.array([1.0, 0.5, 0.0, math.log(2), 0, 0, 0, 0]), np.eye(8) * 0.01, 0.0, 1)
    e = effects(fit, "desat").set_index("part")
    assert abs(e.loc["count", "estimate"] - 0.5) < 1e-12          # log-normal part stays on its scale
    assert abs(e.loc["zero", "estimate"] - 2.0) < 1e-12           # odds ratio


def test_baseline_quartiles_exact_and_sketch(spark):
    from tocsin.operators.summary import continuous_summary
    rows = [("IPI enabled", float(v)) for v in range(1, 101)]
    df = spark.createDataFrame(rows, "randomization string, age double")
    exact = continuous_summary(df, ["age"]).collect()[0]
    assert (exact["n"], exact["p25"], exact["median"], exact["p75"]) == (100, 25.75, 50.5, 75.25)
    approx = continuous_summary(df, ["age"], exact=False).collect()[0]
    assert abs(approx["median"] - 50.5) <= 1


def test_logistic_matches_glm_without_cluster_effect(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    rng = np.random.default_rng(7)
    rows = [(f"N{k}", int(x), float(rng.random() < (0.2 if x == 0 else 0.35)))
            for k in range(8) for x in (k % 2,) for _ in range(60)]
    units = spark.createDataFrame(rows, "nurse string, x int, y double")
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="f", labelCol="y").fit(
        VectorAssembler(inputCols=["x"], outputCol="f").transform(units))
    cells = units.groupBy(F.col("nurse").alias("cluster"), "x", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    fit = ClusteredModel(spark, cells, "binomial").fit(outer=2)
    assert abs(fit.theta[0] - glm.intercept) < 0.05
    assert abs(fit.theta[1] - glm.coefficients[0]) < 0.05


def test_negative_binomial_recovers_simulated_parameters(spark):
    rng = np.random.default_rng(3)
    b0, b1, phi, sigma = 3.0, 0.5, 2.0, 0.3
    rows = []
    for k in range(20):
        x = k % 2
        u = rng.normal(0, sigma)
        mu = np.exp(b0 + b1 * x + u)
        ys = rng.poisson(rng.gamma(phi, mu / phi, size=80))
        rows += [(f"N{k:02d}", x, float(y)) for y in ys]
    units = spark.createDataFrame(rows, "cluster string, x int, y double")
    cells = units.groupBy("cluster", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    fit = ClusteredModel(spark, cells, "negative_binomial").fit(outer=2)
    se = np.sqrt(np.diag(fit.cov))
    assert abs(fit.theta[0] - b0) < 3 * se[0] + 0.05
    assert abs(fit.theta[1] - b1) < 3 * se[1] + 0.05
    assert abs(math.exp(fit.theta[2]) - phi) < 0.5


def _units(spark, n=40):
    rows = [(f"E{i}", "N1" if i % 2 else "N2", "IPI enabled" if i % 3 else "IPI disabled", float(i % 9)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, nurse string, randomization string, outcome double")


def _fit(spark, family, theta, **kw):
    from tocsin.operators.glmm import PARAMS, Fit
    centres = spark.createDataFrame([("N1", 0.4, 0.1), ("N2", -0.4, 0.0)], "cluster string, m1 double, m2 double")
    n = len(theta)
    return Fit(family, PARAMS[family], np.array(theta), np.eye(n) * 0.01, 0.0, 1, centres=centres, **kw)


def test_residuals_lie_in_the_fitted_distribution(spark):
    """Against probabilities added up in plain Python."""
    from tocsin.operators.stats import quantile_residuals
    b0, b1, log_phi, g0, g1 = 2.0, 0.3, 1.0, -0.5, 0.2
    phi = math.exp(log_phi)

    def nb(k, mu):
        return math.exp(math.lgamma(k + phi) - math.lgamma(phi) - math.lgamma(k + 1)
                        + phi * math.log(phi / (phi + mu)) + k * math.log(mu / (phi + mu)))

    for kind in ("subject_specific", "mean_subject"):
        for family, theta in (("negative_binomial", [b0, b1, log_phi, -1.0]),
                              ("zi_negative_binomial", [b0, b1, g0, g1, log_phi, -1.0, 0.0, -1.0])):
            fit = _fit(spark, family, theta)
            res = quantile_residuals(_units(spark), fit, kind=kind).collect()
            assert len(res) == 40
            for r in res:
                x = float(r["randomization"] == "IPI enabled")
                m1, m2 = {"N1": (0.4, 0.1), "N2": (-0.4, 0.0)}[r["nurse"]] if kind == "subject_specific" else (0, 0)
                mu, y = math.exp(b0 + b1 * x + m1), int(r["outcome"])
                zero = 1 / (1 + math.exp(-(g0 + g1 * x + m2))) if "zi" in family else 0.0
                below = sum((1 - zero) * nb(k, mu) for k in range(y)) + (zero if y else 0.0)
                at = (1 - zero) * nb(y, mu) + (0.0 if y else zero)
                assert below - 1e-9 <= r["residual"] <= below + at + 1e-9
            again = quantile_residuals(_units(spark), fit, kind=kind).collect()
            assert sorted(map(tuple, again)) == sorted(map(tuple, res))


def test_residuals_differ_between_the_units_of_a_patient(spark):
    from tocsin.operators.stats import quantile_residuals
    rows = [("E1", "N1", "IPI enabled", 3.0), ("E1", "N2", "IPI enabled", 3.0), ("E1", None, "IPI enabled", 3.0)]
    units = spark.createDataFrame(rows, "id string, nurse string, randomization string, outcome double")
    fit = _fit(spark, "negative_binomial", [2.0, 0.3, 1.0, -1.0])
    res = [r["residual"] for r in quantile_residuals(units, fit, kind="mean_subject").collect()]
    assert len(set(res)) == 3


def test_hurdle_residuals(spark):
    from statistics import NormalDist
    from tocsin.operators.stats import quantile_residuals
    fit = _fit(spark, "hurdle_lognormal", [1.0, 0.2, -0.5, 0.2, -0.3, -1.0, 0.0, -1.0])
    for r in quantile_residuals(_units(spark), fit, kind="mean_subject").collect():
        x = float(r["randomization"] == "IPI enabled")
        zero = 1 / (1 + math.exp(0.5 - 0.2 * x))
        if r["outcome"] == 0:
            assert 0 <= r["residual"] <= zero
        else:
            z = (math.log(r["outcome"]) - 1.0 - 0.2 * x) / math.exp(-0.3)
            assert abs(r["residual"] - (zero + (1 - zero) * NormalDist().cdf(z))) < 1e-6


def test_negative_variance_gives_no_interval(spark):
    from tocsin.operators.glmm import Fit
    fit = Fit("binomial", ["b0", "b1", "l11"], np.array([0.1, 0.5, -1.0]), np.diag([0.01, -0.02, 0.1]), 0.0, 1, False)
    row = fit.coef_table().iloc[1]
    assert math.isnan(row.lower) and math.isnan(row.upper) and math.isnan(row.p_value) and not row.converged


def test_zero_inflated_and_hurdle_recover_simulated_parameters(spark):
    rng = np.random.default_rng(11)
    b0, b1, g0, g1, s1, s2 = 2.0, 0.5, -0.7, 0.6, 0.3, 0.4
    for family, shape in (("zi_negative_binomial", math.log(2.0)), ("hurdle_lognormal", math.log(0.6))):
        rows = []
        for k in range(16):
            u, v, x = rng.normal(0, s1), rng.normal(0, s2), k % 2
            zero = rng.random(120) < 1 / (1 + np.exp(-(g0 + g1 * x + v)))
            mu = b0 + b1 * x + u
            if family == "hurdle_lognormal":
                y = np.round(np.exp(mu + math.exp(shape) * rng.standard_normal(120)), 2) + 0.01
            else:
                y = rng.poisson(rng.gamma(math.exp(shape), np.exp(mu) / math.exp(shape), size=120))
            rows += [(f"N{k:02d}", x, float(a)) for a in np.where(zero, 0.0, y)]
        units = spark.createDataFrame(rows, "cluster string, x int, y double")
        cells = units.groupBy("cluster", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
        fit = ClusteredModel(spark, cells, family, n_nodes=5).fit(outer=2)
        assert fit.converged
        se = np.sqrt(np.diag(fit.cov))
        for name, true in (("b0", b0), ("b1", b1), ("g0", g0), ("g1", g1)):
            i = fit.names.index(name)
            assert abs(fit.theta[i] - true) < 3.5 * se[i] + 0.05, (family, name, fit.theta[i], true, se[i])


def test_shape_is_capped_on_request_only(spark):
    rng = np.random.default_rng(5)
    rows = [(f"N{k}", k % 2, float(y)) for k in range(6) for y in rng.poisson(4.0, size=60)]
    cells = spark.createDataFrame(rows, "cluster string, x int, y double").groupBy("cluster", "x", "y").agg(
        F.count(F.lit(1)).cast("double").alias("c"))
    model = ClusteredModel(spark, cells, "negative_binomial")
    at = {"b0": 1.4, "b1": 0.0, "l11": -2.0}
    # towards the Poisson limit the likelihood settles and keeps its digits
    values = [model.loglik(log_phi=v, **at) for v in (9.9, 10.1, 20.0, 40.0)]
    assert abs(values[0] - values[1]) < 0.01 and abs(values[2] - values[3]) < 1e-4
    assert all(math.isfinite(v) for v in values)
    capped = ClusteredModel(spark, cells, "negative_binomial", max_log_phi=2.0)
    assert capped.loglik(log_phi=9.0, **at) == capped.loglik(log_phi=2.0, **at) != model.loglik(log_phi=9.0, **at)


def test_reml_table_like_the_single_search(spark):
    """All outcomes in one table against the search in plain numpy."""
    from tocsin.operators.stats import icc_reml_table
    rng, rows = np.random.default_rng(4), []
    for name, between, k in (("a", 2.0, 9), ("b", 0.0, 12), ("c", 40.0, 5), ("one", 1.0, 1), ("singles", 1.0, 4)):
        for c in range(k):
            y = 1e6 + rng.normal(0, between) + rng.normal(0, 3, 1 if name == "singles" else rng.integers(1, 30))
            rows.append((name, f"N{c}", len(y), float(y.mean()), float(((y - y.mean()) ** 2).sum())))
    got = {r["outcome"]: r["icc"] for r in icc_reml_table(
        spark.createDataFrame(rows, "outcome string, cluster string, n long, mean double, m2 double")).collect()}
    for name in ("a", "b", "c"):
        comp = pd.DataFrame([r[2:] for r in rows if r[0] == name], columns=["n", "mean", "m2"])
        assert abs(got[name] - icc_reml(comp)) < 1e-5, name
    assert got["one"] is None and got["singles"] is None


def test_binary_estimates(spark):
    from tocsin.operators.stats import icc_binary_estimates
    sets = {"some": [(10, 1), (20, 9), (15, 2), (8, 5)], "none": [(5, 0), (6, 0)], "all": [(5, 5), (6, 6)], "one": [(9, 4)]}
    rows = [(name, n, y) for name, counts in sets.items() for n, y in counts]
    got = {r["name"]: r for r in icc_binary_estimates(spark.createDataFrame(rows, "name string, n long, y long"), "name").collect()}
    n, y = (np.array(v, float) for v in zip(*sets["some"]))
    k, N, p = len(n), n.sum(), y.sum() / n.sum()
    n0 = (N - (n * n).sum() / N) / (k - 1)
    sw = (n / N * (y / n - p) ** 2).sum()
    assert abs(got["some"]["stabilised"] - (N * sw / ((k - 1) * p * (1 - p)) + 0.45 - 1) / (n0 - 1)) < 1e-12
    assert abs(got["some"]["anova"] - icc_binary_anova(pd.DataFrame({"n": n, "y": y}))) < 1e-12
    assert all(got[x]["stabilised"] is None and got[x]["anova"] is None for x in ("none", "all", "one"))
    even = icc_binary_estimates(spark.createDataFrame([(50, 10)] * 6, "n long, y long")).first()
    assert even["stabilised"] is None and even["anova"] < 0  # below 0


def test_incomplete_beta(spark):
    """P(Y < y) of a negative binomial, added up; the cost must not depend on y."""
    from tocsin.functions.special import beta_below
    rows = [(phi, float(y), mu) for phi in (0.01, 0.5, 3.0, 500.0, 1e5) for mu in (0.001, 3.0, 3000.0, 2e5)
            for y in (1, 2, 50, 2900, 3100, 201000, 900000)]
    df = spark.createDataFrame(rows, "a double, b double, mu double")
    for r in df.withColumn("p", beta_below(F.col("a"), F.col("b"), F.log(F.col("a") / F.col("mu")))).collect():
        k = np.arange(int(r.b))
        log_mass = (np.concatenate([[0.0], np.cumsum(np.log((k[:-1] + r.a) / (k[:-1] + 1)))]) - r.a * math.log1p(r.mu / r.a)
                    + k * (math.log(r.mu / r.a) - math.log1p(r.mu / r.a)))
        assert abs(r.p - math.fsum(np.exp(log_mass))) < 1e-8, r


def test_scores_are_the_slopes_of_the_likelihood(spark):
    rng = np.random.default_rng(8)
    rows = [(f"N{k}", k % 2, float(y)) for k in range(6) for y in list(rng.poisson(rng.gamma(2, 5, size=15))) + [0, 0]]
    cells = spark.createDataFrame(rows, "cluster string, x int, y double").groupBy("cluster", "x", "y").agg(
        F.count(F.lit(1)).cast("double").alias("c"))
    for family in ("negative_binomial", "zi_negative_binomial", "hurdle_lognormal", "binomial"):
        own = cells.where("y <= 1") if family == "binomial" else cells
        model = ClusteredModel(spark, own, family, n_nodes=5)
        theta = np.linspace(-0.6, 0.4, len(model.names))
        model.centre([theta])
        h = 1e-4 * np.eye(len(theta))
        values, scores = model._evaluate({0: [theta, *(theta + h), *(theta - h)]})[0]
        slopes = (values[1:len(theta) + 1] - values[len(theta) + 1:]) / 2e-4
        assert np.max(np.abs(scores[0] - slopes)) < 1e-4 * (1 + np.max(np.abs(slopes))), family


def test_models_fitted_together_and_a_spread_of_nothing(spark):
    """Two outcomes in one set of jobs, as each alone; equal clusters end at the bound."""
    from tocsin.operators.glmm import ClusteredModels
    rng, rows = np.random.default_rng(9), []
    for m, spread in ((0, 0.6), (1, 0.0)):
        for k in range(10):
            u = rng.normal(0, spread)
            rows += [(m, f"N{k}", k % 2, float(y)) for y in rng.poisson(rng.gamma(3.0, np.exp(2.0 + 0.4 * (k % 2) + u) / 3.0, size=60))]
    cells = spark.createDataFrame(rows, "_m int, cluster string, x int, y double").groupBy("_m", "cluster", "x", "y").agg(
        F.count(F.lit(1)).cast("double").alias("c"))
    both = ClusteredModels(spark, cells, "negative_binomial", 2).fits()
    alone = ClusteredModel(spark, cells.where("_m = 0").drop("_m"), "negative_binomial").fit()
    assert both[0].converged and np.max(np.abs(both[0].theta - alone.theta)) < 1e-3 and abs(both[0].loglik - alone.loglik) < 1e-3
    assert both[1].converged
    if both[1].held:
        row = both[1].coef_table().set_index("term").loc["l11"]
        assert both[1].held == ("l11",) and math.isnan(row.std_error)


def test_normal_distribution(spark):
    from statistics import NormalDist
    from tocsin.operators.stats import normal_cdf
    df = spark.createDataFrame([(float(z),) for z in (-40, -6, -1.5, 0, 0.3, 2, 8, 30)], "z double")
    for r in df.withColumn("p", normal_cdf(F.col("z"))).collect():
        assert abs(r.p - NormalDist().cdf(r.z)) < 1e-9


def test_order_statistics_are_exact(spark):
    """Ties over many ranges, one value, two, and a group with most rows."""
    from tocsin.operators.summary import order_statistics
    rng = np.random.default_rng(2)
    groups = {"hot": rng.integers(0, 50, 5000) / 4, "wide": rng.normal(0, 1, 301), "one": [7.0], "two": [1.0, 2.0], "same": [3.0] * 90}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, value double")
    for r in order_statistics(df, ["g"], (0.0, 0.25, 0.5, 0.75, 1.0)).collect():
        assert r.n == len(groups[r.g])
        assert np.allclose(r.q, np.quantile(groups[r.g], (0, 0.25, 0.5, 0.75, 1)), rtol=0, atol=1e-12), r
    assert order_statistics(df.where("g = 'none'"), ["g"]).collect() == []


def test_baseline_needs_no_map_of_values(spark):
    from conftest import SF_SMALL
    import __spark_entry__ as entry
    plan = entry.queries()["baseline_continuous"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_crude_effects_without_a_mean(spark):
    from tocsin.operators.stats import crude_effects, formatted_results
    rows = [("a", "IPI enabled", 2.0), ("a", "IPI disabled", 1.0), ("a", "IPI disabled", 3.0), ("b", "IPI enabled", 0.0),
            ("b", "IPI disabled", 0.0), ("c", "IPI enabled", 4.0), ("c", None, 9.0), ("c", "IPI enabled", None)]
    df = spark.createDataFrame(rows, "name string, randomization string, outcome double")
    got = {r["Outcome"]: r for r in formatted_results(crude_effects(df, "name")).collect()}
    assert got["a"]["IRR"] == 1.0 and got["b"]["IRR"] is None and got["c"]["IRR"] is None
    assert formatted_results(crude_effects(df.where("name = 'z'"), "name")).collect() == []


def test_sums_of_a_cluster_give_the_likelihood_of_its_units(spark):
    """One row a cluster, however many different outcomes; values as added up unit by unit."""
    from tocsin.operators.glmm import QUADRATURE_NODES
    rng = np.random.default_rng(12)
    at = {"b0": 9.0, "b1": -0.4, "g0": -1.0, "g1": 0.5, "log_phi": -0.3, "log_sigma": 0.2, "l11": -0.5, "l21": 0.2, "l22": -0.4}
    rows = [(f"N{k % 5}", int(rng.integers(0, 2)), float(y)) for k, y in enumerate(np.round(np.exp(rng.normal(9, 2, 300)), 1))]
    rows += [("N0", 0, 0.0), ("N0", 0, 0.0), ("N1", 1, 0.0), ("N5", 1, 0.0)]  # a cluster of zeros alone
    x1, w1 = np.polynomial.hermite.hermgauss(QUADRATURE_NODES)

    def density(family, x, y, z1, z2):
        eta, zeta = at["b0"] + at["b1"] * x + z1, at["g0"] + at["g1"] * x + z2
        pi, phi = 1 / (1 + math.exp(-zeta)), math.exp(at["log_phi"])
        if family == "binomial":
            return y * eta - math.log1p(math.exp(eta))
        if family == "hurdle_lognormal":
            off = (math.log(y) - eta) / math.exp(at["log_sigma"]) if y else 0.0
            return math.log(1 - pi) - math.log(y) - at["log_sigma"] - 0.5 * math.log(2 * math.pi) - off * off / 2 if y else math.log(pi)
        total = math.log(phi + math.exp(eta))
        count = (math.lgamma(y + phi) - math.lgamma(phi) - math.lgamma(y + 1) + phi * (at["log_phi"] - total) + y * (eta - total))
        if family == "negative_binomial":
            return count
        return math.log(1 - pi) + count if y else math.log(pi + (1 - pi) * math.exp(count))

    for family in ("negative_binomial", "zi_negative_binomial", "hurdle_lognormal", "binomial"):
        own = [(c, x, float(y > 9000)) for c, x, y in rows] if family == "binomial" else rows
        cells = spark.createDataFrame(own, "cluster string, x int, y double").groupBy("cluster", "x", "y").agg(
            F.count(F.lit(1)).cast("double").alias("c"))
        model = ClusteredModel(spark, cells, family)
        assert model.centres.count() == 6
        want = 0.0
        for name in sorted({c for c, _, _ in own}):
            units, total = [(x, y) for c, x, y in own if c == name], []
            for a, u in zip(x1, w1):
                for b, v in zip(x1, w1) if model.dim == 2 else [(0.0, math.exp(-0.0) / math.sqrt(2))]:
                    z1, z2 = math.sqrt(2) * a, math.sqrt(2) * b
                    u1 = z1 / math.exp(at["l11"])
                    lw = math.log(u * v * 2) + a * a + b * b - u1 * u1 / 2 - at["l11"] - 0.5 * math.log(2 * math.pi)
                    if model.dim == 2:
                        u2 = (z2 - at["l21"] * u1) / math.exp(at["l22"])
                        lw += -u2 * u2 / 2 - at["l22"] - 0.5 * math.log(2 * math.pi)
                    total.append(lw + sum(density(family, x, y, z1, z2) for x, y in units))
            want += max(total) + math.log(sum(math.exp(t - max(total)) for t in total))
        got = model.loglik(**{n: at[n] for n in model.names})
        assert abs(got - want) < 1e-7 * abs(want), (family, got, want)


def test_clusters_without_zeros_beside_clusters_with_many(spark):
    """The likelihood is a bent, narrow valley there; the search must reach its end in few jobs."""
    rng, rows = np.random.default_rng(13), []
    zeros = {0: (0, 0, 0, 2, 123, 86), 1: (0, 122, 0, 124, 87)}
    for x, own in zeros.items():
        for k, none in enumerate(own):
            mu = math.exp(13.44 + rng.normal(0, 0.03))
            rows += [(f"N{x}{k}", x, float(y)) for y in 3600 * rng.poisson(rng.gamma(8.4, mu / 3600 / 8.4, size=500))] + [(f"N{x}{k}", x, 0.0)] * none
    cells = spark.createDataFrame(rows, "cluster string, x int, y double").groupBy("cluster", "x", "y").agg(
        F.count(F.lit(1)).cast("double").alias("c"))
    model = ClusteredModel(spark, cells, "zi_negative_binomial")
    fit = model.fit()
    assert fit.converged and model.jobs <= 90, (fit, model.jobs)
