import math

import numpy as np
import pytest

from slicelake.operators import dispersion as D


def long(spark, m):
    rows = [(f"g{i}", f"s{j}", "MM" if j % 2 else "AC", float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    factors = spark.createDataFrame([(f"s{j}", 1.0 + j / 10) for j in range(m.shape[1])], "sample string, size_factor double")
    return spark.createDataFrame(rows, "gene_id string, sample string, species string, count double"), factors


def test_gamma_functions():
    z = np.array([1e-8, 0.3, 1.0, 2.0, 7.7, 123.4, 1e6, 1e8])
    assert np.allclose(D.lgamma(z), [math.lgamma(v) for v in z], rtol=1e-12, atol=1e-10)
    for v in (0.5, 1.0, 4.0, 50.0):
        step = 1e-3 * v
        slope = (math.lgamma(v + step) - 2 * math.lgamma(v) + math.lgamma(v - step)) / step**2
        assert math.isclose(D.trigamma(v), slope, rel_tol=1e-4)


def slow_profile(alpha, y, x, mu):
    like = sum(math.lgamma(k + 1 / alpha) - math.lgamma(1 / alpha) + (1 / alpha) * math.log(1 / (1 + alpha * m)) + k * math.log(alpha * m / (1 + alpha * m)) - k * math.log(m) for k, m in zip(y, mu))
    w = np.diag(mu / (1 + alpha * mu))
    design = np.c_[np.ones(len(y)), x]
    return like - 0.5 * math.log(np.linalg.det(design.T @ w @ design))


@pytest.mark.parametrize("center", [None, 0.02])
def test_the_best_dispersion_is_that_of_a_fine_search(center):
    rng = np.random.default_rng(3)
    x = np.array([0.0, 1.0] * 5)
    y = rng.negative_binomial(4, 4 / (4 + 60), (12, 10)).astype(float)
    mu = np.where(x == 1, y[:, x == 1].mean(axis=1)[:, None], y[:, x == 0].mean(axis=1)[:, None])
    got = D.best_dispersion(y, np.tile(x, (12, 1)), mu, None if center is None else np.full(12, center), 0.3)
    for g in range(12):

        def value(la, g=g):
            return slow_profile(math.exp(la), y[g], x, mu[g]) - (0 if center is None else (la - math.log(center)) ** 2 / 0.6)

        fine = max(np.linspace(math.log(1e-4), math.log(9), 4000), key=value)
        assert abs(math.log(got[g]) - fine) < 0.01


def test_trend_and_prior_are_found_and_estimates_come_nearer(spark):
    rng = np.random.default_rng(8)
    mean = np.exp(rng.uniform(math.log(20), math.log(3000), 500))
    true = (3.0 / mean + 0.08) * np.exp(rng.normal(0, 0.2, 500))
    m = rng.negative_binomial(1 / true[:, None], 1 / (1 + true * mean)[:, None] * np.ones((1, 8))).astype(float)
    m[0] = 0
    counts, factors = long(spark, m)
    flat = factors.selectExpr("sample", "1.0D AS size_factor")
    got = {r["gene_id"]: r for r in D.nb_wald_shrunk(counts, flat, "MM").collect()}
    assert len(got) == 500 and got["g0"]["dispersion_own"] is None and got["g0"]["pvalue"] is None
    line = np.array([got[f"g{i}"]["dispersion_trend"] for i in range(1, 500)])
    assert np.median(np.abs(np.log(line / (3.0 / mean[1:] + 0.08)))) < 0.25
    own, final = (np.log(np.array([got[f"g{i}"][c] for i in range(1, 500)]) / true[1:]) for c in ("dispersion_own", "dispersion"))
    assert np.sqrt(np.mean(final**2)) < 0.6 * np.sqrt(np.mean(own**2))
    assert sum(r["pvalue"] is not None and r["pvalue"] < 0.05 for r in got.values()) < 60  # no gene differs


def test_a_level_trend_and_odd_tables(spark):
    rows = spark.createDataFrame([(10.0 * k, 0.1 + 0.05 * k) for k in range(1, 9)], "base_mean double, own double")
    a1, a0 = D.fit_trend(rows)  # grows with the mean, which no such curve does
    assert a1 == 0.0 and math.isclose(a0, 0.325)
    assert D.fit_trend(rows.where("own < 0")) is None
    counts, factors = long(spark, np.array([[5.0, 7, 9, 8, 6, 7], [0, 0, 0, 0, 0, 0], [3, 3, 3, 3, 3, 3]]))
    some = counts.where("NOT (gene_id = 'g0' AND sample IN ('s0', 's1'))").unionByName(counts.limit(1).selectExpr("'n' AS gene_id", "sample", "species", "cast(NULL AS DOUBLE) AS count"))
    got = {r["gene_id"]: r for r in D.nb_wald_shrunk(some, factors, "MM").collect()}
    assert set(got) == {"g0", "g1", "g2"} and got["g1"]["log2fc"] is None and got["g2"]["dispersion"] >= D.LEAST
    assert D.nb_wald_shrunk(counts.limit(0), factors, "MM").count() == 0


def test_the_trend_is_that_of_a_plain_fit(spark):
    rng = np.random.default_rng(2)
    mean = rng.uniform(5, 500, 80)
    own = (4 / mean + 0.1) * rng.gamma(5, 0.2, 80)
    a1, a0 = D.fit_trend(spark.createDataFrame(list(zip(mean.tolist(), own.tolist())), "base_mean double, own double"))
    # at the best gamma fit the weighted residuals are orthogonal to both terms
    line = a1 / mean + a0
    assert abs(((own - line) / line**2 / mean).sum()) < 1e-3 * (own / line**2 / mean).sum() and abs(((own - line) / line**2).sum()) < 1e-3 * (own / line**2).sum()
