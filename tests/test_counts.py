import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicelake.operators import counts as C
from slicelake.operators import normalize as N
from slicelake.operators import series as S
from slicelake.operators import stats as T
from slicelake.operators import views as V

SCHEMA = "gene_id string, sample string, species string, condition string, replicate int, slice int, count double"


def long(spark, m, genes=None, samples=None):
    rows = [(f"g{i}", f"s{j}", "MM" if j % 2 else "AC", "SHAM", 1, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, SCHEMA)


def test_latest_delivery(spark):
    df = spark.createDataFrame([("gene:g", "s", 1.0, 1), ("g", "s", 5.0, 2), ("g", "s", None, 2), (None, "s", 1.0, 3), ("h", "s", None, None)], "gene_id string, sample string, count double, loaded_at int")
    assert sorted((r["gene_id"], r["count"]) for r in C.latest(df).collect()) == [("g", 5.0), ("h", None)]


def test_size_factors_scale_with_a_sample(spark):
    m = np.random.default_rng(1).integers(1, 100, (30, 4)).astype(float)
    m[3, 2] = 0
    lg = np.log(m[[i for i in range(30) if i != 3]])
    want = np.exp(np.median(lg - lg.mean(axis=1, keepdims=True), axis=0))
    got = {r["sample"]: r["size_factor"] for r in N.size_factors(long(spark, m)).collect()}
    assert np.allclose([got[f"s{j}"] for j in range(4)], want)
    m2 = m.copy()
    m2[:, 1] *= 5
    two = {r["sample"]: r["size_factor"] for r in N.size_factors(long(spark, m2)).collect()}
    assert math.isclose(two["s1"] / two["s0"], 5 * got["s1"] / got["s0"])
    assert N.size_factors(long(spark, [[0, 1], [1, 0]])).count() == 0
    cpm = [{(r["gene_id"], r["sample"]): r["log_cpm"] for r in N.log_cpm(long(spark, x)).collect()} for x in (m, m2)]
    assert all(math.isclose(cpm[0][k], cpm[1][k]) for k in cpm[0])


def test_filters_and_combination(spark):
    df = long(spark, [[5, 5, 0], [5, 0, 0], [2, 2, 2]])
    assert {r["gene_id"] for r in C.expressed_genes(df, 2, 2).collect()} == {"g0", "g2"}
    some = df.where("NOT (gene_id = 'g1' AND sample = 's2')")
    assert {r["gene_id"] for r in C.combine(some, F.col("sample")).select("gene_id").distinct().collect()} == {"g0", "g2"}
    w = C.wide(some, ["s0", "s1", "s2"])
    assert w.where("gene_id = 'g1'").first()["s2"] is None and C.long(w).count() == 9
    assert C.densify(some).where("gene_id = 'g1' AND sample = 's2'").first()["count"] == 0
    assert C.numeric_order(["b10", "b2", "x"]) == ["b2", "b10", "x"]
    with pytest.raises(Exception, match="no such species"):
        C.map_orthologs(df.withColumn("species", F.lit("XX")), spark.createDataFrame([("g0", "g0", "S")], "mus_id string, acomys_id string, symbol string")).collect()


def test_ortholog_rekeying(spark):
    df = spark.createDataFrame([("m1", "AC"), ("a1", "AC"), ("m1", "MM"), ("m2", "MM")], "gene_id string, species string")
    o = spark.createDataFrame([("m1", "a1", "S1"), ("m2", None, "S2")], "mus_id string, acomys_id string, symbol string")
    assert sorted((r["gene_id"], r["species"], r["symbol"]) for r in C.map_orthologs(df, o).collect()) == [("m1", "AC", "S1"), ("m1", "MM", "S1"), ("m2", "MM", "S2")]


def test_bh_matches_brute_force(spark):
    r = random.Random(2)
    p = [round(r.random() ** 3, 2) for _ in range(300)] + [None, 0.0, 1.0, 1.0]
    got = {x["k"]: x["padj"] for x in T.bh_adjust(spark.createDataFrame(list(enumerate(p)), "k int, p double"), "p", "k", range_rows=5).collect()}
    v = sorted(x for x in p if x is not None)
    for k, x in enumerate(p):
        want = None if x is None else min(1.0, min(y * len(v) / max(i + 1 for i, z in enumerate(v) if z == y) for y in v if y >= x))
        assert got[k] is None if want is None else math.isclose(got[k], want)
    assert T.bh_adjust(spark.createDataFrame([], "k int, p double"), "p", "k").count() == 0


def test_distances_tree_and_pca(spark):
    m = np.random.default_rng(3).normal(size=(40, 6))
    df = long(spark, m).where("NOT (gene_id = 'g0' AND sample = 's0')")
    m[0, 0] = 0
    d = {(r["sample_a"], r["sample_b"]): r["distance"] for r in T.sample_distances(df, "count").collect()}
    assert len(d) == 15 and all(math.isclose(v, np.linalg.norm(m[:, int(a[1])] - m[:, int(b[1])]), rel_tol=1e-9) for (a, b), v in d.items())
    tree = T.complete_linkage(T.sample_distances(df, "count")).orderBy("step").collect()
    assert len(tree) == 5 and math.isclose(tree[0]["height"], min(d.values())) and math.isclose(tree[-1]["height"], max(d.values())) and tree[-1]["size"] == 6
    assert T.complete_linkage(spark.createDataFrame([], "sample_a string, sample_b string, distance double")).count() == 0
    scores = {(r["pc"], r["sample"]): r["score"] for r in T.pca(df, "count", 2).collect()}
    c = m - m.mean(axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(sorted(abs(scores[1, f"s{j}"]) for j in range(6)), sorted(abs(vt[0] * s[0])))


def slow_tree(names, d):
    """Nearest pair of all, one after another; clusters go by their smallest name."""
    label, size, out = {s: -(k + 1) for k, s in enumerate(sorted(names))}, dict.fromkeys(names, 1), []
    d = {frozenset(k): v for k, v in d.items()}
    while d:
        near = min(d, key=lambda k: (d[k], *sorted(k)))
        lo, hi = sorted(near)
        out.append((label[lo], label[hi], round(d.pop(near), 9), size[lo] + size[hi]))
        for k in [k for k in d if hi in k]:
            (x,) = k - {hi}
            d[frozenset((lo, x))] = max(d.pop(k), d[frozenset((lo, x))])
        label[lo], size[lo] = len(out), size[lo] + size[hi]
    return out


def test_tree_in_rounds_is_the_tree_of_nearest_pairs(spark):
    m = np.random.default_rng(8).normal(size=(5, 23))
    names = [f"s{k:02d}" for k in range(23)]
    d = {(a, b): float(np.linalg.norm(m[:, i] - m[:, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    got = T.complete_linkage(spark.createDataFrame([(*k, v) for k, v in d.items()], "sample_a string, sample_b string, distance double")).orderBy("step").collect()
    assert [(r["left"], r["right"], round(r["height"], 9), r["size"]) for r in got] == slow_tree(names, d)


def test_gram_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3)
    m = np.random.default_rng(9).normal(size=(60, 8))
    samples, dots = T.gram(long(spark, m).repartition(9), "count")
    got = {(r["a"], r["b"]): r["dot"] for r in dots.collect()}
    assert len(got) == 36 and all(math.isclose(v, float(m[:, a] @ m[:, b]), abs_tol=1e-9) for (a, b), v in got.items())


def slow_wald(y, x, s, alpha):
    """One gene by textbook steps, dispersion given."""
    design, beta, ridge = np.c_[np.ones(len(y)), x], np.array([math.log((y / s).mean()), 0.0]), np.diag([1e-6, 1e-6])
    for _ in range(50):
        mu = np.maximum(s * np.exp(design @ beta), 1e-6)
        w = mu / (1 + alpha * mu)
        beta = np.linalg.solve((design.T * w) @ design + ridge, (design.T * w) @ (np.log(mu / s) + (y - mu) / mu))
    mu = s * np.exp(design @ beta)
    info = (design.T * (mu / (1 + alpha * mu))) @ design
    return beta[1] / math.log(2), math.sqrt(np.linalg.inv(info)[1, 1]) / math.log(2)


def test_batches_are_fitted_as_single_genes(spark):
    rng = np.random.default_rng(14)
    m = rng.negative_binomial(5, 5 / (5 + 80), (30, 10)).astype(float)
    size = {f"s{j}": 0.5 + j / 10 for j in range(10)}
    df = long(spark, m).where("NOT (gene_id IN ('g1', 'g2') AND sample = 's3')")
    got = {r["gene_id"]: r for r in T.nb_wald(df, spark.createDataFrame(list(size.items()), "sample string, size_factor double"), "MM").collect()}
    species = {r[0]: r[1] for r in df.select("sample", "species").distinct().collect()}
    for g in range(30):
        have = [j for j in range(10) if not (g in (1, 2) and j == 3)]
        y, x, s = m[g, have], np.array([float(species[f"s{j}"] == "MM") for j in have]), np.array([size[f"s{j}"] for j in have])
        r = got[f"g{g}"]
        want = slow_wald(y, x, s, r["dispersion"])
        assert math.isclose(r["log2fc"], want[0], rel_tol=1e-5, abs_tol=1e-6) and math.isclose(r["lfc_se"], want[1], rel_tol=1e-4)


def test_sample_order_is_checked(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "o int, sample string")
    C.check_samples(["a", "b"], rows, "o")
    for wrong in (["b", "a"], ["a"], ["a", "b", "c"], []):
        with pytest.raises(ValueError, match="differ from place"):
            C.check_samples(wrong, rows, "o")


def test_wald_finds_the_planted_change(spark):
    rng = np.random.default_rng(4)
    m = rng.negative_binomial(10, 10 / (10 + 50), (40, 12)).astype(float)
    m[0, 1::2] = rng.negative_binomial(10, 10 / (10 + 400), 6)
    m[1] = 0
    factors = spark.createDataFrame([(f"s{j}", 1.0) for j in range(12)], "sample string, size_factor double")
    got = {r["gene_id"]: r for r in T.nb_wald(long(spark, m), factors, "MM").collect()}
    assert 2 < got["g0"]["log2fc"] < 4 and got["g0"]["padj"] < 1e-4 and got["g1"]["pvalue"] is None
    a, b = m[2, 1::2].mean(), m[2, ::2].mean()
    assert math.isclose(got["g2"]["log2fc"], math.log2(a / b), rel_tol=1e-3, abs_tol=1e-4)
    assert sum(r["padj"] is not None and r["padj"] < 0.05 for g, r in got.items() if g not in ("g0", "g1")) <= 3


def test_series(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "a", None), (4, "b", None), (5, "a", "y")], "i int, k string, v string")
    assert [r["v"] for r in S.fill_down(df, "v", "i", ["k"]).orderBy("i").collect()] == [None, "x", "x", None, "y"]
    fa = spark.createDataFrame([("g", 3, 2, "late"), ("g", 3, 1, "first"), ("g", 1, 0, "short"), (None, 1, 5, "free"), (None, 9, 6, "free2"), ("h", None, 7, "nolen")], "gene string, n int, o int, t string")
    assert sorted((str(r["gene"]), r["t"]) for r in S.longest_per_group(fa, "gene", F.col("n"), "o", ["t"]).collect()) == [("None", "free"), ("None", "free2"), ("g", "first"), ("h", "nolen")]
    reps = spark.createDataFrame([("A", "C", 1), ("A", "C", 3), ("A", "C", 3), ("A", "D", 5), ("A", "C", None)], "species string, condition string, replicate int")
    assert sorted(r["replicate"] for r in S.renumber_replicates(reps).collect()) == [1, 1, 2, 2, 2]
    tops = S.top_values(spark.createDataFrame([("t", x) for x in "aabbc"], "tag string, v string"), "tag", "v", 2)
    assert [(r["v"], r["rank"]) for r in tops.orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_volcano_nulls_and_caps(spark):
    df = spark.createDataFrame([(None, 1.0), (0.0, 1.0), (0.01, -0.5), (0.01, 0.4), (0.9, 3.0), (1e-90, None)], "padj double, log2fc double")
    got = [(r["nlp"], r["significance"]) for r in V.volcano_points(df).collect()]
    assert got == [(None, None), (50.0, "sig_up"), (2.0, "sig_down"), (2.0, "not_sig"), (0.05, "not_sig"), (50.0, None)]
    sets = spark.createDataFrame([("Col1a1",), ("xmetalloY",), ("Lem",), ("Z",), (None,)], "s string").select(V.gene_set(F.col("s"), ["Lem"]))
    assert [r[0] for r in sets.collect()] == ["collagen", "metallo", "structural", "other", None]
