"""Dispersions of negative-binomial counts: gene-wise by profile likelihood, their trend over the mean, and shrinkage to it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelake.operators.stats import FIT, by_width, bh_adjust, gene_rows, moments, solve, wald
from slicelake.session import cut

#: Least and greatest dispersion; gene-wise values of at most 100 times the least tell nothing of the trend.
LEAST, MOST = 1e-8, 10.0
#: Residuals of genes that the trend is fitted to, as a ratio of their dispersion to it.
LOW_RATIO, HIGH_RATIO = 1e-4, 15.0
#: Least variance of the prior; residual standard deviations above the trend from which a gene keeps its own value.
LEAST_PRIOR, OUTLIER = 0.25, 2.0
#: Genes of one step of a search, to bound memory.
STEP = 4096


def lgamma(z: np.ndarray) -> np.ndarray:
    """log of the gamma function for z > 0: Stirling's series from z + 8 on."""
    t = z + 8.0
    series = (t - 0.5) * np.log(t) - t + 0.5 * math.log(2 * math.pi) + 1 / (12 * t) - 1 / (360 * t**3) + 1 / (1260 * t**5) - 1 / (1680 * t**7)
    return series - np.sum([np.log(z + k) for k in range(8)], axis=0)


def trigamma(z: float) -> float:
    total = 0.0
    while z < 10:
        total, z = total + 1 / z**2, z + 1
    return total + 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7)


def profile(log_alpha: np.ndarray, y: np.ndarray, x: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Cox-Reid adjusted log likelihood of each gene's dispersion, up to a constant; genes x samples, x of 0 and 1."""
    a = np.exp(log_alpha)[:, None]
    r = 1 / a
    like = (lgamma(y + r) - lgamma(r) - (y + r) * np.log1p(a * mu) + y * np.log(a)).sum(axis=1)
    w = mu / (1 + a * mu)
    one = (w * x).sum(axis=1)
    return like - 0.5 * np.log(np.maximum(one * (w.sum(axis=1) - one), 1e-300))


def best_dispersion(y: np.ndarray, x: np.ndarray, mu: np.ndarray, center: np.ndarray | None = None, var: float = 1.0) -> np.ndarray:
    """The dispersion of each gene with the greatest profile likelihood; with ``center``, times a log-normal prior around it.

    The best of 48 even steps of the logarithm, then golden section between its neighbours.
    """

    def value(la: np.ndarray) -> np.ndarray:
        return profile(la, y, x, mu) - (0 if center is None else (la - np.log(center)) ** 2 / (2 * var))

    grid = np.linspace(math.log(LEAST), math.log(MOST), 49)
    at = np.argmax(np.stack([value(np.full(len(y), g)) for g in grid]), axis=0)
    low, high = grid[np.maximum(at - 1, 0)], grid[np.minimum(at + 1, len(grid) - 1)]
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(32):
        c, d = high - golden * (high - low), low + golden * (high - low)
        left = value(c) > value(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return np.exp((low + high) / 2)


def _means(y: np.ndarray, x: np.ndarray, s: np.ndarray, alpha: np.ndarray, mean: np.ndarray) -> np.ndarray:
    b0, b1 = solve(y, x, s, alpha, mean)[:2]
    return np.maximum(s * np.exp(np.clip(b0[:, None] + b1[:, None] * x, -30, 30)), 1e-6)


def _own(y: np.ndarray, x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rows of (mean, gene-wise dispersion); NaN dispersion for genes that have no fit."""
    mean, start, fit = moments(y, x, s)
    out = np.column_stack([mean, np.full(len(y), np.nan)])
    for part in np.array_split(np.flatnonzero(fit), -(-int(fit.sum()) // STEP) or 1):
        if len(part):
            out[part, 1] = best_dispersion(y[part], x[part], _means(y[part], x[part], s[part], start[part], mean[part]))
    return out


def _final(trend: tuple[float, float], var: float, spread: float):
    def run(y: np.ndarray, x: np.ndarray, s: np.ndarray, own: np.ndarray) -> np.ndarray:
        mean, start, _ = moments(y, x, s)
        fit = ~np.isnan(own)
        line = np.where(fit, trend[0] / np.where(mean > 0, mean, 1.0) + trend[1], np.nan)
        alpha = np.where(fit, own, start)
        for part in np.array_split(np.flatnonzero(fit), -(-int(fit.sum()) // STEP) or 1):
            if len(part):
                mu = _means(y[part], x[part], s[part], start[part], mean[part])
                shrunk = best_dispersion(y[part], x[part], mu, line[part], var)
                apart = np.log(own[part]) > np.log(line[part]) + OUTLIER * spread
                alpha[part] = np.where(apart, own[part], shrunk)
        return np.column_stack([wald(y, x, s, alpha), own, line])

    return run


def _informative(alpha: Column) -> Column:
    return alpha.isNotNull() & (alpha > 100 * LEAST) & (F.col("base_mean") > 0)


def fit_trend(fits: DataFrame, most_rounds: int = 60) -> tuple[float, float] | None:
    """(a1, a0) of dispersion = a1 / mean + a0, by a gamma model with identity link over fits (base_mean, own).

    Each round is one aggregation of five sums over all genes, those far from the trend left out. Where that gives
    no positive curve, the trend is level at the mean dispersion; None without informative genes.
    """
    genes = fits.where(_informative(F.col("own")))
    level = genes.agg(F.avg("own")).first()[0]
    if level is None:
        return None
    a1, a0 = 0.1, 1.0
    u, v = 1 / F.col("base_mean"), F.col("own")
    for _ in range(most_rounds):
        line = F.lit(a1) * u + F.lit(a0)
        w = 1 / (line * line)
        near = genes.where((v / line).between(LOW_RATIO, HIGH_RATIO))
        n, su, suu, sv, suv = near.agg(*[F.coalesce(F.sum(e), F.lit(0.0)) for e in (w, w * u, w * u * u, w * v, w * u * v)]).first()
        det = n * suu - su * su
        if det <= 1e-12 * n * suu:
            return 0.0, level
        b1, b0 = (n * suv - su * sv) / det, (suu * sv - su * suv) / det
        if b1 <= 0 or b0 <= 0:
            return 0.0, level
        moved = math.log(b1 / a1) ** 2 + math.log(b0 / a0) ** 2
        a1, a0 = b1, b0
        if moved < 1e-10:
            break
    return a1, a0


def prior(fits: DataFrame, trend: tuple[float, float]) -> tuple[float, float]:
    """(variance of the prior, standard deviation of the residuals of log dispersions around the trend).

    The spread is the median absolute deviation, less what the gene-wise estimates themselves vary by.
    """
    residual = F.log("own") - F.log(F.lit(trend[0]) / F.col("base_mean") + F.lit(trend[1]))
    rows = fits.where(_informative(F.col("own"))).select(residual.alias("r"), F.size("y").alias("n"))
    middle, most = rows.agg(F.percentile_approx("r", 0.5, 10_000), F.max("n")).first()
    mad = rows.agg(F.percentile_approx(F.abs(F.col("r") - F.lit(middle)), 0.5, 10_000)).first()[0]
    spread = 1.4826 * mad
    return max(spread**2 - trigamma((most - 2) / 2), LEAST_PRIOR), spread


def nb_wald_shrunk(counts: DataFrame, factors: DataFrame, numerator: str, column: str = "species") -> DataFrame:
    """As stats.nb_wald, with dispersions shrunk to their trend, and the columns dispersion_own and dispersion_trend.

    Tier 2: gene-wise dispersions by Cox-Reid adjusted profile likelihood, trend a1 / mean + a0, then the greatest
    posterior under a log-normal prior around it; genes more than two residual deviations above the trend keep their
    own. No outlier flags or independent filtering. Genes without a fit have NULLs as in nb_wald; where no gene
    informs a trend, dispersions are those by moments. A gene is one row, a batch of genes is fitted at once; what all
    genes share (trend, prior) takes aggregations of one row. An empty table gives an empty one.
    """
    genes = gene_rows(counts, factors, numerator, column)
    arrays = "y array<double>, x array<double>, s array<double>"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, y, x, s in by_width(b):
                got = _own(y, x, s)
                yield pa.record_batch([*b.take(pa.array(some)).columns, *[pa.array(v, pa.float64(), from_pandas=True) for v in got.T]], names=[*b.schema.names, "base_mean", "own"])

    fits = cut(genes.mapInArrow(own, f"gene_id string, {arrays}, base_mean double, own double"))
    trend = fit_trend(fits)
    var, spread = prior(fits, trend) if trend else (1.0, 1.0)
    final, columns = _final(trend or (0.0, 1.0), var, spread), [*FIT, "dispersion_own", "dispersion_trend"]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("own").to_numpy(zero_copy_only=False).astype(float)
            for some, y, x, s in by_width(b):
                got = final(y, x, s, values[some] if trend else np.full(len(some), np.nan))
                yield pa.record_batch([b.column("gene_id").take(pa.array(some)), *[pa.array(v, pa.float64(), from_pandas=True) for v in got.T]], names=["gene_id", *columns])

    tested = cut(fits.mapInArrow(test, "gene_id string, " + ", ".join(f"{c} double" for c in columns)))
    return bh_adjust(tested, "pvalue", "gene_id")
