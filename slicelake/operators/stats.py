"""Tests and multivariate views: Benjamini-Hochberg, negative-binomial Wald tests, distances, clustering, PCA."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicelake.session import cut

#: Most samples for the operators that hold a samples x samples table.
MAX_SAMPLES = 5000


#: About how many distinct p values fall into one range of ``bh_adjust``, and the most ranges.
RANGE_ROWS, MOST_RANGES = 200_000, 10_000


def bh_adjust(df: DataFrame, p: str = "p", key: str = "gene_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds padj by Benjamini-Hochberg. NULL p stays NULL and doesn't count.

    Equal p get equal padj, so ties need no order and are one row here, however many tests share them. No window
    spans all rows: distinct p fall into ranges of about ``range_rows``, whose counts and minima are combined (a row a
    range), and running ranks and minima are computed within each. The distinct p are kept in the checkpoint folder.
    """
    points = cut(df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n")))
    size, total = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(1, -(-size // range_rows)))
    bounds = points.agg(F.percentile_approx("_p", [i / ranges for i in range(1, ranges)] or [0.5], 10 * MOST_RANGES)).first()[0] if ranges > 1 else None
    within = F.array(*[F.lit(b) for b in sorted(set(bounds or []))]).cast("array<double>")
    points = points.withColumn("_r", F.abs(F.array_position(F.array_sort(F.array_append(within, F.col("_p"))), F.col("_p"))).cast("int")) if bounds else points.withColumn("_r", F.lit(1))
    ranked = points.withColumn("_rank", F.sum("_n").over(Window.partitionBy("_r").orderBy("_p")))
    across = Window.orderBy("_r")  # one row a range, MOST_RANGES at most
    before = points.groupBy("_r").agg(F.sum("_n").alias("_size")).withColumn("_before", F.sum("_size").over(across) - F.col("_size")).select("_r", "_before")
    ratio = ranked.join(before, "_r").withColumn("_q", F.col("_p") * F.lit(total) / (F.col("_rank") + F.col("_before")))
    lows = ratio.groupBy("_r").agg(F.min("_q").alias("_low"))
    after = lows.withColumn("_after", F.min("_low").over(across.rowsBetween(1, Window.unboundedFollowing))).select("_r", "_after")
    down = Window.partitionBy("_r").orderBy(F.desc("_p"))
    final = ratio.withColumn("_m", F.min("_q").over(down)).join(after, "_r").select("_p", F.least(F.lit(1.0), "_m", F.coalesce("_after", F.lit(1.0))).alias("padj"))
    return df.drop("padj").join(final, df[p] == final["_p"], "left").drop("_p")


#: Samples on a side of one block of a samples x samples table; blocks of a pair merged at a time.
BLOCK, FAN_IN = 512, 16
_BLOCKS = "i int, j int, chunk bigint, dots array<double>"


def _samples(values: DataFrame) -> list[str]:
    samples = sorted(r[0] for r in values.where("sample IS NOT NULL").select("sample").distinct().limit(MAX_SAMPLES + 1).collect())
    if len(samples) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    return samples


def _outer_products(samples: list[str]):
    place, n = {s: i for i, s in enumerate(samples)}, len(samples)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        chunk, some = TaskContext.get().partitionId(), False
        for f in frames:
            for at in range(0, len(f), 4096):
                part = f.iloc[at : at + 4096]
                m = np.zeros((len(part), n))
                for r, (names, values) in enumerate(zip(part["samples"], part["values"])):
                    m[r, [place[s] for s in names]] = values
                total += m.T @ m
                some = True
        if some:
            for i in range(0, n, BLOCK):
                for j in range(i, n, BLOCK):
                    yield pd.DataFrame({"i": [i], "j": [j], "chunk": [chunk], "dots": [total[i : i + BLOCK, j : j + BLOCK].ravel()]})

    return run


def _add_blocks(f: pd.DataFrame) -> pd.DataFrame:
    return f.iloc[:1].assign(dots=[np.sum(np.stack(f["dots"].to_list()), axis=0)])


def gram(values: DataFrame, value: str) -> tuple[list[str], DataFrame]:
    """(sorted samples, table (a, b, dot), a <= b, of sums over genes of value_a * value_b); absent cells are 0.

    Each task sums the outer products of its genes and passes them on in square blocks, which merge in rounds of
    FAN_IN: no task holds more than that many blocks, however many genes there are. More than MAX_SAMPLES samples
    raise an error. A cell given twice counts with one of its values.
    """
    values = cut(values.select("gene_id", "sample", value))  # for the names and for the sums
    samples = _samples(values)
    n = len(samples)
    rows = values.where(F.col(value).isNotNull() & F.col("sample").isNotNull()).groupBy("gene_id").agg(F.collect_list("sample").alias("samples"), F.collect_list(value).alias("values")).select("samples", "values")
    parts = rows.mapInPandas(_outer_products(samples), _BLOCKS)
    tasks = max(2, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for level in range(max(1, math.ceil(math.log(tasks, FAN_IN)))):
        parts = parts.groupBy("i", "j", F.floor(F.col("chunk") / FAN_IN).alias("node")).applyInPandas(_add_blocks, _BLOCKS).withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, j, dots in zip(f["i"], f["j"], f["dots"]):
                wide = min(BLOCK, n - j)
                a, b = np.divmod(np.arange(len(dots)), wide)
                keep = a + i <= b + j
                yield pd.DataFrame({"a": (a + i)[keep], "b": (b + j)[keep], "dot": np.asarray(dots)[keep]})

    # partition numbers may pass ``tasks``; what is then left of a pair is added up here
    return samples, parts.mapInPandas(cells, "a int, b int, dot double").groupBy("a", "b").agg(F.sum("dot").alias("dot"))


def sample_distances(values: DataFrame, value: str) -> DataFrame:
    """(sample_a, sample_b, distance), a before b: Euclidean over genes, absent cells as 0."""
    samples, dots = gram(values, value)
    dots = cut(dots)
    names = F.array(*[F.lit(s) for s in samples]) if samples else F.array().cast("array<string>")
    norms = dots.where("a = b").select(F.col("a").alias("i"), F.col("dot").alias("n"))
    full = dots.where("a < b").join(norms.select(F.col("i").alias("a"), F.col("n").alias("na")), "a").join(norms.select(F.col("i").alias("b"), F.col("n").alias("nb")), "b")
    d2 = F.col("na") + F.col("nb") - 2 * F.col("dot")
    return full.select(F.get(names, F.col("a")).alias("sample_a"), F.get(names, F.col("b")).alias("sample_b"), F.sqrt(F.greatest(d2, F.lit(0.0))).alias("distance"))


def complete_linkage(distances: DataFrame) -> DataFrame:
    """(step, left, right, height, size) of complete-linkage clustering.

    Samples are numbered by name from -1 downwards, merges from 1 upwards by height. In each round all pairs of
    clusters that are each other's nearest merge at once, which gives the tree of merging the nearest pair of all, as
    a cluster is no nearer to others than its parts were. Equal distances: the pair with the smaller names goes first.
    A round is a grouping of the distances left and is kept in the checkpoint folder; no task holds them all. Only the
    merges, one fewer than samples, reach the driver; more than MAX_SAMPLES samples raise an error.
    """
    spark = distances.sparkSession
    d = cut(distances.select(F.least("sample_a", "sample_b").alias("a"), F.greatest("sample_a", "sample_b").alias("b"), F.col("distance").alias("d")))
    names = _samples(d.select(F.explode(F.array("a", "b")).alias("sample")))
    merges: list[tuple[float, str, str]] = []
    while len(merges) < len(names) - 1:
        both = d.select(F.explode(F.array("a", "b")).alias("of"), F.struct("d", "a", "b").alias("pair"))
        near = both.groupBy("of").agg(F.min("pair").alias("pair"))
        mutual = near.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("pair.*").collect()
        if not mutual:
            raise ValueError("distances of some pairs are missing or NULL")
        merges += [(r["d"], r["a"], r["b"]) for r in mutual]
        # a merged cluster goes by its smaller name
        to = spark.createDataFrame([(r["b"], r["a"]) for r in mutual], "old string, new string")
        moved = d.join(F.broadcast(to.select(F.col("old").alias("a"), F.col("new").alias("x"))), "a", "left").join(F.broadcast(to.select(F.col("old").alias("b"), F.col("new").alias("y"))), "b", "left")
        x, y = F.coalesce("x", "a"), F.coalesce("y", "b")
        d = cut(moved.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "d").where("a <> b").groupBy("a", "b").agg(F.max("d").alias("d")))
    label, size, out = {s: -(k + 1) for k, s in enumerate(names)}, dict.fromkeys(names, 1), []
    for step, (height, a, b) in enumerate(sorted(merges), 1):
        size[a] += size[b]
        out.append((step, label[a], label[b], float(height), size[a]))
        label[a] = step
    return spark.createDataFrame(out, "step int, left int, right int, height double, size int")


def pca(values: DataFrame, value: str, components: int = 2, top_genes: int = 500) -> DataFrame:
    """(sample, pc, score, share): sample scores on the first components of the most variable genes.

    Genes are chosen by variance over samples (ties by name), absent cells being 0, and centred; samples are the rows
    of Spark's own PCA. The sign makes each component's largest score positive.
    """
    values = cut(values.select("gene_id", "sample", value))
    n = values.agg(F.countDistinct("sample")).scalar()
    stats = values.groupBy("gene_id").agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_ss")).withColumn("_mean", F.col("_s") / n)
    var = stats.withColumn("_v", F.col("_ss") / n - F.col("_mean") * F.col("_mean"))
    chosen = cut(var.orderBy(F.desc("_v"), "gene_id").limit(top_genes).select("gene_id"))
    picked = values.join(chosen, "gene_id", "left_semi").where("sample IS NOT NULL")
    genes = {r[0]: k for k, r in enumerate(chosen.orderBy("gene_id").collect())}  # top_genes at most
    if not genes:
        return values.sparkSession.createDataFrame([], "sample string, pc int, score double, share double")
    place = F.create_map(*[x for g, k in genes.items() for x in (F.lit(g), F.lit(k))])
    cells = picked.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct(F.get(F.array(place), F.lit(0))[F.col("gene_id")].alias("k"), F.col(value).cast("double").alias("v")))).alias("cells"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(len(genes) - 1)), lambda k: F.coalesce(F.try_element_at("cells", k), F.lit(0.0)))
    rows = cut(cells.select("sample", array_to_vector(dense).alias("row")))
    model = PCA(k=min(components, len(genes)), inputCol="row", outputCol="scores").fit(rows)
    share = [float(x) for x in model.explainedVariance]
    raw = model.transform(rows).select("sample", F.posexplode(vector_to_array("scores")).alias("k", "raw"))
    scores = raw.join(raw.groupBy("k").agg(F.avg("raw").alias("mean")), "k").select("sample", "k", (F.col("raw") - F.col("mean")).alias("score"))
    largest = scores.groupBy("k").agg(F.max_by("score", F.struct(F.abs("score"), "sample")).alias("top"))
    shares = F.array(*[F.lit(x) for x in share])
    return scores.join(largest, "k").select("sample", (F.col("k") + 1).alias("pc"), F.when(F.col("top") < 0, -F.col("score")).otherwise(F.col("score")).alias("score"), F.get(shares, F.col("k")).alias("share"))


def moments(y: np.ndarray, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean of normalized counts, dispersion by moments, whether the gene has a fit) of each gene.

    y: genes x samples; x, s: level (0 or 1) and size factor of each cell. Moments are taken within each level, so that
    a difference between levels is no dispersion.
    """
    g, n = y.shape
    norm = y / s
    mean = norm.mean(axis=1)
    over, under = np.zeros(g), np.zeros(g)
    for level in (0.0, 1.0):
        own = x == level
        k = own.sum(axis=1)
        safe = np.maximum(k, 1)
        m = (norm * own).sum(axis=1) / safe
        ss = (((norm - m[:, None]) * own) ** 2).sum(axis=1)
        inverse = (own / s).sum(axis=1) / safe
        over += np.where(k > 1, ss - (k - 1) * m * inverse, 0.0)
        under += np.where(k > 1, (k - 1) * m**2, 0.0)
    alpha = np.where(under > 0, np.clip(over / np.where(under > 0, under, 1), 1e-8, 10.0), 1e-8)
    return mean, alpha, (mean > 0) & (n >= 3) & (x.min(axis=1) != x.max(axis=1))


def solve(y: np.ndarray, x: np.ndarray, s: np.ndarray, alpha: np.ndarray, mean: np.ndarray, max_iter: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intercept, coefficient of x, its error) of each gene, as natural logarithms; the two normal equations of all genes at once."""
    a = alpha[:, None]
    b0, b1, ridge = np.log(mean), np.zeros(len(y)), 1e-6

    def weights() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        mu = np.maximum(s * np.exp(np.clip(b0[:, None] + b1[:, None] * x, -30, 30)), 1e-6)
        w = mu / (1 + a * mu)
        return mu, w, w.sum(axis=1), (w * x).sum(axis=1), (w * x * x).sum(axis=1)

    going = np.ones(len(b0), dtype=bool)
    for _ in range(max_iter):
        mu, w, w0, w1, w2 = weights()
        z = np.log(mu / s) + (y - mu) / mu
        u0, u1 = (w * z).sum(axis=1), (w * x * z).sum(axis=1)
        det = (w0 + ridge) * (w2 + ridge) - w1 * w1
        n0, n1 = ((w2 + ridge) * u0 - w1 * u1) / det, ((w0 + ridge) * u1 - w1 * u0) / det
        moved = np.maximum(np.abs(n0 - b0), np.abs(n1 - b1))
        b0, b1 = np.where(going, n0, b0), np.where(going, n1, b1)
        going &= moved >= 1e-8
        if not going.any():
            break
    _, _, w0, w1, w2 = weights()
    det = (w0 + ridge) * (w2 + ridge) - w1 * w1
    v10, v11 = -w1 / det, (w0 + ridge) / det  # the coefficient's row of the inverse
    return b0, b1, np.sqrt(np.maximum(v10 * v10 * w0 + 2 * v10 * v11 * w1 + v11 * v11 * w2, 0.0))


def wald(y: np.ndarray, x: np.ndarray, s: np.ndarray, alpha: np.ndarray | None = None) -> np.ndarray:
    """Rows of (mean, dispersion, coefficient, its error, statistic, p) of each gene; NaN where there is none.

    alpha: dispersions, by moments if not given.
    """
    mean, own, fit = moments(y, x, s)
    alpha = own if alpha is None else alpha
    out = np.full((len(y), 6), np.nan)
    out[:, 0], out[:, 1] = mean, alpha
    if not fit.any():
        return out
    _, b1, se = solve(y[fit], x[fit], s[fit], alpha[fit], mean[fit])
    with np.errstate(divide="ignore", invalid="ignore"):
        stat = np.where(se > 0, b1 / se, np.nan)
    out[fit, 2], out[fit, 3], out[fit, 4] = b1 / math.log(2), se / math.log(2), stat
    out[fit, 5] = [math.erfc(abs(t) / math.sqrt(2)) for t in stat]
    return out


FIT = ("base_mean", "dispersion", "log2fc", "lfc_se", "stat", "pvalue")


def gene_rows(counts: DataFrame, factors: DataFrame, numerator: str, column: str) -> DataFrame:
    """(gene_id, y, x, s): each gene's counts, levels (1 for ``numerator``) and size factors as arrays; its samples are few."""
    level = (F.col(column) == numerator).cast("double")
    cell = F.struct(F.col("count").cast("double").alias("y"), level.alias("x"), F.col("size_factor").alias("s"))
    rows = counts.where("count IS NOT NULL").join(factors.select("sample", "size_factor"), "sample").where(level.isNotNull() & (F.col("size_factor") > 0))
    return rows.groupBy("gene_id").agg(F.collect_list(cell).alias("c")).select("gene_id", *[F.col(f"c.{k}").alias(k) for k in "yxs"])


def by_width(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the batch, y, x, s) of the genes of each number of samples."""
    n = np.diff(b.column("y").offsets.to_numpy()) if b.num_rows else np.zeros(0, dtype=int)
    for width in np.unique(n):
        some = np.flatnonzero(n == width)
        yield some, *(np.asarray(b.column(k).take(pa.array(some)).flatten()).astype(float).reshape(len(some), width) for k in "yxs")


def nb_wald(counts: DataFrame, factors: DataFrame, numerator: str, column: str = "species") -> DataFrame:
    """(gene_id, base_mean, dispersion, log2fc, lfc_se, stat, pvalue, padj): negative-binomial Wald test of one factor.

    Tier 1: dispersion by moments within the levels, coefficients by iterated weighted least squares with the given size factors,
    two-sided normal p, Benjamini-Hochberg. log2fc is ``numerator`` over the other level of ``column``. Genes of
    only zeros, of one level or of fewer than three samples have NULL statistics. No dispersion trend, outlier
    flags or independent filtering. A gene is one row (its samples are few), and a batch of genes is fitted at once
    in numpy; the fits are kept in the checkpoint folder, so that they are made once.
    """
    genes = gene_rows(counts, factors, numerator, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, y, x, s in by_width(b):
                got = wald(y, x, s)
                yield pa.record_batch([b.column("gene_id").take(pa.array(some)), *[pa.array(v, pa.float64(), from_pandas=True) for v in got.T]], names=["gene_id", *FIT])

    fitted = cut(genes.mapInArrow(run, "gene_id string, " + ", ".join(f"{c} double" for c in FIT)))
    return bh_adjust(fitted, "pvalue", "gene_id")
