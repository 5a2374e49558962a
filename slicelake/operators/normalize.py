"""Normalization of long count tables: size factors, counts per million, z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def size_factors(counts: DataFrame) -> DataFrame:
    """(sample, size_factor): median of ratios to the geometric mean over genes counted in every sample.

    Absent rows and NULLs are zeros, which exclude a gene; without a usable gene the table is empty. The number of
    samples is counted, not gathered; the median is exact and interpolates.
    """
    n = counts.agg(F.countDistinct("sample")).scalar()
    positive = counts.where("count > 0").select("gene_id", "sample", F.ln("count").alias("lc"))
    full = positive.groupBy("gene_id").agg(F.avg("lc").alias("lg"), F.count(F.lit(1)).alias("n")).where(F.col("n") == n)
    ratios = positive.join(full.select("gene_id", "lg"), "gene_id")
    return ratios.groupBy("sample").agg(F.exp(F.median(F.col("lc") - F.col("lg"))).alias("size_factor"))


def normalized(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """Counts over their sample's size factor; factors may come from other (filtered) genes than the counts."""
    return counts.join(factors.select("sample", "size_factor"), "sample").withColumn("normalized", F.col("count") / F.col("size_factor"))


def log_cpm(counts: DataFrame) -> DataFrame:
    """Adds log_cpm: ln(1 + counts per million of the sample). Totals are summed before they are joined back."""
    totals = counts.groupBy("sample").agg(F.sum("count").alias("_total"))
    return counts.join(totals, "sample").withColumn("log_cpm", F.log1p(F.try_divide(F.col("count"), F.col("_total")) * 1e6)).drop("_total")


def log2_normalized(values: DataFrame) -> DataFrame:
    """Adds log2(normalized + 0.5), in place of a regularized log."""
    return values.withColumn("log2_norm", F.log2(F.col("normalized") + 0.5))


def slice_means(values: DataFrame, value: str) -> DataFrame:
    """(gene_id, species, condition, slice, mean): over the replicates of a slice."""
    return values.groupBy("gene_id", "species", "condition", "slice").agg(F.avg(value).alias("mean"))


def z_scores(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds z: distance from the group's mean in sample standard deviations; NULL for a group of one or of equal values."""
    stats = values.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return values.join(stats, by).withColumn("z", F.try_divide(F.col(value) - F.col("_m"), F.nullif("_s", F.lit(0.0)))).drop("_m", "_s")
