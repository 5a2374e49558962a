"""Count tables in long form: delivery, gene sums, filters, ortholog mapping, combination, reshaping, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelake.functions.names import strip_prefix, without_version


def latest(counts: DataFrame) -> DataFrame:
    """One row per (gene_id, sample): the last delivery; gene ids without their prefix.

    Of rows delivered at the same time the larger count wins, NULL being smallest. Rows without a gene or sample
    are left out. A map-side maximum, so repeated deliveries don't pile up in one task.
    """
    rows = counts.withColumn("gene_id", strip_prefix(F.col("gene_id"))).where("gene_id IS NOT NULL AND sample IS NOT NULL")
    rest = [c for c in counts.columns if c not in ("gene_id", "sample", "loaded_at", "count")]
    last = F.max(F.struct("loaded_at", "count", *rest)).alias("last")
    return rows.groupBy("gene_id", "sample").agg(last).select("gene_id", "sample", *[F.col(f"last.{c}") for c in (*rest, "count", "loaded_at")])


def gene_sums(quant: DataFrame, tx2gene: DataFrame, tx: str = "name") -> DataFrame:
    """Transcript quantities summed to genes: (gene_id, sample, count, abundance, length).

    Version suffixes of transcript ids are ignored; transcripts of no gene are left out. length is the mean of
    effective lengths weighted by abundance, plain mean where the abundance is 0.
    """
    genes = tx2gene.select(without_version(F.col("transcript_id")).alias("_tx"), "gene_id").distinct()
    q = quant.withColumn("_tx", without_version(F.col(tx))).join(genes, "_tx")
    return q.groupBy("gene_id", "sample").agg(
        F.sum("num_reads").alias("count"), F.sum("tpm").alias("abundance"),
        F.coalesce(F.try_divide(F.sum(F.col("effective_length") * F.col("tpm")), F.sum("tpm")), F.avg("effective_length")).alias("length"),
    )


#: Most samples a dense matrix may have.
MAX_SAMPLES = 5000


def densify(counts: DataFrame) -> DataFrame:
    """(gene_id, sample, count) for every gene with every sample; absent and NULL counts are 0.

    The samples, at most MAX_SAMPLES (else an error), go to each gene as an array; genes are never gathered.
    """
    samples = sorted(r[0] for r in counts.where("sample IS NOT NULL").select("sample").distinct().limit(MAX_SAMPLES + 1).collect())
    if len(samples) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    every = F.array(*[F.lit(s) for s in samples]) if samples else F.array().cast("array<string>")
    grid = counts.select("gene_id").distinct().withColumn("sample", F.explode(every))
    have = counts.select("gene_id", "sample", "count")
    return grid.join(have, ["gene_id", "sample"], "left").withColumn("count", F.coalesce("count", F.lit(0.0)))


def expressed_genes(counts: DataFrame, threshold: float, samples: int) -> DataFrame:
    """Genes counted at ``threshold`` or more in at least ``samples`` samples."""
    n = F.sum((F.col("count") >= threshold).cast("int"))
    return counts.groupBy("gene_id").agg(n.alias("n")).where(F.col("n") >= samples).select("gene_id")


def expression_filter(counts: DataFrame, threshold: float, samples: int) -> DataFrame:
    return counts.join(expressed_genes(counts, threshold, samples), "gene_id", "left_semi")


def sample_subset(counts: DataFrame, condition: str | None = None, first_slice: int | None = None, last_slice: int | None = None) -> DataFrame:
    """Counts of one condition and a range of slices, both ends included."""
    if condition is not None:
        counts = counts.where(F.col("condition") == condition)
    if first_slice is not None:
        counts = counts.where(F.col("slice") >= first_slice)
    return counts.where(F.col("slice") <= last_slice) if last_slice is not None else counts


def map_orthologs(counts: DataFrame, orthologs: DataFrame) -> DataFrame:
    """Counts restricted to orthologs, AC genes re-keyed to the mouse id, MM genes kept; another species is an error.

    A map that isn't one to one gives a row for each pairing.
    """
    known = F.when(F.col("species").isin("AC", "MM"), F.col("species")).otherwise(F.raise_error(F.concat(F.lit("no such species: "), F.coalesce("species", F.lit("NULL")))))
    keyed = counts.withColumn("species", known)
    o = orthologs.where("mus_id IS NOT NULL")
    by_species = o.select(F.lit("MM").alias("species"), F.col("mus_id").alias("gene_id"), F.col("mus_id").alias("_to"), "symbol").unionByName(
        o.where("acomys_id IS NOT NULL").select(F.lit("AC").alias("species"), F.col("acomys_id").alias("gene_id"), F.col("mus_id").alias("_to"), "symbol")
    )
    return keyed.drop("symbol").join(by_species, ["species", "gene_id"]).withColumn("gene_id", F.col("_to")).drop("_to")


def combine(counts: DataFrame, group: Column, groups: int | None = None) -> DataFrame:
    """Rows of the genes found in every group (file, sample, species): the inner join of all of them, in long form.

    groups: how many there must be; by default those that occur.
    """
    keyed = counts.withColumn("_group", group)
    need = F.lit(groups) if groups is not None else keyed.agg(F.countDistinct("_group")).scalar()
    shared = keyed.groupBy("gene_id").agg(F.countDistinct("_group").alias("n")).where(F.col("n") == need).select("gene_id")
    return counts.join(shared, "gene_id", "left_semi")


def wide(counts: DataFrame, columns: list[str], by: str = "sample") -> DataFrame:
    """One row per gene, one column for each of ``columns`` in the given order; absent cells are NULL."""
    return counts.groupBy("gene_id").pivot(by, columns).agg(F.sum("count")).select("gene_id", *[F.col(f"`{c}`") for c in columns])


def numeric_order(names: list[str]) -> list[str]:
    """Column names by the number in them, not by letters; names without one come last."""
    import re

    return sorted(names, key=lambda n: (not (m := re.search(r"(\d+)(?!.*\d)", n)), int(m.group(1)) if m else 0, n))


def long(matrix: DataFrame, by: str = "sample") -> DataFrame:
    """The wide table's cells as rows."""
    cells = [c for c in matrix.columns if c != "gene_id"]
    return matrix.unpivot("gene_id", [F.col(f"`{c}`").alias(c) for c in cells], by, "count")


def input_report(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: rows, genes, samples, NULL counts, and samples that only one of the two tables has."""
    a, b = counts.select("sample").distinct(), samples.select("sample").distinct()
    only = a.join(b, "sample", "left_anti").agg(F.count(F.lit(1)).alias("n")), b.join(a, "sample", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("gene_id").alias("genes"), F.countDistinct("sample").alias("samples"), F.count_if(F.col("count").isNull()).alias("null_counts"))
    return stats.select("*", only[0].scalar().alias("not_in_samples"), only[1].scalar().alias("not_in_counts"))


def check_samples(columns: list[str], samples: DataFrame, order: str, name: str = "sample") -> None:
    """Stops with an error unless a matrix's columns are the sample rows' names, in their order (by ``order``).

    Both are bounded by MAX_SAMPLES; more sample rows are an error too.
    """
    rows = [r[0] for r in samples.orderBy(order).select(name).limit(MAX_SAMPLES + 1).collect()]
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    if rows != list(columns):
        at = next((i for i, (a, b) in enumerate(zip(columns, rows)) if a != b), min(len(columns), len(rows)))
        raise ValueError(f"count columns and sample rows differ from place {at + 1} on: {list(columns)[at : at + 1]} and {rows[at : at + 1]}")


def multimapping_filter(alignments: DataFrame, most_genes: int = 2) -> DataFrame:
    """Alignments (read_id, gene_id) of the reads that hit at most ``most_genes`` genes."""
    few = alignments.groupBy("read_id").agg(F.countDistinct("gene_id").alias("n")).where(F.col("n") <= most_genes)
    return alignments.join(few.select("read_id"), "read_id", "left_semi")
