"""Plot-ready tables: volcano points, gene sets, slice profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelake.functions.names import profile_label


def capped_log_p(padj: Column, cap: float = 50.0) -> Column:
    """-log10, capped, rounded half even to 2 places; NULL stays NULL and 0 gives the cap."""
    return F.when(padj.isNotNull(), F.when(padj == 0, F.lit(cap)).otherwise(F.bround(F.least(-F.log10(padj), F.lit(cap)), 2)))


def significance(nlp: Column, lfc: Column, nlp_from: float = 1.3, lfc_from: float = 0.4) -> Column:
    """sig_up, sig_down or not_sig on rounded values; NULL where either is NULL."""
    return F.when(nlp.isNull() | lfc.isNull(), F.lit(None)).when((nlp >= nlp_from) & (lfc > lfc_from), "sig_up").when((nlp >= nlp_from) & (lfc < -lfc_from), "sig_down").otherwise("not_sig")


def volcano_points(de: DataFrame, padj: str = "padj", lfc: str = "log2fc") -> DataFrame:
    """Adds nlp, lfc (2 places) and significance, and an order for the classes in a legend."""
    out = de.withColumn("nlp", capped_log_p(F.col(padj))).withColumn("lfc", F.bround(F.col(lfc), 2))
    out = out.withColumn("significance", significance(F.col("nlp"), F.col("lfc")))
    return out.withColumn("legend_order", F.when(F.col("significance") == "sig_up", 1).when(F.col("significance") == "sig_down", 2).when(F.col("significance") == "not_sig", 3))


def gene_set(symbol: Column, structural: list[str]) -> Column:
    """collagen (begins Col), else metallo (name holds metallo, case apart), else structural by the given list, else other."""
    return F.when(symbol.startswith("Col"), "collagen").when(F.lower(symbol).contains("metallo"), "metallo").when(symbol.isin(*structural) if structural else F.lit(False), "structural").when(symbol.isNotNull(), "other")


def marker_expression(counts: DataFrame, markers: DataFrame, on: str = "gene_id") -> DataFrame:
    """Counts of the marker genes with the markers' columns; a gene in two marker rows gives its counts twice."""
    return counts.join(markers, on)


def profile_points(values: DataFrame, value: str, genes: DataFrame | None = None) -> DataFrame:
    """(gene_id, species, label, slice, value, top): one point a slice, with the gene's largest value as axis limit."""
    if genes is not None:
        values = values.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    points = values.select("gene_id", "species", profile_label(F.col("condition"), F.col("replicate")).alias("label"), "slice", F.bround(value, 1).alias("value"))
    tops = points.groupBy("gene_id").agg(F.max("value").alias("top"))
    return points.join(tops, "gene_id")


def with_prefix(sheet: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows of a sheet that aren't wholly empty and whose ``column`` begins with ``prefix``; NULL doesn't."""
    return sheet.where(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in sheet.columns]).isNotNull() & F.col(column).startswith(prefix))


def in_gene_set(de: DataFrame, genes: DataFrame, on: str = "symbol") -> DataFrame:
    """Results of the genes of a set, with the set's columns; a gene listed twice gives a row for each."""
    return de.join(genes, on)


def labelled(points: DataFrame, symbol: str, selected: DataFrame) -> DataFrame:
    """Adds label: the symbol where it is among the selected ones, else NULL."""
    chosen = selected.select(F.col(symbol), F.lit(True).alias("_on")).distinct()
    return points.join(chosen, symbol, "left").withColumn("label", F.when(F.col("_on"), F.col(symbol))).drop("_on")
