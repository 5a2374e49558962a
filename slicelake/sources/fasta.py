"""FASTA files as tables, and primary transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.functions import names
from slicelake.operators.series import longest_per_group, top_values


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, header, seq, seq_len); header without >, lines of a sequence joined. ordinal keeps the order within a file."""
    raw = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", "true").text(path)
    entry = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"), F.regexp_replace("value", r"\A>", "").alias("v")).where("trim(v) <> ''")
    head = F.regexp_replace(F.substring_index("v", "\n", 1), r"\s+\z", "")
    rest = F.when(F.instr("v", "\n") > 0, F.expr("substr(v, instr(v, '\n') + 1)")).otherwise("")
    seq = F.regexp_replace(rest, r"\s", "")
    return entry.select("file", "ordinal", head.alias("header"), seq.alias("seq"), F.length(seq).alias("seq_len"))


def decoy_names(fasta: DataFrame) -> DataFrame:
    """The first token of each header."""
    return fasta.select(names.first_token(F.col("header")).alias("name"))


def primary_transcripts(fasta: DataFrame, gene: str = "gene") -> DataFrame:
    """(gene, header, seq, seq_len, ordinal): the longest sequence of each gene, the first of equally long ones.

    fasta: read_fasta() with a gene column. Entries without a gene all stay under their own header.
    """
    kept = ["header", "seq", "seq_len", "ordinal", *(["keeps_header"] if "keeps_header" in fasta.columns else [])]
    return longest_per_group(fasta, gene, F.col("seq_len"), "ordinal", kept)


KEYS = {"last_dot": names.before_last_dot, "space": names.first_token}


def with_gene(fasta: DataFrame, key: str | None = None) -> DataFrame:
    """Adds gene, and keeps_header: whether an entry is written under its own header.

    key: one of KEYS for all entries; by default the NCBI rule for files whose first header is NCBI's, which keep their
    headers, else gene and locus tokens.
    """
    if key is not None:
        return fasta.withColumns({"gene": KEYS[key](F.col("header")), "keeps_header": F.lit(False)})
    first = fasta.groupBy("file").agg(F.min_by(names.is_ncbi(F.col("header")), "ordinal").alias("_ncbi"))
    h = F.col("header")
    return fasta.join(first, "file").withColumn("gene", F.when(F.col("_ncbi"), names.ncbi_gene(h)).otherwise(names.ensembl_gene(h))).withColumnRenamed("_ncbi", "keeps_header")


def tag_tokens(fasta: DataFrame) -> DataFrame:
    """(tag, id) of each ``tag:id`` token of each header."""
    tokens = fasta.select(F.explode(F.filter(F.split("header", r"\s+"), lambda t: t.contains(":"))).alias("token"))
    return tokens.select(F.substring_index("token", ":", 1).alias("tag"), F.expr("substr(token, instr(token, ':') + 1)").alias("id"))


def tag_statistics(fasta: DataFrame, k: int = 5) -> DataFrame:
    """(tag, id, n, rank): the ``k`` most frequent ids of each tag of the headers, ties by id."""
    return top_values(tag_tokens(fasta), "tag", "id", k)


def sequences_per_gene(fasta: DataFrame, gene: str = "gene") -> DataFrame:
    """One row: sequences, distinct genes (a NULL gene counts as one)."""
    return fasta.agg(F.count(F.lit(1)).alias("sequences"), (F.countDistinct(gene) + F.coalesce(F.max(F.col(gene).isNull().cast("int")), F.lit(0))).alias("genes"))


def conservation(before: DataFrame, after: DataFrame, gene: str = "gene") -> DataFrame:
    """One row: entries written, distinct genes, entries without a gene; written equals the other two added."""
    b = before.agg(F.countDistinct(gene).alias("genes"), F.count_if(F.col(gene).isNull()).alias("unidentified"))
    return b.select(after.agg(F.count(F.lit(1)).alias("n")).scalar().alias("written"), "genes", "unidentified")
