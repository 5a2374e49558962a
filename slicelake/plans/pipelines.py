"""Whole jobs from files to files: validation, matching, demultiplexing, neighbourhoods, primary transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.functions import names
from slicelake.functions.reads import record_error
from slicelake.operators import barcodes as B
from slicelake.operators import counts as C
from slicelake.operators import normalize as N
from slicelake.operators.series import duplicate_keys
from slicelake.session import cut
from slicelake.sources import fasta, fastq, tabular


def _error(tag: str):
    return record_error(F.col("header_line"), F.col("seq_line"), F.col("plus_line"), F.col("qual_line"), tag)


def integrity_check(spark: SparkSession, path: str, tag: str = "@NS", malformed_path: str | None = None) -> DataFrame:
    """(error, records), valid records under ``valid``; malformed records go to ``malformed_path`` where given. Incomplete records count."""
    reads = fastq.read_fastq(spark, path, tag)
    if malformed_path:
        fastq.quarantine(reads, malformed_path, tag)
    return reads.groupBy(F.coalesce(_error(tag), F.lit("valid")).alias("error")).agg(F.count(F.lit(1)).alias("records"))


def match_edit(spark: SparkSession, path: str, out_path: str, sequences: list[str], barcode_path: str | None = None, replacement: str | None = None, tag: str = "@NS") -> DataFrame:
    """Splits records by whether their whole sequence is one of the given ones, into folders matched=true and false.

    With a replacement, matched records get it as sequence, with quality all I. Returns one row: records, matched,
    mismatched. No sequence at all is an error; an input without records gives empty folders and zeros.
    """
    queries = tabular.query_sequences(spark, sequences, tabular.read_barcodes(spark, barcode_path) if barcode_path else None)
    if queries.isEmpty():
        raise ValueError("no valid query sequence")
    reads = fastq.read_fastq(spark, path, tag).where(F.col("header_line").startswith(tag))
    found = reads.join(queries.withColumn("matched", F.lit(True)), F.col("seq_line") == F.col("seq"), "left").drop("seq").withColumn("matched", F.coalesce("matched", F.lit(False)))
    if replacement is not None:
        seq, qual = B.replaced(F.col("matched"), F.lit(replacement), F.col("seq_line"), F.col("qual_line"))
        found = found.withColumns({"seq_line": seq, "qual_line": qual})
    fastq.write_split(found, out_path)
    n = F.coalesce(F.sum("records"), F.lit(0))
    return fastq.records_by(spark, out_path, "matched boolean").agg(n.alias("records"), F.coalesce(F.sum(F.when(F.col("matched"), F.col("records"))), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.when(~F.col("matched"), F.col("records"))), F.lit(0)).alias("mismatched"))


def demultiplex(spark: SparkSession, r1_path: str, r2_path: str, barcode_path: str, out_path: str, barcode_bases: int = 8, max_hamming: int = 1, tag: str = "@NS") -> DataFrame:
    """Demultiplexes R2 files by the barcodes in R1 files, into one folder a slice and barcode; returns the summary.

    Samples are told apart by file name (second underscore part). R1 sequences are cut to the barcode, invalid
    records are left out, barcodes repaired where that is unambiguous. Listed barcodes without reads have no folder.
    """
    listed = B.barcode_list(tabular.read_barcodes(spark, barcode_path))
    sample = names.sample_from_name(F.element_at(F.split("file", "/"), -1))
    r1 = fastq.read_fastq(spark, r1_path, tag).where(_error(tag).isNull()).withColumn("sample_id", sample).withColumn("seq_line", F.substring("seq_line", 1, barcode_bases))
    r2 = fastq.read_fastq(spark, r2_path, tag).where(_error(tag).isNull()).withColumn("sample_id", sample)
    found = B.demux_r2(r2, B.repair(r1, listed, max_hamming=max_hamming)).join(listed, "barcode")
    fastq.write_by_barcode(found, out_path)
    written = fastq.records_by(spark, out_path, "slice_id int, barcode string").groupBy("barcode").agg(F.sum("records").alias("read_count"))
    return B.with_percent(written, listed, r2.agg(F.count(F.lit(1)).alias("n")))


def normalization_tables(counts: DataFrame, out_path: str, threshold: float, samples: int) -> None:
    """Parquet tables under ``out_path``: unfiltered and filtered counts, size factors of the filtered ones, and all
    counts normalized by them."""
    counts = cut(counts)
    filtered = C.expression_filter(counts, threshold, samples)
    factors = cut(N.size_factors(filtered))
    for name, df in (("unfiltered", counts), ("filtered", filtered), ("size_factors", factors), ("normalized", N.normalized(counts, factors))):
        df.write.mode("errorifexists").parquet(f"{out_path}/{name}")


def barcode_permutations(spark: SparkSession, barcode_path: str, barcode: str | None = None, max_hamming: int = 1) -> DataFrame:
    """(barcode, variant, distance): unambiguous variants of all listed barcodes, or of one."""
    variants = B.unambiguous_variants(B.barcode_list(tabular.read_barcodes(spark, barcode_path)), max_hamming)
    return variants if barcode is None else variants.where(F.col("barcode") == barcode.upper())


def primary_transcript_file(spark: SparkSession, path: str, out_path: str, key: str | None = None) -> DataFrame:
    """Writes the longest sequence of each gene as FASTA text; returns written, genes, unidentified.

    key: ``last_dot`` (the header before its last dot) or ``space`` (its first token) names the gene; by default the
    file's own form tells how. Entries are written under their gene, those without one and all of NCBI's files
    under their own header. Duplicated headers are an error, as is a number of written entries other than genes plus
    unidentified ones.
    """
    entries = cut(fasta.with_gene(fasta.read_fasta(spark, path), key))
    if not duplicate_keys(entries, ["file", "header"]).isEmpty():
        raise ValueError("duplicated headers")
    best = cut(fasta.primary_transcripts(entries))
    report = fasta.conservation(entries, best).first()
    if report["written"] != report["genes"] + report["unidentified"]:
        raise ValueError(f"written entries don't add up: {report}")
    best.select(F.concat(F.lit(">"), F.when(F.col("keeps_header"), F.col("header")).otherwise(F.coalesce("gene", "header")), F.lit("\n"), "seq").alias("value")).write.mode("errorifexists").text(out_path)
    return spark.createDataFrame([report])
