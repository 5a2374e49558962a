"""Tables in text files: barcodes, query sequences, dictionaries, annotations, quantifications, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.functions.names import sample_from_name


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(barcode, slice_id) of a tab-separated list with a header line. Letters other than ACGTN raise an error; a number that isn't one is NULL."""
    raw = spark.read.csv(path, sep="\t", header=True, schema="barcode string, id string", enforceSchema=True)
    up = F.upper(F.trim("barcode"))
    ok = F.when(up.rlike("^[ACGTN]+$"), up).otherwise(F.raise_error(F.concat(F.lit("not a barcode: "), up)))
    return raw.where("trim(barcode) <> ''").select(ok.alias("barcode"), F.expr("try_cast(trim(id) AS INT)").alias("slice_id"))


def query_sequences(spark: SparkSession, given: list[str], listed: DataFrame | None = None) -> DataFrame:
    """Distinct upper-cased sequences from a list and a barcode table; what isn't of ACGTN is left out of the list."""
    one = spark.createDataFrame([(s,) for s in given], "seq string").select(F.upper(F.trim("seq")).alias("seq")).where(F.col("seq").rlike("^[ACGTN]+$"))
    return (one.unionByName(listed.select(F.col("barcode").alias("seq"))) if listed is not None else one).distinct()


def read_dictionary(spark: SparkSession, path: str, one_line: bool = True) -> DataFrame:
    """(barcode, variant) of JSON objects of barcode -> list of variants, one on each line; one_line=False: one in each file."""
    raw = spark.read.text(path, wholetext=not one_line)
    return raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("barcode", "variants")).select("barcode", F.explode("variants").alias("variant"))


def write_dictionary(variants: DataFrame, path: str) -> None:
    """One JSON object {barcode: [variants]} a line and barcode; a ball's size bounds the list."""
    lists = variants.groupBy("barcode").agg(F.sort_array(F.collect_list("variant")).alias("variants"))
    lists.select(F.to_json(F.create_map("barcode", "variants")).alias("value")).write.mode("errorifexists").text(path)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """(seqname, type, start, end, strand, gene_id, transcript_id) of a GTF file; comment lines are skipped."""
    cols = "seqname string, source string, type string, start bigint, end bigint, score string, strand string, frame string, attributes string"
    raw = spark.read.csv(path, sep="\t", comment="#", schema=cols, quote="")

    def attribute(name: str):
        return F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{name} "?([^";]+)', 1), F.lit(""))

    return raw.select("seqname", "type", "start", "end", "strand", attribute("gene_id").alias("gene_id"), attribute("transcript_id").alias("transcript_id"))


def read_quant(spark: SparkSession, path: str, suffix: str = "_Salmon_quant.sf") -> DataFrame:
    """(sample, name, length, effective_length, tpm, num_reads) of all quantification files under a folder; sample is the file's name without its suffix."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sf").csv(path, sep="\t", header=True, schema="name string, length double, effective_length double, tpm double, num_reads double")
    return raw.select(F.replace(F.col("_metadata.file_name"), F.lit(suffix), F.lit("")).alias("sample"), "*")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated matrix whose first column names the rows; that column becomes gene_id, cells double."""
    raw = spark.read.csv(path, sep="\t", header=True)
    first, *rest = raw.columns
    return raw.select(F.col(f"`{first}`").alias("gene_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest])


def read_positional(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A headerless tab-separated file with columns V1, V2, ..."""
    return spark.read.csv(path, sep="\t", header=False, schema=", ".join(f"V{i} string" for i in range(1, columns + 1)))


def read_sheet(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A small spreadsheet, with its row order as ``ordinal``; .csv files need no further library."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True).withColumn("ordinal", F.monotonically_increasing_id())
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise RuntimeError("reading .xlsx needs openpyxl; save the sheet as .csv") from e
    frame = pd.read_excel(path, sheet_name=sheet, dtype=str)
    return spark.createDataFrame(frame.assign(ordinal=range(len(frame))))


def write_matrix(matrix: DataFrame, path: str) -> None:
    """A wide table as tab-separated text with a header."""
    matrix.write.mode("errorifexists").option("header", "true").csv(path, sep="\t")


def demux_log(summary: DataFrame) -> DataFrame:
    """A demultiplexing summary as the lines of its log: barcode with slice, count with thousands separators, percent."""
    label = F.concat("barcode", F.lit(" ("), F.coalesce(F.col("slice_id").cast("string"), F.lit("-")), F.lit(")"))
    return summary.orderBy(F.desc("read_count"), "barcode").select(F.concat_ws("\t", label, F.format_number("read_count", 0), F.format_string("%.1f%%", "pct")).alias("value"))


def paired_by_sample(files: DataFrame, name: str = "file_name", mate: str = "mate") -> DataFrame:
    """(sample, r1, r2): samples with exactly one R1 and one R2 file; others raise an error naming the sample."""
    f = files.withColumn("_sample", sample_from_name(F.col(name)))
    per = f.groupBy("_sample").agg(F.count_if(F.col(mate) == "R1").alias("a"), F.count_if(F.col(mate) == "R2").alias("b"), F.min(F.when(F.col(mate) == "R1", F.col(name))).alias("r1"), F.min(F.when(F.col(mate) == "R2", F.col(name))).alias("r2"))
    fine = F.when((F.col("a") == 1) & (F.col("b") == 1), F.col("_sample")).otherwise(F.raise_error(F.concat(F.lit("no single pair for sample "), F.coalesce("_sample", F.lit("NULL")))))
    return per.select(fine.alias("sample"), "r1", "r2")
