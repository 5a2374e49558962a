"""Queries that write the tables to files of every kind, read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.functions import names
from slicelake.operators import barcodes as B
from slicelake.operators import counts as C
from slicelake.plans import pipelines
from slicelake.plans.counts import GROUPS, PART_HEADERS, SIZE_FACTORS, library_counts, part_headers
from slicelake.plans.counts import SQL as COUNT_SQL
from slicelake.plans.reads import SQL as READ_SQL
from slicelake.plans.reads import demux_summary, match_totals
from slicelake.session import run_folder, table
from slicelake.sources import fasta, fastq, tabular

FOUR = ("header_line", "seq_line", "plus_line", "qual_line")


def _tagged(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Reads whose header bears the tag and whose lines are all there."""
    return table(spark, d, name).where(F.col("header_line").startswith("@NS") & F.col("seq_line").isNotNull() & F.col("plus_line").isNotNull() & F.col("qual_line").isNotNull())


def _written(spark: SparkSession, reads: DataFrame, compression: str) -> str:
    path = run_folder(spark, "fastq")
    fastq.write_fastq(reads, path, compression)
    return path


def fastq_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records of FASTQ files written from the reads, with how often each header and sequence comes."""
    back = fastq.read_fastq(spark, _written(spark, _tagged(spark, d, "r2_reads"), "gzip"))
    return back.groupBy("header_line", "seq_line").agg(F.count(F.lit(1)).alias("records"))


def fastq_plain_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Bases and qualities of uncompressed files, read over input splits."""
    back = fastq.read_fastq(spark, _written(spark, _tagged(spark, d, "r1_reads"), "none"), exact_heads=True)
    return back.groupBy("plus_line").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("seq_line")).alias("bases"), F.sum(F.length("qual_line")).alias("qualities"))


def integrity_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Error histogram of files, as the validator gives it; malformed records go to a folder."""
    path = _written(spark, _tagged(spark, d, "r1_reads"), "none")
    return pipelines.integrity_check(spark, path, malformed_path=run_folder(spark, "malformed"))


def quarantined(spark: SparkSession, d: str) -> DataFrame:
    """Malformed reads in the quarantine folder, with their error."""
    path = run_folder(spark, "quarantine")
    fastq.quarantine(table(spark, d, "r1_reads"), path)
    return spark.read.parquet(path).select("read_id", "error")


def split_sink(spark: SparkSession, d: str) -> DataFrame:
    """Records in the two folders of the split by a listed barcode."""
    reads = _tagged(spark, d, "r1_reads")
    listed = B.barcode_list(table(spark, d, "barcodes")).select(F.col("barcode").alias("seq_line"), F.lit(True).alias("matched"))
    path = run_folder(spark, "split")
    fastq.write_split(reads.join(listed, "seq_line", "left").withColumn("matched", F.coalesce("matched", F.lit(False))), path)
    return fastq.records_by(spark, path, "matched boolean")


def barcode_sink(spark: SparkSession, d: str) -> DataFrame:
    """Records in the folder of each slice and barcode."""
    path = run_folder(spark, "barcodes")
    fastq.write_by_barcode(B.demux_r1(_tagged(spark, d, "r1_reads"), B.barcode_list(table(spark, d, "barcodes"))), path)
    return fastq.records_by(spark, path, "slice_id int, barcode string")


def barcode_file(spark: SparkSession, d: str) -> DataFrame:
    """The barcode list through its tab-separated file."""
    path = run_folder(spark, "list")
    tabular.write_matrix(table(spark, d, "barcodes").where("barcode IS NOT NULL").select("barcode", "tomoseq_slicenumber"), path)
    return tabular.read_barcodes(spark, path)


def query_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences to look for, given by name and from the list."""
    return tabular.query_sequences(spark, ["acgtn", "ACGTN", "no bases", " ttt "], barcode_file(spark, d))


def dictionary_file(spark: SparkSession, d: str) -> DataFrame:
    """The unambiguous variants through their JSON file."""
    path = run_folder(spark, "dictionary")
    tabular.write_dictionary(B.unambiguous_variants(B.barcode_list(table(spark, d, "barcodes"))), path)
    return tabular.read_dictionary(spark, path)


def matrix_file(spark: SparkSession, d: str) -> DataFrame:
    """The wide count matrix through its tab-separated file, back in long form; cells without counts are left out."""
    counts = C.latest(table(spark, d, "counts")).withColumn("grp", F.concat("species", F.lit("_"), "condition"))
    path = run_folder(spark, "matrix")
    tabular.write_matrix(C.wide(counts, GROUPS, "grp"), path)
    return C.long(tabular.read_matrix(spark, path), "grp").where("count IS NOT NULL").select("gene_id", "grp", F.round("count", 6).alias("count"))


def native_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and genes of the Parquet tables of a normalization."""
    out = run_folder(spark, "native")
    pipelines.normalization_tables(library_counts(spark, d).select("gene_id", "sample", "count"), out, 2, 6)
    rows = [spark.read.parquet(f"{out}/{name}").groupBy(F.lit(name).alias("table")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys")) for name, key in (("unfiltered", "gene_id"), ("filtered", "gene_id"), ("size_factors", "sample"), ("normalized", "gene_id"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def positional_file(spark: SparkSession, d: str) -> DataFrame:
    """A headerless table: symbols and names of gene sets by position."""
    path = run_folder(spark, "positional")
    table(spark, d, "part").select(F.col("p_partkey").cast("string"), "p_brand", "p_type").write.csv(path, sep="\t")
    return tabular.read_positional(spark, path, 3).select(F.col("V2").alias("symbol"), F.col("V3").alias("name")).groupBy("symbol", "name").agg(F.count(F.lit(1)).alias("n"))


def annotation_file(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts and genes through a GTF file."""
    path = run_folder(spark, "gtf")
    k = F.col("p_partkey")
    line = F.concat_ws("\t", F.lit("chr1"), F.lit("src"), F.when(k % 3 == 0, "gene").otherwise("transcript"), k, k + F.col("p_size"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit('gene_id "'), F.col("p_brand"), F.lit('"; '), F.when(k % 3 != 0, F.concat(F.lit('transcript_id "T'), k, F.lit('.1"; '))).otherwise(""), F.lit('note "x";')))
    table(spark, d, "part").select(F.when(k % 50 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value")).write.text(path)
    return tabular.read_gtf(spark, path).select("type", "start", "end", "gene_id", "transcript_id")


def _fasta(spark: SparkSession, d: str) -> str:
    path = run_folder(spark, "fasta")
    seq = F.repeat(F.get(F.split("p_name", " "), F.lit(1)), F.col("p_size"))
    rows = part_headers(spark, d).join(table(spark, d, "part").select("p_partkey", seq.alias("seq")), "p_partkey").where("p_partkey % 5 < 3")
    rows.select(F.concat(F.lit(">"), "header", F.lit("\n"), F.substring("seq", 1, 30), F.lit("\n"), F.substring("seq", 31, 10_000)).alias("value")).write.text(path)
    return path


def fasta_file(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a FASTA file: name, gene and length."""
    entries = fasta.with_gene(fasta.read_fasta(spark, _fasta(spark, d)))
    return entries.select(names.first_token(F.col("header")).alias("name"), "gene", "seq_len")


def decoy_list(spark: SparkSession, d: str) -> DataFrame:
    return fasta.decoy_names(fasta.read_fasta(spark, _fasta(spark, d)))


def primary_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Longest sequence of each gene, written and read back: how many entries of which length."""
    out = run_folder(spark, "primary")
    pipelines.primary_transcript_file(spark, _fasta(spark, d), out)
    return fasta.read_fasta(spark, out).groupBy("seq_len").agg(F.count(F.lit(1)).alias("entries"))


def tag_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent ids of each tag of the headers."""
    return fasta.tag_statistics(part_headers(spark, d))


def sequences_per_gene(spark: SparkSession, d: str) -> DataFrame:
    return fasta.sequences_per_gene(part_headers(spark, d).withColumn("gene", names.ensembl_gene(F.col("header"))))


def demux_log(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the demultiplexing log."""
    return tabular.demux_log(demux_summary(spark, d))


def repair_conserves(spark: SparkSession, d: str) -> DataFrame:
    """Reads into the repair and out of it: matched, repaired and unassigned add up."""
    total = table(spark, d, "r1_reads").agg(F.count(F.lit(1)).alias("n"))
    return match_totals(spark, d).agg(F.sum("records").alias("out"), F.sum(F.col("matched") + F.col("repaired") + F.col("unassigned")).alias("parts")).select(total.scalar().alias("into"), "out", "parts")


_ALL = (fastq_round_trip, fastq_plain_round_trip, integrity_of_files, quarantined, split_sink, barcode_sink, barcode_file, query_sequences, dictionary_file, matrix_file, native_tables, positional_file, annotation_file, fasta_file, decoy_list, primary_transcripts, tag_statistics, sequences_per_gene, demux_log, repair_conserves)
QUERIES = {f.__name__: f for f in _ALL}

_OK = "starts_with(header_line, '@NS') AND seq_line IS NOT NULL AND plus_line IS NOT NULL AND qual_line IS NOT NULL"
_ERR = READ_SQL["record_validate"].removeprefix("SELECT read_id, ").removesuffix(" AS error FROM r2_reads")
_B = "b AS (SELECT upper(trim(barcode)) AS barcode, min(slice_id) AS slice_id FROM barcodes WHERE barcode IS NOT NULL GROUP BY 1)"
_F = PART_HEADERS + """, e AS (SELECT p_partkey, string_split(header, ' ')[1] AS id, CASE WHEN p_partkey % 5 < 2 THEN name END AS gene, length(string_split(p_name, ' ')[2]) * p_size AS seq_len FROM h JOIN part USING (p_partkey) WHERE p_partkey % 5 < 3)"""
SQL = {
    "fastq_round_trip": f"SELECT rtrim(header_line, chr(13)) AS header_line, rtrim(seq_line, chr(13)) AS seq_line, count(*) AS records FROM r2_reads WHERE {_OK} GROUP BY 1, 2",
    "fastq_plain_round_trip": f"SELECT rtrim(plus_line, chr(13)) AS plus_line, count(*) AS records, sum(length(rtrim(seq_line, chr(13)))) AS bases, sum(length(rtrim(qual_line, chr(13)))) AS qualities FROM r1_reads WHERE {_OK} GROUP BY 1",
    "integrity_of_files": f"WITH r AS (SELECT rtrim(header_line, chr(13)) AS header_line, rtrim(seq_line, chr(13)) AS seq_line, rtrim(plus_line, chr(13)) AS plus_line, rtrim(qual_line, chr(13)) AS qual_line FROM r1_reads WHERE {_OK}) SELECT coalesce({_ERR}, 'valid') AS error, count(*) AS records FROM r GROUP BY 1",
    "quarantined": f"SELECT read_id, {_ERR} AS error FROM r1_reads WHERE ({_ERR}) IS NOT NULL",
    "split_sink": f"WITH {_B} SELECT seq_line IN (SELECT barcode FROM b) AS matched, count(*) AS records FROM r1_reads WHERE {_OK} GROUP BY 1",
    "barcode_sink": f"WITH {_B} SELECT b.slice_id, b.barcode, count(*) AS records FROM r1_reads JOIN b ON seq_line = b.barcode WHERE {_OK} GROUP BY 1, 2",
    "barcode_file": "SELECT upper(trim(barcode)) AS barcode, TRY_CAST(trim(tomoseq_slicenumber) AS INT) AS slice_id FROM barcodes WHERE barcode IS NOT NULL",
    "query_sequences": "SELECT DISTINCT upper(trim(barcode)) AS seq FROM barcodes WHERE barcode IS NOT NULL UNION SELECT 'ACGTN' UNION SELECT 'TTT'",
    "dictionary_file": READ_SQL["barcode_dictionary_d1"].replace("SELECT min(barcode) AS barcode, variant, cast(min(hamming(barcode, variant)) AS INT) AS distance", "SELECT min(barcode) AS barcode, variant"),
    "matrix_file": f"SELECT * FROM ({COUNT_SQL['count_matrix_long']}) WHERE count IS NOT NULL",
    "native_tables": f"""WITH {SIZE_FACTORS} SELECT 'unfiltered' AS "table", count(*) AS rows, count(DISTINCT gene_id) AS keys FROM lib UNION ALL SELECT 'filtered', count(*), count(DISTINCT gene_id) FROM e
UNION ALL SELECT 'size_factors', count(*), count(DISTINCT sample) FROM sf UNION ALL SELECT 'normalized', count(*), count(DISTINCT gene_id) FROM lib JOIN sf USING (sample)""",
    "positional_file": "SELECT p_brand AS symbol, p_type AS name, count(*) AS n FROM part GROUP BY 1, 2",
    "annotation_file": """SELECT CASE WHEN p_partkey % 3 = 0 THEN 'gene' ELSE 'transcript' END AS type, p_partkey AS start, p_partkey + p_size AS "end", p_brand AS gene_id, CASE WHEN p_partkey % 3 <> 0 THEN 'T' || p_partkey || '.1' END AS transcript_id FROM part WHERE p_partkey % 50 <> 0""",
    "fasta_file": f"WITH {_F} SELECT id AS name, gene, seq_len FROM e",
    "decoy_list": f"WITH {_F} SELECT id AS name FROM e",
    "primary_transcripts": f"WITH {_F}, m AS (SELECT max(seq_len) AS seq_len FROM e WHERE gene IS NOT NULL GROUP BY gene UNION ALL SELECT seq_len FROM e WHERE gene IS NULL) SELECT seq_len, count(*) AS entries FROM m GROUP BY 1",
    "tag_statistics": f"WITH {PART_HEADERS}, t AS (SELECT unnest(list_filter(string_split(header, ' '), lambda x: contains(x, ':'))) AS token FROM h), c AS (SELECT split_part(token, ':', 1) AS tag, substr(token, strpos(token, ':') + 1) AS id, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, id) AS rank FROM c) SELECT * FROM r WHERE rank <= 5",
    "sequences_per_gene": f"WITH {PART_HEADERS} SELECT count(*) AS sequences, count(DISTINCT name) FILTER (WHERE p_partkey % 5 < 2) + 1 AS genes FROM h",
    "demux_log": "SELECT barcode || ' (' || coalesce(cast(slice_id AS VARCHAR), '-') || ')' || chr(9) || format('{:,}', read_count) || chr(9) || printf('%.1f', pct) || '%' AS value FROM (" + READ_SQL["demux_summary"] + ")",
    "repair_conserves": "SELECT count(*) AS into, count(*) AS out, count(*) AS parts FROM r1_reads",
}
