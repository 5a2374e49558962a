"""Queries over reads, barcodes and files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.functions import names
from slicelake.functions import reads as R
from slicelake.functions.materialize import computed
from slicelake.operators import barcodes as B
from slicelake.operators.trim import trim_and_filter
from slicelake.session import table
from slicelake.sources import fastq


def _c(*names_: str):
    return [F.col(n) for n in names_]


FOUR = ("header_line", "seq_line", "plus_line", "qual_line")


def record_validate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "r2_reads").select("read_id", R.record_error(*_c(*FOUR)).alias("error"))


def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return record_validate(spark, d).groupBy(F.coalesce("error", F.lit("valid")).alias("error")).agg(F.count(F.lit(1)).alias("records"))


def malformed_records(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "r1_reads")
    return r.withColumn("error", R.record_error(*_c(*FOUR))).where("error IS NOT NULL").select("read_id", "error", *FOUR)


def read_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "r2_reads").select("read_id", R.packed_read_key(F.col("header_line")).alias("read_key"))


def header_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "r2_reads").select(R.header_token(F.col("header_line"), 3).alias("flowcell")).distinct()


def record_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records whose header bears the tag, per sample; others are skipped."""
    r = table(spark, d, "r2_reads").where(F.col("header_line").startswith("@N"))
    return r.groupBy("sample_id").agg(F.count(F.lit(1)).alias("records"))


def subsequence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "r2_reads").select("read_id", R.subsequence(F.col("seq_line"), 1, 8).alias("seq"), R.subsequence(F.col("qual_line"), 1, 8).alias("qual"))


def quality_filter_r1(spark: SparkSession, d: str) -> DataFrame:
    r = computed(table(spark, d, "r1_reads").where(F.length("seq_line") == 8), q=R.phred(F.col("qual_line")))
    return r.where(R.passes_quality(F.col("seq_line"), F.col("q"), 1)).select("read_id", "seq_line")


def quality_trim_r2(spark: SparkSession, d: str) -> DataFrame:
    return trim_and_filter(table(spark, d, "r2_reads"))


def barcode_ball_d1(spark: SparkSession, d: str) -> DataFrame:
    return B.hamming_ball(B.barcode_list(table(spark, d, "barcodes")), 1)


def barcode_ball_n(spark: SparkSession, d: str) -> DataFrame:
    return B.hamming_ball(B.barcode_list(table(spark, d, "barcodes")), 0)


def barcode_dictionary_d1(spark: SparkSession, d: str) -> DataFrame:
    return B.unambiguous_variants(B.barcode_list(table(spark, d, "barcodes")), 1)


def barcode_dictionary_d2(spark: SparkSession, d: str) -> DataFrame:
    return B.unambiguous_variants(B.barcode_list(table(spark, d, "barcodes")), 2).groupBy("barcode").agg(F.count(F.lit(1)).alias("variants"), F.max((F.col("distance") == 0).cast("int")).alias("keeps_itself"))


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    return B.repair(table(spark, d, "r1_reads"), B.barcode_list(table(spark, d, "barcodes")))


def barcode_exact_split(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "r1_reads")
    listed = B.barcode_list(table(spark, d, "barcodes")).select(F.col("barcode").alias("seq_line"))
    hit = r.join(listed, "seq_line", "left_semi").select("read_id", F.lit(True).alias("matched"))
    return hit.unionByName(r.join(listed, "seq_line", "left_anti").select("read_id", F.lit(False).alias("matched")))


def barcode_correct(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("read_id", "exact", "corrected")


def seq_replace(spark: SparkSession, d: str) -> DataFrame:
    """Repairable reads rewritten to their barcode, quality all I; the others stay."""
    r = _repaired(spark, d)
    seq, qual = B.replaced(F.col("corrected").isNotNull() & ~F.col("exact"), F.col("corrected"), F.col("seq_line"), F.col("qual_line"))
    return r.select("read_id", seq.alias("seq"), qual.alias("qual"))


def match_totals(spark: SparkSession, d: str) -> DataFrame:
    r = _repaired(spark, d)
    return r.groupBy("sample_id").agg(F.count_if("exact").alias("matched"), F.count_if(~F.col("exact") & F.col("corrected").isNotNull()).alias("repaired"), F.count_if(F.col("corrected").isNull()).alias("unassigned"), F.count(F.lit(1)).alias("records"))


def demux_r1(spark: SparkSession, d: str) -> DataFrame:
    return B.demux_r1(table(spark, d, "r1_reads"), B.barcode_list(table(spark, d, "barcodes"))).select("read_id", "barcode", "slice_id")


def demux_r2(spark: SparkSession, d: str) -> DataFrame:
    return B.demux_r2(table(spark, d, "r2_reads"), _repaired(spark, d)).select("read_id", "barcode")


def demux_summary(spark: SparkSession, d: str) -> DataFrame:
    listed = B.barcode_list(table(spark, d, "barcodes"))
    total = table(spark, d, "r2_reads").agg(F.count(F.lit(1)).alias("n"))
    return B.demux_summary(B.demux_r2(table(spark, d, "r2_reads"), _repaired(spark, d)), listed, total)


def key_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the build side of the R2 join that several R1 reads bear."""
    k = table(spark, d, "r1_reads").select("sample_id", R.packed_read_key(F.col("header_line")).alias("read_key")).where("read_key IS NOT NULL")
    return k.groupBy("sample_id", "read_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def file_name_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("file_name")
    return table(spark, d, "fastq_files").select("file_id", names.file_barcode(n).alias("barcode"), names.file_slice_id(n).alias("slice_id"), names.sample_from_name(n).alias("part"), names.sanitized(n).alias("safe_name"), names.file_barcode_any(n).alias("any_barcode"), names.short_path(F.concat_ws("/", F.lit("data"), F.lit("runs"), F.coalesce("sample_id", F.lit("none")), n)).alias("short_path"))


def pair_files(spark: SparkSession, d: str) -> DataFrame:
    """For each sample and barcode the file, if it is the only one, with the number the list gives the barcode."""
    f = file_name_parse(spark, d).join(table(spark, d, "fastq_files").select("file_id", "sample_id"), "file_id")
    one = f.groupBy("sample_id", "barcode").agg(F.count(F.lit(1)).alias("files"), F.min("file_id").alias("file_id"), F.min("slice_id").alias("named")).where("files = 1")
    return one.join(B.barcode_list(table(spark, d, "barcodes")), "barcode").select("sample_id", "barcode", "file_id", "named", "slice_id")


def file_validation(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each file by its name and length."""
    f = table(spark, d, "fastq_files")
    return f.select("file_id", fastq.file_error(F.col("file_name"), F.col("n_bytes")).alias("error"))


def _file_lines(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, line_no, byte_start, line): lines end with LF; a last empty line is none. Carriage returns stay."""
    from pyspark.sql import Window

    f = table(spark, d, "fastq_files").where("content <> ''").select("file_id", F.posexplode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("line_no", "line"))
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return f.withColumn("byte_start", F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0)))


def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    """Records and cut-off tails of each file, four lines a record."""
    lines = _file_lines(spark, d).select("file_id", "line_no")
    return lines.groupBy("file_id").agg(F.floor(F.count(F.lit(1)) / 4).alias("records"), (F.count(F.lit(1)) % 4).alias("tail_lines"))


def chunk_record_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records of each planned byte range: those whose first byte lies in it, whatever the cut. NULL ends run to the file's end."""
    from pyspark.sql import Window

    starts = _file_lines(spark, d).where("line_no % 4 = 0").select("file_id", F.col("byte_start").alias("at"), F.lit(1).alias("n"))
    plan = table(spark, d, "chunk_plan").distinct()
    # a running count over record starts and cuts in one order, instead of records times ranges
    cuts = plan.select("file_id", F.explode(F.array("chunk_start", "chunk_end")).alias("at")).where("at IS NOT NULL").distinct()
    w = Window.partitionBy("file_id").orderBy("at", "n")  # at one place a cut comes before the record
    ranked = cuts.withColumn("n", F.lit(0)).unionByName(starts).withColumn("before", F.sum("n").over(w)).where("n = 0").select("file_id", "at", "before")
    whole = starts.groupBy("file_id").agg(F.sum("n").alias("whole"))
    low = ranked.select("file_id", F.col("at").alias("chunk_start"), F.col("before").alias("low"))
    high = ranked.select("file_id", F.col("at").alias("chunk_end"), F.col("before").alias("high"))
    out = plan.join(low, ["file_id", "chunk_start"], "left").join(high, ["file_id", "chunk_end"], "left").join(whole, "file_id", "left")
    end = F.when(F.col("chunk_end").isNull(), F.col("whole")).otherwise(F.col("high"))
    return out.select("file_id", "worker_id", "chunk_start", "chunk_end", F.greatest(F.lit(0), F.coalesce(end - F.col("low"), F.lit(0))).alias("records"))


QUERIES = {f.__name__: f for f in (record_validate, error_histogram, malformed_records, read_keys, header_tokens, record_counts, subsequence, quality_filter_r1, quality_trim_r2, barcode_ball_d1, barcode_ball_n, barcode_dictionary_d1, barcode_dictionary_d2, barcode_exact_split, barcode_correct, seq_replace, match_totals, demux_r1, demux_r2, demux_summary, key_duplicates, file_name_parse, pair_files, file_validation, fastq_records, chunk_record_counts)}

_ERR = """CASE WHEN header_line IS NULL OR seq_line IS NULL OR plus_line IS NULL OR qual_line IS NULL THEN 'incomplete record'
 WHEN NOT starts_with(header_line, '@NS') THEN 'bad header' WHEN plus_line <> '+' THEN 'bad plus line'
 WHEN NOT regexp_full_match(seq_line, '[ACGTN]+') THEN 'bad sequence' WHEN length(seq_line) <> length(qual_line) THEN 'length mismatch' END"""


def _key_sql(src: str, cols: str) -> str:
    return rf"""h_{src} AS (SELECT {cols}, header_line, regexp_extract(replace(replace(split_part(header_line, ' ', 1), chr(13), ''), chr(10), ''), '(?s)^.*:([0-9]+:[0-9]+:[0-9]+:[0-9]+)$', 1) AS tail FROM {src}),
n_{src} AS (SELECT *, CASE WHEN tail = '' THEN NULL ELSE string_split(tail, ':') END AS f FROM h_{src}),
u_{src} AS (SELECT *, cast(cast(f[1] AS HUGEINT) % 4 AS HUGEINT) * 4611686018427387904 + (cast(f[2] AS HUGEINT) % 1048576) * 4398046511104 + (cast(f[3] AS HUGEINT) % 2097152) * 2097152 + cast(f[4] AS HUGEINT) % 2097152 AS u FROM n_{src}),
k_{src} AS (SELECT *, cast(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS read_key FROM u_{src})"""


_BALL = """b AS (SELECT upper(trim(barcode)) AS barcode, min(slice_id) AS slice_id FROM barcodes WHERE barcode IS NOT NULL GROUP BY 1),
l AS (SELECT unnest(['N','C','T','G','A']) AS letter), p AS (SELECT unnest(range(1, 9)) AS pos),
ball1 AS (SELECT DISTINCT barcode, substr(barcode, 1, pos - 1) || letter || substr(barcode, pos + 1) AS variant FROM b, p, l)"""
_FIX = f"""{_BALL}, keep AS (SELECT variant, min(barcode) AS barcode FROM ball1 GROUP BY variant HAVING count(*) = 1),
fixed AS (SELECT r.*, b.barcode IS NOT NULL AS exact, coalesce(b.barcode, keep.barcode) AS corrected FROM r1_reads r LEFT JOIN b ON r.seq_line = b.barcode LEFT JOIN keep ON r.seq_line = keep.variant)"""
_PHRED = "list_transform(list_filter(string_split(qual_line, ''), lambda c: c <> ''), lambda c: ascii(c) - 33)"
_DEMUX = f"""WITH {_FIX}, {_key_sql("r2_reads", "read_id, sample_id")}, {_key_sql("fixed", "sample_id, corrected")},
built AS (SELECT sample_id, read_key, min(corrected) AS barcode FROM k_fixed WHERE read_key IS NOT NULL AND corrected IS NOT NULL GROUP BY 1, 2),
d AS (SELECT read_id, barcode FROM k_r2_reads JOIN built USING (sample_id, read_key))"""
_LINES = r"""WITH x AS (SELECT file_id, string_split(regexp_replace(content, '\n\z', ''), chr(10)) AS a FROM fastq_files WHERE content <> ''),
y AS (SELECT file_id, unnest(a) AS line, unnest(range(len(a))) AS line_no FROM x),
z AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_start FROM y)"""

SQL = {
    "record_validate": f"SELECT read_id, {_ERR} AS error FROM r2_reads",
    "error_histogram": f"SELECT coalesce({_ERR}, 'valid') AS error, count(*) AS records FROM r2_reads GROUP BY 1",
    "malformed_records": f"SELECT read_id, {_ERR} AS error, header_line, seq_line, plus_line, qual_line FROM r1_reads WHERE ({_ERR}) IS NOT NULL",
    "read_keys": f"WITH {_key_sql('r2_reads', 'read_id')} SELECT read_id, read_key FROM k_r2_reads",
    "header_tokens": "SELECT DISTINCT string_split(header_line, ':')[3] AS flowcell FROM r2_reads",
    "record_counts": "SELECT sample_id, count(*) AS records FROM r2_reads WHERE starts_with(header_line, '@N') GROUP BY 1",
    "subsequence": "SELECT read_id, substr(seq_line, 1, 8) AS seq, substr(qual_line, 1, 8) AS qual FROM r2_reads",
    "quality_filter_r1": f"WITH q AS (SELECT *, {_PHRED} AS q FROM r1_reads WHERE length(seq_line) = 8) SELECT read_id, seq_line FROM q WHERE len(q) > 0 AND len(list_filter(q, lambda v: v < 20)) <= 0.25 * len(q) AND list_sum(q) >= 27 * len(q) AND length(seq_line) - length(replace(seq_line, 'N', '')) <= 1",
    "quality_trim_r2": f"""WITH q AS (SELECT *, {_PHRED} AS q FROM r2_reads WHERE length(seq_line) = length(qual_line)),
w AS (SELECT *, list_filter(range(1, len(q)), lambda i: q[i] + q[i + 1] >= 40) AS good FROM q),
t AS (SELECT *, good[1] AS a, good[-1] + 1 AS z FROM w WHERE len(good) > 0),
c AS (SELECT read_id, substr(seq_line, a, z - a + 1) AS seq, substr(qual_line, a, z - a + 1) AS qual, q[a:z] AS q FROM t WHERE z - a + 1 >= 20)
SELECT read_id, seq, qual FROM c WHERE len(list_filter(q, lambda v: v < 20)) <= 0.25 * len(q) AND list_sum(q) >= 27 * len(q) AND length(seq) - length(replace(seq, 'N', '')) <= 3""",
    "barcode_ball_d1": f"WITH {_BALL} SELECT barcode, variant, cast(hamming(barcode, variant) AS INT) AS distance FROM ball1",
    "barcode_ball_n": f"WITH {_BALL} SELECT DISTINCT barcode, variant, cast(hamming(barcode, variant) AS INT) AS distance FROM (SELECT barcode, barcode AS variant FROM b UNION ALL SELECT barcode, substr(barcode, 1, pos - 1) || 'N' || substr(barcode, pos + 1) FROM b, p)",
    "barcode_dictionary_d1": f"WITH {_BALL} SELECT min(barcode) AS barcode, variant, cast(min(hamming(barcode, variant)) AS INT) AS distance FROM ball1 GROUP BY variant HAVING count(*) = 1",
    "barcode_dictionary_d2": f"WITH {_BALL}, ball2 AS (SELECT DISTINCT barcode, substr(variant, 1, pos - 1) || letter || substr(variant, pos + 1) AS variant FROM ball1, p, l), keep AS (SELECT min(barcode) AS barcode, variant FROM ball2 GROUP BY variant HAVING count(*) = 1) SELECT barcode, count(*) AS variants, max(cast(barcode = variant AS INT)) AS keeps_itself FROM keep GROUP BY 1",
    "barcode_exact_split": f"WITH {_BALL} SELECT read_id, seq_line IS NOT NULL AND seq_line IN (SELECT barcode FROM b) AS matched FROM r1_reads",
    "barcode_correct": f"WITH {_FIX} SELECT read_id, exact, corrected FROM fixed",
    "seq_replace": f"WITH {_FIX} SELECT read_id, CASE WHEN corrected IS NOT NULL AND NOT exact THEN corrected ELSE seq_line END AS seq, CASE WHEN corrected IS NOT NULL AND NOT exact THEN repeat('I', length(corrected)) ELSE qual_line END AS qual FROM fixed",
    "match_totals": f"WITH {_FIX} SELECT sample_id, count_if(exact) AS matched, count_if(NOT exact AND corrected IS NOT NULL) AS repaired, count_if(corrected IS NULL) AS unassigned, count(*) AS records FROM fixed GROUP BY 1",
    "demux_r1": f"WITH {_BALL} SELECT read_id, b.barcode, b.slice_id FROM r1_reads JOIN b ON seq_line = b.barcode",
    "demux_r2": _DEMUX + " SELECT * FROM d",
    "demux_summary": _DEMUX + " SELECT d.barcode, b.slice_id, count(*) AS read_count, round(count(*) * 100.0 / (SELECT count(*) FROM r2_reads), 1) AS pct FROM d LEFT JOIN b ON d.barcode = b.barcode GROUP BY 1, 2",
    "key_duplicates": f"WITH {_key_sql('r1_reads', 'sample_id')} SELECT sample_id, read_key, count(*) AS n FROM k_r1_reads WHERE read_key IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "file_name_parse": r"""WITH s AS (SELECT *, regexp_replace(file_name, '\.[^.]*$', '') AS stem FROM fastq_files)
SELECT file_id, coalesce(nullif(regexp_extract(stem, '^([ACGT]{8})_', 1), ''), nullif(regexp_extract(stem, '_([ACGT]{8})_', 1), ''), nullif(regexp_extract(stem, '_([ACGT]{8})$', 1), '')) AS barcode,
TRY_CAST(nullif(regexp_extract(file_name, 'bcode_(\d+)', 1), '') AS INT) AS slice_id, string_split(split_part(file_name, '.', 1), '_')[2] AS part,
regexp_replace(regexp_replace(file_name, '\s', '_', 'g'), '[-.]+', '_', 'g') AS safe_name, coalesce(nullif(regexp_extract(file_name, '^([ACGTN]+)_', 1), ''), nullif(regexp_extract(file_name, '_([ACGTN]+)_', 1), '')) AS any_barcode, 'runs/' || coalesce(sample_id, 'none') || '/' || file_name AS short_path FROM s""",
    "pair_files": rf"WITH {_BALL}, s AS (SELECT file_id, sample_id, regexp_extract(file_name, '_([ACGT]{{8}})_', 1) AS barcode, TRY_CAST(regexp_extract(file_name, 'bcode_(\d+)', 1) AS INT) AS named FROM fastq_files), o AS (SELECT sample_id, barcode, min(file_id) AS file_id, min(named) AS named FROM s GROUP BY 1, 2 HAVING count(*) = 1) SELECT sample_id, o.barcode, file_id, named, slice_id FROM o JOIN b USING (barcode)",
    "file_validation": "SELECT file_id, CASE WHEN n_bytes IS NULL THEN 'not found' WHEN n_bytes <= 0 THEN 'empty' WHEN NOT coalesce(regexp_matches(file_name, '[.](fastq|fq)([.](gz|zst))?$'), false) THEN 'unknown suffix' END AS error FROM fastq_files",
    "fastq_records": _LINES + " SELECT file_id, count(*) // 4 AS records, count(*) % 4 AS tail_lines FROM z GROUP BY 1",
    "chunk_record_counts": _LINES + ", c AS (SELECT DISTINCT * FROM chunk_plan), s AS (SELECT file_id, byte_start FROM z WHERE line_no % 4 = 0) SELECT c.file_id, worker_id, chunk_start, chunk_end, count(*) FILTER (WHERE byte_start >= chunk_start AND (chunk_end IS NULL OR byte_start < chunk_end)) AS records FROM c LEFT JOIN s USING (file_id) GROUP BY ALL",
}
