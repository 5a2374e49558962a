"""Queries of the general numbered problems (2 and 3), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.operators import rejects, tree_agg
from slicelake.session import cut, table

SHARE = 0.05


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected_rows(table(spark, sf_dir, "r2_raw")).select("raw_id", "reason")


def p2_valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rejects.valid_records(table(spark, sf_dir, "r2_raw"))
    return rows.withColumn("record_no", F.coalesce(F.col("record_no").cast("string"), "record_no_long")).select("raw_id", *rejects.FIELDS)


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rejects.classify(table(spark, sf_dir, "r2_raw"))
    return rows.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_agg.read_states(table(spark, sf_dir, "r2_reads"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = cut(_states(spark, sf_dir))  # a row a barcode, used four times
    total = states.agg(F.coalesce(F.sum("reads"), F.lit(0)).alias("total"))  # reads without a key have a state too
    slices = tree_agg.by_slice(states, table(spark, sf_dir, "barcodes"))
    return tree_agg.heavy_keys(states, "barcode_key", "key", total, SHARE).unionByName(tree_agg.heavy_keys(slices, "slice_id", "slice_id", total, SHARE))


def p3_barcode_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_agg.with_means(_states(spark, sf_dir)).withColumnRenamed("key", "barcode")


def p3_slice_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_agg.with_means(tree_agg.by_slice(_states(spark, sf_dir), table(spark, sf_dir, "barcodes")))


QUERIES = {f.__name__: f for f in (p2_found, p2_valid_records, p2_reasons, p3_found, p3_barcode_results, p3_slice_results)}

_F = r"""(?:[^",]*|"(?:[^"]|"")*")"""
_P2 = rf"""
WITH a AS (SELECT raw_id, regexp_replace(raw_line, '\r\z', '') AS line FROM r2_raw),
b AS (SELECT *, CASE WHEN line IS NULL OR line = '' THEN NULL ELSE regexp_full_match(line, '(?s){_F}(?:,{_F})*') END AS split_ok,
  regexp_replace(line, '(?s)"(?:[^"]|"")*"', 'q', 'g') AS bare FROM a),
c AS (SELECT *, length(bare) - length(replace(bare, ',', '')) + 1 AS n,
  regexp_extract_all(line || ',', '(?s)({_F}),', 1) AS raw_fields FROM b),
d AS (SELECT *, list_transform(raw_fields, lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM c),
e AS (SELECT raw_id, CASE
  WHEN NOT split_ok THEN 'quoting'
  WHEN split_ok IS NULL OR n <> 5 THEN 'column_count'
  WHEN NOT regexp_full_match(f[1], '0*[1-9][0-9]*') THEN 'record_no'
  WHEN NOT regexp_matches(f[2], '^@[^ :]*:[^ :]*:[^ :]*:[0-9]+:[0-9]+:[0-9]+:[0-9]+(?: |\z)') THEN 'header_line'
  WHEN NOT regexp_full_match(f[3], '[ACGTN]+') THEN 'seq_line'
  WHEN f[4] <> '+' THEN 'plus_line'
  WHEN length(f[5]) <> length(f[3]) OR NOT regexp_full_match(f[5], '[!-~]+') THEN 'qual_line' END AS reason, f FROM d)
"""
_P3 = r"""
WITH t AS (SELECT upper(regexp_replace(barcode_key, '^\s+|\s+$', '', 'g')) AS key, length(seq_line) AS len,
  list_sum(list_transform(string_split(coalesce(qual_line, ''), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ascii(c) - 33 END)) AS q, coalesce(length(qual_line), 0) AS qc FROM r2_reads)
"""
_STATE = "count(*) AS reads, coalesce(sum(len), 0) AS bases, coalesce(sum(q), 0) AS qual_sum, sum(qc) AS qual_chars, min(len) AS min_len, max(len) AS max_len"
_MEANS = "round(CASE WHEN reads = 0 THEN NULL ELSE bases / reads END, 6) AS mean_len, round(CASE WHEN qual_chars = 0 THEN NULL ELSE qual_sum / qual_chars END, 6) AS mean_qual"

SQL = {
    "p2_found": _P2 + "SELECT raw_id, reason FROM e WHERE reason IS NOT NULL",
    "p2_valid_records": _P2 + "SELECT raw_id, ltrim(f[1], '0') AS record_no, f[2] AS header_line, f[3] AS seq_line, f[4] AS plus_line, f[5] AS qual_line FROM e WHERE reason IS NULL",
    "p2_reasons": _P2 + "SELECT coalesce(reason, 'valid') AS reason, count(*) AS rows FROM e GROUP BY ALL",
    "p3_found": r"""
WITH t AS (SELECT upper(regexp_replace(barcode_key, '^\s+|\s+$', '', 'g')) AS key FROM r2_reads), n AS (SELECT count(*) AS total FROM t)
SELECT 'barcode_key' AS key_field, key AS key_value FROM t, n WHERE key IS NOT NULL GROUP BY key, total HAVING count(*) >= 0.05 * total
UNION ALL SELECT 'slice_id', cast(slice_id AS VARCHAR) FROM t JOIN barcodes ON key = upper(trim(barcode)), n WHERE slice_id IS NOT NULL GROUP BY slice_id, total HAVING count(*) >= 0.05 * total""",
    "p3_barcode_results": _P3 + f", s AS (SELECT key AS barcode, {_STATE} FROM t GROUP BY key) SELECT *, {_MEANS} FROM s",
    "p3_slice_results": _P3 + f", s AS (SELECT slice_id, {_STATE} FROM t JOIN barcodes ON key = upper(trim(barcode)) WHERE slice_id IS NOT NULL GROUP BY slice_id) SELECT *, {_MEANS} FROM s",
}
