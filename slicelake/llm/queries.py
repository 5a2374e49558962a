"""Queries of the numbered problems of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.llm import fuzzymap, leak, mix, mojibake, seen, split
from slicelake.session import cut, run_table, table


def _keyed_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    return table(spark, sf_dir, "r2_reads").select("read_id", "sample_id", "header_line"), [F.col("sample_id"), seen.read_key(F.col("header_line"))]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, key = _keyed_reads(spark, sf_dir)
    return seen.seen_before(reads, "read_id", key).where("seen").select("read_id")


def p1_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, key = _keyed_reads(spark, sf_dir)
    return seen.error_report(reads, "read_id", key)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list]:
    """Reads up to the middle read_id, as an earlier delivery, and the later ones."""
    reads, key = _keyed_reads(spark, sf_dir)
    middle = table(spark, sf_dir, "r2_reads").agg(F.floor(F.max("read_id") / 2)).scalar()
    later = F.col("read_id") > middle
    return reads.where(~later), reads.where(later), key


def p1_later_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a later delivery whose key came before, by the stored sets of the earlier one."""
    earlier, later, key = _halves(spark, sf_dir)
    stored = run_table(seen.stored_sets(earlier, key))
    return seen.seen_since(stored, later, "read_id", key).where("seen").select("read_id")


def p1_stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys in the stored sets before and after the later delivery is merged in."""
    earlier, later, key = _halves(spark, sf_dir)
    stored = run_table(seen.stored_sets(earlier, key))
    merged = seen.merged_sets(stored, later, key)
    n = F.coalesce(F.sum("n"), F.lit(0)).alias("keys")
    return stored.agg(n).select(F.lit("before").alias("state"), "keys").unionByName(merged.agg(n).select(F.lit("after").alias("state"), "keys"))


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(values that aren't letter for letter a barcode, barcodes)."""
    barcodes = table(spark, sf_dir, "barcodes")
    reads = table(spark, sf_dir, "r1_reads").select(F.lit("r1_reads").alias("source_table"), F.col("read_id").alias("row_id"), F.col("seq_line").alias("value"))
    labels = table(spark, sf_dir, "slice_labels").select(F.lit("slice_labels").alias("source_table"), F.col("entry_id").alias("row_id"), F.col("entered_barcode").alias("value"))
    listed = barcodes.select(F.col("barcode").alias("value")).where("value IS NOT NULL").distinct()
    return reads.unionByName(labels).join(listed, "value", "left_anti"), barcodes


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzymap.nearest_entries(*_typed(spark, sf_dir), "barcode").withColumnRenamed("entry", "barcode")


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each source are off the list, repaired or unmatched."""
    found = p4_found(spark, sf_dir)
    return found.groupBy("source_table").agg(F.count(F.lit(1)).alias("off_list"), F.count_if(F.col("barcode") == fuzzymap.UNMATCHED).alias("unmatched"))


def p4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All barcodes that a typed value may stand for, read in either direction (alias: the reverse complement)."""
    typed, barcodes = _typed(spark, sf_dir)
    other = barcodes.select(F.reverse(F.translate("barcode", "ACGT", "TGCA")).alias("alias"), F.col("barcode").alias("entry"))
    near = fuzzymap.candidates(typed.where("source_table = 'slice_labels'"), barcodes, "barcode", other)
    return near.select("row_id", F.inline("near")).select("row_id", F.col("entry").alias("barcode"), "distance")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_files(table(spark, sf_dir, "fastq_files"), **split.EXACT)


def p5_content_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_files(table(spark, sf_dir, "fastq_files"))


def p5_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the content-defined pieces of every file."""
    files = table(spark, sf_dir, "fastq_files")
    return split.piece_report(files, split.split_files(files))


def p5_kept_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many content-defined pieces of each file outlast a letter put in after its first third."""
    files = table(spark, sf_dir, "fastq_files")
    edited = files.select("file_id", F.expr("overlay(content PLACING 'A' FROM cast(length(content) / 3 AS INT) FOR 0)").alias("content"))
    return split.kept_after_edit(files, edited)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked, and into how many pages."""
    found = leak.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("pages"), F.max("n_words").alias("longest"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = cut(mix.histogram(mix.token_counts(table(spark, sf_dir, "documents"))))  # small; else tokenized twice
    return mix.budgets(hist, table(spark, sf_dir, "source_targets")).where("NOT reachable").select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p7_shares_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the largest mix in which every source has its share."""
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), hold_shares=True)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.detect(table(spark, sf_dir, "documents")).where("garbled").select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.detect(table(spark, sf_dir, "documents")).where("garbled").select("doc_id", "chain", "restored", "lines_lost")


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled pages by what could be done: restored, restored in part (lines lost letters), letters lost, not restorable."""
    found = mojibake.detect(table(spark, sf_dir, "documents")).where("garbled")
    restored, lost = F.col("restored").isNotNull(), F.col("lines_lost") > 0
    kind = F.when(restored & ~lost, "restored").when(restored, "restored in part").when(lost, "letters lost").otherwise("not restorable")
    return found.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("pages"), F.sum("lines_lost").alias("lines_lost"))


def p8_lost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with lines whose letters are gone, and how many such lines."""
    return mojibake.detect(table(spark, sf_dir, "documents")).where("lines_lost > 0").select("doc_id", "lines_lost")


_ALL = (p1_found, p1_error_rate, p1_later_delivery, p1_stored_keys, p4_found, p4_unmatched, p4_candidates, p5_found, p5_content_defined, p5_invariants, p5_kept_after_edit, p6_found, p6_leaked_items, p7_found, p7_mix, p7_shares, p7_shares_held, p8_found, p8_restored, p8_kinds, p8_lost_lines)
QUERIES = {f.__name__: f for f in _ALL}

_P1 = r"""
WITH h AS (SELECT read_id, sample_id, replace(split_part(header_line, ' ', 1), chr(13), '') AS head FROM r2_reads),
k AS (SELECT read_id, sample_id || '|' || regexp_replace(head, '(?s)^.*:0*([0-9]+):0*([0-9]+):0*([0-9]+):0*([0-9]+)$', '\1:\2:\3:\4') AS key
  FROM h WHERE regexp_full_match(head, '(?s).*:[0-9]+:[0-9]+:[0-9]+:[0-9]+')),
f AS (SELECT read_id, key, min(read_id) OVER (PARTITION BY key) AS first FROM k)
"""
# The written letters of a value: steps of fuzzymap.barcode_letters, by whole-list expressions.
_FULLWIDTH = "translate(value, '" + "".join(chr(0xFEE0 + k) for k in range(0x21, 0x7F)) + "', '" + "".join(chr(k) for k in range(0x21, 0x7F)).replace("'", "''") + "')"
_P4 = rf"""
WITH v AS (SELECT 'r1_reads' AS source_table, read_id AS row_id, seq_line AS value FROM r1_reads UNION ALL SELECT 'slice_labels', entry_id, entered_barcode FROM slice_labels),
o AS (SELECT * FROM v WHERE value IS NOT NULL AND value NOT IN (SELECT barcode FROM barcodes WHERE barcode IS NOT NULL)),
a AS (SELECT DISTINCT value, upper(replace({_FULLWIDTH}, chr(12288), ' ')) AS s FROM o),
b AS (SELECT value, regexp_replace(regexp_replace(regexp_replace(s, '\([^()]*\)|\[[^\[\]]*\]', ' ', 'g'), '\A[^:=]{{0,40}}[:=]', ' '), '\A\s*5\s*[''’′`]\s*-?|-?\s*3[''’′`]\s*\z', ' ', 'g') AS s FROM a),
c AS (SELECT value, regexp_extract_all(s, '[\pL\pN]+') AS t FROM b),
d AS (SELECT *, list_transform(t, lambda x: regexp_full_match(x, '[ACGTNUO0-9]+') OR (length(x) >= 5 AND length(regexp_replace(x, '[^ACGT]', '', 'g')) >= 0.7 * length(x))) AS fit,
  len(list_filter(t, lambda x: length(x) = 1)) < 5 AS words FROM c),
e AS (SELECT *, list_max(list_filter(range(1, len(t) + 1), lambda k: fit[k] AND (k = 1 OR NOT regexp_full_match(t[k], '[0-9]+')))) AS z FROM d),
f AS (SELECT *, list_min(list_filter(range(1, z + 1), lambda k: fit[k] AND (k = z OR NOT regexp_full_match(t[k], '[0-9]+')))) AS a FROM e),
g AS (SELECT value, t, array_to_string(list_transform(list_filter(range(CASE WHEN words THEN a ELSE 1 END, CASE WHEN words THEN z ELSE len(t) END + 1), lambda k: fit[k]), lambda k: t[k]), '') AS kept FROM f),
w AS (SELECT value, CASE WHEN coalesce(kept, '') = '' THEN array_to_string(t, '') ELSE kept END AS word FROM g),
"""
_P4_FOUND = _P4 + """n AS (SELECT word, barcode, levenshtein(word, barcode) AS d FROM (SELECT DISTINCT word FROM w), (SELECT DISTINCT barcode FROM barcodes WHERE barcode <> '') WHERE levenshtein(word, barcode) <= 2),
m AS (SELECT word, min(d) AS d FROM n GROUP BY 1), u AS (SELECT n.word, min(barcode) AS barcode FROM n JOIN m ON n.word = m.word AND n.d = m.d GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT source_table, row_id, coalesce(u.barcode, 'UNMATCHED') AS barcode FROM o JOIN w USING (value) LEFT JOIN u USING (word)) """
_P5 = r"""
WITH RECURSIVE l0 AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM fastq_files WHERE n_bytes > size_limit AND size_limit >= 1 AND content IS NOT NULL),
l1 AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, lead(line, 2) OVER (PARTITION BY file_id ORDER BY k) AS third FROM l0),
f AS (SELECT file_id, n_bytes AS n, size_limit AS lim, coalesce(overlap_records, 0) AS k, coalesce(recs, []) AS recs, lines FROM fastq_files JOIN
  (SELECT l1.file_id, list(pos ORDER BY pos) FILTER (WHERE starts_with(line, '@') AND starts_with(third, '+')) AS recs, list(pos ORDER BY pos) FILTER (WHERE pos < n_bytes) AS lines FROM l1 JOIN fastq_files USING (file_id) GROUP BY 1) USING (file_id)),
r AS (SELECT file_id, 0::BIGINT AS s, 0::BIGINT AS p, 0::BIGINT AS e, false AS done, 0 AS step FROM f
 UNION ALL
 SELECT file_id, s, e AS p, e, e >= n, step + 1 FROM (
  SELECT file_id, n, s, step, CASE WHEN n - s <= lim THEN n ELSE coalesce(list_max(list_filter(recs, lambda x: x > p AND x <= s + lim)), list_max(list_filter(lines, lambda x: x > p AND x <= s + lim)), s + lim) END::BIGINT AS e
  FROM (SELECT r.file_id, n, lim, recs, lines, r.p, step, done,
    CASE WHEN step > 0 AND k > 0 AND list_contains(recs, r.e) AND len(list_filter(recs, lambda x: x > r.s AND x < r.e)) > 0
     THEN list_filter(recs, lambda x: x > r.s AND x < r.e)[greatest(len(list_filter(recs, lambda x: x > r.s AND x < r.e)) - k + 1, 1)] ELSE r.e END::BIGINT AS s
    FROM r JOIN f USING (file_id) WHERE NOT done)))
SELECT file_id, s AS chunk_start, e AS chunk_end FROM r WHERE step > 0
"""
SQL = {
    "p1_found": _P1 + "SELECT read_id FROM f WHERE read_id > first",
    "p1_error_rate": _P1 + "SELECT (SELECT count(*) FROM r2_reads) AS records, count(key) AS keyed, count_if(read_id > first) AS seen, count_if(read_id > first) - (count(key) - count(DISTINCT key)) AS wrong, 0.0 AS wrong_rate FROM f WHERE key IS NOT NULL",
    "p1_later_delivery": _P1 + "SELECT read_id FROM f WHERE read_id > first AND read_id > (SELECT max(read_id) // 2 FROM r2_reads)",
    "p1_stored_keys": _P1 + "SELECT 'before' AS state, count(DISTINCT key) AS keys FROM k WHERE read_id <= (SELECT max(read_id) // 2 FROM r2_reads) UNION ALL SELECT 'after', count(DISTINCT key) FROM k",
    "p4_found": _P4_FOUND + "SELECT * FROM r",
    "p4_unmatched": _P4_FOUND + "SELECT source_table, count(*) AS off_list, count_if(barcode = 'UNMATCHED') AS unmatched FROM r GROUP BY 1",
    "p4_candidates": _P4 + """s AS (SELECT barcode, unnest([barcode, reverse(translate(barcode, 'ACGT', 'TGCA'))]) AS path FROM barcodes WHERE barcode <> ''),
n AS (SELECT word, barcode, min(levenshtein(word, path)) AS distance FROM (SELECT DISTINCT word FROM w), s WHERE levenshtein(word, path) <= CASE WHEN length(word) <= 3 THEN 0 WHEN length(word) <= 5 THEN 1 WHEN length(word) <= 11 THEN 2 ELSE 3 END GROUP BY 1, 2)
SELECT row_id, barcode, distance FROM o JOIN w USING (value) JOIN n USING (word) WHERE source_table = 'slice_labels'""",
    "p5_found": _P5,
    "p5_invariants": "SELECT file_id, n_bytes AS covered, true AS within_limit, 0 AS gaps, true AS progress FROM fastq_files WHERE n_bytes > size_limit AND size_limit >= 1 AND content IS NOT NULL",
    "p8_lost_lines": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, chr(65533)))) AS lines_lost FROM documents WHERE contains(text, chr(65533))",
}
