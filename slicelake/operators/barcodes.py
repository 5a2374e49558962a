"""Barcode neighbourhoods, unambiguous repair, and demultiplexing of paired reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelake.functions.reads import packed_read_key

ALPHABET = ("N", "C", "T", "G", "A")
#: Most rows of a barcode or variant table that is broadcast; beyond, the join is shuffled and AQE splits hot barcodes.
MAX_BROADCAST = 500_000


def barcode_list(table: DataFrame) -> DataFrame:
    """(barcode, slice_id): upper-cased, distinct, NULL barcodes left out; other letters than ACGTN raise an error.

    A barcode listed with several slices keeps the smallest.
    """
    up = F.upper(F.trim("barcode"))
    ok = F.when(up.rlike("^[ACGTN]+$"), up).otherwise(F.raise_error(F.concat(F.lit("not a barcode: "), up)))
    return table.where("barcode IS NOT NULL").select(ok.alias("barcode"), "slice_id").groupBy("barcode").agg(F.min("slice_id").alias("slice_id"))


def _substitute(seqs: DataFrame, letters: tuple[str, ...]) -> DataFrame:
    at = seqs.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("variant"))))
    return at.withColumn("letter", F.explode(F.array(*[F.lit(c) for c in letters]))).select("barcode", F.expr("overlay(variant PLACING letter FROM pos FOR 1)").alias("variant")).distinct()


def hamming_ball(barcodes: DataFrame, max_hamming: int = 1) -> DataFrame:
    """(barcode, variant, distance): every sequence within ``max_hamming`` substitutions, the barcode included.

    max_hamming 0 stands for one substitution by N only.
    """
    ball = barcodes.select("barcode", F.col("barcode").alias("variant")).distinct()
    for _ in range(max(1, max_hamming)):
        ball = _substitute(ball, ALPHABET if max_hamming else ("N",)).unionByName(ball).distinct()
    same = F.zip_with(F.split("barcode", ""), F.split("variant", ""), lambda a, b: (a != b).cast("int"))
    return ball.withColumn("distance", F.aggregate(same, F.lit(0), lambda a, x: a + x))


def unambiguous_variants(barcodes: DataFrame, max_hamming: int = 1) -> DataFrame:
    """The ball without variants that lie in the balls of two or more barcodes."""
    ball = hamming_ball(barcodes, max_hamming)
    claimed = ball.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.first("barcode").alias("barcode"), F.first("distance").alias("distance"))
    return claimed.where("n = 1").select("barcode", "variant", "distance")


def _lookup(table: DataFrame, barcodes: DataFrame, max_hamming: int | None = None) -> DataFrame:
    """The table marked for broadcast if it is small enough, by the length of its barcodes: only these are read.

    A ball of one substitution has one row and four for each letter; None stands for the barcodes alone.
    """
    ball = F.lit(1.0) if max_hamming is None else F.pow(1.0 + 4.0 * F.length("barcode"), F.lit(float(max(1, max_hamming))))
    rows = barcodes.limit(MAX_BROADCAST + 1).agg(F.coalesce(F.sum(ball), F.lit(0.0))).first()[0]
    return F.broadcast(table) if rows <= MAX_BROADCAST else table


def repair(reads: DataFrame, barcodes: DataFrame, seq_col: str = "seq_line", max_hamming: int = 1) -> DataFrame:
    """Adds ``exact`` and ``corrected``: the barcode a sequence is, or the only one whose ball it lies in.

    An exact barcode is never overridden by a variant; NULL and other sequences have NULL. One pass, one join.
    """
    listed = barcodes.select(F.col("barcode").alias("_seq"), F.col("barcode").alias("_to"), F.lit(True).alias("exact"))
    variants = unambiguous_variants(barcodes, max_hamming).select(F.col("variant").alias("_seq"), F.col("barcode").alias("_to"), F.lit(False).alias("exact"))
    lookup = listed.unionByName(variants.join(listed.select("_seq"), "_seq", "left_anti"))
    lookup = _lookup(lookup, barcodes, max_hamming)
    joined = reads.drop("exact", "corrected").join(lookup, reads[seq_col] == lookup["_seq"], "left")
    return joined.withColumn("exact", F.coalesce("exact", F.lit(False))).withColumnRenamed("_to", "corrected").drop("_seq")


def replaced(matched: Column, replacement: Column, seq: Column, qual: Column) -> tuple[Column, Column]:
    """(sequence, quality) with matched records replaced; a replaced quality is all ``I``."""
    return F.when(matched, replacement).otherwise(seq), F.when(matched, F.repeat(F.lit("I"), F.length(replacement))).otherwise(qual)


def demux_r1(reads: DataFrame, barcodes: DataFrame, seq_col: str = "seq_line") -> DataFrame:
    """Reads whose sequence is exactly a listed barcode, with its slice_id."""
    listed = barcodes.select(F.col("barcode").alias("_b"), F.col("slice_id").alias("slice_id"))
    listed = _lookup(listed, barcodes)
    return reads.drop("slice_id", "barcode").join(listed, reads[seq_col] == F.col("_b")).withColumnRenamed("_b", "barcode")


def demux_r2(r2: DataFrame, r1: DataFrame) -> DataFrame:
    """R2 reads with the barcode and slice of their mate, joined on (sample_id, packed read key).

    r1: reads with ``corrected`` (or ``barcode``) and header_line. Reads without a key never match; R2 reads
    without a mate are dropped. Several R1 reads of one key give the smallest barcode, whatever their order.
    """
    name = "corrected" if "corrected" in r1.columns else "barcode"
    build = r1.select("sample_id", packed_read_key(F.col("header_line")).alias("read_key"), F.col(name).alias("barcode")).where("read_key IS NOT NULL AND barcode IS NOT NULL").groupBy("sample_id", "read_key").agg(F.min("barcode").alias("barcode"))
    probe = r2.drop("barcode", "read_key", "slice_id").withColumn("read_key", packed_read_key(F.col("header_line"))).where("read_key IS NOT NULL")
    return probe.join(build, ["sample_id", "read_key"])


def demux_summary(demuxed: DataFrame, barcodes: DataFrame, total: DataFrame) -> DataFrame:
    """(barcode, slice_id, read_count, pct): pct of all reads, 1 decimal. total: a one-row, one-column frame.

    Counted before the barcode list is joined, so a hot barcode costs one partial row a task.
    """
    return with_percent(demuxed.groupBy("barcode").agg(F.count(F.lit(1)).alias("read_count")), barcodes, total)


def with_percent(counts: DataFrame, barcodes: DataFrame, total: DataFrame) -> DataFrame:
    """(barcode, slice_id, read_count, pct) of (barcode, read_count)."""
    pct = F.round(F.try_divide(F.col("read_count") * 100.0, total.scalar()), 1)
    return counts.join(barcodes.select("barcode", "slice_id"), "barcode", "left").select("barcode", "slice_id", "read_count", pct.alias("pct"))
