"""A few keys holding most records: per-key results by multi-level tree aggregation.

The leaves are chunks of at most ``CHUNK_ROWS`` reads, each reduced to one state per key. A task merges the chunks it
reads level by level, as soon as ``fan_in`` states of a level are there, so what it hands on is one state per key; the
states of the tasks then merge in rounds of the same fan-in. So no merge, within a task or behind a shuffle, takes more
than ``fan_in`` states of a key, however hot the key, and the tree has several levels from the first tables on.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reads of a chunk, at most.
CHUNK_ROWS = 10_000
#: States of a key that one merge takes. Every round behind a shuffle moves the states of all keys once more.
FAN_IN = 8
#: name, how two states merge
READ_STATE = (("reads", "sum"), ("bases", "sum"), ("qual_sum", "sum"), ("qual_chars", "sum"), ("min_len", "min"), ("max_len", "max"))


def _qual_sums(qual: pa.Array) -> np.ndarray:
    """Sum of Phred values (code minus 33) of each quality string, NULL as 0, straight from the Arrow buffer."""
    qual = pc.fill_null(qual, "").cast(pa.large_binary())
    off = np.frombuffer(qual.buffers()[1], dtype=np.int64, count=len(qual) + 1 + qual.offset)[qual.offset :]
    data = np.frombuffer(qual.buffers()[2] or b"", dtype=np.uint8)
    cum = np.zeros(int(off[-1] - off[0]) + 1, dtype=np.int64)
    np.cumsum(data[off[0] : off[-1]], dtype=np.int64, out=cum[1:])
    at = off - off[0]
    return cum[at[1:]] - cum[at[:-1]] - 33 * (at[1:] - at[:-1])


def _chunk_state(chunk: pa.RecordBatch) -> pa.Table:
    """One state per key of a chunk of (key, seq_line, qual_line)."""
    key = pc.utf8_upper(pc.utf8_trim_whitespace(chunk.column(0)))
    seq, qual = chunk.column(1), chunk.column(2)
    length = pc.utf8_length(seq)
    t = pa.table({"key": key, "reads": pa.array(np.ones(chunk.num_rows, np.int64)), "len": length, "qual_sum": pa.array(_qual_sums(qual)), "qual_chars": pc.fill_null(pc.binary_length(qual), 0).cast(pa.int64())})
    part = t.group_by("key").aggregate([("reads", "sum"), ("len", "sum"), ("qual_sum", "sum"), ("qual_chars", "sum"), ("len", "min"), ("len", "max")])
    return _typed(part.select(["key", "reads_sum", "len_sum", "qual_sum_sum", "qual_chars_sum", "len_min", "len_max"]))


def _combine_chunks(max_states: int, fan_in: int, chunk_rows: int):
    """The levels of the tree within a task: level n holds fewer than ``fan_in`` states of ``fan_in ** n`` chunks each."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[list[pa.Table]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = _chunk_state(batch.slice(at, chunk_rows))
                for level in itertools.count():
                    if level == len(levels):
                        levels.append([])
                    levels[level].append(part)
                    if len(levels[level]) < fan_in:
                        break
                    part, levels[level] = _merge(levels[level]), []
                if sum(x.num_rows for held in levels for x in held) > max_states:
                    part = _fold(levels, fan_in)
                    levels = [] if part.num_rows > max_states // 2 else [[part]]
                    if not levels:
                        yield from part.combine_chunks().to_batches()
        if any(levels):
            yield from _fold(levels, fan_in).combine_chunks().to_batches()

    return combine


def _fold(levels: list[list[pa.Table]], fan_in: int) -> pa.Table:
    """All that the levels hold as one state per key, by merges of at most ``fan_in``."""
    parts = list(itertools.chain(*levels))
    while len(parts) > 1:
        parts = [_merge(parts[i : i + fan_in]) for i in range(0, len(parts), fan_in)]
    return parts[0]


def _typed(t: pa.Table) -> pa.Table:
    cols = [t.column(0), *(c.cast(pa.int64()) for c in t.columns[1:])]
    cols[2] = pc.fill_null(cols[2], 0)
    return pa.table(dict(zip(["key", *(n for n, _ in READ_STATE)], cols)))


def _merge(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by("key").aggregate(list(READ_STATE))
    return out.select(["key", *(f"{n}_{how}" for n, how in READ_STATE)]).rename_columns(["key", *(n for n, _ in READ_STATE)])


def merge_rounds(partials: DataFrame, keys: list[str], merges: dict[str, str], chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merges partial states ``(keys, chunk, states)`` through ``ceil(log_fan_in(chunks))`` rounds, at least one.

    chunk: a number under ``chunks``, here that of the task. merges: state column -> "sum", "min" or "max". NULL states
    are skipped; an empty input gives no rows.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    while True:
        last = chunks <= fan_in
        node = F.lit(0).cast("long") if last else F.floor(F.col("chunk") / fan_in)
        partials = partials.withColumn("chunk", node).groupBy(*keys, "chunk").agg(*[how[h](c).alias(c) for c, h in merges.items()])
        if last:
            return partials.drop("chunk")
        chunks = -(-chunks // fan_in)


def tree_count(df: DataFrame, keys: list[str], fan_in: int = FAN_IN) -> DataFrame:
    """Rows per key by the same tree, for any keys; NULL is a key of its own."""
    chunks = max(1, df.rdd.getNumPartitions())
    partials = df.withColumn("chunk", F.spark_partition_id().cast("long")).groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("rows"))
    return merge_rounds(partials, keys, {"rows": "sum"}, chunks, fan_in)


def read_states(reads: DataFrame, key: str = "barcode_key", fan_in: int = FAN_IN, max_states: int = 200_000, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row of read statistics per key (trimmed, upper-cased); reads without a key come as key NULL.

    Columns: key, reads, bases, qual_sum (of Phred values), qual_chars, min_len, max_len. NULL seq_line counts as
    a read without length, NULL qual_line as one without quality characters. max_states bounds the states a task
    holds; when exceeded they are passed on, so the number of distinct keys is not bounded.
    """
    cols = reads.select(F.col(key).cast("string").alias("key"), F.col("seq_line").cast("string"), F.col("qual_line").cast("string"))
    chunks = max(1, cols.rdd.getNumPartitions())
    schema = "key string, " + ", ".join(f"{n} bigint" for n, _ in READ_STATE)
    partials = cols.mapInArrow(_combine_chunks(max_states, fan_in, chunk_rows), schema).withColumn("chunk", F.spark_partition_id().cast("long"))
    return merge_rounds(partials, ["key"], dict(READ_STATE), chunks, fan_in)


def with_means(states: DataFrame) -> DataFrame:
    """Adds mean_len and mean_qual, rounded to 6 places; NULL where nothing was measured."""
    return states.withColumns({"mean_len": F.round(F.expr("try_divide(bases, reads)"), 6), "mean_qual": F.round(F.expr("try_divide(qual_sum, qual_chars)"), 6)})


def by_slice(states: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Per-barcode states folded to slices. Barcodes without a slice, or not listed, are left out.

    Both inputs hold one row per barcode here, so this step is small whatever the number of reads.
    """
    listed = barcodes.select(F.upper(F.regexp_replace("barcode", r"^\s+|\s+$", "")).alias("key"), "slice_id").where("key IS NOT NULL AND slice_id IS NOT NULL").distinct()
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    return states.join(listed, "key").groupBy("slice_id").agg(*[how[h](n).alias(n) for n, h in READ_STATE])


def heavy_keys(states: DataFrame, key_field: str, key: str, total: DataFrame, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows, as (key_field, key_value). ``total`` is a one-row, one-column frame.

    NULL is no key. Ties at the threshold are all kept.
    """
    return states.where(F.col(key).isNotNull() & (F.col("reads") >= share * total.scalar())).select(F.lit(key_field).alias("key_field"), F.col(key).cast("string").alias("key_value"))
