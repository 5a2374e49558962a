"""Quality trimming and filtering of whole batches of reads: prefix sums over the concatenated quality strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column without NULLs."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _bounds(window_mean: int, least_len: int, qualified: int, max_unqualified: float, least_mean: float, max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, qual = _bytes(b.column(2))
            _, seq = _bytes(b.column(1))
            q = qual.astype(np.int64) - 33
            start, end = at[:-1], at[1:]
            good = np.zeros(len(q) + 1, dtype=bool)  # a window begins here and lies within one read
            if len(q) > 1:
                good[: len(q) - 1] = q[:-1] + q[1:] >= 2 * window_mean
            good[np.maximum(end - 1, 0)[end > start]] = False
            place = np.flatnonzero(good)
            lo, hi = np.searchsorted(place, start), np.searchsorted(place, end)
            some = hi > lo
            pick = place if len(place) else np.zeros(1, dtype=np.int64)
            first = np.where(some, pick[np.minimum(lo, len(pick) - 1)], start)
            last = np.where(some, pick[np.maximum(hi - 1, 0)] + 2, start)  # exclusive
            low, total, ns = _prefix(q < qualified), _prefix(q), _prefix(seq == ord("N"))
            n = last - first
            ok = some & (n >= least_len) & (low[last] - low[first] <= max_unqualified * n) & (total[last] - total[first] >= least_mean * n) & (ns[last] - ns[first] <= max_n)
            rows = pa.array(ok)
            yield pa.record_batch([pc.filter(c, rows) for c in (*b.columns, pa.array((first - start + 1).astype(np.int32)), pa.array(n.astype(np.int32)))], names=["id", "seq", "qual", "first", "n"])

    return run


def trim_and_filter(reads: DataFrame, id_col: str = "read_id", window_mean: int = 20, least_len: int = 20, qualified: int = 20, max_unqualified: float = 0.25, least_mean: float = 27.0, max_n: int = 3) -> DataFrame:
    """(id_col, seq, qual) of the reads that pass, cut from both ends by windows of two bases of the given mean.

    A read without a good window is dropped, and so are NULLs, reads whose sequence and quality differ in length
    and such with characters beyond ASCII. Ties and repeated reads don't matter: each read is judged alone.
    """
    ascii_only = (F.octet_length("seq") == F.length("seq")) & (F.octet_length("qual") == F.length("qual"))
    rows = reads.select(F.col(id_col).cast("bigint").alias("id"), F.col("seq_line").alias("seq"), F.col("qual_line").alias("qual")).where((F.length("seq") == F.length("qual")) & (F.length("seq") > 0) & ascii_only)
    cut = rows.mapInArrow(_bounds(window_mean, least_len, qualified, max_unqualified, least_mean, max_n), "id bigint, seq string, qual string, first int, n int")
    return cut.select(F.col("id").alias(id_col), F.expr("substr(seq, first, n)").alias("seq"), F.expr("substr(qual, first, n)").alias("qual"))
