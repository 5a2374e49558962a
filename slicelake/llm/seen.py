"""Has this key been seen before? Record by record in order of arrival, with bounded memory for earlier keys.

Keys are hashed to fingerprints; records are hash-partitioned by fingerprint and sorted by arrival within each
partition, where a task reads them in batches against an Elias-Fano set of all earlier fingerprints. Before that
shuffle each input chunk answers its own repeats, so a key that holds a third of all rows sends one row a chunk to
its partition; the answered rows are spread evenly.

Sets can be stored: ``stored_sets`` encodes all keys so far by sorted hash partition, ``seen_before`` takes such a table
as what came earlier, and ``merged_sets`` merges a new batch into it, so that billions of earlier keys are neither
kept as keys nor shuffled as such again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelake.functions.materialize import computed
from slicelake.llm.elias_fano import EliasFano, SeenSet

#: A probe against n earlier keys of its partition is wrongly "seen" with a chance of n / 2**FINGERPRINT_BITS.
FINGERPRINT_BITS = 56
#: Leading fingerprint bits that number the partitions of stored sets, and most values of one stored row.
PART_BITS, MOST_STORED = 8, 1_000_000
STORED = "part int, n bigint, low binary, high binary"


def read_key(header: Column) -> Column:
    """``lane:tile:x:y`` of a header as canonical whole numbers, NULL where the header gives none.

    The last four colon-separated parts before the first space, in digits, behind at least one further part.
    Carriage returns are dropped; leading zeros don't count.
    """
    head = F.replace(F.substring_index(header, " ", 1), F.lit("\r"), F.lit(""))
    key = F.regexp_replace(head, r"(?s)\A.*:0*([0-9]+):0*([0-9]+):0*([0-9]+):0*([0-9]+)\z", "$1:$2:$3:$4")
    return F.when(key != head, key)  # a match has a colon less; one pass of the pattern


def _first_in_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags rows whose key stands in an earlier row of the same chunk."""
    for b in batches:
        if not b.num_rows:
            continue
        order, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        by = np.lexsort((order, fp))
        repeat = np.zeros(len(by), dtype=bool)
        same = (fp[by][1:] == fp[by][:-1]) & (order[by][1:] > order[by][:-1])
        repeat[by[1:]] = same
        # rows of one order value are ties: each of them repeats only what came strictly before
        tie = (fp[by][1:] == fp[by][:-1]) & (order[by][1:] == order[by][:-1])
        for i in np.flatnonzero(tie):
            repeat[by[i + 1]] = repeat[by[i]]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(repeat)], names=["ord", "fp", "repeat"])


class Prober:
    """Answers batches of one partition in order of arrival, each against all that came strictly before."""

    def __init__(self, universe_bits: int):
        self.earlier = SeenSet(universe_bits)
        self.pending = np.zeros(0, dtype=np.uint64)  # fingerprints of the order value the last batch ended with
        self.pending_ord = None

    def __call__(self, order: np.ndarray, fp: np.ndarray, repeat: np.ndarray) -> np.ndarray:
        """repeat: rows whose answer is known to be "seen" and whose key another row bears."""
        seen = repeat.copy()
        ask = np.flatnonzero(~repeat)
        o, f = order[ask], fp[ask]
        if self.pending_ord is not None and len(o) and o[0] != self.pending_ord:
            self.earlier.add(_new(self.earlier, self.pending))
            self.pending, self.pending_ord = np.zeros(0, dtype=np.uint64), None
        if len(o):
            hit = self.earlier.seen(f)
            by = np.lexsort((o, f))
            start = np.r_[True, f[by][1:] != f[by][:-1]]
            first_ord = o[by][np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))]
            hit[by] |= o[by] > first_ord
            if len(self.pending):
                hit |= np.isin(f, self.pending) & (o > self.pending_ord)
            seen[ask] = hit
            last = o[-1]
            self.earlier.add(_new(self.earlier, np.concatenate([f[o < last], self.pending]) if self.pending_ord not in (None, last) else f[o < last]))
            self.pending = np.unique(np.concatenate([self.pending if self.pending_ord == last else self.pending[:0], f[o == last]]))
            self.pending_ord = last
        return seen


def _probe(universe_bits: int):
    mask = np.uint64((1 << universe_bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = Prober(universe_bits)
        for b in batches:
            if b.num_rows:
                order, repeat = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
                yield pa.record_batch([b.column(0), pa.array(answer(order, b.column(1).to_numpy().view(np.uint64) & mask, repeat))], names=["ord", "seen"])

    return run


def _new(earlier: SeenSet, values: np.ndarray) -> np.ndarray:
    values = np.unique(values)
    return values[~earlier.seen(values)]


def fingerprint(*key: Column) -> Column:
    """64-bit fingerprint of a key, NULL where any part is NULL."""
    known = key[0].isNotNull()
    for k in key[1:]:
        known &= k.isNotNull()
    return F.when(known, F.xxhash64(*key))


def seen_before(records: DataFrame, order_col: str, key: list[Column], bits: int = FINGERPRINT_BITS) -> DataFrame:
    """(order_col, seen): whether a record with a smaller ``order_col`` bears the same key.

    Records with a NULL in the key or the order have no key and are left out. Records with equal order values and
    equal keys are ties: none of them is earlier than the other. Extra columns are ignored; an empty table gives
    an empty one. No key is wrongly "not seen"; ``bits`` sets how rarely one is wrongly "seen".
    """
    rows = computed(records, _fp=fingerprint(*key)).select(F.col(order_col).cast("bigint").alias("ord"), F.col("_fp").alias("fp")).where("ord IS NOT NULL AND fp IS NOT NULL")
    flagged = rows.mapInArrow(_first_in_chunk, "ord bigint, fp bigint, repeat boolean")
    masked = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    to = F.when(F.col("repeat"), F.xxhash64("ord")).otherwise(masked)
    parts = flagged.repartition(to).sortWithinPartitions("ord")
    return parts.mapInArrow(_probe(bits), "ord bigint, seen boolean").withColumnRenamed("ord", order_col)


def _keyed(records: DataFrame, key: list[Column], bits: int, part_bits: int, order: Column) -> DataFrame:
    """(ord, fp, part): fingerprint without its leading ``part_bits``, which number the partition; records without key left out."""
    rows = computed(records, _fp=fingerprint(*key).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))).where("_fp IS NOT NULL")
    rest = bits - part_bits
    return rows.select(order.cast("bigint").alias("ord"), F.col("_fp").bitwiseAND(F.lit((1 << rest) - 1).cast("bigint")).alias("fp"), F.shiftright("_fp", rest).cast("int").alias("part"))


def _rows_of(part: int, values: np.ndarray, universe_bits: int) -> pa.RecordBatch:
    sets = [EliasFano(values[k : k + MOST_STORED], universe_bits) for k in range(0, len(values), MOST_STORED)]
    columns = ([part] * len(sets), pa.int32()), ([s.n for s in sets], pa.int64()), ([s.low.tobytes() for s in sets], pa.binary()), ([s.high.tobytes() for s in sets], pa.binary())
    return pa.record_batch([pa.array(v, kind) for v, kind in columns], names=["part", "n", "low", "high"])


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one partition, in order; a partition may come in several runs."""
    for b in batches:
        part = b.column(0).to_numpy()
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, z in zip(edges, [*edges[1:], len(part)]):
            yield int(part[a]), b.slice(int(a), int(z - a))


def _stored_of(run: pa.RecordBatch, universe_bits: int) -> list[EliasFano]:
    """The sets among the rows of a run: those with n."""
    some = run.filter(run.column("n").is_valid())
    return [EliasFano.from_words(n, universe_bits, low, high) for n, low, high in zip(*(some.column(c).to_pylist() for c in ("n", "low", "high")))]


def _with_sets(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Stored rows and records in one table, each partition's sets before its records, these in order of arrival."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("n", "bigint"), ("low", "binary"), ("high", "binary"))]
    both = rows.select("part", *nothing, *[c for c in rows.columns if c != "part"])
    if stored is not None:
        both = both.unionByName(stored.select("part", "n", "low", "high"), allowMissingColumns=True)
    return both.repartition("part").sortWithinPartitions("part", F.col("n").isNull(), "ord")


def merged_sets(stored: DataFrame | None, records: DataFrame, key: list[Column], bits: int = FINGERPRINT_BITS, part_bits: int = PART_BITS) -> DataFrame:
    """The stored sets (part, n, low, high) with the keys of a further batch merged in, partition by partition.

    Records with a NULL in the key are left out; without any record the sets come back as they were. Keys that
    repeat within an input chunk are shuffled once. All batches must use the same ``bits`` and ``part_bits``; more of
    the latter keep partitions small (2 ** part_bits partitions, each merged by one task).
    """
    universe = bits - part_bits

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.unique((b.column(2).to_numpy().astype(np.int64) << universe) | b.column(1).to_numpy())
            yield pa.record_batch([pa.array(np.zeros(len(both), dtype=np.int64)), pa.array(both & ((1 << universe) - 1)), pa.array((both >> universe).astype(np.int32))], names=["ord", "fp", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, SeenSet(universe)
        for p, run in _by_part(batches):
            if p != part:
                if part is not None:
                    yield _rows_of(part, held.values(), universe)
                part, held = p, SeenSet(universe)
            held.runs += _stored_of(run, universe)
            fp = run.column("fp").drop_null().to_numpy(zero_copy_only=False).astype(np.uint64)
            held.add(_new(held, fp))
        if part is not None:
            yield _rows_of(part, held.values(), universe)

    rows = _keyed(records, key, bits, part_bits, F.lit(0)).mapInArrow(distinct, "ord bigint, fp bigint, part int")
    return _with_sets(stored, rows).mapInArrow(merge, STORED)


def stored_sets(records: DataFrame, key: list[Column], bits: int = FINGERPRINT_BITS, part_bits: int = PART_BITS) -> DataFrame:
    """(part, n, low, high): the distinct keys of all records as Elias-Fano sets, to be written as a table."""
    return merged_sets(None, records, key, bits, part_bits)


def seen_since(stored: DataFrame, records: DataFrame, order_col: str, key: list[Column], bits: int = FINGERPRINT_BITS, part_bits: int = PART_BITS) -> DataFrame:
    """As ``seen_before``, where every key of the stored sets came before all of ``records``."""
    universe = bits - part_bits
    rows = _keyed(records, key, bits, part_bits, F.col(order_col)).where("ord IS NOT NULL")
    whole = rows.select("ord", F.shiftleft(F.col("part").cast("bigint"), universe).bitwiseOR(F.col("fp")).alias("fp")).mapInArrow(_first_in_chunk, "ord bigint, fp bigint, repeat boolean")
    part = F.when(F.col("repeat"), F.pmod(F.xxhash64("ord"), F.lit(1 << part_bits))).otherwise(F.shiftright("fp", universe)).cast("int")
    flagged = whole.select(part.alias("part"), "ord", F.col("fp").bitwiseAND(F.lit((1 << universe) - 1).cast("bigint")).alias("fp"), "repeat")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, answer = None, None
        for p, run in _by_part(batches):
            if p != part:
                part, answer = p, Prober(universe)
            answer.earlier.runs += _stored_of(run, universe)
            asked = run.filter(run.column("ord").is_valid())
            if asked.num_rows:
                order, fp, repeat = (asked.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "fp", "repeat"))
                yield pa.record_batch([pa.array(order), pa.array(answer(order, fp.astype(np.uint64), repeat.astype(bool)))], names=["ord", "seen"])

    return _with_sets(stored, flagged).mapInArrow(probe, "ord bigint, seen boolean").withColumnRenamed("ord", order_col)


def error_report(records: DataFrame, order_col: str, key: list[Column], bits: int = FINGERPRINT_BITS) -> DataFrame:
    """One row: records, keyed, seen, wrong, wrong_rate. Wrong answers are counted exactly.

    Fingerprints never miss a repeat, so the answers "seen" beyond keyed records less distinct keys are the wrong
    ones (with order values distinct). Distinct keys are counted over the keys themselves.
    """
    answers = seen_before(records, order_col, key, bits).agg(F.count(F.lit(1)).alias("keyed"), F.count_if("seen").alias("seen"))
    keys = records.where(F.col(order_col).isNotNull()).select(*[k.alias(f"k{i}") for i, k in enumerate(key)]).na.drop()
    exact = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))
    total = records.agg(F.count(F.lit(1)).alias("records"))
    wrong = F.col("seen") - F.col("repeats")
    counted = answers.select(total.scalar().alias("records"), "keyed", "seen", exact.scalar().alias("repeats"))
    return counted.select("records", "keyed", "seen", wrong.alias("wrong"), F.round(F.coalesce(F.try_divide(wrong, F.col("keyed")), F.lit(0.0)), 9).alias("wrong_rate"))
