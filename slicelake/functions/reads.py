"""Column expressions over sequencing records: validity, keys, quality, trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slicelake.functions.materialize import once

#: Messages of the record checks, in the order of the checks.
ERRORS = ("incomplete record", "bad header", "bad plus line", "bad sequence", "length mismatch")


def record_error(header: Column, seq: Column, plus: Column, qual: Column, tag: str = "@NS") -> Column:
    """The first check that a record fails, NULL for a valid one.

    Order: all four lines there; header begins with ``tag``; plus line exactly ``+``; sequence of A C G T N only;
    sequence and quality equally long. An empty sequence is a bad one.
    """
    missing = header.isNull() | seq.isNull() | plus.isNull() | qual.isNull()
    return (
        F.when(missing, ERRORS[0])
        .when(~header.startswith(tag), ERRORS[1])
        .when(plus != "+", ERRORS[2])
        .when(~F.rlike(seq, F.lit(r"\A[ACGTN]+\z")), ERRORS[3])
        .when(F.length(seq) != F.length(qual), ERRORS[4])
    )


def header_numbers(header: Column) -> Column:
    """Array of lane, tile, x, y as digit strings, NULL unless at least five colon-separated parts end in four whole numbers."""
    head = F.translate(F.substring_index(header, " ", 1), "\r\n", "")
    parts = F.split(F.regexp_extract(head, r"(?s)\A.*:([0-9]+:[0-9]+:[0-9]+:[0-9]+)\z", 1), ":")
    return once(parts, lambda p: F.when(F.size(p) == 4, p))


def packed_read_key(header: Column) -> Column:
    """64-bit read key: lane in 2 bits, tile in 20, x and y in 21 each; NULL for headers without usable numbers.

    Numbers beyond their field keep their low bits (beyond 38 digits there is no key); lanes 2 and 3 give negative
    keys, which still join by equality. Only join on it together with the sample, as run and flowcell are no part of it.
    """

    def field(n: Column, i: int, bits: int) -> Column:
        digits = F.get(n, F.lit(i))
        low = (digits.try_cast("decimal(38,0)") % F.lit(1 << bits)).cast("bigint")
        return F.when(F.length(digits) <= 18, digits.try_cast("bigint").bitwiseAND((1 << bits) - 1)).otherwise(low)

    def pack(n: Column) -> Column:
        lane, tile, x, y = (field(n, i, bits) for i, bits in enumerate((2, 20, 21, 21)))
        return F.shiftleft(lane, 62).bitwiseOR(F.shiftleft(tile, 42)).bitwiseOR(F.shiftleft(x, 21)).bitwiseOR(y)

    return once(header_numbers(header), pack)


def header_token(header: Column, index: int) -> Column:
    """The ``index``-th colon-separated token of a header, counted from 1; 0 is the whole header; NULL beyond the last."""
    return header if index == 0 else F.get(F.split(header, ":"), F.lit(index - 1))


def phred(qual: Column) -> Column:
    """Array of Phred values (code minus 33)."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def passes_quality(seq: Column, values: Column, max_n: int, qualified: int = 20, max_unqualified: float = 0.25, least_mean: float = 27.0) -> Column:
    """Whether enough bases are qualified, the mean quality is high enough and few bases are N. Empty reads fail."""
    n = F.size(values)
    low = F.size(F.filter(values, lambda q: q < qualified))
    ns = F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))
    return (n > 0) & (low <= max_unqualified * n) & (array_sum(values) >= least_mean * n) & (ns <= max_n)


def trim_bounds(values: Column, window_sum: int = 40) -> Column:
    """(first, last) base kept, from 1, of a cut from both ends by windows of two bases of mean 20; NULL where no window is good."""
    n = F.size(values)
    good = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (F.get(values, i - 1) + F.get(values, i) >= window_sum))
    return F.when(F.size(good) > 0, F.struct(F.element_at(good, 1).alias("first"), (F.element_at(good, -1) + 1).alias("last")))


def subsequence(text: Column, first: int, last: int) -> Column:
    """Positions first to last, counted from 1, both included."""
    return F.substring(text, first, last - first + 1)
