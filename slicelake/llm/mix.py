"""Mixing sources to target weights: choose documents by a hash threshold per source, without sorting.

Token sums by source and hash bucket give the bucket in which a source's budget ends; only that bucket is summed
again by finer hash bits, and every document below the resulting threshold is taken. Thresholds grow with the
budget, so a smaller mix of the same tables is contained in a larger one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicelake.session import broadcast_if_small, cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published splitting pattern of the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Hash bits in all, and how many each round resolves.
HASH_BITS, ROUND_BITS = 30, (10, 10, 10)


@cache
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokenizer(path).encode_ordinary
        for b in batches:
            n = pa.array([0 if t is None else len(enc(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.record_batch([b.column(0), b.column(2), n, b.column(3)], names=["doc_id", "source", "tokens", "h"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, h): tokens of the whole text, and a hash below 2**HASH_BITS. NULL text has no tokens.

    The hash is of doc_id, of the text where that is NULL.
    """
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))).bitwiseAND((1 << HASH_BITS) - 1)
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("source").cast("string"), h.alias("h"))
    return spread(rows).mapInArrow(_count_tokens(tokenizer), "doc_id bigint, source string, tokens bigint, h bigint")


def histogram(counts: DataFrame, bits: int = ROUND_BITS[0]) -> DataFrame:
    """(source, bucket, tokens, docs): sums by source and leading hash bits; combined before the shuffle."""
    return counts.groupBy("source", F.shiftright("h", HASH_BITS - bits).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def budgets(by_bucket: DataFrame, targets: DataFrame, hold_shares: bool = False) -> DataFrame:
    """One row per target source: its tokens, its budget in a mix as large as all documents, and whether it is reachable.

    Where a source falls short in a mix of that size, the others end up above their shares; hold_shares=True makes
    the mix as small as the shortest source asks for, so that all shares hold (a source without tokens: no mix).
    by_bucket: the histogram. Tokens of documents without a listed source count in the size of the mix. A NULL
    max_repeats is 1, a negative one 0; a NULL share is 0. A source without documents has 0 tokens.
    """
    sums = by_bucket.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = by_bucket.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    wanted = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))).cast("bigint").alias("max_repeats"))
    rows = wanted.join(sums, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(total.scalar(), F.lit(0)).alias("total"))
    most = F.col("tokens") * F.col("max_repeats")
    rows = rows.withColumn("reachable", most >= F.col("target_share") * F.col("total"))
    size = F.col("total").cast("double")
    if hold_shares:
        size = F.least(size, F.coalesce(rows.agg(F.min(F.when(F.col("target_share") > 0, most / F.col("target_share")))).scalar(), size))
    return rows.withColumn("budget", F.least(F.col("target_share") * size, most.cast("double")))


def thresholds(counts: DataFrame, plan: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(source, full_copies, threshold): every document is used full_copies times, those with h below threshold once more.

    plan: budgets(); first: the histogram it was made of, for the first round. Each round sums only the bucket in which the rest of the budget ends, by the next hash bits.
    A document that would pass the budget is left out, with all of its hash; equal hashes are in or out together.
    """
    copies = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("bigint")
    state = plan.select("source", copies.alias("full_copies"), (F.col("budget") - copies * F.col("tokens")).alias("rest"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("threshold"))
    used = 0
    for bits in ROUND_BITS:
        used += bits
        inside = counts if used == bits else counts.join(broadcast_if_small(state.select("source", "prefix")), "source").where(F.shiftright("h", HASH_BITS - used + bits) == F.col("prefix")).drop("prefix")
        if first is not None and used == bits:
            hist = first.where("source IS NOT NULL").select("source", "bucket", F.col("tokens").alias("n"))
        else:
            hist = inside.where("source IS NOT NULL").groupBy("source", F.shiftright("h", HASH_BITS - used).alias("bucket")).agg(F.sum("tokens").alias("n"))
        w = Window.partitionBy("source").orderBy("bucket")
        run = hist.join(state, "source").withColumn("cum", F.sum("n").over(w))
        # the first bucket that no longer fits; without one, all of the parent bucket fits
        ends = run.groupBy("source").agg(
            F.min(F.when(F.col("cum") > F.col("rest"), F.col("bucket"))).alias("cut_at"),
            F.coalesce(F.max(F.when(F.col("cum") <= F.col("rest"), F.col("cum"))), F.lit(0)).alias("taken"),
        )
        # with no bucket to cut, everything up to the parent's end is in
        parent_end = F.shiftleft(F.col("prefix") + 1, bits) if used > bits else F.lit(1 << bits).cast("bigint")
        at = F.coalesce("cut_at", parent_end)
        state = cut(
            state.join(ends, "source", "left").select(
                "source", "full_copies", (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("rest"),
                F.coalesce(at, F.lit(0)).cast("bigint").alias("prefix"),
                F.shiftleft(F.coalesce(at, F.lit(0)).cast("bigint"), HASH_BITS - used).alias("threshold"),
            )
        )
    return state.select("source", "full_copies", "threshold")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, hold_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents used, shares reached).

    Documents: doc_id, source, tokens, copies (1 or more). Shares: one row per target source with its share of the
    mix. Documents of no listed source are not used. Repeated rows of one doc_id are used alike. hold_shares: as for
    budgets().
    """
    counts = cut(token_counts(documents, tokenizer))
    hist = cut(histogram(counts))
    plan = cut(budgets(hist, targets, hold_shares))
    at = thresholds(counts, plan, hist)
    used = counts.join(broadcast_if_small(at), "source").withColumn("copies", F.col("full_copies") + (F.col("h") < F.col("threshold")).cast("bigint")).where("copies > 0").select("doc_id", "source", "tokens", "copies")
    sums = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("used_docs"), F.max("copies").alias("most_copies"))
    whole = sums.agg(F.sum("used_tokens").alias("n"))
    reached = plan.join(sums, "source", "left").select(
        "source", "target_share", "max_repeats", "reachable", F.coalesce("used_docs", F.lit(0)).alias("used_docs"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.try_divide(F.col("used_tokens"), whole.scalar()), F.lit(0.0)), 6).alias("reached_share"),
    )
    return used, reached
