from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from slicelake.operators import tree_agg as A


def brute(rows):
    out = defaultdict(lambda: [0, 0, 0, 0, [], []])
    for key, seq, qual in rows:
        k = key.strip().upper() if key is not None else None
        s = out[k]
        s[0] += 1
        s[1] += len(seq or "")
        s[2] += sum(ord(c) - 33 for c in qual or "")
        s[3] += len(qual or "")
        if seq is not None:
            s[4].append(len(seq))
    return {k: (v[0], v[1], v[2], v[3], min(v[4], default=None), max(v[4], default=None)) for k, v in out.items()}


def test_states_match_brute_force_with_a_hot_key(spark):
    rows = [(f" k{i % 7}\t" if i % 3 else "HOT", "ACGT" * (i % 5) if i % 11 else None, "I#" * (i % 4) if i % 13 else None) for i in range(3000)] + [(None, "A", "I"), (None, None, None), ("hot", "", "")]
    df = spark.createDataFrame(rows, "barcode_key string, seq_line string, qual_line string").withColumn("reads", F.lit("clash")).repartition(9)
    got = {r["key"]: tuple(r)[1:] for r in A.read_states(df, fan_in=2, max_states=5).select("key", "reads", "bases", "qual_sum", "qual_chars", "min_len", "max_len").collect()}
    assert got == brute(rows)


def test_empty_and_counts(spark):
    empty = spark.createDataFrame([], "barcode_key string, seq_line string, qual_line string")
    assert A.read_states(empty).count() == 0
    df = spark.range(1000).select((F.col("id") % 3).alias("a"))
    got = {r["a"]: r["rows"] for r in A.tree_count(df.repartition(20), ["a"], fan_in=3).collect()}
    assert got == {0: 334, 1: 333, 2: 333}


def test_heavy_keys_counts_keyless_rows(spark):
    states = spark.createDataFrame([("A", 5), ("B", 4), (None, 91)], "key string, reads bigint")
    total = spark.createDataFrame([(100,)], "total bigint")
    assert [tuple(r) for r in A.heavy_keys(states, "barcode_key", "key", total, 0.05).collect()] == [("barcode_key", "A")]


def test_slices_fold_barcodes(spark):
    states = A.read_states(spark.createDataFrame([("aa", "A", "I"), ("bb", "AC", "II"), ("cc", "A", "I"), ("dd", "A", "I")], "barcode_key string, seq_line string, qual_line string"))
    listed = spark.createDataFrame([("AA", 1), ("BB", 1), ("CC", None), ("AA", 1)], "barcode string, slice_id int")
    assert [(r["slice_id"], r["reads"], r["bases"]) for r in A.by_slice(states, listed).collect()] == [(1, 2, 3)]


def test_tree_has_levels_and_no_merge_takes_more_than_the_fan_in(spark, monkeypatch):
    # the rounds between tasks, with the fan-in as it comes: no grouping of any round gets more than 8 states of the hot key
    partials = spark.range(100).select(F.lit("HOT").alias("key"), F.lit(1).cast("long").alias("reads"), F.col("id").alias("chunk"))
    merged = A.merge_rounds(partials, ["key"], {"reads": "sum"}, 100)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    assert [tuple(r) for r in merged.collect()] == [("HOT", 100)]
    assert [tuple(r) for r in A.merge_rounds(partials, ["key"], {"reads": "sum"}, 0).collect()] == [("HOT", 100)]
    # the levels within a task
    taken, merge = [], A._merge
    monkeypatch.setattr(A, "_merge", lambda parts: taken.append(len(parts)) or merge(parts))
    rows = [("HOT" if i % 5 else f"k{i % 30}", "ACGT" * (i % 4) if i % 7 else None, "I#" * (i % 3) if i % 11 else None) for i in range(1030)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("k", "s", "q"), r)) for r in rows[i : i + 25]], pa.schema({"k": pa.string(), "s": pa.string(), "q": pa.string()})) for i in range(0, 1030, 25)]
    out = pa.Table.from_batches(A._combine_chunks(200_000, A.FAN_IN, 10)(iter(batches)))
    assert {r["key"]: tuple(r.values())[1:] for r in out.to_pylist()} == brute(rows) and out.num_rows == len(brute(rows))
    assert max(taken) == A.FAN_IN == 8 and len(taken) > 15


def test_few_states_held_in_the_levels_of_a_task():
    rows = [(f"k{i % 40}" if i % 4 else "HOT", "AC", "I") for i in range(500)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("k", "s", "q"), r)) for r in rows], pa.schema({"k": pa.string(), "s": pa.string(), "q": pa.string()}))
    out = pa.Table.from_batches(A._combine_chunks(30, 3, 7)(iter([batch])))
    total = out.group_by("key").aggregate([("reads", "sum"), ("bases", "sum")]).to_pylist()
    assert out.num_rows > 31 and {r["key"]: (r["reads_sum"], r["bases_sum"]) for r in total} == {k: v[:2] for k, v in brute(rows).items()}
