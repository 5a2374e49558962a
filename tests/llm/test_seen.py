import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slicelake.llm import seen
from slicelake.llm.elias_fano import EliasFano, SeenSet


@given(st.lists(st.integers(0, 2**20 - 1), max_size=400), st.lists(st.integers(0, 2**20 - 1), min_size=1, max_size=60))
@settings(deadline=None)
def test_elias_fano_matches_a_set(values, probes):
    v = np.unique(np.array(values, dtype=np.uint64))
    ef = EliasFano(v, 20)
    assert (ef.decode() == v).all()
    rank, found = ef.successor(np.array(probes, dtype=np.uint64))
    assert found.tolist() == [p in set(values) for p in probes]
    assert all(r == np.searchsorted(v, np.uint64(p)) for p, r, f in zip(probes, rank, found) if f)


def test_space_is_near_the_bound_and_wide_universes_work():
    rng = np.random.default_rng(1)
    v = np.unique(rng.integers(0, 2**56, 50_000, dtype=np.uint64))
    ef = EliasFano(v, 56)
    assert ef.bits / len(v) < 2 + 56 - np.log2(len(v)) + 4
    assert ef.successor(v)[1].all() and not ef.successor(v[:1000] + np.uint64(1))[1].any()


def test_merging_batches():
    rng, s, all_ = np.random.default_rng(2), SeenSet(40), set()
    for _ in range(60):
        b = np.unique(rng.integers(0, 5000, 100, dtype=np.uint64))
        assert s.seen(b).tolist() == [int(x) in all_ for x in b]
        s.add(b[~s.seen(b)])
        all_ |= {int(x) for x in b}
    assert s.n == len(all_) and len(s.runs) < 15


def answers(spark, rows, **kw):
    df = spark.createDataFrame(rows, "read_id long, k string")
    return sorted((r["read_id"], r["seen"]) for r in seen.seen_before(df.repartition(3), "read_id", [F.col("k")], **kw).collect())


def brute(rows):
    out = []
    for i, k in rows:
        if i is not None and k is not None:
            out.append((i, any(k2 == k and i2 is not None and i2 < i for i2, k2 in rows)))
    return sorted(out)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 40)), st.one_of(st.none(), st.sampled_from(["", "a", "b", "hot", "hot", "x" * 1000]))), max_size=80))
def test_answers_match_brute_force_with_ties_and_nulls(spark, rows):
    assert answers(spark, rows) == brute(rows)


def test_small_batches_and_a_hot_key(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i // 2, "hot" if i % 3 else f"k{i % 50}") for i in range(400)]
        assert answers(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_bits_give_wrong_answers_and_they_are_counted(spark):
    df = spark.range(4000).select(F.col("id").alias("read_id"), F.col("id").cast("string").alias("k"))
    r = seen.error_report(df, "read_id", [F.col("k")], bits=12).first()
    assert r["records"] == r["keyed"] == 4000 and r["wrong"] == r["seen"] > 100
    assert seen.error_report(df, "read_id", [F.col("k")]).first()["wrong"] == 0
    assert seen.error_report(df.limit(0), "read_id", [F.col("k")]).first()["wrong_rate"] == 0


def test_header_keys(spark):
    cases = {"@N:1:F:2:007:8:9 1:N": "2:7:8:9", "@N:1:F:2:7:8:9\r": "2:7:8:9", ":1:2:3:4": "1:2:3:4", "1:2:3:4": None, "@N:1:F:2:7:8:y9": None, "@N:1:F:2:7:: x": None, "": None, "a:0:00:000:0": "0:0:0:0", "@N:a b:1:2:3:4": None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "h string, want string")
    assert df.where(~seen.read_key(F.col("h")).eqNullSafe(F.col("want"))).count() == 0


def test_words_of_a_set_restore_it():
    v = np.unique(np.random.default_rng(3).integers(0, 2**40, 3000, dtype=np.uint64))
    for values in (v, v[:1], v[:0]):
        ef = EliasFano(values, 40)
        back = EliasFano.from_words(ef.n, 40, ef.low.tobytes(), ef.high.tobytes())
        assert (back.decode() == values).all() and (back.successor(v)[1] == np.isin(v, values)).all()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.sampled_from("abcdefgh"), st.just("hot")), max_size=60), st.integers(0, 60), st.sampled_from([0, 3]))
def test_stored_sets_answer_as_the_keys_would(spark, keys, cut_at, part_bits):
    rows = [(i // 2, k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "read_id long, k string")
    earlier, later = df.where(F.col("read_id") < cut_at // 2), df.where(F.col("read_id") >= cut_at // 2)
    kw = {"key": [F.col("k")], "part_bits": part_bits}
    stored = seen.stored_sets(earlier, **kw)
    got = sorted((r["read_id"], r["seen"]) for r in seen.seen_since(stored, later.repartition(3), "read_id", **kw).collect())
    assert got == [x for x in brute(rows) if x[0] >= cut_at // 2]
    merged = seen.merged_sets(stored, later, **kw)
    assert sum(r["n"] for r in merged.collect()) == len({k for k in keys if k is not None})
    assert {(r["part"], r["n"], bytes(r["low"]), bytes(r["high"])) for r in merged.collect()} == {(r["part"], r["n"], bytes(r["low"]), bytes(r["high"])) for r in seen.stored_sets(df, **kw).collect()}


def test_large_partitions_are_stored_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(seen, "MOST_STORED", 100)
    keys = np.unique(np.random.default_rng(5).integers(0, 2**48, 1050, dtype=np.uint64))
    rows = list(seen._rows_of(3, keys, 48).to_pylist())
    assert [r["n"] for r in rows] == [100] * 10 + [50]
    assert (np.concatenate([EliasFano.from_words(r["n"], 48, r["low"], r["high"]).decode() for r in rows]) == keys).all()
