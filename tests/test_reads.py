import random

import pytest
from pyspark.sql import functions as F

from slicelake.functions import names
from slicelake.functions import reads as R
from slicelake.functions.materialize import computed
from slicelake.operators import barcodes as B
from slicelake.operators.trim import trim_and_filter

LIST = [("CATCACGC", 1), ("CATGATCG", 2), ("NACGTACG", 3), ("cattacgc", 4), (None, 5), ("CATCACGC", 9)]


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_first_failing_check(spark):
    rows = [("@NS1", "ACGTN", "+", "IIIII", None), (None, "A", "+", "I", 0), ("@NX", "B", "-", "", 1), ("@NS", "B", "-", "I", 2), ("@NS", "B", "+", "I", 3), ("@NS", "", "+", "", 3), ("@NS", "AC", "+", "I", 4), ("@NS", "A" * 100_000, "+", "I" * 100_000, None)]
    df = spark.createDataFrame(rows, "h string, s string, p string, q string, want int")
    got = df.select(R.record_error(*(F.col(c) for c in "hspq")).alias("e"), "want").collect()
    assert [r["e"] for r in got] == [None if r["want"] is None else R.ERRORS[r["want"]] for r in got]


def test_packed_keys(spark):
    cases = {"@N:1:F:4:23612:2000:1999 1:N": 103846678414493647, "@N:1:F:2:1:2:3": None, "@N:1:F:a:1:2:3": "null", "1:2:3:4": "null", "": "null", None: "null", "@N:1:F:3:1:2:3\r": None}
    df = col(spark, cases)
    got = {r["v"]: r["k"] for r in df.select("v", R.packed_read_key(F.col("v")).alias("k")).collect()}
    assert got["@N:1:F:4:23612:2000:1999 1:N"] == 103846678414493647
    assert got["@N:1:F:2:1:2:3"] < 0 and got["@N:1:F:3:1:2:3\r"] < 0
    assert all(got[k] is None for k, v in cases.items() if v == "null")


def brute_trim(q):
    good = [i for i in range(len(q) - 1) if q[i] + q[i + 1] >= 40]
    return (good[0] + 1, good[-1] + 2) if good else None


def test_trim_and_quality(spark):
    r = random.Random(1)
    quals = ["".join(chr(33 + r.choice((2, 10, 19, 20, 21, 30, 40))) for _ in range(r.randint(0, 30))) for _ in range(200)] + [""]
    df = computed(col(spark, quals), q=R.phred(F.col("v")))
    got = computed(df, t=R.trim_bounds(F.col("q"))).select("v", "t", R.passes_quality(F.col("v"), F.col("q"), 3).alias("ok")).collect()
    for row in got:
        q = [ord(c) - 33 for c in row["v"]]
        assert (tuple(row["t"]) if row["t"] else None) == brute_trim(q)
        assert row["ok"] == bool(q and sum(x < 20 for x in q) <= 0.25 * len(q) and sum(q) >= 27 * len(q) and row["v"].count("N") <= 3)


def test_batch_trimming_matches_the_rule(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        n = r.choice((0, 1, 2, 19, 20, 25, 40))
        rows.append((i, "".join(r.choices("ACGTN", [8, 8, 8, 8, 1], k=n)), "".join(chr(33 + r.choice((2, 19, 20, 21, 30, 40, 40, 40))) for _ in range(n))))
    rows += [(900, None, "I"), (901, "A", None), (902, "AC", "I"), (903, "é" * 30, "I" * 30)]
    want = {}
    for i, s, q in rows[:400]:
        v = [ord(c) - 33 for c in q]
        t = brute_trim(v)
        if t:
            s, q, v = s[t[0] - 1 : t[1]], q[t[0] - 1 : t[1]], v[t[0] - 1 : t[1]]
            if len(v) >= 20 and sum(x < 20 for x in v) <= 0.25 * len(v) and sum(v) >= 27 * len(v) and s.count("N") <= 3:
                want[i] = (s, q)
    df = spark.createDataFrame(rows, "read_id int, seq_line string, qual_line string").withColumn("first", F.lit("clash"))
    assert {x["read_id"]: (x["seq"], x["qual"]) for x in trim_and_filter(df).collect()} == want and len(want) > 20
    assert trim_and_filter(df.limit(0)).count() == 0


def test_golden_neighbourhoods(spark):
    barcodes = B.barcode_list(spark.createDataFrame(LIST, "barcode string, slice_id int"))
    assert {(r["barcode"], r["slice_id"]) for r in barcodes.collect()} == {("CATCACGC", 1), ("CATGATCG", 2), ("NACGTACG", 3), ("CATTACGC", 4)}
    assert B.hamming_ball(barcodes, 1).groupBy("barcode").count().where("count <> 33").count() == 0
    assert B.hamming_ball(barcodes, 2).groupBy("barcode").count().where("count <> 481").count() == 0
    assert B.hamming_ball(barcodes, 0).where("barcode = 'CATCACGC'").count() == 9
    with pytest.raises(Exception, match="not a barcode"):
        B.barcode_list(spark.createDataFrame([("AXG", 1)], "barcode string, slice_id int")).collect()


def test_repair_keeps_exact_and_leaves_ambiguous(spark):
    barcodes = spark.createDataFrame([("AAAAAAAA", 1), ("AAAAAATT", 2), ("CCCCCCCC", 3)], "barcode string, slice_id int")
    seqs = ["AAAAAAAA", "AAAAAAAT", "AAAAAATT", "NAAAAAAA", "CCCCCCCG", "GGGGGGGG", "", None, "CCCCCCCG"]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(seqs)], "i int, seq_line string, corrected string")
    got = {r["i"]: (r["exact"], r["corrected"]) for r in B.repair(df, barcodes).collect()}
    assert got == {0: (True, "AAAAAAAA"), 1: (False, None), 2: (True, "AAAAAATT"), 3: (False, "AAAAAAAA"), 4: (False, "CCCCCCCC"), 5: (False, None), 6: (False, None), 7: (False, None), 8: (False, "CCCCCCCC")}
    two = {r["i"]: r["corrected"] for r in B.repair(df, barcodes, max_hamming=2).collect()}
    assert two[0] == "AAAAAAAA" and two[2] == "AAAAAATT"
    assert B.repair(df.limit(0), barcodes).count() == 0


def test_demux_joins_mates_once(spark):
    h = "@NS:1:F:{}:1:1:{} 1:N"
    r1 = spark.createDataFrame([("s", h.format(1, 1), "B"), ("s", h.format(1, 1), "A"), ("s", h.format(3, 2), "A"), ("t", h.format(1, 1), "C"), ("s", "bad", "A"), ("s", h.format(1, 9), None)], "sample_id string, header_line string, corrected string")
    r2 = spark.createDataFrame([(1, "s", h.format(1, 1)), (2, "s", h.format(3, 2)), (3, "u", h.format(1, 1)), (4, "s", None), (5, "s", "bad"), (6, "s", h.format(1, 9)), (7, "s", h.format(1, 1))], "read_id int, sample_id string, header_line string")
    assert sorted((r["read_id"], r["barcode"]) for r in B.demux_r2(r2, r1).collect()) == [(1, "A"), (2, "A"), (7, "A")]


def test_names(spark):
    df = col(spark, ["MM_SHAM.1.slice1", "AC_MI14D.2.slice14", "AC_MI14D.2.slice20", "other", None])
    got = df.select(names.sample_fields(F.col("v")).alias("f"), names.zone(names.sample_fields(F.col("v"))["condition"], names.sample_fields(F.col("v"))["slice"]).alias("z")).collect()
    assert [r["z"] for r in got] == ["Sham", "Sham", "Fibrotic", "Sham", "Sham"]
    assert tuple(got[1]["f"]) == ("AC", "MI14D", 2, 14) and tuple(got[3]["f"]) == (None,) * 4
    heads = {"P1 pep gene:G1.2 x": "G1.2", "P2 gene=G2 y": "G2", "P3 locus:L3": "L3", "P4 gene:A locus:B": None, "P5": None}
    assert {r["v"]: r["g"] for r in col(spark, heads).select("v", names.ensembl_gene(F.col("v")).alias("g")).collect()} == heads
    ncbi = {"NP_1.2 kinase isoform X1 [Mus]": "kinase [Mus]", "NP_1.2 kinase [Mus]": "NP_1.2 kinase [Mus]"}
    assert {r["v"]: r["g"] for r in col(spark, ncbi).select("v", names.ncbi_gene(F.col("v")).alias("g")).collect()} == ncbi
    one = col(spark, ["bcode_93_CCATTTTA_AC_MI14D.3.dmplx.fastq"]).select(names.file_barcode(F.col("v")), names.file_slice_id(F.col("v")), names.sample_from_name(F.col("v"))).first()
    assert tuple(one) == ("CCATTTTA", 93, "93")
    assert col(spark, ["a b\tc--d.e"]).select(names.sanitized(F.col("v"))).first()[0] == "a_b_c_d_e"
