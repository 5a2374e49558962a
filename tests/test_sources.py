import gzip

import zstandard
from pyspark.sql import functions as F

from slicelake.operators.barcodes import hamming_ball
from slicelake.plans import pipelines
from slicelake.sources import fasta, fastq, tabular
from slicelake.streaming import reads_stream

REC = "@NS1:1:F:1:1:1:{i} 1:N\nACGTACGT\n+\n{q}\n"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = text.encode()
    path.write_bytes(gzip.compress(data) if path.suffix == ".gz" else zstandard.compress(data) if path.suffix == ".zst" else data)


def test_records_survive_splits_and_quality_lines_with_at(spark, tmp_path):
    text = "".join(REC.format(i=i, q="@@IIIII@" if i % 3 == 0 else "IIIIIIII") for i in range(3000))
    write(tmp_path / "in/a.fastq", text)
    write(tmp_path / "in/b.fastq.gz", text)
    write(tmp_path / "in/c.fastq.zst", text.replace("\n", "\r\n"))
    write(tmp_path / "in/empty.fastq", "")
    write(tmp_path / "in/cut.fastq", REC.format(i=0, q="IIIIIIII") + "@NS1:cut\nACG\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = fastq.read_fastq(spark, str(tmp_path / "in"))
        assert got.groupBy(F.element_at(F.split("file", "/"), -1).alias("f")).count().collect() and got.rdd.getNumPartitions() > 10
        per = {r["f"]: r["count"] for r in got.groupBy(F.element_at(F.split("file", "/"), -1).alias("f")).count().collect()}
        assert per == {"a.fastq": 3000, "b.fastq.gz": 3000, "c.fastq.zst": 3000, "cut.fastq": 2}
        whole = got.where("plus_line IS NOT NULL")
        assert whole.where("n_lines <> 4 OR seq_line <> 'ACGTACGT' OR plus_line <> '+' OR length(qual_line) <> 8 OR NOT startswith(header_line, '@NS1:1:F')").count() == 0
        tail = got.where("plus_line IS NULL").first()
        assert tail["header_line"] == "@NS1:cut" and tail["seq_line"] == "ACG" and tail["qual_line"] is None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq_round_trips(spark, tmp_path):
    rows = [(f"@NS:{i}", "ACGT", "+", "@III", i % 2, "ACGT" if i % 2 else "TTTT", i % 3 == 0) for i in range(50)]
    df = spark.createDataFrame(rows, "header_line string, seq_line string, plus_line string, qual_line string, slice_id int, barcode string, matched boolean")
    fastq.write_fastq(df, str(tmp_path / "all"))
    fastq.write_by_barcode(df, str(tmp_path / "by"))
    fastq.write_split(df, str(tmp_path / "split"))
    fastq.quarantine(df.withColumn("plus_line", F.when(F.col("header_line") == "@NS:1", "-").otherwise("+")), str(tmp_path / "bad"))
    lines = lambda p: spark.read.text(str(p)).count()
    assert lines(tmp_path / "all") == 200 and lines(tmp_path / "by/slice_id=1/barcode=ACGT") == 100 and lines(tmp_path / "split/matched=true") == 68
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    back = fastq.read_fastq(spark, str(tmp_path / "all"))
    assert back.count() == 50 and back.where("qual_line = '@III'").count() == 50


def test_records_of_text(spark):
    t = "@a\nAC\n+\n@I\n@b\nA\n"
    df = spark.createDataFrame([(1, t), (2, t.replace("\n", "\r\n")), (3, ""), (4, None)], "file_id int, content string")
    got = fastq.records_of_text(df).orderBy("file_id", "record_no").collect()
    assert [(r["file_id"], r["record_no"], r["header_line"], r["qual_line"]) for r in got] == [(1, 0, "@a", "@I"), (1, 1, "@b", None), (2, 0, "@a", "@I"), (2, 1, "@b", None)]


def test_file_lists(spark):
    paths = spark.createDataFrame([("x.fastq",), ("x.fastq.gz",), ("y.fastq.zst",)], "path string")
    assert {r[0] for r in fastq.prefer_plain(paths).collect()} == {"x.fastq", "y.fastq.zst"}
    named = spark.createDataFrame([("R1_a.fastq",), ("b_R2.fastq",), ("c_R1_R2_.fq",), ("d.fq",)], "n string").select(fastq.mate(F.col("n")))
    assert [r[0] for r in named.collect()] == ["R1", "R2", None, None]
    pairs = spark.createDataFrame([("R1_s1.fastq", "R1"), ("R2_s1.fastq", "R2")], "file_name string, mate string")
    assert tuple(tabular.paired_by_sample(pairs).first()) == ("s1", "R1_s1.fastq", "R2_s1.fastq")


def test_tables(spark, tmp_path):
    write(tmp_path / "b.tsv", "barcode\tid\ncatcacgc\t01\nACGTACGT\tx\n")
    b = tabular.read_barcodes(spark, str(tmp_path / "b.tsv"))
    assert [tuple(r) for r in b.collect()] == [("CATCACGC", 1), ("ACGTACGT", None)]
    assert {r[0] for r in tabular.query_sequences(spark, ["acg", "AXZ", "ACG"], b).collect()} == {"ACG", "CATCACGC", "ACGTACGT"}
    write(tmp_path / "d.json", '{"AA": ["AN", "NA"], "CC": []}')
    assert sorted(tuple(r) for r in tabular.read_dictionary(spark, str(tmp_path / "d.json")).collect()) == [("AA", "AN"), ("AA", "NA")]
    tabular.write_dictionary(hamming_ball(b, 1), str(tmp_path / "dict"))
    assert sorted(map(tuple, tabular.read_dictionary(spark, str(tmp_path / "dict")).collect())) == sorted((r["barcode"], r["variant"]) for r in hamming_ball(b, 1).collect())
    write(tmp_path / "pretty.json", '{\n "AA": ["AN"],\n "CC": ["CN"]\n}')
    assert tabular.read_dictionary(spark, str(tmp_path / "pretty.json"), one_line=False).count() == 2
    write(tmp_path / "a.gtf", '#x\n1\ts\ttranscript\t1\t9\t.\t+\t.\tgene_id "G1"; transcript_id "T1.2";\n')
    g = tabular.read_gtf(spark, str(tmp_path / "a.gtf")).first()
    assert (g["type"], g["gene_id"], g["transcript_id"], g["end"]) == ("transcript", "G1", "T1.2", 9)
    write(tmp_path / "q/bcode_1_CATCACGC_Salmon_quant.sf", "Name\tLength\tEffectiveLength\tTPM\tNumReads\nT1.2\t10\t8\t3\t5\n")
    q = tabular.read_quant(spark, str(tmp_path / "q")).first()
    assert (q["sample"], q["num_reads"]) == ("bcode_1_CATCACGC", 5.0)
    write(tmp_path / "m.tsv", "\tMM_SHAM.1.slice1\tb\ng1\t1\t\n")
    m = tabular.read_matrix(spark, str(tmp_path / "m.tsv"))
    assert m.columns == ["gene_id", "MM_SHAM.1.slice1", "b"] and m.first()[1:] == (1.0, None)
    tabular.write_matrix(m, str(tmp_path / "out"))
    assert tabular.read_matrix(spark, str(tmp_path / "out")).count() == 1
    assert tabular.read_positional(spark, str(tmp_path / "m.tsv"), 3).columns == ["V1", "V2", "V3"]
    log = tabular.demux_log(spark.createDataFrame([("AC", 1, 1234, 5.25), ("GT", None, 9, 0.1)], "barcode string, slice_id int, read_count long, pct double"))
    assert log.first()[0].startswith("AC (1)\t1,234\t5.")


def test_fasta(spark, tmp_path):
    write(tmp_path / "p.fa", ">P1 pep gene:G1.2\nMK\nL\n>P2 pep gene:G1.2\nMKLV\n>P3 pep gene:G1.2\nAAAA\n>P4 none\n\n")
    f = fasta.with_gene(fasta.read_fasta(spark, str(tmp_path / "p.fa")))
    assert [(r["header"], r["seq"], r["seq_len"]) for r in f.orderBy("ordinal").collect()] == [("P1 pep gene:G1.2", "MKL", 3), ("P2 pep gene:G1.2", "MKLV", 4), ("P3 pep gene:G1.2", "AAAA", 4), ("P4 none", "", 0)]
    best = fasta.primary_transcripts(f)
    assert sorted((str(r["gene"]), r["seq"]) for r in best.collect()) == [("G1.2", "MKLV"), ("None", "")]
    assert tuple(fasta.conservation(f, best).first()) == (2, 1, 1)
    assert sorted(r[0] for r in fasta.decoy_names(f).collect()) == ["P1", "P2", "P3", "P4"]  # a join before it keeps no order


def test_keys_and_headers_of_fasta(spark, tmp_path):
    ncbi = ">NP_1.1 kinase isoform X1 [Mus]\nMK\n>NP_2.1 kinase isoform X1 [Mus]\nMKL\n>NP_3.1 ligase [Mus]\nM\n>NP_4.1 ligase isoform alpha [Mus]\nMMM\n>NP_5.1 ligase isoform CRA_a [Mus]\nMMMM\n"
    write(tmp_path / "n.fa", ncbi)
    report = pipelines.primary_transcript_file(spark, str(tmp_path / "n.fa"), str(tmp_path / "out"))
    assert tuple(report.first()) == (4, 4, 0)
    got = sorted(r["header"] for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect())
    assert got == ["NP_2.1 kinase isoform X1 [Mus]", "NP_3.1 ligase [Mus]", "NP_4.1 ligase isoform alpha [Mus]", "NP_5.1 ligase isoform CRA_a [Mus]"]
    pipelines.primary_transcript_file(spark, str(tmp_path / "n.fa"), str(tmp_path / "out2"), "space")
    assert sorted(r["header"] for r in fasta.read_fasta(spark, str(tmp_path / "out2")).collect()) == ["NP_1.1", "NP_2.1", "NP_3.1", "NP_4.1", "NP_5.1"]
    write(tmp_path / "t.fa", ">P1 gene:A kind:x\nM\n>P2 gene:A kind:y\nM\n>P3 gene:B:2\nM\n")
    entries = fasta.with_gene(fasta.read_fasta(spark, str(tmp_path / "t.fa")), "last_dot")
    assert sorted(tuple(r) for r in fasta.tag_statistics(entries, 1).collect()) == [("gene", "A", 2, 1), ("kind", "x", 1, 1)]
    assert tuple(fasta.sequences_per_gene(fasta.with_gene(fasta.read_fasta(spark, str(tmp_path / "t.fa")))).first()) == (3, 2)


def test_what_stands_before_the_first_tag(spark, tmp_path):
    write(tmp_path / "in/a.fastq", "garbage\nACGT\n+\nIIII\n" + REC.format(i=1, q="IIIIIIII"))
    write(tmp_path / "in/b.fastq", REC.format(i=2, q="IIIIIIII") * 2)
    write(tmp_path / "in/c.fastq", "half:a:line\nACGT\n+\nIIII\n" + REC.format(i=1, q="IIIIIIII"))
    count = lambda **kw: {r["h"]: r["count"] for r in fastq.read_fastq(spark, str(tmp_path / "in"), **kw).groupBy(F.col("header_line").startswith("@NS").alias("h")).count().collect()}
    assert count() == {True: 5, False: 1} and count(exact_heads=True) == {True: 4, False: 2}
    report = {r["error"]: r["records"] for r in pipelines.integrity_check(spark, str(tmp_path / "in/a.fastq")).collect()}
    assert report == {"bad header": 1, "valid": 1}


def test_file_validation(spark, tmp_path):
    write(tmp_path / "a.fastq", "x")
    write(tmp_path / "b.fq.gz", "")
    write(tmp_path / "e.fastq", "")
    write(tmp_path / "c.txt", "x")
    names = [str(tmp_path / n) for n in ("a.fastq", "b.fq.gz", "e.fastq", "c.txt", "none.fastq")]
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in fastq.validate_files(spark, names).collect()}
    assert got == {"a.fastq": None, "b.fq.gz": None, "e.fastq": "empty", "c.txt": "unknown suffix", "none.fastq": "not found"}


def test_a_hot_barcode_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        hot = spark.range(20000).select(F.concat(F.lit("@NS"), "id").alias("header_line"), F.lit("ACGT").alias("seq_line"), F.lit("+").alias("plus_line"), F.md5(F.col("id").cast("string")).alias("qual_line"), F.lit(1).alias("slice_id"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("B"), F.col("id") % 7)).otherwise("HOT").alias("barcode"))
        fastq.write_by_barcode(hot.repartition(8), str(tmp_path / "out"), compression="none")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "out/slice_id=1/barcode=HOT").glob("part-*"))) >= 4
    assert fastq.records_by(spark, str(tmp_path / "out"), "slice_id int, barcode string").agg(F.sum("records")).first()[0] == 20000


def test_stream_counts_windows(spark, tmp_path):
    rows = [("@NS:1", "AC", "+", "II", " acgt\r", f"2031-01-01 0{h}:30:00", "s") for h in (1, 1, 2)] + [("@NX", "AC", "+", "II", "ACGT", "2031-01-01 01:00:00", "s"), ("@NS:1", "AC", "+", "II", None, None, "s")]
    df = spark.createDataFrame(rows, "header_line string, seq_line string, plus_line string, qual_line string, barcode_key string, sequenced_at string, sample_id string").withColumn("sequenced_at", F.to_timestamp("sequenced_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = reads_stream.stream_reads(spark, str(tmp_path / "in"), df.schema)
    q = reads_stream.counts_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["barcode"], r["reads"]) for r in spark.table("w").collect()) == [("ACGT", 1), ("ACGT", 2)]
    q = reads_stream.new_reads(stream).writeStream.outputMode("append").format("memory").queryName("n").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("n").count() == 2


def test_jobs_from_files_to_files(spark, tmp_path):
    head = "@NS1:1:F:1:1:1:{} 1:N"
    reads = lambda seqs: "".join(f"{head.format(i)}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs))
    write(tmp_path / "b.tsv", "barcode\tid\nAAAAAAAA\t01\nCCCCCCCC\t02\nGGGGGGGG\tx\n")
    write(tmp_path / "r1/R1_s1.fastq", reads(["AAAAAAAATTT", "AAAAAAANTTT", "CCCCCCCCTTT", "ACACACACTTT", "GGGGGGGGTTT"]))
    write(tmp_path / "r2/R2_s1.fastq", reads(["ACGTACGT"] * 6) + "@NS1:bad\nAX\n+\nII\n")
    summary = pipelines.demultiplex(spark, str(tmp_path / "r1"), str(tmp_path / "r2"), str(tmp_path / "b.tsv"), str(tmp_path / "out"))
    assert sorted((r["barcode"], r["read_count"], r["pct"]) for r in summary.collect()) == [("AAAAAAAA", 2, 33.3), ("CCCCCCCC", 1, 16.7), ("GGGGGGGG", 1, 16.7)]
    assert spark.read.text(str(tmp_path / "out/slice_id=1/barcode=AAAAAAAA")).count() == 8
    check = {r["error"]: r["records"] for r in pipelines.integrity_check(spark, str(tmp_path / "r2"), malformed_path=str(tmp_path / "bad")).collect()}
    assert check == {"valid": 6, "bad sequence": 1}
    totals = pipelines.match_edit(spark, str(tmp_path / "r2"), str(tmp_path / "m"), ["acgtacgt", "zz"], replacement="TT")
    assert tuple(totals.first()) == (7, 6, 1)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "m/matched=true")).collect()]
    assert lines.count("TT") == 6 and lines.count("II") == 6
    assert pipelines.barcode_permutations(spark, str(tmp_path / "b.tsv"), "aaaaaaaa").count() == 33
    write(tmp_path / "p.fa", ">P1 gene:G1\nMK\n>P2 gene:G1\nMKL\n>P3\nA\n")
    assert tuple(pipelines.primary_transcript_file(spark, str(tmp_path / "p.fa"), str(tmp_path / "fa")).first()) == (2, 1, 1)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "fa")).collect()) == [">G1", ">P3", "A", "MKL"]
