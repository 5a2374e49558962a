"""FASTQ files as tables, read by Spark's own input splits; and the sinks for reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.functions.reads import record_error

RECORD = "header_line string, seq_line string, plus_line string, qual_line string"


def _mark_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets head on the first row of each file, in the split that begins at its start."""
    now = None
    for b in batches:
        head = []
        for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            head.append(start == 0 and file != now)
            now = file
        yield pa.record_batch([b.column(0), b.column(2), pa.array(head, pa.bool_())], names=["file", "value", "head"])


def read_fastq(spark: SparkSession, path: str | list[str], tag: str = "@NS", name_filter: str | None = None, exact_heads: bool = False) -> DataFrame:
    """(file, header_line, seq_line, plus_line, qual_line, n_lines) of every record under ``path``.

    The text source splits files at line end plus ``tag``, so a record is read whole by the split it begins in and
    plain files are read in parallel; .gz and .zst files are read by their suffix, each by one task. ``tag`` must be one
    that no quality line begins with (an instrument prefix such as @NS; a lone @ is refused). Carriage returns
    are dropped. A record cut off at a file's end has NULL for the lines it lacks. What stands before a file's first
    tag is one record whose header lacks the tag, for the validator to report: it is told by its first line, which has
    no colon as ids behind a tag do; exact_heads=True tells it by its place in the file, for one pass through Python.
    Empty files give no rows.
    """
    if len(tag) < 2:
        raise ValueError("the tag must be longer than @, which quality lines may begin with")
    reader = spark.read.option("lineSep", "\n" + tag).option("recursiveFileLookup", "true")
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value"))
    if exact_heads:
        raw = raw.mapInArrow(_mark_heads, "file string, value string, head boolean")
        tagless = F.col("head")
    else:
        tagless = ~F.contains(F.substring_index("value", "\n", 1), F.lit(":"))
    # the first record of a file still bears the tag, which the separator took from all others
    body = F.regexp_replace(F.when(F.col("value").startswith("@") | tagless, F.col("value")).otherwise(F.concat(F.lit(tag), "value")), r"\n\z", "")
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    parts = raw.where("trim(value) <> ''").select("file", lines.alias("lines"))
    return parts.select("file", *[F.get("lines", F.lit(i)).alias(n) for i, n in enumerate(("header_line", "seq_line", "plus_line", "qual_line"))], F.size("lines").alias("n_lines"))


def records_of_text(files: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Records of FASTQ texts held in a column, four lines each, with record_no from 0.

    For texts whose tag is unknown: lines are grouped by four from the first. Missing lines of a cut-off tail are
    NULL; NULL and empty texts give no rows; carriage returns are dropped.
    """
    keep = keep or [c for c in files.columns if c != content]
    lines = F.split(F.regexp_replace(F.col(content), r"\r?\n\z", ""), r"\r?\n")
    some = files.where(F.col(content) != "").select(*keep, lines.alias("_lines"))
    numbered = some.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / 4).cast("int"))).alias("record_no"))
    at = F.col("record_no") * 4
    return numbered.select(*keep, "record_no", *[F.get("_lines", at + i).alias(n) for i, n in enumerate(("header_line", "seq_line", "plus_line", "qual_line"))])


def prefer_plain(files: DataFrame, path: str = "path") -> DataFrame:
    """Paths without the compressed twin of a path that is there uncompressed."""
    plain = files.select(F.col(path).alias("_plain")).distinct()
    stripped = F.regexp_replace(path, r"\.(gz|zst)$", "")
    twins = files.where(F.col(path).rlike(r"\.(gz|zst)$")).withColumn("_plain", stripped).join(plain, "_plain", "left_semi").select(path)
    return files.join(twins, path, "left_anti")


def mate(name: Column) -> Column:
    """R1 or R2 by file name, NULL for names of neither or both."""
    one, two = (name.rlike(rf"^R{i}_|_R{i}[_.]") for i in (1, 2))
    return F.when(one & ~two, "R1").when(two & ~one, "R2")


def text_of(df: DataFrame) -> DataFrame:
    """Each record as its four lines, the form the text sink writes."""
    return df.select(F.concat_ws("\n", "header_line", "seq_line", "plus_line", "qual_line").alias("value"))


def write_fastq(reads: DataFrame, path: str, compression: str = "gzip") -> None:
    text_of(reads).write.mode("errorifexists").option("compression", compression).text(path)


def write_by_barcode(reads: DataFrame, path: str, compression: str = "gzip") -> None:
    """One folder per slice_id and barcode.

    Rebalanced by them: Spark splits a hot barcode over as many tasks as its size asks for, and joins small ones
    (spark.sql.adaptive.advisoryPartitionSizeInBytes).
    """
    out = reads.select("slice_id", "barcode", F.concat_ws("\n", "header_line", "seq_line", "plus_line", "qual_line").alias("value")).hint("rebalance", "slice_id", "barcode")
    out.write.mode("errorifexists").partitionBy("slice_id", "barcode").option("compression", compression).text(path)


def write_split(reads: DataFrame, path: str, matched: str = "matched", compression: str = "gzip") -> None:
    """Matching and other records in two folders, from one pass."""
    out = reads.select(F.coalesce(F.col(matched), F.lit(False)).alias("matched"), F.concat_ws("\n", "header_line", "seq_line", "plus_line", "qual_line").alias("value"))
    out.write.mode("errorifexists").partitionBy("matched").option("compression", compression).text(path)


def quarantine(reads: DataFrame, path: str, tag: str = "@NS") -> None:
    """Records that fail validation, with the message, as Parquet."""
    bad = reads.withColumn("error", record_error(F.col("header_line"), F.col("seq_line"), F.col("plus_line"), F.col("qual_line"), tag))
    bad.where("error IS NOT NULL").write.mode("errorifexists").parquet(path)


def records_by(spark: SparkSession, path: str, folders: str) -> DataFrame:
    """(folder columns, records) of what the sinks wrote: lines counted in place of a second run of what made them."""
    lines = spark.read.schema(f"value string, {folders}").text(path)
    columns = [c for c in lines.columns if c != "value"]
    return lines.groupBy(*columns).agg(F.floor(F.count(F.lit(1)) / 4).alias("records"))


#: Suffixes of FASTQ files.
SUFFIXES = (".fastq", ".fq", ".fastq.gz", ".fq.gz", ".fastq.zst", ".fq.zst")


def file_error(name: Column, length: Column) -> Column:
    """What is wrong with a file by its name and length: ``not found`` (NULL length), ``empty``, ``unknown suffix``; NULL for none."""
    known = F.lit(False)
    for x in SUFFIXES:
        known |= name.endswith(x)
    return F.when(length.isNull(), "not found").when(length <= 0, "empty").when(~F.coalesce(known, F.lit(False)), "unknown suffix")


def validate_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, error) of the named files, without reading them; missing ones are listed as not found."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for p in paths:  # metadata only
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        rows.append((p, fs.getFileStatus(at).getLen() if fs.exists(at) and fs.getFileStatus(at).isFile() else None))
    return spark.createDataFrame(rows, "path string, length bigint").withColumn("error", file_error(F.col("path"), F.col("length")))
