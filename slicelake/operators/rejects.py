"""Rows that fail to parse: permissive load of delimited R2 records, with the reason for each failure.

Every line is read permissively under an explicit schema (nothing is dropped, the raw text stays beside the
fields); lines the reader cannot be trusted with - those with quotes or line breaks - are split again by the
strict format, and every row then gets the first failing check as its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicelake.functions.materialize import computed

FIELDS = ("record_no", "header_line", "seq_line", "plus_line", "qual_line")
READ_SCHEMA = T.StructType([T.StructField(f, T.DecimalType(38, 0) if f == "record_no" else T.StringType()) for f in FIELDS] + [T.StructField("corrupt", T.StringType())])
#: Most fields of a line that the CSV reader gets.
MOST_FIELDS = 10
#: Unicode non-characters, which no text may hold: a comma and a quote inside a quoted field.
COMMA, QUOTE = "﷐", "﷑"


def quoting_ok(parts: Column) -> Column:
    """Whether each field is free of quotes or wholly enclosed in them, inner quotes doubled.

    parts: the line split at its double quotes; pieces at even places stand outside quotes. Pass a computed column,
    as it is looked at once for each piece.
    """
    last = F.size(parts) - 1

    def outside_ok(x: Column, i: Column) -> Column:
        opens = x.endswith(",") | (x == "")
        closes = x.startswith(",") | (x == "")
        return F.when(i % 2 == 1, True).when(i == 0, opens).when(i == last, closes).otherwise(opens & closes)

    checked = F.transform(parts, outside_ok)
    return (last == 0) | ((last % 2 == 0) & F.forall(checked, lambda ok: ok))


def strict_fields(parts: Column) -> Column:
    """Fields of a line whose quoting is right, as an array of any length; parts as for quoting_ok."""
    last = F.size(parts) - 1

    def piece(x: Column, i: Column) -> Column:
        escaped = (x == "") & (i > 0) & (i < last)
        return F.when(i % 2 == 1, F.replace(x, F.lit(","), F.lit(COMMA))).when(escaped, F.lit(QUOTE)).otherwise(x)

    joined = F.array_join(F.transform(parts, piece), "")
    return F.transform(F.split(joined, ",", -1), lambda f: F.translate(f, COMMA + QUOTE, ',"'))


def read_permissive(raw: DataFrame, line_col: str = "raw_line") -> DataFrame:
    """Adds ``fields`` (array of strings, NULL where the line can't be split) and ``quoting_fails``.

    A line without quotes and line breaks goes through Spark's permissive CSV reader under the explicit schema,
    which keeps rows of a wrong width or with a number that isn't one as corrupt text; those and all others are split
    by the strict format. So are
    lines of more than MOST_FIELDS fields, as beyond 20,480 the reader fails in every mode.
    One carriage return at the end of a line is dropped. NULL lines have no fields.
    """
    line = F.regexp_replace(F.col(line_col), r"\r\z", "")
    plain = ~F.contains(F.col("_line"), F.lit('"')) & ~F.rlike(F.col("_line"), F.lit(r"[\r\n]"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "quote": '"', "escape": '"', "nullValue": "\ufdd2", "emptyValue": "", "maxCharsPerColumn": "-1"}
    schema = READ_SCHEMA.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    out = computed(raw, _line=line)
    few = F.size(F.split("_line", ",", MOST_FIELDS + 1)) <= MOST_FIELDS
    read = F.from_csv(F.when(plain & few, F.col("_line")), F.lit(schema), options)
    parts = F.when(plain, F.lit(None)).otherwise(F.split("_line", '"', -1))
    out = computed(out, _read=read, _parts=parts)
    out = computed(out, quoting_fails=F.coalesce(~quoting_ok(F.col("_parts")), F.lit(False)))
    clean = F.col("_read.corrupt").isNull() & F.col("_read.qual_line").isNotNull()
    # the number as written, as the reader takes more for a number than the format does
    loaded = F.array(F.substring_index("_line", ",", 1), *[F.coalesce(F.col(f"_read.{f}"), F.lit("")) for f in FIELDS[1:]])
    fields = F.when(F.col("_line").isNull() | (F.col("_line") == "") | F.col("quoting_fails"), F.lit(None)).when(clean, loaded).when(F.col("_parts").isNull(), F.split("_line", ",", -1)).otherwise(strict_fields(F.col("_parts")))
    return computed(out, fields=fields).drop("_line", "_read", "_parts")


def classify(raw: DataFrame, line_col: str = "raw_line") -> DataFrame:
    """Adds the five typed fields and ``reason``, the first check that fails, NULL for a valid row.

    Checks, in order: quoting, column_count (NULL and empty lines too), record_no, header_line, seq_line,
    plus_line, qual_line. Columns of the input that bear a field's name are replaced. Ties cannot occur: each
    row is judged alone, so repeated rows give repeated results; an empty table gives an empty one. record_no is
    DECIMAL(38, 0); a number of more digits is valid too and stands in record_no_long, as text.
    """
    rows = read_permissive(raw.drop(*[c for c in (*FIELDS, "record_no_long") if c != line_col]), line_col)
    f = {name: F.get(F.col("fields"), F.lit(i)) for i, name in enumerate(FIELDS)}
    reason = (
        F.when(F.col("quoting_fails"), "quoting")
        .when(F.coalesce(F.size("fields"), F.lit(-1)) != len(FIELDS), "column_count")
        .when(~F.rlike(f["record_no"], F.lit(r"\A0*[1-9][0-9]*\z")), "record_no")
        .when(~F.rlike(f["header_line"], F.lit(r"\A@[^ :]*:[^ :]*:[^ :]*:[0-9]+:[0-9]+:[0-9]+:[0-9]+(?: |\z)")), "header_line")
        .when(~F.rlike(f["seq_line"], F.lit(r"\A[ACGTN]+\z")), "seq_line")
        .when(f["plus_line"] != "+", "plus_line")
        .when((F.length(f["qual_line"]) != F.length(f["seq_line"])) | ~F.rlike(f["qual_line"], F.lit(r"\A[!-~]+\z")), "qual_line")
    )
    number = F.when(f["record_no"].rlike(r"\A[0-9]+\z"), F.regexp_replace(f["record_no"], r"\A0+(?=.)", ""))
    typed = {name: f[name] for name in FIELDS} | {"record_no": number.try_cast("decimal(38,0)"), "record_no_long": F.when(F.length(number) > 38, number)}
    return rows.withColumn("reason", reason).withColumns(typed).drop("fields", "quoting_fails")


def valid_records(raw: DataFrame, line_col: str = "raw_line") -> DataFrame:
    """The rows that pass every check, loaded as R2 records beside the other columns."""
    return classify(raw, line_col).where(F.col("reason").isNull()).drop("reason", line_col)


def rejected_rows(raw: DataFrame, line_col: str = "raw_line") -> DataFrame:
    """The rows that fail, raw text kept, with the reason."""
    return classify(raw, line_col).where(F.col("reason").isNotNull()).drop(*FIELDS, "record_no_long")
