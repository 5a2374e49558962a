"""Column expressions over names: samples, files, genes, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE = r"^([A-Z]{2})_([A-Z0-9]+)\.(\d+)\.slice(\d+)$"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """A capture group, NULL where the pattern isn't found."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def sample_fields(sample: Column) -> Column:
    """STRUCT(species, condition, replicate, slice) of ``<SP>_<COND>.<rep>.slice<n>``; NULL fields where it isn't one."""
    return F.struct(
        _group(sample, SAMPLE, 1).alias("species"),
        _group(sample, SAMPLE, 2).alias("condition"),
        _group(sample, SAMPLE, 3).cast("int").alias("replicate"),
        _group(sample, SAMPLE, 4).cast("int").alias("slice"),
    )


def zone(condition: Column, slice_: Column, legacy: bool = True) -> Column:
    """Fibrotic for slices 16 to 24 of MI14D, Remote for 1 to 13, Sham for all else.

    legacy=False gives slices 14 and 15 of MI14D as Border, and NULL where condition or slice is NULL.
    """
    infarct = condition == "MI14D"
    first = F.when(infarct & slice_.between(16, 24), "Fibrotic").when(infarct & slice_.between(1, 13), "Remote")
    if legacy:
        return first.otherwise("Sham")
    return first.when(infarct & slice_.isNotNull(), "Border").when(condition.isNotNull() & slice_.isNotNull(), "Sham")


def profile_label(condition: Column, replicate: Column) -> Column:
    """Sham, or ``MI day 14 rep. NN``."""
    return F.when(condition == "SHAM", "Sham").otherwise(F.format_string("MI day 14 rep. %02d", replicate))


def strip_prefix(text: Column, prefix: str = "gene:") -> Column:
    """Without one leading prefix."""
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 2**31 - 1)).otherwise(text)


def file_barcode(name: Column) -> Column:
    """The 8-base barcode in a file name: at its start, between underscores, or at the end of its stem."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.coalesce(*[_group(stem, p) for p in (r"^([ACGT]{8})_", r"_([ACGT]{8})_", r"_([ACGT]{8})$")])


def file_barcode_any(name: Column) -> Column:
    """A barcode of any length of A C G T N: at the name's start before an underscore, else between two underscores."""
    return F.coalesce(_group(name, r"^([ACGTN]+)_"), _group(name, r"_([ACGTN]+)_"))


def file_slice_id(name: Column) -> Column:
    return _group(name, r"bcode_(\d+)").cast("int")


def sample_from_name(name: Column) -> Column:
    """The second underscore part of what stands before the first dot."""
    return F.get(F.split(F.substring_index(name, ".", 1), "_"), F.lit(1))


def sanitized(name: Column) -> Column:
    """Each white space to ``_``, then each ``-.`` run to ``_``."""
    return F.regexp_replace(F.regexp_replace(name, r"\s", "_"), r"[-.]+", "_")


def short_path(path: Column, parts: int = 3) -> Column:
    """The last parts of a path."""
    return F.substring_index(path, "/", -parts)


def ensembl_gene(header: Column) -> Column:
    """Gene name of an Ensembl FASTA header: of its only gene or locus token; NULL with none or several."""
    tokens = F.filter(F.split(header, r"\s+"), lambda t: t.rlike("(gene|locus)[:=]"))
    token = F.get(tokens, F.lit(0))
    return F.when(F.size(tokens) == 1, F.get(F.split(token, F.when(token.contains("="), "=").otherwise(":")), F.lit(1)))


def ncbi_gene(header: Column) -> Column:
    """NCBI FASTA header without its isoform mark; where there was one, without the accession too.

    The mark is ``isoform`` with a run of digits, commas, blanks and capitals up to a blank; other words behind
    ``isoform`` stay, and so does the accession.
    """
    without = F.regexp_replace(header, r"isoform [0-9, A-Z]+ ", "")
    return F.when(without != header, F.regexp_replace(without, r"^\s*\S+\s+", "")).otherwise(header)


def is_ncbi(header: Column) -> Column:
    """Whether a header looks like NCBI's: an NP_, XP_, YP_ or WP_ accession and a closing bracket."""
    return header.rlike(r"^>?(NP_|XP_|YP_|WP_)") & header.endswith("]")


def before_last_dot(header: Column) -> Column:
    return F.regexp_replace(header, r"\.[^.]*$", "")


def first_token(header: Column) -> Column:
    return F.substring_index(header, " ", 1)


def without_version(tx: Column) -> Column:
    """A transcript id without its version suffix."""
    return F.regexp_replace(tx, r"\..*$", "")
