"""Queries over count tables, names and statistics, and their SQL. Doubles are rounded so that engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicelake.functions import names
from slicelake.operators import counts as C
from slicelake.operators import dispersion
from slicelake.operators import normalize as N
from slicelake.operators import series as S
from slicelake.operators import stats as T
from slicelake.operators import views as V
from slicelake.session import cut, table


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(table(spark, d, "counts"))


def library_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts summed to libraries: sample is species_condition.replicate."""
    c = _latest(spark, d).where("count IS NOT NULL")
    sample = F.concat("species", F.lit("_"), "condition", F.lit("."), "replicate")
    return c.groupBy("gene_id", sample.alias("sample"), "species", "condition", "replicate").agg(F.sum("count").alias("count"))


def _r(c: str | Column, n: int = 6) -> Column:
    return F.round(c, n)


def counts_latest(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select("gene_id", "sample", "count", "loaded_at")


def gene_counts(spark: SparkSession, d: str) -> DataFrame:
    """Transcript quantities derived from the delivered counts, summed to genes."""
    c = table(spark, d, "counts").where("count IS NOT NULL")
    quant = c.select("sample", F.concat(names.strip_prefix(F.col("gene_id")), F.lit("."), "replicate").alias("name"), F.col("count").alias("num_reads"), (F.col("count") / 10).alias("tpm"), (F.col("slice") + 100.0).alias("effective_length"))
    genes = c.select(names.strip_prefix(F.col("gene_id")).alias("gene_id"))
    tx2gene = genes.select(F.col("gene_id").alias("transcript_id"), "gene_id").distinct()
    return C.gene_sums(quant, tx2gene).select("gene_id", "sample", _r("count").alias("count"), _r("abundance").alias("abundance"), _r("length").alias("length"))


def expression_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.expression_filter(_latest(spark, d), 2, 30).select("gene_id", "sample", "count")


def sample_subset(spark: SparkSession, d: str) -> DataFrame:
    return C.sample_subset(_latest(spark, d), "MI14D", 16, 24).select("gene_id", "sample", "count")


def _orthologs(spark: SparkSession, d: str) -> DataFrame:
    """A one-to-one map over most of the delivered genes."""
    g = _latest(spark, d).select("gene_id").distinct().where(~F.col("gene_id").endswith("7"))
    return g.select(F.col("gene_id").alias("mus_id"), _acomys().alias("acomys_id"), F.concat(F.lit("S"), F.right("gene_id", F.lit(4))).alias("symbol"))


def _acomys() -> Column:
    """The other species' id of a mouse gene."""
    return F.concat(F.lit("ACOG"), F.right("gene_id", F.lit(11)))


def ortholog_map(spark: SparkSession, d: str) -> DataFrame:
    """Counts under each species' own gene ids, brought to the mouse's."""
    own = _latest(spark, d).withColumn("gene_id", F.when(F.col("species") == "AC", _acomys()).otherwise(F.col("gene_id")))
    return C.map_orthologs(own, _orthologs(spark, d)).select("gene_id", "symbol", "species", "sample", "count")


def marker_expression(spark: SparkSession, d: str) -> DataFrame:
    """Counts of marker genes; some genes are markers of two classes."""
    last = F.right("gene_id", F.lit(1)).cast("int")
    genes = _latest(spark, d).select("gene_id").distinct()
    markers = genes.where(last < 3).select("gene_id", F.lit("matrix").alias("classification")).unionByName(genes.where(last.between(2, 4)).select("gene_id", F.lit("signal").alias("classification")))
    return V.marker_expression(_latest(spark, d), markers).select("gene_id", "classification", "sample", "count")


def combine_intersect(spark: SparkSession, d: str) -> DataFrame:
    c = _latest(spark, d)
    return C.combine(c, F.concat("species", "condition", F.col("replicate").cast("string"))).select("gene_id", "sample", "count")


GROUPS = ["AC_MI14D", "AC_SHAM", "MM_MI14D", "MM_SHAM"]


def _wide(spark: SparkSession, d: str) -> DataFrame:
    c = _latest(spark, d).withColumn("grp", F.concat("species", F.lit("_"), "condition"))
    return C.wide(c, GROUPS, "grp")


def count_matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    m = _wide(spark, d)
    return m.select("gene_id", *[_r(c).alias(c) for c in GROUPS])


def count_matrix_long(spark: SparkSession, d: str) -> DataFrame:
    return C.long(_wide(spark, d), "grp").select("gene_id", "grp", _r("count").alias("count"))


def size_factors(spark: SparkSession, d: str) -> DataFrame:
    return N.size_factors(C.expression_filter(library_counts(spark, d), 2, 6)).select("sample", _r("size_factor").alias("size_factor"))


def normalized_counts(spark: SparkSession, d: str) -> DataFrame:
    lib = library_counts(spark, d)
    factors = N.size_factors(C.expression_filter(lib, 2, 6))
    return N.log2_normalized(N.normalized(lib, factors)).select("gene_id", "sample", _r("normalized", 4).alias("normalized"), _r("log2_norm").alias("log2_norm"))


def log_cpm(spark: SparkSession, d: str) -> DataFrame:
    return N.log_cpm(library_counts(spark, d)).select("gene_id", "sample", _r("log_cpm").alias("log_cpm"))


def slice_means(spark: SparkSession, d: str) -> DataFrame:
    c = N.slice_means(_latest(spark, d).where("count IS NOT NULL"), "count")
    return c.withColumn("mean", _r("mean"))


def z_scores(spark: SparkSession, d: str) -> DataFrame:
    m = N.slice_means(_latest(spark, d).where("count IS NOT NULL"), "count")
    return N.z_scores(m, "mean", ["gene_id", "species"]).select("gene_id", "species", "condition", "slice", _r("z").alias("z"))


def sample_parse_zone(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").select("sample", names.sample_fields(F.col("sample")).alias("f"))
    return s.select("sample", "f.species", "f.condition", "f.replicate", "f.slice", names.zone(F.col("f.condition"), F.col("f.slice")).alias("zone"), names.zone(F.col("f.condition"), F.col("f.slice"), False).alias("strict_zone"))


def input_report(spark: SparkSession, d: str) -> DataFrame:
    return C.input_report(_latest(spark, d), table(spark, d, "samples"))


def densified(spark: SparkSession, d: str) -> DataFrame:
    return C.densify(library_counts(spark, d)).groupBy("sample").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("count") == 0).alias("zeros"))


def fill_down(spark: SparkSession, d: str) -> DataFrame:
    return S.fill_down(table(spark, d, "samples"), "zone", "slice", ["sample_id"]).select("sample", "zone")


def replicate_renumber(spark: SparkSession, d: str) -> DataFrame:
    return S.renumber_replicates(table(spark, d, "samples")).select("sample", "replicate")


def _tests(spark: SparkSession, d: str) -> DataFrame:
    """A p value and a fold change for each order, of which some have none."""
    p = F.when(F.col("o_orderkey") % 97 != 0, (F.col("o_orderkey") % 997) / 1000)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("gene_id"), p.alias("p"), (((F.col("o_custkey") % 41) - 20) / 20).alias("log2fc"))


def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    return T.bh_adjust(_tests(spark, d)).select("gene_id", _r("padj", 8).alias("padj"))


def volcano_points(spark: SparkSession, d: str) -> DataFrame:
    return V.volcano_points(_tests(spark, d), "p").select("gene_id", "nlp", "lfc", "significance", "legend_order")


STRUCTURAL = ["lemon", "almond"]


def gene_sets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 11 == 0, "Col").when(F.col("p_partkey") % 13 == 0, "xMetallo").otherwise(""), F.get(F.split("p_name", " "), F.lit(0))).alias("symbol"))
    return s.select("p_partkey", V.gene_set(F.col("symbol"), STRUCTURAL).alias("gene_set"))


def profile_points(spark: SparkSession, d: str) -> DataFrame:
    c = _latest(spark, d).where("count IS NOT NULL")
    return V.profile_points(c, "count", _orthologs(spark, d).select(F.col("mus_id").alias("gene_id")))


def sample_distance(spark: SparkSession, d: str) -> DataFrame:
    return T.sample_distances(N.log_cpm(library_counts(spark, d)), "log_cpm").withColumn("distance", _r("distance", 5))


def slice_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances between all slices of all samples, over every gene."""
    return T.sample_distances(N.log_cpm(_latest(spark, d).where("count IS NOT NULL")), "log_cpm").withColumn("distance", _r("distance", 5))


def sample_tree(spark: SparkSession, d: str) -> DataFrame:
    return T.complete_linkage(sample_distance(spark, d))


def sample_pca(spark: SparkSession, d: str) -> DataFrame:
    return T.pca(N.log_cpm(library_counts(spark, d)), "log_cpm").withColumns({"score": _r("score", 5), "share": _r("share", 5)})


def nb_wald(spark: SparkSession, d: str) -> DataFrame:
    lib = C.sample_subset(library_counts(spark, d), "MI14D")
    lib = cut(lib)  # used for the factors, the filter and the fit
    return T.nb_wald(C.expression_filter(lib, 10, 4), N.size_factors(C.expression_filter(lib, 2, 6)), "MM")


def nb_wald_shrunk(spark: SparkSession, d: str) -> DataFrame:
    lib = cut(C.sample_subset(library_counts(spark, d), "MI14D"))
    return dispersion.nb_wald_shrunk(C.expression_filter(lib, 10, 4), N.size_factors(C.expression_filter(lib, 2, 6)), "MM")


def nb_dispersion(spark: SparkSession, d: str) -> DataFrame:
    """Means and dispersions of the genes that nb_wald tests."""
    return nb_wald(spark, d).select("gene_id", _r("base_mean").alias("base_mean"), _r("dispersion").alias("dispersion"))


def longest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return S.longest_per_group(table(spark, d, "documents"), "source", F.col("n_chars"), "doc_id", ["doc_id", "n_chars"])


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return S.duplicate_keys(table(spark, d, "r2_reads").where("header_line <> ''"), ["header_line"])


def tag_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.top_values(table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL"), "lang", "source", 5)


def anti_set(spark: SparkSession, d: str) -> DataFrame:
    busy = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(busy, "c_custkey", "left_anti").select("c_custkey", "c_name")


def union_append(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "r1_reads").select("sample_id", F.lit("R1").alias("mate"))
    b = table(spark, d, "r2_reads").select("sample_id", F.lit("R2").alias("mate"))
    return a.unionByName(b).groupBy("sample_id", "mate").agg(F.count(F.lit(1)).alias("reads"))


def multimapping(spark: SparkSession, d: str) -> DataFrame:
    al = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_suppkey").cast("string").alias("gene_id"))
    return C.multimapping_filter(al).groupBy("gene_id").agg(F.count(F.lit(1)).alias("alignments"))


def fasta_names(spark: SparkSession, d: str) -> DataFrame:
    """Gene names from headers of several forms."""
    h = F.col("header")
    return part_headers(spark, d).select("p_partkey", names.ensembl_gene(h).alias("gene"), names.ncbi_gene(h).alias("ncbi_gene"), names.first_token(h).alias("token"), names.before_last_dot(h).alias("stem"), names.is_ncbi(h).alias("ncbi"))


def part_headers(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, header): FASTA headers over parts, with gene or locus tokens, two of them, or in NCBI's form."""
    k, name = F.col("p_partkey"), F.get(F.split("p_name", " "), F.lit(0))
    form = [
        F.concat(F.lit("ENSP"), k, F.lit("."), k % 3, F.lit(" pep gene:"), name, F.lit(" kind:"), F.col("p_brand")),
        F.concat(F.lit("tr"), k, F.lit(" locus="), name),
        F.concat(F.lit("tr"), k, F.lit(" locus="), name, F.lit(" gene:"), name),
        F.concat(F.lit("NP_"), k, F.lit(".1 "), name, F.lit(" isoform X"), k % 7, F.lit(" [Mus musculus]")),
        F.concat(F.lit("XP_"), k, F.lit(".1 "), name, F.lit(" isoform alpha [Acomys]")),
    ]
    header = F.when(k % 5 == 0, form[0]).when(k % 5 == 1, form[1]).when(k % 5 == 2, form[2]).when(k % 5 == 3, form[3]).otherwise(form[4])
    return table(spark, d, "part").select("p_partkey", header.alias("header"))


def de_gene_set(spark: SparkSession, d: str) -> DataFrame:
    """Test results of the parts of some kinds, as a gene set's."""
    genes = V.with_prefix(table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), "p_type"), "p_type", "PROMO")
    return V.in_gene_set(_tests(spark, d), genes, "gene_id").select("gene_id", "p_type", "p")


def labelled_points(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("gene_id"))
    return V.labelled(V.volcano_points(_tests(spark, d), "p"), "gene_id", some).select("gene_id", "nlp", "label")


_ALL = (de_gene_set, labelled_points, counts_latest, gene_counts, expression_filter, sample_subset, ortholog_map, marker_expression, combine_intersect, count_matrix_wide, count_matrix_long, size_factors, normalized_counts, log_cpm, slice_means, z_scores, sample_parse_zone, input_report, densified, fill_down, replicate_renumber, bh_adjust, volcano_points, gene_sets, profile_points, sample_distance, slice_distance, sample_tree, sample_pca, nb_wald, nb_wald_shrunk, nb_dispersion, longest_per_group, duplicate_keys, tag_topk, anti_set, union_append, multimapping, fasta_names)
QUERIES = {f.__name__: f for f in _ALL}

_L = """l AS (SELECT * EXCLUDE (rn, gene_id), g AS gene_id FROM (SELECT *, regexp_replace(gene_id, '^gene:', '') AS g,
 row_number() OVER (PARTITION BY regexp_replace(gene_id, '^gene:', ''), sample ORDER BY loaded_at DESC NULLS LAST, count DESC NULLS LAST) AS rn FROM counts WHERE gene_id IS NOT NULL AND sample IS NOT NULL) WHERE rn = 1)"""
_LIB = _L + """, lib AS (SELECT gene_id, species || '_' || condition || '.' || replicate AS sample, species, condition, replicate, sum(count) AS count FROM l WHERE count IS NOT NULL GROUP BY ALL)"""
SIZE_FACTORS = _LIB + """, expr AS (SELECT gene_id FROM lib GROUP BY 1 HAVING sum(cast(count >= 2 AS INT)) >= 6),
e AS (SELECT * FROM lib WHERE gene_id IN (SELECT gene_id FROM expr)), pos AS (SELECT gene_id, sample, ln(count) AS lc FROM e WHERE count > 0),
lg AS (SELECT gene_id, avg(lc) AS lg FROM pos GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample) FROM e)),
sf AS (SELECT sample, exp(median(lc - lg)) AS size_factor FROM pos JOIN lg USING (gene_id) GROUP BY 1)"""
_CPM = _LIB + ", tot AS (SELECT sample, sum(count) AS t FROM lib GROUP BY 1), cpm AS (SELECT gene_id, sample, ln(1 + count / t * 1e6) AS v FROM lib JOIN tot USING (sample))"
_CPM_ALL = _L + ", tot AS (SELECT sample, sum(count) AS t FROM l WHERE count IS NOT NULL GROUP BY 1), cpm AS (SELECT gene_id, sample, CASE WHEN t = 0 THEN NULL ELSE ln(1 + count / t * 1e6) END AS v FROM l JOIN tot USING (sample) WHERE count IS NOT NULL)"
_DIST = """, n AS (SELECT sample, sum(v * v) AS n FROM cpm GROUP BY 1 HAVING sum(v * v) > 0), dot AS (SELECT a.sample AS sa, b.sample AS sb, sum(a.v * b.v) AS dot FROM cpm a JOIN cpm b USING (gene_id) WHERE a.sample < b.sample GROUP BY 1, 2)
SELECT x.sample AS sample_a, y.sample AS sample_b, round(sqrt(greatest(x.n + y.n - 2 * coalesce(dot, 0), 0)), 5) AS distance FROM n x JOIN n y ON x.sample < y.sample LEFT JOIN dot ON sa = x.sample AND sb = y.sample"""
_PAIRS, _LAST = _DIST.rsplit("\n", 1)
# the state of a step: distances left, and each cluster's name, number and size
_TREE = _PAIRS + ", pd AS (" + _LAST + """), nm AS (SELECT sample AS s, -row_number() OVER (ORDER BY sample) AS id FROM n),
t AS (SELECT 0 AS step, 0::BIGINT AS l, 0::BIGINT AS r, 0.0::DOUBLE AS height, 0::BIGINT AS size, (SELECT list({'d': distance, 'a': sample_a, 'b': sample_b}) FROM pd) AS pairs, (SELECT list({'s': s, 'id': id, 'n': 1::BIGINT}) FROM nm) AS names
 UNION ALL
 SELECT step + 1, x.id, y.id, m.d, x.n + y.n,
  (SELECT list({'d': d, 'a': a, 'b': b}) FROM (SELECT max(d) AS d, least(a2, b2) AS a, greatest(a2, b2) AS b FROM
   (SELECT u.d, CASE WHEN u.a = m.b THEN m.a ELSE u.a END AS a2, CASE WHEN u.b = m.b THEN m.a ELSE u.b END AS b2 FROM (SELECT unnest(pairs) AS u)) WHERE a2 <> b2 GROUP BY 2, 3)),
  list_transform(names, lambda k: CASE WHEN k.s = m.a THEN {'s': k.s, 'id': step + 1, 'n': x.n + y.n} ELSE k END)
 FROM (SELECT *, list_filter(names, lambda k: k.s = m.a)[1] AS x, list_filter(names, lambda k: k.s = m.b)[1] AS y FROM (SELECT *, list_min(pairs) AS m FROM t WHERE len(pairs) > 0)))
SELECT step, l AS left, r AS right, height, size FROM t WHERE step > 0"""
# size factors of the two species' infarct libraries, and moments of each gene within each species
_NB = SIZE_FACTORS.replace("lib AS (", "every AS (").replace(", expr AS", ", lib AS (SELECT * FROM every WHERE condition = 'MI14D'), expr AS") + """,
c AS (SELECT gene_id, species, count / size_factor AS y, 1 / size_factor AS inv FROM lib JOIN sf USING (sample) WHERE size_factor > 0 AND gene_id IN (SELECT gene_id FROM lib GROUP BY 1 HAVING sum(cast(count >= 10 AS INT)) >= 4)),
m AS (SELECT gene_id, count(*) AS k, avg(y) AS m, var_pop(y) * count(*) AS ss, avg(inv) AS inv FROM c GROUP BY gene_id, species),
v AS (SELECT gene_id, sum(ss - (k - 1) * m * inv) FILTER (WHERE k > 1) AS more, sum((k - 1) * m * m) FILTER (WHERE k > 1) AS under FROM m GROUP BY 1)
SELECT gene_id, round(base_mean, 6) AS base_mean, round(CASE WHEN under > 0 THEN least(greatest(more / under, 1e-8), 10) ELSE 1e-8 END, 6) AS dispersion FROM v JOIN (SELECT gene_id, avg(y) AS base_mean FROM c GROUP BY 1) USING (gene_id)"""
_ORTH = "o AS (SELECT DISTINCT gene_id AS mus_id, 'S' || right(gene_id, 4) AS symbol FROM l WHERE NOT ends_with(gene_id, '7'))"
PART_HEADERS = """h AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS name, CASE p_partkey % 5
 WHEN 0 THEN 'ENSP' || p_partkey || '.' || (p_partkey % 3) || ' pep gene:' || string_split(p_name, ' ')[1] || ' kind:' || p_brand
 WHEN 1 THEN 'tr' || p_partkey || ' locus=' || string_split(p_name, ' ')[1] WHEN 2 THEN 'tr' || p_partkey || ' locus=' || string_split(p_name, ' ')[1] || ' gene:' || string_split(p_name, ' ')[1]
 WHEN 3 THEN 'NP_' || p_partkey || '.1 ' || string_split(p_name, ' ')[1] || ' isoform X' || (p_partkey % 7) || ' [Mus musculus]' ELSE 'XP_' || p_partkey || '.1 ' || string_split(p_name, ' ')[1] || ' isoform alpha [Acomys]' END AS header FROM part)"""
_WIDE = "w AS (SELECT gene_id, " + ", ".join(f"sum(count) FILTER (WHERE species || '_' || condition = '{g}') AS {g}" for g in GROUPS) + " FROM l GROUP BY 1)"
_TESTS = "t AS (SELECT o_orderkey AS gene_id, CASE WHEN o_orderkey % 97 <> 0 THEN (o_orderkey % 997) / 1000.0e0 END AS p, ((o_custkey % 41) - 20) / 20.0e0 AS log2fc FROM orders)"
_MEAN = _L + ", m AS (SELECT gene_id, species, condition, slice, avg(count) AS mean FROM l WHERE count IS NOT NULL GROUP BY ALL)"

SQL = {
    "de_gene_set": f"WITH {_TESTS} SELECT gene_id, p_type, p FROM t JOIN part ON p_partkey = gene_id WHERE starts_with(p_type, 'PROMO')",
    "labelled_points": f"WITH {_TESTS} SELECT gene_id, CASE WHEN p IS NULL THEN NULL WHEN p = 0 THEN 50 ELSE round_even(least(-log10(p), 50), 2) END AS nlp, CASE WHEN gene_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000) THEN gene_id END AS label FROM t",
    "counts_latest": f"WITH {_L} SELECT gene_id, sample, count, loaded_at FROM l",
    "gene_counts": "SELECT regexp_replace(gene_id, '^gene:', '') AS gene_id, sample, round(sum(count), 6) AS count, round(sum(count / 10), 6) AS abundance, round(CASE WHEN sum(count / 10) = 0 THEN avg(slice + 100.0) ELSE sum((slice + 100.0) * (count / 10)) / sum(count / 10) END, 6) AS length FROM counts WHERE count IS NOT NULL AND gene_id IS NOT NULL GROUP BY 1, 2",
    "expression_filter": f"WITH {_L} SELECT gene_id, sample, count FROM l WHERE gene_id IN (SELECT gene_id FROM l GROUP BY 1 HAVING sum(cast(count >= 2 AS INT)) >= 30)",
    "sample_subset": f"WITH {_L} SELECT gene_id, sample, count FROM l WHERE condition = 'MI14D' AND slice BETWEEN 16 AND 24",
    "ortholog_map": f"WITH {_L}, {_ORTH} SELECT gene_id, symbol, species, sample, count FROM l JOIN o ON gene_id = mus_id",
    "marker_expression": f"WITH {_L}, m AS (SELECT *, cast(right(gene_id, 1) AS INT) AS k FROM l) SELECT gene_id, 'matrix' AS classification, sample, count FROM m WHERE k < 3 UNION ALL SELECT gene_id, 'signal', sample, count FROM m WHERE k BETWEEN 2 AND 4",
    "combine_intersect": f"WITH {_L}, k AS (SELECT *, species || condition || replicate AS grp FROM l) SELECT gene_id, sample, count FROM k WHERE gene_id IN (SELECT gene_id FROM k GROUP BY 1 HAVING count(DISTINCT grp) = (SELECT count(DISTINCT grp) FROM k))",
    "count_matrix_wide": f"WITH {_L}, {_WIDE} SELECT gene_id, " + ", ".join(f"round({g}, 6) AS {g}" for g in GROUPS) + " FROM w",
    "count_matrix_long": f"WITH {_L}, {_WIDE} " + " UNION ALL ".join(f"SELECT gene_id, '{g}' AS grp, round({g}, 6) AS count FROM w" for g in GROUPS),
    "size_factors": f"WITH {SIZE_FACTORS} SELECT sample, round(size_factor, 6) AS size_factor FROM sf",
    "normalized_counts": f"WITH {SIZE_FACTORS} SELECT gene_id, sample, round(count / size_factor, 4) AS normalized, round(log2(count / size_factor + 0.5), 6) AS log2_norm FROM lib JOIN sf USING (sample)",
    "log_cpm": f"WITH {_CPM} SELECT gene_id, sample, round(v, 6) AS log_cpm FROM cpm",
    "slice_means": f"WITH {_MEAN} SELECT gene_id, species, condition, slice, round(mean, 6) AS mean FROM m",
    "z_scores": f"WITH {_MEAN} SELECT gene_id, species, condition, slice, round((mean - avg(mean) OVER w) / nullif(stddev_samp(mean) OVER w, 0), 6) AS z FROM m WINDOW w AS (PARTITION BY gene_id, species)",
    "sample_parse_zone": r"""WITH p AS (SELECT sample, regexp_extract(sample, '^([A-Z]{2})_([A-Z0-9]+)\.(\d+)\.slice(\d+)$', ['species', 'condition', 'replicate', 'slice']) AS f FROM samples),
q AS (SELECT sample, nullif(f.species, '') AS species, nullif(f.condition, '') AS condition, TRY_CAST(f.replicate AS INT) AS replicate, TRY_CAST(f.slice AS INT) AS slice FROM p)
SELECT *, CASE WHEN condition = 'MI14D' AND slice BETWEEN 16 AND 24 THEN 'Fibrotic' WHEN condition = 'MI14D' AND slice BETWEEN 1 AND 13 THEN 'Remote' ELSE 'Sham' END AS zone,
CASE WHEN condition = 'MI14D' AND slice BETWEEN 16 AND 24 THEN 'Fibrotic' WHEN condition = 'MI14D' AND slice BETWEEN 1 AND 13 THEN 'Remote' WHEN condition = 'MI14D' AND slice IS NOT NULL THEN 'Border' WHEN condition IS NOT NULL AND slice IS NOT NULL THEN 'Sham' END AS strict_zone FROM q""",
    "input_report": f"WITH {_L} SELECT count(*) AS rows, count(DISTINCT gene_id) AS genes, count(DISTINCT sample) AS samples, count_if(count IS NULL) AS null_counts, (SELECT count(DISTINCT sample) FROM l WHERE sample NOT IN (SELECT sample FROM samples)) AS not_in_samples, (SELECT count(DISTINCT sample) FROM samples WHERE sample NOT IN (SELECT sample FROM l)) AS not_in_counts FROM l",
    "densified": f"WITH {_LIB} SELECT s.sample, count(*) AS cells, count_if(coalesce(count, 0) = 0) AS zeros FROM (SELECT DISTINCT sample FROM lib) s CROSS JOIN (SELECT DISTINCT gene_id FROM lib) g LEFT JOIN lib ON lib.sample = s.sample AND lib.gene_id = g.gene_id GROUP BY 1",
    "fill_down": "SELECT sample, last_value(zone IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS zone FROM samples",
    "replicate_renumber": "SELECT sample, CASE WHEN replicate = max(replicate) OVER (PARTITION BY species, condition) THEN 2 ELSE 1 END AS replicate FROM samples",
    "bh_adjust": f"WITH {_TESTS}, r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS i, count(*) OVER () AS n FROM t WHERE p IS NOT NULL), a AS (SELECT gene_id, least(1, min(p * n / i) OVER (ORDER BY p DESC)) AS padj FROM r) SELECT t.gene_id, round(padj, 8) AS padj FROM t LEFT JOIN a USING (gene_id)",
    "volcano_points": f"""WITH {_TESTS}, v AS (SELECT gene_id, CASE WHEN p IS NULL THEN NULL WHEN p = 0 THEN 50 ELSE round_even(least(-log10(p), 50), 2) END AS nlp, round_even(log2fc, 2) AS lfc FROM t),
s AS (SELECT *, CASE WHEN nlp IS NULL OR lfc IS NULL THEN NULL WHEN nlp >= 1.3 AND lfc > 0.4 THEN 'sig_up' WHEN nlp >= 1.3 AND lfc < -0.4 THEN 'sig_down' ELSE 'not_sig' END AS significance FROM v)
SELECT *, CASE significance WHEN 'sig_up' THEN 1 WHEN 'sig_down' THEN 2 WHEN 'not_sig' THEN 3 END AS legend_order FROM s""",
    "gene_sets": "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'Col' WHEN p_partkey % 13 = 0 THEN 'xMetallo' ELSE '' END || string_split(p_name, ' ')[1] AS symbol FROM part) SELECT p_partkey, CASE WHEN starts_with(symbol, 'Col') THEN 'collagen' WHEN contains(lower(symbol), 'metallo') THEN 'metallo' WHEN symbol IN ('lemon', 'almond') THEN 'structural' WHEN symbol IS NOT NULL THEN 'other' END AS gene_set FROM s",
    "profile_points": f"WITH {_L}, {_ORTH}, p AS (SELECT gene_id, species, CASE WHEN condition = 'SHAM' THEN 'Sham' ELSE printf('MI day 14 rep. %02d', replicate) END AS label, slice, round_even(count, 1) AS value FROM l WHERE count IS NOT NULL AND gene_id IN (SELECT mus_id FROM o)) SELECT *, max(value) OVER (PARTITION BY gene_id) AS top FROM p",
    "sample_distance": f"WITH {_CPM}" + _DIST,
    "slice_distance": f"WITH {_CPM_ALL}" + _DIST,
    "sample_tree": f"WITH RECURSIVE {_CPM}" + _TREE,
    "nb_dispersion": f"WITH {_NB}",
    "longest_per_group": "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rn FROM documents) WHERE rn = 1 OR source IS NULL",
    "duplicate_keys": "SELECT header_line, count(*) AS n FROM r2_reads WHERE header_line <> '' GROUP BY 1 HAVING count(*) > 1",
    "tag_topk": "SELECT lang, source, n, rank FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS rank FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) WHERE rank <= 5",
    "anti_set": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "union_append": "SELECT sample_id, mate, count(*) AS reads FROM (SELECT sample_id, 'R1' AS mate FROM r1_reads UNION ALL SELECT sample_id, 'R2' FROM r2_reads) GROUP BY 1, 2",
    "multimapping": "SELECT cast(l_suppkey AS VARCHAR) AS gene_id, count(*) AS alignments FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <= 2) GROUP BY 1",
    "fasta_names": f"""WITH {PART_HEADERS} SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN name END AS gene, CASE p_partkey % 5 WHEN 3 THEN name || ' [Mus musculus]' ELSE header END AS ncbi_gene,
 string_split(header, ' ')[1] AS token, CASE WHEN contains(header, '.') THEN substr(header, 1, length(header) - strpos(reverse(header), '.')) ELSE header END AS stem, p_partkey % 5 >= 3 AS ncbi FROM h""",
}
