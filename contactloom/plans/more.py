"""Queries of filters, regions, axes and text formats, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions import text
from contactloom.operators import assembly, axis, calling, contacts, intervals, loops, models, rearrangements, sequences
from contactloom.operators.written import scratch, written
from contactloom.plans import commands
from contactloom.plans.relational import AXIS, RUNS, Query, _numbered_svs, _triples
from contactloom.sources import files, views
from contactloom.sources.views import loops_sql, with_views

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BOTH = """, sides AS (SELECT bin1_id, bin2_id, "count" FROM pixels UNION ALL SELECT bin2_id, bin1_id, "count" FROM pixels WHERE bin1_id <> bin2_id)"""


@query(with_views("pixels bins") + BOTH + """
SELECT bin1_id, bin2_id, "count" FROM sides JOIN bins a ON a.bin_id = bin1_id AND a.chrom = 'chr1' AND a.start < 50000 AND a."end" > 20000
JOIN bins b ON b.bin_id = bin2_id AND b.chrom = 'chr2' AND b.start < 30000 AND b."end" > 500""")
def region_block_fetch(spark: SparkSession, d: str) -> DataFrame:
    return contacts.fetch(views.pixels(spark, d), views.bins(spark), ("chr1", 20_000, 50_000), ("chr2", 500, 30_000))


@query(with_views("genes track", RUNS) + """, cut AS (SELECT key, chrom, p AS part, CAST(floor(start % 700 + p * ("end" - start) / 4.0) AS BIGINT) AS start, CAST(floor(start % 700 + (p + 1) * ("end" - start) / 4.0) AS BIGINT) AS "end" FROM (SELECT key, ['click', 'view', 'purchase', 'signup'][key % 4 + 1] AS chrom, start, "end" FROM genes), range(4) t(p)),
met AS (SELECT key, part, sum(value * (least(c."end", s."end") - greatest(c.start, s.start))) / sum(least(c."end", s."end") - greatest(c.start, s.start)) AS signal FROM cut c JOIN segments s ON c.chrom = s.chrom AND c.start < s."end" AND s.start < c."end" GROUP BY 1, 2)
SELECT key, CAST(part AS INTEGER) AS part, coalesce(signal, 0) AS signal FROM cut LEFT JOIN met USING (key, part)""")
def binned_signal(spark: SparkSession, d: str) -> DataFrame:
    g = views.genes(spark, d)
    names = F.array(*[F.lit(n) for n in ("click", "view", "purchase", "signup")])
    rows = g.select("key", F.get(names, (F.col("key") % 4).cast("int")).alias("chrom"), (F.col("start") % 700).alias("start"), (F.col("start") % 700 + F.col("end") - F.col("start")).alias("end"))
    return intervals.binned_means(rows, sequences.runs(views.track(spark, d)), 4, key="key", size=512)


NAMES = "names AS (SELECT o_orderkey AS id, CASE o_custkey % 27 WHEN 22 THEN 'chrX' WHEN 23 THEN 'chrY' WHEN 24 THEN 'chrM' WHEN 25 THEN 'chrUn_1' WHEN 26 THEN 'EBV' ELSE 'chr' || (o_custkey % 27 + 1) END AS chrom FROM orders)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey") % 27
    name = F.when(k < 22, F.concat(F.lit("chr"), (k + 1).cast("string")))
    for i, n in enumerate(("chrX", "chrY", "chrM", "chrUn_1", "EBV"), 22):
        name = name.when(k == i, n)
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), name.alias("chrom"))


@query(f"WITH {NAMES} SELECT id, chrom FROM names WHERE ltrim(chrom, 'chr') NOT IN ('M', 'Y', 'MT', 'EBV') AND NOT contains(chrom, '_')")
def chromosome_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return contacts.excluding(_names(spark, d))


@query(f"WITH {NAMES} SELECT id, chrom FROM names WHERE NOT regexp_matches(chrom, '_|M|X|Y|MT|EBV')")
def chromosome_substring_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return contacts.without_substrings(_names(spark, d))


@query(f"WITH {NAMES} SELECT DISTINCT chrom, CASE WHEN starts_with(chrom, 'chr') THEN chrom[4:] ELSE 'chr' || chrom END AS other, (SELECT CASE WHEN starts_with(min(chrom), 'chr') THEN 'chr' ELSE '' END FROM names) AS prefix FROM names")
def chromosome_prefix(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d)
    one = names.agg(text.prefix(F.col("chrom")).alias("prefix"))
    return names.select("chrom", text.toggled_chrom(F.col("chrom")).alias("other")).distinct().crossJoin(F.broadcast(one))  # one row


@query(with_views("pixels") + """, kept AS (SELECT * FROM pixels WHERE bin2_id - bin1_id >= 2), ends AS (SELECT bin1_id AS bin_id, "count" FROM kept UNION ALL SELECT bin2_id, "count" FROM kept) SELECT bin_id, CAST(sum("count") AS BIGINT) AS coverage, count(*) AS nnz FROM ends GROUP BY 1""")
def off_diagonal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return contacts.marginals(views.pixels(spark, d), 2)


COVER = """, ends AS (SELECT bin1_id AS bin_id, "count" FROM pixels WHERE bin1_id <> bin2_id UNION ALL SELECT bin2_id, "count" FROM pixels WHERE bin1_id <> bin2_id), cover AS (SELECT bin_id, sum("count") AS coverage, count(*) AS nnz FROM ends GROUP BY 1)"""


@query(with_views("pixels bins") + COVER + """, scaled AS (SELECT c.*, coverage / median(coverage) OVER (PARTITION BY chrom) AS x FROM cover c JOIN bins USING (bin_id)),
center AS (SELECT median(ln(x)) AS m FROM scaled), spread AS (SELECT median(abs(ln(x) - m)) AS s FROM scaled, center)
SELECT bin_id, chrom FROM scaled JOIN bins USING (bin_id), center, spread WHERE nnz >= 10 AND coverage >= 12 AND x >= exp(m - 2 * s)""")
def usable_bins(spark: SparkSession, d: str) -> DataFrame:
    return contacts.usable_bins(views.pixels(spark, d), views.bins(spark), 10, 12, 2.0).select("bin_id", "chrom")


@query(with_views("pixels") + """, ends AS (SELECT bin1_id AS bin_id, "count" FROM pixels UNION ALL SELECT bin2_id, "count" FROM pixels) SELECT avg(n) AS scale FROM (SELECT sum("count") AS n FROM ends GROUP BY bin_id)""")
def mean_marginal(spark: SparkSession, d: str) -> DataFrame:
    return contacts.mean_marginal(views.pixels(spark, d))


@query(with_views("pixels") + """, ends AS (SELECT bin1_id AS bin_id, "count" FROM pixels UNION ALL SELECT bin2_id, "count" FROM pixels) SELECT bin_id, CASE WHEN bin_id % 37 <> 0 THEN round(sqrt(sum("count")), 9) ELSE 0 END AS bias FROM ends GROUP BY 1""")
def bias_inverse(spark: SparkSession, d: str) -> DataFrame:
    """The bias of bins whose weight is one over the root of their coverage, and is null for masked ones."""
    cover = contacts.marginals(views.pixels(spark, d))
    weight = F.when(F.col("bin_id") % 37 != 0, 1 / F.sqrt("coverage"))
    return contacts.bias(cover.select("bin_id", weight.alias("weight"))).select("bin_id", F.round("bias", 9).alias("bias"))


@query(with_views("pixels bins") + """, g AS (SELECT sum(n) AS genome FROM (SELECT max("end") AS n FROM bins GROUP BY chrom)), t AS (SELECT CAST(sum("count") AS DOUBLE) AS total FROM pixels), x AS (SELECT 3031042417.0 / genome * total * (1000 / 5000.0) * 0.73256754 AS depth FROM g, t)
SELECT CAST(5000 AS INTEGER) AS size, round(depth, 3) AS depth, CAST(CASE WHEN abs(1000000 - depth) <= abs(20000000 - depth) THEN 1000000 ELSE 20000000 END AS INTEGER) AS chosen FROM x""")
def model_choice(spark: SparkSession, d: str) -> DataFrame:
    return contacts.model_choice(views.pixels(spark, d), views.bins(spark), views.BIN_SIZE, {5000: [1_000_000, 20_000_000], 25_000: [5_000_000]}).withColumn("depth", F.round("depth", 3))


def _axis(spark: SparkSession) -> DataFrame:
    return axis.axis(views.blocks(spark), views.bins(spark), views.BIN_SIZE)


#: The axes of all assemblies, and contacts on them.
AXES = """axes AS (SELECT assembly, "offset" + CASE WHEN strand = '+' THEN k - lo ELSE hi - 1 - k END AS idx, block, b.bin_id, x.chrom, b.start, b.weight FROM (SELECT *, unnest(range(lo, hi)) AS k FROM assembly_blocks) x JOIN bins b ON b.chrom = x.chrom AND b.start = k * 1000),
moved AS (SELECT a.assembly, least(a.idx, b.idx) AS i, greatest(a.idx, b.idx) AS j, CAST(sum("count") AS BIGINT) AS "count", sum("count" * coalesce(a.weight, 0) * coalesce(b.weight, 0)) AS balanced FROM pixels JOIN axes a ON a.bin_id = bin1_id JOIN axes b ON b.bin_id = bin2_id AND b.assembly = a.assembly GROUP BY 1, 2, 3)"""


def _axes(spark: SparkSession, d: str) -> DataFrame:
    return axis.axis(views.assembly_blocks(spark, d), views.bins(spark), views.BIN_SIZE, ("assembly",))


@query(with_views("pixels bins assembly_blocks", AXES) + "SELECT assembly, count(*) = count(DISTINCT bin_id) AS ok FROM axes GROUP BY 1")
def axis_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Which assemblies' axes hold no bin twice."""
    return axis.is_one_to_one(_axes(spark, d), ("assembly",))


@query(with_views("pixels bins assembly_blocks", AXES) + """SELECT assembly, i, j, "count", round(balanced, 9) AS balanced FROM moved""")
def keyed_axis_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts on the axes of all assemblies."""
    rows = axis.remapped(views.pixels(spark, d), _axes(spark, d), ("assembly",), views.bins(spark))
    return rows.withColumn("balanced", F.round("balanced", 9))


@query(with_views("pixels bins assembly_blocks", AXES) + """, s AS (SELECT assembly, j AS idx FROM moved WHERE "count" >= 2 GROUP BY 1, 2), n AS (SELECT assembly, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT DISTINCT x.assembly, x.idx FROM axes x LEFT JOIN n USING (assembly) LEFT JOIN s ON s.assembly = x.assembly AND s.idx = x.idx WHERE coalesce(n, 0) < 11 OR s.idx IS NOT NULL)
SELECT assembly, idx, CAST(row_number() OVER (PARTITION BY assembly ORDER BY idx) - 1 AS INTEGER) AS place FROM k""")
def keyed_gap_free(spark: SparkSession, d: str) -> DataFrame:
    """Places without gaps on the axes of all assemblies; sparse axes stay whole."""
    blocks, members = axis.classes(views.assembly_blocks(spark, d), "assembly")
    frame = axis.axis(blocks, views.bins(spark), views.BIN_SIZE, ("assembly",))
    moved = axis.remapped(views.pixels(spark, d), frame, ("assembly",)).where("count >= 2")
    return axis.for_members(written(axis.gap_free(moved, frame, ("assembly",)), "places"), members, "assembly")


CALLS = """calls AS (SELECT DISTINCT chrom1, start1, end1, chrom2, start2, end2, CAST(chrom1 <> chrom2 AS INTEGER) AS neo FROM loops)"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d, 1).select(*loops.KEY, "neo").distinct()


@query(with_views("pixels bins blocks", AXIS, loops_sql(1, "loops"), CALLS) + "SELECT * FROM calls WHERE (chrom1, start1) IN (SELECT (chrom, start) FROM axis) AND (chrom2, start2) IN (SELECT (chrom, start) FROM axis)")
def tight_axis_loops(spark: SparkSession, d: str) -> DataFrame:
    return axis.tight(_calls(spark, d), _axis(spark)).select(*loops.KEY, "neo")


@query(with_views("pixels bins blocks", AXIS, loops_sql(1, "loops"), CALLS) + """, near AS (SELECT c.*, c.chrom1 || ':' || c.start1 || '-' || c.chrom2 || ':' || c.start2 AS id, a.start AS at1, b.start AS at2, least(a.idx, b.idx) AS i, greatest(a.idx, b.idx) AS j, a.block AS block1, b.block AS block2 FROM calls c JOIN axis a ON a.chrom = c.chrom1 AND a.start BETWEEN c.start1 - 1000 AND c.end1 JOIN axis b ON b.chrom = c.chrom2 AND b.start BETWEEN c.start2 - 1000 AND c.end2),
cells AS (SELECT id, at1, at2, near.i, near.j, coalesce(moved."count", 0) AS n FROM near LEFT JOIN moved ON moved.i = near.i AND moved.j = near.j WHERE (block1 <> block2) = (neo = 1))
SELECT id, i, j, n AS "count" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, at1, at2) AS r FROM cells) WHERE r = 1""")
def loop_pixel_pick(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("chrom1"), F.lit(":"), F.col("start1"), F.lit("-"), F.col("chrom2"), F.lit(":"), F.col("start2"))
    frame = _axis(spark)
    return axis.picked(_calls(spark, d).withColumn("id", name), frame, axis.remapped(views.pixels(spark, d), frame), views.BIN_SIZE)


@query(with_views("track") + """SELECT 'chr' || chrom AS chrom, idx * 100 AS start, idx * 100 + 100 AS "end", CAST(value AS DOUBLE) AS value FROM track""")
def bedgraph_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "bedgraph")
    rows = views.track(spark, d).select("chrom", (F.col("idx") * 100).alias("start"), (F.col("idx") * 100 + 100).alias("end"), "value")
    files.write_bedgraph(rows, path)
    return files.bedgraph(spark, path)


@query(with_views("pixels bins", loops_sql(1, "loops")) + ", l AS (SELECT DISTINCT chrom1, start1, end1, chrom2, start2, end2, label || ',' || distance || ',' || CAST(chrom1 <> chrom2 AS INTEGER) AS t FROM loops) SELECT chrom1, start1, end1, chrom2, start2, end2, string_agg(t, ',' ORDER BY t) AS label FROM l GROUP BY ALL")
def loop_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "loops")
    files.write_loops(loops.labelled(_triples(spark, d, 1)), path)
    return files.loops(spark, path)


@query(with_views("genes") + """SELECT chrom, start, "end", replace(gene, ' ', '_') AS name, CAST(key AS DOUBLE) AS score, strand, '10,' || ("end" - start - 10) AS sizes FROM genes""")
def bed12_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, g = scratch(spark, "bed"), views.genes(spark, d)
    sizes = F.concat_ws(",", F.lit("10"), F.col("end") - F.col("start") - 10)
    g.select(F.concat_ws("\t", "chrom", "start", "end", F.replace("gene", F.lit(" "), F.lit("_")), "key", "strand", "start", "end", F.lit("0"), F.lit("2"), sizes, F.lit("0,10"))).write.text(path)
    return files.bed(spark, path).select("chrom", "start", "end", "name", "score", "strand", F.array_join("block_sizes", ",").alias("sizes"))


@query(with_views("sv") + """, p AS (SELECT ltrim(c1, 'chr') AS a, p1, ltrim(c2, 'chr') AS b, p2 FROM sv) SELECT DISTINCT CASE WHEN (a, p1) <= (b, p2) THEN a ELSE b END AS chrom1, CASE WHEN (a, p1) <= (b, p2) THEN p1 ELSE p2 END AS p1, CASE WHEN (a, p1) <= (b, p2) THEN b ELSE a END AS chrom2, CASE WHEN (a, p1) <= (b, p2) THEN p2 ELSE p1 END AS p2 FROM p""")
def peak_file_read(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "peaks")
    t = F.split("value", "\t")
    views.sv_lines(spark, d).select(F.concat_ws("\t", t[0], t[3], t[3], t[1], t[4], t[4])).write.text(path)
    return files.peaks(spark, path)


def _caller_lines(spark: SparkSession, d: str) -> DataFrame:
    t = F.split("value", "\t")
    end = lambda x: (x.cast("long") + 50).cast("string")
    size = F.when(t[3].cast("long") % 3 == 0, "5kb").otherwise("10kb")
    return views.sv_lines(spark, d).select(F.concat_ws("\t", F.lit("sv"), t[0], t[3], end(t[3]), F.substring(t[2], 1, 1), t[1], t[4], end(t[4]), F.substring(t[2], 2, 1), size).alias("value"))


@query(with_views("sv") + """, o AS (SELECT c1, CASE WHEN s1 = '+' THEN p1 + 50 ELSE p1 END AS p1, s1, c2, CASE WHEN s2 = '+' THEN p2 + 50 ELSE p2 END AS p2, s2 FROM sv WHERE p1 % 3 <> 0),
w AS (SELECT *, CASE WHEN c1 = c2 THEN p1 > p2 ELSE c1 > c2 END AS swap FROM o),
x AS (SELECT CASE WHEN swap THEN c2 ELSE c1 END AS c1, CASE WHEN swap THEN p2 ELSE p1 END AS p1, CASE WHEN swap THEN s2 ELSE s1 END AS s1, CASE WHEN swap THEN c1 ELSE c2 END AS c2, CASE WHEN swap THEN p1 ELSE p2 END AS p2, CASE WHEN swap THEN s1 ELSE s2 END AS s2 FROM w)
SELECT *, CASE WHEN c1 <> c2 THEN 'translocation' WHEN s1 || s2 = '+-' THEN 'deletion' WHEN s1 || s2 = '-+' THEN 'duplication' ELSE 'inversion' END AS note FROM x""")
def caller_table_read(spark: SparkSession, d: str) -> DataFrame:
    return rearrangements.from_caller(_caller_lines(spark, d))


@query(with_views("pixels bins") + """, t AS (SELECT least(a.cn, b.cn) AS k1, greatest(a.cn, b.cn) AS k2, sum("count" * a.weight * b.weight) AS total FROM pixels JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id WHERE a.chrom <> b.chrom AND a.weight > 0 AND b.weight > 0 GROUP BY 1, 2),
n AS (SELECT least(a.cn, b.cn) AS k1, greatest(a.cn, b.cn) AS k2, count(*) AS n FROM bins a JOIN bins b ON a.chrom < b.chrom AND a.weight > 0 AND b.weight > 0 GROUP BY 1, 2),
m AS (SELECT k1, k2, coalesce(total, 0) / n AS mean FROM n LEFT JOIN t USING (k1, k2)), f AS (SELECT k1, k2, mean / (SELECT mean FROM m WHERE k1 = 2 AND k2 = 2) AS factor FROM m)
SELECT bin1_id, bin2_id, "count", round("count" * coalesce(factor, 0), 9) AS simulated FROM pixels JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id LEFT JOIN f ON k1 = least(a.cn, b.cn) AND k2 = greatest(a.cn, b.cn) WHERE a.chrom <> b.chrom""")
def simulated_trans(spark: SparkSession, d: str) -> DataFrame:
    return models.simulated(views.pixels(spark, d), views.bins(spark), 2).withColumn("simulated", F.round("simulated", 9))


@query()
def simulated_cis(spark: SparkSession, d: str) -> DataFrame:
    return models.simulated_cis(views.pixels(spark, d), views.bins(spark), 2, 30)


@query()
def rare_copy_numbers(spark: SparkSession, d: str) -> DataFrame:
    coarse = sequences.runs(views.track(spark, d)).withColumnRenamed("value", "cn")
    return sequences.without_rare(coarse, 12).select("chrom", "start", "end", "cn")


@query()
def allele_slopes(spark: SparkSession, d: str) -> DataFrame:
    pixels, bins = views.pixels(spark, d), views.bins(spark)
    curve = models.isotonic_curve(contacts.expected(pixels, bins), views.PER_CHROM - 1)
    svs = _numbered_svs(spark, d).withColumn("c1", F.concat(F.lit("chr"), "c1")).withColumn("c2", F.concat(F.lit("chr"), "c2"))
    return assembly.allele_slopes(pixels, bins, svs, curve, 20_000, views.BIN_SIZE, 12_000, (8_000, 15_000, 20_000))


@query()
def assembled_chains(spark: SparkSession, d: str) -> DataFrame:
    return commands.every_line(_numbered_svs(spark, d), 400, 10, 3)


EXONS = """exons AS (SELECT *, [{'s': start + 50, 'e': start + 150}, {'s': start + 120, 'e': start + 300}, {'s': start + 50, 'e': start + 200}, {'s': "end" - 90, 'e': "end"}, {'s': start + 301, 'e': start + 302 + key % 200}] AS exons FROM genes)"""


@query(with_views("genes blocks", EXONS) + """, met AS (SELECT g.*, block, b.strand AS way, lo * 1000 AS bs, hi * 1000 AS be, "offset" * 1000 AS base FROM exons g JOIN blocks b ON g.chrom = b.chrom AND g.start < hi * 1000 AND lo * 1000 < g."end"),
body AS (SELECT *, base + CASE WHEN way = '+' THEN greatest(start, bs) - bs ELSE be - least("end", be) END AS lo, base + CASE WHEN way = '+' THEN least("end", be) - bs ELSE be - greatest(start, bs) END AS hi FROM met),
cut AS (SELECT *, list_transform(exons, lambda x: {'at': greatest(CASE WHEN way = '+' THEN base + x.s - bs ELSE base + be - x.e END, lo) - lo, 'stop': least(CASE WHEN way = '+' THEN base + x.e - bs ELSE base + be - x.s END, hi) - lo, 'size': x.e - x.s}) AS c FROM body),
kept AS (SELECT *, list_reduce(list_transform(list_sort(list_transform(list_filter(c, lambda x: x.at > 0 AND x.stop > x.at), lambda x: {'at': x.at, 'less': -x.size})), lambda x: [x]), lambda a, x: CASE WHEN len(a) > 0 AND x[1].at < a[-1].at - a[-1].less THEN a ELSE list_concat(a, x) END, CAST([] AS STRUCT("at" BIGINT, less BIGINT)[])) AS k FROM cut)
SELECT key AS id, gene, CAST(block AS INTEGER) AS block, lo, hi, CASE WHEN way = '+' THEN strand WHEN strand = '+' THEN '-' ELSE '+' END AS strand, array_to_string(list_transform(k, lambda x: x.at), ',') AS starts, array_to_string(list_transform(k, lambda x: -x.less), ',') AS sizes FROM kept""")
def gene_exons_lifted(spark: SparkSession, d: str) -> DataFrame:
    """Genes with exons on the axis."""
    s, e, k = F.col("start"), F.col("end"), F.col("key")
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    genes = views.genes(spark, d).withColumn("exons", F.array(pair(s + 50, s + 150), pair(s + 120, s + 300), pair(s + 50, s + 200), pair(e - 90, e), pair(s + 301, s + 302 + k % 200)))
    out = axis.lifted_genes(genes.withColumnRenamed("key", "id"), views.blocks(spark), views.BIN_SIZE)
    return out.select("id", "gene", "block", "lo", "hi", "strand", F.array_join("exon_starts", ",").alias("starts"), F.array_join("exon_sizes", ",").alias("sizes"))


@query(with_views("pixels bins blocks", AXIS) + """, b AS (SELECT idx, block FROM axis), c AS (SELECT m.i, m.j, "count" AS v, x.block AS bi, y.block AS bj FROM moved m JOIN b x ON x.idx = i JOIN b y ON y.idx = j),
met AS (SELECT a.i, a.j, o.i AS x, o.j AS y, row_number() OVER (PARTITION BY a.i, a.j ORDER BY o.v DESC, CASE WHEN o.i = a.i AND o.j = a.j THEN 0 ELSE 1 END, o.i, o.j) AS r FROM c a JOIN c o ON o.i BETWEEN a.i - 3 AND a.i + 3 AND o.j BETWEEN a.j - 3 AND a.j + 3 AND o.bi = a.bi AND o.bj = a.bj
WHERE a.v >= 2 AND a.i >= 3 AND a.j + 3 <= (SELECT max(idx) FROM b))
SELECT c.i, c.j, coalesce(x, c.i) AS to_i, coalesce(y, c.j) AS to_j FROM c LEFT JOIN met ON met.i = c.i AND met.j = c.j AND r = 1 WHERE v >= 2""")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    """Calls moved to the cell with the most contacts around them."""
    frame = _axis(spark)
    rows = axis.remapped(views.pixels(spark, d), frame).withColumnRenamed("count", "value")
    return calling.local_maxima(rows.where("value >= 2"), rows, frame, 3)


@query(with_views("pixels bins") + """SELECT a.chrom AS chrom1, b.chrom AS chrom2, bin1_id % 100 AS at1, bin2_id % 100 AS at2, "count" AS value FROM pixels JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id WHERE a.chrom = 'chr2'""")
def contact_table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Contacts written by pairs of chromosomes, and those of one first chromosome read back."""
    path = scratch(spark, "contacts")
    files.write_contacts(views.pixels(spark, d), views.bins(spark), path)
    return files.contacts(spark, path, "chr2")


@query(with_views("pixels bins") + """, ends AS (SELECT bin1_id AS bin_id, "count" FROM pixels UNION ALL SELECT bin2_id, "count" FROM pixels), c AS (SELECT bin_id, CAST(sum("count") AS BIGINT) AS cn FROM ends GROUP BY 1)
SELECT bin_id, chrom, start, c.cn FROM bins LEFT JOIN c USING (bin_id)""")
def bin_columns_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A column of bins put in another's place, as a second version, and read back."""
    path, bins = scratch(spark, "bins"), views.bins(spark)
    files.write_bins(bins, bins.select("bin_id", "weight"), path)
    cover = contacts.marginals(views.pixels(spark, d)).select("bin_id", F.col("coverage").alias("cn"))
    files.write_bins(bins, cover, path, converged=True)
    return files.read_version(spark, path).select("bin_id", "chrom", "start", "cn")


@query("""SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS idx, chr(CAST(65 + c_custkey % 3 AS INTEGER)) AS chain, round((c_custkey * 7919 % 20011) / 1000.0 - 10, 3) AS x, round((c_custkey * 104729 % 20011) / 1000.0, 3) AS y, round(c_custkey % 1000 / 8.0, 3) AS z FROM customer WHERE c_custkey < 9999""")
def pdb_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Points written as a structure file and read back; the format numbers 9,999 at most."""
    path, k = scratch(spark, "pdb"), F.col("c_custkey")
    rows = views.table(spark, d, "customer").where("c_custkey < 9999")
    least = rows.agg(F.min("c_custkey").alias("least"))
    rows = rows.crossJoin(F.broadcast(least)).select((k - F.col("least")).alias("idx"), (k % 3).cast("int").alias("block"), ((k * 7919 % 20011) / 1000 - 10).alias("x"), ((k * 104729 % 20011) / 1000).alias("y"), (k % 1000 / 8).alias("z"))  # one row
    files.pdb_lines(rows).write.text(path)
    return files.pdb(spark, path)


@query(with_views("pixels bins assembly_blocks", AXES) + """, p AS (SELECT assembly, idx, block, chrom, start FROM axes), t AS (SELECT a.assembly, {'c': a.chrom, 's': a.start} AS x, {'c': b.chrom, 's': b.start} AS y, CAST(a.block <> b.block AS INTEGER) AS neo FROM p a JOIN p b ON a.assembly = b.assembly WHERE a.idx = 3 AND b.idx = 30)
SELECT least(x, y).c AS chrom1, least(x, y).s AS start1, least(x, y).s + 1000 AS end1, greatest(x, y).c AS chrom2, greatest(x, y).s AS start2, greatest(x, y).s + 1000 AS end2, string_agg(DISTINCT assembly || ',27000,' || neo, ',' ORDER BY assembly || ',27000,' || neo) AS label FROM t GROUP BY 1, 2, 3, 4, 5, 6""")
def domain_file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Domains of all assemblies placed on the genome, labelled, written and read back."""
    path, frame = scratch(spark, "domains"), _axes(spark, d)
    ends = frame.select("assembly").distinct().select("assembly", F.lit(3).cast("long").alias("start"), F.lit(31).cast("long").alias("end"))
    files.write_loops(loops.labelled(commands.placed_domains(ends, frame, views.BIN_SIZE)), path)
    return files.loops(spark, path)


@query(with_views("sv") + """SELECT 'P' || p1 AS name, CAST(10000 AS INTEGER) AS resolution, c1, p1, c2, p2, abs(p1 - p2) AS apart, p1 % 2 = 0 AS induced FROM sv WHERE abs(p1 - p2) <= 50000 AND c1 <> c2 AND p1 % 2 = 0""")
def sv_peak_read(spark: SparkSession, d: str) -> DataFrame:
    """Induced peaks between chromosomes and not too far apart, from lines of text."""
    path, t = scratch(spark, "sv-peaks"), F.split("value", "\t")
    a, b = t[3].cast("long"), t[4].cast("long")
    views.sv_lines(spark, d).select(F.concat_ws("\t", F.concat(F.lit("P"), t[3]), F.lit("10000"), t[0], t[3], t[1], t[4], F.abs(a - b).cast("string"), (a % 2 == 0).cast("string"))).write.text(path)
    return files.sv_peaks(spark, path, 50_000, only_inter=True, last=True)


@query(with_views("track") + """, c AS (SELECT chrom, row_number() OVER (ORDER BY chrom) AS ord, max(idx) + 1 AS length FROM track GROUP BY 1), b AS (SELECT chrom, coalesce(sum(length) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c)
SELECT chrom, CAST(base + idx AS BIGINT) AS at, round(log2(value), 9) AS log2 FROM track JOIN b USING (chrom) WHERE value > 0""")
def plot_points(spark: SparkSession, d: str) -> DataFrame:
    """A profile at cumulative positions."""
    from pyspark.sql import Window as W

    t = views.track(spark, d)
    chroms = t.groupBy("chrom").agg((F.max("idx") + 1).alias("length")).withColumn("ord", F.row_number().over(W.orderBy("chrom")))
    return commands.cnv_plot_points(t.withColumn("start", F.col("idx")), chroms).withColumn("log2", F.round("log2", 9))
