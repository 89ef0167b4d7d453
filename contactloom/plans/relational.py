"""Queries of relational operators over the views, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions import text
from contactloom.operators import axis, contacts, intervals, loops, models, paths, rearrangements, sequences
from contactloom.sources import views
from contactloom.sources.views import loops_sql, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAIRED = "paired AS (SELECT p.*, a.chrom AS chrom1, b.chrom AS chrom2, a.weight AS w1, b.weight AS w2, a.cn AS cn1, b.cn AS cn2 FROM pixels p JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id)"
EXPECTED = """num AS (SELECT bin2_id - bin1_id AS distance, sum("count" * w1 * w2) AS total FROM paired WHERE chrom1 = chrom2 AND w1 > 0 AND w2 > 0 GROUP BY 1),
den AS (SELECT b.bin_id - a.bin_id AS distance, count(*) AS pairs FROM bins a JOIN bins b ON a.chrom = b.chrom AND b.bin_id >= a.bin_id AND a.weight > 0 AND b.weight > 0 GROUP BY 1),
curve AS (SELECT distance, total, pairs, total / pairs AS value FROM num JOIN den USING (distance) WHERE pairs > 10 AND total > 0)"""


@query(with_views("pixels bins", PAIRED, EXPECTED) + "SELECT * FROM curve")
def distance_expected_raw(spark: SparkSession, d: str) -> DataFrame:
    return contacts.expected(views.pixels(spark, d), views.bins(spark))


@query(with_views("pixels bins", PAIRED) + 'SELECT bin1_id, bin2_id, "count", "count" * w1 * w2 AS balanced FROM paired')
def balanced_pixels(spark: SparkSession, d: str) -> DataFrame:
    return contacts.balanced(views.pixels(spark, d), views.bins(spark))


@query(with_views("pixels bins") + """, both_ways AS (SELECT bin1_id, bin2_id, "count" FROM pixels UNION ALL SELECT bin2_id, bin1_id, "count" FROM pixels WHERE bin1_id <> bin2_id)
SELECT bin1_id, bin2_id, "count" FROM both_ways JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id
WHERE a.chrom = 'chr1' AND a.start < 50000 AND a."end" > 10000 AND b.chrom = 'chr2' AND b.start < 80000 AND b."end" > 0""")
def region_fetch(spark: SparkSession, d: str) -> DataFrame:
    return contacts.fetch(views.pixels(spark, d), views.bins(spark), ("chr1", 10000, 50000), ("chr2", 0, 80000))


@query(with_views("pixels") + 'SELECT bin_id, CAST(sum("count") AS BIGINT) AS coverage, count(*) AS nnz FROM (SELECT unnest([bin1_id, bin2_id]) AS bin_id, "count" FROM pixels WHERE bin2_id - bin1_id >= 1) GROUP BY 1')
def marginal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return contacts.marginals(views.pixels(spark, d), ignore=1)


@query(with_views("pixels bins") + """, cov AS (SELECT bin_id, sum("count") AS c FROM (SELECT unnest([bin1_id, bin2_id]) AS bin_id, "count" FROM pixels) GROUP BY 1),
med AS (SELECT chrom, median(c) AS m FROM cov JOIN bins USING (bin_id) GROUP BY 1),
scaled AS (SELECT bin_id, c / m AS s FROM cov JOIN bins USING (bin_id) JOIN med USING (chrom)),
center AS (SELECT median(ln(s)) AS c FROM scaled), mad AS (SELECT median(abs(ln(s) - c)) AS m FROM scaled, center)
SELECT bin_id, round(s, 9) AS scaled, s >= exp(c - 5 * m) AS kept FROM scaled, center, mad""")
def mad_max_filter(spark: SparkSession, d: str) -> DataFrame:
    return contacts.mad_filter(contacts.marginals(views.pixels(spark, d)), views.bins(spark)).withColumn("scaled", F.round("scaled", 9))


@query(with_views("pixels bins") + 'SELECT bin1_id, bin2_id, "count" FROM pixels JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id WHERE a.weight > 0 AND b.weight > 0')
def valid_bin_filter(spark: SparkSession, d: str) -> DataFrame:
    ok = views.bins(spark).where(contacts.is_valid(F.col("weight")))
    return contacts.paired(views.pixels(spark, d), ok, "chrom").select("bin1_id", "bin2_id", "count")


@query("""SELECT o_orderkey AS id, o_orderpriority AS chrom FROM orders WHERE NOT contains(o_orderpriority, '_') AND NOT contains(o_orderpriority, 'M') AND NOT contains(o_orderpriority, 'X') AND NOT contains(o_orderpriority, 'Y')""")
def chrom_substring_filter(spark: SparkSession, d: str) -> DataFrame:
    return contacts.without_substrings(views.intervals(spark, d)).select("id", "chrom")


@query(with_views("pixels") + 'SELECT count(*) AS nnz, CAST(sum("count") AS BIGINT) AS total, CAST(sum("count") AS DOUBLE) AS depth, CAST(CASE WHEN abs(50000 - sum("count")) <= abs(100000 - sum("count")) THEN 50000 ELSE 100000 END AS INTEGER) AS model FROM pixels')
def depth_estimate(spark: SparkSession, d: str) -> DataFrame:
    out = contacts.depth(views.pixels(spark, d))
    return out.withColumn("model", contacts.nearest_value([50000, 100000], F.col("depth")).cast("int"))


@query(with_views("intervals track") + """, t AS (SELECT chrom, idx AS start, idx + 1 AS "end", value FROM track), k AS (SELECT row_number() OVER (ORDER BY chrom) AS r, chrom FROM (SELECT DISTINCT chrom FROM track)),
kk AS (SELECT row_number() OVER (ORDER BY chrom) AS r, chrom FROM (SELECT DISTINCT chrom FROM intervals)), i AS (SELECT id, k.chrom, start % 700 AS start, start % 700 + ("end" - start) AS "end" FROM intervals JOIN kk USING (chrom) JOIN k USING (r))
SELECT id, coalesce(sum(value * (least(i."end", t."end") - greatest(i.start, t.start))) / sum(least(i."end", t."end") - greatest(i.start, t.start)), 0.0) AS signal FROM i LEFT JOIN t ON i.chrom = t.chrom AND i.start < t."end" AND t.start < i."end" GROUP BY 1""")
def range_mean_signal(spark: SparkSession, d: str) -> DataFrame:
    t = views.track(spark, d).select("chrom", F.col("idx").alias("start"), (F.col("idx") + 1).alias("end"), "value")
    rows = _on_track(spark, d, t)
    return intervals.range_means(rows, t, size=64)


def _on_track(spark: SparkSession, d: str, t: DataFrame) -> DataFrame:
    """The intervals with their names put onto the track's, in order, and their places onto its hours."""
    from pyspark.sql import Window as W

    own = views.intervals(spark, d)
    number = lambda rows, out: rows.select(F.col("chrom").alias(out)).distinct().withColumn("r", F.row_number().over(W.orderBy(out)))  # noqa: E731  a few names
    names = number(own, "a").join(number(t, "b"), "r").select("a", "b")
    start = F.col("start") % 700
    return own.join(names, own["chrom"] == names["a"]).select("id", F.col("b").alias("chrom"), start.alias("start"), (start + F.col("end") - F.col("start")).alias("end"))


@query(with_views("sites bins") + """, n AS (SELECT chrom, pos // 1000 * 1000 AS start, count(DISTINCT pos) AS n FROM sites GROUP BY 1, 2)
SELECT bin_id, coalesce(n, 0) AS n FROM bins LEFT JOIN n USING (chrom, start)""")
def cut_site_counts(spark: SparkSession, d: str) -> DataFrame:
    return intervals.counted_in_bins(views.sites(spark, d), views.bins(spark), views.BIN_SIZE)


RUNS = """ordered AS (SELECT *, idx - row_number() OVER (PARTITION BY chrom, value ORDER BY idx) AS island FROM track),
segments AS (SELECT chrom, min(idx) AS start, max(idx) + 1 AS "end", value, count(*) AS n FROM ordered GROUP BY chrom, value, island)"""


@query(with_views("track", RUNS) + "SELECT * FROM segments")
def run_length_segments(spark: SparkSession, d: str) -> DataFrame:
    return sequences.runs(views.track(spark, d))


@query(with_views("track", RUNS) + """, bins7 AS (SELECT chrom, i AS bin_id, i * 7 AS start, i * 7 + 7 AS "end" FROM (SELECT DISTINCT chrom FROM track), range(103) t(i)),
parts AS (SELECT b.chrom, bin_id, CAST(value AS DOUBLE) AS value, sum(least(b."end", s."end") - greatest(b.start, s.start)) AS n, sum(greatest(0, least(b.start + 3, s."end") - greatest(b.start, s.start))) AS l FROM bins7 b JOIN segments s ON b.chrom = s.chrom AND b.start < s."end" AND s.start < b."end" GROUP BY ALL),
halves AS (SELECT chrom, bin_id, sum(value * l) AS a, sum(value * (n - l)) AS b, sum(n) AS covered FROM parts GROUP BY ALL),
whole AS (SELECT b.chrom, b.bin_id, coalesce(a, 0) AS a, coalesce(h.b, 0) AS b, 7 - coalesce(covered, 0) AS n FROM bins7 b LEFT JOIN halves h ON h.chrom = b.chrom AND h.bin_id = b.bin_id),
every AS (SELECT chrom, bin_id, value, sum(n) AS n FROM (SELECT chrom, bin_id, value, n FROM parts UNION ALL SELECT chrom, bin_id, 0.0, n FROM whole) GROUP BY ALL HAVING sum(n) > 0),
most AS (SELECT chrom, bin_id, min(value) AS most FROM every e WHERE n = (SELECT max(n) FROM every f WHERE f.chrom = e.chrom AND f.bin_id = e.bin_id) GROUP BY 1, 2)
SELECT chrom, bin_id, CASE WHEN a * 4 = b * 3 THEN (a + b) / 7 ELSE most END AS value FROM whole JOIN most USING (chrom, bin_id)""")
def rebin_length_weighted_mode(spark: SparkSession, d: str) -> DataFrame:
    t = views.track(spark, d)
    grid = t.select("chrom").distinct().crossJoin(spark.range(103).withColumnRenamed("id", "n"))  # a few names, 103 bins each
    at = F.struct("chrom", "n").alias("bin_id")
    bins = grid.select("chrom", at, (F.col("n") * 7).alias("start"), (F.col("n") * 7 + 7).alias("end"))
    return intervals.rebinned(sequences.runs(t), bins, size=64).select("bin_id.chrom", F.col("bin_id.n").alias("bin_id"), "value")


@query(with_views("intervals") + """SELECT a.id AS a_id, b.id AS b_id, least(a."end", b."end") - greatest(a.start, b.start) AS shared,
round((least(a."end", b."end") - greatest(a.start, b.start)) / (greatest(a."end", b."end") - least(a.start, b.start)), 9) AS ratio
FROM intervals a JOIN intervals b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" WHERE a.id <> b.id""")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """All rows against all rows; its pairs grow with the square of the table."""
    rows = views.intervals(spark, d)
    ends = [F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")]
    out = intervals.overlap_of_equals(rows, rows, size=32, more={"shared": intervals.length(*ends), "ratio": F.round(intervals.ratio(*ends), 9)})
    return out.where("a_id != b_id").select("a_id", "b_id", "shared", "ratio")


@query(with_views("intervals") + 'SELECT id, chrom FROM intervals a WHERE EXISTS (SELECT 1 FROM intervals b WHERE a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.id <> b.id)')
def interval_overlap_semi(spark: SparkSession, d: str) -> DataFrame:
    """Of all rows those that overlap another row of the table."""
    return intervals.meeting_others(views.intervals(spark, d), "left_semi", size=32).select("id", "chrom")


@query(with_views("intervals") + 'SELECT id, chrom FROM intervals a WHERE NOT EXISTS (SELECT 1 FROM intervals b WHERE a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND a.id <> b.id)')
def interval_overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    return intervals.meeting_others(views.intervals(spark, d), "left_anti", size=32).select("id", "chrom")


@query(with_views("intervals") + """, flagged AS (SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY chrom ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM intervals),
marked AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS g FROM flagged)
SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM marked GROUP BY chrom, g""")
def interval_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return intervals.coalesced(views.intervals(spark, d))


@query(with_views("genes blocks") + """SELECT key AS id, CAST(block AS INTEGER) AS block, "offset" * 1000 + CASE WHEN b.strand = '+' THEN greatest(g.start, lo * 1000) - lo * 1000 ELSE hi * 1000 - least(g."end", hi * 1000) END AS lo,
"offset" * 1000 + CASE WHEN b.strand = '+' THEN least(g."end", hi * 1000) - lo * 1000 ELSE hi * 1000 - greatest(g.start, lo * 1000) END AS hi,
CASE WHEN b.strand = '+' THEN g.strand WHEN g.strand = '+' THEN '-' ELSE '+' END AS strand FROM genes g JOIN blocks b ON g.chrom = b.chrom AND g.start < hi * 1000 AND lo * 1000 < g."end\"""")
def liftover_elements(spark: SparkSession, d: str) -> DataFrame:
    return axis.lifted_intervals(views.genes(spark, d).withColumnRenamed("key", "id"), views.blocks(spark), views.BIN_SIZE)


@query(with_views("pixels bins genes", loops_sql(1, "loops")) + """, neo AS (SELECT * FROM loops WHERE chrom1 <> chrom2),
anchors AS (SELECT chrom1 AS chrom, greatest(0, start1 - 7000) AS start, end1 + 7000 AS "end", label FROM neo UNION SELECT chrom2, greatest(0, start2 - 7000), end2 + 7000, label FROM neo)
SELECT DISTINCT gene, label AS assembly FROM anchors a JOIN genes g ON a.chrom = g.chrom AND a.start < g."end" AND g.start < a."end\"""")
def padded_gene_search(spark: SparkSession, d: str) -> DataFrame:
    calls = views.loops(spark, d).withColumn("neo", (F.col("chrom1") != F.col("chrom2")).cast("int")).withColumnRenamed("label", "assembly")
    return loops.gene_search(calls, views.genes(spark, d))


@query(with_views("track") + """, near AS (SELECT *, list(CAST(value AS DOUBLE)) OVER (PARTITION BY chrom ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS l FROM track),
m AS (SELECT *, list_median(l) AS med FROM near), r AS (SELECT *, list_median(list_transform(l, lambda v: abs(v - med))) AS mad FROM m)
SELECT chrom, idx, value, med, mad, abs(value - med) < 3.0 * 1.4826 * mad AS kept FROM r""")
def hampel_filter(spark: SparkSession, d: str) -> DataFrame:
    return sequences.hampel(views.track(spark, d), F.col("value")).select("chrom", "idx", "value", "med", "mad", "kept")


@query(with_views("track") + """, coarse AS (SELECT chrom, idx AS start, idx + 1 AS "end", value // 3 AS value FROM track),
flagged AS (SELECT *, CASE WHEN lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS f FROM coarse WINDOW w AS (PARTITION BY chrom ORDER BY start)),
marked AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM flagged)
SELECT chrom, value, min(start) AS start, max("end") AS "end", count(*) AS parts FROM marked GROUP BY chrom, g, value""")
def adjacent_segment_merge(spark: SparkSession, d: str) -> DataFrame:
    t = views.track(spark, d).select("chrom", F.col("idx").alias("start"), (F.col("idx") + 1).alias("end"), F.floor(F.col("value") / 3).alias("value"))
    return sequences.merged(t)


@query(with_views("pixels bins") + ', cov AS (SELECT bin1_id AS bin_id, count(*) AS n FROM pixels GROUP BY 1) SELECT bin_id, n, CAST(dense_rank() OVER (ORDER BY n) - 1 AS INTEGER) AS level FROM cov')
def dense_rank_levels(spark: SparkSession, d: str) -> DataFrame:
    cov = views.pixels(spark, d).groupBy(F.col("bin1_id").alias("bin_id")).agg(F.count(F.lit(1)).alias("n"))
    return contacts.rank_levels(cov, "n").select("bin_id", "n", "level")


@query(with_views("track") + ", v AS (SELECT chrom, idx // 24 AS day, CASE WHEN value < 2 THEN 0 ELSE value END AS value FROM track) SELECT chrom, day, median(CASE WHEN value <> 0 THEN value END) AS median, avg(CAST(value = 0 AS INTEGER)) AS zeros, CAST(CASE WHEN avg(CAST(value = 0 AS INTEGER)) > 0.8 THEN 0 ELSE coalesce(round_even(median(CASE WHEN value <> 0 THEN value END) * 0.5, 0), 0) END AS BIGINT) AS cn FROM v GROUP BY 1, 2")
def integer_copy_number(spark: SparkSession, d: str) -> DataFrame:
    v = views.track(spark, d).select("chrom", F.floor(F.col("idx") / 24).alias("day"), F.when(F.col("value") < 2, 0).otherwise(F.col("value")).alias("value"))
    return sequences.copy_numbers(v, ["chrom", "day"], ploidy=0.5)


@query(with_views("track", RUNS) + """, coarse AS (SELECT chrom, value // 4 AS value, idx FROM track), o2 AS (SELECT *, idx - row_number() OVER (PARTITION BY chrom, value ORDER BY idx) AS island FROM coarse),
s2 AS (SELECT chrom, max(idx) + 1 AS "end" FROM o2 GROUP BY chrom, value, island) SELECT DISTINCT a.chrom, a."end" FROM segments a JOIN s2 b ON a.chrom = b.chrom AND abs(a."end" - b."end") <= 1""")
def boundary_tolerance_intersect(spark: SparkSession, d: str) -> DataFrame:
    t = views.track(spark, d)
    return sequences.near_ends(sequences.runs(t), sequences.runs(t.withColumn("value", F.floor(F.col("value") / 4))), tolerance=2)


@query(with_views("pixels bins", PAIRED) + """, t AS (SELECT least(cn1, cn2) AS cn1, greatest(cn1, cn2) AS cn2, sum("count" * w1 * w2) AS total FROM paired WHERE chrom1 <> chrom2 AND w1 > 0 AND w2 > 0 GROUP BY 1, 2),
n AS (SELECT least(a.cn, b.cn) AS cn1, greatest(a.cn, b.cn) AS cn2, count(*) AS n FROM bins a JOIN bins b ON a.chrom < b.chrom AND a.weight > 0 AND b.weight > 0 GROUP BY 1, 2)
SELECT cn1, cn2, n, coalesce(total, 0) / n AS mean FROM n LEFT JOIN t USING (cn1, cn2)""")
def cn_pair_trans(spark: SparkSession, d: str) -> DataFrame:
    return contacts.cn_pairs(views.pixels(spark, d), views.bins(spark), trans=True).withColumn("n", F.col("n").cast("long"))


@query(with_views("pixels bins", PAIRED) + """, t AS (SELECT least(cn1, cn2) AS cn1, greatest(cn1, cn2) AS cn2, bin2_id - bin1_id AS distance, sum("count" * w1 * w2) AS total FROM paired WHERE chrom1 = chrom2 AND w1 > 0 AND w2 > 0 GROUP BY 1, 2, 3),
n AS (SELECT least(a.cn, b.cn) AS cn1, greatest(a.cn, b.cn) AS cn2, b.bin_id - a.bin_id AS distance, count(*) AS n FROM bins a JOIN bins b ON a.chrom = b.chrom AND b.bin_id >= a.bin_id AND a.weight > 0 AND b.weight > 0 GROUP BY 1, 2, 3)
SELECT cn1, cn2, distance, n, coalesce(total, 0) / n AS mean FROM n LEFT JOIN t USING (cn1, cn2, distance) WHERE n >= 3""")
def cn_pair_cis_distance(spark: SparkSession, d: str) -> DataFrame:
    return contacts.cn_pairs(views.pixels(spark, d), views.bins(spark), trans=False)


AXIS = """axis AS (SELECT "offset" + CASE WHEN strand = '+' THEN k - lo ELSE hi - 1 - k END AS idx, CAST(block AS INTEGER) AS block, b.bin_id, x.chrom, b.start FROM (SELECT *, unnest(range(lo, hi)) AS k FROM blocks) x JOIN bins b ON b.chrom = x.chrom AND b.start = k * 1000),
moved AS (SELECT least(a.idx, b.idx) AS i, greatest(a.idx, b.idx) AS j, CAST(sum("count") AS BIGINT) AS "count" FROM pixels JOIN axis a ON a.bin_id = bin1_id JOIN axis b ON b.bin_id = bin2_id GROUP BY 1, 2)"""


def _axis(spark: SparkSession) -> DataFrame:
    return axis.axis(views.blocks(spark), views.bins(spark), views.BIN_SIZE)


@query(with_views("pixels bins blocks", AXIS) + "SELECT * FROM moved")
def axis_remap_contacts(spark: SparkSession, d: str) -> DataFrame:
    return axis.remapped(views.pixels(spark, d), _axis(spark))


@query(with_views("pixels bins blocks", AXIS) + ', s AS (SELECT j AS idx FROM moved GROUP BY 1 HAVING sum("count") > 0), k AS (SELECT idx FROM axis WHERE (SELECT count(*) FROM s) < 11 OR idx IN (SELECT idx FROM s)) SELECT idx, CAST(row_number() OVER (ORDER BY idx) - 1 AS INTEGER) AS place FROM k')
def gap_free_index(spark: SparkSession, d: str) -> DataFrame:
    frame = _axis(spark)
    return axis.gap_free(axis.remapped(views.pixels(spark, d), frame), frame)


@query(with_views("pixels bins blocks", AXIS) + """, ok AS (SELECT axis.*, weight FROM axis JOIN bins USING (bin_id) WHERE weight > 0),
n AS (SELECT a.block AS block1, b.block AS block2, b.idx - a.idx AS distance, count(*) AS n FROM ok a JOIN ok b ON b.idx - a.idx BETWEEN 2 AND 60 GROUP BY 1, 2, 3),
t AS (SELECT a.block AS block1, b.block AS block2, j - i AS distance, sum("count" * a.weight * b.weight) AS total FROM moved JOIN ok a ON a.idx = i JOIN ok b ON b.idx = j WHERE j - i BETWEEN 2 AND 60 GROUP BY 1, 2, 3)
SELECT block1, block2, distance, total / n AS mean FROM n JOIN t USING (block1, block2, distance) WHERE n >= 3 AND total > 0""")
def block_decay_points(spark: SparkSession, d: str) -> DataFrame:
    frame = _axis(spark)
    return axis.decay(axis.remapped(views.pixels(spark, d), frame), frame, views.bins(spark), 60)


@query(with_views("pixels bins blocks", AXIS) + """, l AS (SELECT m.i, m.j, {'chrom': a.chrom, 'start': a.start} AS x, {'chrom': b.chrom, 'start': b.start} AS y, a.block <> b.block AS neo FROM moved m JOIN axis a ON a.idx = m.i JOIN axis b ON b.idx = m.j WHERE "count" >= 2)
SELECT i, j, least(x, y).chrom AS chrom1, least(x, y).start AS start1, greatest(x, y).chrom AS chrom2, greatest(x, y).start AS start2, (j - i) * 1000 AS distance, neo FROM l""")
def loop_axis_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    frame = _axis(spark)
    return axis.lifted(axis.remapped(views.pixels(spark, d), frame).where("count >= 2"), frame, views.BIN_SIZE)


SV = """o AS (SELECT ltrim(c1, 'chr') AS c1, CASE WHEN c1 = c2 AND p1 > p2 THEN p2 ELSE p1 END AS p1, CASE WHEN c1 = c2 AND p1 > p2 THEN s2 ELSE s1 END AS s1, ltrim(c2, 'chr') AS c2, CASE WHEN c1 = c2 AND p1 > p2 THEN p1 ELSE p2 END AS p2, CASE WHEN c1 = c2 AND p1 > p2 THEN s1 ELSE s2 END AS s2, 'translocation' AS note FROM sv),
parsed AS (SELECT DISTINCT * FROM o WHERE c1 <> c2 OR (p2 - p1 >= 5000 AND NOT (s1 = '-' AND s2 = '+' AND p2 - p1 < 10000)))"""


@query(with_views("sv", SV) + "SELECT * FROM parsed")
def sv_parse_canonical(spark: SparkSession, d: str) -> DataFrame:
    return rearrangements.parsed(views.sv_lines(spark, d), 1000, 5000)


@query(with_views("sv", SV) + """, w AS (SELECT *, CASE WHEN c1 = c2 THEN p1 > p2 ELSE c1 > c2 END AS swap FROM parsed),
x AS (SELECT CASE WHEN swap THEN c2 ELSE c1 END AS c1, CASE WHEN swap THEN p2 ELSE p1 END AS p1, CASE WHEN swap THEN s2 ELSE s1 END AS s1, CASE WHEN swap THEN c1 ELSE c2 END AS c2, CASE WHEN swap THEN p1 ELSE p2 END AS p2, CASE WHEN swap THEN s1 ELSE s2 END AS s2 FROM w)
SELECT *, CASE WHEN c1 <> c2 THEN 'translocation' WHEN s1 || s2 = '+-' THEN 'deletion' WHEN s1 || s2 = '-+' THEN 'duplication' ELSE 'inversion' END AS note FROM x""")
def sv_label(spark: SparkSession, d: str) -> DataFrame:
    return rearrangements.labelled(rearrangements.parsed(views.sv_lines(spark, d), 1000, 5000))


FLANKS = """ids AS (SELECT CAST('0x' || md5(concat_ws(',', c1, p1, s1, c2, p2, s2))[1:15] AS BIGINT) AS id, * FROM parsed),
both_ways AS (SELECT id, c1, p1, s1, c2, p2, s2, FALSE AS mirrored FROM ids UNION ALL SELECT id, c2, p2, s2, c1, p1, s1, TRUE FROM ids),
flank AS (SELECT *, CASE WHEN s1 = '+' THEN greatest(0, p1 - 400) ELSE p1 END AS lo1, CASE WHEN s1 = '+' THEN p1 ELSE p1 + 400 END AS hi1, CASE WHEN s2 = '+' THEN greatest(0, p2 - 400) ELSE p2 END AS lo2, CASE WHEN s2 = '+' THEN p2 ELSE p2 + 400 END AS hi2 FROM both_ways)"""


@query(with_views("sv", SV, FLANKS) + """, met AS (SELECT a.id AS src, a.mirrored AS src_mirrored, b.id AS dst, b.mirrored AS dst_mirrored, least(a.hi2, b.hi1) - greatest(a.lo2, b.lo1) AS overlap, greatest(a.hi2, b.hi1) - least(a.lo2, b.lo1) AS whole
FROM flank a JOIN flank b ON a.id <> b.id AND a.c2 = b.c1 AND a.s2 <> b.s1 AND a.lo2 < b.hi1 AND b.lo1 < a.hi2) SELECT src, src_mirrored, dst, dst_mirrored, overlap, round(overlap / whole, 9) AS ratio FROM met WHERE overlap > 40""")
def sv_connect_edges(spark: SparkSession, d: str) -> DataFrame:
    return rearrangements.connected(_numbered_svs(spark, d), 400, 10).withColumn("ratio", F.round("ratio", 9))


def _numbered_svs(spark: SparkSession, d: str) -> DataFrame:
    """Rearrangements with an id above 0 from the hash of their six fields."""
    rows = rearrangements.parsed(views.sv_lines(spark, d), 1000, 5000)
    digest = F.md5(F.concat_ws(",", "c1", "p1", "s1", "c2", "p2", "s2"))
    return rows.withColumn("id", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))


@query(with_views("links") + """, walk AS (SELECT DISTINCT src, dst, 1 AS hops FROM links WHERE src <> dst AND src % 100 = 0 UNION SELECT w.src, e.dst, w.hops + 1 FROM walk w JOIN links e ON w.dst = e.src WHERE w.hops < 6 AND e.dst <> w.src AND e.src <> e.dst)
SELECT src, dst, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY 1, 2""")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """From the sources whose number is divisible by 100, over all links."""
    links = views.links(spark, d)
    return rearrangements.shortest_hops(links, 6, links.where("src % 100 = 0"))


@query()
def shortest_paths_all(spark: SparkSession, d: str) -> DataFrame:
    """From all sources; its rows are pairs of nodes."""
    return rearrangements.shortest_hops(views.links(spark, d), 6)


@query()
def path_contiguous_dedup(spark: SparkSession, d: str) -> DataFrame:
    return paths.maximal(views.links(spark, d), 6)


@query(with_views("pixels bins", loops_sql(1, "loops")) + ", l AS (SELECT DISTINCT chrom1, start1, end1, chrom2, start2, end2, label || ',' || distance || ',' || CAST(chrom1 <> chrom2 AS INTEGER) AS t FROM loops) SELECT chrom1, start1, end1, chrom2, start2, end2, string_agg(t, ',' ORDER BY t) AS label FROM l GROUP BY ALL")
def bedpe_label_merge(spark: SparkSession, d: str) -> DataFrame:
    return loops.labelled(_triples(spark, d, 1))


@query(with_views("pixels bins", loops_sql(1, "loops")) + "SELECT DISTINCT chrom1, start1, end1, chrom2, start2, end2, label AS assembly, distance, CAST(chrom1 <> chrom2 AS INTEGER) AS neo FROM loops")
def bedpe_label_explode(spark: SparkSession, d: str) -> DataFrame:
    return loops.labels_of(loops.labelled(_triples(spark, d, 1)))


def _triples(spark: SparkSession, d: str, step: int) -> DataFrame:
    return views.loops(spark, d, step).withColumn("neo", (F.col("chrom1") != F.col("chrom2")).cast("int")).withColumnRenamed("label", "assembly").select(*loops.KEY, "assembly", "distance", "neo")


def _level(name: str, size: int, finer: str, fine: int) -> str:
    """Loops of `name` met with the loops kept at a finer level: the finer loops that stand inside each."""
    return f"""h_{name}_{finer} AS (SELECT c.*, f.start1 AS f1, f.start2 AS f2 FROM {name}_t c JOIN (SELECT DISTINCT chrom1, start1, chrom2, start2 FROM {finer}_kept) f ON c.chrom1 = f.chrom1 AND c.chrom2 = f.chrom2
  AND f.start1 BETWEEN c.start1 // {fine} * {fine} AND c.end1 // {fine} * {fine} AND f.start2 BETWEEN c.start2 // {fine} * {fine} AND c.end2 // {fine} * {fine})"""


def _triples_sql(name: str) -> str:
    return f"{name}_t AS (SELECT chrom1, start1, end1, chrom2, start2, end2, label AS assembly, distance, CAST(chrom1 <> chrom2 AS INTEGER) AS neo FROM {name})"


def _missed(name: str, finer: tuple[str, ...]) -> str:
    rules = " OR ".join(f"(chrom1, start1, chrom2, start2) NOT IN (SELECT chrom1, start1, chrom2, start2 FROM h_{name}_{f})" for f in finer)
    return f"{name}_kept AS (SELECT * FROM {name}_t WHERE {rules})"


def _moved(name: str, finer: str, fine: int) -> str:
    return f"SELECT CAST({fine} AS INTEGER) AS resolution, chrom1, f1 AS start1, f1 + {fine} AS end1, chrom2, f2 AS start2, f2 + {fine} AS end2, assembly, distance, neo FROM h_{name}_{finer}"


LEVELS = (*(_triples_sql(n) for n in ("a", "b", "c")), "a_kept AS (SELECT * FROM a_t)", _level("b", 2000, "a", 1000), _missed("b", ("a",)), _level("c", 5000, "a", 1000), _level("c", 5000, "b", 2000), _missed("c", ("a", "b")))


@query(with_views("pixels bins", loops_sql(1, "a"), loops_sql(2, "b"), loops_sql(5, "c"), *LEVELS) + f"""SELECT CAST(1000 AS INTEGER) AS resolution, * FROM a_t UNION SELECT 2000, * FROM b_kept UNION SELECT 5000, * FROM c_kept
UNION {_moved("b", "a", 1000)} UNION {_moved("c", "a", 1000)} UNION {_moved("c", "b", 2000)}""")
def multires_loop_merge(spark: SparkSession, d: str) -> DataFrame:
    """All labels at three resolutions."""
    return loops.across_resolutions({step * views.BIN_SIZE: _triples(spark, d, step) for step in (1, 2, 5)})


@query("""WITH a AS (SELECT o_orderkey AS id, CAST(o_custkey % 97 AS VARCHAR) AS path, CAST(CASE o_orderkey % 3 WHEN 0 THEN 5000 WHEN 1 THEN 10000 ELSE 25000 END AS INTEGER) AS resolution FROM orders)
SELECT id, path, resolution FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY resolution, id) AS r FROM a) WHERE r = 1""")
def multires_assembly_pick(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    rows = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 97).cast("string").alias("path"), F.when(k == 0, 5000).when(k == 1, 10000).otherwise(25000).alias("resolution"))
    return rearrangements.finest(rows)


@query(with_views("pixels bins", PAIRED, EXPECTED) + """SELECT bin1_id, bin2_id, bin2_id - bin1_id AS distance, "count" * w1 * w2 AS value, curve.value AS mean FROM paired JOIN
(SELECT distance, total / pairs AS value FROM num JOIN den USING (distance) WHERE pairs > 5 AND total > 0) curve ON curve.distance = bin2_id - bin1_id
WHERE chrom1 = chrom2 AND w1 > 0 AND w2 > 0 AND bin2_id - bin1_id BETWEEN 4 AND 80""")
def candidate_pixels(spark: SparkSession, d: str) -> DataFrame:
    return contacts.candidates(views.pixels(spark, d), views.bins(spark), 4, 80)


@query(with_views("pixels bins", PAIRED, EXPECTED) + """SELECT bin1_id, bin2_id, bin2_id - bin1_id AS distance, coalesce("count" / value, CAST("count" AS DOUBLE)) AS normalized FROM pixels LEFT JOIN curve ON distance = bin2_id - bin1_id""")
def distance_normalized_pixels(spark: SparkSession, d: str) -> DataFrame:
    pixels = views.pixels(spark, d)
    return contacts.distance_normalized(pixels, contacts.expected(pixels, views.bins(spark))).select("bin1_id", "bin2_id", "distance", "normalized")


@query(with_views("pixels") + """, m AS (SELECT bin1_id, min("count") AS lo, max("count") AS hi FROM pixels GROUP BY 1) SELECT bin1_id, bin2_id, CASE WHEN hi > lo THEN CAST("count" - lo AS DOUBLE) / (hi - lo) END AS scaled FROM pixels JOIN m USING (bin1_id)""")
def minmax_rows(spark: SparkSession, d: str) -> DataFrame:
    return contacts.minmax(views.pixels(spark, d), "count", ["bin1_id"]).select("bin1_id", "bin2_id", "scaled")


PEAKS = """peaks AS (SELECT bin1_id * 400 + bin2_id AS id, a.chrom AS chrom1, b.chrom AS chrom2, bin1_id * 1000 AS p1, bin2_id * 1000 AS p2 FROM pixels JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id WHERE bin2_id - bin1_id > 20)"""


MATCHED = """, met AS (SELECT a.id, b.id AS match, sqrt((a.p1 - b.p1) * (a.p1 - b.p1) + (a.p2 - b.p2) * (a.p2 - b.p2)) AS distance, least(4000.0, abs(a.p1 - a.p2) * 0.2) AS near FROM peaks a JOIN peaks b ON a.chrom1 = b.chrom1 AND a.chrom2 = b.chrom2 AND (a.id // 400) % 2 = 0 AND (b.id // 400) % 2 = 1
AND abs(a.p1 - b.p1) <= 4000 AND abs(a.p2 - b.p2) <= 4000),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, match) AS r FROM met WHERE distance <= near) WHERE r = 1) """


@query(with_views("pixels bins", PEAKS) + MATCHED + "SELECT id, match, distance FROM one")
def nearest_peak_match(spark: SparkSession, d: str) -> DataFrame:
    rows = _peaks(spark, d)
    odd = F.floor(F.col("id") / 400) % 2 == 1
    return intervals.nearest(rows.where(~odd), rows.where(odd), 4000)


@query(with_views("pixels bins", PEAKS) + MATCHED + "SELECT min(id) AS id, match FROM one GROUP BY match")
def one_shot_peak_match(spark: SparkSession, d: str) -> DataFrame:
    rows = _peaks(spark, d)
    odd = F.floor(F.col("id") / 400) % 2 == 1
    return models.matched_once(rows.where(~odd), rows.where(odd), 4000)


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    rows = contacts.paired(views.pixels(spark, d), views.bins(spark), "chrom").where("bin2_id - bin1_id > 20")
    return rows.select((F.col("bin1_id") * 400 + F.col("bin2_id")).alias("id"), "chrom1", "chrom2", (F.col("bin1_id") * 1000).alias("p1"), (F.col("bin2_id") * 1000).alias("p2"))


@query()
def greedy_peak_dedup(spark: SparkSession, d: str) -> DataFrame:
    return rearrangements.greedy_peaks(_peaks(spark, d), apart=3000)


@query(with_views("pixels") + 'SELECT bin1_id % 10 AS part, round(quantile_cont("count", 0.95), 9) AS level FROM pixels WHERE "count" <> 0 GROUP BY 1')
def peak_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = views.pixels(spark, d).withColumn("part", F.col("bin1_id") % 10)
    return contacts.percentile_of_nonzero(rows, 0.95, ["part"]).withColumn("level", F.round("level", 9))


@query(with_views("genes") + 'SELECT gene, key, chrom, start, "end", strand FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY "end" - start DESC, key) AS r FROM genes) WHERE r = 1')
def gene_longest_record(spark: SparkSession, d: str) -> DataFrame:
    return loops.longest_records(views.genes(spark, d))


@query("""WITH t AS (SELECT o_orderkey AS id, 'chr' || (o_custkey % 22 + 1) || ':' || o_orderkey || '-' || (o_orderkey + o_custkey % 900 - 100) AS s FROM orders), p AS (SELECT id, s, regexp_extract(s, '^([^:]+):([0-9]+)-([0-9]+)$', ['chrom', 'start', 'end']) AS r FROM t WHERE NOT contains(s, '--'))
SELECT id, r.chrom AS chrom, CAST(r.start AS BIGINT) AS start, CAST(r."end" AS BIGINT) AS "end", ltrim(r.chrom, 'chr') AS bare FROM p WHERE r."end" <> '' AND CAST(r."end" AS BIGINT) >= CAST(r.start AS BIGINT)""")
def region_parse(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders")
    s = text.region_text(F.concat(F.lit("chr"), (F.col("o_custkey") % 22 + 1).cast("string")), F.col("o_orderkey"), F.col("o_orderkey") + F.col("o_custkey") % 900 - 100)
    rows = o.select(F.col("o_orderkey").alias("id"), text.region(s).alias("r")).where("r IS NOT NULL AND r.end IS NOT NULL")
    return rows.select("id", "r.chrom", "r.start", "r.end", text.bare_chrom(F.col("r.chrom")).alias("bare"))


@query("""WITH n AS (SELECT DISTINCT CASE WHEN o_custkey % 25 < 22 THEN 'chr' || (o_custkey % 25 + 1) ELSE 'chr' || ['X', 'Y', 'M'][o_custkey % 25 - 21] END AS name FROM orders)
SELECT name, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_matches(name, '[0-9]+$') THEN 0 WHEN name = 'chrX' THEN 1 WHEN name = 'chrY' THEN 2 ELSE 3 END, CAST(nullif(regexp_extract(name, '([0-9]+)$', 1), '') AS INTEGER)) AS INTEGER) AS place FROM n""")
def chrom_natural_sort(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    k = F.col("o_custkey") % 25
    name = F.concat(F.lit("chr"), F.when(k < 22, (k + 1).cast("string")).otherwise(F.get(F.array(F.lit("X"), F.lit("Y"), F.lit("M")), (k - 22).cast("int"))))
    rows = views.table(spark, d, "orders").select(name.alias("name")).distinct()
    return rows.withColumn("place", F.row_number().over(W.orderBy(text.chrom_order(F.col("name")))))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey = 0 THEN '0' ELSE CASE WHEN o_orderkey * 1237 // 1000000 > 0 THEN (o_orderkey * 1237 // 1000000) || 'M' ELSE '' END || CASE WHEN o_orderkey * 1237 % 1000000 // 1000 > 0 THEN (o_orderkey * 1237 % 1000000 // 1000) || 'K' ELSE '' END || CASE WHEN o_orderkey * 1237 % 1000 > 0 THEN CAST(o_orderkey * 1237 % 1000 AS VARCHAR) ELSE '' END END AS label FROM orders""")
def position_labels(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.human_position(F.col("o_orderkey") * 1237).alias("label"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'bed3' WHEN event_id % 5 = 2 THEN 'bedgraph' WHEN event_id % 5 = 3 THEN 'bed6' ELSE 'bed4' END AS kind FROM events""")
def bed_type_guess(spark: SparkSession, d: str) -> DataFrame:
    e, k = views.table(spark, d, "events"), F.col("event_id") % 5
    start = F.col("user_id").cast("string")
    base = F.concat_ws("\t", F.col("event_type"), start, (F.col("user_id") + 10).cast("string"))
    line = F.when(k == 0, F.concat(F.lit("#"), base)).when(k == 1, base).when(k == 2, F.concat_ws("\t", base, F.col("value").cast("string"))).when(k == 3, F.concat_ws("\t", base, F.lit("name"), F.lit("0"), F.lit("+"))).otherwise(F.concat_ws("\t", base, F.lit("name")))
    return e.select(F.col("event_id").alias("id"), text.bed_type(line).alias("kind"))
