"""Contact-map views of the star-schema tables, so that every operator runs on them, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators.written import shuffles

BINS = 400
PER_CHROM = 100
BIN_SIZE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bin1_id, bin2_id, count), upper triangle."""
    a, b = F.col("l_partkey") % BINS, F.col("l_orderkey") % BINS
    rows = table(spark, sf_dir, "lineitem").select(F.least(a, b).alias("bin1_id"), F.greatest(a, b).alias("bin2_id"))
    return rows.groupBy("bin1_id", "bin2_id").agg(F.count(F.lit(1)).alias("count"))


def bins(spark: SparkSession) -> DataFrame:
    """(bin_id, chrom, start, end, weight, cn); a null weight is a masked bin."""
    i = F.col("id")
    start = (i % PER_CHROM) * BIN_SIZE
    return spark.range(BINS).select(
        i.alias("bin_id"),
        F.concat(F.lit("chr"), (F.floor(i / PER_CHROM) + 1).cast("string")).alias("chrom"),
        start.alias("start"),
        (start + BIN_SIZE).alias("end"),
        F.when(i % 37 != 0, F.pow(F.lit(0.5), i % 4)).alias("weight"),
        (F.floor(i / 25) % 4 + 1).cast("int").alias("cn"),
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, idx, value): events of a kind in an hour."""
    hour = (F.floor(F.unix_timestamp("ts") / 3600) - 473352).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), hour.alias("idx"))
    return rows.groupBy("chrom", "idx").agg(F.count(F.lit(1)).alias("value"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, chrom, start, end), half-open."""
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("chrom"), start.alias("start"), (start + 1 + F.col("o_custkey") % 20).alias("end"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 4 + 1).cast("string")).alias("chrom"), ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 131) % 100000).alias("pos"))


def sv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): rearrangements as lines of text, chromA chromB orientation posA posB type."""
    c = table(spark, sf_dir, "customer")
    key, s1, s2 = F.col("c_custkey"), F.col("c_custkey") % 2, F.floor(F.col("c_custkey") / 2) % 2
    strand = lambda s: F.when(s == 0, "+").otherwise("-")
    parts = (F.concat(F.lit("chr"), (F.col("c_nationkey") % 4 + 1).cast("string")), F.concat(F.lit("chr"), (key % 4 + 1).cast("string")), F.concat(strand(s1), strand(s2)), ((key * 7919) % 100000).cast("string"), ((key * 104729) % 100000).cast("string"), F.lit("translocation"))
    return c.select(F.concat_ws("\t", *parts).alias("value"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): all links of lineitem from part to supplier keys, repeats included; the keys grow with the tables."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def loops(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    """(chrom1, start1, end1, chrom2, start2, end2, label, distance) at `step` bins a side, one a pixel of two or more."""
    size = step * BIN_SIZE
    b = bins(spark).select("bin_id", "chrom", "start")
    rows = pixels(spark, sf_dir).where("count >= 2")
    rows = rows.join(b.select(F.col("bin_id").alias("bin1_id"), F.col("chrom").alias("chrom1"), F.col("start").alias("s1")), "bin1_id")
    rows = rows.join(b.select(F.col("bin_id").alias("bin2_id"), F.col("chrom").alias("chrom2"), F.col("start").alias("s2")), "bin2_id")
    start = lambda s: (F.floor(F.col(s) / size) * size).cast("long")
    label = F.concat(F.lit("C"), (F.col("bin1_id") % 7).cast("string"))
    return rows.select("chrom1", start("s1").alias("start1"), (start("s1") + size).alias("end1"), "chrom2", start("s2").alias("start2"), (start("s2") + size).alias("end2"), label.alias("label"), ((F.col("bin2_id") - F.col("bin1_id")) * BIN_SIZE).alias("distance")).distinct()


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    start = (key * 7919) % 100000
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("gene"), key.alias("key"), F.concat(F.lit("chr"), (key % 4 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + 500 + 100 * F.col("p_size")).alias("end"), F.when(key % 2 == 0, "+").otherwise("-").alias("strand"))


def blocks(spark: SparkSession) -> DataFrame:
    """(block, chrom, lo, hi, strand, offset): runs of bins of one assembly, lo and hi in bins of the chromosome."""
    return spark.createDataFrame([(0, "chr1", 10, 60, "+", 0), (1, "chr3", 20, 70, "-", 50), (2, "chr2", 0, 40, "+", 100)], "block int, chrom string, lo long, hi long, strand string, offset long")


def assembly_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(assembly, block, chrom, lo, hi, strand, offset): two blocks of 20 bins of one assembly a supplier; the second may lie
    on the first."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), k.cast("string")).alias("assembly"), k.alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("block"))
    first = F.col("block") == 0
    at = F.when(first, F.col("k") % 4).otherwise(F.floor(F.col("k") / 4) % 4)
    lo = F.when(first, F.col("k") * 7 % 80).otherwise(F.col("k") * 13 % 80)
    strand = F.when(first | (F.col("k") % 2 == 0), "+").otherwise("-")
    return rows.select("assembly", "block", F.concat(F.lit("chr"), (at + 1).cast("string")).alias("chrom"), lo.alias("lo"), (lo + 20).alias("hi"), strand.alias("strand"), (F.col("block") * 20).cast("long").alias("offset"))


#: The same views, as common table expressions by name.
SQL = {
    "pixels": 'pixels AS (SELECT least(a, b) AS bin1_id, greatest(a, b) AS bin2_id, count(*) AS "count" FROM (SELECT l_partkey % 400 AS a, l_orderkey % 400 AS b FROM lineitem) GROUP BY 1, 2)',
    "bins": "bins AS (SELECT i AS bin_id, 'chr' || (i // 100 + 1) AS chrom, (i % 100) * 1000 AS start, (i % 100) * 1000 + 1000 AS \"end\", CASE WHEN i % 37 <> 0 THEN power(0.5, i % 4) END AS weight, CAST(1 + (i // 25) % 4 AS INTEGER) AS cn FROM range(400) t(i))",
    "track": "track AS (SELECT event_type AS chrom, CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 AS idx, count(*) AS value FROM events GROUP BY 1, 2)",
    "intervals": "intervals AS (SELECT o_orderkey AS id, o_orderpriority AS chrom, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS start, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 + o_custkey % 20 AS \"end\" FROM orders)",
    "sites": "sites AS (SELECT 'chr' || (l_suppkey % 4 + 1) AS chrom, (l_orderkey * 7919 + l_linenumber * 131) % 100000 AS pos FROM lineitem)",
    "sv": "sv AS (SELECT 'chr' || (c_nationkey % 4 + 1) AS c1, 'chr' || (c_custkey % 4 + 1) AS c2, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS s1, CASE WHEN (c_custkey // 2) % 2 = 0 THEN '+' ELSE '-' END AS s2, (c_custkey * 7919) % 100000 AS p1, (c_custkey * 104729) % 100000 AS p2 FROM customer)",
    "links": "links AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)",
    "genes": "genes AS (SELECT p_name AS gene, p_partkey AS key, 'chr' || (p_partkey % 4 + 1) AS chrom, (p_partkey * 7919) % 100000 AS start, (p_partkey * 7919) % 100000 + 500 + 100 * p_size AS \"end\", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)",
    "assembly_blocks": "assembly_blocks AS (SELECT 'C' || k AS assembly, b AS block, 'chr' || (CASE WHEN b = 0 THEN k % 4 ELSE (k // 4) % 4 END + 1) AS chrom, lo, lo + 20 AS hi, CASE WHEN b = 0 OR k % 2 = 0 THEN '+' ELSE '-' END AS strand, b * 20 AS \"offset\" FROM (SELECT s_suppkey AS k, b, CASE WHEN b = 0 THEN s_suppkey * 7 % 80 ELSE s_suppkey * 13 % 80 END AS lo FROM supplier, range(2) t(b)))",
    "blocks": "blocks AS (SELECT * FROM (VALUES (0, 'chr1', 10, 60, '+', 0), (1, 'chr3', 20, 70, '-', 50), (2, 'chr2', 0, 40, '+', 100)) t(block, chrom, lo, hi, strand, \"offset\"))",
}


def loops_sql(step: int, name: str) -> str:
    size = step * BIN_SIZE
    return f"""{name} AS (SELECT DISTINCT a.chrom AS chrom1, a.start // {size} * {size} AS start1, a.start // {size} * {size} + {size} AS end1, b.chrom AS chrom2, b.start // {size} * {size} AS start2, b.start // {size} * {size} + {size} AS end2, 'C' || (bin1_id % 7) AS label, (bin2_id - bin1_id) * 1000 AS distance
  FROM pixels JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id WHERE "count" >= 2)"""


def with_views(names: str, *rest: str) -> str:
    """A WITH clause of the views named, and the expressions that follow them."""
    return "WITH RECURSIVE " + ", ".join([*(SQL[n] for n in names.split()), *rest]) + "\n"
