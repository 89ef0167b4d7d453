from pyspark.sql import functions as F

from contactloom.operators import assembly, axis, intervals


def test_axes_look_up_no_more_than_their_places_or_the_contacts(spark):
    """500 axes of 12 bins lie on one locus of 4,000 contacts: each has 78 pairs of places."""
    pixels = spark.range(64 * 64).select((F.col("id") % 64).alias("lo"), F.floor(F.col("id") / 64).alias("hi"), F.lit(1).cast("long").alias("count")).where("lo <= hi")
    pixels = pixels.withColumns({"c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long")})
    place = spark.range(500).select("id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("idx")).select("id", (F.col("id") % 50 + F.col("idx")).alias("bin_id"), "idx")
    ways, rest = axis.met_cells(pixels, place, ("id",))
    assert rest.isEmpty() and ways.count() == 500 * 78
    ways, rest = axis.met_cells(pixels.where("lo = 3 AND hi = 5"), place, ("id",))
    assert ways.isEmpty() and rest.count() == 500
    frame = place.withColumn("idx", F.col("idx").cast("long"))
    one = pixels.where("lo = 3 AND hi = 5").select(F.col("hi").alias("bin1_id"), F.col("lo").alias("bin2_id"), "count")
    got = {(r["id"], r["i"], r["j"]) for r in axis.remapped(one, frame, ("id",)).collect()}
    assert got == {(k, 3 - k % 50, 5 - k % 50) for k in range(500) if k % 50 <= 3}


def test_equal_intervals_meet_as_one(spark):
    """2,000 rows of four intervals are four rows, and each of their pairs comes out once."""
    rows = spark.range(2000).select("id", F.lit("a").alias("chrom"), (F.col("id") % 4 * 10).alias("start"), (F.col("id") % 4 * 10 + 15).alias("end"))
    assert intervals.equal_rows(rows).count() == 4
    got = intervals.overlap_of_equals(rows.where("id % 50 = 0"), rows, 32)
    want = {(a, b) for a in range(0, 2000, 50) for b in range(2000) if abs(a % 4 - b % 4) <= 1}
    pairs = [(r["a_id"], r["b_id"]) for r in got.collect()]
    assert len(pairs) == len(want) and set(pairs) == want


def test_shares_are_worked_out_once_for_equal_intervals(spark):
    """Below the steps that pair rows, for distinct intervals; before, for each pair of rows."""
    rows = spark.range(500).select("id", F.lit("a").alias("chrom"), (F.col("id") % 4 * 10).alias("start"), (F.col("id") % 4 * 10 + 15).alias("end"))
    ends = [F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")]
    out = intervals.overlap_of_equals(rows, rows, 32, more={"ratio": F.round(intervals.ratio(*ends), 9)}).select("a_id", "b_id", "ratio")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("explode(b_ids") < plan.rindex("explode(a_ids") < plan.index("round(")
    assert {(abs(r["a_id"] % 4 - r["b_id"] % 4), r["ratio"]) for r in out.collect()} == {(0, 1.0), (1, 0.2)}


def test_ranges_of_a_small_file_are_not_broadcast(spark):
    rows = spark.range(1000).select("id", F.lit("a").alias("chrom"), (F.col("id") % 5).alias("start"), (F.col("id") % 5 + 40).alias("end"))
    track = spark.range(10).select(F.lit("a").alias("chrom"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + 5).alias("end"), F.col("id").alias("value"))
    out = intervals.range_means(rows, track, size=8)
    got = {r["id"]: r["signal"] for r in out.collect()}
    assert got[0] == got[5] == sum(range(8)) / 8 and len(got) == 1000
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_axes_of_equal_blocks_are_one(spark):
    """300 axes of three forms come to the kernels as three, and each has the rows that it has alone."""
    rows = [(f"C{k}", b, "chr1", 10 * (k % 3) + 30 * b, 10 * (k % 3) + 30 * b + 6, "+-"[b], 6 * b) for k in range(300) for b in (0, 1)]
    blocks = spark.createDataFrame(rows, "assembly string, block int, chrom string, lo long, hi long, strand string, offset long")
    once, members = axis.classes(blocks, "assembly")
    assert {r["assembly"] for r in once.collect()} == {"C0", "C1", "C101"} and once.count() == 6
    bins = spark.range(100).select(F.col("id").alias("bin_id"), F.lit("chr1").alias("chrom"), (F.col("id") * 10).alias("start"))
    pixels = spark.range(4000).select((F.col("id") * 7 % 90).alias("bin1_id"), (F.col("id") * 11 % 90).alias("bin2_id"), (F.col("id") % 5).alias("count"))
    moved = lambda b: axis.remapped(pixels, axis.axis(b, bins, 10, ("assembly",)), ("assembly",))
    got = [tuple(r) for r in axis.for_members(moved(once), members, "assembly").collect()]
    assert len(got) > 300 and sorted(got) == sorted(tuple(r) for r in moved(blocks).collect())


def test_junctions_of_equal_bins_are_one(spark):
    """Forty rearrangements whose breakpoints lie in two pairs of bins have two axes, as many slopes as they are, and tasks
    count the pairs of an axis's valid bins from its one row."""
    svs = spark.createDataFrame([(k, "chr1", 3000 + k, "+", "chr2", 5000 + 1000 * (k % 2) + k, "-") for k in range(1, 41)], "id long, c1 string, p1 long, s1 string, c2 string, p2 long, s2 string")
    bins = spark.range(40).select(F.col("id").alias("bin_id"), F.concat(F.lit("chr"), (F.floor(F.col("id") / 20) + 1).cast("string")).alias("chrom"), (F.col("id") % 20 * 1000).alias("start"), F.lit(1.0).alias("weight"))
    blocks, members = axis.classes(assembly.junction_blocks(svs, 3000, 1000, bins), "id")
    assert {r["id"] for r in blocks.collect()} == {1, 2} and members.count() == 40
    pairs = axis.valid_pairs(axis.axis(blocks, bins, 1000, ("id",)), bins, 3, ("id",))
    got = {(r["block1"], r["block2"], r["distance"]): r["n"] for r in pairs.where("id = 1").collect()}
    assert got == {(0, 0, 2): 2, (0, 0, 3): 1, (0, 1, 2): 2, (0, 1, 3): 3, (1, 1, 2): 2, (1, 1, 3): 1}
    pixels = spark.createDataFrame([(a, b, 9) for a in range(40) for b in range(a, 40)], "bin1_id long, bin2_id long, count long")
    curve = spark.range(20).select(F.col("id").alias("distance"), (1.0 / (F.col("id") + 1)).alias("value"))
    assert assembly.allele_slopes(pixels, bins, svs, curve, 3000, 1000, ranges=(3000,), bounded=True).select("id").distinct().count() == 40
