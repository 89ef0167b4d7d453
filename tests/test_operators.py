"""Operators on planted cases, held against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.functions import kernels, text
from contactloom.operators import axis, contacts, intervals, loops, models, rearrangements, sequences
from contactloom.plans import commands
from contactloom.sources import files
from contactloom.streaming import marginals


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def planted(spark):
    """Two chromosomes of 60 bins, contacts floor(400 / (d + 1)), five masked bins, class 2 twice as covered."""
    bins = [(i, f"chr{i // 60 + 1}", i % 60 * 1000, i % 60 * 1000 + 1000, None if i % 29 == 7 else 1.0, 1 + (i // 30) % 2) for i in range(120)]
    pixels = [(i, j, int(400 / (j - i + 1)) * bins[i][5] * bins[j][5]) for i in range(120) for j in range(i, 120) if i // 60 == j // 60 and (i + j) % 5]
    return spark.createDataFrame(pixels, "bin1_id long, bin2_id long, count long"), spark.createDataFrame(bins, "bin_id long, chrom string, start long, end long, weight double, cn int"), pixels, bins


def test_expected_counts_pairs_without_a_pixel(planted):
    pixels, bins, p, b = planted
    ok = {x[0] for x in b if x[4]}
    for r in contacts.expected(pixels, bins).collect():
        d = r["distance"]
        pairs = sum(i in ok and i + d in ok and i // 60 == (i + d) // 60 for i in range(120))
        total = sum(c for i, j, c in p if j - i == d and i in ok and j in ok)
        assert (r["pairs"], r["total"]) == (pairs, total) and r["value"] == total / pairs


def test_isotonic_and_curve(planted):
    pixels, bins, *_ = planted
    values = [r["value"] for r in models.isotonic_curve(contacts.expected(pixels, bins), 70).orderBy("distance").collect()]
    assert len(values) == 71 and all(a >= b - 1e-12 for a, b in zip(values, values[1:]))
    assert kernels.isotonic_decreasing(np.array([3.0, 1, 2, 0])).tolist() == [3, 1.5, 1.5, 0]


def test_balancing_evens_out_classes(planted):
    pixels, bins, p, b = planted
    bins = bins.withColumn("cn", F.when(F.col("chrom") == "chr1", 1).otherwise(2))  # no contacts between the classes
    got = {r["bin_id"]: r["sweight"] for r in models.balanced_by_class(pixels, bins, tolerance=1e-12, rounds=40).collect()}
    assert all((got[x[0]] is None) == (x[4] is None) for x in b)
    marg = dict.fromkeys(got, 0.0)
    for i, j, c in p:
        if i != j and got[i] and got[j]:
            marg[i] += c * got[i] * got[j]
            marg[j] += c * got[i] * got[j]
    for cn in (1, 2):
        own = [m for i, m in marg.items() if m and i // 60 + 1 == cn]
        assert np.std(own) / np.mean(own) < 1e-3


def test_mad_filter_drops_the_outlier(spark):
    cov = spark.createDataFrame([(i, 100 + i % 7 if i != 3 else 1) for i in range(40)], "bin_id long, coverage long")
    bins = spark.range(40).select(F.col("id").alias("bin_id"), F.lit("chr1").alias("chrom"))
    assert [r["bin_id"] for r in contacts.mad_filter(cov, bins).where("NOT kept").collect()] == [3]


def test_intervals(spark):
    rng = np.random.default_rng(2)
    own = [(i, f"c{i % 3}", int(s), int(s + rng.integers(1, 40))) for i, s in enumerate(rng.integers(0, 500, 120))]
    df = spark.createDataFrame(own, "id long, chrom string, start long, end long")
    pairs = {(a[0], b[0]) for a in own for b in own if a[1] == b[1] and a[2] < b[3] and b[2] < a[3]}
    got = rows(intervals.overlap(df, df, size=17), "a_id", "b_id")
    assert len(got) == len(set(got)) and set(got) == pairs
    for r in intervals.coalesced(df).collect():
        inside = [x for x in own if x[1] == r["chrom"] and r["start"] <= x[2] and x[3] <= r["end"]]
        assert len(inside) == r["n"]
    assert intervals.overlap(df.limit(0), df).count() == 0


def test_runs_merge_and_hampel(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, 2, 2, 2, 1, 9])] + [("b", 0, 1), ("b", 2, 1)], "chrom string, idx long, value long")
    assert rows(sequences.runs(df), "chrom", "start", "end", "value") == [("a", 0, 2, 1), ("a", 2, 5, 2), ("a", 5, 6, 1), ("a", 6, 7, 9), ("b", 0, 1, 1), ("b", 2, 3, 1)]
    x = np.concatenate([np.random.default_rng(0).normal(size=60), [40.0]])
    got = sequences.hampel(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "chrom string, idx long, v double"), F.col("v")).orderBy("idx").collect()
    for i, r in enumerate(got):
        near = x[max(0, i - 10) : i + 10]
        med = np.median(near)
        assert math.isclose(r["med"], med, abs_tol=1e-12) and r["kept"] == (abs(x[i] - med) < 3 * 1.4826 * np.median(np.abs(near - med)))
    segs = spark.createDataFrame([("a", 0, 9, 2), ("a", 9, 11, 0), ("a", 11, 30, 2), ("a", 30, 32, 0)], "chrom string, start long, end long, cn long")
    assert rows(sequences.absorb_and_merge(segs), "start", "end", "cn") == [(0, 30, 2), (30, 32, 0)]


def test_half_to_even(spark):
    df = spark.createDataFrame([("a", 1.25), ("b", 1.75), ("c", 0.0)], "chrom string, value double")
    assert rows(sequences.copy_numbers(df, ["chrom"]), "chrom", "cn") == [("a", 2), ("b", 4), ("c", 0)]


def test_parsing_rearrangements(spark):
    lines = ["chr9 chr9 +- 900000 100000 del", "chr9 chr9 -+ 100000 900000 dup", "chr1 chr2 ++ 100-300 5 t", "chr1 chr2 ++ 100-99999 5 wide", "chr1 chr2 ++ 100-300 5 t", "chrX chrX ++ 1 2 short"]
    got = rows(rearrangements.parsed(spark.createDataFrame([(x,) for x in lines], "value string"), 1000), "c1", "p1", "s1", "c2", "p2", "s2", "note")
    assert got == [("1", 200, "+", "2", 5, "+", "t"), ("9", 100000, "-", "9", 900000, "+", "del")][:1]


def test_caller_table(spark):
    lines = ["n chr2 10 20 + chr1 30 40 - x 10kb", "n chr1 10 20 - chr1 5 8 + x 10kb", "n chr1 10 20 - chr1 5 8 + x 5kb"]
    got = rows(rearrangements.from_caller(spark.createDataFrame([(x,) for x in lines], "value string")), "c1", "p1", "s1", "c2", "p2", "s2", "note")
    assert got == [("chr1", 8, "+", "chr1", 10, "-", "deletion"), ("chr1", 30, "-", "chr2", 20, "+", "translocation")]


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 5), (4, 1)], "src long, dst long")
    got = {(r["src"], r["dst"]): r["path"] for r in rearrangements.shortest_paths(edges, 4).collect()}
    assert got[1, 4] == [1, 2, 3, 4] and got[3, 5] == [3, 4, 1, 2, 5]
    kept = {tuple(r["path"]) for r in rearrangements.without_subpaths(spark.createDataFrame([([1, 2, 3],), ([2, 1],), ([2, 3],), ([3, 1],), ([3, 2, 1],)], "path array<long>")).collect()}
    assert kept == {(1, 2, 3), (1, 3)}
    flank = "array<struct<chrom: string, lo: long, hi: long>>"
    df = spark.createDataFrame([(1, [("1", 0, 10), ("2", 0, 10), ("1", 5, 15)]), (2, [("1", 0, 10), ("1", 0, 10), ("2", 0, 10)])], f"id int, f {flank}")
    assert rows(df.select("id", rearrangements.has_loop(F.col("f")).alias("x")), "id", "x") == [(1, True), (2, False)]


def test_greedy_peaks(spark):
    rng = np.random.default_rng(4)
    p = rng.integers(0, 300, (150, 2))
    kept = []
    for i, x in enumerate(p):
        if all(math.dist(x, p[k]) > 25 for k in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, "a", "b", int(x), int(y)) for i, (x, y) in enumerate(p)], "id long, chrom1 string, chrom2 string, p1 long, p2 long")
    assert [r[0] for r in rows(rearrangements.greedy_peaks(df, 25), "id")] == kept


def test_axis_turns_blocks(spark, planted):
    _, bins, *_ = planted
    blocks = spark.createDataFrame([(0, "chr1", 5, 8, "+", 0), (1, "chr2", 10, 12, "-", 3)], "block int, chrom string, lo long, hi long, strand string, offset long")
    frame = axis.axis(blocks, bins, 1000)
    assert rows(frame, "idx", "bin_id") == [(0, 5), (1, 6), (2, 7), (3, 71), (4, 70)]
    assert axis.is_one_to_one(frame).first()["ok"]
    got = axis.lifted(spark.createDataFrame([(0, 4)], "i long, j long"), frame, 1000).first()
    assert (got["chrom1"], got["start1"], got["chrom2"], got["start2"], got["distance"], got["neo"]) == ("chr1", 5000, "chr2", 10000, 4000, True)


def test_coarse_loops(spark):
    kind = "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, assembly string, distance long, neo int"
    fine = spark.createDataFrame([("1", 1000, 2000, "1", 9000, 10000, "A", 8000, 0)], kind)
    coarse = spark.createDataFrame([("1", 0, 5000, "1", 5000, 10000, "B", 5000, 0), ("1", 20000, 25000, "1", 40000, 45000, "B", 20000, 0)], kind)
    got = rows(loops.across_resolutions({1000: fine, 5000: coarse}), "resolution", "start1", "assembly")
    assert got == [(1000, 1000, "A"), (1000, 1000, "B"), (5000, 20000, "B")]
    assert rows(loops.labels_of(loops.labelled(fine)), "assembly", "distance", "neo") == [("A", 8000, 0)]


def test_huber_and_trend():
    x = np.linspace(0, 10, 60)
    y = 0.4 * x + 1
    y[::10] += 30
    slope, base, r2 = kernels.huber_line(x, y)
    assert abs(slope - 0.4) < 1e-3 and abs(base - 1) < 1e-2 and r2 > 0.99
    assert not kernels.trend_is_unclear(x, y) and kernels.trend_is_unclear(np.arange(6.0), np.array([1.0, 5, 2, 4, 3, 3.5]))


def test_segmentation(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, 80), rng.normal(3, 0.3, 60), rng.normal(0, 0.3, 60)])
    found = kernels.segments(x, 200, 0.01, 0.05, np.random.default_rng(0))
    assert all(min(abs(a - e) for a, _ in found) <= 1 for e in (80, 140)) and sum(b - a for a, b in found) == 200
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "chrom string, idx long, x double")
    states = [r["state"] for r in models.hidden_states(df, 2).orderBy("idx").collect()]
    assert states == [0] * 80 + [1] * 60 + [0] * 60


def test_clusters_and_matches():
    i, j, v = np.array([0, 1, 1, 30]), np.array([10, 10, 11, 50]), np.array([1.0, 5, 2, 9])
    assert [(seed, len(rows)) for seed, rows in kernels.grown_clusters(i, j, v, 2.0)] == [(3, 1), (1, 3)]
    assert kernels.match_once(np.array([[0, 100], [1, 100]]), np.array([[2, 100], [50, 90]]), 10) == [(0, 0)]
    assert kernels.stretches(np.array([1, 1, 0, 1, 1, 1, 0, 0, 1, 1], bool)) == [(0, 6)]


def test_structure_keeps_the_order_of_distances():
    n = 12
    i, j = np.triu_indices(n, 1)
    x = kernels.coordinates(i, j, 1000.0 / (j - i) ** 3, n)
    d = np.linalg.norm(x[i] - x[j], axis=1)
    assert np.corrcoef(kernels.ranks(d), kernels.ranks(j - i))[0, 1] > 0.9
    assert abs(np.linalg.norm(np.diff(x, axis=0), axis=1).mean() - 1.1) < 1e-9


def test_text(spark):
    df = spark.createDataFrame([("chr1:1,000-2,000",), ("chr1:9-2",), ("chrX",), ("",)], "s string").select(text.region(F.col("s")).alias("r"))
    assert [r["r"] and tuple(r["r"]) for r in df.collect()] == [("chr1", 1000, 2000), None, ("chrX", 0, None), None]
    one = spark.range(1).select(text.human_position(F.lit(1_500_000)).alias("a"), text.toggled_chrom(F.lit("chr1")).alias("b"), text.toggled_chrom(F.lit("1")).alias("c"), text.bare_chrom(F.lit("chrX")).alias("d")).first()
    assert tuple(one) == ("1M500K", "1", "chr1", "X")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("C0 translocation,1,10,+,X,21,- 1,9 X,22\nA1 t,1,1,+,2,2,- t,2,3,+,3,4,- 1,0 3,9\n")
    got = files.assemblies(spark, str(tmp_path / "a.txt"))
    assert [r["value"] for r in files.assembly_lines(got).collect()] == ["A1\tt,1,1,+,2,2,-\tt,2,3,+,3,4,-\t1,0\t3,9", "C0\ttranslocation,1,10,+,X,21,-\t1,9\tX,22"]
    (tmp_path / "b.bed").write_text("# c\ntrack x\nchr1\t0\t1000\tgene_1\t0.5\t-\t0\t1000\t0\t3\t10,20,100\t20,200,700\nchr2 5 6\n")
    b = files.bed(spark, str(tmp_path / "b.bed")).orderBy("chrom").collect()
    assert (b[0]["strand"], b[0]["block_sizes"], b[0]["block_starts"], b[1]["name"]) == ("-", [10, 20, 100], [20, 200, 700], None)
    track = spark.createDataFrame([("1", 0, 10, 0.5)], "chrom string, start long, end long, value double")
    files.write_bedgraph(track, str(tmp_path / "t"))
    assert rows(files.bedgraph(spark, str(tmp_path / "t")), "chrom", "start", "end", "value") == [("chr1", 0, 10, 0.5)]
    (tmp_path / "p.txt").write_text("chr2 50 7\nchr2 1 2 chr1 9 10\n")
    assert rows(files.peaks(spark, str(tmp_path / "p.txt")), "chrom1", "p1", "chrom2", "p2") == [("1", 9, "2", 1), ("2", 7, "2", 50)]


def test_stream_equals_batch(spark, planted, tmp_path):
    pixels, *_ = planted
    pixels.repartition(3).write.parquet(str(tmp_path / "in"))
    query = marginals.start(marginals.marginal_stream(marginals.pixel_stream(spark, str(tmp_path / "in"))), "covered", str(tmp_path / "c"))
    query.awaitTermination(120)
    assert rows(spark.table("covered"), "bin_id", "coverage", "nnz") == rows(contacts.marginals(pixels), "bin_id", "coverage", "nnz")


def test_commands(spark, planted):
    pixels, bins, *_ = planted
    genes = spark.createDataFrame([("MYC", "chr1", 0, 60000)], "gene string, chrom string, start long, end long")
    blocks = spark.createDataFrame([(0, "chr1", 5, 45, "+", 0), (1, "chr2", 10, 40, "-", 40)], "block int, chrom string, lo long, hi long, strand string, offset long")
    calls = commands.call_loops(pixels, bins, blocks, 1000, F.col("center") / (F.col("center") + F.col("corner")), 0.0, upper=30, half=2, ranges=(10_000, 30_000))
    assert calls.count() > 0
    found = commands.search_by_gene(calls.withColumn("neo", F.lit(1)), genes, "myc")
    assert [r["assembly"] for r in found.collect()] == ["C0"]
    segments = spark.createDataFrame([("chr1", 0, 30000, 1), ("chr1", 30000, 60000, 2), ("chr2", 0, 60000, 1)], "chrom string, start long, end long, value int")
    assert commands.correct_cnv(pixels, bins, segments, rounds=3).where("sweight > 0").count() > 0
    profile = spark.createDataFrame([("chr1", i * 1000, i * 1000 + 1000, 1.0 + (i >= 40) + (i * 7 % 5) / 100) for i in range(90)], "chrom string, start long, end long, value double")
    got = commands.segment_cnv(profile, 1000, states=2)
    assert rows(got, "start", "end", "value") == [(0, 40000, 2), (40000, 90000, 4)]
    assert commands.call_domains(pixels, bins, blocks, 1000, 10_000).columns == ["assembly", "start", "end"]
