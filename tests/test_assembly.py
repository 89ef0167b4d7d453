"""Assemblies, slopes and the like on planted cases, against plain versions."""

import itertools

import numpy as np
import pytest

from contactloom.functions import kernels
from contactloom.operators import assembly, axis, contacts, intervals, models, rearrangements, sequences
from contactloom.plans import commands
from contactloom.sources import files

SVS = "id long, c1 string, p1 long, s1 string, c2 string, p2 long, s2 string"


def test_scaled_junction_has_its_slope(spark):
    """Contacts across a junction are 0.4 of the decay by distance on the joined axis, those beside it 1."""
    size, n, cut1, cut2 = 1000, 120, 60, 60
    bins = spark.createDataFrame([(c * n + i, f"chr{c + 1}", i * size, i * size + size, 1.0) for c in (0, 1) for i in range(n)], "bin_id long, chrom string, start long, end long, weight double")
    at = {i: i for i in range(cut1 + 1)} | {n + i: cut1 + 1 + (i - cut2) for i in range(cut2, n)}
    rows = []
    for a, b in itertools.combinations_with_replacement(range(2 * n), 2):
        if (a < n) == (b < n):
            rows.append((a, b, 10_000 // max(1, b - a)))
        elif a in at and b in at and abs(at[a] - at[b]) > 0:
            rows.append((a, b, round(0.4 * 10_000 / abs(at[a] - at[b]))))
    pixels = spark.createDataFrame(rows, "bin1_id long, bin2_id long, count long")
    curve = spark.createDataFrame([(d, 10_000 / max(1, d)) for d in range(2 * n)], "distance long, value double")
    svs = spark.createDataFrame([(1, "chr1", cut1 * size, "+", "chr2", cut2 * size, "-"), (2, "chr1", 30 * size, "-", "chr2", 90 * size, "+")], SVS)
    got = {r["id"]: r for r in assembly.allele_slopes(pixels, bins, svs, curve, 40 * size, size, 20 * size, (10 * size, 30 * size)).collect()}
    assert got[1]["u"] == pytest.approx(1, abs=0.05) and got[1]["d"] == pytest.approx(1, abs=0.05)
    assert got[1]["m"] == pytest.approx(0.4, abs=0.04) and got[1]["m_r2"] > 0.6 and got[1]["u_share"] == pytest.approx(0.4, abs=0.05)
    kept = assembly.supported(assembly.allele_slopes(pixels, bins, svs, curve, 40 * size, size, None, (10 * size, 30 * size)))
    assert [r["id"] for r in kept.collect()] == [1]
    blocks = assembly.junction_blocks(svs, 40 * size, size)
    frame = axis.axis(blocks, bins, size, ("id",))
    scaled = assembly.rescaled_junctions(axis.remapped(pixels, frame, ("id",)), frame, assembly.allele_slopes(pixels, bins, svs, curve, 40 * size, size, None, (10 * size, 30 * size)))
    one = {(r["i"], r["j"]): (r["count"], r["scaled"]) for r in scaled.where("id = 1").collect()}
    across = [v / c for (i, j), (c, v) in one.items() if i < 41 <= j]
    assert np.allclose(across, 2.5, rtol=0.1)


def chain(spark, *svs):
    return spark.createDataFrame([(i, *sv) for i, sv in enumerate(svs, 1)], SVS)


def test_three_rearrangements_make_one_chain(spark):
    svs = chain(spark, ("1", 10_000, "+", "2", 5_000, "-"), ("2", 8_000, "+", "3", 20_000, "-"), ("3", 23_000, "+", "4", 1_000, "-"), ("9", 5_000, "+", "8", 5_000, "-"))
    paths = [r["path"] for r in commands.assemble(svs, 5_000, 100).collect()]
    assert len(paths) == 1 and paths[0] in ([1, 2, 3], [-3, -2, -1])
    out = commands.assemblies(commands.assemble(svs, 5_000, 100), svs, 5_000)
    lines = {r["value"].split("\t")[0]: r["value"] for r in files.assembly_lines(out).collect()}
    assert set(lines) == {"A0", "C0", "C1", "C2", "C3"}
    assert lines["A0"] in ("A0\ttranslocation,1,10000,+,2,5000,-\ttranslocation,2,8000,+,3,20000,-\ttranslocation,3,23000,+,4,1000,-\t1,5000\t4,6000", "A0\ttranslocation,4,1000,-,3,23000,+\ttranslocation,3,20000,-,2,8000,+\ttranslocation,2,5000,-,1,10000,+\t4,6000\t1,5000")


def test_chain_that_meets_itself_is_left_out(spark):
    """The last flank lies on the first one again."""
    svs = chain(spark, ("1", 10_000, "+", "2", 5_000, "-"), ("2", 8_000, "+", "1", 6_000, "-"))
    assert commands.assemble(svs, 5_000, 100).count() == 0


def test_blocks_of_a_path_follow_each_other(spark):
    svs = chain(spark, ("1", 10_000, "+", "2", 5_000, "-"), ("2", 8_000, "+", "3", 20_000, "+"))
    steps = assembly.path_steps(spark.createDataFrame([([1, 2],)], "path array<bigint>"), svs, 3_000)
    got = [tuple(r)[1:] for r in assembly.path_blocks(steps, 1000).orderBy("block").collect()]
    assert got == [(0, "1", 7, 11, "+", 0), (1, "2", 5, 9, "+", 4), (2, "3", 17, 21, "-", 8)]


def test_connectable_needs_neighbours_that_fit(spark):
    blocks = spark.createDataFrame([(k, b) for k in ("x", "y", "z") for b in range(3)], "id string, block int")
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    rows = [(k, a, b, 1.0, 0.9, False) for k in "xyz" for a, b in pairs]
    rows = [(*r[:4], 0.5, False) if r[:3] == ("y", 1, 2) else (*r[:4], 0.5, True) if r[:3] == ("z", 2, 2) else r for r in rows]
    found = spark.createDataFrame(rows, "id string, block1 int, block2 int, slope double, r2 double, unclear boolean")
    assert [r["id"] for r in assembly.connectable(found, blocks).collect()] == ["x"]


def test_pair_counts_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "a" if i < 70 else "b", float(rng.random() > 0.2), int(rng.integers(1, 4))) for i in range(130)]
    bins = spark.createDataFrame(rows, "bin_id long, chrom string, weight double, cn int")
    want = {}
    for (i, c, w, k), (j, e, v, m) in itertools.combinations_with_replacement(rows, 2):
        if c == e and w > 0 and v > 0:
            key = (c, min(k, m), max(k, m), j - i)
            want[key] = want.get(key, 0) + 1
    got = {(r["chrom"], r["cn1"], r["cn2"], r["distance"]): r["pairs"] for r in contacts.valid_pairs(bins, value="cn").collect()}
    assert got == want
    short = {(r["chrom"], r["distance"]): r["pairs"] for r in contacts.valid_pairs(bins, 5).collect()}
    assert short == {(c, d): sum(n for (x, _, _, y), n in want.items() if (x, y) == (c, d)) for c in "ab" for d in range(6)}


def test_rebinning_takes_the_mean_of_even_halves(spark):
    bins = spark.createDataFrame([(0, "a", 0, 10), (1, "a", 10, 20), (2, "a", 20, 30)], "bin_id long, chrom string, start long, end long")
    segments = spark.createDataFrame([("a", 0, 2, 4.0), ("a", 2, 3, 1.0), ("a", 5, 8, 3.0), ("a", 10, 17, 2.0), ("a", 17, 20, 5.0)], "chrom string, start long, end long, value double")
    assert {r["bin_id"]: r["value"] for r in intervals.rebinned(segments, bins).collect()} == {0: 1.8, 1: 2.0, 2: 0.0}


def test_rare_copy_numbers_join_the_nearest(spark):
    rows = spark.createDataFrame([("a", 0, 100, 2), ("a", 100, 103, 3), ("a", 103, 150, 5), ("a", 150, 152, 9)], "chrom string, start long, end long, cn int")
    assert [r["cn"] for r in sequences.without_rare(rows).orderBy("start").collect()] == [2, 2, 5, 5]


def test_spans_merge_from_the_left():
    x = np.r_[np.full(10, 2.0), np.full(2, 9.0), np.full(10, 2.1), np.full(10, 8.0), np.zeros(5)]
    assert kernels.merged_spans(x, [0, 10, 12, 22, 32, 37], 3, 0.4) == [(0, 22), (22, 32), (32, 37)]


def test_flat_start_is_left_out():
    y = np.r_[9.0, 8, 8, 8, np.linspace(7.5, 3, 9), 3, 3, 2, 1.5, 1, 0.5, 0.2]
    assert kernels.without_flat_start(np.arange(20.0), y) == 3
    assert kernels.without_flat_start(np.arange(20.0), np.r_[np.full(8, 9.0), np.linspace(8, 1, 12)]) == 0
    x = np.linspace(20, 1, 20)
    slope, r2 = kernels.best_line(np.arange(20.0), x, 0.5 * x + 1)
    assert (slope, r2) == (pytest.approx(0.5, abs=1e-6), pytest.approx(1, abs=1e-6))
    assert kernels.best_line(np.arange(3.0), np.arange(3.0), np.arange(3.0)) == (0.0, 0.0)


def test_smoothing_is_a_mirrored_gaussian():
    w = np.random.default_rng(1).random(25)
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    k /= k.sum()
    wide = np.pad(w.reshape(5, 5), 4, mode="symmetric")
    plain = np.array([[sum(wide[i + a, j + b] * k[a] * k[b] for a in range(9) for b in range(9)) for j in range(5)] for i in range(5)])
    assert np.allclose(kernels.smoothed_square(w, 1.0), ((plain - plain.min()) / (plain.max() - plain.min())).ravel())
    assert kernels.smoothed_square(np.ones(9), 1.0) is None


def test_cis_factors_follow_the_copy_number(spark):
    """Counts of pairs of (4, 4) are twice those of (2, 2) at each distance."""
    rows = [(i, "a", 1.0, 2 if i < 80 else 4) for i in range(160)]
    bins = spark.createDataFrame(rows, "bin_id long, chrom string, weight double, cn int")
    pixels = spark.createDataFrame([(i, j, round((2 if i >= 80 else 1) * 6000 / (j - i + 1))) for i in range(160) for j in range(i, 160) if (i < 80) == (j < 80)], "bin1_id long, bin2_id long, count long")
    got = {(r["bin1_id"], r["bin2_id"]): r["simulated"] / r["count"] for r in models.simulated_cis(pixels, bins, 2, 40).collect()}
    assert got[3, 9] == 1 and got[100, 120] == pytest.approx(2, abs=0.05)


def test_segments_of_cnv(spark):
    rng = np.random.default_rng(2)
    level = np.r_[np.full(60, 1.0), np.full(40, 2.0), np.full(60, 0.5)] + rng.normal(0, 0.03, 160)
    profile = spark.createDataFrame([("a", i * 1000, i * 1000 + 1000, float(v)) for i, v in enumerate(level)], "chrom string, start long, end long, value double")
    got = [(r["start"] // 1000, r["end"] // 1000, r["value"]) for r in commands.segment_cnv(profile, 1000, 3).orderBy("start").collect()]
    assert [g[2] for g in got] == [2, 4, 1] and all(abs(a - b) <= 2 for g, w in zip(got, [(0, 60), (60, 100), (100, 160)], strict=True) for a, b in zip(g[:2], w, strict=True))


def test_matches_are_taken_once(spark):
    rng = np.random.default_rng(4)
    a, b = ([(int(i), "x", "x", int(p), int(p) + 400) for i, p in enumerate(rng.integers(0, 900, 60))] for _ in "ab")
    schema = "id long, chrom1 string, chrom2 string, p1 long, p2 long"
    got = {(r["id"], r["match"]) for r in models.matched_once(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 60).collect()}
    assert got == set(kernels.match_once(np.array([x[3:] for x in a], float), np.array([x[3:] for x in b], float), 60.0))


def test_shortest_hops_from_some_sources(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (5, 3)], "src long, dst long")
    got = {(r["src"], r["dst"]): r["hops"] for r in rearrangements.shortest_hops(edges, 2, edges.where("src = 5")).collect()}
    assert got == {(5, 3): 1, (5, 4): 2}
