"""Queries and operators do the whole job: held against plain versions of all rows."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest

from contactloom.functions import kernels
from contactloom.operators import intervals, loops, models, rearrangements
from contactloom.plans import numeric, relational
from contactloom.sources import views

SF = "/root/testdata/sf0.001"
with_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def peaks(spark):
    found = defaultdict(list)
    for r in relational._peaks(spark, SF).collect():
        found[r["chrom1"], r["chrom2"]].append((r["id"], r["p1"], r["p2"]))
    return {k: sorted(v) for k, v in found.items()}


@with_data
def test_greedy_peaks_of_all_rows(spark, peaks):
    want = set()
    for part in peaks.values():
        kept = []
        for i, p1, p2 in part:
            if all(math.dist((p1, p2), x) > 3000 for x in kept):
                kept.append((p1, p2))
                want.add(i)
    assert {r["id"] for r in relational.greedy_peak_dedup(spark, SF).collect()} == want


def test_greedy_peaks_across_squares(spark):
    rng = np.random.default_rng(5)
    at = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2))})
    kept = []
    for i, x in enumerate(at):
        if all(math.dist(x, at[k]) > 3 for k in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, "a", "b", *x) for i, x in enumerate(at)], "id long, chrom1 string, chrom2 string, p1 long, p2 long")
    assert sorted(r["id"] for r in rearrangements.greedy_peaks(df, 3, side=4).collect()) == kept


@with_data
def test_one_shot_match_of_all_rows(spark, peaks):
    want = set()
    for part in peaks.values():
        a, b = ([x for x in part if x[0] // 400 % 2 == odd] for odd in (0, 1))
        if a and b:
            found = kernels.match_once(np.array(a, float)[:, 1:], np.array(b, float)[:, 1:], 4000.0)
            want |= {(a[i][0], b[k][0]) for i, k in found}
    assert {(r["id"], r["match"]) for r in relational.one_shot_peak_match(spark, SF).collect()} == want


@with_data
def test_coalesced_intervals_hold_all_rows(spark):
    rows, got = views.intervals(spark, SF).collect(), relational.interval_coalesce(spark, SF).collect()
    assert sum(r["n"] for r in got) == len(rows)
    assert all(sum(x["chrom"] == r["chrom"] and x["start"] <= r["start"] and r["end"] <= x["end"] for x in got) == 1 for r in rows)
    n = relational.interval_overlap_semi(spark, SF).count() + relational.interval_overlap_anti(spark, SF).count()
    assert n == len(rows)


def test_intervals_that_meet_others(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "ab"[i % 2], int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 600, 80), rng.integers(0, 12, 80), strict=True))]
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long")
    meets = {i for i, c, s, e in rows for j, d, t, f in rows if i != j and c == d and s < f and t < e and s < e and t < f}
    assert {r["id"] for r in intervals.meeting_others(df, "left_semi", 32).collect()} == meets
    assert {r["id"] for r in intervals.meeting_others(df, "left_anti", 32).collect()} == {r[0] for r in rows} - meets and 0 < len(meets) < 80


def test_balancing_says_whether_it_converged(spark):
    rng = np.random.default_rng(2)
    pixels = spark.createDataFrame([(i, j, int(rng.integers(1, 9))) for i in range(12) for j in range(i, 12)], "bin1_id long, bin2_id long, count long")
    bins = spark.createDataFrame([(i, 1.0, 1 + i % 2) for i in range(12)], "bin_id long, weight double, cn int")
    assert not models.balanced_by_class(pixels, bins, rounds=1).first()["converged"]
    r = models.balanced_by_class(pixels, bins, rounds=1000).first()
    assert r["converged"] and r["variance"] < 1e-5


@with_data
def test_paths_over_all_links(spark):
    links = {(r["l_partkey"], r["l_suppkey"]) for r in views.table(spark, SF, "lineitem").select("l_partkey", "l_suppkey").collect()}
    after, want = defaultdict(set), {}
    for a, b in links:
        after[a].add(b)
    for a in after:
        front, seen = after[a] - {a}, set()
        for hop in range(1, 7):
            want |= {(a, b): hop for b in front}
            seen |= front
            front = {c for b in front for c in after.get(b, ())} - seen - {a}
    assert {(r["src"], r["dst"]): r["hops"] for r in relational.shortest_paths_all(spark, SF).collect()} == want
    kept = [r["path"] for r in relational.path_contiguous_dedup(spark, SF).collect()]
    steps = {frozenset(x) for p in kept for x in zip(p, p[1:], strict=False)}
    assert steps == {frozenset(x) for x in links if x[0] != x[1]}


@with_data
def test_loops_of_all_labels_and_resolutions(spark):
    names = (*loops.KEY, "assembly", "distance", "neo")
    got = {tuple(r[n] for n in ("resolution", *names)) for r in relational.multires_loop_merge(spark, SF).collect()}
    fine = {tuple(r[n] for n in names) for r in relational._triples(spark, SF, 1).collect()}
    assert {x[7] for x in got} == {f"C{i}" for i in range(7)} and {(1000, *x) for x in fine} <= got
    for size in (2000, 5000):
        at = {(x[1], x[2] // size, x[4], x[5] // size, *x[7:]) for x in got}
        coarse = {tuple(r[n] for n in names) for r in relational._triples(spark, SF, size // 1000).collect()}
        assert {(x[0], x[1] // size, x[3], x[4] // size, *x[6:]) for x in coarse} <= at


def test_five_levels_are_five_states(spark):
    rng = np.random.default_rng(8)
    x = np.repeat([0.0, 4, 8, 12, 16], 60) + rng.normal(0, 0.2, 300)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "chrom string, idx long, x double")
    assert models.mixture_states(df, "x").where("chosen").first()["k"] >= 5
    states = [r["state"] for r in models.hidden_states(df).orderBy("idx").collect()]
    assert all({states[i] for i in range(a, a + 60)}.isdisjoint(states[a + 60 :]) for a in range(0, 240, 60))


def test_one_shuffle_in_a_thousand_rejects(spark):
    def pieces(**levels):
        return models.change_points(df, **levels).count()

    x = np.random.default_rng(0).normal(0, 1, 200)
    x[80:120] += 0.7
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "chrom string, idx long, x double")
    assert pieces() == 1 < pieces(shuffles=100, p=0.01)


@with_data
def test_overlaps_of_all_rows(spark):
    """Both sides are the whole table, so that each pair comes out both ways."""
    rows = views.intervals(spark, SF).collect()
    want = {(a["id"], b["id"]) for a in rows for b in rows if a["id"] != b["id"] and a["chrom"] == b["chrom"] and a["start"] < b["end"] and b["start"] < a["end"]}
    got = [(r["a_id"], r["b_id"]) for r in relational.interval_overlap_join(spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want and any(a % 50 for a, _ in got)
