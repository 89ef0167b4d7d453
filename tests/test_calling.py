"""Bounds of induced contacts, anchors, gap-free axes of many assemblies, and domain chains, on planted cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.functions import kernels
from contactloom.operators import assembly, axis, calling, domains, models
from contactloom.plans import commands

SIZE = 1000
BINS = "bin_id long, chrom string, start long, end long, weight double"
SVS = "id long, c1 string, p1 long, s1 string, c2 string, p2 long, s2 string"
BLOCKS = "assembly string, block int, chrom string, lo long, hi long, strand string, offset long"


def bins_of(spark, chroms, n, weight=1.0):
    return spark.createDataFrame([(c * n + i, f"chr{c + 1}", i * SIZE, i * SIZE + SIZE, weight) for c in range(chroms) for i in range(n)], BINS)


# bounds


def induced(rng, up, down, rows=60, columns=60, level=0.4):
    """Noise, and contacts that a junction induces between its nearest `up` rows and `down` columns."""
    block = rng.poisson(0.3, (rows, columns)).astype(float)
    near = np.add.outer(np.arange(rows)[::-1], np.arange(columns)) + 1
    block[rows - up :, :down] += rng.poisson(400 * level / near[rows - up :, :down])
    return block


@pytest.mark.parametrize("up,down", [(20, 30), (30, 15), (40, 40), (12, 25)])
def test_bounds_of_a_planted_block(up, down):
    found = kernels.induced_bounds(induced(np.random.default_rng(up), up, down))
    assert abs(found[0] - (60 - up)) <= 2 and abs(found[1] - down) <= 2 and min(found[2:]) > 0.5


def test_bounds_of_an_empty_block_are_the_whole():
    assert kernels.induced_bounds(np.zeros((20, 30))) == (0, 29, 0.0, 0.0)
    sparse = np.zeros((20, 30))
    sparse[10:19, 5:25] = 1
    assert kernels.induced_bounds(sparse)[:2] == (0, 29)  # nine rows are too few


def plain_blur(m):
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    k /= k.sum()
    wide = np.pad(m, 4, mode="symmetric")
    return np.array([[(wide[i : i + 9, j : j + 9] * np.outer(k, k)).sum() for j in range(m.shape[1])] for i in range(m.shape[0])])


def test_blur_of_any_shape():
    m = np.random.default_rng(2).random((7, 12))
    assert np.allclose(kernels.blurred(m), plain_blur(m))


@pytest.fixture(scope="module")
def junction(spark):
    """Two chromosomes joined; contacts across the junction are 0.4 of the decay, and end 30 bins before it and 20 after."""
    n, cut1, cut2, up, down = 120, 60, 60, 30, 20
    rng = np.random.default_rng(8)
    at = {i: i for i in range(cut1 + 1)} | {n + i: cut1 + 1 + (i - cut2) for i in range(cut2, n)}
    rows = []
    for a, b in itertools.combinations_with_replacement(range(2 * n), 2):
        if (a < n) == (b < n):
            rows.append((a, b, int(rng.poisson(20_000 / max(1, b - a)))))
        else:
            far = at[b] - at[a] if a in at and b in at else 0
            inside = far > 0 and a > cut1 - up and b < n + cut2 + down
            rows.append((a, b, int(rng.poisson(0.4 * 20_000 / far if inside else 0.4))))
    pixels = spark.createDataFrame([r for r in rows if r[2]], "bin1_id long, bin2_id long, count long")
    curve = spark.createDataFrame([(d, 20_000 / max(1, d)) for d in range(2 * n)], "distance long, value double")
    svs = spark.createDataFrame([(1, "chr1", cut1 * SIZE, "+", "chr2", cut2 * SIZE, "-"), (2, "chr1", 30 * SIZE, "-", "chr2", 90 * SIZE, "+")], SVS)
    return pixels, bins_of(spark, 2, n), svs, curve


def test_bounds_narrow_the_slopes(spark, junction):
    pixels, bins, svs, curve = junction
    ranges = (10 * SIZE, 30 * SIZE, 50 * SIZE)
    got = {r["id"]: r for r in assembly.allele_slopes(pixels, bins, svs, curve, 50 * SIZE, SIZE, ranges=ranges, bounded=True).collect()}
    one = got[1]
    assert abs(one["up"] - (51 - 30)) <= 2 and abs(one["down"] - (51 + 20)) <= 2
    assert one["m"] == pytest.approx(0.4, abs=0.06) and one["m_r2"] > 0.6 and one["u_share"] == pytest.approx(0.4, abs=0.06)
    assert [r["id"] for r in assembly.supported(assembly.allele_slopes(pixels, bins, svs, curve, 50 * SIZE, SIZE, ranges=ranges, bounded=True)).collect()] == [1]
    blocks = assembly.junction_blocks(svs, 50 * SIZE, SIZE, bins)
    frame = axis.axis(blocks, bins, SIZE, ("id",))
    moved = axis.remapped(pixels, frame, ("id",), bins)
    slopes = assembly.allele_slopes(pixels, bins, svs, curve, 50 * SIZE, SIZE, ranges=ranges, bounded=True)
    across = assembly.rescaled_junctions(moved, frame, slopes).where("id = 1 AND i <= 50 AND j > 50").collect()
    inside = [r["scaled"] / r["count"] for r in across if r["i"] >= one["up"] and r["j"] < one["down"]]
    assert np.allclose(inside, min(1 / one["m"], 5 / max(one["u"], one["d"]))) and all(r["scaled"] == r["count"] for r in across if r["i"] < one["up"] or r["j"] >= one["down"])


def plain_bounds(pixels, blocks, n):
    """Bounds by dense matrices, one rearrangement at a time."""
    dense = np.zeros((2 * n, 2 * n))
    for r in pixels:
        dense[r["bin1_id"], r["bin2_id"]] = dense[r["bin2_id"], r["bin1_id"]] = r["count"]
    out = {}
    for key in {b["id"] for b in blocks}:
        a, b = sorted((x for x in blocks if x["id"] == key), key=lambda x: x["block"])
        arms = [np.arange(x["lo"], x["hi"])[:: 1 if x["strand"] == "+" else -1] + n * (int(x["chrom"][3:]) - 1) for x in (a, b)]
        up, down, *_ = kernels.induced_bounds(dense[np.ix_(*arms)])
        out[key] = (up, len(arms[0]) + down)
    return out


def test_bounds_of_all_junctions(spark, junction):
    pixels, bins, svs, _ = junction
    rng = np.random.default_rng(3)
    more = [(k, "chr1", int(p) * SIZE, s, "chr2", int(q) * SIZE, t) for k, (p, q, s, t) in enumerate(zip(rng.integers(40, 80, 12), rng.integers(40, 80, 12), "+-+-++--+-+-", "-+--++-+-+-+", strict=True), 10)]
    blocks = assembly.junction_blocks(svs.union(spark.createDataFrame(more, SVS)), 40 * SIZE, SIZE, bins)
    frame = axis.axis(blocks, bins, SIZE, ("id",))
    got = {r["id"]: (r["up"], r["down"]) for r in assembly.induced_bounds(axis.remapped(pixels, frame, ("id",), bins), blocks).collect()}
    assert got == plain_bounds(pixels.collect(), blocks.collect(), 120) and len(got) == 14


def test_arms_stop_at_ends_and_half_way(spark):
    bins = bins_of(spark, 2, 100)
    svs = [(1, "chr1", 95_000, "-", "chr2", 3_000, "+"), (2, "chr1", 40_000, "+", "chr1", 60_500, "+"), (3, "chr1", 40_000, "-", "chr1", 61_000, "-"), (4, "chr1", 40_000, "-", "chr1", 60_000, "+"), (5, "chr1", 40_000, "+", "chr1", 60_000, "-")]
    rows = assembly.junction_blocks(spark.createDataFrame(svs, SVS), 30_000, SIZE, bins).orderBy("id", "block").collect()
    assert [(r["id"], r["lo"], r["hi"], r["strand"], r["offset"]) for r in rows] == [
        (1, 95, 100, "-", 0), (1, 0, 4, "-", 5), (2, 10, 41, "+", 0), (2, 50, 61, "-", 31), (3, 40, 51, "-", 0), (3, 61, 92, "+", 11),
        (4, 40, 49, "-", 0), (4, 51, 61, "-", 9), (5, 10, 41, "+", 0), (5, 60, 91, "+", 31),
    ]


# anchors


def plain_summits(x, height, apart):
    tops, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i] and x[i] >= height:
            tops.append((i + j) // 2)
        i = j + 1
    kept = []
    for t in sorted(tops, key=lambda t: (-x[t], -t)):
        if all(abs(t - k) >= apart for k in kept):
            kept.append(t)
    return sorted(kept)


def test_summits_of_random_piles():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = rng.integers(0, 6, rng.integers(1, 60))
        assert kernels.summits(x, 2, 3).tolist() == plain_summits(x.tolist(), 2, 3)


def test_feet_of_a_peak():
    x = np.array([0, 1, 4, 9, 4, 2, 3, 8, 1, 0])
    assert kernels.foot(x, 3, 10) == (0.0, 9.0)
    assert kernels.foot(x, 7, 10) == (5.0, pytest.approx(7 + 6 / 7))  # its left side ends at the higher peak's
    assert kernels.foot(x, 3, 2) == (pytest.approx(1 + 1 / 3), 5.0)


def test_anchors_merge_where_they_meet():
    places = np.repeat(np.arange(100, 120), [0, 1, 3, 6, 3, 1, 4, 2, 0, 0, 0, 0, 2, 5, 2, 0, 0, 0, 0, 1])
    assert kernels.pile_anchors(places, 2, 2, 10) == [(103, 101, 107), (113, 111, 115)]


def plain_calls(i, j, value, near, least, beside):
    """Calls of one pair of blocks, by dictionaries."""
    held = {(int(a), int(b)): float(v) for a, b, v in zip(i, j, value, strict=True)}
    calls, visited = set(), set()

    def grow(points):
        order = sorted(points, key=lambda p: (held[p], p), reverse=True)
        done = set()
        linked = {p: {p} for p in order}
        for p, q in itertools.combinations(order, 2):
            if np.hypot(p[0] - q[0], p[1] - q[1]) <= near and linked[p] is not linked[q]:
                linked[p] |= linked[q]
                for k in list(linked[q]):
                    linked[k] = linked[p]
        for p in order:
            if p in done or len(linked[p]) == 1:
                continue
            own, center, far = [p, p], p, near
            rest = [q for q in order if q in linked[p] and q not in done and q != p]
            while True:
                more = [q for q in rest if np.hypot(q[0] - center[0], q[1] - center[1]) <= far]
                if not more:
                    break
                own, rest = own + more, [q for q in rest if q not in more]
                center = tuple(np.rint(np.mean(own, axis=0)))
                far = np.rint(max(np.hypot(q[0] - center[0], q[1] - center[1]) for q in own)) + near
            done |= set(own)
            calls.add(p)
        return done

    for _, a, b in kernels.pile_anchors(i, least, near, beside):
        for _, c, d in kernels.pile_anchors(j, least, near, beside):
            inside = [p for p in held if a <= p[0] <= b and c <= p[1] <= d]
            if len(inside) == 1:
                calls.add(inside[0])
            elif inside:
                visited |= grow(inside)
    rest = [p for p in held if p not in visited]
    visited |= grow(rest)
    return calls | {p for p in held if p not in visited}


def test_calls_of_random_piles(spark):
    rng = np.random.default_rng(11)
    rows = []
    for part in range(6):
        at = {(int(a), int(b)) for c in rng.integers(0, 60, (8, 2)) for a, b in c + rng.integers(-3, 4, (rng.integers(1, 25), 2))}
        rows += [(part, a, b, float(v)) for (a, b), v in zip(sorted(at), rng.integers(1, 9, len(at)), strict=True)]
    df = spark.createDataFrame(rows, "part int, i long, j long, value double")
    got = {(r["part"], r["i"], r["j"]) for r in calling.clustered_by_anchors(df, ["part"], 10_000).collect()}
    want = set()
    for part in range(6):
        i, j, v = (np.array(c) for c in zip(*[r[1:] for r in rows if r[0] == part], strict=True))
        want |= {(part, *p) for p in plain_calls(i, j, v, calling.radius(10_000), 2, calling.reach(10_000))}
    assert got == want
    found = calling.anchors(df, ["part"], 10_000).collect()
    for part in range(6):
        i = np.array([r[1] for r in rows if r[0] == part])
        assert sorted((r["summit"], r["lo"], r["hi"]) for r in found if r["part"] == part) == kernels.pile_anchors(i, 2, 2, calling.reach(10_000))


# windows


def test_windows_by_tiles_are_those_of_the_matrix(spark):
    rng = np.random.default_rng(7)
    half, rows, wanted, dense = 2, [], [], {}
    for key in ("x", "y"):
        m = np.triu(rng.poisson(1.2, (90, 90)).astype(float))
        dense[key] = m
        rows += [(key, int(a), int(b), float(m[a, b])) for a, b in zip(*np.nonzero(m), strict=True)]
        wanted += [(key, int(a), int(b)) for a, b in zip(rng.integers(0, 90, 300), rng.integers(0, 90, 300), strict=True) if b > a]
    wanted = sorted(set(wanted))
    curve = {d: 10 / (d + 1) for d in range(70)}
    got = calling.windows(
        spark.createDataFrame(wanted, "key string, bin1_id long, bin2_id long"), spark.createDataFrame(rows, "key string, bin1_id long, bin2_id long, count double"),
        spark.createDataFrame(list(curve.items()), "distance long, value double"), half, keys=("key",), sizes=spark.createDataFrame([("x", 90), ("y", 90)], "key string, n long"),
    )
    got = {(r["key"], r["bin1_id"], r["bin2_id"]): np.array(r["window"]) for r in got.collect()}
    want = {}
    for key, x, y in wanted:
        if x < half or y + half + 1 > 90 or y - x - 2 < half:
            continue
        w = dense[key][x - half : x + half + 1, y - half : y + half + 1]
        corner = w[:half, :half].mean()
        if np.count_nonzero(w) >= 0.1 * w.size and corner > 0 and w[half, half] / corner > 0.1:
            far = np.abs((y + np.arange(-half, half + 1))[None] - (x + np.arange(-half, half + 1))[:, None])
            want[key, x, y] = (w / np.vectorize(curve.get)(far)).ravel() if far.max() < 70 else w.ravel()
    assert set(got) == set(want) and len(want) > 50 and all(np.allclose(got[k], want[k]) for k in want)


# axes of many assemblies


def test_places_without_gaps(spark):
    frame = spark.createDataFrame([(k, i) for k in "ab" for i in range(20)], "key string, idx long")
    rows = [("a", i, j, 1) for i in range(20) for j in range(i, 20) if j % 3 and i % 3] + [("b", 2, 5, 1), ("b", 5, 5, 0)]
    contacts = spark.createDataFrame(rows, "key string, i long, j long, count long")
    got = [(r["key"], r["idx"], r["place"]) for r in axis.gap_free(contacts, frame, ("key",)).orderBy("key", "idx").collect()]
    assert got == [("a", i, n) for n, i in enumerate(i for i in range(20) if i % 3)] + [("b", i, i) for i in range(20)]


def test_places_across_parts(spark, monkeypatch):
    monkeypatch.setattr(axis, "PART", 7)
    frame = spark.range(100).withColumnRenamed("id", "idx")
    contacts = frame.where("idx % 4 != 1").select(F.lit(0).cast("long").alias("i"), F.col("idx").alias("j"), F.lit(1).alias("count"))
    got = [(r["idx"], r["place"]) for r in axis.gap_free(contacts, frame).orderBy("idx").collect()]
    assert got == [(i, n) for n, i in enumerate(i for i in range(100) if i % 4 != 1)]
    back = axis.moved(axis.moved(contacts, axis.gap_free(contacts, frame)), axis.gap_free(contacts, frame), back=True)
    assert sorted(r["j"] for r in back.collect()) == [i for i in range(100) if i % 4 != 1]


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(12)
    n, rows = 60, {}
    for a, b in itertools.combinations_with_replacement(range(3 * n), 2):
        if (v := int(rng.poisson(200 / (1 + b - a) if a // n == b // n else 3))) and a % 17 and b % 17:
            rows[a, b] = v
    for a, b in zip(rng.integers(0, 3 * n, 60), rng.integers(0, 3 * n, 60), strict=True):
        rows[min(a, b), max(a, b)] = 150
    pixels = spark.createDataFrame([(int(a), int(b), v) for (a, b), v in rows.items()], "bin1_id long, bin2_id long, count long")
    blocks = []
    for k in range(100):
        lo, hi = int(rng.integers(0, 35)), int(rng.integers(0, 35))
        c = int(rng.integers(1, 4))
        e = c % 3 + 1 if k % 10 else c
        blocks += [(f"C{k}", 0, f"chr{c}", lo, lo + 25, "+", 0), (f"C{k}", 1, f"chr{e}", hi, hi + 25, "+-"[k % 2], 25)]
    return pixels, bins_of(spark, 3, n), spark.createDataFrame(blocks, BLOCKS)


def test_one_job_equals_many(spark, many):
    pixels, bins, blocks = many
    score = F.col("center") / (F.col("center") + F.col("corner"))
    run = lambda b: commands.call_loops(pixels, bins, b, SIZE, score, 0.6, upper=40, half=2, ranges=(20_000, 40_000))
    every = {tuple(r) for r in run(blocks).collect()}
    names = [f"C{k}" for k in (0, 1, 2, 10, 57, 99)]
    for name in names:
        assert {r for r in every if r[6] == name} == {tuple(r) for r in run(blocks.where(F.col("assembly") == name)).collect()}
    double = {r["assembly"] for r in axis.is_one_to_one(axis.axis(blocks, bins, SIZE, ("assembly",)), ("assembly",)).where("NOT ok").collect()}
    assert double and not double & {r[6] for r in every} and len({r[6] for r in every}) > 30


def test_remapping_by_cells_is_the_join(spark, many):
    pixels, bins, blocks = many
    frame = axis.axis(blocks, bins, SIZE, ("assembly",))
    got = {(r["assembly"], r["i"], r["j"]): r["count"] for r in axis.remapped(pixels, frame, ("assembly",)).collect()}
    at, counts, want = {}, {(r["bin1_id"], r["bin2_id"]): r["count"] for r in pixels.collect()}, {}
    for r in frame.collect():
        at.setdefault(r["assembly"], []).append((r["bin_id"], r["idx"]))
    for key, places in at.items():
        for (a, x), (b, y) in itertools.product(places, repeat=2):
            if (a, b) in counts:
                cell = (key, min(x, y), max(x, y))
                want[cell] = want.get(cell, 0) + counts[a, b]
    assert got == want


def test_valid_pairs_are_those_of_all_pairs(spark, many):
    _, bins, blocks = many
    bins = bins.withColumn("weight", F.when(F.col("bin_id") % 7 != 3, 1.0))
    frame = axis.axis(blocks.where("assembly IN ('C0', 'C1', 'C2')"), bins, SIZE, ("assembly",))
    got = {(r["assembly"], r["block1"], r["block2"], r["distance"]): r["n"] for r in axis.valid_pairs(frame, bins, 30, ("assembly",)).collect()}
    ok, want = [r for r in frame.collect() if r["bin_id"] % 7 != 3], {}
    for a, b in itertools.product(ok, repeat=2):
        if a["assembly"] == b["assembly"] and 2 <= b["idx"] - a["idx"] <= 30:
            key = (a["assembly"], a["block"], b["block"], b["idx"] - a["idx"])
            want[key] = want.get(key, 0) + 1
    assert got == want


# domains


def test_chain_likelihood_is_the_sum_over_paths():
    rng = np.random.default_rng(9)
    moves, weights, means, variances = domains.initial()
    weights = rng.dirichlet(np.ones(3), 4)
    for n in (4, 5, 7):
        x = rng.normal(0, 4, n)
        e = np.exp(kernels.mixture_logs(x, weights, means, variances)).sum(axis=2)
        paths = [p for p in itertools.product(range(4), repeat=n) if p[0] == 0]
        likely = [np.prod([e[t, s] for t, s in enumerate(p)]) * np.prod([moves[a, b] for a, b in zip(p, p[1:], strict=False)]) * moves[p[-1], 4] for p in paths]
        got = kernels.chain_sums(x, moves, weights, means, variances)
        assert got[0] == pytest.approx(np.log(sum(likely)))
        want = np.zeros((4, 5))
        for p, w in zip(paths, likely, strict=True):
            for a, b in zip(p, (*p[1:], 4), strict=True):
                want[a, b] += w / sum(likely)
        assert np.allclose(got[1:21].reshape(4, 5), want) and got[21:33].sum() == pytest.approx(n)
        assert tuple(kernels.likeliest_chain(x, moves, weights, means, variances)) == paths[int(np.argmax(likely))]
    assert not kernels.chain_sums(np.ones(3), *domains.initial()).any() and len(kernels.likeliest_chain(np.ones(3), *domains.initial())) == 0


def planted_index(rng, runs, domains_a_run):
    """(rows, domains) of an index with planted domains; runs are parted by zeros."""
    rows, found, at = [], [], 0
    for _ in range(runs):
        for _ in range(domains_a_run):
            down, up = rng.integers(4, 10, 2)
            values = np.r_[8, rng.gamma(4, 1, down), -rng.gamma(4, 1, up), -8] * -1.0
            found.append((at, at + len(values)))
            rows += [(at + k, float(v + rng.normal(0, 0.2))) for k, v in enumerate(values)]
            at += len(values)
        rows.append((at, 0.0))
        at += 1
    return rows, found


def test_trained_chain_finds_planted_domains(spark):
    rng = np.random.default_rng(10)
    rows, found = planted_index(rng, 8, 4)
    index = spark.createDataFrame([("a", *r) for r in rows], "chrom string, idx long, di double")
    model = domains.trained(index, rounds=15)
    assert model.count() == 19
    moves = domains.chain_of(model)[0]
    assert {(a, b) for a, b in zip(*np.nonzero(moves), strict=True)} <= set(domains.MOVES)
    other, want = planted_index(rng, 3, 3)
    got = {(r["start"], r["end"]) for r in domains.called(spark.createDataFrame([("b", *r) for r in other], "chrom string, idx long, di double"), model).collect()}
    assert len(got & set(want)) >= 0.8 * len(want) and len(got) <= 1.2 * len(want)


def test_index_of_an_empty_table(spark):
    index = spark.createDataFrame([], "chrom string, idx long, di double")
    model = domains.trained(index)
    assert model.count() == 19 and domains.called(index, model).count() == 0


def test_directionality_by_assembly(spark):
    rows = [("a", 0, 1, 5.0), ("a", 1, 3, 2.0), ("b", 0, 1, 1.0)]
    frame = spark.createDataFrame([(k, i) for k in "ab" for i in range(5)], "assembly string, idx long")
    got = {(r["assembly"], r["idx"]): r["di"] for r in models.directionality(spark.createDataFrame(rows, "assembly string, i long, j long, value double"), 2, ("assembly",), frame).collect()}
    assert len(got) == 10 and got["a", 0] == 5.0 and got["a", 1] == pytest.approx(-(1.5**2 + 1.5**2) / 3.5) and got["b", 1] == -1.0 and got["b", 4] == 0.0
