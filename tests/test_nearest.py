"""Nearest fibers and nearest outline points where images are crowded, empty or wide, and the test of uniform directions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fibrespark.operators import boundary, neighbors, statistics

FIBERS = "image_id long, fiber_id long, center_row double, center_col double, angle double"
POINTS = "image_id long, roi_id long, seq long, row long, col long"


def clusters(n, count=10, side=8192, spread=6.0, seed=0):
    """``n`` fibers in dense clusters of a wide image, and a few alone."""
    rng = np.random.default_rng(seed)
    middles = rng.uniform(0, side, (count, 2))
    places = np.round(middles[rng.integers(0, count, n)] + rng.normal(0, spread, (n, 2)), 1)
    places[: n // 50] = rng.uniform(-500, side, (n // 50, 2))
    return [(0, k, float(r), float(c), float(k % 180)) for k, (r, c) in enumerate(places)]


def test_neighbors_in_clusters_equal_brute_force(spark):
    rows = clusters(1500) + [(1, k, 5.0, 5.0, 1.0) for k in range(40)] + [(2, k, 1e6 * k, -1e6 * k, 1.0) for k in range(5)] + [(3, 0, 1.0, 1.0, 1.0)]
    got = {}
    for r in neighbors.nearest_neighbors(spark.createDataFrame(rows, FIBERS).repartition(3), 4).collect():
        got.setdefault((r.image_id, r.fiber_id), []).append((r.rank, r.distance, r.nb_id))
    for image in range(4):
        own = np.array([x[1:4] for x in rows if x[0] == image])
        for k, r, c in own:
            d = np.hypot(own[:, 1] - r, own[:, 2] - c)
            order = np.lexsort((own[:, 0], d))
            want = [(n, d[i], own[i, 0]) for n, i in enumerate([i for i in order if own[i, 0] != k][:4], 1)]
            assert sorted(got.get((image, int(k)), [])) == [(n, pytest.approx(x), i) for n, x, i in want]


def test_boxes_in_reach_grow_with_the_fibers(spark):
    """Ten dense clusters: pairs and boxes a fiber stay, while fibers become four times as many."""
    counts = []
    for n in (1000, 4000):
        f = spark.createDataFrame(clusters(n, spread=3.0 * math.sqrt(n / 1000)), FIBERS)
        boxes = neighbors._boxes_in_reach(f, f, 4)
        held = neighbors._celled(f).groupBy("image_id", "_r", "_c").agg(F.count(F.lit(1)).alias("n"))
        counts.append(boxes.join(held, ["image_id", "_r", "_c"]).agg(F.sum("n")).first()[0] / n)
    assert counts[1] < 1.5 * counts[0] < 200


def outlines(n, side):
    rng = np.random.default_rng(n)
    rows = []
    for roi in range(n):
        r0, c0, h, w = rng.integers(0, side), rng.integers(0, side), rng.integers(5, 200), rng.integers(5, 200)
        path = [(r0, c0 + k) for k in range(w)] + [(r0 + k, c0 + w) for k in range(h)] + [(r0 + h, c0 + w - k) for k in range(w)] + [(r0 + h - k, c0) for k in range(h + 1)]
        rows += [(0, roi, s, int(r), int(c)) for s, (r, c) in enumerate(path)]
    return rows


@pytest.mark.parametrize("keys", [("image_id",), ("image_id", "roi_id")])
def test_nearest_points_equal_brute_force(spark, keys):
    rng = np.random.default_rng(1)
    rows = outlines(6, 3000) + [(1, 99, 0, -7, 4)]
    fibers = [(0, k, float(r), float(c), 0.0) for k, (r, c) in enumerate(rng.uniform(-400, 3400, (150, 2)))] + [(0, 1000, 200000.0, -90000.5, 0.0), (1, 1, 3.0, 4.0, 0.0), (2, 1, 3.0, 4.0, 0.0)]
    got = boundary.nearest_point(spark.createDataFrame(fibers, FIBERS), spark.createDataFrame(rows, POINTS).repartition(3), keys).collect()
    found = {(r.image_id, r.fiber_id, *([r.roi_id] if len(keys) > 1 else [])): (r.distance, r.boundary_roi, r.boundary_seq) for r in got}
    want = {}
    for image, k, r, c, _ in fibers:
        for i, roi, seq, pr, pc in rows:
            if i == image:
                key = (image, k, *([roi] if len(keys) > 1 else []))
                d = (math.sqrt((r - pr) ** 2 + (c - pc) ** 2), roi, seq)
                want[key] = min(want.get(key, d), d)
    assert set(found) == set(want)
    for key, (d, roi, seq) in want.items():
        assert found[key] == (pytest.approx(d), roi, seq)


def test_points_met_are_few_for_any_number(spark):
    f = spark.createDataFrame([(0, k, 37.0 * k % 3000, 91.0 * k % 3000, 0.0) for k in range(300)], FIBERS).select("image_id", "fiber_id", "center_row", "center_col")
    met = []
    for n in (5, 40):
        p = spark.createDataFrame(outlines(n, 3000), POINTS).select("image_id", *[F.col(c).alias(f"_{c}") for c in ("roi_id", "seq", "row", "col")])
        met.append(boundary._near_pairs(f, p, ["image_id"], ["image_id"]).count() / 300)
    assert max(met) < 40
    p = p.select("*", F.col("_roi_id").alias("roi_id"))
    assert boundary._near_pairs(f, p, ["image_id"], ["image_id", "roi_id"]).count() / (300 * 40) < 40


def test_uniformity(spark):
    rng = np.random.default_rng(2)
    groups = [rng.integers(0, 36, n) * 5.0 for n in (1, 2, 3, 10, 49, 50, 51, 120)] + [rng.uniform(-90, 300, 200), rng.normal(20, 9, 40), np.array([0.0, 90.0]), np.array([30.0] * 9), np.array([0.0, 45, 90, 135])]
    rows = [(g, float(a)) for g, angles in enumerate(groups) for a in angles] + [(0, None)]
    got = {r.g: r for r in statistics.uniformity_test(spark.createDataFrame(rows, "g int, angle double"), "angle", ("g",)).collect()}
    for g, angles in enumerate(groups):
        a = angles % 180
        n, m = len(a), min(int((((a - t) % 180) < 90).sum()) for t in np.concatenate([a, (a + 90) % 180]))
        if n == 2 * m:
            p = 1.0
        elif n <= 50:
            p = 2.0 ** (1 - n) * (n - 2 * m) * math.comb(n, m)
        else:
            q = math.pi * math.sqrt(n) / (2 * (n - 2 * m))
            p = math.sqrt(2 * math.pi) / q * math.exp(-math.pi**2 / (8 * q * q))
        assert (got[g].n, got[g].m, got[g].p) == (n, m, pytest.approx(min(1.0, p)))
    assert got[9].p < 1e-6 < 0.5 < got[12].p
