import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fibrespark.operators import grouping

POINTS = "image_id long, seed long, center_row double, center_col double, angle double"


def scan(points, radius):
    """The scan in the order of seeds, one image."""
    group = {}
    for _, seed, r, c, _ in sorted(points, key=lambda x: x[1]):
        if seed not in group:
            group[seed] = seed
            for _, k, pr, pc, _ in points:
                if k not in group and math.floor(r - radius) < pr < math.ceil(r + radius) and math.ceil(c - radius) < pc < math.floor(c + radius):
                    group[k] = seed
    return group


def mean_orientation(angles, step):
    best, spread = float(angles.mean()), float(angles.std())
    for cut in np.arange(angles.min(), angles.max() + step, step)[::-1]:
        turned = np.where(angles >= cut, angles - 180, angles)
        if (s := float(turned.std())) < spread - 1e-9:
            best, spread = float(turned.mean()), s
    return best % 180


def points_of(order, n=150, side=60, images=2):
    rng = np.random.default_rng(len(order))
    out = []
    for image in range(images):
        places = rng.integers(1, side, (n, 2)).astype(float)
        if order == "snake":
            places = np.array(sorted(places.tolist(), key=lambda p: (p[0] // 4, p[1] if p[0] // 4 % 2 else -p[1])))
        elif order == "line":
            places = np.array([[5.0, float(k)] for k in range(n)])
        elif order == "one place":
            places = np.full((n, 2), 7.0)
        elif order == "fractions":
            places = places + rng.random((n, 2))
        out += [(image, 10 * k, float(r), float(c), float(rng.integers(0, 1440) / 8)) for k, (r, c) in enumerate(places)]
    return out


@pytest.mark.parametrize("order", ["random", "snake", "line", "one place", "fractions"])
def test_groups_equal_the_scan(spark, order):
    points = points_of(order)
    frame = spark.createDataFrame(points, POINTS).repartition(3)
    for radius in (4.0, 6.5) if order == "random" else (5.0,):
        got = {(r.image_id, r.seed): r.group for r in grouping.seeds(frame, radius).collect()}
        want = {(i, k): g for i in (0, 1) for k, g in scan([p for p in points if p[0] == i], radius).items()}
        assert got == want
    fibers = {(r.image_id, r.fiber_id): r for r in grouping.group_curvelets(frame, radius, 5.625).collect()}
    assert set(fibers) == {(i, g) for (i, _), g in want.items()}
    for (image, g), r in fibers.items():
        own = [p for p in points if p[0] == image and want[image, p[1]] == g]
        assert r.weight == len(own) and r.center_row == math.floor(np.median([p[2] for p in own]) + 0.5) and r.center_col == math.floor(np.median([p[3] for p in own]) + 0.5)
        off = abs(r.angle - mean_orientation(np.array([p[4] for p in own]), 5.625))
        assert min(off, 180 - off) < 1e-6


def test_mean_orientations(spark):
    rng = np.random.default_rng(0)
    groups = [rng.integers(0, 32, rng.integers(1, 30)) * 5.625 for _ in range(200)] + [rng.random(rng.integers(1, 30)) * 180 for _ in range(200)]
    groups += [np.array([0.0, 60.0, 120.0]), np.array([178.0, 2.0]), np.array([90.0] * 5), np.array([0.0, 90.0])]
    rows = [(k, float(a)) for k, g in enumerate(groups) for a in g] + [(0, None), (999, None)]
    got = {r.g: r.angle for r in grouping.mean_orientations(spark.createDataFrame(rows, "g int, angle double"), 5.625, ("g",)).collect()}
    assert set(got) == set(range(len(groups)))
    for k, g in enumerate(groups):
        off = abs(got[k] - mean_orientation(g, 5.625))
        assert min(off, 180 - off) < 1e-6, (k, g)


def test_no_points_and_one(spark):
    none = spark.createDataFrame([], POINTS)
    assert grouping.group_curvelets(none, 5.0, 5.625).count() == 0
    one = spark.createDataFrame([(None, 3, 1.0, 1.0, None)], POINTS)
    assert grouping.seeds(one, 5.0).where(F.col("group") == 3).count() == 1
