"""No join of a query over fibers and outlines may have the driver broadcast a side: the planner takes exploded rows for as few as their file's."""

import random
import re

import pytest

from pyspark.sql import functions as F

from fibrespark.operators import boundary, contours, heatmap, roi
from fibrespark.plans import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name", ["nearest_boundary", "boundary_association", "overlay_segments", "region_distances", "roi_alignment", "roi_summary", "roi_edge_alignment", "fiber_features", "nearest_neighbors", "box_features", "feature_table", "extension_points", "mask_contours"]
)
def test_exploded_tables_are_not_broadcast(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" in plan


def test_runs_of_overlapping_polygons_hold_each_pixel_once(spark):
    rng = random.Random(4)
    rows = []
    for roi_id in range(12):
        r, c, h, w = rng.randrange(-20, 150), rng.randrange(-20, 250), rng.randrange(1, 60), rng.randrange(1, 150)
        rows += [(roi_id % 2, roi_id, k, float(a), float(b)) for k, (a, b) in enumerate([(r, c), (r, c + w), (r + h, c + w // 2), (r + h, c), (r, c)])]
    points = spark.createDataFrame(rows, "image_id long, roi_id long, seq long, row double, col double")
    pixels = roi.polygon_mask(points, 160, 300).select("image_id", "row", "col").distinct()
    runs = roi.mask_of_polygons(points, 160, 300)
    got = [(r.image_id, r.row, c) for r in runs.collect() for c in range(r.first, r.last + 1)]
    assert len(got) == len(set(got)) and set(got) == {tuple(p) for p in pixels.collect()}
    fibers = spark.createDataFrame([(k % 3, k, rng.uniform(-5, 165), rng.uniform(-5, 305)) for k in range(400)], "image_id long, fiber_id long, center_row double, center_col double")
    by_pixel = boundary.mask_value(fibers, pixels.selectExpr("*", "255 AS value"), 160, 300)
    by_run = boundary.mask_value(fibers, runs, 160, 300)
    assert by_run.columns == by_pixel.columns and sorted(map(tuple, by_run.collect())) == sorted(map(tuple, by_pixel.collect()))
    assert by_run.where("region = 1").count() > 20


def test_lines_meet_outline_points_as_their_pixels_do(spark):
    rng = random.Random(9)
    fibers = spark.createDataFrame([(k % 2, k, rng.uniform(0, 90), rng.uniform(-10, 90), rng.choice([0.0, 45.0, 90.0, 135.0, rng.uniform(0, 180), None])) for k in range(150)], "image_id long, fiber_id long, center_row double, center_col double, angle double")
    points = spark.createDataFrame([(k % 2, k, 0, rng.randrange(0, 90), rng.randrange(-10, 90)) for k in range(3000)], "image_id long, roi_id long, seq long, row long, col long")
    for threshold in (0.0, 0.1, 0.6, 25.3):
        pixels = boundary.segment_pixels(boundary.fiber_lines(fibers, threshold), "r1", "c1", "r2", "c2")
        met = pixels.join(points.selectExpr("image_id", "row AS px_row", "col AS px_col").distinct(), ["image_id", "px_row", "px_col"])
        distance = F.sqrt(F.pow(F.col("center_row") - F.col("px_row"), 2) + F.pow(F.col("center_col") - F.col("px_col"), 2))
        want = met.groupBy("image_id", "fiber_id").agg(F.min(F.struct(distance.alias("d"), "px_row", "px_col")).alias("b")).select("image_id", "fiber_id", "b.*")
        assert sorted(map(tuple, boundary.extension_points(fibers, points, threshold).collect())) == sorted(map(tuple, want.collect()))


def test_contours_of_runs_are_those_of_their_pixels(spark):
    rng = random.Random(2)
    pixels = [(i, r, c, 1) for i in range(2) for r in range(-3, 30) for c in range(-70, 130) if rng.random() < 0.9 - 0.4 * i]
    mask = spark.createDataFrame(pixels, "image_id long, row long, col long, value int")
    runs = contours.mask_runs(mask)
    got, want = contours.mask_contours(runs.select("image_id", "row", "first", "last")), contours.mask_contours(mask)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # points stand between a filled pixel and an empty one, each such pair has one
    filled = {p[:3] for p in pixels}
    beside = sorted((i, 2 * r + a, 2 * c + b) for i, r, c in filled for a, b in contours.STEPS if (i, r + a, c + b) not in filled)
    assert sorted((p.image_id, p.r, p.c) for p in contours.contour_steps(mask).collect()) == beside


def test_density_sends_rows_of_boxes_not_their_pixels(spark):
    rng = random.Random(5)
    height, width, half = 40, 150, 6
    held = {(i, rng.randrange(height), rng.randrange(width)): float(rng.randrange(0, 255)) for i in (1, 2) for _ in range(60 + 800 * (i - 1))}
    pixels = spark.createDataFrame([(*p, v) for p, v in held.items()], "image_id long, row int, col int, value double")
    got = heatmap.density_maximum(pixels, height, width)
    # one exchange by pixel, for the count in the box
    assert len(re.findall(r"hashpartitioning\(image_id#\w+, row#\w+, col#\w+", got._jdf.queryExecution().executedPlan().toString())) == 1
    want = {}
    for (i, r, c), v in held.items():
        box = [(i, a, b) for a in range(max(0, r - half), min(height, r + half + 1)) for b in range(max(0, c - half), min(width, c + half + 1))]
        share = v / sum(p in held for p in box)
        for p in box:
            want[p] = max(want.get(p, 0.0), share)
    assert {(x.image_id, x.row, x.col): x.value for x in got.collect()} == want
