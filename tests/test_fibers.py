import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fibrespark.functions import angles
from fibrespark.operators import boundary, coefficients, contours, curvelet, grouping, heatmap, neighbors, roi, sinks, statistics
from fibrespark.plans.pipeline import AnalysisParameters, ParameterError, analyze_fibers, extract_fibers

FIBERS = "image_id long, fiber_id long, center_row double, center_col double, angle double"


def fibers_of(spark, n, seed=0, images=1, side=200):
    rng = np.random.default_rng(seed)
    rows = [(i, k, float(rng.integers(0, side)), float(rng.integers(0, side)), float(rng.integers(0, 1440) / 8)) for i in range(images) for k in range(n)]
    return spark.createDataFrame(rows, FIBERS), rows


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def square(image, roi_id, r0, c0, h, w):
    path = [(r0, c) for c in range(c0, c0 + w)] + [(r, c0 + w) for r in range(r0, r0 + h)] + [(r0 + h, c) for c in range(c0 + w, c0, -1)] + [(r, c0) for r in range(r0 + h, r0 - 1, -1)]
    return [(image, roi_id, k, r, c) for k, (r, c) in enumerate(path)]


POINTS = "image_id long, roi_id long, seq long, row long, col long"


@pytest.mark.parametrize("n", [0, 1, 2, 17, 120])
def test_neighbor_features_equal_brute_force(spark, n):
    f, rows = fibers_of(spark, n, seed=n)
    got = {r.fiber_id: r for r in neighbors.fiber_features(f).collect()}
    assert len(got) == n
    for _, k, r, c, _ in rows:
        near = sorted((math.dist((r, c), (x[2], x[3])), x[1], x[4]) for x in rows if x[1] != k)
        for m in (2, 4, 8, 16):
            d = got[k][f"distance_to_nearest_{m}_fibers"]
            if len(near) < m:
                assert d is None and got[k]["alignment_mean"] is None
                continue
            assert d == pytest.approx(np.mean([x[0] for x in near[:m]]))
            a = np.radians([2 * x[2] for x in near[:m]])
            assert got[k][f"alignment_of_nearest_{m}_fibers"] == pytest.approx(math.hypot(np.cos(a).sum(), np.sin(a).sum()) / m)
        for b in (32, 64, 128):
            inside = [x for x in rows if abs(x[2] - r) < b / 2 and abs(x[3] - c) < b / 2]
            assert got[k][f"fibers_within_box_density{b}"] == len(inside)


def test_neighbors_of_a_crowd_in_a_corner(spark):
    rows = [(0, k, float(k % 7), float(k // 7), 10.0) for k in range(60)] + [(0, 100, 900.0, 900.0, 20.0)]
    got = neighbors.nearest_neighbors(spark.createDataFrame(rows, FIBERS), 5).where("fiber_id = 100").orderBy("rank").collect()
    want = sorted((math.dist((900, 900), x[2:4]), x[1]) for x in rows if x[1] != 100)[:5]
    assert [(pytest.approx(r.distance), r.nb_id) for r in got] == want


def test_angle_functions(spark):
    assert value(spark, angles.round_half_up(F.lit(-0.5))) == 0 and value(spark, angles.round_half_even(F.lit(2.5))) == 2
    assert value(spark, angles.fold90(F.lit(170.0), F.lit(10.0))) == pytest.approx(20)
    assert value(spark, angles.edge_angle(F.lit(30.0), F.lit(120.0))) == pytest.approx(0, abs=1e-6)
    assert value(spark, angles.centers_line(F.lit(1.0), F.lit(0.0))) == pytest.approx(90)
    assert value(spark, angles.centers_line(F.lit(0.0), F.lit(0.0))) is None
    # two of 64 wedges whose angles are known
    assert value(spark, angles.wedge_angle(F.lit(30), 64)) == pytest.approx(53.4375)
    assert value(spark, angles.wrap180(angles.wedge_angle(F.lit(0), 64))) == pytest.approx(42.1875)
    assert value(spark, angles.wrap180(F.lit(-10.0))) == pytest.approx(170)
    assert value(spark, angles.uint8(F.lit(300.7))) == 255 and value(spark, angles.uint8(F.lit(-3.0))) == 0
    assert value(spark, angles.on_image_edge(F.lit(512), F.lit(7), F.lit(512), F.lit(512), 1)) is True


def test_histograms(spark):
    f = spark.createDataFrame([(0, k, 0.0, 0.0, a) for k, a in enumerate([1.0, 2.5, 7.5, 177.5, 179.0, 90.0])], FIBERS)
    edges = {r.bin: r["count"] for r in statistics.angle_histogram(f).collect()}
    assert len(edges) == 35 and sum(edges.values()) == 4 and edges[0] == 1 and edges[1] == 1 and edges[34] == 1
    centers = {r.bin: r["count"] for r in statistics.angle_histogram(f, mode="centers").collect()}
    assert len(centers) == 36 and sum(centers.values()) == 6


def test_association_with_a_square(spark):
    points = spark.createDataFrame(square(0, 1, 50, 50, 40, 40), POINTS)
    f = spark.createDataFrame([(0, 1, 45.0, 70.0, 0.0), (0, 2, 70.0, 70.0, 30.0), (0, 3, 190.0, 190.0, 0.0)], FIBERS)
    mask = roi.polygon_mask(points, 200, 200).withColumn("value", F.lit(255))
    got = {r.fiber_id: r for r in boundary.global_association(f, points, mask, 200, 200, 30.0).collect()}
    assert got[1].distance == 5 and got[1].included and got[1].relative_angle == pytest.approx(0, abs=1e-4)
    assert got[2].region == 1 and not got[2].included and got[2].excluded
    assert got[3].relative_angle is None and not got[3].included
    banded = {r.fiber_id: r.included for r in boundary.association_flags(boundary.mask_value(boundary.nearest_point(f, points), mask, 200, 200), 30.0, 6.0).collect()}
    assert banded == {1: False, 2: False, 3: False}


def test_region_properties(spark):
    points = spark.createDataFrame(square(0, 1, 10, 20, 20, 80) + square(0, 2, 100, 100, 60, 10) + square(1, 3, 5, 5, 10, 10), POINTS)
    got = {r.roi_id: r for r in roi.region_properties(roi.polygon_mask(points, 200, 200)).collect()}
    assert got[1].area == 20 * 80 and got[1].orientation == pytest.approx(0) and got[2].orientation == pytest.approx(90)
    assert (got[1].roi_row, got[1].roi_col) == (19.5, 59.5)
    f = spark.createDataFrame([(0, 1, 5.0, 60.0, 10.0)], FIBERS)
    details = roi.roi_alignment(f, points, 200, 200, 30.0)
    assert [(r.roi_id, r.fiber_angle) for r in details.collect()] == [(1, 10.0)]
    summary = {r.roi_id: r for r in roi.roi_summary(details, points, 200, 200).collect()}
    assert summary[1].number_of_fibers == 1 and summary[1].mean_angle_to_boundary_center == pytest.approx(10)
    assert summary[2].number_of_fibers == 0 and summary[2].mean_angle_to_boundary_edge is None
    assert roi.roi_alignment(f, points, 200, 200, None).count() == 2


def test_segments_and_extension(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 4.0), (2, 5.0, 5.0, 5.0, 5.0)], "k long, a double, b double, c double, d double")
    got = {k: [(r.px_row, r.px_col) for r in boundary.segment_pixels(rows, "a", "b", "c", "d").where(F.col("k") == k).orderBy("px_step").collect()] for k in (1, 2)}
    assert got[1][0] == (0, 0) and got[1][-1] == (3, 4) and got[2] == [(5, 5)]
    assert all(max(abs(x[0] - y[0]), abs(x[1] - y[1])) == 1 for x, y in zip(got[1], got[1][1:]))
    points = spark.createDataFrame(square(0, 1, 50, 50, 40, 40), POINTS)
    f = spark.createDataFrame([(0, 1, 70.0, 40.0, 0.0)], FIBERS)
    assert boundary.extension_points(f, points, 30.0).first()["extension_point_distance"] == pytest.approx(10)


def test_coefficients(spark):
    rows = [(0, w, k, 0, float(w * 10 + k)) for w in range(4) for k in range(10)] + [(1, 0, 0, 0, 0.0)]
    c = spark.createDataFrame(rows, "image_id long, wedge long, k1 long, k2 long, value double")
    limits = {r.image_id: r.threshold for r in coefficients.keep_threshold(c, 0.1).collect()}
    assert limits[1] == 0 and sum(x[4] >= limits[0] for x in rows) == pytest.approx(4, abs=1)
    assert {r.image_id for r in coefficients.kept_coefficients(c, 0.1).collect()} == {0}
    top = coefficients.top_wedges(coefficients.wedge_means(c.where("image_id = 0")), 50).collect()
    assert sorted(r.wedge for r in top) == [2, 3]
    assert coefficients.top_wedges(coefficients.wedge_means(c), 10).count() == 0


def test_grouping_takes_free_points_once(spark):
    rows = [(0, 0, 50.0, 50.0, 178.0), (0, 1, 52.0, 49.0, 2.0), (0, 2, 80.0, 80.0, 40.0), (0, 3, 59.0, 50.0, 90.0)]
    p = spark.createDataFrame(rows, "image_id long, seed long, center_row double, center_col double, angle double")
    got = {r.fiber_id: r for r in grouping.group_curvelets(p, 8.0, 5.625).collect()}
    assert set(got) == {0, 2, 3} and got[0].weight == 2 and got[0].angle == pytest.approx(0) and (got[0].center_row, got[0].center_col) == (51, 50)


def test_curvelet_transform_is_a_tight_frame():
    rng = np.random.default_rng(0)
    for shape in ((64, 64), (96, 70)):
        image = rng.normal(size=shape)
        c = curvelet.forward(image)
        assert np.abs(curvelet.inverse(c, *shape) - image).max() < 1e-10
        assert sum((np.abs(x) ** 2).sum() for level in c for x in level) == pytest.approx((image**2).sum())
    assert curvelet.wedges_at(4, 6) == 64 and curvelet.number_of_scales(512, 512) == 6


@pytest.mark.parametrize("angle", [0, 45, 70, 90, 135, 160])
def test_extracted_fibers_follow_a_line(spark, angle):
    y, x = np.mgrid[:64, :64]
    t = np.radians(angle)
    image = np.exp(-(((np.sin(t) * (x - 32) + np.cos(t) * (y - 32)) / 1.5) ** 2))
    rows = [(7, 64, 64, image.ravel().tolist())]
    images = spark.createDataFrame(rows, "image_id long, height int, width int, pixels array<double>")
    f = extract_fibers(images, AnalysisParameters(64, 64)).collect()
    off = [abs((r.angle - angle + 90) % 180 - 90) for r in f]
    assert f and np.median(off) <= 12


def test_heatmap_steps(spark):
    f, _ = fibers_of(spark, 60, side=60)
    raw = heatmap.raw_map(f, 60, 60)
    seen = {(r.row, r.col): r.value for r in raw.collect()}
    done = {(r.row, r.col): r.value for r in heatmap.density_maximum(raw, 60, 60, 12).collect()}
    counts = {p: sum(abs(p[0] - q[0]) <= 6 and abs(p[1] - q[1]) <= 6 for q in seen) for p in seen}
    for p in list(done)[:50]:
        want = max(seen[q] / counts[q] for q in seen if abs(p[0] - q[0]) <= 6 and abs(p[1] - q[1]) <= 6)
        assert done[p] == pytest.approx(want)
    # a plane of one value stays as it is, borders included
    flat = spark.createDataFrame([(0, r, c, 9.0) for r in range(20) for c in range(20)], "image_id long, row int, col int, value double")
    assert all(r.value == pytest.approx(9.0) for r in heatmap.gaussian_filter(flat, 20, 20, 2.0).collect())


def test_contours_and_components(spark):
    rows = [(0, r, c, 1) for r in range(3, 6) for c in range(3, 7)] + [(0, 6, 7, 1), (0, 12, 12, 1)]
    mask = spark.createDataFrame(rows, "image_id long, row long, col long, value int")
    assert {r.roi_id for r in contours.mask_components(mask).collect()} == {1, 2}
    outline = contours.mask_contours(mask).where("roi_id = 2").orderBy("seq").collect()
    assert len(outline) == 5 and (outline[0].row, outline[0].col) == (outline[-1].row, outline[-1].col)
    assert {(r.row, r.col) for r in outline} == {(11.5, 12.0), (12.5, 12.0), (12.0, 11.5), (12.0, 12.5)}


def test_whole_analysis_and_sinks(spark, tmp_path):
    f, _ = fibers_of(spark, 40, images=2)
    points = spark.createDataFrame(square(0, 1, 50, 50, 40, 40) + square(1, 2, 20, 20, 90, 60), POINTS)
    done = analyze_fibers(f, AnalysisParameters(200, 200), points)
    done.write(str(tmp_path))
    table = spark.read.parquet(f"{tmp_path}/features")
    assert table.count() == 80 and len(table.columns) == 35
    assert done.features.columns == ["image_id", *sinks.BASE, *sinks.feature_columns(), *sinks.BOUNDARY]
    assert spark.read.parquet(f"{tmp_path}/overlay").where("kind = 'boundary'").count() == points.count() - 2
    labels = {r.roi_id: r for r in spark.read.parquet(f"{tmp_path}/roi_labels").collect()}
    assert set(labels) == {1, 2} and math.dist((labels[2].x1, labels[2].y1), (labels[2].x2, labels[2].y2)) == pytest.approx(40)
    alone = analyze_fibers(f, AnalysisParameters(200, 200))
    assert alone.features.count() == 80 and alone.values.count() == 80 and alone.map.count() > 0
    with pytest.raises(ParameterError):
        AnalysisParameters(0, 5)


def test_area_samples_equal_brute_force(spark):
    rows = square(0, 1, 50, 50, 40, 40)
    got = boundary.area_samples(spark.createDataFrame(rows, POINTS), 100, 100, 10.0).first()["num_points"]
    third = sorted((c, r) for _, _, _, r, c in rows)[::3]
    hit = sum(any(math.dist((i % 100, i // 100), (r, c)) <= 10 for c, r in third) for i in range(0, 10000, 5))
    assert got == hit * 5


def test_gaussian_of_the_default_width_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    image = np.where(rng.random((30, 41)) < 0.1, rng.integers(1, 256, (30, 41)), 0).astype(float)
    rows = [(1, int(r), int(c), float(image[r, c])) for r, c in zip(*np.nonzero(image))]
    k = np.exp(-0.5 * (np.arange(-16, 17) / 4.0) ** 2)
    k /= k.sum()
    want = np.pad(image, 16, mode="edge")
    want = np.apply_along_axis(np.convolve, 0, want, k, "valid")
    want = np.apply_along_axis(np.convolve, 1, want, k, "valid")
    got = np.zeros_like(want)
    for r in heatmap.gaussian_filter(spark.createDataFrame(rows, "image_id long, row int, col int, value double"), 30, 41).collect():
        got[r.row, r.col] = r.value
    assert np.abs(got - want).max() < 1e-9
