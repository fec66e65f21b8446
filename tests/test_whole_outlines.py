"""Images whose fibers and outlines fit a task are searched whole there; the others, and only they, by joins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_outlines import KINDS, outline

from fibrespark.operators import boundary, neighbors, outlines, roi

FIBERS = "image_id long, fiber_id long, center_row double, center_col double, note string"
POINTS = "image_id long, roi_id long, seq long, row long, col long"


def final_plan(df):
    """The plan that ran."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("keys", [("image_id",), ("image_id", "roi_id")])
def test_images_that_fit_a_task_shuffle_no_pairs(spark, keys, monkeypatch):
    rng = random.Random(3)
    fibers = [(i, k, float(rng.randrange(40)), rng.choice([None, *[float(rng.randrange(40))] * 9]), f"n{k}") for i in range(4) for k in range(8 * i + 1)]
    points = [(i, roi, s, rng.randrange(40), rng.randrange(40)) for i in range(1, 5) for roi in (7, 3, 5) for s in range(11 * i)]
    f, p = spark.createDataFrame(fibers, FIBERS), spark.createDataFrame(points, POINTS).repartition(3)
    want = {}
    for image, k, r, c, note in fibers:
        for i, roi, seq, pr, pc in points:
            if i == image and c is not None:
                key = (image, *([roi] if len(keys) > 1 else []), k, r, c, note)
                d = (math.sqrt((r - pr) ** 2 + (c - pc) ** 2), roi, seq, pr, pc)
                want[key] = min(want.get(key, d), d)
    whole = boundary.nearest_point(f, p, keys)
    assert sorted(map(tuple, whole.collect())) == sorted((*k, *d) for k, d in want.items())
    plan = final_plan(whole)
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan
    # images of more fibers or points than that go down the tree, with the same rows
    for limits in ((10, 40), (0, 0)):
        monkeypatch.setattr(boundary, "WHOLE", limits[0])
        monkeypatch.setattr(boundary, "WHOLE_POINTS", limits[1])
        some = boundary.nearest_point(f, p, keys)
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.collect()))
        assert "Window" in final_plan(some)


@pytest.mark.parametrize("points", [21, 7])
def test_slopes_in_a_task_equal_those_of_joins(spark, points):
    rows = [(0, k, 3 * n, float(r), float(c)) for k, kind in enumerate(KINDS) for n, (r, c) in enumerate(outline(kind))]
    frame = spark.createDataFrame(rows, "image_id long, roi_id long, seq long, row double, col double")
    want = {(r.roi_id, r.seq): r.slope for r in outlines.outline_slopes(frame, frame, points).collect()}
    for k in range(len(KINDS)):
        seq, row, col = (np.array([x[c] for x in rows if x[1] == k]) for c in (2, 3, 4))
        got = outlines.slopes_in_task(row, col, seq, np.arange(len(seq)), points)
        assert len(got) == len(seq) > 0
        for n, slope in zip(seq.tolist(), got.tolist()):
            assert (want[k, n] is None and math.isnan(slope)) or slope == pytest.approx(want[k, n], abs=1e-9), (KINDS[k], n)


def test_association_walks_in_the_task_of_an_image(spark, monkeypatch):
    rng = random.Random(8)
    fibers = [(i, k, float(rng.randrange(100)), float(rng.randrange(100)), rng.randrange(720) / 4) for i in range(3) for k in range(20 * i + 5)]
    rows = []
    for i, n, r, c, h, w in [(0, 1, 10, 10, 30, 50), (0, 2, 30, 40, 40, 40), (1, 3, 0, 5, 60, 20), (2, 4, 50, 50, 49, 49)]:
        rows += [(i, n, k, a, b) for k, (a, b) in enumerate([(r, c + k) for k in range(w)] + [(r + k, c + w) for k in range(h)] + [(r + h, c + w - k) for k in range(w)] + [(r + h - k, c) for k in range(h + 1)])]
    f, p = spark.createDataFrame(fibers, FIBERS.replace("note string", "angle double")), spark.createDataFrame(rows, POINTS)
    for least in (None, 4.0):
        make = lambda: boundary.global_association(f, p, roi.mask_of_polygons(p, 100, 100), 100, 100, 15.0, least)
        whole = make()
        want = sorted(map(tuple, whole.collect()))
        assert "collect_set" not in final_plan(whole) and final_plan(whole).count("FlatMapCoGroupsInArrow") == 1
        assert whole.where("relative_angle IS NOT NULL").count() == whole.where((F.col("distance") <= 15) & (F.col("distance") > (least or -1))).count() > 10
        with monkeypatch.context() as m:
            m.setattr(boundary, "WHOLE", 24)
            for a, b in zip(sorted(map(tuple, make().collect())), want, strict=True):
                assert [pytest.approx(x, abs=1e-9) if isinstance(x, float) else x for x in a] == list(b)


@pytest.mark.parametrize("least", [(2, 32), (3, 5)])
def test_features_in_the_task_of_an_image_equal_those_of_joins(spark, least):
    rng = random.Random(12)
    rows = [(i, 7 * k % 1009, float(rng.randrange(70)), rng.choice([None, *[float(rng.randrange(70))] * 9]), rng.choice([None, *[rng.randrange(720) / 4] * 5])) for i, n in enumerate((1, 2, 3, 12, 300)) for k in range(n)]
    rows += [(5, k, 3.0, 4.0, 10.0 * k) for k in range(40)] + [(None, 1, 1.0, 1.0, 1.0)]
    f = spark.createDataFrame(rows, FIBERS.replace("note string", "angle double")).repartition(3)
    whole = neighbors.fiber_features(f, *least)
    got = {(r.image_id, r.fiber_id): r.asDict() for r in whole.collect()}
    plan = final_plan(whole)
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Window" not in plan and "explode" not in plan.lower() and "Generate" not in plan
    by_joins = neighbors.neighbor_features(f, least[0]).join(neighbors.box_features(f, least[1]), ["image_id", "fiber_id"])
    assert by_joins.columns == whole.columns and by_joins.dtypes == whole.dtypes
    want = {(r.image_id, r.fiber_id): r.asDict() for r in by_joins.collect()}
    # only the largest image by joins, the others in tasks
    some = {(r.image_id, r.fiber_id): r.asDict() for r in neighbors.fiber_features(f, *least, whole=100).collect()}
    assert len(want) > 250 and set(got) == set(want) == set(some)
    for key, values in want.items():
        for c, x in values.items():
            for y in (got[key][c], some[key][c]):
                assert (x is None and y is None) or y == pytest.approx(x, abs=1e-9), (key, c)
