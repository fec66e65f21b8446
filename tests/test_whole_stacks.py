"""Stacks of one tile, transformed whole in a task, against the spread transform."""

import numpy as np

from fibrespark.operators import curvelet3d

SLICES = "image_id string, z int, height int, width int, pixels array<double>"


def test_whole_stacks_equal_spread_ones_whatever_is_left_out(spark):
    v = np.random.default_rng(9).normal(size=(6, 10, 9))
    slices = spark.createDataFrame([("a", z, 10, 9, v[z].ravel().tolist()) for z in (5, 0, 2)], SLICES)
    made = [{tuple(r[:11]): (r.re, r.im) for r in curvelet3d.transform_stacks(slices, 3, 4, tile).collect()} for tile in (61, 1 << 17)]
    assert set(made[0]) == set(made[1]) and all(np.allclose(x, made[1][k], atol=1e-12) for k, x in made[0].items())
    assert len(curvelet3d.stacked_boxes(curvelet3d.volume_frame, (6, 10, 9), 3, 4)) < 12  # boxes are transformed by size, not one by one
    kept = curvelet3d.transform_stacks(slices, 3, 4).where("wedge % 3 <> 1 AND k1 <> 2")
    back = [{r.z: r.pixels for r in curvelet3d.reconstruct_stacks(kept, 3, 4, tile).collect()} for tile in (61, 1 << 17)]
    assert set(back[0]) == set(back[1]) == set(range(6)) and all(np.allclose(x, back[1][z], atol=1e-9) for z, x in back[0].items())
