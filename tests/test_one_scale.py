"""One scale of the curvelet transform, of which half the wedges are computed, against the whole transform."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fibrespark.operators import curvelet

IMAGES = "image_id string, height int, width int, pixels array<double>"


@pytest.mark.parametrize("shape,coarse", [((64, 64), 16), ((96, 70), 16), ((129, 151), 8), ((20, 20), 16)])
def test_one_scale_equals_that_of_the_whole_transform(shape, coarse):
    image = np.random.default_rng(2).normal(size=shape)
    whole = curvelet.forward(image, None, coarse)
    for scale, level in enumerate(whole):
        got = curvelet.of_scale(image, scale, coarse)
        assert [c.shape for c in got] == [c.shape for c in level]
        assert max(np.abs(a - b).max() for a, b in zip(got, level)) < 1e-12
        alone = curvelet.inverse([lv if k == scale else [np.zeros_like(c) for c in lv] for k, lv in enumerate(whole)], *shape, coarse)
        assert np.abs(curvelet.inverse_half(curvelet.forward_half(image, scale, coarse), *shape, scale, coarse) - alone).max() < 1e-10


def test_energies_equal_those_of_the_coefficients_and_no_coefficient_leaves_its_task(spark):
    rng = np.random.default_rng(6)
    rows = [(name, *shape, rng.normal(size=shape).ravel().tolist()) for name, shape in (("a", (64, 64)), ("b", (70, 96)))] + [("dark", 64, 64, [0.0] * 4096)]
    images = spark.createDataFrame(rows, IMAGES)
    want = curvelet.transform_images(images).groupBy("image_id", "scale", "wedge", "n_wedges").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("energy"), F.count("*").alias("n"))
    got = curvelet.wedge_energies(images)
    assert got.count() == want.count() == 16 * 3
    key = ["image_id", "scale", "wedge", "n_wedges"]
    met = got.join(want.withColumnsRenamed({"energy": "e", "n": "m"}), key).where("n = m AND abs(energy - e) < 1e-9")
    assert met.count() == 16 * 3
    assert {r.image_id for r in got.where("energy = 0").collect()} == {"dark"}


@pytest.mark.parametrize("keep", [0.05, 1.0])
def test_reconstruction_equals_that_of_the_whole_transform(spark, keep):
    rng = np.random.default_rng(7)
    image = rng.normal(size=(70, 96))
    made = curvelet.forward(image)
    scale = len(made) - 2
    values = np.concatenate([np.abs(c).ravel() for c in made[scale]])
    step = values.max() / 100
    share = np.cumsum(np.bincount(np.floor(values / step + 0.5).astype(int), minlength=101))
    least = np.flatnonzero(share > (1 - keep) * len(values))[0] * step
    want = curvelet.inverse([[np.where(np.abs(c) >= least, c, 0) if k == scale else np.zeros_like(c) for c in lv] for k, lv in enumerate(made)], *image.shape)
    rows = [("a", 70, 96, image.ravel().tolist()), ("dark", 8, 8, [0.0] * 64)]
    got = {r.image_id: r.pixels for r in curvelet.reconstruct_images(spark.createDataFrame(rows, IMAGES), keep).collect()}
    assert np.abs(np.array(got["a"]) - want.ravel()).max() < 1e-5 and set(got["dark"]) == {0.0}


def test_images_by_their_lit_pixels(spark):
    image = np.zeros((64, 70))
    image[[3, 63, 40], [0, 69, 9]] = [1.0, 5.0, 2.0]
    whole = spark.createDataFrame([("a", 64, 70, image.ravel().tolist())], IMAGES)
    lit = spark.createDataFrame([("a", 64, 70, [40 * 70 + 9, 210, 64 * 70 - 1], [2.0, 1.0, 5.0])], "image_id string, height int, width int, places array<int>, levels array<double>")
    for f in (curvelet.wedge_energies, curvelet.transform_images, lambda x: curvelet.reconstruct_images(x, 0.05)):
        assert f(lit).collect() == f(whole).collect()
