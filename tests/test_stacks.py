import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fibrespark.operators import curvelet, curvelet3d
from fibrespark.operators.curvelet3d import Frame
from fibrespark.plans.pipeline import AnalysisParameters, ParameterError, analyze_stacks, extract_fibers, extract_fibers_of_bands

SLICES = "image_id string, z int, height int, width int, pixels array<double>, note string"


def whole(volume, scales, coarse):
    """The transform of a volume in one piece."""
    frame = Frame(volume.shape, scales, coarse)
    cube = np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(volume))) / math.sqrt(volume.size)
    freq = [x.ravel() for x in np.meshgrid(*[np.arange(-(n // 2), (n + 1) // 2) for n in volume.shape], indexing="ij")]
    out = {}
    for scale in range(scales):
        for wedge in range(frame.n_wedges(scale)):
            weight, size = frame.weights(scale, wedge, freq), frame.box(scale, wedge)
            box = np.zeros(size, dtype=complex)
            used = np.flatnonzero(weight)
            box[tuple(f[used] % n for f, n in zip(freq, size))] = cube.ravel()[used] * weight[used]
            out[scale, wedge] = np.fft.fftshift(np.fft.ifftn(box)) * math.sqrt(box.size)
    return out


@pytest.mark.parametrize("dims,scales,coarse", [((16, 20, 24), 4, 4), ((9, 30, 17), 3, 2), ((12, 12, 12), 2, 8), ((40, 8, 8), 4, 3)])
def test_windows_are_a_partition_and_boxes_hold_each_frequency_once(dims, scales, coarse):
    frame = Frame(dims, scales, coarse)
    freq = [x.ravel() for x in np.meshgrid(*[np.arange(-(n // 2), (n + 1) // 2) for n in dims], indexing="ij")]
    squares = np.zeros(len(freq[0]))
    for scale in range(scales):
        wedges, at, weight = frame.windows(scale, freq)
        np.add.at(squares, at, weight**2)
        assert wedges.max() < frame.n_wedges(scale)
        for wedge in np.unique(wedges).tolist():
            mine = at[wedges == wedge]
            own = [f[mine] for f in freq]
            size = frame.box(scale, wedge)
            places = [f % n for f, n in zip(own, size)]
            assert len(np.unique(np.ravel_multi_index(places, size))) == len(mine)
            assert all((a == b).all() for a, b in zip(frame.unwrapped(scale, wedge, places), own))
            assert np.allclose(frame.weights(scale, wedge, own), weight[wedges == wedge])
    assert np.abs(squares - 1).max() < 1e-12


@pytest.mark.parametrize("tile", [97, 1 << 17])
def test_stacks_are_transformed_and_put_together_again(spark, tile):
    """With small tiles every box and every volume is over several tasks."""
    rng = np.random.default_rng(1)
    volumes = {"a": rng.normal(size=(8, 10, 12)), "b": rng.normal(size=(5, 12, 9))}
    rows = [(name, z, v.shape[1], v.shape[2], v[z].ravel().tolist(), "x") for name, v in volumes.items() for z in range(len(v)) if (name, z) != ("a", 3)]
    volumes["a"][3] = 0  # a missing slice
    slices = spark.createDataFrame([*rows, ("c", 0, 4, 4, None, "no pixels")], SLICES).repartition(3)
    planes = curvelet3d.transform_stacks(slices, 3, 2, tile)
    got = planes.collect()
    for name, v in volumes.items():
        want = whole(v, 3, 2)
        mine = [r for r in got if r.image_id == name]
        assert len(mine) == sum(x.shape[0] for x in want.values())
        for r in mine:
            assert np.abs(np.array(r.re) + 1j * np.array(r.im) - want[r.scale, r.wedge][r.k1].ravel()).max() < 1e-12
        assert sum(np.square(r.re).sum() + np.square(r.im).sum() for r in mine) == pytest.approx((v**2).sum(), rel=1e-12)
    back = curvelet3d.reconstruct_stacks(planes, 3, 2, tile).collect()
    assert len(back) == 13
    for r in back:
        assert np.abs(np.array(r.pixels).reshape(r.height, r.width) - volumes[r.image_id][r.z]).max() < 1e-9
    assert {r.image_id for r in back} == {"a", "b"}


def test_coefficients_of_a_wave_lie_across_it(spark):
    z, y, x = np.mgrid[:16, :16, :16]
    v = np.cos(2 * np.pi * 4 * x / 16)
    slices = spark.createDataFrame([("w", k, 16, 16, v[k].ravel().tolist(), "") for k in range(16)], SLICES)
    planes = curvelet3d.transform_stacks(slices, 3, 4)
    rows = curvelet3d.coefficient_rows(planes, 1)
    energy = {r.wedge: r.e for r in rows.groupBy("wedge").agg(F.sum(F.col("value") ** 2).alias("e")).collect()}
    strong = {w for w, e in energy.items() if e > 1e-6}
    assert {w // 16 for w in strong} == {4, 5} and len(strong) == 8  # both faces along the columns, the four wedges around their middle
    assert rows.select("k1", "k2", "k3").distinct().count() <= rows.count()
    done = analyze_stacks(slices, 1, 10, 0.9, 3, 4)
    assert {r.wedge for r in done.orientations.collect()} <= strong | set(energy) and done.slices.count() == 16
    with pytest.raises(ParameterError):
        analyze_stacks(slices, 3, scales=4)


def test_no_stacks(spark):
    none = spark.createDataFrame([], SLICES)
    assert curvelet3d.transform_stacks(none).count() == 0
    assert curvelet3d.reconstruct_stacks(curvelet3d.transform_stacks(none)).count() == 0


BANDS = "image_id string, first_row int, height int, width int, pixels array<double>"


def bands_of(name, image, rows):
    return [(name, k, image.shape[0], image.shape[1], image[k : k + rows].ravel().tolist()) for k in range(0, image.shape[0], rows)]


@pytest.mark.parametrize("height,width,scales,coarse", [(64, 64, 3, 16), (96, 70, 3, 16), (33, 120, 4, 8), (128, 20, 2, 16)])
def test_boxes_of_planes_hold_each_frequency_once(height, width, scales, coarse):
    frame = curvelet.PlaneFrame((height, 1, width), scales, coarse)
    freq = [x.ravel() for x in np.meshgrid(np.arange(height) - height // 2, [0], np.arange(width) - width // 2, indexing="ij")]
    squares = np.zeros(height * width)
    for scale in range(scales):
        wedges, at, weight = frame.windows(scale, freq)
        np.add.at(squares, at, weight**2)
        for wedge in np.unique(wedges).tolist():
            mine = at[wedges == wedge]
            own, size = [f[mine] for f in freq], frame.box(scale, wedge)
            places = [f % n for f, n in zip(own, size)]
            assert len(np.unique(np.ravel_multi_index(places, size))) == len(mine)
            assert all((a == b).all() for a, b in zip(frame.unwrapped(scale, wedge, places), own))
            assert np.allclose(frame.weights(scale, wedge, own), weight[wedges == wedge])
    assert np.abs(squares - 1).max() < 1e-12


@pytest.mark.parametrize("tile", [211, 1 << 17])
def test_bands_equal_whole_images(spark, tile):
    rng = np.random.default_rng(5)
    images = {"a": rng.normal(size=(64, 64)), "b": rng.normal(size=(96, 70))}
    bands = spark.createDataFrame([b for name, i in images.items() for b in bands_of(name, i, 7)] + [("c", 0, 4, 4, None)], BANDS).repartition(5)
    planes = curvelet3d.transform_bands(bands, tile_values=tile)
    got = {}
    for r in planes.collect():
        got[r.image_id, r.scale, r.wedge, r.k1] = np.array(r.re) + 1j * np.array(r.im)
    want = {(name, j, w, k): row for name, i in images.items() for j, level in enumerate(curvelet.forward(i)) for w, c in enumerate(level) for k, row in enumerate(c)}
    assert set(got) == set(want) and all(np.abs(got[k] - want[k]).max() < 1e-12 for k in want)
    back = curvelet3d.reconstruct_bands(planes, tile_values=tile).collect()
    assert len(back) == 160
    assert all(np.abs(np.array(r.pixels) - images[r.image_id][r.first_row]).max() < 1e-9 for r in back)


def test_coefficients_of_a_full_image(spark):
    y, x = np.mgrid[:512, :512]
    image = np.exp(-(((x - 256 + 0.5 * (y - 256)) / 2) ** 2)) + np.exp(-(((y - 300) / 2) ** 2))
    bands = spark.createDataFrame(bands_of("i", image, 64), BANDS)
    whole = spark.createDataFrame([("i", 512, 512, image.ravel().tolist())], "image_id string, height int, width int, pixels array<double>")
    key = ["image_id", "scale", "wedge", "n_wedges", "k1", "k2", "nx", "ny"]
    a = curvelet3d.band_coefficients(curvelet3d.transform_bands(bands)).select(*key, F.col("re").alias("r1"), F.col("im").alias("i1"))
    b = curvelet.transform_images(whole)
    met = a.join(b, key)
    assert met.count() == a.count() == b.count()
    assert met.agg(F.max(F.abs(F.col("r1") - F.col("re")) + F.abs(F.col("i1") - F.col("im")))).first()[0] < 1e-11


def test_fibers_of_bands_equal_those_of_images(spark):
    y, x = np.mgrid[:64, :96]
    image = np.exp(-(((x - 40 + 0.5 * (y - 30)) / 2) ** 2))
    bands = spark.createDataFrame(bands_of("i", image, 20), BANDS)
    whole = spark.createDataFrame([("i", 64, 96, image.ravel().tolist())], "image_id string, height int, width int, pixels array<double>")
    p = AnalysisParameters(64, 96)
    place = lambda f: sorted((r.center_row, r.center_col, round(r.angle, 6), r.weight) for r in f.collect())
    one, other = place(extract_fibers_of_bands(bands, p)), place(extract_fibers(whole, p))
    assert one == other and one
