"""Maps cut into tiles, against brute force on whole images."""

import math

import numpy as np
import pytest

from fibrespark.operators import heatmap

PIXELS = "image_id string, row int, col int, value double"


def alignments(image, size):
    out = {}
    for (r, c) in image:
        turns = [v * math.pi / 127.5 for (r2, c2), v in image.items() if abs(r - r2) < size and abs(c - c2) < size]
        if len(turns) > 2:
            out[r, c] = 255 * math.hypot(sum(map(math.cos, turns)), sum(map(math.sin, turns))) / len(turns)
    return out


def spread(image, height, width, half):
    out = {}
    for (r, c), v in image.items():
        n = sum(abs(r - r2) <= half and abs(c - c2) <= half for r2, c2 in image)
        for at in [(y, x) for y in range(max(0, r - half), min(height, r + half + 1)) for x in range(max(0, c - half), min(width, c + half + 1))]:
            out[at] = max(out.get(at, 0.0), v / n)
    return out


def blurred(image, height, width, sigma):
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    full = np.zeros((height, width))
    for at, v in image.items():
        full[at] = v
    full = np.pad(full, reach, mode="edge")
    for axis in (0, 1):
        full = np.apply_along_axis(np.convolve, axis, full, k, "valid")
    return {at: full[at] for at in np.ndindex(height, width) if full[at] > 0}


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(3)
    made = {}
    for name, n in (("a", 90), ("b", 2), ("c", 300)):
        made[name] = {(int(r), int(c)): float(v) for r, c, v in zip(rng.integers(0, 70, n), rng.integers(0, 53, n), rng.integers(0, 256, n))}
    made["a"] |= {(0, 0): 0.0, (69, 52): 255.0, (0, 52): 9.0}
    rows = [(name, r, c, v) for name, image in made.items() for (r, c), v in image.items()] + [("a", 33, 33, None)]
    made["a"].pop((33, 33), None)
    rows = [x for x in rows if x[:3] != ("a", 33, 33) or x[3] is None]
    return spark.createDataFrame(rows, PIXELS).repartition(3), made


def held(df):
    out = {}
    for r in df.collect():
        assert (r.row, r.col) not in out.setdefault(r.image_id, {})
        out[r.image_id][r.row, r.col] = r.value
    return out


def same(got, want):
    assert {k for k in want if want[k]} == set(got)
    for name, pixels in got.items():
        assert set(pixels) == set(want[name])
        assert all(v == pytest.approx(want[name][at], abs=1e-9) for at, v in pixels.items())


@pytest.mark.parametrize("tile", [16, 512])
def test_steps_on_tiles_equal_brute_force(images, tile):
    pixels, made = images
    same(held(heatmap.circular_filter(pixels, 7, tile=tile)), {k: alignments(v, 7) for k, v in made.items()})
    same(held(heatmap.circular_filter(pixels, 7, 70, 53, tile)), {k: alignments(v, 7) for k, v in made.items()})
    same(held(heatmap.density_maximum(pixels.where("value IS NOT NULL"), 70, 53, 8)), {k: spread(v, 70, 53, 4) for k, v in made.items()})
    same(held(heatmap.gaussian_filter(pixels, 70, 53, 1.5, tile)), {k: blurred(v, 70, 53, 1.5) for k, v in made.items()})


@pytest.mark.parametrize("tile", [16, 512])
@pytest.mark.parametrize("circular", [7, None])
def test_finished_maps_on_tiles_equal_brute_force(images, tile, circular):
    pixels, made = images
    want = {k: blurred(spread(alignments(v, circular) if circular else v, 70, 53, 3), 70, 53, 2.0) for k, v in made.items()}
    got = held(heatmap.processed_map(pixels, 70, 53, circular, 6, 2.0, tile))
    assert {k for k in want if want[k]} == set(got)
    for name, levels in got.items():
        assert set(levels) == set(want[name])
        assert all(v == math.floor(want[name][at]) or abs(v - want[name][at]) < 1e-6 for at, v in levels.items())


def test_maps_join_nothing_and_send_each_pixel_once_or_to_neighbouring_tiles(images):
    """Before, each value was sent to every pixel it reaches, twice, and pixels were joined with pixels."""
    pixels, _ = images
    for df in (heatmap.processed_map(pixels, 70, 53), heatmap.gaussian_filter(pixels, 70, 53), heatmap.circular_filter(pixels, 19, 70, 53)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Aggregate") == 0
