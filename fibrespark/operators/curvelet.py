"""Fast discrete curvelet transform by wrapping, forward and inverse, in numpy per image; ``curvelet3d`` spreads it over tasks for images that don't fit one.

The construction is that of Candes, Demanet, Donoho and Ying (2006): smooth radial windows split the Fourier plane into nested squares, smooth
angular windows split each ring into wedges, and each wedge is wrapped onto a rectangle around the origin and inverse-transformed. Windows are a partition of unity in squares, so the
transform is a tight frame: energy is kept and the inverse is the adjoint. The finest level is one array of wavelets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def number_of_scales(height: int, width: int) -> int:
    return max(2, math.floor(math.log2(min(height, width)) - 3))


def _rise(x: np.ndarray) -> np.ndarray:
    """Smooth step from 0 (x <= 0) to 1 (x >= 1) with rise(x)**2 + rise(1 - x)**2 == 1."""
    x = np.clip(x, 0.0, 1.0)
    return np.sin(np.pi / 2 * x**4 * (35 - 84 * x + 70 * x**2 - 20 * x**3))


def wedges_at(scale: int, scales: int, coarse_wedges: int = 16) -> int:
    """Number of wedges of a scale counted from 0, the coarsest: 1 there and at the finest, else doubled at every other scale."""
    if scale == 0 or scale == scales - 1:
        return 1
    return coarse_wedges * 2 ** math.ceil((scale - 1) / 2)


@dataclass(frozen=True)
class PlaneFrame:
    """Windows over the frequencies of an image, and the boxes that wedges wrap onto, in closed form: no task needs the plane.

    An image is a volume of dims (height, 1, width), as the spread transform of volumes takes it. Frequencies are whole numbers around 0. ``coarse`` is a multiple of 4 and at least 8.
    """

    dims: tuple[int, int, int]
    scales: int
    coarse: int = 16

    def n_wedges(self, scale: int) -> int:
        return wedges_at(scale, self.scales, self.coarse)

    def _cut(self, scale: int) -> float:
        return 2.0 ** (scale - self.scales + 1) / 1.5

    def _relative(self, freq: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return freq[0] / (self.dims[0] / 2), freq[2] / (self.dims[2] / 2)

    def _low(self, scale: int, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        cut = self._cut(scale)
        return _rise((2 * cut - np.abs(y)) / cut) * _rise((2 * cut - np.abs(x)) / cut)

    def _ring(self, scale: int, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The scale's radial window; the squares of all sum to 1."""
        outer = 1.0 if scale == self.scales - 1 else self._low(scale, y, x) ** 2
        inner = 0.0 if scale == 0 else self._low(scale - 1, y, x) ** 2
        return np.sqrt(np.clip(outer - inner, 0, 1))

    @staticmethod
    def _around(y: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Place in [0, n) along the border of the square through each frequency: a side holds n / 4 wedges of equal width; angles fall from wedge 0, just under 45 degrees."""
        big = np.maximum(np.maximum(np.abs(x), np.abs(y)), 1e-12)
        u = np.where(np.abs(x) >= np.abs(y), np.where(x > 0, 0.5 + y / big / 2, 2.5 - y / big / 2), np.where(y > 0, 1.5 - x / big / 2, 3.5 + x / big / 2))
        return ((u - 1) * n / 4) % n

    def windows(self, scale: int, freq: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(wedge, place, weight) of every window of the scale that isn't zero at a place."""
        y, x = self._relative(freq)
        ring, n = self._ring(scale, y, x), self.n_wedges(scale)
        used = np.flatnonzero(ring)
        if n == 1:
            return np.zeros(len(used), np.int64), used, ring[used]
        around = self._around(y[used], x[used], n)
        found = []
        for step in (0, 1):
            k = np.floor(around - 0.5) + step
            weight = _rise(1 - np.abs(around - k - 0.5)) * ring[used]
            ok = weight > 0
            found.append(((k[ok] % n).astype(np.int64), used[ok], weight[ok]))
        return tuple(np.concatenate(f) for f in zip(*found))

    def weights(self, scale: int, wedge: int, freq: list[np.ndarray]) -> np.ndarray:
        """The wedge's window at each place."""
        y, x = self._relative(freq)
        ring, n = self._ring(scale, y, x), self.n_wedges(scale)
        if n == 1:
            return ring
        return ring * _rise(1 - np.abs((self._around(y, x, n) - wedge - 0.5 + n / 2) % n - n / 2))

    def box(self, scale: int, wedge: int) -> tuple[int, int, int]:
        return self._place(scale, wedge)[0]

    def _place(self, scale: int, wedge: int) -> tuple[tuple[int, int, int], int, int, int, float]:
        """(sizes, long axis, sign, first frequency along it, slope of the first frequency of the other axis).

        The box is as long as the wedge along the axis that its side of the square crosses, and as wide as its widest cross-section.
        """
        n = self.n_wedges(scale)
        if n == 1:
            reach = [math.ceil(2 * self._cut(0) * d / 2) - 1 for d in self.dims]
            return tuple(d if scale or d == 1 else min(d, 2 * r + 1) for d, r in zip(self.dims, reach)), -1, 1, 0, 0.0
        side, at = divmod(wedge, n // 4)
        axis, sign = ((0, 1), (2, -1), (0, -1), (2, 1))[side]
        ends = sorted(1 - 8 * (at + e) / n if side < 2 else 8 * (at + e) / n - 1 for e in (-0.5, 1.5))
        # beyond the corner the border runs along the other axis
        t0, t1 = [t if abs(t) <= 1 else math.copysign(1 / (2 - abs(t)), t) for t in ends]
        low, high = self._cut(scale - 1) / max(1.0, abs(t0), abs(t1)), 2 * self._cut(scale)
        half = self.dims[axis] / 2
        first, last = math.floor(low * half) + 1, min(math.ceil(high * half) - 1, self.dims[axis] // 2)
        size = [1, 1, 1]
        size[axis] = max(1, last - first + 1)
        size[2 - axis] = min(self.dims[2 - axis], math.floor(high * (t1 - t0) * self.dims[2 - axis] / 2) + 1)
        return tuple(size), axis, sign, first if sign > 0 else -last, t0

    def unwrapped(self, scale: int, wedge: int, places: list[np.ndarray]) -> list[np.ndarray]:
        """The one frequency of the wedge that is wrapped onto each place of its box."""
        size, axis, sign, first, slope = self._place(scale, wedge)
        if axis < 0:
            return [(p + n // 2) % n - n // 2 for p, n in zip(places, size)]
        freq = [np.zeros_like(places[1])] * 3
        freq[axis] = first + (places[axis] - first) % size[axis]
        other = 2 - axis
        n = self.dims[other]
        start = np.floor(sign * freq[axis] / (self.dims[axis] / 2) * slope * n / 2).astype(np.int64) + 1 if size[other] < n else -(n // 2)
        freq[other] = start + (places[other] - start) % size[other]
        return freq


@lru_cache(maxsize=16)
def plane_frame(dims: tuple[int, int, int], scales: int | None = None, coarse_wedges: int = 16) -> PlaneFrame:
    return PlaneFrame(dims, scales or number_of_scales(dims[0], dims[2]), coarse_wedges)


@lru_cache(maxsize=4)
def plan(height: int, width: int, scales: int | None = None, coarse_wedges: int = 16) -> list[list[tuple]]:
    """Per scale and wedge: (rows and columns of the centred plane, weights, rows and columns of the box, its size)."""
    frame = plane_frame((height, 1, width), scales, coarse_wedges)
    r, c = (x.ravel() for x in np.meshgrid(np.arange(height) - height // 2, np.arange(width) - width // 2, indexing="ij"))
    out = []
    for scale in range(frame.scales):
        wedge, at, weight = frame.windows(scale, [r, np.zeros_like(r), c])
        order = np.argsort(wedge, kind="stable")
        bounds = np.searchsorted(wedge[order], np.arange(frame.n_wedges(scale) + 1))
        level = []
        for k in range(frame.n_wedges(scale)):
            mine, own = at[order[bounds[k] : bounds[k + 1]]], weight[order[bounds[k] : bounds[k + 1]]]
            rows, _, cols = frame.box(scale, k)
            level.append((r[mine] + height // 2, c[mine] + width // 2, own, r[mine] % rows, c[mine] % cols, rows, cols))
        out.append(level)
    return out


def forward(image: np.ndarray, scales: int | None = None, coarse_wedges: int = 16) -> list[list[np.ndarray]]:
    """Coefficients by scale (coarsest first) and wedge, complex."""
    height, width = image.shape
    plane = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(image))) / math.sqrt(height * width)
    out = []
    for level in plan(height, width, scales, coarse_wedges):
        made = []
        for r, c, weight, to_r, to_c, rows, cols in level:
            small = np.zeros((rows, cols), dtype=complex)
            small[to_r, to_c] = plane[r, c] * weight
            made.append(np.fft.fftshift(np.fft.ifft2(small)) * math.sqrt(rows * cols))
        out.append(made)
    return out


def inverse(coefficients: list[list[np.ndarray]], height: int, width: int, coarse_wedges: int = 16) -> np.ndarray:
    plane = np.zeros((height, width), dtype=complex)
    for level, made in zip(plan(height, width, len(coefficients), coarse_wedges), coefficients):
        for (r, c, weight, to_r, to_c, rows, cols), coefficient in zip(level, made):
            small = np.fft.fft2(np.fft.ifftshift(coefficient)) / math.sqrt(rows * cols)
            plane[r, c] += small[to_r, to_c] * weight
    return np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(plane))).real * math.sqrt(height * width)


def _own(images: DataFrame) -> DataFrame:
    """Images come with ``pixels`` (array<double>, row by row) or, where most pixels are 0, with ``places`` (array<int>, from 0, row by row) and ``levels`` (array<double>) of the others."""
    return images.select("image_id", "height", "width", *(["pixels"] if "pixels" in images.columns else ["places", "levels"]))


def _image(row) -> np.ndarray:
    if hasattr(row, "pixels"):
        return np.asarray(row.pixels, dtype=float).reshape(int(row.height), int(row.width))
    image = np.zeros(int(row.height) * int(row.width))
    image[np.asarray(row.places, dtype=np.int64)] = row.levels
    return image.reshape(int(row.height), int(row.width))


@lru_cache(maxsize=4)
def half_plan(height: int, width: int, scale: int, coarse_wedges: int = 16) -> tuple[int, list[tuple]]:
    """(number of wedges of the scale, per size of boxes: wedges, rows, columns, places in the plane, weights, places in the boxes) of the first half of the wedges.

    An image is real, so the coefficients of the opposite wedge are the conjugates: its window is the mirrored one and its box has the same size. Planes and boxes begin with frequency 0."""
    frame = plane_frame((height, 1, width), None, coarse_wedges)
    r, c = (x.ravel() for x in np.meshgrid(np.arange(height) - height // 2, np.arange(width) - width // 2, indexing="ij"))
    wedge, at, weight = frame.windows(scale, [r, np.zeros_like(r), c])
    n, sizes = frame.n_wedges(scale), {}
    for k in range(max(1, n // 2)):
        sizes.setdefault(frame.box(scale, k)[::2], []).append(k)
    out = []
    for (rows, cols), wedges in sizes.items():
        nth = np.full(n, -1)
        nth[wedges] = np.arange(len(wedges))
        mine = np.flatnonzero(nth[wedge] >= 0)
        y, x = r[at[mine]], c[at[mine]]
        out.append((wedges, rows, cols, y % height * width + x % width, weight[mine], (nth[wedge[mine]] * rows + y % rows) * cols + x % cols))
    return n, out


def forward_half(image: np.ndarray, scale: int, coarse_wedges: int = 16) -> list[np.ndarray]:
    """Coefficients of one scale, boxes of one size (half_plan()) stacked; each box begins with its middle."""
    height, width = image.shape
    plane = np.fft.fft2(np.fft.ifftshift(image)).ravel() / math.sqrt(height * width)
    made = []
    for wedges, rows, cols, at, weight, to in half_plan(height, width, scale, coarse_wedges)[1]:
        small = np.zeros(len(wedges) * rows * cols, dtype=complex)
        small[to] = plane[at] * weight
        made.append(np.fft.ifft2(small.reshape(-1, rows, cols)) * math.sqrt(rows * cols))
    return made


def inverse_half(coefficients: list[np.ndarray], height: int, width: int, scale: int, coarse_wedges: int = 16) -> np.ndarray:
    """The image that these and the opposite wedges' coefficients of one scale make."""
    n, boxes = half_plan(height, width, scale, coarse_wedges)
    values = np.concatenate([np.fft.fft2(made).ravel()[to] * (weight / math.sqrt(rows * cols)) for made, (_, rows, cols, _, weight, to) in zip(coefficients, boxes)])
    at, plane = np.concatenate([b[3] for b in boxes]), np.empty(height * width, dtype=complex)
    plane.real, plane.imag = (np.bincount(at, part, height * width) for part in (values.real, values.imag))
    return np.fft.fftshift(np.fft.ifft2(plane.reshape(height, width)).real) * (math.sqrt(height * width) * (2 if n > 1 else 1))


def of_scale(image: np.ndarray, scale: int, coarse_wedges: int = 16) -> list[np.ndarray]:
    """forward() of one scale: coefficients by wedge."""
    n, boxes = half_plan(*image.shape, scale, coarse_wedges)
    out: list = [None] * n
    for made, (wedges, *_) in zip(forward_half(image, scale, coarse_wedges), boxes):
        for k, c in zip(wedges, made):
            out[k] = np.fft.fftshift(c)
            if n > 1:
                out[k + n // 2] = out[k].conj()
    return out


def transform_images(images: DataFrame, scale_from_finest: int = 1, coarse_wedges: int = 16) -> DataFrame:
    """Images (image_id, height, width and pixels or places and levels) to the coefficients of one scale (1: the second finest):
    image_id, scale, wedge, n_wedges, k1, k2, nx, ny, sx, sy, re, im, value (magnitude). One image a row, so tasks hold one image at a time."""
    kind = images.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                scale = number_of_scales(int(row.height), int(row.width)) - 1 - scale_from_finest
                if scale < 0:
                    continue
                made = of_scale(_image(row), scale, coarse_wedges)
                for wedge, c in enumerate(made):
                    nx, ny = c.shape
                    k1, k2 = np.divmod(np.arange(nx * ny), ny)
                    flat = c.ravel()
                    yield pd.DataFrame({
                        "image_id": row.image_id, "scale": scale, "wedge": wedge, "n_wedges": len(made), "k1": k1, "k2": k2, "nx": nx, "ny": ny,
                        "sx": 1.0 / nx, "sy": 1.0 / ny, "re": flat.real, "im": flat.imag, "value": np.abs(flat),
                    })

    ints = ", ".join(f"{c} int" for c in ("scale", "wedge", "n_wedges", "k1", "k2", "nx", "ny"))
    return _own(images).mapInPandas(run, f"image_id {kind}, {ints}, sx double, sy double, re double, im double, value double")


def wedge_energies(images: DataFrame, scale_from_finest: int = 1, coarse_wedges: int = 16) -> DataFrame:
    """transform_images() summed by wedge, in the task that has the image: image_id, scale, wedge, n_wedges, energy (sum of squared magnitudes), n (coefficients)."""
    kind = images.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                scale = number_of_scales(int(row.height), int(row.width)) - 1 - scale_from_finest
                if scale < 0:
                    continue
                n, boxes = half_plan(int(row.height), int(row.width), scale, coarse_wedges)
                for made, (wedges, *_) in zip(forward_half(_image(row), scale, coarse_wedges), boxes):
                    for k, c in zip(wedges, made):
                        flat = c.ravel().view(float)
                        rows += [(row.image_id, scale, w, n, float(flat @ flat), c.size) for w in ((k, k + n // 2) if n > 1 else (k,))]
            yield pd.DataFrame(rows, columns=["image_id", "scale", "wedge", "n_wedges", "energy", "n"])

    return _own(images).mapInPandas(run, f"image_id {kind}, scale int, wedge int, n_wedges int, energy double, n long")


def reconstruct_images(images: DataFrame, keep: float, scale_from_finest: int = 1, coarse_wedges: int = 16, bins: int = 101) -> DataFrame:
    """(image_id, height, width, pixels array<float>): each image from its coefficients of one scale at or above the threshold that keeps a share of ``keep`` of them."""
    kind = images.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                height, width = int(row.height), int(row.width)
                scale = number_of_scales(height, width) - 1 - scale_from_finest
                pixels = np.zeros(height * width, np.float32)
                if scale >= 0:
                    made = forward_half(_image(row), scale, coarse_wedges)
                    sizes = [np.abs(c) for c in made]
                    # opposite wedges have the same magnitudes, so half of them give the shares
                    values = np.concatenate([v.ravel() for v in sizes])
                    step = values.max() / (bins - 1)
                    counts = np.bincount(np.minimum(np.floor(values / step + 0.5), bins - 1).astype(int), minlength=bins) if step else np.array([len(values)])
                    over = np.flatnonzero(np.cumsum(counts) > (1 - keep) * len(values))
                    least = over[0] * step if len(over) else np.inf
                    pixels = inverse_half([np.where(v >= least, c, 0) for v, c in zip(sizes, made)], height, width, scale, coarse_wedges).astype(np.float32).ravel()
                yield pd.DataFrame([(row.image_id, height, width, pixels)], columns=["image_id", "height", "width", "pixels"])

    return _own(images).mapInPandas(run, f"image_id {kind}, height int, width int, pixels array<float>")
