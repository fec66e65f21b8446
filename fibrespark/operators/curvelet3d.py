"""Curvelet transform of image stacks, forward and inverse, spread over tasks: no task holds a volume beyond one tile.

The frequency cube is split by smooth radial windows into nested shells, and each shell but the coarsest and the finest by smooth windows over the six faces of the cube
into wedges, as Ying, Demanet and Candes (2005) do. Windows are normalised, so their squares sum to one and the transform is a tight frame. A wedge's frequencies
are wrapped onto a box that is as long as the wedge along its face's axis and, across it, as wide as its widest cross-section.

A Fourier transform of a volume is one over the two axes of each slice, an exchange, and one along pencils of the third axis. Pencils are dealt in tiles of at most
``TILE`` values, and so are the boxes of wedges on their way back, by pencils first and then by planes:

    slices -> (volume, tile): all frequencies of a tile, times the windows -> (wedge, tile): along axis 1 -> (wedge, plane): the other two -> coefficients

and the same backwards. Volumes of at most one tile go through both at once, in a task each, with the boxes of one size stacked. Axes are (z, row, column) = (k1, k2, k3). Slices: image_id (the stack), z (from 0, unique), height, width, pixels. Missing slices are zero.
A stack's slices have one size. Stacks without slices, or with null pixels: no rows. One slice, or one plane of a box, must fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibrespark.operators.curvelet import _rise, plane_frame

TILE = 1 << 17
SCALES = 4
COARSE_WEDGES = 8


@dataclass(frozen=True)
class Frame:
    """Windows over the frequencies of a volume, and the boxes that wedges wrap onto. Frequencies are whole numbers around 0."""

    dims: tuple[int, int, int]
    scales: int = SCALES
    coarse: int = COARSE_WEDGES

    def side(self, scale: int) -> int:
        """Wedges along a side of a face; 0 for the scales without directions."""
        return 0 if scale in (0, self.scales - 1) else self.coarse * 2 ** math.ceil((scale - 1) / 2)

    def n_wedges(self, scale: int) -> int:
        return max(1, 6 * self.side(scale) ** 2)

    def _cut(self, scale: int) -> float:
        return 2.0 ** (scale - self.scales + 1) / 1.5

    def _low(self, scale: int, at: list[np.ndarray]) -> np.ndarray:
        cut = self._cut(scale)
        return math.prod(_rise((2 * cut - np.abs(x)) / cut) for x in at)

    def shell(self, scale: int, at: list[np.ndarray]) -> np.ndarray:
        outer = 1.0 if scale == self.scales - 1 else self._low(scale, at) ** 2
        inner = 0.0 if scale == 0 else self._low(scale - 1, at) ** 2
        return np.sqrt(np.clip(outer - inner, 0, 1))

    def relative(self, freq: list[np.ndarray]) -> list[np.ndarray]:
        return [k / (n / 2) for k, n in zip(freq, self.dims)]

    def _across(self, at: list[np.ndarray], face: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether a place is before the face, its two coordinates there in wedges, 0 being the middle of the first)."""
        axis, sign = divmod(face, 2)
        ahead = at[axis] * (1 - 2 * sign)
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = [(at[k] / ahead + 1) * n / 2 - 0.5 for k in range(3) if k != axis]
        before = (ahead > 0) & (np.abs(u - (n - 1) / 2) < (n + 1) / 2) & (np.abs(v - (n - 1) / 2) < (n + 1) / 2)
        return before, np.where(before, u, 0), np.where(before, v, 0)

    def _norm(self, at: list[np.ndarray], n: int) -> np.ndarray:
        """Root of the sum of the squares of all wedges' bumps."""
        total = np.zeros(len(at[0]))
        for face in range(6):
            before, u, v = self._across(at, face, n)
            total += np.where(before, _covered(u, n) * _covered(v, n), 0)
        return np.sqrt(total)

    def windows(self, scale: int, freq: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(wedge, place, weight) of every window of the scale that isn't zero at a place."""
        at = self.relative(freq)
        shell = self.shell(scale, at)
        used = np.flatnonzero(shell)
        n = self.side(scale)
        if not n:
            return np.zeros(len(used), np.int64), used, shell[used]
        at = [x[used] for x in at]
        shell = shell[used] / self._norm(at, n)
        found = []
        for face in range(6):
            before, u, v = self._across(at, face, n)
            here = np.flatnonzero(before)
            u, v = u[here], v[here]
            for a in (0, 1):
                for b in (0, 1):
                    i, j = np.floor(u) + a, np.floor(v) + b
                    weight = _bump(u - i) * _bump(v - j) * shell[here]
                    ok = (i >= 0) & (i < n) & (j >= 0) & (j < n) & (weight > 0)
                    found.append(((face * n * n + i * n + j)[ok].astype(np.int64), used[here[ok]], weight[ok]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def weights(self, scale: int, wedge: int, freq: list[np.ndarray]) -> np.ndarray:
        """The wedge's window at each place."""
        at = self.relative(freq)
        shell, n = self.shell(scale, at), self.side(scale)
        if not n:
            return shell
        face, i, j = wedge // (n * n), wedge // n % n, wedge % n
        before, u, v = self._across(at, face, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(before & (shell > 0), shell * _bump(u - i) * _bump(v - j) / self._norm(at, n), 0)

    def box(self, scale: int, wedge: int) -> tuple[int, int, int]:
        return self._place(scale, wedge)[0]

    def _place(self, scale: int, wedge: int) -> tuple[tuple[int, int, int], int, int, int, list]:
        """(sizes, axis of the face, sign, first frequency along it, slope of the first frequency of the other axes)."""
        n = self.side(scale)
        if not n:
            reach = [math.ceil(2 * self._cut(0) * d / 2) - 1 for d in self.dims]
            return tuple(d if scale else min(d, 2 * r + 1) for d, r in zip(self.dims, reach)), -1, 1, 0, []
        face, i, j = wedge // (n * n), wedge // n % n, wedge % n
        axis, sign = face // 2, 1 - 2 * (face % 2)
        low, high = self._cut(scale - 1) / (1 + 1 / n), 2 * self._cut(scale)
        half = self.dims[axis] / 2
        first, last = math.floor(low * half) + 1, min(math.ceil(high * half) - 1, self.dims[axis] // 2)
        size = [0, 0, 0]
        size[axis] = max(1, last - first + 1)
        slopes = []
        for k, m in zip([k for k in range(3) if k != axis], (i, j)):
            size[k] = min(self.dims[k], math.floor(high * 2 / n * self.dims[k]) + 1)
            slopes.append((k, (2 * m + 1) / n - 1 - 2 / n))
        return tuple(size), axis, sign, first if sign > 0 else -last, slopes

    def unwrapped(self, scale: int, wedge: int, places: list[np.ndarray]) -> list[np.ndarray]:
        """The one frequency of the wedge that is wrapped onto each place of its box."""
        size, axis, sign, first, slopes = self._place(scale, wedge)
        if axis < 0:
            return [(p + n // 2) % n - n // 2 for p, n in zip(places, size)]
        freq: list = [None] * 3
        freq[axis] = first + (places[axis] - first) % size[axis]
        ahead = sign * freq[axis] / (self.dims[axis] / 2)
        for k, slope in slopes:
            n = self.dims[k]
            start = np.floor(ahead * slope * n / 2).astype(np.int64) + 1 if size[k] < n else -(n // 2)
            freq[k] = start + (places[k] - start) % size[k]
        return freq


def _bump(x: np.ndarray) -> np.ndarray:
    return _rise(1 - np.abs(x))


def _covered(u: np.ndarray, n: int) -> np.ndarray:
    """Sum of the squares of the bumps around 0 ... n - 1."""
    i = np.floor(u)
    return np.where((i >= 0) & (i < n), _bump(u - i) ** 2, 0) + np.where((i + 1 >= 0) & (i + 1 < n), _bump(u - i - 1) ** 2, 0)


@lru_cache(maxsize=16)
def volume_frame(dims: tuple[int, int, int], scales: int, coarse: int) -> Frame:
    return Frame(dims, scales, coarse)


def _width(size: tuple[int, int, int], tile: int) -> int:
    """Pencils of a tile of ``tile`` values."""
    return max(1, tile // size[0])


def _planes(size: tuple[int, int, int], tile: int) -> int:
    """Planes of a slab of about ``tile`` values."""
    return max(1, tile // (size[1] * size[2]))


def _complex(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.complex128)


def _pack(size: tuple[int, int, int], wedge: int, tile: int) -> int:
    """Wedges of small boxes go together: the number of the wedge's group, whose boxes hold about ``tile`` values."""
    return wedge // max(1, tile // math.prod(size))


def _of_each(table: pa.Table, by: str, *names: str) -> dict[int, list[list]]:
    """The columns ``names`` of a table as lists, by the value of ``by``."""
    out: dict[int, list[list]] = {}
    for k, *values in zip(*(table.column(c).to_pylist() for c in (by, *names))):
        for held, v in zip(out.setdefault(k, [[] for _ in names]), values):
            held.append(v)
    return out


def _pieces(size: tuple[int, int, int], width: int, tile: int, at: list[bytes], values: list[bytes]) -> np.ndarray:
    """The pencils of a tile (axis 1 x pencils) put together from values and their places in it."""
    pencils = min(width, size[1] * size[2] - tile * width)
    out = np.zeros(size[0] * pencils, dtype=complex)
    for a, v in zip(at, values):
        np.add.at(out, np.frombuffer(a, dtype=np.int64), _complex(v))
    return out.reshape(size[0], pencils)


def _table(kinds: dict, rows: list[tuple]) -> pa.Table:
    names = list(kinds)
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=names)


def _kinds(key: pa.DataType, *fields: str) -> dict:
    known = {"image_id": key, "at": pa.binary(), "values": pa.binary(), "re": pa.list_(pa.float64()), "im": pa.list_(pa.float64()), "pixels": pa.list_(pa.float64())}
    return {f: known.get(f, pa.int32()) for f in fields}


def _schema(key: str, *fields: str) -> str:
    known = {"image_id": key, "at": "binary", "values": "binary", "re": "array<double>", "im": "array<double>", "pixels": "array<double>"}
    return ", ".join(f"{f} {known.get(f, 'int')}" for f in fields)


def _key(df: DataFrame) -> tuple[str, pa.DataType]:
    return df.schema["image_id"].dataType.simpleString(), df.select("image_id").limit(0).toArrow().schema.field(0).type


def _first(table: pa.Table, *names: str) -> tuple:
    return tuple(table.column(n)[0].as_py() for n in names)


@lru_cache(maxsize=4)
def stacked_boxes(frame_of, dims: tuple[int, int, int], scales: int | None, coarse: int) -> list[tuple]:
    """Per scale and size of boxes: scale, number of its wedges, those of this size, the size, places in the frequencies of the volume, weights, places in the boxes; all begin with frequency 0."""
    frame = frame_of(dims, scales, coarse)
    freq = [x.ravel() for x in np.meshgrid(*[(np.arange(n) + n // 2) % n - n // 2 for n in dims], indexing="ij")]
    out = []
    for scale in range(frame.scales):
        wedge, at, weight = frame.windows(scale, freq)
        sizes: dict = {}
        for k in np.unique(wedge).tolist():
            sizes.setdefault(frame.box(scale, k), []).append(k)
        for size, wedges in sizes.items():
            nth = np.full(frame.n_wedges(scale), -1)
            nth[wedges] = np.arange(len(wedges))
            mine = np.flatnonzero(nth[wedge] >= 0)
            to = nth[wedge[mine]]
            for f, n in zip(freq, size):
                to = to * n + f[at[mine]] % n
            out.append((scale, frame.n_wedges(scale), np.array(wedges), size, at[mine], weight[mine], to))
    return out


def _dealt(df: DataFrame) -> DataFrame:
    """By volume. Volumes cost much more than their rows weigh, by which few tasks would be made."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism), "image_id")


def _transform_whole(slices: DataFrame, scales: int | None, coarse_wedges: int, frame_of) -> DataFrame:
    kind, arrow = _key(slices)

    def run(table: pa.Table) -> pa.Table:
        image, d, h, w = table.column("image_id")[0], *_first(table, "depth", "height", "width")
        volume = np.zeros((d, h, w))
        for z, pixels in zip(table.column("z").to_pylist(), table.column("pixels")):
            volume[z] = np.asarray(pixels.values, dtype=float).reshape(h, w)
        cube = np.fft.fftn(np.fft.ifftshift(volume)).ravel() / math.sqrt(volume.size)
        made = []
        for scale, n_wedges, wedges, size, at, weight, to in stacked_boxes(frame_of, (d, h, w), scales, coarse_wedges):
            boxes = np.zeros((len(wedges), *size), dtype=complex)
            boxes.ravel()[to] = cube[at] * weight
            flat = np.fft.fftshift(np.fft.ifftn(boxes, axes=(1, 2, 3)), axes=(1, 2, 3)).ravel() * math.sqrt(math.prod(size))
            rows = len(wedges) * size[0]
            ends = pa.array(np.arange(rows + 1, dtype=np.int32) * (size[1] * size[2]))
            ints = [np.full(rows, x, np.int32) for x in (d, h, w, scale)] + [np.repeat(wedges, size[0]).astype(np.int32)] + [np.full(rows, x, np.int32) for x in (n_wedges, *size)] + [np.tile(np.arange(size[0], dtype=np.int32), len(wedges))]
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x))) for x in (flat.real, flat.imag)]
            made.append(pa.table([pa.repeat(image, rows), *map(pa.array, ints), *lists], names=list(COEFFICIENTS)))
        return pa.concat_tables(made) if made else _table(_kinds(arrow, *COEFFICIENTS), [])

    return _dealt(slices).groupBy("image_id").applyInArrow(run, _schema(kind, *COEFFICIENTS))


def _reconstruct_whole(planes: DataFrame, scales: int | None, coarse_wedges: int, frame_of) -> DataFrame:
    kind, arrow = _key(planes)
    fields = ("image_id", "z", "height", "width", "pixels")

    def run(table: pa.Table) -> pa.Table:
        image, d, h, w = _first(table, "image_id", "depth", "height", "width")
        of_scale, of_wedge, k1 = (table.column(c).to_numpy() for c in ("scale", "wedge", "k1"))
        re, im = (table.column(c).combine_chunks() for c in ("re", "im"))
        values = re.flatten().to_numpy() + 1j * im.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(re.value_lengths().to_numpy())])[:-1]
        cube = np.zeros(d * h * w, dtype=complex)
        for scale, n_wedges, wedges, size, at, weight, to in stacked_boxes(frame_of, (d, h, w), scales, coarse_wedges):
            nth = np.full(n_wedges, -1)
            nth[wedges] = np.arange(len(wedges))
            rows = np.flatnonzero(of_scale == scale)
            rows = rows[nth[of_wedge[rows]] >= 0]
            boxes = np.zeros((len(wedges) * size[0], size[1] * size[2]), dtype=complex)
            boxes[nth[of_wedge[rows]] * size[0] + k1[rows]] = values[starts[rows][:, None] + np.arange(size[1] * size[2])]
            flat = np.fft.fftn(np.fft.ifftshift(boxes.reshape(-1, *size), axes=(1, 2, 3)), axes=(1, 2, 3)).ravel()[to] * (weight / math.sqrt(math.prod(size)))
            cube.real += np.bincount(at, flat.real, cube.size)
            cube.imag += np.bincount(at, flat.imag, cube.size)
        volume = np.fft.fftshift(np.fft.ifftn(cube.reshape(d, h, w))).real * math.sqrt(cube.size)
        return _table(_kinds(arrow, *fields), [(image, z, h, w, volume[z].ravel()) for z in range(d)])

    return _dealt(planes).groupBy("image_id").applyInArrow(run, _schema(kind, *fields))


COEFFICIENTS = ("image_id", "depth", "height", "width", "scale", "wedge", "n_wedges", "n1", "n2", "n3", "k1", "re", "im")


def transform_stacks(slices: DataFrame, scales: int = SCALES, coarse_wedges: int = COARSE_WEDGES, tile_values: int = TILE, frame_of=volume_frame) -> DataFrame:
    """``frame_of``: makes the windows from dims, scales and coarse wedges.

    Slices to coefficients: a row per plane k1 of each wedge's box (n1 x n2 x n3), with its values (re, im) by k2, k3; image_id, depth, height, width, scale, wedge, n_wedges."""
    kind, arrow = _key(slices)
    own = slices.where("pixels IS NOT NULL").select("image_id", F.col("z").cast("int").alias("z"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels")
    depth = own.groupBy("image_id").agg((F.max("z") + 1).alias("depth"))
    own = own.join(depth, "image_id").select("image_id", "depth", "height", "width", "z", "pixels")
    small = F.col("depth").cast("long") * F.col("height") * F.col("width") <= tile_values
    whole, own = _transform_whole(own.where(small), scales, coarse_wedges, frame_of), own.where(~small)
    fields = ("image_id", "depth", "height", "width", "tile", "z", "values")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, d, h, w, z = (batch.column(c)[k].as_py() for c in range(5))
                plane = np.asarray(batch.column(5)[k].values, dtype=float).reshape(h, w)
                flat = np.fft.fft2(np.fft.ifftshift(plane)).ravel() / math.sqrt(h * w)
                step = _width((d, h, w), tile_values)
                rows = [(image, d, h, w, t, z, flat[t * step : (t + 1) * step].tobytes()) for t in range(-(-h * w // step))]
                yield from _table(_kinds(arrow, *fields), rows).to_batches()

    tiles = own.mapInArrow(across, _schema(kind, *fields))
    sent = ("image_id", "depth", "height", "width", "scale", "pack", "tile", "wedge", "at", "values")

    def along(table: pa.Table) -> pa.Table:
        image, d, h, w, tile = _first(table, "image_id", "depth", "height", "width", "tile")
        frame = frame_of((d, h, w), scales, coarse_wedges)
        start = tile * _width((d, h, w), tile_values)
        pencils = min(_width((d, h, w), tile_values), h * w - start)
        block = np.zeros((d, pencils), dtype=complex)
        for z, values in zip(table.column("z").to_pylist(), table.column("values").to_pylist()):
            block[z] = _complex(values)
        block = np.fft.fft(np.fft.ifftshift(block, axes=0), axis=0).ravel() / math.sqrt(d)
        place = np.arange(start, start + pencils)
        centred = lambda x, n: (x + n // 2) % n - n // 2
        freq = [np.repeat(centred(np.arange(d), d), pencils), np.tile(centred(place // w, h), d), np.tile(centred(place % w, w), d)]
        rows = []
        for scale in range(frame.scales):
            wedge, at, weight = frame.windows(scale, freq)
            order = np.argsort(wedge, kind="stable")
            wedge, at, weight = wedge[order], at[order], weight[order]
            bounds = [0, *(np.flatnonzero(np.diff(wedge)) + 1).tolist(), len(wedge)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                own_wedge, mine = int(wedge[a]), at[a:b]
                size = frame.box(scale, own_wedge)
                wrapped = [f[mine] % n for f, n in zip(freq, size)]
                pencil, step = wrapped[1] * size[2] + wrapped[2], _width(size, tile_values)
                for t in np.unique(pencil // step).tolist():
                    inside = pencil // step == t
                    across = min(step, size[1] * size[2] - t * step)
                    spot = wrapped[0][inside] * across + pencil[inside] - t * step
                    rows.append((image, d, h, w, scale, _pack(size, own_wedge, tile_values), t, own_wedge, spot.astype(np.int64).tobytes(), (block[mine[inside]] * weight[a:b][inside]).tobytes()))
        return _table(_kinds(arrow, *sent), rows)

    wrapped = tiles.groupBy("image_id", "tile").applyInArrow(along, _schema(kind, *sent))
    slabs = ("image_id", "depth", "height", "width", "scale", "pack", "slab", "wedge", "tile", "values")

    def back(table: pa.Table) -> pa.Table:
        image, d, h, w, scale, pack, tile = _first(table, *sent[:7])
        rows = []
        for wedge, (at, values) in _of_each(table, "wedge", "at", "values").items():
            size = frame_of((d, h, w), scales, coarse_wedges).box(scale, wedge)
            block = np.fft.ifft(_pieces(size, _width(size, tile_values), tile, at, values), axis=0) * math.sqrt(size[0])
            planes = _planes(size, tile_values)
            rows += [(image, d, h, w, scale, pack, s, wedge, tile, block[s * planes : (s + 1) * planes].tobytes()) for s in range(-(-size[0] // planes))]
        return _table(_kinds(arrow, *slabs), rows)

    returned = wrapped.groupBy("image_id", "scale", "pack", "tile").applyInArrow(back, _schema(kind, *slabs))

    def finish(table: pa.Table) -> pa.Table:
        image, d, h, w, scale, slab = _first(table, *slabs[:5], "slab")
        frame = frame_of((d, h, w), scales, coarse_wedges)
        n_wedges, rows = frame.n_wedges(scale), []
        for wedge, (tiles, values) in _of_each(table, "wedge", "tile", "values").items():
            size = frame.box(scale, wedge)
            first, step = slab * _planes(size, tile_values), _width(size, tile_values)
            n = min(_planes(size, tile_values), size[0] - first)
            flat = np.zeros((n, size[1] * size[2]), dtype=complex)
            for tile, part in zip(tiles, map(_complex, values)):
                flat[:, tile * step : tile * step + len(part) // n] = part.reshape(n, -1)
            made = np.fft.fftshift(np.fft.ifft2(flat.reshape(n, *size[1:])), axes=(1, 2)).reshape(n, -1) * math.sqrt(size[1] * size[2])
            rows += [(image, d, h, w, scale, wedge, n_wedges, *size, (first + k + size[0] // 2) % size[0], made[k].real, made[k].imag) for k in range(n)]
        return _table(_kinds(arrow, *COEFFICIENTS), rows)

    return whole.unionByName(returned.groupBy("image_id", "scale", "pack", "slab").applyInArrow(finish, _schema(kind, *COEFFICIENTS)))


def coefficient_rows(planes: DataFrame, scale: int | None = None) -> DataFrame:
    """transform_stacks() to a row per coefficient: image_id, scale, wedge, k1, k2, k3, re, im, value (magnitude); of one scale if it is given."""
    chosen = planes if scale is None else planes.where(F.col("scale") == scale)
    each = chosen.select("image_id", "scale", "wedge", "k1", "n3", F.posexplode(F.arrays_zip("re", "im")).alias("k", "c"))
    k = F.col("k")
    return each.select("image_id", "scale", "wedge", "k1", F.floor(k / F.col("n3")).cast("int").alias("k2"), (k % F.col("n3")).alias("k3"), "c.re", "c.im", F.hypot("c.re", "c.im").alias("value"))


def reconstruct_stacks(planes: DataFrame, scales: int = SCALES, coarse_wedges: int = COARSE_WEDGES, tile_values: int = TILE, frame_of=volume_frame) -> DataFrame:
    """transform_stacks(), or what was kept of it, to slices (image_id, z, height, width, pixels): the adjoint, which is the inverse. Planes that are left out count as zero."""
    kind, arrow = _key(planes)
    small = F.col("depth").cast("long") * F.col("height") * F.col("width") <= tile_values
    planes = planes.select("image_id", "depth", "height", "width", "scale", "wedge", "k1", "re", "im")
    whole, planes = _reconstruct_whole(planes.where(small), scales, coarse_wedges, frame_of), planes.where(~small)
    fields = ("image_id", "depth", "height", "width", "scale", "pack", "tile", "wedge", "k1", "values")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, d, h, w, scale, wedge, k1 = (batch.column(c)[k].as_py() for c in range(7))
                size = frame_of((d, h, w), scales, coarse_wedges).box(scale, wedge)
                plane = (np.asarray(batch.column(7)[k].values) + 1j * np.asarray(batch.column(8)[k].values)).reshape(size[1:])
                flat = np.fft.fft2(np.fft.ifftshift(plane)).ravel() / math.sqrt(size[1] * size[2])
                step, at = _width(size, tile_values), (k1 - size[0] // 2) % size[0]
                pack = _pack(size, wedge, tile_values)
                rows = [(image, d, h, w, scale, pack, t, wedge, at, flat[t * step : (t + 1) * step].tobytes()) for t in range(-(-len(flat) // step))]
                yield from _table(_kinds(arrow, *fields), rows).to_batches()

    tiles = planes.mapInArrow(across, _schema(kind, *fields))
    sent = ("image_id", "depth", "height", "width", "tile", "at", "values")

    def along(table: pa.Table) -> pa.Table:
        image, d, h, w, scale, tile = _first(table, *fields[:5], "tile")
        frame, rows = frame_of((d, h, w), scales, coarse_wedges), []
        for wedge, (planes, values) in _of_each(table, "wedge", "k1", "values").items():
            size = frame.box(scale, wedge)
            start = tile * _width(size, tile_values)
            pencils = min(_width(size, tile_values), size[1] * size[2] - start)
            block = np.zeros((size[0], pencils), dtype=complex)
            for k, part in zip(planes, map(_complex, values)):
                block[k] = part
            block = np.fft.fft(block, axis=0).ravel() / math.sqrt(size[0])
            pencil = np.arange(start, start + pencils)
            places = [np.repeat(np.arange(size[0]), pencils), np.tile(pencil // size[2], size[0]), np.tile(pencil % size[2], size[0])]
            freq = frame.unwrapped(scale, wedge, places)
            weight = frame.weights(scale, wedge, freq)
            used = np.flatnonzero(weight)
            spot = [f[used] % n for f, n in zip(freq, (d, h, w))]
            kept, step = block[used] * weight[used], _width((d, h, w), tile_values)
            flat = spot[1] * w + spot[2]
            for t in np.unique(flat // step).tolist():
                inside = flat // step == t
                across = min(step, h * w - t * step)
                rows.append((image, d, h, w, t, (spot[0][inside] * across + flat[inside] - t * step).astype(np.int64).tobytes(), kept[inside].tobytes()))
        return _table(_kinds(arrow, *sent), rows)

    unwrapped = tiles.groupBy("image_id", "scale", "pack", "tile").applyInArrow(along, _schema(kind, *sent))
    cut = ("image_id", "depth", "height", "width", "tile", "z", "values")

    def back(table: pa.Table) -> pa.Table:
        image, d, h, w, tile = _first(table, *sent[:5])
        block = _pieces((d, h, w), _width((d, h, w), tile_values), tile, table.column("at").to_pylist(), table.column("values").to_pylist())
        block = np.fft.fftshift(np.fft.ifft(block, axis=0), axes=0) * math.sqrt(d)
        return _table(_kinds(arrow, *cut), [(image, d, h, w, tile, z, block[z].tobytes()) for z in range(d)])

    returned = unwrapped.groupBy("image_id", "tile").applyInArrow(back, _schema(kind, *cut))
    slices = ("image_id", "z", "height", "width", "pixels")

    def finish(table: pa.Table) -> pa.Table:
        image, d, h, w, z = _first(table, "image_id", "depth", "height", "width", "z")
        flat = np.zeros(h * w, dtype=complex)
        for tile, values in zip(table.column("tile").to_pylist(), table.column("values").to_pylist()):
            part = _complex(values)
            flat[tile * _width((d, h, w), tile_values) : tile * _width((d, h, w), tile_values) + len(part)] = part
        plane = np.fft.fftshift(np.fft.ifft2(flat.reshape(h, w))) * math.sqrt(h * w)
        return _table(_kinds(arrow, *slices), [(image, z, h, w, plane.real.ravel())])

    return whole.unionByName(returned.groupBy("image_id", "z").applyInArrow(finish, _schema(kind, *slices)))


def image_rows(bands: DataFrame) -> DataFrame:
    """Bands of images (image_id, first_row, height and width of the image, pixels row by row) to slices of one pixel row: images as volumes of dims (height, 1, width)."""
    width = F.col("width").cast("int")
    rows = (F.size("pixels") / width).cast("int")
    each = bands.where("pixels IS NOT NULL AND size(pixels) > 0").select("image_id", "first_row", "width", "pixels", F.explode(F.sequence(F.lit(0), rows - 1)).alias("k"))
    return each.select("image_id", (F.col("first_row") + F.col("k")).cast("int").alias("z"), F.lit(1).alias("height"), "width", F.slice("pixels", F.col("k") * width + 1, width).alias("pixels"))


def transform_bands(bands: DataFrame, scales: int | None = None, coarse_wedges: int = 16, tile_values: int = TILE) -> DataFrame:
    """The transform of ``curvelet`` for images of any size, given as bands: planes as transform_stacks() has them, with n2 = 1. Pixel rows that are missing count as zero, up to the last one there is."""
    return transform_stacks(image_rows(bands), scales, coarse_wedges, tile_values, plane_frame)


def band_coefficients(planes: DataFrame, scale_from_finest: int = 1) -> DataFrame:
    """transform_bands() to the rows of ``curvelet.transform_images``, of one scale (1: the second finest)."""
    finest = planes.groupBy("image_id").agg(F.max("scale").alias("finest"))
    own = planes.join(finest, "image_id").where(F.col("scale") == F.col("finest") - scale_from_finest)
    each = own.select("image_id", "scale", "wedge", "n_wedges", "k1", F.col("n1").alias("nx"), F.col("n3").alias("ny"), F.posexplode(F.arrays_zip("re", "im")).alias("k2", "c"))
    return each.select(
        "image_id", "scale", "wedge", "n_wedges", "k1", "k2", "nx", "ny", (1 / F.col("nx")).alias("sx"), (1 / F.col("ny")).alias("sy"), "c.re", "c.im", F.hypot("c.re", "c.im").alias("value")
    )


def reconstruct_bands(planes: DataFrame, scales: int | None = None, coarse_wedges: int = 16, tile_values: int = TILE) -> DataFrame:
    """transform_bands(), or what was kept of it, to bands of one pixel row: image_id, first_row, width, pixels."""
    rows = reconstruct_stacks(planes, scales, coarse_wedges, tile_values, plane_frame)
    return rows.select("image_id", F.col("z").alias("first_row"), "width", "pixels")
