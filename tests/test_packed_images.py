"""Packed TIFF and PNG files, written here in plain ways, against the pixels that went in."""

import struct
import zlib

import numpy as np
import pytest

from fibrespark.sources import readers


def lzw(data):
    """Packs bytes as TIFF's LZW does."""
    codes, out, bits, held = {}, bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    put(256, 9)
    codes, text = {bytes([k]): k for k in range(256)}, b""
    n = 258
    width = lambda: min(12, max(9, (n + 1).bit_length()))
    for k in range(len(data)):
        longer = text + data[k : k + 1]
        if longer in codes:
            text = longer
            continue
        put(codes[text], max(9, n.bit_length()))
        codes[longer] = n
        n += 1
        if n == 4094:
            put(codes[data[k : k + 1]], 12)
            put(256, 12)
            codes, n, text = {bytes([j]): j for j in range(256)}, 258, b""
            continue
        text = data[k : k + 1]
    if text:
        put(codes[text], max(9, n.bit_length()))
        n += 1
    put(257, max(9, n.bit_length()))
    put(0, 7)
    return bytes(out)


def packbits(data):
    out = bytearray()
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return bytes(out)


def tiff(a, compression, tile=None, rows=None, predictor=1, order="<"):
    height, width, samples = a.shape
    kind = a.dtype.newbyteorder(order)
    pack = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}[compression]
    if tile:
        full = np.zeros((-(-height // tile[0]) * tile[0], -(-width // tile[1]) * tile[1], samples), a.dtype)
        full[:height, :width] = a
        parts = [full[r : r + tile[0], c : c + tile[1]] for r in range(0, height, tile[0]) for c in range(0, width, tile[1])]
    else:
        parts = [a[r : r + rows] for r in range(0, height, rows)]
    if predictor == 2:
        parts = [np.diff(p, axis=1, prepend=np.zeros_like(p[:, :1])) for p in parts]
    packed = [pack(np.ascontiguousarray(p).astype(kind).tobytes()) for p in parts]
    out, offsets = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0" * 4), []
    for p in packed:
        offsets.append(len(out))
        out += p
    lists = len(out)
    out += struct.pack(f"{order}{2 * len(parts)}I", *offsets, *map(len, packed))
    n = len(parts)
    at = lambda k, values: values[0] if n == 1 else lists + 4 * n * k
    where = [(324, 4, n, at(0, offsets)), (325, 4, n, at(1, [len(p) for p in packed]))] if tile else [(273, 4, n, at(0, offsets)), (279, 4, n, at(1, [len(p) for p in packed]))]
    tags = [(256, 4, 1, width), (257, 4, 1, height), (259, 4, 1, compression), (262, 4, 1, 1), (277, 4, 1, samples), (258, 4, 1, 8 * a.dtype.itemsize), (317, 4, 1, predictor), *where]
    tags += [(322, 4, 1, tile[1]), (323, 4, 1, tile[0])] if tile else [(278, 4, 1, rows)]
    struct.pack_into(order + "I", out, 4, len(out))
    out += struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHII", *t) for t in sorted(tags)) + b"\0\0\0\0"
    return bytes(out)


def picture(kind=np.uint8, samples=1, height=37, width=53):
    rng = np.random.default_rng(samples)
    a = np.add.outer(np.arange(height), np.arange(width) // 3)[..., None] * np.arange(1, samples + 1) + rng.integers(0, 4, (height, width, samples))
    a[5:20, 10:40] = 7
    return a.astype(kind)


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("shape", [{"tile": (16, 32)}, {"rows": 10}, {"rows": 37}])
@pytest.mark.parametrize("predictor", [1, 2])
def test_packed_tiffs_equal_plain_ones(compression, shape, predictor):
    for a, order in ((picture(), "<"), (picture(np.uint16, 3), ">"), (picture(np.int32), "<"), (np.zeros((37, 53, 1), np.uint8), "<")):
        (got,) = readers.decode_image(tiff(a, compression, predictor=predictor, order=order, **shape))
        assert np.array_equal(got, a.astype(float))


def test_long_lzw_data_begins_anew():
    rng = np.random.default_rng(0)
    for data in (rng.integers(0, 256, 60_000).astype(np.uint8).tobytes(), b"abab" * 30_000, b"x", b""):
        assert readers._lzw(lzw(data)) == data


def png(a, colour, bits=8, kinds=(0, 1, 2, 3, 4), palette=None):
    """Each row by the next of the filters."""
    height = a.shape[0]
    lines = a.reshape(height, -1)
    if bits == 16:
        lines = lines.astype(">u2").view(np.uint8)
    elif bits < 8:
        ones = (lines[..., None] >> np.arange(bits - 1, -1, -1) & 1).reshape(height, -1).astype(np.uint8)
        lines = np.packbits(ones, axis=1)
    pixel = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * bits // 8)
    raw, up = b"", [0] * lines.shape[1]
    for r, line in enumerate(lines.astype(int).tolist()):
        kind, own = kinds[r % len(kinds)], []
        for k, x in enumerate(line):
            left, above, corner = line[k - pixel] if k >= pixel else 0, up[k], up[k - pixel] if k >= pixel else 0
            near = {abs(left + above - corner - y): y for y in (corner, above, left)}  # the last written wins a tie
            own.append(x - (0, left, above, (left + above) // 2, near[min(near)])[kind] & 255)
        raw, up = raw + bytes([kind, *own]), line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    packed = zlib.compress(raw)
    head = struct.pack(">IIBBBBB", a.shape[1], height, bits, colour, 0, 0, 0)
    extra = chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", packed[:50]) + chunk(b"IDAT", packed[50:]) + chunk(b"IEND", b"")


def test_pngs():
    for colour, samples in ((0, 1), (2, 3), (4, 2), (6, 4)):
        a = picture(np.uint8, samples)
        assert np.array_equal(readers.decode_image(png(a, colour))[0], a)
        wide = picture(np.uint16, samples) * 37
        assert np.array_equal(readers.decode_image(png(wide, colour, 16))[0], wide)
    for bits in (1, 2, 4):
        a = picture() % (1 << bits)
        assert np.array_equal(readers.decode_image(png(a, 0, bits))[0], a * (255 // ((1 << bits) - 1)))
    palette = np.random.default_rng(0).integers(0, 256, (16, 3))
    a = picture() % 16
    assert np.array_equal(readers.decode_image(png(a, 3, 4, palette=palette))[0], palette[a[..., 0]])


def test_files_of_several_folders(spark, tmp_path):
    a = picture()
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        for name in ("b", "a"):
            (tmp_path / folder / f"{name}.png").write_bytes(png(a + (name == "b"), 0))
    (tmp_path / "one" / "c.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    stack = readers.read_stack(spark, str(tmp_path / "*"), "*.png").collect()
    assert sorted((r.stack.rsplit("/", 1)[1], r.z, r.image_id, r.error is None) for r in stack) == [("one", 0, "a", True), ("one", 1, "b", True), ("one", 2, "c", False), ("two", 0, "a", True), ("two", 1, "b", True)]
    assert {r.pixels[0] - a[0, 0, 0] for r in stack if r.pixels and r.image_id == "b"} == {1}
    assert readers.read_stack(spark, str(tmp_path / "*"), "*.png", 1).count() == 2
