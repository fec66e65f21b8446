"""Readers: images, coordinates, masks and fiber segments from files, as DataFrames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fibrespark.functions.angles import luminance


def _pnm(data: bytes) -> list[np.ndarray]:
    """Binary PGM (P5) or PPM (P6)."""
    at, fields = 2, []
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    planes = 3 if data[:2] == b"P6" else 1
    a = np.frombuffer(data, dtype=">u2" if most > 255 else "u1", count=width * height * planes, offset=at + 1)
    return [a.reshape(height, width, planes)]


def _packbits(data: bytes) -> bytes:
    """Runs of Macintosh PackBits: a count below 128 copies one byte more than it says, above 128 it repeats the next byte."""
    out, at = bytearray(), 0
    while at < len(data):
        count = data[at]
        if count < 128:
            out += data[at + 1 : at + 2 + count]
            at += 2 + count
        elif count > 128:
            out += data[at + 1 : at + 2] * (257 - count)
            at += 2
        else:
            at += 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, highest bit first, 256 to begin anew and 257 to end; widths grow one code early."""
    out, table, last = bytearray(), [], None
    held, bits, width = 0, 0, 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], None, 9
            continue
        if code < len(table):
            text = table[code]
        elif last is not None and code == len(table):
            text = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        out += text
        if last is not None:
            table.append(last + text[:1])
        last = text
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


#: Ways in which a TIFF's strips and tiles are packed, by their number.
UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def _tiff(data: bytes) -> list[np.ndarray]:
    """Pages of a TIFF in strips or tiles, plain or packed (LZW, deflate, PackBits), with or without differences along rows: 8, 16 or 32 bits, integers or floats, one or more samples a pixel."""
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(order + "I", data[4:8])
    sizes = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
    pages = []
    while at:
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        tags: dict[int, list[int]] = {}
        for k in range(n):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            if kind not in sizes:
                continue
            code, width = sizes[kind]
            raw = entry[8 : 8 + width * count] if width * count <= 4 else data[(o := struct.unpack(order + "I", entry[8:])[0]) : o + width * count]
            tags[tag] = list(struct.unpack(f"{order}{count}{code}", raw))
        unpack = UNPACK.get(tags.get(259, [1])[0])
        if unpack is None:
            raise ValueError(f"TIFF with compression {tags[259][0]} isn't read")
        if tags.get(284, [1])[0] != 1:
            raise ValueError("only TIFF with interleaved samples is read")
        width, height = tags[256][0], tags[257][0]
        bits, samples, form = tags.get(258, [1])[0], tags.get(277, [1])[0], tags.get(339, [1])[0]
        kind = np.dtype({1: "u", 2: "i", 3: "f"}[form] + str(bits // 8)).newbyteorder(order)
        tiled = 324 in tags
        wide, high = (tags[322][0], tags[323][0]) if tiled else (width, min(height, tags.get(278, [height])[0]))
        across = -(-width // wide)
        a = np.zeros((height, width, samples))
        for k, (o, c) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279])):
            top, left = k // across * high, k % across * wide
            rows = high if tiled else min(high, height - top)
            part = np.frombuffer(unpack(data[o : o + c]), dtype=kind, count=rows * wide * samples).reshape(rows, wide, samples)
            if tags.get(317, [1])[0] == 2:
                part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
            elif tags.get(317, [1])[0] != 1:
                raise ValueError("TIFF with a predictor of floats isn't read")
            a[top : top + rows, left : left + wide] = part[: height - top, : width - left]
        pages.append(255 - a if tags.get(262, [1])[0] == 0 and bits == 8 else a)
        (at,) = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
    return pages


def _unfiltered(raw: bytes, rows: int, size: int, pixel: int) -> np.ndarray:
    """PNG's rows of ``size`` bytes, each after the number of its filter, to plain bytes; ``pixel``: bytes of a pixel."""
    out = np.zeros((rows + 1, size + pixel), dtype=np.uint8)  # a row of zeros above, a pixel of zeros before
    for r in range(rows):
        kind, line = raw[r * (size + 1)], np.frombuffer(raw, np.uint8, size, r * (size + 1) + 1)
        up, own = out[r], out[r + 1]
        if kind == 0:
            own[pixel:] = line
        elif kind == 1:
            whole = np.zeros(-(-size // pixel) * pixel, np.uint8)
            whole[:size] = line
            own[pixel:] = np.cumsum(whole.reshape(-1, pixel), axis=0, dtype=np.uint8).ravel()[:size]
        elif kind == 2:
            own[pixel:] = line + up[pixel:]
        elif kind in (3, 4):
            left, above = own.tolist(), up.tolist()
            for k, x in enumerate(line.tolist(), pixel):
                a, b, c = left[k - pixel], above[k], above[k - pixel]
                if kind == 3:
                    guess = (a + b) // 2
                else:  # whichever of left, above and corner is nearest to a + b - c, in that order
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                left[k] = x + guess & 255
            own[:] = left
        else:
            raise ValueError("broken PNG data")
    return out[1:, pixel:]


def _png(data: bytes) -> list[np.ndarray]:
    """PNG without interlacing: grey, colour or palette, 1 to 16 bits a sample."""
    at, body, palette = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if interlaced:
        raise ValueError("interlaced PNG isn't read")
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = _unfiltered(zlib.decompress(body), height, -(-width * samples * bits // 8), max(1, samples * bits // 8))
    if bits == 16:
        a = np.ascontiguousarray(lines).view(">u2")
    elif bits == 8:
        a = lines
    else:  # packed, highest bits first
        ones = np.unpackbits(lines, axis=1)[:, : width * samples * bits].reshape(height, -1, bits)
        a = ones @ (1 << np.arange(bits - 1, -1, -1))
        a = a if colour == 3 else a * (255 // ((1 << bits) - 1))
    a = a.reshape(height, width, samples)
    return [(palette[a[..., 0]] if colour == 3 else a).astype(float)]


def decode_image(data: bytes) -> list[np.ndarray]:
    """Pages of an image file as height x width x samples."""
    if data[:2] in (b"P5", b"P6"):
        return _pnm(data)
    if data[:4] in (b"II*\x00", b"MM\x00*"):
        return _tiff(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    raise ValueError("neither PGM, PPM, PNG nor TIFF")


IMAGES = "image_id string, slice int, height int, width int, pixels array<double>, error string, path string"


def decode_images(files: DataFrame, pages: str = "first") -> DataFrame:
    """Files (path, content) to grey images, a row per page (``pages`` first or all). A file that can't be read gives a row with its error and no pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    read = decode_image(bytes(content))
                    rows = []
                    for k, a in enumerate(read if pages == "all" else read[:1]):
                        grey = luminance(a[..., 0], a[..., 1], a[..., 2]) if a.shape[2] >= 3 else a[..., 0]
                        rows.append((name, k + 1, a.shape[0], a.shape[1], grey.astype(float).ravel(), None, path))
                except (ValueError, KeyError, struct.error, IndexError, UnboundLocalError, zlib.error) as e:
                    rows = [(name, 1, None, None, None, str(e), path)]
                out = pd.DataFrame(rows, columns=["image_id", "slice", "height", "width", "pixels", "error", "path"])
                yield out.astype({"height": "Int32", "width": "Int32"})

    return files.select("path", "content").mapInPandas(run, IMAGES)


def read_images(spark: SparkSession, path: str, glob: str = "*.tif", pages: str = "first") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return decode_images(files, pages)


def read_stack(spark: SparkSession, path: str, glob: str = "*.tif", limit: int | None = None) -> DataFrame:
    """Images of folders as stacks, a folder a stack: adds stack, the folder, and z, the place by file name (from 0); the first ``limit`` if one is given. Images are told apart by their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    order = Window.partitionBy("stack").orderBy("path")
    numbered = files.select("path", folder.alias("stack")).withColumn("z", (F.row_number().over(order) - 1).cast("long"))
    if limit is not None:
        numbered = numbered.where(F.col("z") < limit)
    return decode_images(files.join(numbered.select("path"), "path", "left_semi")).join(numbered, "path")


def pixels_of(images: DataFrame) -> DataFrame:
    """(image_id, row, col, value) of every pixel."""
    at = images.select("image_id", "width", F.posexplode("pixels").alias("k", "value"))
    return at.select("image_id", F.floor(F.col("k") / F.col("width")).cast("int").alias("row"), (F.col("k") % F.col("width")).cast("int").alias("col"), "value")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, line): lines in their order within each file. Files are read whole: outlines are small, and there may be many."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    return files.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("seq", "line"))


def _stem(path: str) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (y, x) files: name, seq, row, col. Lines with fewer than two fields or without numbers are left out."""
    parts = F.split("line", "\t")
    rows = _numbered_lines(spark, path).select(_stem("path").alias("name"), "seq", parts.alias("p"))
    number = lambda k: F.expr(f"try_cast(trim(get(p, {k})) AS double)")
    return rows.select("name", "seq", number(0).alias("row"), number(1).alias("col")).where("row IS NOT NULL AND col IS NOT NULL")


def read_boundaries(spark: SparkSession, path: str, origin: int = 0) -> DataFrame:
    """Headerless row,col CSV files, one outline a file: name, seq, row, col, less ``origin`` (1 for coordinates that count from 1)."""
    rows = _numbered_lines(spark, path).select(_stem("path").alias("name"), "seq", F.split("line", ",").alias("p"))
    number = lambda k: F.expr(f"try_cast(trim(get(p, {k})) AS double)") - origin
    return rows.select("name", "seq", number(0).alias("row"), number(1).alias("col")).where("row IS NOT NULL AND col IS NOT NULL")


def read_mask(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Dense CSV masks, a file an image: image_id, row, col, value."""
    lines = _numbered_lines(spark, path).where("trim(line) <> ''")
    cells = lines.select(_stem("path").alias("image_id"), F.col("seq").alias("row"), F.posexplode(F.split("line", sep)).alias("col", "v"))
    return cells.select("image_id", "row", "col", F.expr("try_cast(trim(v) AS double)").alias("value")).where("value IS NOT NULL")


def centers_from_text(rows: DataFrame, center: str = "center") -> DataFrame:
    """Centres written as "[row col]": adds center_row and center_col."""
    number = lambda k: F.expr(f"try_cast(regexp_extract({center}, '(-?[0-9.]+)[^0-9.-]+(-?[0-9.]+)', {k}) AS double)")
    return rows.withColumns({"center_row": number(1), "center_col": number(2)})


def normalized_fibers(fibers: DataFrame) -> DataFrame:
    """Fibers with center_row and center_col, whichever dialect (center_1, center_2 or center_0, center_1) they came in; NaN becomes null."""
    names = set(fibers.columns)
    if not {"center_row", "center_col"} <= names:
        pair = ("center_1", "center_2") if "center_2" in names else ("center_0", "center_1")
        fibers = fibers.withColumnsRenamed({pair[0]: "center_row", pair[1]: "center_col"})
    doubles = [c for c in ("center_row", "center_col", "angle", "weight") if c in fibers.columns]
    return fibers.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in doubles})


def fibers_of_segments(segments: DataFrame) -> DataFrame:
    """Traced fibers (image_id, fiber_id, seg, row, col, width) to one row per fiber: centre, angle between its ends, lengths, curvature (end-to-end by total) and mean width."""
    path = segments.groupBy("image_id", "fiber_id").agg(F.array_sort(F.collect_list(F.struct("seg", "row", "col"))).alias("p"), F.avg("width").alias("width"))
    ends = path.withColumns({"a": F.get("p", 0), "b": F.element_at("p", -1), "m": F.get("p", F.floor(F.size("p") / 2).cast("int"))})
    length = F.aggregate(F.transform("p", lambda x, k: F.when(k > 0, F.sqrt(F.pow(x["row"] - F.get("p", k - 1)["row"], 2) + F.pow(x["col"] - F.get("p", k - 1)["col"], 2))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    straight = F.sqrt(F.pow(F.col("a.row") - F.col("b.row"), 2) + F.pow(F.col("a.col") - F.col("b.col"), 2))
    angle = F.pmod(F.degrees(F.atan2(F.col("a.row") - F.col("b.row"), F.col("b.col") - F.col("a.col"))), F.lit(180.0))
    out = ends.select("image_id", "fiber_id", F.col("m.row").alias("center_row"), F.col("m.col").alias("center_col"), angle.alias("angle"), length.alias("total_length"), straight.alias("end_to_end_length"), "width")
    return out.withColumn("curvature", F.col("end_to_end_length") / F.when(F.col("total_length") > 0, F.col("total_length")))
