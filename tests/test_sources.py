import struct

import numpy as np
import pytest

from fibrespark.operators import curvelet
from fibrespark.plans import queries
from fibrespark.plans.pipeline import AnalysisParameters
from fibrespark.sources import derived, readers
from fibrespark.streaming.images import analyze_stream, running_histogram, watch_images


def tiff(pages):
    """Uncompressed little-endian TIFF of 8-bit grey pages."""
    out = bytearray(b"II*\x00\x00\x00\x00\x00")
    link = 4
    for a in pages:
        at = len(out)
        out += a.astype(np.uint8).tobytes()
        struct.pack_into("<I", out, link, len(out))
        tags = [(256, 3, 1, a.shape[1]), (257, 3, 1, a.shape[0]), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, at), (277, 3, 1, 1), (279, 4, 1, a.size)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\x00\x00\x00\x00"
    return bytes(out)


def test_images(spark, tmp_path):
    a = np.arange(48).reshape(6, 8)
    (tmp_path / "one.tif").write_bytes(tiff([a, a + 1]))
    (tmp_path / "two.tif").write_bytes(b"broken")
    (tmp_path / "grey.pgm").write_bytes(b"P5\n# made\n8 6\n255\n" + a.astype(np.uint8).tobytes())
    (tmp_path / "rgb.ppm").write_bytes(b"P6 1 1 255 " + bytes([100, 50, 200]))
    got = {(r.image_id, r.slice): r for r in readers.read_images(spark, str(tmp_path), "*.tif", "all").collect()}
    assert np.array_equal(np.reshape(got["one", 1].pixels, (6, 8)), a) and got["one", 2].pixels[0] == 1
    assert got["two", 1].pixels is None and got["two", 1].error
    assert readers.read_images(spark, str(tmp_path), "*.tif").where("error IS NULL").count() == 1
    assert readers.read_images(spark, str(tmp_path), "*.pgm").first().pixels[9] == 9
    assert readers.read_images(spark, str(tmp_path), "*.ppm").first().pixels[0] == pytest.approx(0.299 * 100 + 0.587 * 50 + 0.114 * 200)
    pixels = readers.pixels_of(readers.read_images(spark, str(tmp_path), "*.pgm"))
    assert pixels.where("row = 1 AND col = 2").first().value == 10
    stack = readers.read_stack(spark, str(tmp_path), "*.pgm").collect()
    assert [(r.image_id, r.z) for r in stack] == [("grey", 0)]


def test_coordinates_and_masks(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("Y    X\n1\t2\n3\t4.5\nbad\n")
    assert [(r.seq, r.row, r.col) for r in readers.read_coordinates(spark, str(tmp_path / "c.tsv")).orderBy("seq").collect()] == [(1, 1.0, 2.0), (2, 3.0, 4.5)]
    (tmp_path / "b.csv").write_text("10,20\n11,20\n")
    assert [(r.name, r.row, r.col) for r in readers.read_boundaries(spark, str(tmp_path / "b.csv"), 1).orderBy("seq").collect()] == [("b", 9.0, 19.0), ("b", 10.0, 19.0)]
    (tmp_path / "m.csv").write_text("0,255\n1,0\n")
    assert readers.read_mask(spark, str(tmp_path / "m.csv")).where("value > 0").count() == 2
    text = spark.createDataFrame([("[12   7]", 5.0)], "center string, angle double")
    assert [(r.center_row, r.center_col) for r in readers.centers_from_text(text).collect()] == [(12.0, 7.0)]


def test_dialects_and_segments(spark):
    old = spark.createDataFrame([(1.0, 2.0, float("nan"))], "center_1 double, center_2 double, weight double")
    r = readers.normalized_fibers(old).first()
    assert (r.center_row, r.center_col, r.weight) == (1.0, 2.0, None)
    seg = spark.createDataFrame([(0, 1, k, 10.0, float(k), 2.0) for k in range(5)], "image_id long, fiber_id long, seg long, row double, col double, width double")
    f = readers.fibers_of_segments(seg).first()
    assert (f.angle, f.total_length, f.end_to_end_length, f.curvature, f.width) == (0.0, 4.0, 4.0, 1.0, 2.0)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    y, x = np.mgrid[:64, :64]
    (tmp_path / "in" / "a.tif").write_bytes(tiff([200 * np.exp(-(((x - 32) / 1.5) ** 2))]))
    q = analyze_stream(watch_images(spark, str(tmp_path / "in")), AnalysisParameters(64, 64), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    rows = spark.createDataFrame([(0, 12.0), (0, 13.0), (1, 99.0)], "image_id long, angle double")
    rows.write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "f"))
    q = running_histogram(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.image_id, r.bin): r["count"] for r in spark.sql("SELECT * FROM counts").collect()} == {(0, 2): 2, (1, 19): 1}


def test_pictures_are_whole_images(spark, tmp_path):
    rows = [(k, 1000.0 + 37.13 * k) for k in range(1, 60)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    want = np.zeros((512, 512))
    for f in derived.fibers(spark, str(tmp_path)).collect():
        for t in range(-3, 4):
            r, c = f.center_row - t * np.sin(np.radians(f.angle)), f.center_col + t * np.cos(np.radians(f.angle))
            r, c = int(np.floor(r + 0.5)), int(np.floor(c + 0.5))
            if 0 <= r < 512 and 0 <= c < 512:
                want[r, c] += 1
    [p] = derived.pictures(spark, str(tmp_path)).collect()
    assert (p.image_id, p.height, p.width) == (0, 512, 512) and (np.array(p.pixels).reshape(512, 512) == want).all()
    level = curvelet.forward(want)[-2]
    got = {r.wedge: r for r in queries.curvelet_coefficients(spark, str(tmp_path)).collect()}
    assert len(got) == len(level) == 64
    for k, c in enumerate(level):
        assert got[k].n == c.size and got[k].energy == pytest.approx((np.abs(c) ** 2).sum(), abs=1e-5)
