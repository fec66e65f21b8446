import numpy as np
import pytest

from fibrespark.operators import outlines

POINTS = "image_id long, roi_id long, seq long, row double, col double"


def slopes_of(rows, cols, wanted, points=21):
    """The walk point by point, with a library's parabola."""
    place = {}
    for k, rc in enumerate(zip(rows.tolist(), cols.tolist())):
        place.setdefault(rc, k)

    def follow(start, steps, met):
        out, here = [], start
        for _ in range(points // 2):
            for dr, dc in steps:
                k = place.get((rows[here] + dr, cols[here] + dc))
                if k is not None and k not in met:
                    here = k
                    break
            met.add(here)
            out.append(here)
        return out

    found = []
    for start in wanted:
        met = {start}
        back = follow(start, outlines.BACK, met)
        path = np.array([*back[::-1], start, *follow(start, outlines.ON, met)])
        y, x = cols[path], rows[path]
        rough = np.degrees(np.arctan2(y[-1] - y[0], x[-1] - x[0])) % 180
        over, value = (x, y) if rough < 45 or rough > 135 else (y, x)
        if len(set(path.tolist())) < 3:
            found.append(None)
        elif len(np.unique(over)) < 3:
            found.append(rough)
        else:
            fit = np.polynomial.Polynomial.fit(over, value, 2)
            line = np.linspace(over[0], over[-1], outlines.SLOPE_STEPS)
            a, b = line[outlines.SLOPE_BETWEEN[0]], line[outlines.SLOPE_BETWEEN[1]]
            rise = fit(b) - fit(a)
            found.append(np.degrees(np.arctan2(rise, b - a) if over is x else np.arctan2(b - a, rise)) % 180)
    return found


def outline(kind):
    rng = np.random.default_rng(len(kind))
    if kind == "circle":
        t = np.linspace(0, 2 * np.pi, 700)
        pts = np.unique(np.stack([np.floor(50 + 30 * np.sin(t)), np.floor(60 + 40 * np.cos(t))], 1), axis=0)
        pts = pts[np.argsort(np.arctan2(pts[:, 0] - 50, pts[:, 1] - 60))]
    elif kind == "walk":  # crosses itself
        pts = np.cumsum(rng.integers(-1, 2, (400, 2)), axis=0).astype(float)
    elif kind == "blob":  # a crowd
        pts = rng.permutation(np.argwhere(rng.random((25, 25)) < 0.5)).astype(float)
    elif kind == "lines":
        pts = np.array([(k, 0) for k in range(30)] + [(0, k) for k in range(10, 40)] + [(k + 60, k + 60) for k in range(30)] + [(200, 200), (300, 300), (300, 301)], float)
    else:  # half pixels, closed
        pts = np.array([(0.5, k) for k in range(20)] + [(k, 19.5) for k in range(1, 20)] + [(0.5, 0)], float)
    return pts


KINDS = ["circle", "walk", "blob", "lines", "half pixels"]


@pytest.mark.parametrize("points", [21, 7])
def test_slopes_equal_the_walk(spark, points):
    rows = [(k % 2, k, 3 * n, float(r), float(c)) for k, kind in enumerate(KINDS) for n, (r, c) in enumerate(outline(kind))]
    frame = spark.createDataFrame(rows, POINTS).repartition(3)
    wanted = frame.select("image_id", "roi_id", "seq").unionByName(frame.select("image_id", "roi_id", "seq").limit(50))
    wanted = wanted.unionByName(spark.createDataFrame([(0, 0, 10**6), (7, 7, 7)], "image_id long, roi_id long, seq long"))
    got = {(r.roi_id, r.seq // 3): r.slope for r in outlines.outline_slopes(wanted, frame, points).collect()}
    assert len(got) == len(rows)
    for k, kind in enumerate(KINDS):
        pts = outline(kind)
        first = {}
        for n, rc in enumerate(map(tuple, pts.tolist())):
            first.setdefault(rc, n)
        own = [n for n in range(len(pts)) if first[tuple(pts[n].tolist())] == n]
        for n, want in zip(own, slopes_of(pts[:, 0], pts[:, 1], own, points)):
            if want is None:
                assert got[k, n] is None
            else:
                off = abs(got[k, n] - want)
                assert min(off, 180 - off) < 1e-6, (kind, n)


def test_straight_and_slanted_lines(spark):
    rows = [(0, 1, k, float(k), 0.0) for k in range(60)] + [(0, 2, k, 0.0, float(k)) for k in range(60)] + [(0, 3, k, float(k), float(k)) for k in range(60)] + [(0, 4, 30, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, POINTS)
    got = {r.roi_id: r.slope for r in outlines.outline_slopes(frame.where("seq = 30"), frame).collect()}
    assert got == {1: pytest.approx(0), 2: pytest.approx(90), 3: pytest.approx(45), 4: None}
    assert outlines.outline_slopes(frame.limit(0), frame).count() == 0 and outlines.outline_slopes(frame, frame.limit(0)).count() == 0
