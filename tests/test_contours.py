from collections import deque

import numpy as np
import pytest

from fibrespark.operators import contours

MASK = "image_id long, row long, col long, value int, note string"


def label_pixels(filled):
    labels, n = {}, 0
    for start in sorted(filled):
        if start in labels:
            continue
        n += 1
        labels[start] = n
        queue = deque([start])
        while queue:
            r, c = queue.popleft()
            for p in ((r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if p in filled and p not in labels:
                    labels[p] = n
                    queue.append(p)
    return labels


def trace(filled):
    """Loops by squares of four pixels: each joins the points on its sides."""
    follow = {}
    for r, c in {(r - a, c - b) for r, c in filled for a in (0, 1) for b in (0, 1)}:
        corner = [(r, c) in filled, (r, c + 1) in filled, (r + 1, c + 1) in filled, (r + 1, c) in filled]
        side = [(r, c + 0.5), (r + 0.5, c + 1), (r + 1, c + 0.5), (r + 0.5, c)]
        for k in range(4):
            if not corner[k] and corner[(k + 1) % 4]:
                leave = next(m % 4 for m in range(k + 1, k + 5) if corner[m % 4] and not corner[(m + 1) % 4])
                assert side[leave] not in follow
                follow[side[leave]] = side[k]
    loops = []
    while follow:
        loop = [min(follow)]
        while loop[-1] in follow:
            loop.append(follow.pop(loop[-1]))
        loops.append(loop)
    return loops


def spiral(n):
    """One long line that winds inwards."""
    grid, r, c, d = np.zeros((n, n), bool), 0, 0, 0
    grid[0, 0] = True
    for length in [n - 1, n - 1, n - 1, *[x for k in range(n - 3, 0, -2) for x in (k, k)]]:
        for _ in range(length):
            r, c = r + (0, 1, 0, -1)[d % 4], c + (1, 0, -1, 0)[d % 4]
            grid[r, c] = True
        d += 1
    return grid


def masks():
    rng = np.random.default_rng(3)
    yield from (rng.random((24, 90)) < p for p in (0.1, 0.4, 0.55, 0.8))
    checks = np.indices((12, 150)).sum(axis=0) % 2 == 0
    ring = np.zeros((20, 20), bool)
    ring[2:18, 2:18] = True
    ring[5:15, 5:15] = False
    ring[8:12, 8:12] = True
    one = np.zeros((3, 3), bool)
    one[1, 1] = True
    yield from (checks, ring, one, spiral(33), np.ones((5, 200), bool))


@pytest.fixture(scope="module")
def case(spark):
    grids = list(masks())
    rows = [(k, int(r), int(c), 255, "x") for k, g in enumerate(grids) for r, c in zip(*np.nonzero(g))] + [(0, 0, 500, 0, "empty"), (99, 1, 1, 0, "empty")]
    rows += rows[:5]  # repeated pixels
    return grids, spark.createDataFrame(rows, MASK).repartition(4)


def test_components_equal_a_flood(case):
    grids, mask = case
    got = {(r.image_id, r.row, r.col): r.roi_id for r in contours.mask_components(mask).collect()}
    want = {(k, r, c): n for k, g in enumerate(grids) for (r, c), n in label_pixels({(int(r), int(c)) for r, c in zip(*np.nonzero(g))}).items()}
    assert got == want


def test_contours_equal_tracing(case):
    grids, mask = case
    got, chosen = {}, {}
    for r in contours.contours(mask).collect():
        got.setdefault((r.image_id, r.loop), {})[r.seq] = (r.row, r.col)
    for r in contours.mask_contours(mask).collect():
        chosen.setdefault((r.image_id, r.roi_id), {})[r.seq] = (r.row, r.col)
    in_order = lambda d: [d[k] for k in range(len(d))]
    want, longest = set(), {}
    for k, g in enumerate(grids):
        filled = {(int(r), int(c)) for r, c in zip(*np.nonzero(g))}
        want |= {(k, tuple(loop[:-1])) for loop in trace(filled)}
        labels = label_pixels(filled)
        for n in set(labels.values()):
            longest[k, n] = max(trace({p for p, m in labels.items() if m == n}), key=len)
    assert {(image, tuple(in_order(d))) for (image, _), d in got.items()} == want
    assert {key: in_order(d) for key, d in chosen.items()} == longest


def test_components_of_a_long_chain_and_a_hub(spark):
    rng = np.random.default_rng(0)
    names = rng.permutation(3000).tolist()
    chain = [(1, names[k], names[k + 1]) for k in range(2999)]
    hub = [(2, 7, k) for k in range(8, 3000)] + [(2, 5000, 5001), (3, 4, 4)]
    got = contours.components(spark.createDataFrame(chain + hub, "image_id long, a long, b long")).collect()
    assert {(r.image_id, r.root) for r in got} == {(1, 0), (2, 7), (2, 5000)} and len(got) == 3000 + 2993 + 2


def test_no_pixels(spark):
    none = spark.createDataFrame([], MASK)
    assert contours.mask_components(none).count() == 0 and contours.mask_contours(none).count() == 0
