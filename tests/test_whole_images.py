"""Images searched or transformed whole in a task give what the spread forms give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fibrespark.operators import neighbors

FIBERS = "image_id long, fiber_id long, center_row double, center_col double, angle double"


@pytest.mark.parametrize("k", [1, 4])
def test_neighbors_in_whole_images_equal_those_on_cells(spark, k):
    rng = np.random.default_rng(8)
    rows = [(i, int(f), float(r), float(c), float(f % 180)) for i, n in enumerate((600, 2, 1, 3)) for f, r, c in zip(rng.permutation(n), rng.integers(0, 40, n), rng.integers(0, 40, n))]
    f = spark.createDataFrame(rows + [(0, 9999, None, 4.0, 1.0)], FIBERS).repartition(3)
    one, other = neighbors.nearest_neighbors(f, k), neighbors.nearest_neighbors(f, k, whole=0)
    got, want = sorted(map(tuple, one.collect())), sorted(map(tuple, other.collect()))
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])
    assert one.schema == other.schema and len(got) == 600 * k + 2 + 3 * min(k, 2)
