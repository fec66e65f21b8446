"""Embedding near-dedup by the epsilon grid order join.

Vectors of one label are normalised, turned onto their principal directions and put in the order of grid cells of width epsilon over the leading ones;
unit vectors have a cosine of at least c exactly if they are within epsilon = sqrt(2 - 2c) of each other. The ordered sequence is cut into
blocks. Blocks whose boxes over the leading directions are further apart than epsilon can't hold a pair and are
never brought together; the others are joined by recursion: both sequences are halved, intervals with distant boxes are skipped, and short
ones are compared in double precision.

* Equal vectors of a label are one class with a count, found by a grouped aggregate; a group of copies costs one vertex.
* A pair of blocks answers with a number of links and one spanning link per vector, so groups of near copies don't list their pairs.
* The directions come from the ``sample`` vectors with the smallest hashes of their class; they decide what is skipped, never what is linked.
* Range partitioning by (label, cells) splits a hot label.

Null label, null vector, a null or non-finite component, a zero vector, no components: linked with nothing, a component of its own id.
Vectors of different lengths aren't compared. Null ids: null component unless linked with an id. Repeated rows are copies of
each other. Empty table: empty result. Further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

LEAST_COSINE = 0.93
LEADING = 4
BLOCK = 2048
LEAF = 128
SAMPLE = 4096
SLACK = 1e-6  # of single-precision boxes


def _principal(sample: np.ndarray, leading: int) -> np.ndarray:
    """Leading principal directions of unit vectors, as columns."""
    values, directions = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(sample.shape[1], -1))
    return directions[:, np.argsort(values)[::-1][:leading]]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance between the boxes of two sets of points."""
    gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
    return float(np.sqrt((gap * gap).sum()))


def sequence_join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine >= least (i < j if both sequences are the same one), by recursion over intervals."""
    epsilon = np.sqrt(2 - 2 * least) + SLACK
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        if i >= j or k >= m or same and m <= i + 1:
            continue
        if _apart(pa_[i:j], pb[k:m]) > epsilon:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            x, y = np.nonzero((a[i:j] @ b[k:m].T) / (na[i:j, None] * nb[None, k:m]) >= least)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            found.append((x, y))
        elif j - i >= m - k:
            h = (i + j) // 2
            stack += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            stack += [(i, j, k, h), (i, j, h, m)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _local_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs (x, y), of n points."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            return root


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, id_col="vec_id", vector_col="embedding", label_col="label", leading: int = LEADING, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept (id = component_id)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<float>").alias("_v"), F.col(label_col).alias("_label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = F.col("_label").isNotNull() & F.coalesce(F.size("_v") > 0, F.lit(False)) & F.forall("_v", finite) & F.exists("_v", lambda x: x != 0)
    rows = rows.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    classes = rows.where("_ok").groupBy("_label", "_v").agg(F.min("_id").alias("least_id"), F.count(F.lit(1)).alias("m"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("_v")), "vectors")

    dims = [r[0] for r in classes.select("dim").distinct().limit(64).collect()]
    turn: dict[int, np.ndarray] = {}
    for d in dims:  # one, in practice; a table of more lengths than that has its others ordered by their own components
        picked = classes.where(F.col("dim") == d).orderBy(F.xxhash64("_v"), "cid").limit(sample).select("_v").collect()
        turn[d] = _principal(_unit(np.array([r[0] for r in picked], dtype=np.float64)), min(leading, d)) if len(picked) > 1 else np.eye(d)[:, :leading]
    width = float(np.sqrt(2 - 2 * least))

    def turned(v: np.ndarray) -> np.ndarray:
        directions = turn.get(v.shape[1])
        out = _unit(v) @ (np.eye(v.shape[1])[:, :leading] if directions is None else directions)
        return np.pad(out, ((0, 0), (0, leading - out.shape[1])))

    label = classes.schema["_label"].dataType.simpleString()
    label_type = classes.select("_label").limit(0).toArrow().schema.field(0).type

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, v = batch.column("dim").to_numpy(), batch.column("_v").to_pylist()
            out = np.zeros((batch.num_rows, leading), dtype=np.int32)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                out[at] = np.floor(turned(np.array([v[i] for i in at], dtype=np.float64)) / width)
            extra = [pa.array(out[:, k]) for k in range(leading)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    names = [f"c{k}" for k in range(leading)]
    gridded = classes.select("_label", "dim", "cid", "m", "_v").mapInArrow(cells, f"_label {label}, dim int, cid long, m long, _v array<float>, " + ", ".join(f"{n} int" for n in names))
    order = ["_label", "dim", *names, "cid"]
    parts = max(1, -(-classes.count() // (8 * block)))
    ordered = gridded.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .blocks import block_ids

        ids = block_ids()
        for batch in batches:
            labels, dim, v = batch.column("_label").to_pylist(), batch.column("dim").to_pylist(), batch.column("_v").to_pylist()
            start = 0
            for end in range(1, batch.num_rows + 1):
                if end < batch.num_rows and end - start < block and (labels[end], dim[end]) == (labels[start], dim[start]):
                    continue
                a = np.array(v[start:end], dtype=np.float32)
                t = turned(a.astype(np.float64))
                part = slice(start, end)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([next(ids)], pa.int64()), pa.array([labels[start]], label_type), pa.array([dim[start]], pa.int32()),
                        pa.array([batch.column("cid").to_pylist()[part]], pa.list_(pa.int64())), pa.array([batch.column("m").to_pylist()[part]], pa.list_(pa.int64())),
                        pa.array([a.tobytes()], pa.binary()), pa.array([t.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([t.max(axis=0).tolist()], pa.list_(pa.float64())),
                    ],
                    names=["block", "_label", "dim", "cids", "m", "v", "lo", "hi"],
                )
                start = end

    blocks = written(ordered.mapInArrow(cut, f"block long, _label {label}, dim int, cids array<long>, m array<long>, v binary, lo array<double>, hi array<double>"), "vector-blocks")

    # pairs of blocks that may hold a link: met in a cell of the first direction, then by their boxes
    reach = width + SLACK
    cell = lambda x: F.floor(x / F.lit(reach)).cast("int")
    boxes = blocks.select("block", "_label", "dim", "lo", "hi")
    here = boxes.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")[0]), cell(F.col("hi")[0]))))
    there = boxes.select(*[F.col(c).alias(f"{c}2") for c in ("block", "_label", "dim", "lo", "hi")])
    there = there.withColumn("cell2", F.explode(F.sequence(cell(F.col("lo2")[0] - reach), cell(F.col("hi2")[0] + reach))))
    met = here.join(there, (F.col("_label") == F.col("_label2")) & (F.col("dim") == F.col("dim2")) & (F.col("cell") == F.col("cell2")) & (F.col("block") <= F.col("block2")))
    gaps = [F.greatest(F.lit(0.0), F.col("lo")[k] - F.col("hi2")[k], F.col("lo2")[k] - F.col("hi")[k]) for k in range(leading)]
    near = met.where(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= F.lit(reach * reach)).select("block", "block2").distinct()
    left = blocks.select("block", "dim", F.col("cids").alias("cids1"), F.col("m").alias("m1"), F.col("v").alias("v1"))
    right = blocks.select(F.col("block").alias("block2"), F.col("cids").alias("cids2"), F.col("m").alias("m2"), F.col("v").alias("v2"))
    pairs = near.join(left, "block").join(right, "block2").select("block", "block2", "dim", "cids1", "m1", "v1", "cids2", "m2", "v2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                same = row["block"] == row["block2"]
                a, b = (np.frombuffer(row[c], np.float32).reshape(-1, row["dim"]).astype(np.float64) for c in ("v1", "v2"))
                x, y = sequence_join(a, b, turned(a), turned(b), least, same)
                cids = np.array(row["cids1"] if same else row["cids1"] + row["cids2"], dtype=np.int64)
                m = np.array(row["m1"] if same else row["m1"] + row["m2"], dtype=np.int64)
                y = y if same else y + len(a)
                links = np.zeros(len(cids), dtype=np.int64)
                np.add.at(links, x, m[y])
                np.add.at(links, y, m[x])
                hit = np.flatnonzero(links)
                root = _local_roots(len(cids), x, y)
                yield pa.RecordBatch.from_arrays([pa.array(cids[hit]), pa.array(links[hit]), pa.array(cids[root[hit]])], names=["cid", "links", "to"])

    found = written(pairs.mapInArrow(compare, "cid long, links long, to long"), "vector-links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    judged = classes.join(counts, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least_of = judged.groupBy("root").agg(F.min("least_id").alias("component_id"))
    judged = judged.join(least_of, "root").select(F.col("_label").alias("l"), F.col("_v").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    linked = rows.where("_ok").join(judged, (F.col("_label") == F.col("l")) & (F.col("_v") == F.col("v"))).select("_id", "n_links", "component_id")
    alone = rows.where("NOT _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))
