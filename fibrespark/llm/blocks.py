"""Blocks of documents and packed columns.

A block is a bounded run of rows (about ``block_bytes`` of text), written once as one row of a table in the shared folder, with
an id that is fixed from then on. Operators send what a block holds to other tasks by (block, group) and get the answer back
by block, so one word, line or passage costs a block one entry however many of its documents hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pack_ints(values: np.ndarray) -> bytes:
    """32-bit integers of 0 or more, as zstd over their byte planes."""
    a = np.ascontiguousarray(values, dtype=np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


def pack_strings(values: list[str] | pa.Array) -> bytes:
    batch = pa.record_batch([pa.array(values, pa.large_string()) if isinstance(values, list) else values], names=["s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_strings(data: bytes) -> list[str]:
    with pa.ipc.open_stream(data) as source:
        return source.read_all().column(0).to_pylist()


def runs(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of at most about ``block_bytes`` from batches of (id, text); null texts become empty."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                held += len(texts[-1])
                if held >= block_bytes:
                    yield ids, texts
                    ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def block_ids() -> Iterator[int]:
    """Ids no other task uses; they are written with the blocks, so a task that runs again can't change them later."""
    from pyspark import TaskContext

    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 32
    while True:
        yield first
        first += 1
