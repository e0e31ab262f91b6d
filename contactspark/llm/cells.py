"""Counts by cell of a table of fixed size, added up over all tasks a block at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import few

#: Cells of one block, which is a row while blocks are added up.
BLOCK_BITS = 16
#: Cells that a task gathers before it counts them.
GATHER = 4_000_000


def added_up(df: DataFrame, text: str, cells: Callable[[pa.RecordBatch], list[np.ndarray]], bits: int, finish: Callable[[np.ndarray], np.ndarray], most: int = (1 << 32) - 1) -> np.ndarray:
    """finish(counts) of all blocks, one after the other, of 2 ** bits cells; each block has 2 ** BLOCK_BITS of them.

    cells gives the cells of a slice of a batch, once for each time that they count; text is the column that slices go by. A task's
    own counts stop at `most`. What the driver gets is as large as the table, whatever the input.
    """
    small = np.dtype("u1" if most < 1 << 8 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            cell = np.concatenate(held).astype("u4", copy=False)
            cell.sort()
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            n = np.minimum(np.diff(np.r_[first, len(cell)]), most).astype(small)
            cell = cell[first]
            edges = np.searchsorted(cell, np.arange((1 << bits - BLOCK_BITS) + 1, dtype="u8") << np.uint64(BLOCK_BITS)).astype("i4")
            at = (cell & np.uint32((1 << BLOCK_BITS) - 1)).astype("<u2")
            some = np.flatnonzero(np.diff(edges))
            sizes = np.r_[edges[some], edges[-1]]  # empty blocks take nothing, so their edges may go
            columns = [pa.array(some, pa.int32()), *(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(sizes * np.int32(x.itemsize)), pa.py_buffer(x)]) for x in (at, n))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "at", "n"])

        for whole in batches:
            for b in few(whole, text):
                held += cells(b)
                if sum(map(len, held)) > GATHER:
                    yield counted()
                    held.clear()
        if sum(map(len, held)):
            yield counted()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = -1, np.zeros(1 << BLOCK_BITS, "i8")

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([finish(total).tobytes()], pa.binary())], names=["block", "total"])

        for b in batches:
            for k, at, n in zip(b["block"].to_pylist(), b["at"].to_pylist(), b["n"].to_pylist(), strict=True):
                if k != block:
                    if block >= 0:
                        yield closed()
                    block, total[:] = k, 0
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, small)  # a row has each cell once
        if block >= 0:
            yield closed()

    found = df.mapInArrow(count, "block int, at binary, n binary").repartition("block").sortWithinPartitions("block").mapInArrow(add_up, "block int, total binary").toArrow()
    empty = finish(np.zeros(1 << BLOCK_BITS, "i8"))
    out = np.tile(empty, (1 << bits - BLOCK_BITS, 1))
    for block, row in zip(found["block"].to_pylist(), found["total"].to_pylist(), strict=True):
        out[block] = np.frombuffer(row, empty.dtype)
    return out.reshape(-1)
