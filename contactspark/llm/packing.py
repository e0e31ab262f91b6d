"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A piece of n tokens costs `linear * n + quadratic * n * n`, as attention stays within a document.
Documents go, the longest first, to the sequence of the lowest cost that has room left; what does
not fit there is cut off and goes on to the next lowest. Documents are gathered and packed a few million tokens at a
time, so packing is a narrow step: no shuffle, and memory follows the gathering, not the input. All
sequences of a gathering are full; what is left, less than a sequence, is packed with the next one. The last
tokens of a partition go to sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import coder, few, read_vocabulary
from .common import giving_back

#: Sequences of one task get consecutive ids from its partition's number times this on.
IDS_PER_PARTITION = 1 << 40

#: Tokens that are gathered before they are packed.
GATHER = 2_000_000

#: Bytes of text that are encoded at once; a slice looks each of its distinct chunks up once.
SLICE = 8_000_000

SCHEMA = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to n, the largest first."""
    return [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


def assign(lengths: list[int], capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, last: bool = True) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences are numbered from 0.

    Documents of no token get no piece; equal lengths keep their order. Tokens that fill no sequence go to some of powers of two;
    unless this is the last packing: then they are pieces of sequence -1, which are still to be packed.
    """
    full, rest = divmod(sum(lengths), capacity)
    room = [capacity] * full + ([] if not rest else powers_of_two(rest) if last else [rest])
    used = [0] * len(room)
    open_ = [(0.0, s) for s in range(len(room))]  # by cost; equal costs by number
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[i]
        while left:
            cost, s = heapq.heappop(open_)
            n = min(left, room[s] - used[s])
            yield i, start, n, s if last or s < full else -1, used[s]
            used[s] += n
            start, left = start + n, left - n
            if used[s] < room[s]:
                heapq.heappush(open_, (cost + linear * n + quadratic * n * n, s))


def pack_documents(
    df: DataFrame, tokenizer_path: str, capacity: int = 2048, text: str = "text", key: str = "doc_id", end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048
) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then end_id, so null and empty texts have one token. Rows of the
    same key or text are packed as separate documents. Sequences hold `capacity` tokens, the last few of
    a partition a power of two. The other columns of df are not kept. An empty table gives no rows.
    """
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in SCHEMA)])
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))
    end = np.array([end_id], "<u4").tobytes()

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value, "library")
        first = TaskContext.get().partitionId() * IDS_PER_PARTITION
        held: list[tuple] = []  # key, ids still to be packed, how many of the document's stand before them, and how many it has
        tokens, kind = 0, pa.int64()

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal held, tokens, first
            rows, left = [], []
            for i, start, n, s, at in assign([len(x[1]) // 4 for x in held], capacity, linear, quadratic, last):
                k, ids, before, size = held[i]
                piece = memoryview(ids)[4 * start : 4 * (start + n)]
                if s < 0:
                    left.append((k, bytes(piece), before + start, size))
                else:
                    rows.append((k, before + start, n, zlib.crc32(piece), size, first + s, at))
            first += max((r[5] - first for r in rows), default=-1) + 1
            held, tokens = left, sum(len(x[1]) // 4 for x in left)
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else kind) for k, c in enumerate(columns)], names=schema.names)

        for whole in batches:
            kind = whole.schema.field(key).type
            for b in few(whole, text, SLICE):
                for k, ids in zip(b[key].to_pylist(), bpe.encode(b[text].to_pylist()), strict=True):
                    ids += end
                    held.append((k, ids, 0, len(ids) // 4))
                    tokens += len(ids) // 4
                if tokens > GATHER:
                    yield packed(False)
        if held:
            yield packed(True)

    return df.select(*dict.fromkeys([key, text])).mapInArrow(run, schema)
