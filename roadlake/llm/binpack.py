"""Token-id output: documents as packed id matrices.

Best-fit-decreasing packing with a segment tree over bin capacities. A task packs the pieces of one block of documents
(a fixed number of tokens, so its memory is bounded and no row crosses tasks), longest piece first, each into the
fullest bin that still has room. Documents longer than a bin are cut losslessly into full pieces and a rest.

Each result row is one row of the id matrix: input_ids (size numbers, padded), the cumulative segment lengths
cu_seqlens (from 0), position_ids that restart at 0 with each segment, and the documents and starts of the segments.
Defined results: a null or empty text is the end id alone; repeated rows are packed as rows of their own; an empty table
gives no rows; other columns are ignored. A row_id holds the task's number, so it depends on how the table's files are split.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, groups_of
from .packing import spread


class RoomTree:
    """A segment tree over the capacities 0..size: how many open bins have exactly this much room left."""

    def __init__(self, size: int):
        self.half = 1 << size.bit_length()
        self.some = bytearray(2 * self.half)  # whether a bin lies below this node
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        i = room + self.half
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the smallest room that is at least `least`, with its room."""
        i = least + self.half
        if not self.some[i]:
            while i > 1 and not (i % 2 == 0 and self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.half:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.half
        bin_id = self.bins[room].pop()
        if not self.bins[room]:
            while i:
                self.some[i] = 0
                i >>= 1
                if i and (self.some[2 * i] or self.some[2 * i + 1]):
                    break
        return bin_id, room


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The bin of each piece, and the number of bins. Ties: the earlier piece first."""
    tree, bins, out = RoomTree(size), 0, np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found, bins = (bins, size), bins + 1
        out[i] = found[0]
        tree.add(found[1] - n, found[0])
    return out, bins


def tiktoken_encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rows_of(block: list[tuple[pa.Array, np.ndarray, np.ndarray]], size: int, pad: int, part: int, number: int) -> pa.RecordBatch:
    """Packs the documents of one block: (doc_ids, ids, ends) of several batches."""
    doc_ids = pa.concat_arrays([x[0] for x in block])
    ids = np.concatenate([x[1] for x in block])
    tokens = np.concatenate([np.diff(x[2]) for x in block])
    begin = np.cumsum(tokens) - tokens
    pieces = -(-tokens // size)
    doc = np.repeat(np.arange(len(tokens)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
    length = np.minimum(size, tokens[doc] - start)
    bins, n = best_fit_decreasing(length, size)
    order = np.argsort(bins, kind="stable")
    length, doc, start, bins = length[order], doc[order], start[order], bins[order]
    ends = np.cumsum(length)
    edge = np.searchsorted(bins, np.arange(n + 1))  # the first segment of each bin
    base = (ends - length)[edge[:-1]]
    within = np.arange(ends[-1]) - np.repeat(ends - length, length)  # the position in its segment
    flat = np.repeat(bins * size + ends - length - base[bins], length) + within
    matrix, positions = np.full(n * size, pad, np.int32), np.zeros(n * size, np.int32)
    matrix[flat], positions[flat] = ids[np.repeat(begin[doc] + start, length) + within], within
    filled = np.bincount(bins, length, n).astype(np.int64)
    bounds = np.zeros(len(doc) + n, np.int32)
    bounds[np.arange(len(doc)) + bins + 1] = ends - base[bins]
    raw = matrix.astype("<u4").tobytes()
    lists = lambda v, o, t: pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, t))
    each = np.arange(n + 1) * size
    return pa.RecordBatch.from_arrays(
        [
            pa.array((part << 40) + (number << 20) + np.arange(n), pa.int64()),
            lists(matrix, each, pa.int32()),
            lists(bounds, edge + np.arange(n + 1), pa.int32()),
            lists(positions, each, pa.int32()),
            pa.ListArray.from_arrays(pa.array(edge, pa.int32()), doc_ids.take(pa.array(doc))),
            lists(start, edge, pa.int64()),
            pa.array(filled, pa.int64()),
            pa.array([zlib.crc32(raw[4 * size * i : 4 * size * (i + 1)]) for i in range(n)], pa.int64()),
        ],
        names=["row_id", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "starts", "n_tokens", "ids_crc32"],
    )


SCHEMA = "row_id long, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<long>, starts array<long>, n_tokens long, ids_crc32 long"


def packer(path: str, pattern: str, size: int, end_id: int, pad: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = tiktoken_encoder(path, pattern).encode_ordinary, TaskContext.get().partitionId(), 0
        block, held = [], 0
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            doc_ids = batch.column(0).cast(pa.int64())
            for a, b in groups_of(offsets, 1 << 20):
                raw, at = data[offsets[a] : offsets[b]].tobytes(), offsets[a : b + 1] - offsets[a]
                got = [np.array(encode(raw[i:j].decode()), np.uint32) for i, j in zip(at[:-1], at[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
                ids, ends = spread(np.concatenate(got), ends, end_id)
                block.append((doc_ids.slice(a, b - a), ids, ends))
                held += len(ids)
                if held >= block_tokens:
                    yield rows_of(block, size, pad, part, number)
                    block, held, number = [], 0, number + 1
        if block:
            yield rows_of(block, size, pad, part, number)

    return run


def pack_ids(docs: DataFrame, path: str, pattern: str, *, size: int = 2048, end_id: int = 50256, pad: int = 50256, block_tokens: int = 1 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per packed matrix row; write it with write_binary() or as Parquet. A map over the scan, no shuffle."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(packer(path, pattern, size, end_id, pad, block_tokens), SCHEMA)


def write_binary(packed: DataFrame, path: str) -> None:
    """Writes the matrix as binary records: little-endian 32-bit ids, cumulative lengths and positions as bytes, beside the documents."""
    binary, whole = ("input_ids", "cu_seqlens", "position_ids"), ("row_id", "doc_ids", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            as_bytes = [pa.array([np.asarray(x.values, "<i4").tobytes() for x in b.column(name)], pa.binary()) for name in binary]
            yield pa.RecordBatch.from_arrays([*as_bytes, *(b.column(name) for name in whole)], names=[*binary, *whole])

    schema = ", ".join(f"{name} binary" for name in binary)
    packed.mapInArrow(run, f"{schema}, row_id long, doc_ids array<long>, starts array<long>").write.parquet(path)
