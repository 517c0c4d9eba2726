"""Shortest-pack-first packing over the histogram of piece lengths.

A document's ids (its tokens, then one end id) are cut into full sequences and one rest. The rests' lengths are
counted in Spark; the packing itself sees the histogram only, at most `size` numbers whatever the corpus, so it runs on
the driver. It places lengths longest first, each into the emptiest open pack that still has room ("shortest pack
first"), and works on pattern counts, not on documents. Documents then find their place by their rank among the rests
of the same length.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are packed as rows of their
own; an empty table gives no rows; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, groups_of, materialise, tidy_shuffles
from .token_cache import WordIds

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long"


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordIds:
    """Ids of space-separated words by the tokenizer in this file. Its pre-tokenizer never joins text across white space.

    A worker keeps it between tasks; it is a cache, so a lost worker costs time only.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(path).encode_batch_fast
    return WordIds(lambda words: [x.ids for x in encode([w.decode() for w in words], add_special_tokens=False)])


def spread(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Puts the end id behind each text's ids."""
    n = len(ends) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(ends))] = ids
    return out, ends + np.arange(n + 1)


def cut_documents(path: str, size: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, ranks = word_encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            data, offsets = buffers(texts)
            for a, b in groups_of(offsets, 1 << 20):
                raw = data[offsets[a] : offsets[b]].tobytes()
                at = offsets[a : b + 1] - offsets[a]
                if b"<|" not in raw:  # which could become a special token; else the tokenizer folds case itself, and words without it repeat more
                    raw = raw.lower()
                ids, ends = spread(*words.ids([raw[i:j].split() for i, j in zip(at[:-1], at[1:], strict=True)]), end_id)
                raw_ids, tokens = ids.astype("<u4").tobytes(), np.diff(ends)
                pieces = -(-tokens // size)
                doc = np.repeat(np.arange(b - a), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(size, tokens[doc] - start)
                first = ends[:-1][doc] + start
                crc = [zlib.crc32(raw_ids[4 * i : 4 * j]) for i, j in zip(first, first + length, strict=True)]
                # rank among the pieces of the same length that this task has made so far
                order = np.argsort(length, kind="stable")
                runs = length[order]
                new = np.flatnonzero(np.diff(runs, prepend=-1))
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc)))) + ranks[runs]
                ranks += np.bincount(length, minlength=size + 1)
                numbers = (start, length, np.array(crc), tokens[doc], np.full(len(doc), part), rank)
                columns = [doc_ids.slice(a, b - a).take(pa.array(doc)).cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in numbers)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
                if keep_ids:  # pieces lie one behind the other
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how many packs, the lengths in each) that place every length of the histogram in packs of at most size.

    Lengths come longest first; each goes to the open patterns with the smallest sum. A pattern that gets a further
    length for only some of its packs is split in two, so the work depends on the histogram alone.
    """
    heap: list[tuple[int, int, int, tuple[int, ...]]] = []  # sum, tie-breaker, count, lengths
    full, made = [], 0
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left = histogram[length]
        while left and heap and heap[0][0] + length <= size:
            total, _, count, lengths = heapq.heappop(heap)
            per_pack = min((size - total) // length, max(1, left // count))
            if per_pack == 1 or left < count:
                packs, times = min(count, left), 1
            else:
                packs, times = count, per_pack
            made += 2
            if packs < count:
                heapq.heappush(heap, (total, made, count - packs, lengths))
            grown = (total + times * length, made + 1, packs, lengths + (length,) * times)
            left -= packs * times
            if grown[0] == size:
                full.append((packs, grown[3]))
            else:
                heapq.heappush(heap, grown)
        if left:
            made += 1
            times = size // length
            if packs := left // times:
                heapq.heappush(heap, (times * length, made, packs, (length,) * times))
            if rest := left % times:
                made += 1
                heapq.heappush(heap, (rest * length, made, 1, (length,) * rest))
    return full + [(count, lengths) for _, _, count, lengths in heap]


def runs_of(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Where the pieces of each length go: runs of ranks, as the first rank, its sequence and the offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used, sequence = Counter(), 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            runs.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return list(runs.items())


def pack(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 1, keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids (unless keep_ids is False)."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids = ["ids"] if keep_ids else []
    with tidy_shuffles(docs.sparkSession):
        pieces = materialise(own.mapInArrow(cut_documents(path, size, end_id, keep_ids), PIECES + ", ids array<int>" * keep_ids), "pieces")
        counts = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
        histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    spark = docs.sparkSession
    runs = spark.createDataFrame(runs_of(shortest_pack_first(histogram, size)), "length long, runs array<struct<first: long, sequence: long, offset: long>>")
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # there are as many counts as tasks times lengths: they are shuffled, not broadcast
    before = counts.select("length", "part", F.coalesce(earlier, F.lit(0)).alias("before")).hint("shuffle_hash")
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(runs), "length")  # at most `size` rows
    placed = placed.withColumn("run", F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1))
    sequence = F.col("run.sequence") + F.col("rank") - F.col("run.first")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return placed.select(*columns, sequence.alias("sequence_id"), F.col("run.offset").alias("offset"), *ids)
