"""Ranked lexical search over compressed postings, document at a time.

The index is a table. Each shard has some megabytes of consecutive documents: their ids in ascending order and lengths in one row, and a
row for each term with its documents (differences of their places in the shard) and how often it occurs there, as numbers of 7 bits a byte. The
corpus's totals and each term's documents are sums over shards. A search joins the items' terms with the postings; each shard merges an
item's postings lists by a heap of the lists' next documents, a window of documents at a time, adds up the scores and keeps the
best ones in a bounded heap by score, then id; the shards' results are ranked together. Scores are integers, so any order of adding gives
the same.

Defined results: terms are what `inside` matches, A-Z folded; null and empty texts have no terms and are not counted as documents; very
long texts are taken whole, in parts that end between words; ties go to the smaller doc_id, rows without one coming last; repeated rows
are documents of their own; the rows of one item_id make one item with all their terms, rows without one are left out; an item without
known terms, an empty table of items or of documents gives no rows; other columns are kept out, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, materialise, tidy_shuffles
from .words import strings, words_of

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
WINDOW = 1 << 14


def terms(data: np.ndarray) -> np.ndarray:
    """Letters and digits of ASCII, and everything beyond it."""
    return _TERM[data]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as 7 bits a byte, the last byte of each below 128; and where each number begins (one more)."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for b in range(7, 64, 7):
        size += v >> np.uint64(b) > 0
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for i in range(int(size.max()) if len(v) else 0):
        some = size > i
        out[at[:-1][some] + i] = ((v[some] >> np.uint64(7 * i)) & np.uint64(127)) | (size[some] > i + 1).astype(np.uint64) << np.uint64(7)
    return out, at


def decode(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    size = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for i in range(int(size.max()) if len(ends) else 0):
        some = size > i
        out[some] |= (data[starts[some] + i].astype(np.int64) & 127) << (7 * i)
    return out


POSTINGS = "shard long, term string, n_docs long, n_terms long, data binary, ids array<long>, lengths array<long>"
_NAMES = ["shard", "term", "n_docs", "n_terms", "data", "ids", "lengths"]
_TYPES = [pa.int64(), pa.large_string(), pa.int64(), pa.int64(), pa.large_binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


class Shard:
    """Documents on their way into one shard."""

    def __init__(self):
        self.ids: list = []
        self.bytes = 0
        self.known: list[pa.Array] = []  # distinct words of each part
        self.words = 0
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # document, word and times

    def add(self, ids: list, data: np.ndarray, offsets: np.ndarray) -> None:
        for doc, own, at in words_of(data, offsets, terms):
            words = pc.dictionary_encode(strings(own, at))
            size = len(words.dictionary)
            pair, times = np.unique(doc * size + words.indices.to_numpy(), return_counts=True)
            self.pairs.append((pair // size + len(self.ids), pair % size + self.words, times))
            self.known.append(words.dictionary)
            self.words += size
        self.ids += ids
        self.bytes += len(data)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        if not self.pairs:
            return
        words = pc.dictionary_encode(pa.concat_arrays(self.known))
        doc, word, times = (np.concatenate([p[i] for p in self.pairs]) for i in range(3))
        self.pairs, self.known = [], []
        used = np.unique(doc)
        order = np.array(sorted(range(len(used)), key=lambda i: (self.ids[used[i]] is None, self.ids[used[i]] or 0, i)), np.int64)
        place = np.zeros(len(self.ids), np.int64)
        place[used[order]] = np.arange(len(used))
        # by word, then document; a text in several parts has a pair in each of them
        pair = words.indices.to_numpy().astype(np.int64)[word] * len(used) + place[doc]
        order_of = np.argsort(pair, kind="stable")
        pair, times = pair[order_of], times[order_of]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pair, times = pair[first], np.add.reduceat(times, first)
        word, doc = pair // len(used), pair % len(used)
        lengths = np.bincount(doc, times, len(used)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        steps = np.diff(doc, prepend=0)
        steps[starts] = doc[starts]
        data, at = encode(np.stack([steps, times], 1).ravel())
        ends = np.append(starts[1:], len(word))
        cuts = at[np.append(starts, len(word)) * 2]
        n = len(starts)
        blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(data)])
        ids = [self.ids[i] for i in used[order].tolist()]
        head = [[number], [None], [len(ids)], [int(times.sum())], [None], [ids], [lengths.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(head, _TYPES, strict=True)], names=_NAMES)
        nothing = [pa.nulls(n, t) for t in _TYPES[5:]]
        body = [pa.array(np.full(n, number)), words.dictionary.take(pa.array(word[starts])), pa.array(ends - starts), pa.array(np.add.reduceat(times, starts)), blobs, *nothing]
        for a in range(0, n, 20_000):
            yield pa.RecordBatch.from_arrays([x.slice(a, 20_000) for x in body], names=_NAMES)


def shards(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = Shard()
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids, a = batch.column(0).to_pylist(), 0
            while a < len(ids):  # as many documents as the shard has room for, one at least
                b = int(np.searchsorted(offsets, offsets[a] + shard_bytes - shard.bytes, "right")) - 1
                b = min(max(b, a + 1 if not shard.bytes else a), len(ids))
                if b > a:
                    shard.add(ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if b < len(ids):
                    yield from shard.rows(number)
                    shard, number = Shard(), number + 1
                a = b
        yield from shard.rows(number)

    return run


def index(docs: DataFrame, *, shard_bytes: int = 1 << 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of docs, a written table: a row for each shard and term, and one for each shard's documents, whose term is null."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialise(own.mapInArrow(shards(shard_bytes), POSTINGS), "postings")


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, term and how often the item has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, own, at in words_of(*buffers(batch.column(1)), terms):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), strings(own, at)], names=["item_id", "term"])

    own = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id IS NOT NULL")
    return own.mapInArrow(run, "item_id long, term string").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def merged(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, int]]:
    """(score, place) of the k best documents of ascending lists (places, gains). The heap has each list's next document; every
    round takes the lists whose next one lies in the window that the least of them opens."""
    heap = [(int(places[0]), i, 0) for i, (places, _) in enumerate(lists) if len(places)]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []  # bounded, the worst on top: least score, of equal ones the greatest place
    while heap:
        low = heap[0][0]
        some, gains = [], []
        while heap and heap[0][0] < low + WINDOW:
            _, i, a = heapq.heappop(heap)
            places, gain = lists[i]
            b = a + int(np.searchsorted(places[a:], low + WINDOW))
            some.append(places[a:b])
            gains.append(gain[a:b])
            if b < len(places):
                heapq.heappush(heap, (int(places[b]), i, b))
        total = np.zeros(WINDOW, np.int64)
        np.add.at(total, np.concatenate(some) - low, np.concatenate(gains))
        at = np.flatnonzero(total > (best[0][0] if len(best) == k else 0))  # a later document does not displace an equal one
        if len(at) > k:
            at = at[total[at] >= np.partition(total[at], -k)[-k]]
        for i in at[np.lexsort((at, -total[at]))][:k].tolist():
            entry = (int(total[i]), -(low + i))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return [(s, -p) for s, p in sorted(best, reverse=True)]


def search(docs_index: DataFrame, items: DataFrame, *, k: int = 10, block_items: int = 512, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents with a score above 0."""
    spark = docs_index.sparkSession
    documents, postings = docs_index.where("term IS NULL"), docs_index.where("term IS NOT NULL")
    with tidy_shuffles(spark):
        n, total = documents.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        asked = materialise(item_terms(items, item_id, text), "item-terms")
        blocks = max(1, -(-asked.select("item_id").distinct().count() // block_items))
        df = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).alias("weight")
        wanted = asked.join(df.select("term", weight), "term").where("weight > 0").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
        wanted = materialise(wanted.groupBy("block", "term", "weight").agg(F.collect_list(F.struct("item_id", "times")).alias("items")), "asked-terms")  # a block's items at most

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, lengths = right.column("ids")[0].as_py(), right.column("lengths")[0].values.to_numpy()
            m = 25 + (75 * lengths * n) // total
            sizes = left.column("n_docs").to_numpy()
            both = decode(np.frombuffer(b"".join(left.column("data").to_pylist()), np.uint8)).reshape(-1, 2)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            places = np.cumsum(both[:, 0])
            places -= np.repeat(places[cuts[:-1]] - both[cuts[:-1], 0], sizes)
            gain = np.repeat(left.column("weight").to_numpy(), sizes) * ((1_000_000_000 * both[:, 1]) // (1000 * both[:, 1] + 8 * m[places]))
            lists: dict[int, list] = {}
            for a, b, who in zip(cuts[:-1], cuts[1:], left.column("items").to_pylist(), strict=True):
                for x in who:
                    lists.setdefault(x["item_id"], []).append((places[a:b], gain[a:b] * x["times"] if x["times"] > 1 else gain[a:b]))
            for item, own in lists.items():
                out += [(item, ids[p], s) for s, p in merged(own, k)]
        return pa.Table.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["item_id", "doc_id", "score"])

    left = postings.select("shard", "term", "n_docs", "data").join(wanted, "term").select("shard", "block", "n_docs", "data", "weight", "items")
    right = documents.select(F.col("shard").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), "ids", "lengths")
    found = left.groupBy("shard", "block").cogroup(right.groupBy("of", "part")).applyInArrow(score, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
