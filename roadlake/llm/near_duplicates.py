"""Near-duplicate documents: fast similarity sketching, banding, and exact verification of word shingles.

1. Every text becomes the set of its distinct k-word shingles, as 64-bit hashes. Equal sets are one node from here on,
   so a group of copies of any size is one row.
2. A node's sketch has t bins. In round i < t each shingle falls into a random bin, in round t + i into bin i; an empty
   bin takes the smallest value of the first round that reaches it. 2t rounds fill every bin of every set, and bins
   agree with the sets' similarity with the bounds of independent samples.
3. Nodes that share all bins of a band meet in a bucket. Buckets are split into tiles of bounded size. A tile compares
   whole sketches (8 bits a bin) and keeps pairs within `sigmas` standard deviations of the threshold; it reports a
   spanning forest of them, never all pairs.
4. Candidate groups (components of that forest) are compared on full sets, again in tiles and as a spanning forest of
   the links that hold exactly. Components of these links are the result.

A linked pair is lost only if no band agrees (below 1e-6 for a pair at the threshold with the default sketch) or its
sketches disagree by more than `sigmas` deviations.

Defined results: null, empty and blank texts have no shingles and link with nothing; texts with fewer than k words have
their whole word sequence as one shingle; a very long text is compared by its whole set, read in pieces of a few megabytes of documents; pairs
exactly at the threshold are linked; of equal smallest ids each row has its component's number and is kept; repeated rows are rows of one node; a row without id is linked by its text
but kept only if no row has an id; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, discard, groups_of, materialise, mix, span_hashes, tidy_shuffles, word_spans
from .components import components

_UP = np.uint64(32)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs of each text (of the whole text if it has fewer words), and where each text's begin."""
    n = np.diff(first)
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        rolled = mix(rolled + words[i : len(words) - k + 1 + i], k)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    source = np.repeat(first[:-1], counts) + np.arange(starts[-1]) - np.repeat(starts[:-1], counts)
    short = np.flatnonzero((n > 0) & (n < k))
    out = rolled[np.minimum(source, max(0, len(rolled) - 1))] if len(rolled) else np.zeros(len(source), np.uint64)
    for d in short:
        h = np.zeros(1, np.uint64)
        for w in words[first[d] : first[d + 1]]:
            h = mix(h + w, 1000 + int(n[d]))
        out[starts[d]] = h[0]
    return out, starts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    starts, ends, first = word_spans(data, offsets)
    all_, at = shingles(span_hashes(data, starts, ends), first, k)
    return [np.unique(all_[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t numbers for each non-empty set: the fast similarity sketch, whose bins are all filled after 2t rounds."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    out, empty = np.zeros((n, t), np.uint64), np.ones((n, t), bool)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    active, items, owner = np.arange(n), flat, np.repeat(np.arange(n), sizes)
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    for r in range(2 * t):
        if not len(active):
            break
        h = mix(items, 7000 + r)
        bins = ((h >> _UP) * np.uint64(t) >> _UP).astype(np.int64) if r < t else np.full(len(h), r - t)
        best = np.full(len(active) * t, worst)
        np.minimum.at(best, owner * t + bins, h)
        best = best.reshape(-1, t)
        new = (best != worst) & empty[active]
        rows, cols = np.nonzero(new)
        out[active[rows], cols] = mix(best[rows, cols] ^ np.uint64(r))
        empty[active[rows], cols] = False
        left = empty[active].any(1)
        if not left.all():
            active = active[left]
            items = np.concatenate([flat[starts[i] : starts[i + 1]] for i in active]) if len(active) else flat[:0]
            owner = np.repeat(np.arange(len(active)), sizes[active])
    return out


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketched(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = bands * rows
        for batch in batches:
            doc_ids = batch.column(0)
            data, offsets = buffers(batch.column(1))
            for a, b in groups_of(offsets, 1 << 22):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                some = [i for i, s in enumerate(sets) if len(s)]
                bins = sketches([sets[i] for i in some], t)
                h = np.zeros((len(some), bands), np.uint64)
                for i in range(rows):
                    h = mix(h + bins.reshape(-1, bands, rows)[:, :, i], 5)
                h = mix(h + np.arange(bands, dtype=np.uint64), 6).view(np.int64)
                low, keys, node = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                for j, i in enumerate(some):
                    low[i], keys[i], node[i] = (bins[j] & np.uint64(255)).astype(np.uint8).tobytes(), h[j], node_of(sets[i])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(low, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "node", "sketch", "keys"],
                )

    return run


def tiles(df: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Gives each row the tiles that it is in: its group in blocks of about `block` rows, every two blocks one tile."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    df = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return df.select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).drop("own", "other", size)


def by_group(compare: Callable, columns: list[str]):
    """Runs compare(table) on all rows of each run of equal (group, lo, hi); rows come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = compare(table, bounds)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(c).to_numpy() for c in columns]
            new = np.flatnonzero(np.any([np.diff(x) != 0 for x in keys], axis=0)) + 1 if held.num_rows > 1 else np.zeros(0, np.int64)
            if len(new):
                yield from emit(held.slice(0, new[-1]).combine_chunks(), np.concatenate([[0], new]))
                held = held.slice(new[-1])
        if held is not None:
            yield from emit(held.combine_chunks(), np.array([0, held.num_rows]))

    return run


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def stars(forest: Forest, node: np.ndarray) -> list[tuple[int, int]]:
    """(smallest node, other node) within each tree of positions. Tiles of the same nodes report mostly the same pairs."""
    roots = [forest.root(i) for i in range(len(node))]
    low: dict[int, int] = {}
    for r, v in zip(roots, node.tolist(), strict=True):
        low[r] = min(v, low.get(r, v))
    return [(low[r], v) for r, v in zip(roots, node.tolist(), strict=True) if low[r] != v]


def close_sketches(least: int, share: float):
    """Pairs of a tile with at least `least` equal bins and sizes that allow the similarity `share`."""

    def compare(table: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, size = table.column("node").to_numpy(), table.column("n_shingles").to_numpy()
        flat, _ = binary(table.column("sketch"))
        bins = flat.reshape(table.num_rows, -1)
        n = np.diff(bounds)
        two = bounds[:-1][n == 2]
        two = two[((bins[two] == bins[two + 1]).sum(1) >= least) & (np.minimum(size[two], size[two + 1]) >= share * np.maximum(size[two], size[two + 1]))]
        out = [np.stack([node[two], node[two + 1]], 1)]
        for a, b in zip(bounds[:-1][n > 2], bounds[1:][n > 2], strict=True):
            f, x, s = Forest(b - a), bins[a:b], size[a:b]
            for i in range(b - a - 1):
                near = np.flatnonzero(((x[i + 1 :] == x[i]).sum(1) >= least) & (np.minimum(s[i + 1 :], s[i]) >= share * np.maximum(s[i + 1 :], s[i])))
                for j in near.tolist():
                    f.join(i, i + 1 + j)
            out.append(np.array(stars(f, node[a:b]), np.int64).reshape(-1, 2))
        pairs = np.concatenate(out)
        return pairs[:, 0], pairs[:, 1]

    return compare


def binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def exact_links(percent: int, cells: int = 1 << 22):
    """Pairs of a tile whose full sets have 100 * intersection >= percent * union, as a spanning forest."""

    def compare(table: pa.Table, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = table.column("node").to_numpy()
        flat, offsets = binary(table.column("shingles"))
        values, offsets = flat.view(np.uint64) if len(flat) else np.zeros(0, np.uint64), offsets // 8
        size = np.diff(offsets)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a == 2:
                both = len(np.intersect1d(values[offsets[a] : offsets[a + 1]], values[offsets[a + 1] : offsets[b]], assume_unique=True))
                if 100 * both >= percent * (size[a] + size[a + 1] - both):
                    out.append([[node[a], node[a + 1]]])
            elif b - a > 2:
                m = b - a
                _, column, seen = np.unique(values[offsets[a] : offsets[b]], return_inverse=True, return_counts=True)
                row = np.repeat(np.arange(m), size[a:b])
                shared = seen[column] > 1  # shingles of one set alone meet nothing
                rank = np.cumsum(seen > 1) - 1
                row, column = row[shared], rank[column[shared]]
                both, width, total = np.zeros((m, m), np.float32), max(1, cells // m), int((seen > 1).sum())
                order = np.argsort(column, kind="stable")
                row, column = row[order], column[order]
                for c in range(0, total, width):
                    i, j = np.searchsorted(column, [c, c + width])
                    part = np.zeros((m, min(width, total - c)), np.float32)
                    part[row[i:j], column[i:j] - c] = 1
                    both += part @ part.T
                both = np.rint(both).astype(np.int64)
                s = size[a:b]
                i, j = np.nonzero(np.triu(100 * both >= percent * (s[:, None] + s[None] - both), 1))
                f = Forest(m)
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    f.join(x, y)
                out.append(stars(f, node[a:b]))
        pairs = np.concatenate([np.asarray(x, np.int64).reshape(-1, 2) for x in out]) if out else np.zeros((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]

    return compare


def set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for a, b in groups_of(offsets, 1 << 22):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return run


def compared(tiled: DataFrame, group: str, compare: Callable) -> DataFrame:
    key = [group, "lo", "hi"]
    n = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiled.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(by_group(compare, key), "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, sigmas: float = 5.5, block: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept: one row for each row of docs."""
    spark, t, s = docs.sparkSession, bands * rows, percent / 100
    least = math.floor(t * (s - sigmas * math.sqrt(s * (1 - s) / t)))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with tidy_shuffles(spark):
        all_ = materialise(own.mapInArrow(sketched(k, bands, rows), "doc_id long, n_shingles long, node long, sketch binary, keys array<long>"), "sketches")
        nodes = materialise(all_.where("node IS NOT NULL").select("node", "doc_id", "n_shingles", "sketch", "keys").dropDuplicates(["node"]), "nodes")
        members = nodes.select("node", F.explode("keys").alias("key"))
        shared = materialise(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        met = tiles(members.join(shared, "key"), "key", "n", block)
        tiled = met.join(nodes.select("node", "n_shingles", "sketch"), "node")
        near = materialise(compared(tiled, "key", close_sketches(least, s)), "candidates")
        groups = components(near)
        sizes = groups.groupBy("label").agg(F.count("*").alias("n"))
        candidates = materialise(groups.join(sizes, "label").join(nodes.select("node", "doc_id"), "node"), "groups")
        texts = own.join(candidates.select("doc_id").distinct(), own.doc_id.eqNullSafe(candidates.doc_id), "left_semi").select("text")
        sets = texts.mapInArrow(set_rows(k), "node long, shingles binary").dropDuplicates(["node"])
        full = tiles(candidates.select("node", "label", "n"), "label", "n", block).join(sets, "node")
        links = materialise(compared(full, "label", exact_links(percent)), "links")
        labels = components(links)
        labelled = materialise(all_.select("doc_id", "n_shingles", "node").join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("label")), "labelled")
        first = materialise(labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id")), "first")
    discard(all_, nodes, shared, near, groups, candidates, links, labels)
    out = labelled.join(first, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest id, the first of these rows; rows without id come last.

    Columns stay as they are, whatever their names. Null, empty and blank texts link with nothing, so all their rows stay.
    """
    row = "row of near_duplicates"
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows, doc_id=row, text=text, **options).select(F.col("doc_id").alias(row), "component_id")
    best = groups.join(rows.select(row, F.col(doc_id).cast("long").alias("id")), row).groupBy("component_id").agg(F.min_by(row, F.struct(F.col("id").isNull(), "id", row)).alias(row))
    return rows.join(best.select(row), row, "left_semi").drop(row)
