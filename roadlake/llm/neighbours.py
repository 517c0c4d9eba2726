"""Approximate nearest neighbours: a forest of random-projection trees under one shared priority queue, then exact reranking.

The trees are fitted on a bounded sample; every row is indexed. A query takes leaves of all trees in the order of their
distance to its path until they hold `share` of the rows; rows and queries meet in the leaves, where exact distances are
computed on the original vectors. Leaves of too many rows (copies) are split into blocks that all their queries visit.
The share is the smallest of `SHARES` whose recall on audit queries, measured against brute force over all rows,
reaches the target; the last one is every row, so hard data cost time, not recall.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do those of another
length than the commonest; a query's own rows (its id) are no candidates; ties go to the smaller id; repeated candidate
rows count once; an empty table, or no query, gives no rows; other columns are kept out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tidy_shuffles
from .vectors import Forest, matrix, sample_of, usable

SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
FOUND = "query_id long, vec_id long, score double"


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, distance) of the k nearest ids of each query, by their nearest row, ties to the smaller id; a query's own id is left out."""
    distinct, of = np.unique(ids, return_inverse=True)
    by_id = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[by_id], np.arange(len(distinct)))
    out = []
    for q, own in zip(queries, query_ids, strict=True):
        d = np.sqrt(((rows - q) ** 2).sum(1))
        d = np.minimum.reduceat(d[by_id], starts) if len(ids) else d
        d[distinct == own] = np.inf
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
        some = some[np.isfinite(d[some])]
        some = some[np.lexsort((distinct[some], d[some]))][:k]
        out.append((np.full(len(some), own), distinct[some], d[some]))
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0) for i in range(3))


def table_of(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    a, b, d = found
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, is_query: Column, *, k: int = 10, trees: int = 8, leaf_rows: int = 512, sample: int = 20_000, audit: int = 200, target: float = 0.93, block: int = 4096, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows; is_query picks the queries among rows."""
    spark = rows.sparkSession
    own = rows.where(usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("vec_id IS NOT NULL")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return empty
    own, n = own.where(F.size("x") == common[0]), common[1]
    points = sample_of(own, "vec_id", "x", sample)
    forest = Forest(points, trees, max(8, len(points) * leaf_rows // max(n, 1)))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = forest.leaf_numbers(matrix(b.column(1))) if b.num_rows else np.zeros((0, trees), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(numbers.ravel(), pa.int64()), trees).cast(pa.list_(pa.int64()))], names=["vec_id", "x", "is_query", "leaves"])

    kind = own.schema["x"].dataType.simpleString()
    with tidy_shuffles(spark):
        index = materialise(own.mapInArrow(leaves, f"vec_id long, x {kind}, is_query boolean, leaves array<long>"), "index")
        cells = index.select("vec_id", "x", F.posexplode("leaves").alias("tree", "leaf"))
        sizes = [np.zeros(m, np.int64) for m in forest.leaves]
        for t, leaf, m in index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():  # as many as leaves
            sizes[t][leaf] = m
        # audit: brute force for at most `audit` queries over all rows
        checked = index.where("is_query").select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(audit).toArrow()
        if not checked.num_rows:
            return empty
        q, q_ids = matrix(checked.column("x")), checked.column("vec_id").to_numpy()

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield table_of(nearest(q, q_ids, matrix(b.column(1)), b.column(0).to_numpy(), k))

        truth = ranked(index.select("vec_id", "x").mapInArrow(brute, FOUND), k).select("query_id", "vec_id")
        hits = truth.join(index.select("vec_id", "leaves"), "vec_id").groupBy("query_id", "vec_id").agg(F.first("leaves").alias("leaves")).collect()  # audit * k rows
    by_query: dict[int, list] = {}
    for r in hits:
        by_query.setdefault(r.query_id, []).append(r.leaves)
    recall = 0.0
    for share in SHARES:
        got = total = 0
        for x, i in zip(q, q_ids.tolist(), strict=True):
            seen = set(forest.visits(x, sizes, share * n)) if share < 1 else None
            for leaves_of in by_query.get(i, []):
                total += 1
                got += seen is None or any((t, leaf) in seen for t, leaf in enumerate(leaves_of))
        recall = got / total if total else 1.0
        if recall >= target:
            break
    everything = [(0, i) for i in range(forest.leaves[0])]
    blocks = [np.maximum(1, -(-s // block)) for s in sizes]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            at, tree, leaf, part = [], [], [], []
            for i in range(b.num_rows):
                for t, cell in forest.visits(x[i], sizes, share * n) if share < 1 else everything:
                    for p in range(blocks[t][cell]):
                        at.append(i), tree.append(t), leaf.append(cell), part.append(p)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(tree, pa.int64()), pa.array(leaf, pa.int64()), pa.array(part, pa.int64())], names=["vec_id", "x", "tree", "leaf", "part"])

    asked = index.where("is_query").select("vec_id", "x").mapInArrow(visit, f"vec_id long, x {kind}, tree long, leaf long, part long")
    split = [(t, i, int(m)) for t, per in enumerate(blocks) for i, m in enumerate(per) if m > 1]  # as many as leaves at most
    parts = F.coalesce(F.create_map(*[F.lit(v) for t, i, m in split for v in (t * 10_000_000 + i, m)])[F.col("tree") * 10_000_000 + F.col("leaf")], F.lit(1)) if split else F.lit(1)
    kept = cells if share < 1 else cells.where("tree = 0")
    kept = kept.select("vec_id", "x", F.col("tree").cast("long"), "leaf", F.pmod(F.xxhash64("vec_id"), parts).cast("long").alias("part"))

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.Table.from_batches([table_of((np.zeros(0), np.zeros(0), np.zeros(0)))])
        return pa.Table.from_batches([table_of(nearest(matrix(queries.column("x")), queries.column("vec_id").to_numpy(), matrix(rows.column("x")), rows.column("vec_id").to_numpy(), k))])

    key = ["tree", "leaf", "part"]
    out = ranked(kept.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, FOUND), k)
    out.audit_recall, out.share = recall, share  # what the audit measured
    return out
