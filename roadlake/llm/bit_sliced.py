"""Exact top-k by inner product over a bit-sliced index.

Components become integers, floor(scale * x). A block of rows is stored as bitmaps, one for each dimension and bit of its
components, counted from the block's least component. A query's scores are added up as bitmaps too: every set bit of a query's
component adds that dimension's slices, moved up by the bit's place, and full adders work column by column on all bitmaps of one
weight at once; a negative component takes the slices' complement, so nothing is ever subtracted. The k best rows are then found
from the most significant slice of the sum downward; rows that tie at the boundary are told apart by their id, exactly. Rows and
queries meet in tiles of a block of each, and the tiles' results are ranked together.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without an id or with a
component of more than 2^24 after scaling, as sums have to fit 64 bits; zero and empty vectors take part. An inner product needs
equal lengths: a query meets the rows of its own length. Rows with the query's id are its own and no candidates. Repeated rows are
candidates of their own and take a place each; of query rows with one id the least vector (by its integers, in order) asks. Ties go to
the smaller id. An empty table, or no query, gives no rows. Other columns are kept out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tidy_shuffles
from .vectors import matrix

MOST = 1 << 24
FOUND = "query_id long, vec_id long, score long, times long"


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as double; null where the vector takes no part."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) <= MOST))
    return F.when(fine, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")))


def slices_of(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps (dimension, bit, word of 64 rows) of the components above their least one, and that least one."""
    low = int(values.min()) if values.size else 0
    above = np.zeros((-(-max(len(values), 1) // 64) * 64, values.shape[1]), np.uint64)
    above[: len(values)] = values - low
    bits = int(above.max()).bit_length() if above.size else 0
    out = np.zeros((values.shape[1], bits, len(above) // 64), np.uint64)
    for b in range(bits):
        out[:, b] = np.packbits(((above >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T.copy(), axis=1, bitorder="little").view(np.uint64)
    return out, low


def added(columns: list[list[np.ndarray]], words: int) -> np.ndarray:
    """The sum of bitmaps, of weight 2^i in columns[i], as slices from the least significant: full adders on three bitmaps at a time."""
    out, i = [], 0
    while i < len(columns):
        own = np.concatenate(columns[i]) if columns[i] else np.zeros((0, words), np.uint64)
        carries = []
        while len(own) > 1:
            if third := len(own) // 3:
                a, b, c, rest = own[:third], own[third : 2 * third], own[2 * third : 3 * third], own[3 * third :]
                odd = a ^ b
                carries.append((a & b) | (odd & c))
                odd ^= c
                own = np.concatenate([odd, rest]) if len(rest) else odd
            else:
                carries.append(own[:1] & own[1:])
                own = own[:1] ^ own[1:]
        out.append(own[0] if len(own) else np.zeros(words, np.uint64))
        if carries:
            if i + 1 == len(columns):
                columns.append([])
            columns[i + 1] += carries
        i += 1
    return np.stack(out) if out else np.zeros((0, words), np.uint64)


def sums(slices: np.ndarray, low: int, q: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices of every row's inner product with q, and what has to be added to them."""
    _, bits, words = slices.shape
    high, size = (1 << bits) - 1, np.abs(q)
    columns: list[list[np.ndarray]] = [[] for _ in range((int(size.max()).bit_length() if size.size else 0) + bits)]
    for b in range(bits):
        own = slices[:, b] ^ np.where(q < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
        for j in range(int(size.max()).bit_length()):
            if (some := (size >> j) & 1 == 1).any():
                columns[b + j].append(own[some])
    # q * x = |q| * above + q * low, or for q < 0: |q| * (high - above) - |q| * high + q * low
    return added(columns, words), low * int(q.sum()) - high * int(size[q < 0].sum())


def bits_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(slices: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Ordinals of the k largest sums among the rows of a bitmap, of equal ones the first: from the most significant slice downward."""
    sure, tied = np.zeros_like(rows), rows
    for s in slices[::-1]:
        upper = tied & s
        n = int(np.bitwise_count(sure | upper).sum())
        if n > k:
            tied = upper
        else:
            sure, tied = sure | upper, tied & ~s
            if n == k:
                return bits_of(sure)
    own = bits_of(sure)
    return np.concatenate([own, bits_of(tied)[: k - len(own)]])


def score_of(slices: np.ndarray, at: np.ndarray) -> np.ndarray:
    bits = (slices[:, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
    return (bits.astype(np.int64) << np.arange(len(slices))[:, None]).sum(0)


def build(key: tuple, rows: pa.Table) -> pa.Table:
    """One block of the index: ids in ascending order, how often each row occurs, the slices."""
    rows = rows.sort_by([("vec_id", "ascending")])
    d = key[0].as_py()
    values = matrix(rows.column("q")).astype(np.int64) if d else np.zeros((rows.num_rows, 0), np.int64)
    slices, low = slices_of(values)
    one = [d, key[1].as_py(), low, slices.shape[1], rows.column("vec_id").to_pylist(), rows.column("times").to_pylist(), slices.tobytes()]
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(one, INDEX_TYPES, strict=True)], names=INDEX_NAMES)


INDEX_NAMES = ["d", "block", "low", "bits", "ids", "times", "slices"]
INDEX_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
INDEX = "d int, block long, low long, bits int, ids array<long>, times array<long>, slices binary"


def search(rows: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, block_rows: int = 32_768, block_queries: int = 4096, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest inner products; is_query picks the queries among rows."""
    spark = rows.sparkSession
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(vector, scale).alias("q"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    own = own.where("vec_id IS NOT NULL AND q IS NOT NULL").groupBy("vec_id", "q").agg(F.count("*").alias("times"), F.max("is_query").alias("is_query"))
    with tidy_shuffles(spark):
        own = materialise(own, "quantised")
        asked = own.where("is_query").groupBy("vec_id").agg(F.min("q").alias("q"))
        n, n_asked = own.count(), asked.count()
        blocks = max(1, -(-n // block_rows))
        # a small table gets smaller query blocks, so that every core has a tile
        asked_blocks = max(1, -(-n_asked // block_queries), min(-(-n_asked // 64), -(-2 * spark.sparkContext.defaultParallelism // blocks)))
        placed = own.select(F.size("q").alias("d"), F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)).alias("block"), "vec_id", "q", "times")
        index = materialise(placed.groupBy("d", "block").applyInArrow(build, INDEX), "bit-slices")
        # one row of slices for each block of queries; each query once for each block of rows
        left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))))
        right = asked.select(F.size("q").alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(asked_blocks)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "vec_id", "q")

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if rows.num_rows and queries.num_rows:
            d, bits = rows.column("d")[0].as_py(), rows.column("bits")[0].as_py()
            ids, times = (np.array(rows.column(c)[0].as_py(), np.int64) for c in ("ids", "times"))
            low, words = rows.column("low")[0].as_py(), -(-max(len(ids), 1) // 64)
            slices = np.frombuffer(rows.column("slices")[0].as_py(), np.uint64).reshape(d, bits, words)
            every = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
            values = matrix(queries.column("q")).astype(np.int64) if d else np.zeros((queries.num_rows, 0), np.int64)
            for q, i in zip(values, queries.column("vec_id").to_pylist(), strict=True):
                total, more = sums(slices, low, q)
                others = every.copy()
                for a in range(*np.searchsorted(ids, [i, i + 1])):
                    others[a // 64] &= ~(np.uint64(1) << np.uint64(a % 64))
                at = best(total, others, k)
                for x, y in zip(out, (np.full(len(at), i), ids[at], score_of(total, at) + more, times[at]), strict=True):
                    x.append(y)
        return pa.Table.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["query_id", "vec_id", "score", "times"])

    found = left.groupBy("d", "block", "part").cogroup(right.groupBy("d", "block", "part")).applyInArrow(meet, FOUND)
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k)))).alias("copy"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
