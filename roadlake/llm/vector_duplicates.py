"""Near-duplicate vectors: NN-descent inside labels, neighbour lists that grow where they are full, audited recall.

1. Equal vectors of a label are one node with a weight, so copies of any number are one row.
2. Lists start from the leaves of a few random-projection trees: in a leaf (in blocks of bounded size) every node
   meets every other. Trees are fitted on a bounded sample; where their leaves hold too much of a large table, random
   hyperplanes through the leaf's middle split them on, so leaves stay small at any size.
3. A round joins neighbours of neighbours: all that have a node in their list, and all in its list, meet, again in
   blocks of bounded size, dealt anew each round; pairs that beat the last of a full list enter it. Rounds end when
   few lists change.
4. Found pairs within `margin` of the threshold tie nodes into groups. A list that is full of such pairs may miss some,
   whatever its length, so these nodes are searched for exactly: leaders that have them all within a radius meet every
   node of their label, at the threshold widened by the radius, and groups that meet become one. Each group's nodes are
   compared in double precision, tile by tile, which counts links and reports stars of them, never all pairs. Their
   components are the result.
5. The audit finds the links of a set of nodes by brute force over all rows. The set has the nodes with the smallest hash:
   20 x `audit`, and four times as many up to 320 x `audit` until `audit` of them have links, or all nodes. A node counts
   if all its links are found, so a pair counts as much as a group of thousands. Below the share `target` the lists double
   and the descent goes on. If the longest lists don't reach it, or too few nodes have links to tell, every node is
   searched for exactly, as those with full lists are. The result's `audit_recall` is the share measured of what is
   returned, `audited` the number of nodes with links behind it, `exact_search` whether it took that last step.

Defined results: vectors that are null, zero or hold null or non-finite components, and vectors without label, link with
nothing and are kept; one vec_id with several vectors is a row and a node for each, all with that number; vectors of different lengths link with nothing of the other length; repeated rows are copies: they link
with each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, tidy_shuffles
from .components import components
from .vectors import Forest, matrix, usable

EDGES = "a long, b long, similarity float"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best_pairs(node: np.ndarray, x: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of a block, for each node its k most similar that beat the worst in its list."""
    s = x @ x.T
    s[node[:, None] == node[None]] = -2
    m = min(k, len(node) - 1)
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
    a = np.repeat(np.arange(len(node)), m)
    b, v = top.ravel(), np.take_along_axis(s, top, 1).ravel()
    good = v > np.maximum(worst[a], -1.5)
    return node[a[good]], node[b[good]], v[good]


def met(k: int):
    """Runs best_pairs() on each group of rows (g, block, node, x, worst), which come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
            node, worst = table.column("node").to_numpy(), table.column("worst").to_numpy()
            rows = lambda i, j: matrix(table.column("x").slice(i, j - i)).astype(np.float32)  # noqa: E731  a group's vectors are equally long
            found = [best_pairs(node[i:j], rows(i, j), worst[i:j], k) for i, j in zip(bounds[:-1], bounds[1:], strict=True) if j - i > 1]
            a, b, v = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.float32())], names=["a", "b", "similarity"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            new = np.flatnonzero((np.diff(held.column("g").to_numpy()) != 0) | (np.diff(held.column("block").to_numpy()) != 0)) + 1
            if len(new):
                yield emit(held.slice(0, new[-1]).combine_chunks(), np.concatenate([[0], new]))
                held = held.slice(new[-1])
        if held is not None:
            yield emit(held.combine_chunks(), np.array([0, held.num_rows]))

    return run


def meetings(members: DataFrame, nodes: DataFrame, worst: DataFrame | None, k: int, most: int, seed: int) -> DataFrame:
    """members (g, node): all nodes of a group meet, large groups in random blocks of about `most`."""
    sizes = members.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most)
    blocks = F.coalesce(F.ceil(F.col("n") / most), F.lit(1))
    dealt = members.join(sizes, "g", "left").select("g", F.pmod(F.xxhash64("node", F.lit(seed)), blocks).cast("long").alias("block"), "node")
    with_x = dealt.join(nodes.select("node", F.col("unit").alias("x")), "node")
    with_x = with_x.join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0))) if worst is not None else with_x.withColumn("worst", F.lit(-2.0))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_x.select("g", "block", "node", "x", "worst").repartition(n, "g", "block").sortWithinPartitions("g", "block").mapInArrow(met(k), EDGES)


def shortened(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each list, ties to the smaller node."""
    once = edges.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def tile_links(threshold: float):
    """Links of a tile (label, lo, hi): how many weights each node gains, and stars of the links. Only pairs across the two blocks of a tile count, or within a tile of one block."""

    def run(table: pa.Table) -> pa.Table:
        node, weight, block = (table.column(c).to_numpy() for c in ("node", "weight", "own"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        x = unit(matrix(table.column("x")))
        left, right = (np.flatnonzero(block == lo), np.flatnonzero(block == hi)) if lo != hi else (np.arange(len(node)),) * 2
        linked = x[left] @ x[right].T >= threshold
        if lo == hi:
            np.fill_diagonal(linked, False)
        gained = np.zeros(len(node), np.int64)
        gained[left] += linked @ weight[right]
        if lo != hi:
            gained[right] += linked.T @ weight[left]
        # trees of the links, breadth first; their smallest node is the star's middle
        tree, last = np.full(len(node), -1), 0
        full = np.zeros((len(node), len(node)), bool) if lo != hi else linked
        if lo != hi:
            full[np.ix_(left, right)] = linked
            full |= full.T
        for i in range(len(node)):
            if tree[i] < 0:
                front = np.zeros(len(node), bool)
                front[i] = True
                while front.any():
                    tree[front] = last
                    front = full[front].any(0) & (tree < 0)
                last += 1
        low = np.full(last, np.iinfo(np.int64).max)
        np.minimum.at(low, tree, node)
        return pa.table({"node": node, "links": gained, "middle": low[tree]})

    return run


def leaders_of(threshold: float, radius: float):
    """Nodes of a group that have all its rows within an angle `radius`, and the similarity that a leader's search needs."""

    def run(table: pa.Table) -> pa.Table:
        x = unit(matrix(table.column("unit")))
        left, at, bound = np.arange(len(x)), [], []
        while len(left):
            s = x[left] @ x[left[0]]
            own = s >= np.cos(radius)
            own[0] = True
            at.append(left[0]), bound.append(np.cos(np.arccos(threshold) + np.arccos(np.clip(s[own].min(), -1, 1))))
            left = left[~own]
        return table.select(["group", "label", "unit"]).take(pa.array(at)).append_column("bound", pa.array(bound, pa.float64()))

    return run


def leaders(members: DataFrame, threshold: float, margin: float, most: int = 4096) -> DataFrame:
    """group, label, unit, bound: leaders of members (group, label, node, unit), in blocks of about `most` of a group."""
    sizes = members.groupBy("group").agg(F.count("*").alias("n"))
    dealt = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / most)))
    alone = dealt.where("n = 1").select("group", "label", "unit", F.lit(threshold).alias("bound"))
    schema = f"group long, label long, unit {members.schema['unit'].dataType.simpleString()}, bound double"
    return alone.union(dealt.where("n > 1").repartition("group", "block").groupBy("group", "block").applyInArrow(leaders_of(threshold, np.arccos(threshold - margin) - np.arccos(threshold)), schema))


def by_label(table: pa.Table) -> dict[int, np.ndarray]:
    """Positions of each label's rows."""
    label = table.column("label").to_numpy()
    order = np.argsort(label, kind="stable")
    return {int(label[own[0]]): own for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(own)}


def reached(grouped: DataFrame, found: DataFrame, most: int = 32_768, rows: int = 256) -> DataFrame:
    """Pairs of groups (a, b) of which a leader found (group, label, unit, bound) meets a node (group, label, unit).

    Leaders come to the driver `most` at a time, and every node meets those of its label, so nothing is shuffled and
    no pair inside a group is a row.
    """
    parts, out = max(1, -(-found.count() // most)), None
    for part in range(parts):
        got = found.where(F.pmod(F.xxhash64("group", "unit"), F.lit(parts)) == part).toArrow()
        asked = {k: (matrix(got.column("unit").take(pa.array(own))).astype(np.float32), got.column("group").to_numpy()[own], got.column("bound").to_numpy()[own]) for k, own in by_label(got).items()}
        sent = grouped.sparkSession.sparkContext.broadcast(asked)

        def meet(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pairs, table = [np.zeros((0, 2), np.int64)], pa.Table.from_batches([b])
                for k, own in by_label(table).items():
                    if k not in sent.value:
                        continue
                    q, q_group, bound = sent.value[k]
                    x, group = matrix(table.column("unit").take(pa.array(own))).astype(np.float32), table.column("group").to_numpy()[own]
                    for i in range(0, len(q), rows):
                        at, to = np.nonzero(q[i : i + rows] @ x.T >= bound[i : i + rows, None].astype(np.float32) - 1e-5)  # more than single precision loses
                        pair = np.stack([q_group[i + at], group[to]], 1)
                        pairs.append(np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0))
                ties = np.unique(np.concatenate(pairs), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ties[:, 0]), pa.array(ties[:, 1])], names=["a", "b"])

        met_now = materialise(grouped.select("group", "label", "unit").mapInArrow(meet, "a long, b long").distinct(), "ties")
        sent.destroy()
        out = met_now if out is None else out.union(met_now)
    return out


def fit_forest(nodes: DataFrame, sample: int, trees: int, leaf_rows: int, n: int, length: int) -> Deepened:
    got = nodes.where(F.size("unit") == length).select("unit", F.xxhash64("node").alias("h")).orderBy("h").limit(sample).select("unit").toArrow()
    points = matrix(got.column("unit"))
    forest = Forest(points, trees, max(4, len(points) * leaf_rows // max(n, 1)))
    held = n / (leaf_rows * min(forest.leaves))  # how many times too much a leaf holds of the table
    return Deepened(forest, points, max(0, round(np.log2(held))) if len(points) < n else 0)


def link_duplicates(rows: DataFrame, *, threshold: float = 0.98, margin: float = 0.02, k: int = 10, rounds: int = 4, trees: int = 4, leaf_rows: int = 64, sample: int = 20_000, most: int = 128, tile: int = 512, audit: int = 200, target: float = 0.995, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row."""
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x"), F.col(label).alias("label"))
    part = usable("x") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    with tidy_shuffles(rows.sparkSession):
        keyed = own.withColumn("same", F.when(part, F.xxhash64("label", "x")))
        groups = keyed.where("same IS NOT NULL").groupBy("same").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("x").alias("x"), F.first("label").alias("label"))
        size = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
        scaled = groups.withColumn("norm", F.sqrt(size)).withColumn("unit", F.transform("x", lambda c: (c.cast("double") / F.col("norm")).cast("float")))
        nodes = materialise(scaled.withColumn("label", F.xxhash64("label", F.size("x"))).select("same", "node", "weight", "label", "x", "unit"), "vectors")
        n = nodes.count()
        linked, recall, audited, everything = None, 1.0, 0, False
        if n > 1:
            common = nodes.groupBy(F.size("unit").alias("d")).count().orderBy(F.desc("count")).first()[0]
            linked = descend(nodes, n, common, threshold, margin, k, rounds, trees, leaf_rows, sample, most, tile, audit, target)
            recall, audited, everything = linked.audit_recall, linked.audited, linked.exact_search
        if linked is None:
            linked = nodes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("label"))
        found = materialise(nodes.select("same", "node", "weight").join(linked, "node", "left").select("same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "node").alias("component_id")), "linked-vectors")
        discard(nodes)
    out = keyed.select("vec_id", "same").join(found, "same", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    out.audit_recall, out.audited, out.exact_search = recall, audited, everything  # what the audit measured
    return out


class Deepened:
    """A forest whose leaves are split on by `bits` random hyperplanes each, through the middle of the leaf's sample."""

    def __init__(self, forest: Forest, points: np.ndarray, bits: int, seed: int = 6):
        self.forest, self.bits = forest, bits
        self.middles, self.planes = [], []
        if bits:
            at = forest.leaf_numbers(points)
            for t, leaves in enumerate(forest.leaves):
                sums = np.zeros((leaves, points.shape[1]))
                np.add.at(sums, at[:, t], points)
                self.middles.append(sums / np.maximum(1, np.bincount(at[:, t], minlength=leaves))[:, None])
                self.planes.append(np.random.default_rng(seed + t).normal(size=(points.shape[1], bits)))

    def leaf_numbers(self, x: np.ndarray) -> np.ndarray:
        out = self.forest.leaf_numbers(x)
        for t, (middles, planes) in enumerate(zip(self.middles, self.planes, strict=True)):
            side = (x - middles[out[:, t]]) @ planes >= 0
            out[:, t] = (out[:, t] << self.bits) + side @ (1 << np.arange(self.bits))
        return out


def true_links(nodes: DataFrame, n: int, threshold: float, audit: int, rows: int = 256) -> tuple[DataFrame, int, bool]:
    """(node, links) of the audited nodes that have links, their number, and whether they are enough or all."""
    most = 20 * audit
    while True:
        got = nodes.select("node", "label", "x").orderBy(F.xxhash64("node"), "node").limit(most).toArrow()
        asked = {k: (unit(matrix(got.column("x").take(pa.array(own)))), got.column("node").to_numpy()[own]) for k, own in by_label(got).items()}
        sent = nodes.sparkSession.sparkContext.broadcast(asked)

        def brute(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, sums, table = [], [], pa.Table.from_batches([b])
                for k, own in by_label(table).items():
                    if k not in sent.value:
                        continue
                    q, q_node = sent.value[k]
                    x, (node, weight) = unit(matrix(table.column("x").take(pa.array(own)))), (table.column(c).to_numpy()[own] for c in ("node", "weight"))
                    for i in range(0, len(q), rows):
                        at, to = np.nonzero((q[i : i + rows] @ x.T >= threshold) & (q_node[i : i + rows, None] != node[None]))
                        some, back = np.unique(at, return_inverse=True)
                        ids.append(q_node[i + some]), sums.append(np.bincount(back, weight[to], len(some)).astype(np.int64))
                ids, sums = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (ids, sums))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.int64())], names=["node", "links"])

        truth = materialise(nodes.select("node", "label", "weight", "x").mapInArrow(brute, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")), "audit-links")
        sent.destroy()
        linked = truth.count()
        if linked >= audit or most >= min(n, 320 * audit):
            return truth, linked, linked >= audit or most >= n
        discard(truth)
        most *= 4


def descend(nodes: DataFrame, n: int, length: int, threshold: float, margin: float, k: int, rounds: int, trees: int, leaf_rows: int, sample: int, most: int, tile: int, audit: int, target: float) -> DataFrame:
    forest = fit_forest(nodes, sample, trees, leaf_rows, n, length)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            fits = np.flatnonzero(lists.value_lengths().to_numpy() == length)
            out = np.zeros((b.num_rows, trees), np.int64)
            if len(fits):
                out[fits] = forest.leaf_numbers(matrix(lists.take(pa.array(fits))))
            flat = (out * trees + np.arange(trees)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), trees)), pa.array(np.repeat(b.column(1).to_numpy(), trees)), pa.array(flat)], names=["node", "label", "leaf"])

    in_leaves = nodes.select("node", "label", "unit").mapInArrow(leaves, "node long, label long, leaf long").select(F.xxhash64("label", "leaf").alias("g"), "node")
    graph = materialise(shortened(meetings(in_leaves, nodes, None, k, most, 0), k), "neighbours")
    truth, linked, enough = true_links(nodes, n, threshold, audit)

    def recall_of(out: DataFrame) -> float:
        """Share of the audited nodes that have all their links."""
        whole = truth.join(out.select("node", F.col("links").alias("got")), "node").where("got >= links").count()
        return whole / linked if linked else 1.0

    seed, everything = 0, False
    for wide in (k, 2 * k, 4 * k) if enough else (k,):
        for _ in range(rounds):
            seed += 1
            lists = graph.select(F.col("a").alias("g"), F.col("b").alias("node"))
            members = lists.union(lists.select(F.col("node").alias("g"), F.col("g").alias("node"))).union(graph.select("a", "a")).distinct()
            worst = graph.groupBy(F.col("a").alias("node")).agg(F.when(F.count("*") >= wide, F.min("similarity").cast("double")).alias("worst"))
            found = meetings(members, nodes, worst, wide, most, seed)
            new = materialise(shortened(graph.union(found), wide), "neighbours")
            changed = new.join(graph.select("a", "b"), ["a", "b"], "left_anti").count()
            discard(graph)
            graph = new
            if changed < 0.01 * n * wide:
                break
        near = materialise(graph.where(F.col("similarity") >= threshold - margin).select("a", "b"), "near-vectors")
        groups = components(near)
        full = near.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") >= wide).select("node")
        out = joined_exactly(nodes, near, groups, full, threshold, margin, tile)
        discard(near, groups)
        recall = recall_of(out)
        if enough and recall >= target:
            break
        discard(out)
    else:
        everything = True
        near = materialise(graph.where(F.col("similarity") >= threshold - margin).select("a", "b"), "near-vectors")
        groups = components(near)
        out = joined_exactly(nodes, near, groups, nodes.select("node"), threshold, margin, tile)
        discard(near, groups)
        recall = recall_of(out)
    discard(graph, truth)
    out.audit_recall, out.audited, out.exact_search = recall, linked, everything
    return out


def joined_exactly(nodes: DataFrame, near: DataFrame, groups: DataFrame, asked: DataFrame, threshold: float, margin: float, tile: int) -> DataFrame:
    """exact() of groups, after every group with asked nodes has met all that they link with."""
    named = groups.select("node", F.col("label").alias("group"))
    grouped = materialise(nodes.select("node", "label", "unit").join(named, "node", "left").withColumn("group", F.coalesce("group", "node")), "grouped-vectors")
    found = materialise(leaders(grouped.join(asked, "node", "left_semi"), threshold, margin), "leaders")
    ties = reached(grouped, found)
    wider = groups if ties.isEmpty() else components(near.union(ties))  # a group's number is one of its nodes
    out = exact(nodes, wider, threshold, tile)
    discard(grouped, found, wider)
    return out


def exact(nodes: DataFrame, groups: DataFrame, threshold: float, tile: int) -> DataFrame:
    """node, links, label: exact links inside groups (node, label), and the components that they make."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / tile).cast("int")
    rows = groups.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(F.col("label").alias("group"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node")
    # a group holds one label only, as lists do: nodes meet inside labels
    tiled = rows.join(nodes.select("node", "weight", "x"), "node").groupBy("group", "lo", "hi").applyInArrow(tile_links(threshold), "node long, links long, middle long")
    tiles = materialise(tiled, "tile-links")
    joined = components(tiles.where("node <> middle").select(F.col("node").alias("a"), F.col("middle").alias("b")))
    links = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    out = materialise(links.join(joined, "node", "left").select("node", "links", F.coalesce("label", "node").alias("label")), "exact-links")
    discard(tiles, joined)
    return out
