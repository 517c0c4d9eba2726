"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(w | v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b)/(V+1), where b is the bucket (power of two) of the context's count c(v). The
weights l(b) come from expectation-maximisation on counts held out from the training documents: the documents of one fold
are deleted from all counts, and the weights make their tokens likeliest.

The corpus is dealt into chunks of documents of bounded size. A chunk asks for the counts of its distinct n-grams, as 64-bit
hashes dealt by their value to buckets; a bucket adds up what all chunks have of an n-gram and answers each chunk in
the order of its question, so no vocabulary is broadcast or collected and no token is a row. A chunk's hash order is
a function of its texts, so later passes line answers up again. Held-out likelihoods reach the driver as a histogram of
quantised probability ratios (a quarter of an octave), whose size does not grow with the corpus.

Defined results: null and empty texts are their end alone; a very long text is scored whole, as a chunk of its own size; repeated rows are rows,
count as often as they occur and score alike; documents are dealt by id and text, so many rows without id, or of one id, are in many chunks; a
document without id is a training document; without training documents the base is log10(1) a token; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, crc_of_id, groups_of, materialise, mix, span_hashes, text_bytes, tidy_shuffles, word_spans

END = mix(np.array([0xE0D], np.uint64), 20)[0]
STEPS = 4  # of an octave, for ratios of probabilities
FOLDS, TEST_FOLD, DELETED_FOLD = 5, 1, 0


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all lowest bytes first: the high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


class Chunk:
    """The tokens and distinct n-grams of a chunk of documents."""

    def __init__(self, table: pa.Table):
        data, offsets = buffers(table.column("text"))
        n = len(offsets) - 1
        words, firsts, done = [], [np.zeros(1, np.int64)], 0
        pa.default_memory_pool().release_unused()  # the last chunk's, before this one's arrays
        for a, b in groups_of(offsets, 1 << 22):
            part = data[offsets[a] : offsets[b]]
            starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a])
            words.append(span_hashes(part, starts, ends))
            firsts.append(first[1:] + done)
            done += len(starts)
        first = np.concatenate(firsts)
        self.sizes = np.diff(first) + 1
        self.ends = np.cumsum(self.sizes)  # behind each document's end token
        token = np.full(done + n, END, np.uint64)
        if done:
            token[np.arange(done) + np.repeat(np.arange(n), np.diff(first))] = np.concatenate(words)
        del words
        context = np.concatenate([[END], token[:-1]]).astype(np.uint64)  # a document's first context is the end of another
        pairs, self.pair = np.unique(mix(mix(context, 22) + token, 23) & ~np.uint64(1), return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        del context
        single, self.token = np.unique(mix(token, 21) | np.uint64(1), return_inverse=True)
        self.token = self.token.astype(np.int32)
        del token
        end = np.searchsorted(single, mix(np.array([END]), 21)[0] | np.uint64(1))
        self.context = np.concatenate([[end], self.token[:-1]]).astype(np.int32)
        keys = np.concatenate([pairs, single])
        self.n_pairs, order = len(pairs), np.argsort(keys, kind="stable")
        self.keys, self.back = keys[order], np.argsort(order, kind="stable")
        self.order = order

    def per_key(self, documents: np.ndarray) -> np.ndarray:
        """How often each key occurs in these documents (a mask)."""
        of = np.repeat(documents, self.sizes)
        pairs = np.bincount(self.pair[of], minlength=self.n_pairs)
        return np.concatenate([pairs, np.bincount(self.token[of], minlength=len(self.keys) - self.n_pairs)])[self.order]

    def counts(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its count, its context's and that of both together, from values in the order of the keys."""
        values = values[self.back].astype(np.float64)
        single = values[self.n_pairs :]
        return single[self.token], single[self.context], values[: self.n_pairs][self.pair]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def questions(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        chunk, fold = Chunk(table), table.column("fold").to_numpy()
        n, deleted = chunk.per_key(fold != TEST_FOLD), chunk.per_key(fold == DELETED_FOLD)
        edge = np.searchsorted(bucket_of(chunk.keys, buckets), np.arange(buckets + 1))
        some = [i for i in range(buckets) if edge[i] < edge[i + 1]]
        cut = lambda x: pa.array([planes(x[edge[i] : edge[i + 1]]) for i in some], pa.binary())
        steps = np.diff(chunk.keys, prepend=np.uint64(0))
        steps[edge[some]] = chunk.keys[edge[some]]  # each bucket's first key is whole
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int64()), "bucket": pa.array(some, pa.int64()), "keys": cut(steps), "n": cut(n), "deleted": cut(deleted)})

    return ask


def answers(table: pa.Table) -> pa.Table:
    """All that chunks ask of one bucket. Sums over the bucket's words stand in the first row."""
    asked = [np.cumsum(unplanes(x), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = lambda name: np.bincount(at, np.concatenate([unplanes(x) for x in table.column(name).to_pylist()]).astype(np.float64), len(keys)).astype(np.int64)
    n, deleted = total("n"), total("deleted")
    word = (keys & np.uint64(1)).astype(bool)
    ends = np.cumsum([len(x) for x in asked])
    cut = lambda x: pa.array([planes(x[at[b - len(a) : b]].astype(np.uint64)) for a, b in zip(asked, ends, strict=True)], pa.binary())
    first = lambda x: pa.array([int(x)] + [0] * (len(asked) - 1), pa.int64())
    left = (n - deleted)[word]
    return pa.table({
        "chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": cut(n), "deleted": cut(deleted),
        "words": first((n[word] > 0).sum()), "tokens": first(n[word].sum()), "words_left": first((left > 0).sum()), "tokens_left": first(left.sum()),
    })


ANSWER = "chunk long, bucket long, n binary, deleted binary, words long, tokens long, words_left long, tokens_left long"


def in_order(table: pa.Table, name: str) -> np.ndarray:
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column(name).to_pylist(), strict=True))
    return np.concatenate([unplanes(x) for _, x in rows])


def estimates(c: np.ndarray, context: np.ndarray, both: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram and unigram estimates, and the bucket of the context's count: 0 for 0, else 1 + its logarithm to the base 2."""
    return both / np.maximum(context, 1), c / max(tokens, 1), np.frexp(context)[1]


def held_out_histogram(tokens: int, words: int):
    def run(docs: pa.Table, answer: pa.Table) -> pa.Table:
        cells, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if docs.num_rows:
            chunk = Chunk(docs)
            held = np.repeat(docs.column("fold").to_numpy() == DELETED_FOLD, chunk.sizes)
            pair, single, bucket = estimates(*chunk.counts(in_order(answer, "n") - in_order(answer, "deleted")), tokens)
            level = lambda f: np.where(f > 0, np.rint(STEPS * np.log2(np.maximum(f, 1e-300) * (words + 1))) + 512, 0).astype(np.int64)
            cells, n = np.unique(((bucket.astype(np.int64) << 24) + (level(pair) << 12) + level(single))[held], return_counts=True)
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, rounds: int = 200, prior: float = 0.5) -> np.ndarray:
    """A row of weights (bigram, unigram, uniform) for each bucket, by expectation-maximisation; a pseudo-count keeps all above 0."""
    bucket, pair, single = cells >> 24, cells >> 12 & 4095, cells & 4095
    ratio = lambda q: np.where(q > 0, 2.0 ** ((q - 512) / STEPS), 0.0)
    f = np.stack([ratio(pair), ratio(single), np.ones(len(cells))], 1)
    w = np.tile([0.4, 0.4, 0.2], (66, 1))
    for _ in range(rounds):
        share = w[bucket] * f
        share *= (n / share.sum(1))[:, None]
        w = np.stack([np.bincount(bucket, share[:, i], 66) for i in range(3)], 1) + prior
        w[0, 0] = 0  # no context, no bigram
        w /= w.sum(1, keepdims=True)
    seen = np.bincount(bucket, n, 66) > 0
    for b in range(1, 66):  # a bucket that no held-out token had takes its lower neighbour's weights
        if not seen[b] and b > 1:
            w[b] = w[b - 1]
    return w


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(tokens: int, words: int, weights: np.ndarray):
    def run(docs: pa.Table, answer: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        chunk = Chunk(docs)
        c, context, both = chunk.counts(in_order(answer, "n"))
        pair, single, bucket = estimates(c, context, both, tokens)
        w = weights[bucket]
        p = w[:, 0] * pair + w[:, 1] * single + w[:, 2] / (words + 1)
        starts = chunk.ends - chunk.sizes
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": pa.array(docs.column("fold").to_numpy() == TEST_FOLD), "n_tokens": pa.array(chunk.sizes, pa.int64()),
            "n_known": pa.array(add((c > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(docs.num_rows, tokens), pa.int64()),
            "base_score": add(np.log10((c + 0.5) / (tokens + 0.5 * (words + 1)))), "score": add(np.log10(p)),
        })

    return run


def score(docs: DataFrame, *, chunk_bytes: int = 3 << 20, bucket_bytes: int = 4 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs."""
    size = text_bytes(docs, text)
    chunks, buckets = max(64, math.ceil(size / chunk_bytes)), max(64, math.ceil(size / bucket_bytes))
    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(FOLDS)), F.lit(DELETED_FOLD)).cast("long").alias("fold"),
        F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")), F.lit(chunks)).cast("long").alias("chunk"),
    )
    by_chunk = own.groupBy("chunk")
    with tidy_shuffles(docs.sparkSession):
        asked = by_chunk.applyInArrow(questions(buckets), "chunk long, bucket long, keys binary, n binary, deleted binary")
        answered = materialise(asked.groupBy("bucket").applyInArrow(answers, ANSWER), "ngram-answers")
        total = answered.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("words", "tokens", "words_left", "tokens_left"))).first()
        words, tokens, words_left, tokens_left = total
        answer = answered.select("chunk", "bucket", "n", "deleted").groupBy("chunk")
        held = by_chunk.cogroup(answer).applyInArrow(held_out_histogram(tokens_left, words_left), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weights = learn_weights(held.column("cell").to_numpy(), held.column("n").to_numpy())
    return by_chunk.cogroup(answer).applyInArrow(scores(tokens, words, weights), SCORES)
