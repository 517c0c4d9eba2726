"""Toxic severity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = logistic(threshold_k - w . x): all thresholds share the weights w; x has a feature's count, as log(1 + n).
Words are runs of letters (A-Z, a-z and bytes beyond ASCII), A-Z folded. Features are words and the beginnings of longer
words (4 to 7 bytes), which languages with many endings need. Those count whose share in toxic documents differs
significantly, the `features` most significant ones. They are chosen and fitted on at most `rows` labelled documents, those with
the smallest hash of their id: documented bounds of the model, so the driver holds `rows` times `features` counts at most, however long
the texts are. Grades beyond the two of a 0/1 label come from how many words of a toxic document show a feature of toxic documents:
up to 2, 3 to 5, more.

A document is called toxic if P(grade > 0) reaches a cut that the labelled documents teach too: each of `FOLDS` folds is left
out of choosing and fitting in turn and judged by the rest. Of the cuts that call at most `most_false` of the left-out clean
documents toxic, the cut is the highest that catches the most toxic ones, put halfway to the next
document below.

Defined results: null and empty texts have no features and so the base rate's severity; very long texts are scored whole, in
pieces of a few megabytes of documents at a time; a label above 0 is toxic, any other is not; labels that are null, or of ids that no
document has, teach nothing; a label given twice counts as its greatest; of rows with one id the smallest text teaches; without
labels of both kinds every document has severity 0; repeated rows are rows of their own and score alike, ties included; an
empty table gives no rows; other columns of docs are kept out of the result, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, discard, groups_of, materialise, mix, span_hashes, word_spans

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 4
NO_WORDS = np.zeros(0, np.uint64)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of features
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5  # of P(grade > 0)
    caught: float = 0.0  # share of left-out toxic documents at the cut
    left_alone: float = 1.0  # share of left-out clean documents below it

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        """P(grade = k) in columns."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None] - margin[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(margin), 1)), below, np.ones((len(margin), 1))], 1), axis=1)


NOTHING = Model(NO_WORDS, np.zeros(0), np.array([40.0]))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of weights and ordered thresholds by Adam on all rows; thresholds stay ordered as sums of exponentials."""
    n, k = len(grades), int(grades.max()) + 1
    base = np.array([np.clip((grades <= i).mean(), 1e-6, 1 - 1e-6) for i in range(k - 1)])
    cut = np.log(base / (1 - base))
    p = np.concatenate([np.zeros(features), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, gaps = p[:features], np.exp(p[features + 1 :])
        t = np.concatenate([[-np.inf], p[features] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        z = np.bincount(rows, values * w[columns], n)
        hi, lo = sigma(t[grades + 1] - z), sigma(t[grades] - z)
        chance = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / chance, lo * (1 - lo) / chance  # of log chance by the upper and the lower threshold
        g = np.empty_like(p)
        g[:features] = np.bincount(columns, values * (dlo - dhi)[rows], features) / n - ridge * w
        dt = (np.bincount(grades, dhi, k)[: k - 1] - np.bincount(grades, dlo, k)[1:]) / n
        g[features] = dt.sum()
        g[features + 1 :] = gaps * np.cumsum(dt[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p[:features], p[features] + np.concatenate([[0], np.cumsum(np.exp(p[features + 1 :]))])


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and beginnings of words; the document and the word (counted over all documents) of each."""
    starts, ends, first = word_spans(data, offsets, LETTERS)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes, words = [span_hashes(data, starts, ends)], [np.arange(len(starts))]
    for n in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > n)
        hashes.append(mix(span_hashes(data, starts[longer], starts[longer] + n), 30))
        words.append(longer)
    word = np.concatenate(words)
    return np.concatenate(hashes), doc[word], word


def counted_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents, and toxic ones, of a batch and fold each feature is."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            some = batch.slice(a, 256)
            data, offsets = buffers(some.column(0))
            toxic, fold = (some.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            h, doc, _ = features_of(data, offsets)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (np.diff(h) != 0) | (np.diff(doc) != 0)
            words, at = np.unique(h[new], return_inverse=True)
            cells, of = np.unique(at * FOLDS + fold[doc[new]], return_inverse=True)
            bad = np.bincount(of, toxic[doc[new]] > 0, len(cells)).astype(np.int64)
            columns = [words[cells // FOLDS].view(np.int64), (cells % FOLDS).astype(np.int32), np.bincount(of, minlength=len(cells)), bad]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["word", "fold", "n", "bad"])


def found_features(words: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, chosen feature and word of each occurrence of a chosen feature."""
    h, doc, word = features_of(data, offsets)
    if not len(words):
        return doc[:0], doc[:0], word[:0]
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = words[at] == h
    return doc[hit], at[hit], word[hit]


def taught_features(words: np.ndarray, shows_toxic: np.ndarray):
    """A row for each document: its chosen features and how often it has them, and, for each way of choosing (a row of shows_toxic),
    how many of its words show a feature of toxic documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                doc, at, word = found_features(words, *buffers(some.column(1)))
                pairs, times = np.unique(doc * max(1, len(words)) + at, return_counts=True)
                cuts = np.searchsorted(pairs // max(1, len(words)), np.arange(some.num_rows + 1))
                owner = np.zeros(int(word.max()) + 1 if len(word) else 0, np.int64)
                owner[word] = doc
                hits = np.stack([np.bincount(owner[np.unique(word[toxic[at]])], minlength=some.num_rows) for toxic in shows_toxic], 1)
                listed = lambda x, cuts=cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32()))
                own = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1) * len(shows_toxic), pa.int32()), pa.array(hits.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), listed(pairs % max(1, len(words))), listed(times), own], names=["doc_id", "features", "times", "hits"])

    return run


class Labelled:
    """The labelled documents' chosen features, on the driver: bounded by the numbers of labelled documents and of features."""

    def __init__(self, toxic: np.ndarray, fold: np.ndarray, doc: np.ndarray, feature: np.ndarray, times: np.ndarray, hits: np.ndarray):
        self.toxic, self.fold, self.doc, self.feature, self.value, self.hits = toxic, fold, doc, feature, np.log1p(times), hits

    def fit(self, own: np.ndarray, chosen: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of all features (0 where not chosen), thresholds, and P(grade > 0) of every document, fitted on `own` documents."""
        used = chosen[self.feature]
        row, column, value = self.doc[used], self.feature[used], self.value[used]
        grades = np.where(self.toxic, 1 + (self.hits[:, way] >= 3) + (self.hits[:, way] >= 6), 0)
        of_own, number = own[row], np.cumsum(own) - 1
        levels = np.unique(grades[own], return_inverse=True)[1]  # grades that no document has take no threshold
        weights, thresholds = fit_ordinal(number[row[of_own]], column[of_own], value[of_own], levels, len(chosen))
        margin = np.bincount(row, value * weights[column], len(self.toxic))
        return weights, thresholds, 1 - Model(NO_WORDS, weights, thresholds).probabilities(margin)[:, 0]


def significance(n: np.ndarray, bad: np.ndarray, share: float) -> np.ndarray:
    """Standard deviations between a feature's number of toxic documents and what the base rate would give."""
    return (bad - share * n) / np.sqrt(np.maximum(share * (1 - share) * n, 1e-12))


def learnt_cut(p: np.ndarray, toxic: np.ndarray, most_false: float) -> tuple[float, float, float]:
    """The cut, and the shares of toxic documents at or above it and of clean ones below it."""
    order = np.argsort(-p, kind="stable")
    last = np.append(np.diff(p[order]) != 0, True)  # of equal scores
    values, caught, false = p[order][last], (np.cumsum(toxic[order]) / toxic.sum())[last], (np.cumsum(~toxic[order]) / (~toxic).sum())[last]
    allowed = np.flatnonzero(false <= most_false)
    if not len(allowed):
        return 1.0, 0.0, 1.0
    best = allowed[np.argmax(caught[allowed])]  # the first, so the highest
    lower = values[best + 1] if best + 1 < len(values) else 0.0
    return float((values[best] + lower) / 2), float(caught[best]), float(1 - false[best])


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = 20_000, features: int = 4096, least_docs: int = 3, z: float = 3.0, most_false: float = 0.005, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from at most `rows` labelled documents and the `features` most significant features in `least_docs` of them, from `z` on."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), (F.col(label).cast("int") > 0).cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # broadcast: at most `rows` pairs of numbers; of an id's rows the smallest text, so that repeated rows don't grow the sample
    taught = own.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    taught = materialise(taught.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    known_docs = taught.select("doc_id", "toxic", "fold").orderBy("doc_id").toArrow()  # at most `rows`
    toxic, fold = known_docs.column("toxic").to_numpy() > 0, known_docs.column("fold").to_numpy()
    if not toxic.any() or toxic.all():
        discard(taught)
        return NOTHING
    docs_in, bad_in = (np.bincount(fold, x, FOLDS).astype(np.int64) for x in (np.ones(len(toxic)), toxic))

    # a feature's documents without each fold in turn, and (last) of all folds
    without = [*range(FOLDS), None]
    totals = [(int(docs_in.sum() - (0 if i is None else docs_in[i])), int(bad_in.sum() - (0 if i is None else bad_in[i]))) for i in without]
    counts = taught.select("text", "toxic", "fold").mapInArrow(counted_features, "word long, fold int, n long, bad long").groupBy("word")
    counts = counts.agg(*(F.coalesce(F.sum(F.when(F.lit(True) if i is None else F.col("fold") != i, F.col(c))), F.lit(0)).alias(f"{c}{j}") for j, i in enumerate(without) for c in ("n", "bad")))
    shares = [b / n if n else 0.0 for n, b in totals]
    # of every way of choosing the most significant features: never more than `features` rows of each reach the driver
    known = materialise(counts, "feature-counts")
    best = []
    for j, share in enumerate(shares):
        if 0 < share < 1:
            mark = F.when(F.col(f"n{j}") >= least_docs, F.abs(F.col(f"bad{j}") - share * F.col(f"n{j}")) / F.sqrt(share * (1 - share) * F.col(f"n{j}")))
            best.append(known.withColumn("mark", mark).where(F.col("mark") >= z).orderBy(F.desc("mark"), "word").limit(features).drop("mark"))
    chosen = reduce(DataFrame.unionByName, best).distinct().toArrow()
    discard(known)
    words = chosen.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    n, bad = (np.stack([chosen.column(f"{c}{j}").to_numpy()[order] for j in range(len(without))]) for c in ("n", "bad"))
    marks = [np.where(n[j] >= least_docs, significance(n[j], bad[j], s), 0.0) for j, s in enumerate(shares)]
    ways = np.stack([np.abs(m) >= max(z, np.sort(np.abs(m))[-features] if len(m) > features else 0.0) for m in marks])
    found = taught.select("doc_id", "text").mapInArrow(taught_features(words, ways & (np.stack(marks) > 0)), "doc_id long, features array<int>, times array<int>, hits array<int>").orderBy("doc_id").toArrow()
    discard(taught)
    flat = [found.column(c).combine_chunks() for c in ("features", "times", "hits")]
    flat = [pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in flat]
    sizes = np.diff(flat[0].offsets.to_numpy())
    labelled = Labelled(toxic, fold, np.repeat(np.arange(len(toxic)), sizes), *(x.flatten().to_numpy().astype(np.int64) for x in flat[:2]), flat[2].flatten().to_numpy().reshape(len(toxic), -1))

    p, judged = np.zeros(len(toxic)), np.zeros(len(toxic), bool)
    for i in range(FOLDS):
        rest = fold != i
        if toxic[rest].any() and not toxic[rest].all():
            p[~rest] = labelled.fit(rest, ways[i], i)[2][~rest]
            judged |= ~rest
    weights, thresholds, _ = labelled.fit(np.ones(len(toxic), bool), ways[-1], FOLDS)
    if not (judged & toxic).any() or not (judged & ~toxic).any():
        return Model(words, weights, thresholds)
    return Model(words, weights, thresholds, *learnt_cut(p[judged], toxic[judged], most_false))


def margins(model: Model, column: pa.Array) -> np.ndarray:
    """w . x of each text of a batch."""
    data, offsets = buffers(column)
    out = [np.zeros(0)]
    for a, b in groups_of(offsets, 1 << 22):
        doc, at, _ = found_features(model.words, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        size = max(1, len(model.words))
        pairs, times = np.unique(doc * size + at, return_counts=True)
        out.append(np.bincount(pairs // size, np.log1p(times) * model.weights[pairs % size], b - a) if len(pairs) else np.zeros(b - a))
    return np.concatenate(out)


def scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probabilities(margins(model, batch.column(1)))
            columns = [batch.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1), pa.int32()), pa.array(1 - p[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "grade", "p_toxic"])

    return run


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity (the expected grade), grade (the likeliest), p_toxic (of any grade above 0), toxic (p_toxic reaches the model's cut)."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(scored(model), "doc_id long, severity double, grade int, p_toxic double").withColumn("toxic", F.col("p_toxic") >= F.lit(model.cut))


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs without those that score() calls toxic; all columns stay as they are, whatever their names. Null and empty texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probabilities(margins(model, batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())))
            yield batch.filter(pa.array(1 - p[:, 0] < model.cut))

    return docs.mapInArrow(run, docs.schema)
