"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by hashes of deletions.

A word's deletions are hashed without being written out: a polynomial hash of what lies before a letter and one of what lies
behind it give the hash of the word without that letter, for all words of one length at once. Keys are dealt into buckets by their
highest bits (a radix partition) and sorted there. Only keys that two different words share go on; they are joined with their words,
and the rest of each word without its letter is compared as a string, so that a collision of hashes links nothing.

Two words are near if they leave the same rest after deleting a letter at the same place (replaced), or if one is what the other
leaves (inserted, deleted). Deleting any letter of a run of equal ones leaves the same rest, so a word gives one key for each run,
with the run's first and last place. Of each rest the words are counted and their best is taken; pairs are never written: a rest
has at most (length + 1) times as many words as the alphabet has letters.

Defined results: null and empty texts have no words, a null id counts as an empty one; very long texts and words are
taken whole; repeated rows count as rows; of near words that occur equally often the smallest in code-point order is the form; an empty
table gives no rows; other columns are kept out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, discard, groups_of, materialise, mix, tidy_shuffles
from .words import strings, words_of

BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), 0xC3]] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _crc_table()


def letters(data: np.ndarray) -> np.ndarray:
    """A-Z, a-z and U+00C0 to U+00FF, which in UTF-8 are C3 and the byte behind it."""
    inside = _LETTERS[data]
    inside[1:] |= data[:-1] == 0xC3
    return inside


def crc_on(state: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """crc32 of each span's bytes behind a text whose crc32 is given, position by position over all spans."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    longer = len(sizes) - np.cumsum(np.bincount(np.minimum(sizes, 65), minlength=66))
    at, c = offsets[:-1][order], ~state[order].astype(np.uint32)
    for k in range(64):
        if not (m := longer[k]):
            break
        c[:m] = CRC[(c[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
    out = np.empty(len(sizes), np.uint32)
    out[order] = ~c
    for i in np.flatnonzero(sizes > 64):
        out[i] = zlib.crc32(data[offsets[i] : offsets[i + 1]].tobytes(), int(state[i]))
    return out


def thinned(prefix: np.ndarray, data: np.ndarray, offsets: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """The words, those whose crc32 `every` divides without the letter that it names."""
    h = crc_on(prefix, data, offsets).astype(np.int64)
    some = np.flatnonzero(h % every == 0)
    first = np.concatenate([(data & 0xC0) != 0x80, [True]])  # a letter's first byte
    letter = np.cumsum(first) - 1  # the letter that each byte belongs to
    begins = np.flatnonzero(first)
    n = letter[offsets[1:]] - letter[offsets[:-1]]
    gone = letter[offsets[some]] + h[some] % n[some]
    keep = np.ones(len(data), bool)
    keep[begins[gone]] = False
    two = begins[gone + 1] - begins[gone] == 2
    keep[begins[gone[two]] + 1] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def counted(every: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in groups_of(offsets, 1 << 23):
                prefix = np.array([zlib.crc32(b"%s:" % ("" if i is None else str(i)).encode()) for i in ids[a:b]], np.uint32)
                parts = []
                for doc, own, at in words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], letters):
                    words = strings(*thinned(prefix[doc], own, at, every))
                    parts.append(words.filter(pc.greater_equal(pc.utf8_length(words), least)))
                if parts:
                    found = pc.value_counts(pa.chunked_array(parts, pa.large_string()))
                    yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])

    return run


def words(docs: DataFrame, *, every: int = 97, least_length: int = 5, least: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n, how often it occurs, of all words that are long and frequent enough."""
    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = own.mapInArrow(counted(every, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least)


def deletions(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length (rows of code points): the hash without each letter, and the whole word's."""
    m, n = codes.shape
    with np.errstate(over="ignore"):
        c = mix(codes.astype(np.uint64), 41)
        power = np.ones(n + 1, np.uint64)
        for i in range(n):
            power[i + 1] = power[i] * BASE
        before, behind = np.zeros((n + 1, m), np.uint64), np.zeros((n + 1, m), np.uint64)
        for i in range(n):
            before[i + 1] = before[i] * BASE + c[:, i]
        for i in range(n - 1, -1, -1):
            behind[i] = behind[i + 1] + c[:, i] * power[n - 1 - i]
        without = before[:-1] * power[n - 1 - np.arange(n)][:, None] + behind[1:]
        return mix(without.T, n - 1), mix(before[n], n)


def keyed(bits: int):
    """A row for each deletion that leaves another rest: key, word, first and last place; and one for the word itself, with place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0).to_numpy(), batch.column(1)
            lengths = pc.utf8_length(text).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                of_length = np.flatnonzero(lengths == n)
                step = max(1, (1 << 20) // int(n))
                for a in range(0, len(of_length), step):
                    some = of_length[a : a + step]
                    codes = np.frombuffer("".join(text.take(pa.array(some)).to_pylist()).encode("utf-32-le"), np.uint32).reshape(len(some), n)
                    without, whole = deletions(codes)
                    new = np.ones(codes.shape, bool)
                    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
                    row, first = np.nonzero(new)
                    last = np.append(first[1:] - 1, n - 1)
                    last[last < first] = n - 1  # the last run of a word
                    key = np.concatenate([without[row, first], whole])
                    place = [np.concatenate([x, np.full(len(some), -1)]).astype(np.int32) for x in (first, last)]
                    word = np.concatenate([ids[some][row], ids[some]])
                    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, key.view(np.int64), word, *place)], names=["bucket", "key", "id", "first", "last"])

    return run


KEYS = "bucket long, key long, id long, first int, last int"


def shared(rows: pa.Table) -> pa.Table:
    """The rows of keys that several words have: the bucket is sorted by key."""
    key, word = rows.column("key").to_numpy(), rows.column("id").to_numpy()
    order = np.argsort(key, kind="stable")
    key, word = key[order], word[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(word, starts) != np.maximum.reduceat(word, starts) if len(key) else np.zeros(0, bool)
    return rows.take(pa.array(order[np.repeat(several, np.diff(np.append(starts, len(key))))]))


def best_others(group: np.ndarray, word: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of other rows of its group and the best-ranked one's row, -1 if there is none."""
    order = np.lexsort((rank, group))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0])) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    top = np.repeat(order[starts], sizes)
    second = np.repeat(np.where(sizes > 1, order[np.minimum(starts + 1, len(group) - 1)], -1), sizes)
    n, best = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    n[order], best[order] = np.repeat(sizes - 1, sizes), np.where(top == order, second, top)
    return n, best


def near(rows: pa.Table) -> pa.Table:
    """id, number of near words and the best of them by the rests of one bucket; rests are compared as strings."""
    id_, n, first, last = (rows.column(c).to_numpy() for c in ("id", "n", "first", "last"))
    text = rows.column("word").to_pylist()
    rest = pd.factorize(np.array([w if p < 0 else w[:p] + w[p + 1 :] for w, p in zip(text, first.tolist(), strict=True)], object))[0] if len(text) else np.zeros(0, np.int64)
    rank = np.empty(len(text), np.int64)  # by n downward, then by code points; equal words rank equal
    rank[np.lexsort((pd.factorize(np.array(text, object), sort=True)[0] if text else rest, -n))] = np.arange(len(text))
    out = []

    def put(at: np.ndarray, count: np.ndarray, best: np.ndarray) -> None:
        out.append((id_[at], count, n[best], [text[i] for i in best.tolist()]))

    # replaced: the same rest after deleting at the same place; runs are opened only where several words leave the rest
    cut = np.flatnonzero(first >= 0)
    several = pd.Series(id_[cut]).groupby(rest[cut]).transform("nunique").to_numpy() > 1 if len(cut) else np.zeros(0, bool)
    cut = cut[several]
    times = last[cut] - first[cut] + 1
    row = np.repeat(cut, times)
    place = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    count, best = best_others(np.unique(np.stack([rest[row], place]), axis=1, return_inverse=True)[1].ravel() if len(row) else row, row, rank[row])
    hit = np.flatnonzero(count > 0)
    put(row[hit], count[hit], row[best[hit]])
    # inserted and deleted: a rest that is itself a word; every word leaves it once, as runs give one row
    whole = np.flatnonzero(first < 0)
    of = pd.Series(whole, index=rest[whole])
    cut = np.flatnonzero((first >= 0) & np.isin(rest, rest[whole]))
    base = of.reindex(rest[cut]).to_numpy().astype(np.int64) if len(cut) else cut
    put(cut, np.ones(len(cut), np.int64), base)
    order = np.lexsort((rank[cut], base))
    shorter, starts, sizes = np.unique(base[order], return_index=True, return_counts=True)
    put(shorter, sizes, cut[order][starts])
    columns = [np.concatenate([x[i] for x in out]) for i in range(3)] + [[w for x in out for w in x[3]]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "n_near", "form_n", "form"])


def variants(docs: DataFrame, *, every: int = 97, least_length: int = 5, least: int = 3, bucket_keys: int = 1 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of all words."""
    with tidy_shuffles(docs.sparkSession):
        counts = words(docs, every=every, least_length=least_length, least=least, doc_id=doc_id, text=text)
        known = materialise(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
        keys = known.agg(F.sum(F.length("word") + 1)).first()[0] or 0
        bits = (keys // bucket_keys).bit_length()
        rows = known.select("id", "word").mapInArrow(keyed(bits), KEYS).groupBy("bucket").applyInArrow(shared, KEYS)
        pairs = rows.join(known, "id").groupBy("bucket").applyInArrow(near, "id long, n_near long, form_n long, form string")
        best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
        found = pairs.groupBy("id").agg(F.sum("n_near").alias("n_near"), best)
        formed = F.col("best.form").isNotNull() & (-F.col("best.less") >= 2 * F.col("n"))
        out = known.join(found, "id", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("best.form")).alias("form"),
            F.when(formed, -F.col("best.less")).alias("form_n"),
        )
        out = materialise(out, "forms")
        discard(known)
        roots = roots_of(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots_of(links: DataFrame) -> DataFrame:
    """word and root, the end of each word's chain, by pointer jumping. n at least doubles with each link, so few rounds end it."""
    links = materialise(links, "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        joined = materialise(joined, "links")
        discard(links)
        links = joined.select("word", "root")
        links._scratch = joined._scratch
        if not joined.where("moved").limit(1).count():
            return links
