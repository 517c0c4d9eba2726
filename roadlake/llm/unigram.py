"""Unigram encoding: Viterbi over a double-array trie of pieces with log scores, byte fallback, and decoding.

Text is a row of segments: white-space marks, then what follows up to the next mark. No piece has a mark behind
another character, so the best path of a text is made of its segments' best paths, and segments repeat: each new one is
encoded once, many at a time, as array operations over their characters. The trie's two arrays (base and check) are
walked for all segments side by side, position by position, or segment by segment where there are few.

An unknown character costs the least piece score less 10 and becomes its UTF-8 bytes as byte pieces. Ties go to the
piece that begins first. Decoding joins pieces, turns byte pieces back into text and marks into spaces.

Defined results: null and empty texts have no ids; repeated rows stay rows; an empty table gives no rows; other columns
are ignored.
A very long text is encoded whole; one without any blank is walked character by character, in time that grows with its length.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, groups_of
from .token_cache import WordIds

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Below this number of segments a plain walk costs less than array calls for each character.
FEW = 200


class DoubleArray:
    """A trie in two arrays: the child of state s by code c is base[s] + c if check[base[s] + c] == s."""

    def __init__(self, words: list[list[int]]):
        children: dict[int, dict[int, int]] = {0: {}}
        last: dict[int, int] = {}
        for number, word in enumerate(words):
            s = 0
            for c in word:
                s = children[s].setdefault(c, len(children))
                children.setdefault(s, {})
            last[s] = number
        most = max((max(w) for w in words if w), default=0) + 1
        place, free, start = {0: 0}, bytearray(b"\1") * (2 * len(children) + 2 * most), 1
        free[0], first = 0, most + 1  # the first free cell that every code can reach
        for s in sorted(children, key=lambda s: -len(children[s])):
            if not children[s]:
                continue
            codes = sorted(children[s])
            at, tries = (first - codes[0] if len(codes) == 1 else start), 0
            while True:
                while at + codes[-1] >= len(free):
                    free += bytearray(b"\1") * len(free)
                if all(free[at + c] for c in codes):
                    break
                at, tries = at + 1, tries + 1
            if len(codes) > 1 and tries > 64:  # crowded: later ones begin further on
                start = at
            for c in codes:
                free[at + c] = 0
                place[children[s][c]] = at + c
            while first < len(free) and not free[first]:
                first += 1
            children[s][-1] = at
        size = len(free) + most
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for s, own in children.items():
            if -1 in own:
                at = own.pop(-1)
                self.base[place[s]] = at
                for c in own:
                    self.check[at + c] = place[s]
        for s, number in last.items():
            self.value[place[s]] = number

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The children by these codes, -1 where there are none."""
        to = self.base[state] + code
        return np.where((code > 0) & (self.check[to] == state), to, -1)


class Unigram:
    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: dict[int, int], unknown: int):
        """pieces: text, log score and id of each ordinary piece; byte_ids: the id of each byte's piece, if there are such."""
        if any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
            raise ValueError("a piece has a white-space mark behind another character")
        letters = sorted({c for p, _, _ in pieces for c in p})
        self.code = np.zeros(max((ord(c) for c in letters), default=0) + 2, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.trie = DoubleArray([[int(self.code[ord(c)]) for c in p] for p, _, _ in pieces])
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        self.ids = np.array([i for _, _, i in pieces], np.int64)
        self.longest = max((len(p) for p, _, _ in pieces), default=0)
        self.unknown_score = float(self.score.min(initial=0)) - UNKNOWN_PENALTY
        self.byte_ids, self.unknown = byte_ids, unknown
        self.text = {i: p for p, _, i in pieces}
        self.byte_of = {i: b for b, i in byte_ids.items()}

    @classmethod
    @functools.lru_cache(maxsize=2)
    def from_model(cls, path: str) -> Unigram:
        """The ordinary pieces and scores of a sentencepiece model; a piece's score is taken as its log score."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
        return cls([(m.id_to_piece(i), m.get_score(i), i) for i in n if not special(i)], {int(m.id_to_piece(i)[3:5], 16): i for i in n if m.is_byte(i)}, m.unk_id())

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """The best path of each segment. Segments of like length go together, so padding stays small."""
        out: list[list[int]] = [[]] * len(segments)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        a = 0
        while a < len(order):
            b, most = a, 0
            while b < len(order) and b - a < 20_000 and (most := len(segments[order[b]])) * (b - a + 1) <= 400_000 or b == a:
                b += 1
            for i, ids in zip(order[a:b], self._viterbi([segments[i] for i in order[a:b]]), strict=True):
                out[i] = ids
            a = b
        return out

    def _viterbi(self, segments: list[str]) -> list[list[int]]:
        """Many segments side by side; a few are walked one by one, as array calls for each character would cost more than their work."""
        m, n = len(segments), np.array([len(s) for s in segments])
        if m < FEW:
            return [self._path(s, *self._walk(s)) for s in segments]
        width = int(n.max(initial=0))
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        codes = np.zeros((m, width + 1), np.int32)
        codes[np.arange(width + 1)[None] < n[:, None]] = self.code[np.minimum(points, len(self.code) - 1)]
        best = np.full((m, width + 1), -np.inf)
        best[:, 0] = 0
        from_, piece = np.zeros((m, width + 1), np.int32), np.full((m, width + 1), -1, np.int32)
        for a in range(width):
            rows = np.flatnonzero(n > a)
            start = best[rows, a]
            # one unknown character unless a piece is this long
            state, own, single = np.zeros(len(rows), np.int32), np.arange(len(rows)), np.zeros(len(rows), bool)
            for d in range(self.longest):
                state = self.trie.step(state, codes[rows[own], a + d]) if a + d < width else np.full(len(own), -1, np.int32)
                alive = state >= 0
                state, own = state[alive], own[alive]
                if not len(own):
                    break
                v = self.trie.value[state]
                hit = v >= 0
                r, s = rows[own[hit]], start[own[hit]] + self.score[v[hit]]
                if d == 0:
                    single[own[hit]] = True
                better = s > best[r, a + d + 1]
                r = r[better]
                best[r, a + d + 1], from_[r, a + d + 1], piece[r, a + d + 1] = s[better], a, v[hit][better]
            r, s = rows[~single], start[~single] + self.unknown_score
            better = s > best[r, a + 1]
            r = r[better]
            best[r, a + 1], from_[r, a + 1], piece[r, a + 1] = s[better], a, -1
        return [self._path(s, f, p) for s, f, p in zip(segments, from_.tolist(), piece.tolist(), strict=True)]

    @functools.cached_property
    def _lists(self) -> tuple[list, ...]:
        return tuple(x.tolist() for x in (self.code, self.trie.base, self.trie.check, self.trie.value, self.score))

    def _walk(self, text: str) -> tuple[list[int], list[int]]:
        """(start, number) of the piece that ends the best path to each position, -1 for an unknown character."""
        code, base, check, value, score = self._lists
        codes = [code[c] if (c := ord(x)) < len(code) else 0 for x in text]
        n, unknown = len(text), self.unknown_score
        best, from_, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for a in range(n):
            start, state, at, single = best[a], 0, a, False
            while at < n and codes[at] and check[to := base[state] + codes[at]] == state:
                state, at = to, at + 1
                v = value[state]
                if v >= 0:
                    single = single or at == a + 1
                    if (s := start + score[v]) > best[at]:
                        best[at], from_[at], piece[at] = s, a, v
            if not single and (s := start + unknown) > best[a + 1]:
                best[a + 1], from_[a + 1], piece[a + 1] = s, a, -1
        return from_, piece

    def _path(self, text: str, from_: list[int], piece: list[int]) -> list[int]:
        """The ids of the best path, read from its end."""
        at, ids = len(text), []
        while at:
            p, a = piece[at], from_[at]
            if p >= 0:
                ids.append(int(self.ids[p]))
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(text[a:at].encode())]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at = a
        return ids[::-1]

    @staticmethod
    def segments(text: str) -> list[str]:
        return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.encode_segments(self.segments(text)) for i in s]

    def decode(self, ids: list[int]) -> str:
        out: list[bytes] = []
        for i in ids:
            out.append(bytes([self.byte_of[i]]) if i in self.byte_of else self.text.get(i, " ⁇ ").replace(MARK, " ").encode())
        return b"".join(out).decode("utf-8", "replace").removeprefix(" ")


SEGMENT = re.compile(rb" *[^ ]+| +")


def encoder(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.from_model(path)
        cache = WordIds(lambda new: model.encode_segments([s.decode().replace(" ", MARK) for s in new]))
        score = np.full(int(max([*model.ids, *model.byte_ids.values()])) + 1, np.nan)
        score[model.ids] = model.score
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            doc_ids = batch.column(0)
            for a, b in groups_of(offsets, 1 << 20):
                raw, at = data[offsets[a] : offsets[b]].tobytes(), offsets[a : b + 1] - offsets[a]
                texts = [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                ids, ends = cache.ids([SEGMENT.findall(b" " + t) if t else [] for t in texts])
                byte_pieces = np.concatenate([[0], np.cumsum(np.isnan(score[ids]))])
                total = np.concatenate([[0], np.cumsum(np.nan_to_num(score[ids]))])
                raw_ids = ids.astype("<u4").tobytes()
                same = [model.decode(ids[i:j].tolist()) == t.decode() for t, i, j in zip(texts, ends[:-1], ends[1:], strict=True)]
                columns = [
                    doc_ids.slice(a, b - a),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array(byte_pieces[ends[1:]] - byte_pieces[ends[:-1]], pa.int64()),
                    pa.array(total[ends[1:]] - total[ends[:-1]], pa.float64()),
                    pa.array([zlib.crc32(raw_ids[4 * i : 4 * j]) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
                    pa.array(same, pa.bool_()),
                ]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "n_byte_pieces", "piece_score", "ids_crc32", "decodes", "ids"][: len(columns)])

    return run


def encode(docs: DataFrame, path: str, *, keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, piece_score (the pieces' log scores added up), ids_crc32, decodes (whether the ids give the text back), ids."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(encoder(path, keep_ids), "doc_id long, n_pieces long, n_byte_pieces long, piece_score double, ids_crc32 long, decodes boolean" + ", ids array<int>" * keep_ids)


def decode(encoded: DataFrame, path: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.from_model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else model.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
