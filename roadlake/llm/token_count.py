"""Token counts of whole texts as the sentencepiece library gives them, huge texts chunk by chunk.

A boundary between two characters x and y is stable if no piece of the vocabulary has x directly before y: merges
make pieces of the vocabulary only, so none ever spans such a boundary, and what stands before and after it is encoded
independently. A huge text is encoded in overlapping chunks with offsets; two neighbours are spliced at a boundary in
their overlap at which both encodings have a token end and which is stable by that proof. Where the overlap has none
it is doubled, at last up to the end of the text, so that the count is the library's in every case.

Defined results: null and empty texts have 0 tokens and 0 bytes; repeated rows stay rows; an empty table gives none;
other columns are kept out of the result, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, groups_of

MARK = "▁"


class Counter:
    def __init__(self, path: str, chunk: int = 1 << 16, overlap: int = 256):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.feed = len(self.model.encode("\n"))
        assert not any("\n" in p for p in pieces), "this vocabulary has pieces with line feeds"
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def counts(self, texts: list[str]) -> list[int]:
        short = [t if len(t) <= self.chunk else "" for t in texts]
        got = [len(x) for x in self.model.encode(short, num_threads=1)]
        return [n if len(t) <= self.chunk else len(self.encode_long(t)) for n, t in zip(got, texts, strict=True)]

    def spans(self, text: str, first: bool) -> list[tuple[int, int]]:
        """(end in characters, id) of each token. Behind the first chunk the library's leading mark is kept off by a line feed, which no piece joins to anything."""
        text = text if first else f"\n{text}"
        done = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
        out = [(int(done[p.end]), p.id) for p in self.model.encode(text, return_type="proto").pieces]
        return out if first else [(end - 1, i) for end, i in out[self.feed :]]

    def stable(self, text: str, at: int) -> bool:
        x, y = (MARK if c == " " else c for c in text[at - 1 : at + 1])
        return x + y not in self.joined

    def encode_long(self, text: str) -> list[int]:
        """The ids of a text of any length, by overlapping chunks."""
        ids: list[int] = []
        a, n = 0, len(text)
        b = min(n, a + self.chunk)
        tokens = self.spans(text[a:b], True)
        done = -1  # ids of tokens that end up to here are already in `ids`; the first ones can end at 0
        while b < n:
            wide, cut = self.overlap, None
            while cut is None:
                start = max(done, 0, b - wide)
                end = min(n, start + max(self.chunk, 2 * wide))
                after = self.spans(text[start:end], start == 0)
                ends = {start + e for e, _ in after} | {start}
                both = [a + e for e, _ in tokens if start < a + e < b and a + e in ends and self.stable(text, a + e)]
                if both:
                    cut = both[-1]
                elif start == max(done, 0):  # no boundary can be proved in all that is left: the chunk itself grows
                    self.widened += 1
                    b = min(n, b + max(self.chunk, b - a))
                    tokens = self.spans(text[a:b], a == 0)
                    wide = self.overlap
                    if b == n:
                        break
                else:
                    self.widened += 1
                    wide *= 2
            if cut is None:
                break
            ids += [i for e, i in tokens if done < a + e <= cut]
            a, b, tokens, done = start, end, after, cut
        return ids + [i for e, i in tokens if a + e > done]


def counted(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, chunk, overlap)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            sizes, n = np.diff(offsets), []
            for a, b in groups_of(offsets, 1 << 21):
                raw = data[offsets[a] : offsets[b]].tobytes()
                at = offsets[a : b + 1] - offsets[a]
                n += counter.counts([raw[i:j].decode() for i, j in zip(at[:-1], at[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, *, limit: int = 4096, chunk: int = 1 << 16, overlap: int = 256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document. A map over the scan: no shuffle, memory of one batch and one chunk."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = own.mapInArrow(counted(path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
