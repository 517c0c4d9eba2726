"""Personal data: exact base patterns, and a semi-Markov conditional random field over whole candidate spans.

Words with a digit or an @ are found over whole batches of bytes; texts without any are done. In the others the base
patterns run as linear scans, and runs of such words become regions. In a region every span that could be an entity (valid
for its kind: address parts, digit counts, check digit) is a candidate segment with features of the whole span; all
other characters are single segments. Dynamic programming over segment ends picks the likeliest segmentation, so
boundaries and kinds are chosen together; a segment has at most `LONGEST` characters. The field is trained here, by maximum
likelihood on generated sentences with a fixed seed. The result is the base spans and the field's spans that overlap none.

What the field adds: phone numbers and cards that base drops because they stand next to further digits, and numbers
in national form.

Defined results: null and empty texts have no spans; offsets count code points, ends are exclusive; repeated rows stay rows;
an empty table gives no rows; other columns are ignored by find() and kept by redact(), whatever their names.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, groups_of, word_spans

KINDS = ("email", "ip", "card", "phone")
LONGEST = 120
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]++")
HIT = np.zeros(256, bool)
HIT[[*range(48, 58), 64]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping: a match starts where the run of local characters before its @ does, behind the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", a, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The base spans of a text, by start, then kind in the order of KINDS."""
    out = list(emails(text)) if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return sorted(out, key=in_order)


def in_order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


# ---- the field


def candidates(text: str) -> list[Span]:
    """Every span of a region that is valid for a kind. Each start has a bounded number of ends."""
    out, n = list(emails(text)), len(text)
    runs = [m.span() for m in _DIGITS.finditer(text)]
    ends = {a: b for a, b in runs}
    for k, (a, b) in enumerate(runs):
        # cards: runs joined by single blanks or hyphens
        digits, at = "", a
        for x, y in runs[k : k + 19]:
            if x > at and (x - at > 1 or text[at] not in " -") or len(digits) + y - x > 19:
                break
            digits, at = digits + text[x:y], y
            if len(digits) >= 12 and luhn(digits):
                out.append(("card", a, y))
        # phones: from a plus, a bracket or the number itself
        start = a
        if start and text[start - 1] == "(":
            start -= 1
        if start and text[start - 1] == "+":
            start -= 1
        digits, at = 0, start
        for x, y in runs[k : k + 15]:
            if x > a and (x - at > 4 or any(c not in " ().-" for c in text[at:x])) or digits + y - x > 15:
                break
            digits, at = digits + y - x, y
            if digits >= 9 and (start < a or y - a > digits):
                out.append(("phone", start, y))
        # addresses
        parts, at = 1, b
        while parts < 4 and at + 1 < n and text[at] == "." and at + 1 in ends:
            at, parts = ends[at + 1], parts + 1
        if parts == 4 and all(len(p) < 4 and int(p) < 256 for p in text[a:at].split(".")):
            out.append(("ip", a, at))
    return [s for s in out if s[2] - s[1] <= LONGEST]


FEATURES = ("bias", "length", "digits", "plus", "bracket", "blanks", "hyphens", "dots", "plain run", "groups", "even groups", "digit before", "digit after", "letter before", "letter after", "dot beside", "blank and digit before", "blank and digit after", "short groups")


def features(text: str, kind: str, a: int, b: int) -> np.ndarray:
    """Numbers that describe the whole span and what stands beside it, in the block of its kind."""
    span, before, after = text[a:b], text[max(0, a - 2) : a], text[b : b + 2]
    groups = [m.end() - m.start() for m in _DIGITS.finditer(span)]
    x = np.array([
        1, len(span) / 20, sum(groups) / 15, span[0] == "+", "(" in span, span.count(" ") / 4, span.count("-") / 4, span.count(".") / 4,
        len(groups) == 1, len(groups) / 5, len(groups) > 1 and len(set(groups[:-1])) == 1, before[-1:].isdigit(), after[:1].isdigit(),
        before[-1:].isalpha(), after[:1].isalpha(), before[-1:] in {".", ","} or len(after) > 1 and after[0] == "." and after[1].isdigit(),
        len(before) > 1 and before[1] in " -" and before[0].isdigit(), len(after) > 1 and after[0] in " -" and after[1].isdigit(), sum(g < 3 for g in groups) / 4,
    ], float)
    out = np.zeros((len(KINDS), len(FEATURES)))
    out[KINDS.index(kind)] = x
    return out.ravel()


def by_end(spans: list[Span]) -> list[int]:
    return sorted(range(len(spans)), key=lambda i: (spans[i][2], spans[i][1], spans[i][0]))


def decode(spans: list[Span], scores: np.ndarray) -> list[int]:
    """The segmentation with the greatest score: characters outside entities score 0. Only ends of segments are states."""
    best, back = {0: 0.0}, {}
    points, values = [0], [0.0]
    for i in by_end(spans):
        _, a, b = spans[i]
        k = int(np.searchsorted(points, a, "right")) - 1
        s = values[k] + scores[i]
        if b == points[-1]:
            if s > values[-1]:
                values[-1], back[b] = s, (i, points[k])
        else:
            keep = values[-1]
            points.append(b)
            values.append(max(s, keep))
            back[b] = (i, points[k]) if s > keep else (None, points[-2])
        best[b] = values[-1]
    out, at = [], points[-1]
    while at:
        i, at = back[at]
        if i is not None:
            out.append(i)
    return out[::-1]


def marginals(n: int, spans: list[Span], scores: np.ndarray) -> tuple[float, np.ndarray]:
    """log Z over all segmentations, and each candidate's probability, by the forward and backward sums."""
    forward, starts, ends = np.full(n + 1, -np.inf), {}, {}
    for i, (_, a, b) in enumerate(spans):
        starts.setdefault(a, []).append(i)
        ends.setdefault(b, []).append(i)
    forward[0] = 0
    for p in range(1, n + 1):
        forward[p] = np.logaddexp.reduce([forward[p - 1], *(forward[spans[i][1]] + scores[i] for i in ends.get(p, ()))])
    backward = np.zeros(n + 1)
    for p in range(n - 1, -1, -1):
        backward[p] = np.logaddexp.reduce([backward[p + 1], *(backward[spans[i][2]] + scores[i] for i in starts.get(p, ()))])
    return forward[n], np.exp([forward[a] + scores[i] + backward[b] - forward[n] for i, (_, a, b) in enumerate(spans)])


def sentences(n: int, seed: int) -> Iterator[tuple[str, set[Span]]]:
    """Generated sentences with the spans that they were made of."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = rng.choice("3456") + digits(rng.choice((11, 13, 14, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        gap = rng.choice(("", "", " ", "-"))
        return gap.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"+{rng.randint(2, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"+1{a}{b}{c}", f"{a}-{b}-{c}", f"+{rng.randint(20, 99)}.{a}.{b}.{c}"))

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def email() -> str:
        name = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
        return f"{name}.{digits(2)}@{rng.choice(('mail', 'post'))}{rng.randint(1, 9)}.example.com"

    noise = (lambda: digits(rng.randint(1, 11)), lambda: f"{rng.randint(1900, 2100)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 9)}.", lambda: f"{digits(2)}.{digits(2)}.{digits(2)}", lambda: digits(rng.choice((12, 13, 16, 20, 24))), lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: " ".join(digits(rng.choice((1, 2, 3))) for _ in range(rng.randint(4, 9))), lambda: f"{digits(5)}-{digits(4)}")
    for _ in range(n):
        text, truth = "", set()
        for _ in range(rng.randint(1, 4)):
            text += rng.choice(("", "", "tel ", "no. ", "x ", "(see "))
            kind = rng.choice((*KINDS, "card", "phone", "noise", "noise", "noise"))
            if kind == "noise":
                text += rng.choice(noise)()
            else:
                made = {"email": email, "ip": ip, "card": card, "phone": phone}[kind]()
                truth.add((kind, len(text), len(text) + len(made)))
                text += made
            text += rng.choice((" ", " ", " ", " and ", ". ", ", ", ") "))
        yield text, truth


@functools.lru_cache(maxsize=1)
def trained(n: int = 500, seed: int = 11, steps: int = 60, ridge: float = 0.02) -> np.ndarray:
    """The field's weights: maximum likelihood with a ridge on n generated sentences, by gradient steps with momentum per weight."""
    data = []
    for text, truth in sentences(n, seed):
        spans = candidates(text)
        if spans:
            data.append((len(text), spans, np.array([features(text, *s) for s in spans]), np.array([s in truth for s in spans], float)))
    w = np.zeros(len(KINDS) * len(FEATURES))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = -ridge * w
        for length, spans, x, y in data:
            g += (y - marginals(length, spans, x @ w)[1]) @ x / len(data)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def field_spans(text: str, weights: np.ndarray) -> list[Span]:
    spans = candidates(text)
    if not spans:
        return []
    return [spans[i] for i in decode(spans, np.array([features(text, *s) @ weights for s in spans]))]


def regions(text: str, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of words with digits that at most three characters part, given as code points."""
    a, b = hits[0]
    for x, y in hits[1:]:
        if x - b > 3:
            yield a, b
            a = x
        b = y
    yield a, b


def all_spans(text: str, hits: list[tuple[int, int]], weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """The base spans; these and the field's spans that overlap none of them."""
    base = base_spans(text)
    added = []
    for a, b in regions(text, hits):
        a, b = max(0, a - 2), min(len(text), b + 2)
        added += [(k, a + x, a + y) for k, x, y in field_spans(text[a:b], weights)]
    if not added:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    free = [s for s in added if not (k := int(np.searchsorted(starts, s[2]))) or reach[k - 1] <= s[1]]
    return base, sorted({*base, *free}, key=in_order)


def texts_with_hits(column: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
    """(row, text, words with a digit or an @ as code points) of the texts of a batch that have such."""
    data, offsets = buffers(column)
    for a, b in groups_of(offsets, 1 << 22):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        hit = np.flatnonzero(HIT[part])
        if not len(hit):
            continue
        rows = np.searchsorted(at, hit, "right") - 1
        for row in np.unique(rows):
            own = part[at[row] : at[row + 1]]
            starts, ends, _ = word_spans(own, np.array([0, len(own)]))
            some = np.unique(np.searchsorted(starts, hit[rows == row] - at[row] if len(hit) < 1000 else hit[slice(*np.searchsorted(rows, [row, row + 1]))] - at[row], "right") - 1)
            points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            yield a + int(row), own.tobytes().decode(), list(zip(points[starts[some]].tolist(), points[ends[some]].tolist(), strict=True))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def finder(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            base, every = [""] * n, [""] * n
            counts = np.zeros((n, len(KINDS)), np.int64)
            for row, text, hits in texts_with_hits(batch.column(1)):
                own, spans = all_spans(text, hits, weights)
                base[row], every[row] = joined(own), joined(spans)
                for k, _, _ in own:
                    counts[row, KINDS.index(k)] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, i]) for i in range(len(KINDS))), pa.array(base, pa.string()), pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    return run


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_spans, spans (all), both as kind:start:end joined by commas. A map over the scan."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(finder(trained()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with each span replaced by its kind in brackets; n_chars, where there is such a column, counts the new text.

    Null and empty texts stay as they are, very long ones are searched whole; of overlapping spans the first names the replacement; rows and other
    columns stay, whatever their names; an empty table stays empty.
    """
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            new = {row: redacted(t, all_spans(t, hits, weights)[1]) for row, t, hits in texts_with_hits(batch.column(i))}
            if new:
                values = batch.column(i).to_pylist()
                for row, t in new.items():
                    values[row] = t
                batch = batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out
