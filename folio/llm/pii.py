"""Personal data by patterns and by a linear-chain conditional random field.

Patterns give the base spans. The field adds spans in forms that they miss: it
labels words by their shapes, those of their neighbours and a few cue words. It
is trained on a small labelled table, examples and words of sampled documents as
the patterns mark them, and decoded by Viterbi for many sequences at a time.

Words that can be labelled hold a digit, or one of ``@+([``. All others are
outside by definition, so a line falls into sequences that don't depend on one
another, and only these are decoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import arrays, sample
from folio.llm.pii_examples import EXAMPLES

# The kinds in the order in which equal starts are listed, and their limits.
KINDS = ("email", "ip", "card", "phone")
MOST_PART, CARD_DIGITS, PHONE_DIGITS = 255, (12, 19), (9, 15)

#: Labels of the field: outside, and for kinds of several words the first word and the others.
LABELS = ("", "email", "ip", "card", "card+", "phone", "phone+")
_KIND = np.array([-1, 0, 1, 2, 2, 3, 3])

#: Documents of at most so many bytes, and sequences of at most so many words, that the field is fitted on.
FIT_ROWS, FIT_BYTES, FIT_SEQUENCES, FIT_WORDS = 4000, 4 << 20, 20_000, 64

#: Words that announce personal data.
CUES = (
    "call phone tel telefon telephone mobile mobil cell fax ring dial text reach contact number rufen appelez "
    "card visa mastercard amex karte kartennummer ip host server client ping login address mail email write"
).split()

#: Bits of the table of feature weights, steps of the fit, and its penalty.
BITS, STEPS, RATE, PENALTY = 16, 120, 0.5, 0.002

_NEVER = -1e4

# base spans, each found in time linear in the text

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, place of the kind, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match has the first @ behind its local part, which begins at most where the last match ended."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(last, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Of a chain of dotted numbers every four make a match."""
    for chain in _DOTTED.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts = chain[0].split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= MOST_PART for x in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    """Whether the weighted digit sum, every second digit from the right doubled, ends in 0."""
    twice = [2 * int(x) for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _DIGITS.finditer(text):
        if len(found[0]) >= CARD_DIGITS[0]:
            digits = found[0].replace(" ", "").replace("-", "")
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PLUS.finditer(text):
        if PHONE_DIGITS[0] <= sum(c.isdigit() for c in found[0]) <= PHONE_DIGITS[1]:
            yield found.span()


def unsure(text: str) -> list[Span]:
    """Chains of more digits than a card has, in which numbers stand side by side: no pattern says what they are."""
    chains = (m for m in _DIGITS.finditer(text) if len(m[0]) > CARD_DIGITS[1] and not m[0].isdigit())
    return [(m.start(), 2, m.end()) for m in chains if sum(c.isdigit() for c in m[0]) > CARD_DIGITS[1]]


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that don't overlap, in code points, by start and kind."""
    return sorted((start, k, end) for k, find in enumerate((_emails, _addresses, _cards, _phones)) for start, end in find(text))


# features


def _classes() -> np.ndarray:
    """The class of each byte: letters and digits as one of theirs, other ASCII as itself, the rest as one."""
    out = np.arange(256, dtype=np.uint8)
    for low, high, one in (("A", "Z", "A"), ("a", "z", "a"), ("0", "9", "0")):
        out[ord(low) : ord(high) + 1] = ord(one)
    out[128:] = 127
    return out


_CLASS = _classes()
_MARK = np.isin(np.arange(256), [*range(ord("0"), ord("9") + 1), *map(ord, "@+([")])
_DIGIT, _LETTER = ord("0"), np.isin(np.arange(256), [*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)])
_SALTS = np.random.Generator(np.random.PCG64(97)).integers(1 << 62, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def _hash_words(words: list[str]) -> np.ndarray:
    data, at = arrays.text_buffers(pa.array(words))
    return arrays.span_hashes(data, at[:-1], at[1:])


_CUES = np.sort(_hash_words(CUES))


@dataclass(frozen=True)
class Shapes:
    """Of some words: hashes of the shape with runs collapsed, of the one with lengths of digit runs, counts and cues."""

    plain: np.ndarray
    sized: np.ndarray
    digits: np.ndarray
    flags: np.ndarray
    cue: np.ndarray


def _spans_of(keep: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Borders of words among the bytes that are kept."""
    return np.concatenate([[0], np.cumsum(keep)])[borders]


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Shapes:
    size = ends - starts
    borders = np.concatenate([[0], np.cumsum(size)])
    raw = data[np.repeat(starts - borders[:-1], size) + np.arange(borders[-1])]
    kind = _CLASS[raw]
    opens = np.ones(len(kind), bool)
    opens[1:] = kind[1:] != kind[:-1]
    opens[borders[:-1]] = True
    runs = np.flatnonzero(opens)
    length = np.diff(np.append(runs, len(kind)))
    at = _spans_of(opens, borders)
    collapsed = kind[runs]
    sized = np.where(collapsed == _DIGIT, 128 + np.minimum(length, 31), collapsed).astype(np.uint8)
    count = lambda of: np.diff(_spans_of(of, borders))
    digits = np.minimum(count(kind == _DIGIT), 24)
    letters = _LETTER[raw]
    own = _spans_of(letters, borders)
    names = arrays.span_hashes(raw[letters], own[:-1], own[1:])
    cue = np.searchsorted(_CUES, names)
    cue = np.where(_CUES[np.minimum(cue, len(_CUES) - 1)] == names, cue + 1, 0)
    valid = np.zeros(len(size), bool)
    for k in np.flatnonzero((digits >= CARD_DIGITS[0]) & (digits <= CARD_DIGITS[1])).tolist():
        valid[k] = luhn(bytes(raw[borders[k] : borders[k + 1]][kind[borders[k] : borders[k + 1]] == _DIGIT]).decode())
    flags = np.minimum(count(kind == ord("@")), 1) + 2 * np.minimum(count(kind == ord(".")), 4) + 10 * np.minimum(count(kind == ord(":")), 2)
    flags = flags + 30 * (count(letters) > 0) + 60 * valid + 120 * (count(kind == 127) > 0)
    return Shapes(arrays.span_hashes(collapsed, at[:-1], at[1:], lower=False), arrays.span_hashes(sized, at[:-1], at[1:], lower=False), digits, flags, cue)


@dataclass(frozen=True)
class Words:
    """Words of a chunk that can be labelled, in sequences."""

    starts: np.ndarray  # bytes
    ends: np.ndarray
    borders: np.ndarray  # of sequences among the words
    text: np.ndarray  # of each word
    features: np.ndarray  # words x templates, rows of the table of weights


def words_of(data: np.ndarray, at: np.ndarray) -> Words:
    starts, ends, first = arrays.words(data, at)
    total = np.concatenate([[0], np.cumsum(_MARK[data])])
    own = np.flatnonzero(total[ends] > total[starts])
    if not len(own):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(1, np.int64), none, np.zeros((0, 1), np.int64))
    text = np.searchsorted(first, own, side="right") - 1
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    tied = lambda a, b: (text_of(a) == text_of(b)) & (lines[ends[a]] == lines[starts[b]])
    text_of = lambda k: np.searchsorted(first, k, side="right") - 1
    opens = np.ones(len(own), bool)
    opens[1:] = (np.diff(own) > 1) | ~tied(own[:-1], own[1:])
    near = {}
    for step in (-2, -1, 1):
        k = own + step
        inside = (k >= 0) & (k < len(starts))
        k = np.where(inside, k, own)
        low, high = np.minimum(k, own), np.maximum(k, own)
        near[step] = np.where(inside & tied(low, high), k, -1)
    wanted = np.unique(np.concatenate([own, *near.values()]))
    wanted = wanted[wanted >= 0]
    found = shapes(data, starts[wanted], ends[wanted])
    place = lambda k: np.searchsorted(wanted, k)

    def value(of: np.ndarray, step: int) -> np.ndarray:
        k = near.get(step, own)
        return np.where(k >= 0, of[place(np.maximum(k, wanted[0]))].astype(np.uint64) + np.uint64(1), np.uint64(0))

    here = (found.plain, found.sized, found.digits, found.flags, found.digits * 512 + found.flags)
    columns = [value(x, 0) for x in here]
    columns += [value(x, step) for step in (-1, 1) for x in (found.sized, found.digits, found.flags)]
    columns += [value(found.cue, -1), value(found.cue, -2), np.zeros(len(own), np.uint64)]
    ids = [(arrays.mixed(x ^ _SALTS[m]) * _SALTS[m]) >> np.uint64(64 - BITS) for m, x in enumerate(columns)]
    return Words(starts[own], ends[own], np.append(np.flatnonzero(opens), len(own)), text, np.stack(ids, axis=1).astype(np.int64))


# the field


def _steps(borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from long to short, and how many have a word at each step."""
    size = np.diff(borders)
    order = np.argsort(-size, kind="stable")
    return order, np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")


@dataclass(frozen=True)
class Field:
    """Weights by feature and label, and by neighbouring labels; a sequence has the label outside before and behind it."""

    weights: np.ndarray
    links: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), len(LABELS)))
        for column in features.T:
            out += self.weights[column]
        return out

    def decode(self, words: Words) -> np.ndarray:
        """The best labels of all sequences, by Viterbi, a step of all sequences at a time."""
        best = self.emissions(words.features)
        order, active = _steps(words.borders)
        begin = words.borders[:-1][order]
        size = np.diff(words.borders)[order]
        for step, n in enumerate(active.tolist()):
            at = begin[:n] + step
            best[at] += (best[at - 1][:, :, None] + self.links).max(axis=1) if step else self.links[0]
        labels = np.zeros(len(best), np.int8)
        for step in range(len(active) - 1, -1, -1):
            n = int(active[step])
            at = begin[:n] + step
            following = np.where(size[:n] > step + 1, labels[np.minimum(at + 1, len(best) - 1)], 0)
            labels[at] = (best[at] + self.links[:, following].T).argmax(axis=1)
        return labels

    def marginals(self, features: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Label probabilities of words, expected counts of neighbouring labels, and the log of all sequences' sums."""
        scores = self.emissions(features)
        order, active = _steps(borders)
        begin, end = borders[:-1][order], borders[1:][order] - 1
        ahead, behind = scores.copy(), np.zeros_like(scores)
        for step, n in enumerate(active.tolist()):
            at = begin[:n] + step
            ahead[at] += _log_sum(ahead[at - 1][:, :, None] + self.links, 1) if step else self.links[0]
        total = _log_sum(ahead[end] + self.links[:, 0], 1)
        behind[end] = self.links[:, 0]
        pairs = np.zeros_like(self.links)
        for step in range(len(active) - 1, 0, -1):
            n = int(active[step])
            at = begin[:n] + step
            own = (scores[at] + behind[at])[:, None, :] + self.links
            behind[at - 1] = _log_sum(own, 2)
            pairs += np.exp(ahead[at - 1][:, :, None] + own - total[:n, None, None]).sum(axis=0)
        whole = np.empty_like(total)
        whole[order] = total
        p = np.exp(ahead + behind - np.repeat(whole, np.diff(borders))[:, None])
        pairs[0] += p[begin].sum(axis=0)
        pairs[:, 0] += p[end].sum(axis=0)
        return p, pairs, float(total.sum())


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def possible() -> np.ndarray:
    """Zero where two labels may stand side by side: further words of a span only behind words of their kind."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for b, name in enumerate(LABELS):
        if name.endswith("+"):
            out[:, b] = [0 if a in (name, name[:-1]) else _NEVER for a in LABELS]
    return out


def train(features: np.ndarray, borders: np.ndarray, labels: np.ndarray) -> Field:
    """The field of greatest likelihood under a small penalty, by scaled gradient steps over all sequences."""
    n = max(1, len(borders) - 1)
    allowed = possible()
    weights, links = np.zeros((1 << BITS, len(LABELS))), np.zeros_like(allowed)
    if len(borders) < 2:
        return Field(weights, allowed)
    seen_weights, seen_links = np.full_like(weights, 1e-6), np.full_like(links, 1e-6)
    before = np.where(np.isin(np.arange(len(labels)), borders[:-1]), 0, np.roll(labels, 1))
    counts = np.zeros_like(links)
    np.add.at(counts, (before, labels), 1)
    np.add.at(counts[:, 0], labels[borders[1:] - 1], 1)
    used, place = np.unique(features, return_inverse=True)
    place = place.reshape(features.shape)
    for step in range(STEPS):
        p, pairs, _ = Field(weights, links + allowed).marginals(features, borders)
        p[np.arange(len(labels)), labels] -= 1
        grad = np.zeros((len(used), len(LABELS)))
        for column in place.T:
            for label in range(len(LABELS)):
                grad[:, label] += np.bincount(column, p[:, label], len(used))
        grad = grad / n + PENALTY / n * weights[used]
        now = RATE * (1 - step / STEPS)
        seen_weights[used] += grad * grad
        weights[used] -= now * grad / np.sqrt(seen_weights[used])
        pull = (pairs - counts) / n + PENALTY / n * links
        seen_links += pull * pull
        links -= now * pull / np.sqrt(seen_links) * (allowed == 0)
    return Field(weights.astype(np.float32), links + allowed)


# the labelled table


def marked(example: str) -> tuple[str, list[Span]]:
    """The text of an example and its marked spans."""
    text, spans = "", []
    for part in re.split(r"(<\w+>.*?</\w+>)", example):
        found = re.fullmatch(r"<(\w+)>(.*?)</\w+>", part)
        if found:
            spans.append((len(text), KINDS.index(found[1]), len(text) + len(found[2])))
        text += found[2] if found else part
    return text, spans


def word_labels(words: Words, points: np.ndarray, at: np.ndarray, spans: list[list[Span]]) -> np.ndarray:
    """The label of each word under the spans of its text; ``points`` has the code points before each byte."""
    labels = np.zeros(len(words.starts), np.int64)
    last: dict[int, Span] = {}
    for k, (lo, hi, t) in enumerate(zip(points[words.starts].tolist(), points[words.ends].tolist(), words.text.tolist())):
        base = int(points[at[t]])
        own = next((s for s in spans[t] if s[0] < hi - base and s[2] > lo - base), None)
        if own:
            first = LABELS.index(KINDS[own[1]])
            labels[k] = first + 1 if last.get(t) == own and LABELS[min(first + 1, len(LABELS) - 1)].endswith("+") else first
            last[t] = own
    return labels


def _points(data: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of texts: their places, bytes and borders."""
    data, at = arrays.text_buffers(column)
    for lo, hi in arrays.chunks(at):
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]


_SEQUENCES = "h long, features binary, labels binary"


def sequences(docs: DataFrame) -> DataFrame:
    """The sequences of ``t``, labelled by the patterns; those of more than ``FIT_WORDS`` words, or ``unsure``, are left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in _texts(batch.column(0)):
                words = words_of(data, at)
                held = set(words.text.tolist())
                texts = [batch.column(0)[lo + k].as_py() if k in held else "" for k in range(hi - lo)]
                labels = word_labels(words, _points(data), at, list(map(base_spans, texts)))
                doubt = word_labels(words, _points(data), at, list(map(unsure, texts)))
                rows = [(a, b) for a, b in zip(words.borders[:-1].tolist(), words.borders[1:].tolist()) if b - a <= FIT_WORDS and not doubt[a:b].any()]
                parts = [(words.features[a:b].astype("<i4").tobytes(), labels[a:b].astype(np.int8).tobytes()) for a, b in rows]
                h = [int.from_bytes(hashlib.blake2b(x + y, digest_size=8).digest(), "little", signed=True) for x, y in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array([x for x, _ in parts], pa.binary()), pa.array([y for _, y in parts], pa.binary())],
                    names=["h", "features", "labels"],
                )

    return docs.select("t").mapInArrow(each, _SEQUENCES)


def fit(docs: DataFrame, examples: tuple[str, ...] = EXAMPLES, *, rows: int = FIT_ROWS, text: str = "text") -> Field:
    """Fit on the examples and on at most ``FIT_SEQUENCES`` different sequences of at most ``rows`` documents.

    Documents and sequences are chosen by hash, so copies count once and the
    choice doesn't depend on how rows are dealt. Null texts have no sequence, and
    texts of more than ``FIT_BYTES`` aren't chosen.
    """
    short = docs.where(F.octet_length(text) <= FIT_BYTES)
    own = sample.evenly(short.select(F.coalesce(F.col(text), F.lit("")).alias("t")), rows, "t")
    found = sequences(own).dropDuplicates(["h"]).orderBy("h").limit(FIT_SEQUENCES).collect()
    texts, spans = zip(*map(marked, examples)) if examples else ((), ())
    data, at = arrays.text_buffers(pa.array(texts, pa.string()))
    words = words_of(data, at)
    parts = [np.frombuffer(r["features"], "<i4").reshape(len(r["labels"]), -1) for r in found]
    features = np.concatenate([words.features, *parts]) if len(words.starts) else np.concatenate(parts) if parts else words.features
    labels = np.concatenate([word_labels(words, _points(data), at, list(spans)), *(np.frombuffer(r["labels"], np.int8) for r in found)]).astype(np.int64)
    size = np.concatenate([np.diff(words.borders), [len(x) for x in parts]]).astype(np.int64)
    return train(features, np.concatenate([[0], np.cumsum(size)]), labels)


# reports

_EDGE = {0: (b"[A-Za-z0-9]", b"[A-Za-z0-9]"), 1: (b"[0-9A-Fa-f:]", b"[0-9A-Fa-f:]"), 2: (b"[0-9]", b"[0-9]"), 3: (b"[+(0-9]", b"[0-9]")}
_WHOLE = {k: re.compile(a + b"(?:.*" + b + b")?", re.DOTALL) for k, (a, b) in _EDGE.items()}


def _cuts(data: np.ndarray) -> list[int]:
    """Borders of pieces of a long text, about ``arrays.CHUNK`` each, that end with a line."""
    lines = np.flatnonzero(data == 10) + 1
    found = lines[np.searchsorted(lines, np.arange(arrays.CHUNK, len(data), arrays.CHUNK), side="right") - 1] if len(lines) else lines
    return [0, *np.unique(found[(found > 0) & (found < len(data))]).tolist(), len(data)]


def field_spans(field: Field, data: np.ndarray, at: np.ndarray) -> dict[int, list[Span]]:
    """The field's spans of each text that has any, in code points, without punctuation at their edges.

    Nothing reaches over the end of a line, so a text that is a chunk of its own
    is read in pieces of whole lines, and memory doesn't follow its length.
    """
    if len(at) != 2 or len(data) <= 2 * arrays.CHUNK:
        return _field_spans(field, data, at)
    cuts, before, out = _cuts(data), 0, []
    for a, b in zip(cuts, cuts[1:]):
        piece = data[a:b]
        found = _field_spans(field, piece, np.array([0, b - a])).get(0, [])
        out += [(start + before, kind, end + before) for start, kind, end in found]
        before += int(np.count_nonzero((piece & 0xC0) != 0x80))
    return {0: out} if out else {}


def _field_spans(field: Field, data: np.ndarray, at: np.ndarray) -> dict[int, list[Span]]:
    words = words_of(data, at)
    labels = field.decode(words)
    out: dict[int, list[Span]] = {}
    hits = np.flatnonzero(labels)
    if not len(hits):
        return out
    points = _points(data)
    opens = np.array([not LABELS[x].endswith("+") for x in labels[hits]])
    for a, b in zip(np.flatnonzero(opens).tolist(), [*np.flatnonzero(opens)[1:].tolist(), len(hits)]):
        t, kind = int(words.text[hits[a]]), int(_KIND[labels[hits[a]]])
        lo = int(words.starts[hits[a]])
        found = _WHOLE[kind].search(bytes(data[lo : words.ends[hits[b - 1]]]))
        if found:
            ends = points[[lo + found.start(), lo + found.end()]] - points[at[t]]
            out.setdefault(t, []).append((int(ends[0]), kind, int(ends[1])))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def apart(base: list[Span], more: list[Span]) -> list[Span]:
    """Those of ``more`` that overlap none of ``base``; both are sorted by start."""
    out, k, reach = [], 0, 0
    for span in more:
        while k < len(base) and base[k][0] < span[2]:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= span[0]:
            out.append(span)
    return out


def scan(docs: DataFrame, field: Field, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, added``: base spans of each text and the field's that overlap none, as arrays of ``start, kind, end``.

    A map over the rows: nothing is shuffled, and copies are scanned where they are.
    """
    span = "array<struct<start:int,kind:string,end:int>>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for batch in batches:
            base: list[list] = []
            added: list[list] = []
            for lo, hi, data, at in _texts(batch.column(1)):
                marks = set((np.searchsorted(at, np.flatnonzero(_MARK[data]), side="right") - 1).tolist())
                found = field_spans(field, data, at)
                for k in range(hi - lo):
                    own = base_spans(batch.column(1)[lo + k].as_py()) if k in marks else []
                    base.append([(a, KINDS[x], b) for a, x, b in own])
                    added.append([(a, KINDS[x], b) for a, x, b in apart(own, sorted(found.get(k, [])))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([[{"start": a, "kind": x, "end": b} for a, x, b in row] for row in rows], kind) for rows in (base, added))],
                names=["doc_id", "base", "added"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(each, f"doc_id long, base {span}, added {span}")


def digest(docs: DataFrame, field: Field, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, counts of base spans, their digest, all spans and ``n_added``, for each row.

    Defined cases: a null text counts as empty and has no span; a null id keeps
    its row; repeated rows are reported again; a very long text is scanned whole,
    in time linear in its length; where two kinds' base spans overlap both stay,
    and of the field's those that overlap none; other columns are ignored; an
    empty table gives an empty result.
    """
    order = {k: F.lit(n) for n, k in enumerate(KINDS)}
    place = lambda s: F.coalesce(*(F.when(s["kind"] == k, n) for k, n in order.items()))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    keyed = lambda x: F.transform(x, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return scan(docs, field, key=key, text=text).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(keyed(F.concat("base", "added")))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
