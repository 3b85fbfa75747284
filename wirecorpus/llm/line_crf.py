"""Quality rules with a line labeller: a linear-chain conditional random field over a text's lines.

Each line has a few bounded features (shares of kinds of characters, length, repetition). The field
scores content and boilerplate for every line and every step from line to line; Viterbi decoding
finds the best labelling of the whole text. The share of words that stand in content lines decides
whether the text is kept, after base rules on its length and its repeated word windows.

The weights are fitted by gradient ascent on the likelihood of labelled lines, in numpy, with the
forward-backward recursion run on many chains at once. The lines of a labelled document take its
label. As such chains never change their label, as many are made that do: a run of lines of a
document of one class, put into a document of the other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wirecorpus.llm.common import by_slice, labelled_sample, runs
from wirecorpus.llm.superminhash import mix, word_hashes

# labelled documents per class, and lines of one training sequence
PER_CLASS, CHAIN = 1000, 32
MIN_WORDS, WINDOW, REPEATED_PERCENT = 50, 3, 50
# share of words in content lines from which a text is kept
CONTENT = 0.5

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# bounds of the buckets of each measured value
_SHARES = (0.0001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
_LENGTHS = (1, 2, 4, 8, 16, 32, 64)
_MEASURES = (
    ("symbol", _SHARES), ("upper", _SHARES), ("digit", _SHARES), ("bang", _SHARES), ("stop", _SHARES), ("pipe", _SHARES),
    ("repeated", _SHARES), ("words", _LENGTHS), ("seen", (0.5,)), ("empty", (0.5,)),
)
FEATURES = sum(len(bounds) + 1 for _, bounds in _MEASURES)
BOILERPLATE, KEPT = 0, 1


@dataclass
class LineField:
    emit: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 2)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))


def _kinds() -> np.ndarray:
    """Kind of each octet: 1 symbol, 2 upper, 3 digit, 4 bang, 5 stop, 6 pipe, 7 white, 0 other."""
    table = np.zeros(256, dtype=np.uint8)
    table[[ord(c) for c in "#*$%&<>@^~=_+\\/{}[]"]] = 1
    table[65:91], table[48:58], table[33], table[[44, 46, 58, 59]], table[124] = 2, 3, 4, 5, 6
    table[32] = table[9:14] = 7
    return table


def _in_windows(hashes: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Words that stand in a window of so many words which its text has twice or more."""
    n = len(hashes)
    inside = np.zeros(n, dtype=bool)
    m = n - window + 1
    if m <= 0:
        return inside
    name = hashes[:m].copy()
    for k in range(1, window):
        name = mix(name * np.uint64(3) + hashes[k: k + m] + np.uint64(k))
    at = np.flatnonzero(owner[:m] == owner[window - 1:])
    order = at[np.lexsort((name[at], owner[at]))]
    same = (name[order[1:]] == name[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = order[twice]
    for k in range(window):
        inside[starts + k] = True
    return inside


class Lines:
    """Measures of all lines of some texts, and the counts that the base rules need."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        split = [t.split(b"\n") for t in raw]
        self.per_text = np.array([len(s) for s in split], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.per_text)])
        lines = [line for s in split for line in s]
        owner = np.repeat(np.arange(len(texts)), self.per_text)
        octets = np.array([len(line) for line in lines], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(octets + 1)])
        text = np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8) if lines else np.zeros(0, np.uint8)
        kind = _kinds()[text]
        line_of = np.repeat(np.arange(len(lines)), octets + 1)
        counts = np.bincount(line_of * 8 + kind, minlength=8 * len(lines)).reshape(-1, 8).astype(float)
        counts[:, 7] -= 1  # the line end
        dense = np.maximum(octets - counts[:, 7], 1)

        hashes, word_line = word_hashes(lines, fold=False)
        self.line_words = np.bincount(word_line, minlength=len(lines))
        word_owner = owner[word_line]
        inside = _in_windows(hashes, word_owner, WINDOW)
        self.n_words = np.bincount(word_owner, minlength=len(texts))
        self.n_repeated = np.bincount(word_owner, weights=inside, minlength=len(texts)).astype(np.int64)
        repeated = np.bincount(word_line, weights=inside, minlength=len(lines)) / np.maximum(self.line_words, 1)
        seen = np.zeros(len(lines))
        self.n_dup = np.zeros(len(texts), dtype=np.int64)
        worded, at = self.line_words > 0, 0
        for i, s in enumerate(split):
            before: set[bytes] = set()
            for line in s:
                if worded[at]:
                    if line in before:
                        seen[at] = 1
                    before.add(line)
                at += 1
        self.n_dup = np.bincount(owner, weights=seen, minlength=len(texts)).astype(np.int64)
        code_points = np.array([len(t) for t in texts], dtype=np.int64)
        whites = np.bincount(owner, weights=counts[:, 7], minlength=len(texts)).astype(np.int64) + self.per_text - 1
        self.word_chars = code_points - whites
        self.symbols = np.array([sum(map(t.count, "#*$%&|<>")) for t in texts], dtype=np.int64)

        values = [*(counts[:, k] / dense for k in range(1, 7)), repeated, self.line_words, seen, self.line_words == 0]
        self.active = np.empty((len(lines), len(_MEASURES)), dtype=np.int64)
        offset = 0
        for j, ((_, bounds), value) in enumerate(zip(_MEASURES, values)):
            self.active[:, j] = offset + np.searchsorted(np.array(bounds, dtype=float), value, side="right")
            offset += len(bounds) + 1

    def scores(self, model: LineField) -> np.ndarray:
        return model.emit[self.active].sum(axis=1)


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """The best labels of one chain of two-label scores; of equals the one that keeps to content."""
    steps = scores.tolist()
    (m00, m01), (m10, m11) = move.tolist()
    a, b = steps[0]
    back = []
    for s0, s1 in steps[1:]:
        from0, from1 = a + m00, b + m10
        to0, p0 = (from0, 0) if from0 > from1 else (from1, 1)
        from0, from1 = a + m01, b + m11
        to1, p1 = (from0, 0) if from0 > from1 else (from1, 1)
        back.append((p0, p1))
        a, b = to0 + s0, to1 + s1
    at = 0 if a > b else 1
    labels = [at]
    for pointers in reversed(back):
        at = pointers[at]
        labels.append(at)
    return labels[::-1]


def spliced(texts: list[str], labels: list[int], seed: int = 5) -> tuple[list[str], list[np.ndarray]]:
    """Texts with a run of lines of a text of the other class in them, and the label of each line.

    Every text takes in one run, so there are as many as texts; with one class or none there are none.
    """
    rng = np.random.default_rng(seed)
    by_class = {c: [t.split("\n") for t, x in zip(texts, labels) if x == c] for c in (0, 1)}
    out, marks = [], []
    if by_class[0] and by_class[1]:
        for c in (0, 1):
            for k, lines in enumerate(by_class[c]):
                other = by_class[1 - c][int(rng.integers(len(by_class[1 - c])))]
                size = int(rng.integers(1, len(other) + 1))
                start, at = int(rng.integers(len(other) - size + 1)), int(rng.integers(len(lines) + 1))
                out.append("\n".join([*lines[:at], *other[start: start + size], *lines[at:]]))
                marks.append(np.concatenate([np.full(at, c), np.full(size, 1 - c), np.full(len(lines) - at, c)]))
    return out, marks


def train(texts: list[str], labels: list[int], steps: int = 150, rate: float = 1.0, ridge: float = 1e-3) -> LineField:
    """Gradient ascent on the mean log-likelihood of the chains. With one class or none: all content."""
    model = LineField()
    if len(set(labels)) < 2:
        return model
    mixed, marks = spliced(texts, labels)
    marks = [np.full(t.count("\n") + 1, c) for t, c in zip(texts, labels)] + marks
    # both classes weigh the same, plain texts as much as mixed ones, and each chain once whatever its length
    kind = np.array([*labels, *(2 + m[0] for m in marks[len(texts):])])
    share = 1 / (len(set(kind.tolist())) * np.bincount(kind, minlength=4).clip(1))
    active, label, weight, number = [], [], [], 0
    for part in runs(texts + mixed):
        lines = Lines(part)
        for a, b in zip(lines.first, lines.first[1:]):  # long texts give several chains, none is cut off
            for at in range(a, b, CHAIN):
                active.append(lines.active[at: min(at + CHAIN, b)].copy())
                label.append(marks[number][at - a: at - a + CHAIN])
                weight.append(share[kind[number]])
            number += 1
    weight = np.array(weight)
    size = np.array([len(x) for x in active])
    n, longest = len(active), int(size.max())
    padded = np.zeros((n, longest, len(_MEASURES)), dtype=np.int32)
    for i, x in enumerate(active):
        padded[i, : len(x)] = x
    real = np.arange(longest)[None, :] < size[:, None]
    given = np.zeros((n, longest, 2))  # one at the label of each line
    observed = np.zeros((2, 2))
    for i, x in enumerate(label):
        given[i, np.arange(len(x)), x] = 1
        np.add.at(observed, (x[:-1], x[1:]), weight[i] / size[i])
    speed = [np.zeros_like(model.emit), np.zeros_like(model.move)]
    for step in range(steps):
        score = model.emit[padded].sum(axis=2)  # (n, longest, 2)
        forward = np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            came = np.logaddexp(forward[:, t - 1, 0, None] + model.move[0], forward[:, t - 1, 1, None] + model.move[1])
            forward[:, t] = np.where(real[:, t, None], came + score[:, t], forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        backward = np.zeros((n, longest, 2))
        expected = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            ahead = backward[:, t + 1] + score[:, t + 1]
            both = forward[:, t, :, None] + model.move[None] + ahead[:, None, :] - total[:, None, None]
            on = real[:, t + 1]
            expected += (np.exp(both[on]) * (weight / size)[on, None, None]).sum(axis=0)
            went = np.logaddexp(model.move[:, 0] + ahead[:, 0, None], model.move[:, 1] + ahead[:, 1, None])
            backward[:, t] = np.where(real[:, t + 1, None], went, 0.0)
        share = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
        error = (given - share) * (weight / size)[:, None, None]
        gradient = np.zeros_like(model.emit)
        for c in (0, 1):
            flat = np.repeat(error[:, :, c].reshape(-1), len(_MEASURES))
            gradient[:, c] = np.bincount(padded.reshape(-1), weights=flat, minlength=FEATURES)
        moves = observed - expected
        for value, g, v in ((model.emit, gradient, speed[0]), (model.move, moves, speed[1])):
            v *= 0.9
            v += g - ridge * value
            value += rate * v
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> LineField:
    """Fit on at most ``per_class`` labelled documents of each class, chosen by md5 of their ids."""
    return train(*labelled_sample(docs, labels, label, per_class))


def _verdict(texts: list[str], model: LineField):
    """Measures of the texts, each one's labels, content share, base rules and verdict."""
    lines = Lines(texts)
    scores = lines.scores(model)
    labels, share = [], np.zeros(len(texts))
    for i in range(len(texts)):
        a, b = lines.first[i], lines.first[i + 1]
        label = np.array(viterbi(scores[a:b], model.move))
        words = lines.line_words[a:b]
        share[i] = (words * label).sum() / max(1, words.sum())
        labels.append(label)
    failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeated > REPEATED_PERCENT * lines.n_words)
    return lines, labels, share, failed, ~failed & (share >= CONTENT)


def keep_rows(docs: DataFrame, model: LineField, text: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns.

    A null or empty text fails the base rules; repeated rows are kept or go together; no row gives no
    row, and columns of any name are handed on as they are.
    """
    at = docs.columns.index(text)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(_verdict([t or "" for t in batch.column(at).to_pylist()], model)[4]))
        return work

    return docs.mapInArrow(by_slice(make, text), docs.schema)


def judge(docs: DataFrame, model: LineField, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base rules and verdict of every row, whole texts.

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_share, n_lines, content_spans). ``content_spans`` are the runs of content lines, as
    (first, last) line from 0. A text with fewer than ``MIN_WORDS`` words, or with over half of its
    words in windows of three words found twice or more, fails the base rules; one that passes is
    kept if at least ``CONTENT`` of its words stand in content lines. A null or empty text has no
    words and fails. Repeated rows give repeated rows; other columns are not read.
    """
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lines, labels, share, failed, kept = _verdict([t or "" for t in batch.column(1).to_pylist()], model)
            spans = []
            for label in labels:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], label, [0]])))
                spans.append([{"first": int(f), "last": int(l) - 1} for f, l in zip(edge[::2], edge[1::2])])
            columns = [
                batch.column(0), lines.n_words, lines.word_chars, lines.symbols, lines.n_dup, lines.n_repeated,
                failed, kept, share, lines.per_text,
                pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], NAMES)
        return work

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(by_slice(make, "text"), SCHEMA)


NAMES = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    "content_share", "n_lines", "content_spans",
]
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double, n_lines long, "
    "content_spans array<struct<first: int, last: int>>"
)
