"""Language of a text: averaged hashed subword embeddings under a linear softmax.

Subwords are all runs of 1 to 4 octets of UTF-8 inside a word, with a space on either side of it.
Each is hashed to a row of an embedding table; a text is the average of its rows; a linear layer
and a softmax give the language. Tables and layer are trained together by stochastic gradient
descent in numpy on spans of labelled texts. Averaging and the layer are both linear, so for
prediction the layer is multiplied into the table once, and a text costs one lookup per subword.

The softmax's temperature is fitted on training documents kept apart. A softmax is also sure of
text in no learned language, so rejection has a measure of its own: the fluency of a text is the
mean log frequency of its subwords in the language told. What a language asks for at least is
calibrated on the documents kept apart, against the same texts with shuffled letters and against
texts of the other languages judged as if their own had not been learned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from wirecorpus.llm.common import by_slice, runs
from wirecorpus.llm.superminhash import mix

BUCKETS, DIMENSIONS, LONGEST = 1 << 16, 16, 4
# labelled documents used for fitting, per language
PER_LANGUAGE = 800
# octets of the spans that training texts are cut into, and of a short one that stands for a short text
SPANS, SPAN = (8, 1024), 240
# so much worse it is to reject a share of good texts than to keep that share of others
CARE = 20
# the middle of all that costs at most so much more than the best is taken
NEAR = 0.05
# a short text is given the benefit of so many standard errors of its fluency
ERRORS = 2
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_PLAIN_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray = field(repr=False)  # (BUCKETS, languages), divided by the temperature
    bias: np.ndarray = field(repr=False)
    usual: np.ndarray = field(repr=False)  # (BUCKETS, languages), log2 of the share of subwords
    spread: np.ndarray = field(repr=False)  # standard deviation of usual over a language's subwords
    least: np.ndarray = field(repr=False)  # fluency a language asks for


def _octet_classes() -> np.ndarray:
    """Octets as they count: A-Z as a-z, everything of ASCII but letters as a space."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


def subwords(texts: list[bytes]):
    """Runs of (bucket, text number) arrays, one per subword length."""
    ends = np.cumsum([len(t) + 2 for t in texts])
    octets = _octet_classes()[np.frombuffer(b"".join(b" " + t + b" " for t in texts), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    space = octets == 32
    last = np.zeros(len(octets), dtype=bool)
    last[ends - 1] = True
    rolling = np.zeros(len(octets), dtype=np.uint64)
    whole = np.ones(len(octets), dtype=bool)
    for n in range(1, LONGEST + 1):
        m = len(octets) - n + 1
        if m <= 0:
            return
        rolling = rolling[:m] * np.uint64(0x100000001B3) + octets[n - 1:].astype(np.uint64) + np.uint64(1)
        # a space may begin or end a subword, not stand inside it; nothing spans two texts
        whole = whole[:m].copy()
        if n > 1:
            whole &= ~last[n - 2: n - 2 + m]
        if n > 2:
            whole &= ~space[n - 2: n - 2 + m]
        good = whole if n > 2 else whole & ~space[:m] if n == 1 else whole & ~(space[:m] & space[n - 1:])
        at = np.flatnonzero(good)
        yield (mix(rolling[at] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64), owner[at]


def _averages(texts: list[bytes]):
    """Subwords of all texts ordered by text: (buckets, starts, counts)."""
    runs = list(subwords(texts))
    buckets = np.concatenate([b for b, _ in runs])
    owner = np.concatenate([o for _, o in runs])
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(texts))
    return buckets[order], np.concatenate([[0], np.cumsum(counts)[:-1]]), counts


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=1, keepdims=True)
    e = np.exp(logits)
    return e / e.sum(axis=1, keepdims=True)


def _spans(text: bytes, rng: np.random.Generator) -> list[bytes]:
    """The text in consecutive spans of very different sizes, cut between code points."""
    cut, low, high = [0], *np.log2(SPANS)
    while cut[-1] < len(text):
        end = min(cut[-1] + int(2 ** rng.uniform(low, high)), len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        cut.append(end)
    return [text[a:b] for a, b in zip(cut, cut[1:])]


def train(texts: list[str], labels: list[str], steps: int = 640, rate: float = 40.0, seed: int = 7) -> LanguageModel:
    """Fit on these texts, in at least so many steps and two rounds over the spans.

    The spans of a text make up the whole text. One text of five is kept apart for the temperature and the fluency asked for.
    """
    languages = sorted(set(labels))
    if not languages:
        none = np.zeros((BUCKETS, 0), np.float32)
        return LanguageModel([], none, np.zeros(0), none, np.zeros(0), np.zeros(0))
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(languages)}
    raw = [t.encode() for t in texts]
    spans, marks = [], []
    for i, (t, lang) in enumerate(zip(raw, labels)):
        if i % 5 and _LETTER.search(texts[i]):
            cut = _spans(t, rng)
            spans += cut
            marks += [number[lang]] * len(cut)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32)
    layer += rng.normal(0, 0.1, layer.shape).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    marks = np.array(marks, dtype=np.int64)
    done, batch = 0, 64
    each = max(1, -(-len(spans) // batch))
    epochs = max(2, -(-steps // each)) if spans else 0
    for _ in range(epochs):
        order = rng.permutation(len(spans))
        for a in range(0, len(order), batch):
            chosen = order[a: a + batch]
            buckets, starts, counts = _averages([spans[i] for i in chosen])
            some = counts > 0
            if not some.any():
                continue
            chosen, starts, counts = chosen[some], starts[some], counts[some]
            hidden = np.add.reduceat(table[buckets], starts, axis=0) / counts[:, None]
            error = _softmax(hidden @ layer + bias)
            error[np.arange(len(chosen)), marks[chosen]] -= 1
            error /= len(chosen)
            step = rate * (1 - done / (epochs * each))
            back = (error @ layer.T / counts[:, None]).astype(np.float32)
            layer -= 0.05 * step * (hidden.T @ error).astype(np.float32)
            bias -= 0.05 * step * error.sum(axis=0)
            np.subtract.at(table, buckets, np.float32(step) * np.repeat(back, counts, axis=0))
            done += 1
    usual, spread = _usual(
        [t for i, t in enumerate(texts) if i % 5], [number[g] for i, g in enumerate(labels) if i % 5], len(languages))
    model = LanguageModel(
        languages, (table @ layer).astype(np.float32), bias.astype(np.float64), usual, spread,
        np.full(len(languages), -np.inf))
    apart = [i for i in range(0, len(raw), 5) if _LETTER.search(texts[i])]
    if apart:
        logits = np.concatenate([_logits(model, [t.encode() for t in part]) for part in runs([texts[i] for i in apart])])
        truth = np.array([number[labels[i]] for i in apart])
        scale = min(
            (-np.log(np.maximum(_softmax(logits * s)[np.arange(len(truth)), truth], 1e-12)).mean(), s)
            for s in np.geomspace(0.05, 20, 61))[1]
        model.table *= np.float32(scale)
        model.bias *= scale
        model.least = _least(model, [texts[i] for i in apart], truth, np.random.default_rng(seed + 1))
    return model


def _usual(texts: list[str], marks: list[int], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Log share of each bucket among the subwords of each language, and its standard deviation."""
    counts = np.full((BUCKETS, languages), 0.5)
    for k in range(languages):
        for part in runs([t for t, m in zip(texts, marks) if m == k]):
            for buckets, _ in subwords([t.encode() for t in part]):
                counts[:, k] += np.bincount(buckets, minlength=BUCKETS)
    share = counts / counts.sum(axis=0)
    usual = np.log2(share)
    mean = (share * usual).sum(axis=0)
    return usual.astype(np.float32), np.sqrt((share * (usual - mean) ** 2).sum(axis=0))


def _least(model: LanguageModel, texts: list[str], truth: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The fluency each language asks for, which parts its own texts from others best.

    Each text counts whole and as a short span. With no text of its own a language asks for nothing.
    """
    own, other = [[] for _ in model.languages], [[] for _ in model.languages]

    def judged(some: list[str], without: list[int] | None, into: list[list[float]], told: list[int] | None = None) -> None:
        raw = [t.encode() for t in some]
        parts = _parts(raw)
        logits = _logits(model, raw, parts)
        if without is not None:
            logits[np.arange(len(raw)), without] = -np.inf
        best = logits.argmax(axis=1) if told is None else np.array(told)
        for k, f in zip(best, _fluency(model, parts, len(raw), best)):
            into[k].append(f)

    at = 0
    for part in runs(texts):
        marks = truth[at: at + len(part)].tolist()
        at += len(part)
        cut = []
        for t in part:
            size = int(rng.integers(8, SPAN))
            start = int(rng.integers(0, max(1, len(t) - size)))
            cut.append(t[start: start + size])
        for some in (part, cut):
            judged(some, None, own, marks)
            judged(["".join(rng.permutation(list(t))) if t else t for t in some], None, other)
            if len(model.languages) > 1:
                judged(some, marks, other)
    least = np.full(len(model.languages), -np.inf)
    for k, (good, bad) in enumerate(zip(own, other)):
        if good and bad:
            good, bad = np.sort(good), np.sort(bad)
            tried = np.linspace(min(good[0], bad[0]), max(good[-1], bad[-1]), 1001)
            # one odd text, whole and as a span, does not count
            lost = np.maximum(np.searchsorted(good, tried) - 2, 0) / len(good)
            cost = CARE * lost - np.searchsorted(bad, tried) / len(bad)
            least[k] = np.median(tried[cost <= cost.min() + NEAR])
    return least


def _parts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The subwords in short types, to be gone over more than once."""
    return [(buckets.astype(np.uint16), owner.astype(np.int32)) for buckets, owner in subwords(texts)]


def _fluency(model: LanguageModel, parts: list[tuple[np.ndarray, np.ndarray]], texts: int, told: np.ndarray) -> np.ndarray:
    """Mean log frequency of each text's subwords in the language told, and ``ERRORS`` standard errors."""
    sums, counts = np.zeros(texts), np.zeros(texts)
    for buckets, owner in parts:
        counts += np.bincount(owner, minlength=texts)
        sums += np.bincount(owner, weights=model.usual[buckets, told[owner]], minlength=texts)
    counts = np.maximum(counts, 1)
    return sums / counts + ERRORS * model.spread[told] / np.sqrt(counts)


def _logits(model: LanguageModel, texts: list[bytes], parts: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    sums = np.zeros((len(texts), len(model.languages)))
    counts = np.zeros(len(texts))
    for buckets, owner in subwords(texts) if parts is None else parts:
        counts += np.bincount(owner, minlength=len(texts))
        for k in range(len(model.languages)):
            sums[:, k] += np.bincount(owner, weights=model.table[buckets, k], minlength=len(texts))
    return sums / np.maximum(counts, 1)[:, None] + model.bias


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Train on at most ``per_language`` documents of each label, the first by md5 of their ids.

    Rows without label, id or text are passed over. The rows are chosen from ids and labels alone, in
    one pass for all languages; one without text still counts as chosen. A model has 0.5 MB per
    language. No labelled row gives a model without languages, which rejects everything.
    """
    named = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("_id"), F.col(lang).alias("_lang"))
    order = [F.md5(F.col("_id").cast("string")), F.col("_id")]
    place = F.row_number().over(W.partitionBy("_lang").orderBy(*order))
    picked = named.withColumn("_place", place).where(F.col("_place") <= per_language).select("_id", "_lang")
    ids = [(r[0], r[1]) for r in picked.collect()]
    if not ids:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame(ids, "_id long, _lang string").distinct()
    rows = (
        docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
        .where(F.col("_text").isNotNull()).join(F.broadcast(chosen), ["_id", "_lang"])
        .orderBy(*order, F.xxhash64("_text")).limit(len(ids)).collect()
    )
    return train([r["_text"] for r in rows], [r["_lang"] for r in rows])


def _judge(column: pa.Array, known: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    lettered = np.array([
        bool(_PLAIN_LETTER.search(t) or _LETTER.search(t.decode("utf-8", "replace"))) for t in texts], dtype=bool)
    if known.languages:
        parts = _parts(texts)
        share = _softmax(_logits(known, texts, parts))
        told = share.argmax(axis=1)
        low = _fluency(known, parts, len(texts), told) < known.least[told]
        names = [known.languages[b] if ok else UNDETERMINED for b, ok in zip(told, lettered)]
        scores = np.where(lettered, share.max(axis=1), 0.0)
    else:
        names, scores, low = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    return names, scores, low | ~lettered


def _shared(docs: DataFrame, model: LanguageModel):
    """The model's plain parts, sent to each worker once: two tables of fixed size per language."""
    return docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.table, model.bias, model.usual, model.spread, model.least))


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, whole texts.

    ``score`` is the calibrated probability. A null text or one without a letter has the language
    ``und``, score 0 and is rejected, as is one less fluent than the language told asks for. Repeated
    rows give repeated rows; other columns are not read.
    """
    shared = _shared(docs, model)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores, rejected = _judge(batch.column(1), LanguageModel(*shared.value))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "rejected"])
        return work

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(by_slice(make, "text"), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_rows(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows that ``predict`` does not reject, with all their columns.

    A null text and one without a letter are rejected; repeated rows are kept or go together; no row
    gives no row, and columns of any name are handed on as they are.
    """
    shared = _shared(docs, model)
    at = docs.columns.index(text)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(~_judge(batch.column(at), LanguageModel(*shared.value))[2]))
        return work

    return docs.mapInArrow(by_slice(make, text), docs.schema)
