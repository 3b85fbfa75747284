"""Quality by compression: dictionaries of good and of bad text, and which of them helps more.

A text is cut into pieces of a few kilobytes, each compressed by zstandard once with the dictionary
built from good texts and once with that from bad ones. The difference of the sizes over their sum
is the gain, and the log of their mean over the text's length its density, which tells repetition
from prose where both dictionaries help alike. A logistic model over the gain, the density and its
square, fitted on labelled texts that are in no dictionary, turns them into a score.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wirecorpus.llm.common import by_slice, kept, labelled_sample, logistic

# labelled documents per class for the dictionaries and the calibration together
PER_CLASS = 1500
DICTIONARY = 256 << 10
PIECE = 1 << 10
# octets of the runs a dictionary is chosen in
SEGMENT = 256
LEVEL = 3


@dataclass
class CompressionModel:
    """Dictionaries as octets, and the logistic model's weights, the constant last."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary trained on all pieces of all the texts; its size is the only bound.

    Too little text to train on gives raw content, of pieces spread over all texts if not all fit.
    """
    import zstandard

    pieces = [t[at: at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:
        step = -(-sum(len(p) + 1 for p in pieces) // DICTIONARY)
        return b"\n".join(pieces[:: max(1, step)])


class Compressors:
    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard

        self.each = []
        for content in (good, bad):
            # trained, or raw content where that is not possible: zstandard tells them apart
            trained = zstandard.ZstdCompressionDict(content)
            trained.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(
                dict_data=trained, write_checksum=False, write_content_size=False, write_dict_id=False))

    def measure(self, text: bytes) -> tuple[float, float]:
        """Gain and density of a text; of an empty one (0, 0)."""
        good = bad = 0
        for at in range(0, len(text), PIECE):
            piece = text[at: at + PIECE]
            good += len(self.each[0].compress(piece))
            bad += len(self.each[1].compress(piece))
        return ((bad - good) / (bad + good), math.log((bad + good) / 2 / len(text))) if text else (0.0, 0.0)


def _design(measured: list[tuple[float, float]]) -> np.ndarray:
    gain, density = np.array(measured).reshape(-1, 2).T
    return np.column_stack([100 * gain, density, density * density])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> CompressionModel:
    """Fit on at most ``per_class`` labelled documents of each class (chosen by md5 of their ids).

    Two of three go into the dictionaries, the others calibrate. With no labelled text of one of
    the classes every score is 0.5.
    """
    texts, marks = labelled_sample(docs, labels, label, per_class)
    raw, marks = [t.encode() for t in texts], np.array(marks, dtype=float)
    part = np.arange(len(raw)) % 3
    good = _dictionary([t for t, m, p in zip(raw, marks, part) if m == 1 and p])
    bad = _dictionary([t for t, m, p in zip(raw, marks, part) if m == 0 and p])
    rest = part == 0
    if not good or not bad or len(set(marks[rest])) < 2:
        return CompressionModel(good, bad, (0.0, 0.0, 0.0, 0.0))
    tool = Compressors(good, bad)
    measured = [tool.measure(t) for t, r in zip(raw, rest) if r]
    return CompressionModel(good, bad, tuple(logistic(_design(measured), marks[rest]).tolist()))


def score(docs: DataFrame, model: CompressionModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, gain, score, predicted) of every row, whole texts.

    ``score`` is the calibrated probability of label 1, ``predicted`` is 1 from 0.5 on. A null or
    empty text has gain and density 0. Repeated rows give repeated rows; other columns are not read.
    """
    shipped = pickle.dumps((model.good, model.bad))
    weights = np.array(model.weights)

    def make():
        tool = kept(("compressors", hash(shipped)), lambda: Compressors(*pickle.loads(shipped)))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            measured = [tool.measure(t or b"") for t in texts]
            scores = 1 / (1 + np.exp(-np.clip(_design(measured) @ weights[:-1] + weights[-1], -30, 30)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g for g, _ in measured]), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "gain", "score", "predicted"])
        return work

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(by_slice(make, "text"), "doc_id long, gain double, score double, predicted int")
