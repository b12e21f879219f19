"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on labelled texts, one a class. A text is cut into
short pieces that are compressed with each; the difference of the two compressed sizes,
over their sum, says which dictionary knows the text better. A logistic curve of
that difference alone (a constant and a slope), fitted to examples that no
dictionary has seen, turns it into a probability. Pieces are short so that what a piece has
to refer to is the dictionary rather than its own beginning.

Dictionaries and coefficients (under 70 KB) go to the tasks; texts are scored where
they are read, in pieces, so a text of any length takes the memory of a piece.

Defined results: null and empty texts have no size and score the share of good
examples (the prior); repeated rows score alike; with examples of one class only, or
none, every text scores that prior (1.0 and 0.5 respectively smoothed); an empty
table gives an empty result; a null doc_id is scored and is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import common

#: Labelled documents of each class to learn from, at most.
PER_CLASS = 800
DICTIONARY = 32 << 10
PIECE = 128
LEVEL = 3
CUT = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray
    prior: float

    def coders(self) -> tuple:
        made = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        return tuple(made)


def sizes(text: bytes, coders: tuple) -> tuple[int, int]:
    """Compressed bytes of all pieces of ``text`` with each coder."""
    good = bad = 0
    for i in range(0, len(text), PIECE):
        part = text[i : i + PIECE]
        good += len(coders[0].compress(part))
        bad += len(coders[1].compress(part))
    return good, bad


def difference(text: bytes, coders: tuple) -> float:
    """Normalised difference of the compressed sizes: positive if the dictionary of good text knows it better."""
    good, bad = sizes(text, coders)
    return (bad - good) / (bad + good) if good + bad else 0.0


def _dictionaries(rows: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """Dictionaries of the good and of the bad texts of (text, label), of one size, so that neither is favoured for having more text."""
    samples = [[t[i : i + PIECE] for t, y in rows if y == k for i in range(0, len(t), PIECE)] for k in (1, 0)]
    size = min(DICTIONARY, max(1024, min(sum(map(len, s)) for s in samples) * 3 // 10))
    return tuple(_dictionary(s, size) for s in samples)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or where there is too little text for training, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\0" * 8


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Newton's method with a small penalty on all but the constant."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[bytes, int]], share: float | None = None) -> Model:
    """A model of (text, label) examples; ``share``: of good ones among all labelled rows.

    The examples are dealt into two folds. Dictionaries of one fold give the differences
    of the other and the other way round; the curve is fitted to both, the final
    dictionaries to all.
    """
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    prior = share if share is not None else (n[1] + 1) / (sum(n) + 2)
    if min(n) < 4:
        return Model(b"\0" * 8, b"\0" * 8, np.zeros(0), prior)
    each = [[r for r in rows if r[1] == k] for k in (0, 1)]
    folds = [each[0][i::2] + each[1][i::2] for i in (0, 1)]
    x, y = [], []
    for mine, other in (folds, folds[::-1]):
        coders = Model(*_dictionaries(mine), np.zeros(0), prior).coders()
        x += [(1.0, 10 * difference(t, coders)) for t, _ in other if t]
        y += [v for t, v in other if t]
    if len(set(y)) < 2:
        return Model(b"\0" * 8, b"\0" * 8, np.zeros(0), prior)
    xs, ys = np.array(x), np.array(y, float)
    return Model(*_dictionaries(rows), _logistic(xs, ys), prior)


def score(text: bytes, model: Model, coders: tuple) -> float:
    if not text or not len(model.weights):
        return model.prior
    return float(1 / (1 + np.exp(-np.clip(np.array([1.0, 10 * difference(text, coders)]) @ model.weights, -30, 30))))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = model.coders()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
            values = [score(t.as_py() or b"", model, coders) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows = common.labelled_sample(spark, docs, labels, "quality", per_class)
    counts = {r[0]: r[1] for r in labels.where(F.col("quality").isin(0, 1) & (common.bucket(F.col("doc_id"), 5) != 0)).groupBy("quality").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    model = train([((r["text"] or "").encode(), r["label"]) for r in rows], (good + 1) / (good + bad + 2))
    if len(model.weights) and good and bad:  # the sample is balanced, the labelled rows are not
        n = [sum(r["label"] == k for r in rows) for k in (0, 1)]
        model.weights[0] += np.log(good / bad) - np.log(n[1] / n[0])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    common.text_batches(docs.sparkSession)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double")
    return got.select(
        "doc_id",
        F.coalesce(common.bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, fit(spark, docs, common.table(spark, sf_dir, "labels")))
