"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads the bytes of the lower-cased text as they stand, words, digits, signs and
blanks alike, in windows of ``WIDE`` bytes that overlap by ``LAP`` on each side, so that
context crosses words. It labels every byte position with a distribution over the learned
languages, each position in the window in whose middle it lies; a document pools the log
probabilities of all its positions.

Trained on the driver by backpropagation through time on windows of a bounded sample of
labelled documents; weights (some tens of KB) go to the tasks, texts are labelled where
they are read.

Defined results: null texts and texts without a letter (of any script): ``und`` and score 0; no
labelled example: ``und`` for all; one learned language: that one; equal scores go to
the language that comes first in order; repeated rows are labelled alike; a null
doc_id is labelled and not held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm import common, gru

#: Documents of each language to learn from, at most.
PER_LANGUAGE = 200
#: Windows of each of these documents to learn from, at most: a bound on the sample, not on what is labelled.
SPOTS = 8
WIDE, LAP = 128, 16
HIDDEN = 12
EPOCHS, BATCH = 4, 64
#: Batches of each pass, at least.
STEPS = 40
#: Windows labelled at once (of four languages; fewer of more).
ROWS = 1024
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    p: dict[str, np.ndarray]


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (windows, WIDE) of all texts, 0 beyond a text's ends; whose each window is, and how many bytes in its middle are the text's."""
    codes = [np.frombuffer((t or "").lower().encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    step = WIDE - 2 * LAP
    size = np.array([len(c) for c in codes], np.int64)
    many = -(-size // step)
    whole = np.zeros(int((many * step + 2 * LAP).sum()), np.uint8)
    begin = np.cumsum(many * step + 2 * LAP) - (many * step + 2 * LAP)
    for c, a in zip(codes, begin.tolist()):
        whole[a + LAP : a + LAP + len(c)] = c
    who = np.repeat(np.arange(len(texts)), many)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[who] + nth * step
    return whole[at[:, None] + np.arange(WIDE)[None, :]] if len(at) else np.zeros((0, WIDE), np.uint8), who, np.minimum(step, size[who] - nth * step)


def _inside(count: np.ndarray) -> np.ndarray:
    """(WIDE, windows): 1 for the positions that a window labels."""
    at = np.arange(WIDE)[:, None] - LAP
    return ((at >= 0) & (at < count[None, :])).astype(np.float32)


def positions(model: Model, code: np.ndarray) -> np.ndarray:
    """Log probabilities (WIDE, windows, languages) at each position of windows (WIDE, windows)."""
    p = model.p
    f = gru.read(p["xf"], p["uf"], code)
    logit = f @ p["w"][:HIDDEN]
    logit += gru.read(p["xb"], p["ub"], code[::-1])[::-1] @ p["w"][HIDDEN:]
    logit += p["b"]
    logit -= logit.max(axis=2, keepdims=True)
    logit -= np.log(np.exp(logit).sum(axis=2, keepdims=True))
    return logit


def train(examples: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of (text, language) examples."""
    languages = sorted({lang for _, lang in examples})
    rng = np.random.default_rng(seed)
    k, h = len(languages), HIDDEN
    mat = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0] if len(s) > 1 else 1)).astype(np.float32)
    p = {"xf": mat(256, 3 * h) * 4, "xb": mat(256, 3 * h) * 4, "uf": mat(h, 3 * h), "ub": mat(h, 3 * h), "w": mat(2 * h, k), "b": np.zeros(k, np.float32)}
    model = Model(languages, p)
    if k < 2:
        return model
    picked, y = [], []
    for t, lang in examples:
        own, _, count = windows([t])
        for j in rng.permutation(len(own))[:SPOTS]:
            picked.append((own[j], int(count[j])))
            y.append(languages.index(lang))
    if not picked:
        return model
    code, count, truth = np.array([c for c, _ in picked]).T, np.array([n for _, n in picked]), np.array(y)
    opt = gru.Adam(p, 0.01)
    steps = -(-len(truth) // BATCH) * EPOCHS
    passes = max(EPOCHS, -(-STEPS * EPOCHS // steps))  # a small sample is gone through more often
    ones = np.ones((WIDE, BATCH), np.float32)
    for epoch in range(passes):
        if epoch == passes - max(1, passes // 4):
            opt.rate /= 4
        order = rng.permutation(len(truth))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            c, mask, on = code[:, part], _inside(count[part]), ones[:, : len(part)]
            keep: tuple[list, list] = ([], [])
            states = gru.both(p["xf"][c], p["xb"][c], p["uf"], p["ub"], on, keep)
            logit = states @ p["w"] + p["b"]
            d = np.exp(logit - logit.max(axis=2, keepdims=True))
            d /= d.sum(axis=2, keepdims=True)
            d[:, np.arange(len(part)), truth[part]] -= 1
            d *= mask[:, :, None] / mask.sum()
            dxf, dxb, duf, dub = gru.both_back(d @ p["w"].T, p["uf"], p["ub"], on, keep)
            g = {"w": np.tensordot(states, d, ([0, 1], [0, 1])), "b": d.sum(axis=(0, 1)), "uf": duf, "ub": dub}
            for name, dx in (("xf", dxf), ("xb", dxb)):
                g[name] = np.zeros_like(p[name])
                np.add.at(g[name], c.ravel(), dx.reshape(-1, dx.shape[2]))
            opt.step(g)
    return model


def identify(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, probability) of each text."""
    able = [has_letter(t) for t in texts]
    if not model.languages or not any(able):
        return [("und", 0.0)] * len(texts)
    code, who, count = windows([t if ok else None for t, ok in zip(texts, able)])
    k = len(model.languages)
    pooled, size = np.zeros((len(texts), k)), np.bincount(who, count, len(texts))
    rows = max(32, ROWS * 4 // max(4, k))  # the labels of so many windows are held at once
    for a in range(0, len(code), rows):
        part = np.ascontiguousarray(code[a : a + rows].T)
        # A position at a time, and the positions of a window added up before those of a text.
        found = np.einsum("tbk,tb->bk", positions(model, part), _inside(count[a : a + rows]), dtype=np.float64)
        np.add.at(pooled, who[a : a + rows], found)
    out = []
    for own, n, ok in zip(pooled, size, able):
        if not ok:
            out.append(("und", 0.0))
            continue
        prob = np.exp((own - own.max()) / n)
        best = int(prob.argmax())
        out.append((model.languages[best], float(prob[best] / prob.sum())))
    return out


#: Characters that are identified together.
_SLICE = 1 << 20


def _identify(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a = batch.column(1).to_pylist(), 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and size < _SLICE:
                    size += len(texts[b] or "")
                    b += 1
                found = identify(model, texts[a:b])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["doc_id", "lang_pred", "score"])
                a = b

    return run


def fit(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of a sample: of each language, however many there are, the documents of smallest hash among those not held out."""
    ok = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.bucket(F.col("doc_id"), 3) != 1))
    # Tasks send no more than ``per_language`` rows of a language (a group limit below the window).
    place = F.row_number().over(Window.partitionBy("lang").orderBy("__h", "doc_id"))
    picked = ok.select("lang", "doc_id", F.xxhash64("doc_id").alias("__h")).distinct().withColumn("__n", place).where(F.col("__n") <= per_language).select("lang", "doc_id").collect()
    if not picked:
        return Model([], {})
    chosen = spark.createDataFrame([(r[0], r[1]) for r in picked], "lang string, doc_id long")
    # Of a repeated id the smallest text stands for all; a very long text is no example.
    texts = ok.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    rows = texts.where(F.length("text") <= common.EXAMPLE_CHARS).orderBy("doc_id", "lang").collect()
    return train([(r["text"], r["lang"]) for r in rows])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    common.text_batches(docs.sparkSession)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_identify(model), "doc_id long, lang_pred string, score double")
    return got.select("doc_id", F.coalesce(common.bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = common.table(spark, sf_dir, "documents")
    return identified(docs, fit(spark, docs.select("doc_id", "text", "lang")))
