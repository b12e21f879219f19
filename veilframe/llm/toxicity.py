"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A position of the network is a word. Its input joins a learned word vector (words
seen in several training documents; others share one) with a character vector: the
mean of learned vectors of the word's hashed character 3-, 4- and 5-grams. The states
of both directions are pooled by attention over a window of ``WINDOW`` words; windows
overlap by half and cover the whole text, and a document scores as its worst window.

Trained in numpy by backpropagation through time on a bounded sample of labelled
documents: first on windows that carry their document's label, then on the worst
window of each document. A logistic curve fitted to sample documents that the network
has not seen turns window scores into probabilities at the labelled rows' base rate.

Weights (under 1 MB) go to the tasks, texts are scored where they are read.

Defined results: null texts and texts without a letter score the base rate of the
labelled rows halved; with examples of one class or none, every text scores that too;
repeated rows score alike; a null doc_id is scored and not held out; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import common, gru

#: Labelled documents of each class to learn from, at most.
PER_CLASS = 900
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 12, 12, 16, 12
GRAMS = (3, 4, 5)
BUCKETS = 1 << 14
#: A word has a vector of its own if so many training documents hold it.
MIN_DOCUMENTS = 4
WARM_UP, WORST = 3, 8
#: Batches of 64 windows in each pass, at least.
STEPS = 40
CUT = 0.5
#: Characters scored together.
SLICE = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)
    curve: tuple[float, float] = (0.0, 1.0)
    base: float = 0.5

    @property
    def able(self) -> bool:
        return bool(self.p)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character gram of ``<word>``, and where each word's grams begin (one more entry than words)."""
    code = np.frombuffer("".join(f"<{w}>" for w in vocabulary).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in vocabulary])
    start = np.cumsum(size) - size
    number = np.repeat(np.arange(len(size)), size)
    end = np.repeat(start + size, size)
    at = np.arange(len(code))
    out, owner = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            ok = at[at + n <= end]
            h = np.full(len(ok), np.uint64(n))
            for j in range(n):
                h = (h ^ code[ok + j]) * _MULT
                h ^= h >> np.uint64(31)
            out.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
            owner.append(number[ok])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    return np.concatenate(out)[order], np.searchsorted(owner_all[order], np.arange(len(size) + 1))


def _means(table: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean vector of each word's grams; every word has one gram at least."""
    return np.add.reduceat(table[bucket], at[:-1], axis=0) / np.diff(at)[:, None].astype(np.float32)


def inputs(p: dict, known: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word inputs (V, word and character dimensions) and their projections for both directions."""
    e = np.concatenate([p["words"][known], np.tanh(chars)], axis=1)
    return e, e @ p["wf"] + p["bf"], e @ p["wb"] + p["bb"]


def pooled(p: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(logit, attention, hidden, context) of windows with states (T, B, 2H)."""
    hidden = np.tanh(states @ p["wa"])
    s = hidden @ p["va"] + (mask - 1) * 1e4
    a = np.exp(s - s.max(axis=0))
    a /= a.sum(axis=0)
    context = np.einsum("tb,tbh->bh", a, states)
    return context @ p["wo"] + p["bo"], a, hidden, context


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n words, the last one ending with the text."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(a, a + WINDOW) for a in starts]


def _batch(docs: list[np.ndarray], spots: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (T, B) and mask of windows (document, start, end)."""
    wide = max(b - a for _, a, b in spots)
    at, mask = np.zeros((wide, len(spots)), np.int64), np.zeros((wide, len(spots)), np.float32)
    for j, (d, a, b) in enumerate(spots):
        at[: b - a, j] = docs[d][a:b]
        mask[: b - a, j] = 1
    return at, mask


def worst(p: dict, docs: list[np.ndarray], xf: np.ndarray, xb: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Highest window logit of each document (of word numbers), and that window."""
    best, where = np.full(len(docs), -np.inf, np.float32), [(d, 0, 0) for d in range(len(docs))]
    short = [(d, 0, len(w)) for d, w in enumerate(docs) if 0 < len(w) < WINDOW]
    full = [(d, a, b) for d, w in enumerate(docs) if len(w) >= WINDOW for a, b in windows(len(w))]
    for spots in (sorted(short, key=lambda s: s[2]), full):
        for i in range(0, len(spots), 1024):
            part = spots[i : i + 1024]
            if spots is full:
                lead = np.array([s[1] for s in part])
                flat = np.concatenate([docs[d][a:b] for d, a, b in part]).reshape(len(lead), WINDOW).T
                at, mask = flat, np.ones(flat.shape, np.float32)
            else:
                at, mask = _batch(docs, part)
            logit = pooled(p, gru.both(xf[at], xb[at], p["uf"], p["ub"], mask), mask)[0]
            for s, x in zip(part, logit.tolist()):
                if x > best[s[0]]:
                    best[s[0]], where[s[0]] = x, s
    return best, where


def _start(n_words: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, d = HIDDEN, WORD_DIM + CHAR_DIM
    mat = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    return {
        "words": (rng.standard_normal((n_words, WORD_DIM)) * 0.1).astype(np.float32), "chars": (rng.standard_normal((BUCKETS, CHAR_DIM)) * 0.3).astype(np.float32),
        "wf": mat(d, 3 * h), "wb": mat(d, 3 * h), "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32), "uf": mat(h, 3 * h), "ub": mat(h, 3 * h),
        "wa": mat(2 * h, ATTEND), "va": mat(ATTEND), "wo": mat(2 * h), "bo": np.zeros(1, np.float32),
    }


def _learn(p: dict, opt: gru.Adam, docs: list, spots: list, y: np.ndarray, known: np.ndarray, bucket: np.ndarray, at: np.ndarray, rng) -> None:
    """One pass over windows with labels ``y``, in batches."""
    for a in range(0, len(spots), 64):
        part, t = spots[a : a + 64], y[a : a + 64]
        number, mask = _batch(docs, part)
        uniq, local = np.unique(number, return_inverse=True)
        local = local.reshape(number.shape)
        # The grams of this batch's words only.
        size = at[uniq + 1] - at[uniq]
        own = np.cumsum(size) - size
        pick = np.repeat(at[uniq] - own, size) + np.arange(size.sum())
        b = bucket[pick]
        chars = np.add.reduceat(p["chars"][b], own, axis=0) / size[:, None].astype(np.float32)
        k = np.where(rng.random(len(uniq)) < 0.5, 0, known[uniq])  # half the words go without their own vector
        e, xf, xb = inputs(p, k, chars)
        keep: tuple[list, list] = ([], [])
        states = gru.both(xf[local], xb[local], p["uf"], p["ub"], mask, keep)
        logit, att, hidden, context = pooled(p, states, mask)
        d = ((gru.sigmoid(logit) - t) / len(part)).astype(np.float32)
        g = {"wo": context.T @ d, "bo": d.sum(keepdims=True)}
        dcontext = d[:, None] * p["wo"]
        dstates = att[:, :, None] * dcontext[None]
        da = np.einsum("tbh,bh->tb", states, dcontext)
        ds = att * (da - (att * da).sum(axis=0))
        g["va"] = np.einsum("tb,tba->a", ds, hidden)
        dh = ds[:, :, None] * p["va"] * (1 - hidden**2)
        g["wa"] = np.tensordot(states, dh, ([0, 1], [0, 1]))
        dstates += dh @ p["wa"].T
        dxf, dxb, g["uf"], g["ub"] = gru.both_back(dstates, p["uf"], p["ub"], mask, keep)
        de = np.zeros_like(e)
        for name, dx in (("f", dxf), ("b", dxb)):
            rows = np.zeros((len(uniq), 3 * HIDDEN), np.float32)
            np.add.at(rows, local.ravel(), dx.reshape(-1, 3 * HIDDEN))
            g["w" + name], g["b" + name] = e.T @ rows, rows.sum(axis=0)
            de += rows @ p["w" + name].T
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(g["words"], k, de[:, :WORD_DIM])
        dchars = de[:, WORD_DIM:] * (1 - np.tanh(chars) ** 2) / size[:, None]
        np.add.at(g["chars"], b, np.repeat(dchars, size, axis=0).astype(np.float32))
        opt.step(g)


def train(rows: list[tuple[str, int]], base: float, seed: int = 3) -> Model:
    """A model of (text, label) examples; ``base``: share of toxic ones among all labelled rows."""
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    if min(n) < 8:
        return Model(base=base)
    rng = np.random.default_rng(seed)
    tokens = [words(t) for t, _ in rows]
    y = np.array([v for _, v in rows], np.float32)
    fitting = np.arange(len(rows)) % 6 != 5
    held = Counter(w for i, t in enumerate(tokens) if fitting[i] for w in set(t))
    vocabulary = {w: k + 1 for k, w in enumerate(sorted(w for w, c in held.items() if c >= MIN_DOCUMENTS))}
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in tokens]
    known = np.array([vocabulary.get(w, 0) for w in number], np.int64)
    bucket, at = grams(list(number))
    p = _start(len(vocabulary) + 1, rng)
    opt = gru.Adam(p, 0.006)
    mine = [i for i in np.flatnonzero(fitting) if len(docs[i])]
    pos, neg = [i for i in mine if y[i] == 1], [i for i in mine if y[i] == 0]
    for epoch in range(WARM_UP + WORST):
        if epoch == WARM_UP + WORST - 3:
            opt.rate /= 3
        _, xf, xb = inputs(p, known, _means(p["chars"], bucket, at))
        spots, labels = [], []
        if epoch < WARM_UP:
            for i in mine:
                w = windows(len(docs[i]))
                for j in rng.permutation(len(w))[:6]:
                    spots.append((i, *w[j]))
                    labels.append(y[i])
        else:
            order = [*pos, *neg]
            _, where = worst(p, [docs[i] for i in order], xf, xb)
            for i, (_, a, b) in zip(order, where):
                spots.append((i, a, b))
                labels.append(y[i])
                w = windows(len(docs[i]))
                if y[i] == 0:  # and another one, as any window of such a document is clean
                    spots.append((i, *w[rng.integers(len(w))]))
                    labels.append(0.0)
        for _ in range(max(1, -(-STEPS * 64 // max(1, len(spots))))):  # a small sample is gone through again
            shuffle = rng.permutation(len(spots))
            _learn(p, opt, docs, [spots[j] for j in shuffle], np.array(labels, np.float32)[shuffle], known, bucket, at, rng)
    model = Model(p, vocabulary, (0.0, 1.0), base)
    rest = [i for i in np.flatnonzero(~fitting) if len(docs[i])]
    _, xf, xb = inputs(p, known, _means(p["chars"], bucket, at))
    logit = worst(p, [docs[i] for i in rest], xf, xb)[0].astype(float)
    model.curve = _curve(logit, y[rest], base, n[1] / sum(n))
    return model


def _curve(x: np.ndarray, y: np.ndarray, base: float, share: float) -> tuple[float, float]:
    """(constant, slope) of a logistic curve, moved from the sample's share of toxic documents to the base rate."""
    c, s = 0.0, 1.0
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(200):
        q = gru.sigmoid(c + s * x)
        w = q * (1 - q) + 1e-6
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, [(soft - q).sum(), ((soft - q) * x).sum()])
        c, s = c + float(np.clip(step[0], -1, 1)), max(0.05, s + float(np.clip(step[1], -0.5, 0.5)))
        if np.abs(step).max() < 1e-7:
            break
    odds = lambda v: np.log(v / (1 - v))
    clip = lambda v: min(max(v, 1e-4), 1 - 1e-4)
    return c + float(odds(clip(base)) - odds(clip(share))), s


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """Probability that each text is toxic: of its worst window, over all of them."""
    out = np.full(len(texts), model.base / 2)
    number = _Numbers()
    docs = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in map(words, texts)]
    if not number or not model.able:
        return out
    vocabulary = list(number)
    known = np.fromiter((model.words.get(w, 0) for w in vocabulary), np.int64, len(vocabulary))
    xf, xb = (np.empty((len(vocabulary), 3 * HIDDEN), np.float32) for _ in range(2))
    for a in range(0, len(vocabulary), 8192):
        bucket, at = grams(vocabulary[a : a + 8192])
        _, xf[a : a + 8192], xb[a : a + 8192] = inputs(model.p, known[a : a + 8192], _means(model.p["chars"], bucket, at))
    has = np.array([len(d) > 0 for d in docs])
    logit, _ = worst(model.p, docs, xf, xb)
    out[has] = gru.sigmoid(model.curve[0] + model.curve[1] * logit[has].astype(float))
    return out


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a = batch.column(1).to_pylist(), 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and size < SLICE:
                    size += len(texts[b] or "")
                    b += 1
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(scores(model, texts[a:b]), pa.float64())], names=["doc_id", "score"])
                a = b

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows = common.labelled_sample(spark, docs, labels, "toxic", per_class)
    counts = {r[0]: r[1] for r in labels.where(F.col("toxic").isin(0, 1) & (common.bucket(F.col("doc_id"), 5) != 0)).groupBy("toxic").count().collect()}
    yes, no = counts.get(1, 0), counts.get(0, 0)
    return train([(r["text"] or "", r["label"]) for r in rows], (yes + 1) / (yes + no + 2))


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


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, fit(spark, docs, common.table(spark, sf_dir, "labels")))
