"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models, one of a target corpus (documents labelled good) and
one of the background (all documents). Both count every token of their corpus, share one
vocabulary and their smoothing, and are matched in size: background counts are scaled to the
target's number of tokens, as a sample of that size would have them on average. A document
is scored without itself: what it added to a model is taken off first. Its score is
the mean over its tokens of the target loss less the background
loss: lower means more like the target than the corpus at large is.

Words and pairs of words are counted under 63-bit hashes and one bit that tells the two
apart, in a table that grows with the corpus; nothing of it is broadcast or sent to the
driver. Tasks cut their rows into chunks of about ``CHUNK`` bytes and send the distinct
hashes of each with their counts, packed by bucket of leading hash bits (the number of
buckets follows the text). Each bucket adds up its counts and answers every chunk in the
order of its hashes, and the answers meet the texts of the chunk. Where other documents
are scored than were counted, chunks send the hashes they ask for
in the same way (such documents added nothing, so nothing is taken off). Sending and scoring cut the rows of ``docs`` into chunks independently,
so its partitions must be reproducible, as those of files are; a chunk whose answers do
not fit its texts is an error.

Whether a document is target is joined: by a broadcast of the ids where there are at most
``BROADCAST_IDS``, else by a shuffle, whose result is written first so that it can be read alike twice.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text
without words, or null, has 0 tokens, null losses and score 0; without target
documents the target model knows nothing but smoothing, and nothing is scaled; repeated rows count and
are scored each; an id labelled good on any row is target; a null doc_id is background;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import common
from veilframe.llm.minhash import _mix, encoded, slices, word_hashes

#: Words that the uniform estimate reckons with at least; beyond that, those of the background.
WORDS = 1 << 18
#: Weight of the unigram estimate in a bigram's, in tokens, and of the uniform one in a unigram's.
BACKOFF, UNIFORM = 8.0, 0.1
BROADCAST_IDS = 1_000_000
#: Bytes of text of a chunk, and those that a bucket of hashes stands for, about.
CHUNK, BUCKET = 12 << 20, 4 << 20

_COUNTS = "bucket int, chunk long, n int, keys binary, t binary, b binary"
_ANSWERS = "chunk long, bucket int, n long, mark long, t binary, b binary"
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
_LAST = 2**31 - 1


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word keys in order, the pair key of each with its predecessor, whether it begins a text, and where texts begin."""
    with np.errstate(over="ignore"):
        h, at = word_hashes(texts)
        before = np.concatenate([[np.uint64(0)], h[:-1]]) if len(h) else h
        pair = _mix(before * np.uint64(0x9E3779B97F4A7C15) + h)
    first = np.zeros(len(h), bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    return h | np.uint64(1), pair & ~np.uint64(1), first, at


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of words and pairs in order, and how often each stands."""
    found = [np.zeros(0, np.uint64)]
    for part in slices(texts):
        w, pair, first, _ = hashes([texts[i] for i in part])
        found += [w, pair[~first]]
    return np.unique(np.concatenate(found), return_counts=True)


def pack(a: np.ndarray) -> bytes:
    """64-bit numbers, byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(b, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, -1).T).view(kind).ravel()


def _pack_keys(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def _unpack_keys(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, n, np.uint64), dtype=np.uint64)


def _mark(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys).view(np.int64)) if len(keys) else 0


def _runs(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted keys, and where those of each are."""
    if not bits:
        at = np.array([0, len(keys)])
    else:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    for k in np.flatnonzero(at[1:] > at[:-1]):
        yield int(k), slice(at[k], at[k + 1])


def _name(texts: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(texts), digest_size=8).digest()) >> 1


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[bytes], pa.Array]]:
    """(chunk, texts, the other column) of all rows; a chunk is named by a hash of its texts."""
    texts, others, kind, size = [], [], None, 0
    for batch in batches:
        own, other, a = encoded(batch.column(column)), batch.column(1 - column), 0
        kind = other.type
        for i, t in enumerate(own):
            size += len(t)
            if size >= CHUNK:
                texts += own[a : i + 1]
                yield _name(texts), texts, pa.chunked_array([*others, other.slice(a, i + 1 - a)], kind).combine_chunks()
                texts, others, a, size = [], [], i + 1, 0
        texts += own[a:]
        others.append(other.slice(a))
    if texts:
        yield _name(texts), texts, pa.chunked_array(others, kind).combine_chunks()


def _count(bits: int) -> object:
    """Packed counts of the chunks of (key, text); key is (doc_id, whether it is target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts, key in _chunks(batches, 1):
            target = key.field("target").to_numpy(zero_copy_only=False)
            keys, b = _keys(texts)
            some, times = _keys([texts[i] for i in np.flatnonzero(target)])
            t = np.zeros(len(keys), np.int64)
            t[np.searchsorted(keys, some)] = times
            rows = [(k, chunk, s.stop - s.start, _pack_keys(keys[s]), pack(t[s]), pack(b[s])) for k, s in _runs(keys, bits)]
            yield from _batches(rows, _COUNTS)

    return run


def _ask(bits: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts, _ in _chunks(batches, 1):
            keys, _ = _keys(texts)
            yield from _batches([(k, chunk, s.stop - s.start, _pack_keys(keys[s]), None, None) for k, s in _runs(keys, bits)], _COUNTS)

    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _batches(rows: list[tuple], schema: str, size: int = 1000) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in schema.split(", ")]
    for a in range(0, len(rows), size):
        yield pa.record_batch([pa.array([r[j] for r in rows[a : a + size]], _ARROW[kind]) for j, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _answer(table: pa.Table) -> pa.Table:
    """The counts of a bucket for every chunk that asks; and as chunk -1 its words and their counts."""
    rows = list(zip(*(c.to_pylist() for c in table.select(["bucket", "chunk", "n", "keys", "t", "b"]).columns)))
    counts = [r for r in rows if r[4] is not None]
    every = np.concatenate([np.zeros(0, np.uint64), *(_unpack_keys(r[3], r[2]) for r in counts)])
    keys, where = np.unique(every, return_inverse=True)
    # Sums of whole numbers in doubles: exact up to 2^53.
    t, b = (np.bincount(where, np.concatenate([np.zeros(0, np.int64), *(unpack(r[j], r[2]) for r in counts)]), len(keys)).astype(np.int64) for j in (4, 5))
    out, bucket = [], rows[0][0]
    word = (keys & np.uint64(1)).astype(bool)
    if len(keys):
        out.append((-1, bucket, int(word.sum()), 0, pack(t[word].sum(keepdims=True)), pack(b[word].sum(keepdims=True))))
    for _, chunk, n, packed, _, _ in rows:
        if chunk is not None:
            asked = _unpack_keys(packed, n)
            at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
            hit = keys[at] == asked if len(keys) else np.zeros(n, bool)
            own = [np.where(hit, x[at], 0) if len(keys) else np.zeros(n, np.int64) for x in (t, b)]
            out.append((chunk, bucket, n, _mark(asked), pack(own[0]), pack(own[1])))
    return pa.Table.from_batches(list(_batches(out, _ANSWERS)))


@dataclass
class Counts:
    """Packed counts of both corpora, not yet added up, the bits that choose a bucket, the documents counted, and those with the flag."""

    rows: DataFrame
    bits: int
    docs: DataFrame
    flagged: DataFrame


def _keyed(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.struct("doc_id", "target").alias("key"), "text")


def fit(docs: DataFrame, target: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> Counts:
    """The counts of ``docs`` (doc_id, text), of which those in ``target`` (doc_id) are the target corpus."""
    common.text_batches(docs.sparkSession)
    ids = target.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // BUCKET).bit_length())
    small = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    met = own.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), "doc_id", "left")
    flagged = met.select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")
    if not small:
        flagged = common.cut(flagged)
    return Counts(_keyed(flagged).mapInArrow(_count(bits), _COUNTS), bits, docs, flagged)


class Losses:
    """The losses of tokens under both models, from the words of the background and the tokens of each corpus."""

    def __init__(self, words: int, totals: tuple[int, int]):
        self.words, self.totals = max(WORDS, words), totals
        self.scale = 1.0, totals[0] / totals[1] if totals[0] else 1.0

    def of(self, texts: list[bytes], keys: np.ndarray, counts: tuple[np.ndarray, np.ndarray], added: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and the summed loss (target, background) of each.

        ``counts`` are those of ``keys``; ``added`` tells of each text whether it is among what either model counted.
        """
        w, pair, first, at = hashes(texts)
        n = np.diff(at)
        if not len(w):
            return n, np.zeros((2, len(texts)))
        whose = np.repeat(np.arange(len(texts)), n)
        w = np.searchsorted(keys, w)
        pair = np.searchsorted(keys, np.where(first, keys[w], pair))
        # How often a text holds each of its own words and pairs; keys of words and of pairs differ.
        size = len(keys)
        own, where, times = np.unique(np.concatenate([whose * size + w, (whose * size + pair)[~first]]), return_inverse=True, return_counts=True)
        own_w = times[where[: len(w)]]
        own_pair = np.zeros(len(w), np.int64)
        own_pair[~first] = times[where[len(w) :]]
        before, own_before = np.concatenate([[0], w[:-1]]), np.concatenate([[0], own_w[:-1]])
        loss = np.empty((2, len(w) + 1))
        loss[:, 0] = 0
        for k in (0, 1):
            off = np.repeat(added[k], n).astype(np.int64)
            total = (self.totals[k] - off * np.repeat(n, n)) * self.scale[k]
            one = ((counts[k][w] - off * own_w) * self.scale[k] + UNIFORM) / (total + UNIFORM * self.words)
            two = ((counts[k][pair] - off * own_pair) * self.scale[k] + BACKOFF * one) / ((counts[k][before] - off * own_before) * self.scale[k] + BACKOFF)
            loss[k, 1:] = -np.log(np.where(first, one, two))
        ends = np.cumsum(loss, axis=1)
        return n, ends[:, at[1:]] - ends[:, at[:-1]]


def _texts() -> object:
    """The rows of (key, text) with their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts, key in _chunks(batches, 1):
            for part in slices(texts):
                own = key.take(pa.array(part))
                yield pa.record_batch([pa.array([chunk] * len(part), pa.int64()), own.field("doc_id"), own.field("target"), pa.array([texts[i] for i in part], pa.binary())], names=["chunk", "doc_id", "target", "text"])

    return run


def _score(losses: Losses, counted: bool) -> object:
    def scores(answers: list[tuple], ids: list, target: list[bool], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, _ = _keys(texts)
        if sum(a[0] for a in answers) != len(keys) or int(np.bitwise_xor.reduce(np.array([0, *(a[1] for a in answers)], np.int64))) != _mark(keys):
            raise RuntimeError("the documents to score were not dealt alike twice; write them first")
        counts = tuple(np.concatenate([np.zeros(0, np.int64), *(unpack(a[j], a[0]) for a in answers)]) for j in (2, 3))
        for part in slices(texts):
            added = np.array([target[i] and counted for i in part]), np.full(len(part), counted)
            n, loss = losses.of([texts[i] for i in part], keys, counts, added)
            none = n == 0
            mean = loss / np.maximum(n, 1)
            yield pa.record_batch(
                [pa.array([ids[i] for i in part], pa.int64()), pa.array(n, pa.int64()), pa.array(mean[0], mask=none), pa.array(mean[1], mask=none), pa.array(np.where(none, 0.0, mean[0] - mean[1]))],
                names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, ids, target, texts = None, {}, [], [], []
        for batch in batches:
            for chunk, bucket, n, mark, t, b, doc_id, flag, text in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now:
                    if texts or answers:
                        yield from scores(list(answers.values()), ids, target, texts)
                    now, answers, ids, target, texts = chunk, {}, [], [], []
                if bucket == _LAST:
                    ids.append(doc_id)
                    target.append(flag)
                    texts.append(text)
                else:
                    answers[bucket] = (n, mark, t, b)  # chunks of the same texts get the same answers
        if texts or answers:
            yield from scores(list(answers.values()), ids, target, texts)

    return run


def scored(docs: DataFrame, models: Counts) -> DataFrame:
    """doc_id, n_tokens, mean losses and their difference for every row of ``docs``."""
    common.text_batches(docs.sparkSession)
    same, rows = docs is models.docs, models.rows
    if same:
        docs = models.flagged
    else:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("target"), "text")
        rows = rows.withColumn("chunk", F.lit(None).cast("long")).unionByName(_keyed(docs).mapInArrow(_ask(models.bits), _COUNTS))
    # Written once: the totals below must be known before a token is scored.
    answers = common.cut(rows.groupBy("bucket").applyInArrow(_answer, _ANSWERS))
    sums = answers.where("chunk = -1").select("n", "t", "b").toLocalIterator()
    words, totals = 0, [0, 0]
    for r in sums:
        words += r["n"]
        totals = [totals[0] + int(unpack(r["t"], 1)[0]), totals[1] + int(unpack(r["b"], 1)[0])]
    rows = _keyed(docs).mapInArrow(_texts(), "chunk long, doc_id long, target boolean, text binary").withColumn("bucket", F.lit(_LAST))
    dealt = answers.where("chunk >= 0").unionByName(rows, allowMissingColumns=True).select("chunk", "bucket", "n", "mark", "t", "b", "doc_id", "target", "text")
    return dealt.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_score(Losses(words, tuple(totals)), same), _SCORES)


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the models of the documents labelled good and of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    good = common.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return scored(docs, fit(docs, good))
