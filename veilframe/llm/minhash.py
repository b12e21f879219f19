"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct shingles of ``width`` words. Each of
``REGISTERS`` buckets has a salted hash of its own; the smallest hash of the set is
stored as its count of leading zeros (6 bits) and the 10 bits behind the leading one.
Equal registers, less the expected share of chance collisions, estimate the
Jaccard similarity. Registers in bands make buckets of candidates.

How groups of any size stay cheap and whole:

1. Texts of the same words in the same order (by a cryptographic digest of 128 bits)
   are one vertex. Vertices are texts, not ids, so an id on rows of unlike texts is
   several; a vertex is numbered in the order of its smallest id.
2. In each bucket, members are compared with one hub, the smallest vertex,
   so a bucket of n gives n pairs. Links found that way are contracted to components.
3. Only pairs of *different* components within a bucket are left. Of two sets of n and m
   shingles that are similar enough, the rarest n - ceil(t n) + 1 and m - ceil(t m) + 1 share
   one (prefix filter, exact). Members that share such a shingle are compared by their
   sets as a matrix product, group by group, or in groups of over ``BLOCK`` members
   shingle by shingle; no pair becomes a row unless it is a link.

Every link is confirmed on the full sets of both texts: those with a hub if they pass
the estimate (a margin of over six standard errors below the threshold), the others
once their sets of hashes meet the threshold. Keys that hold a large share of the rows
are dealt to several tasks (``common.salted_join``).

Defined results: null or wordless text: empty set, linked with nothing; fewer words
than ``width``: the whole sequence is the one shingle; A-Z only are lower-cased;
words are ``[^\\x20\\x09-\\x0D]+``; repeated rows are copies; a row of null id takes
part in no link and is kept, its component null; where an id stands on unlike texts, each
row has the component of its text; an empty table gives an empty result; other columns
pass through. A text is hashed in pieces of about 1 MiB; its set is held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm import common
from veilframe.llm.common import cut, discard, salted_join
from veilframe.llm.components import components

REGISTERS = 96
ROWS = 4  # registers of a band: with 24 bands a pair of similarity 0.8 is missed with probability 3e-6
MANTISSA = 10
#: Bytes of text that are hashed at once.
SLICE = 1 << 20
#: How far below the threshold an estimate may lie: over six standard errors of 96 registers.
MARGIN = 0.26

_P = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (finaliser of a public-domain generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SALTS = _mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE * 2)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            have = _POWERS[0] = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, p)])) for p in (_P, inverse))
    return have


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and where each text's words begin (one entry more than texts)."""
    blob = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    blank = _BLANK[blob]
    first = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    last = np.flatnonzero(blank[1:] & ~blank[:-1])
    up, down = _powers(len(blob))
    total = np.cumsum((_LOWER[blob].astype(np.uint64) + np.uint64(1)) * up[: len(blob)])
    h = (total[last] - total[first - 1]) * down[first]
    return _mix(h ^ (last - first).astype(np.uint64)), np.searchsorted(first, starts)


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in pieces of about ``SLICE`` bytes that end between words."""
    a = 0
    while a < len(text):
        gap = _GAP.search(text, a + SLICE)
        b = gap.start() if gap else len(text)
        yield text[a:b]
        a = b


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes``, of a single long text piece by piece."""
    if len(texts) == 1 and len(texts[0]) > SLICE:
        words = np.concatenate([word_hashes([p])[0] for p in pieces(texts[0])])
        return words, np.array([0, len(words)])
    return word_hashes(texts)


def digest(text: bytes) -> bytes:
    """What texts of the same lower-cased words in the same order have in common, and no others."""
    h = hashlib.blake2b(digest_size=16)
    for p in pieces(text):
        if words := p.lower().split():
            h.update(b" ".join(words) + b" ")
    return h.digest()


def shingle_hashes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    with np.errstate(over="ignore"):
        words, at = _words(texts)
        weights = _mix(np.arange(11, 11 + width, dtype=np.uint64))
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(width):
            rolled += _mix(words[j : j + n] * weights[j] + np.uint64(j))
        rolled = _mix(rolled)
        out = []
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                whole = _mix(words[a:b] * weights[: b - a] + np.uint64(77)).sum(dtype=np.uint64)
                out.append(np.array([_mix(np.array([whole]))[0] ^ np.uint64(b - a)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (uint16) of nonempty sets, a row each."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((len(sets), REGISTERS), np.uint64)
    with np.errstate(over="ignore"):
        for j, salt in enumerate(_SALTS):
            v = (flat ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
            v ^= v >> np.uint64(32)
            v *= np.uint64(0x94D049BB133111EB)
            low[:, j] = np.minimum.reduceat(v, at)
    return compress(low)


def compress(low: np.ndarray) -> np.ndarray:
    """Smallest hashes as (leading zeros, mantissa), 6 and 10 bits."""
    zeros = np.minimum(53 - np.frexp((low >> np.uint64(11)).astype(np.float64))[1], 53).astype(np.uint64)
    mantissa = ((low << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of unrelated sets of n and m shingles agree (published approximation)."""
    return 0.169919487159739 * 2.0**-MANTISSA * 4 * n * m / (n + m) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows a and b, corrected for chance collisions."""
    c = collision_rate(n.astype(float), m.astype(float))
    return np.maximum(0.0, ((a == b).mean(axis=1) - c) / (1 - c))


def slices(texts: list, size: int = SLICE) -> Iterator[list[int]]:
    """Runs of indices whose texts have about ``size`` bytes together."""
    run, n = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        n += len(t)
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def encoded(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


_SIGNED = "id long, row long, n long, d1 long, d2 long, sig binary"


def _sign(width: int):
    schema = pa.schema([(c, pa.binary() if k == "binary" else pa.int64()) for c, k in (x.split() for x in _SIGNED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(2))
            for part in slices(texts):
                own = [texts[i] for i in part]
                sets = shingle_hashes(own, width)
                full = [k for k, s in enumerate(sets) if len(s)]
                sig = registers([sets[k] for k in full]) if full else None
                sigs: list = [None] * len(sets)
                for row, k in enumerate(full):
                    sigs[k] = sig[row].tobytes()
                d = np.frombuffer(b"".join(map(digest, own)), np.int64).reshape(-1, 2)
                at = pa.array(part)
                cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sigs, pa.binary())]
                yield pa.record_batch(cols, schema=schema)

    return run


def _spell(width: int):
    """(v, shingle hash) of each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), encoded(batch.column(1))
            for part in slices(texts):
                sets = shingle_hashes([texts[i] for i in part], width)
                who = np.repeat(ids[part], [len(s) for s in sets])
                yield pa.record_batch([pa.array(who), pa.array(np.concatenate(sets).view(np.int64))], names=["v", "h"])

    return run


def _pack(width: int):
    """(v, its set of shingle hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), encoded(batch.column(1))
            for part in slices(texts):
                sets = shingle_hashes([texts[i] for i in part], width)
                yield pa.record_batch([ids.take(pa.array(part)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["v", "hashes"])

    return run


def _plausible(num: int, den: int):
    """Keeps candidate pairs whose sizes allow the similarity and whose estimate comes near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            ok = (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (estimate(sa, sb, na, nb) >= num / den - MARGIN)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def shingle_set(text: bytes, width: int) -> frozenset:
    words = text.lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[j:] for j in range(width))))


def _confirm(width: int, num: int, den: int):
    """Keeps pairs with den * |A and B| >= num * |A or B| on the full sets of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[bytes, frozenset]] = {}

        def of(side: int, text: bytes) -> frozenset:
            if side not in last or last[side][0] != text:
                last[side] = (text, shingle_set(text, width))
            return last[side][1]

        for batch in batches:
            ta, tb = encoded(batch.column(2)), encoded(batch.column(3))
            ok = []
            for x, y in zip(ta, tb):
                a, b = of(0, x), of(1, y)
                both = len(a & b)
                ok.append(den * both >= num * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links_within(block: list[tuple], num: int, den: int, across: bool) -> Iterator[tuple[int, int]]:
    """Links between different labels among rows (own, v, label, hashes), as many as join what is linked; ``across``: only from block to block."""
    sets = [r[3] for r in block]
    sizes = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    number = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    row, column = row[shared], number[column[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, [a, a + 2048])
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    total = sizes[:, None] + sizes[None, :] - both
    near = np.triu(den * both >= num * total, 1)
    label, own = np.array([r[2] for r in block]), np.array([r[0] for r in block])
    near &= label[:, None] != label[None, :]
    if across:
        near &= own[:, None] != own[None, :]
    root = {int(x): int(x) for x in label}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(near)):
        p, q = find(int(label[i])), find(int(label[j]))
        if p != q:
            root[max(p, q)] = min(p, q)
            yield block[i][1], block[j][1]


def _compare(num: int, den: int):
    """Links within the groups (g, lo, hi), which come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, []

        def out() -> pa.RecordBatch:
            pairs = list(_links_within(block, num, den, at[1] != at[2])) if len({r[2] for r in block}) > 1 else []
            return pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for g, lo, hi, own, v, label, hashes in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (g, lo, hi) != at:
                    if block:
                        yield out()
                    at, block = (g, lo, hi), []
                block.append((own, v, label, np.frombuffer(hashes, np.uint64)))
        if block:
            yield out()

    return run


#: Members of a group that are compared at once.
BLOCK = 256
_PAIR = "a long, b long"


class NearDuplicates:
    """Components of near-duplicate documents of ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100):
        self.width, self.num, self.den = width, num, den
        common.text_batches(docs.sparkSession)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("row"), "text")
        self.signed = cut(self.docs.mapInArrow(_sign(width), _SIGNED))
        able = self.signed.where("n > 0 and id is not null")
        texts = able.groupBy("d1", "d2", "n", "sig").agg(F.min("id").alias("id"), F.min_by("row", "id").alias("row"))
        # Numbers in the order of ids: the smallest vertex of a component has its smallest id.
        self.reps = cut(texts.orderBy("id", "d1", "d2").withColumn("v", F.monotonically_increasing_id()))

    def _bands(self) -> DataFrame:
        """(key, v, hub) for buckets of two vertices at least; the hub is the smallest."""
        size = 2 * ROWS
        keys = self.reps.select(
            "v",
            F.explode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * size + 1, F.lit(size))))).alias("key"),
        )
        shared = cut(keys.groupBy("key").agg(F.min("v").alias("hub"), F.max("v").alias("hi")).where("hub < hi").select("key", "hub"))
        bands = cut(salted_join(keys, shared, "key", ["v"]))
        discard(shared)
        return bands

    def _texts(self, of: DataFrame) -> DataFrame:
        """(v, text) of the vertices ``of`` (v)."""
        wanted = cut(self.reps.join(of, "v", "left_semi").select("v", "id", "row"))
        out = cut(self.docs.join(common.few(wanted), ["id", "row"]).groupBy("v").agg(F.min("text").alias("text")))
        discard(wanted)
        return out

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) whose sizes and registers do not rule a link out."""
        sig = {c: self.reps.select(F.col("v").alias(c), F.col("n").alias("n" + c), F.col("sig").alias("s" + c)) for c in "ab"}
        both = salted_join(pairs.join(sig["a"], "a"), sig["b"], "b", ["a"], counted=pairs)
        return cut(both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_plausible(self.num, self.den), _PAIR))

    def _confirmed(self, near: DataFrame) -> DataFrame:
        """Those pairs (a, b) that are links on the full sets of their texts."""
        texts = self._texts(near.select(F.col("a").alias("v")).union(near.select("b")).distinct())
        ta, tb = (texts.select(F.col("v").alias(c), F.col("text").alias("t" + c)) for c in "ab")
        both = salted_join(near.join(ta, "a"), tb, "b", ["a"], counted=near)
        out = cut(both.select("a", "b", "ta", "tb").mapInArrow(_confirm(self.width, self.num, self.den), _PAIR))
        discard(texts)
        return out

    def components(self) -> DataFrame:
        """(id, component) of the vertices that have a link."""
        bands = self._bands()
        pairs = cut(bands.where("v <> hub").select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct())
        near = self._near(pairs)
        links = self._confirmed(near)
        labels = components(links)
        torn = self._torn(bands, labels)
        discard(bands, pairs, near)
        if torn.isEmpty():
            discard(torn, links)
            return labels
        found = self._rest(torn)
        out = labels
        if not found.isEmpty():
            out = components(links.unionByName(found))
            discard(labels)
        discard(torn, found, links)
        return out

    @staticmethod
    def _torn(bands: DataFrame, labels: DataFrame) -> DataFrame:
        """(hub, v, label) of the buckets whose members lie in different components."""
        named = cut(bands.join(labels.withColumnRenamed("id", "v"), "v", "left").select("key", "hub", "v", F.coalesce("component", "v").alias("label")))
        torn = cut(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"))
        out = cut(salted_join(named, torn, "key", ["v"], "left_semi").select("hub", "v", "label").distinct())
        discard(named, torn)
        return out

    def _rest(self, torn: DataFrame) -> DataFrame:
        """Links (a, b) between different labels within a hub's buckets, as many as join what is linked."""
        texts = self._texts(torn.select("v").distinct())
        spelled = cut(texts.mapInArrow(_spell(self.width), "v long, h long"))
        held = cut(spelled.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        # Rarest first; shingles that no other member has go first of all, and lead to nobody.
        ranked = salted_join(spelled, held, "h", ["v"], "left").withColumn(
            "r", F.row_number().over(Window.partitionBy("v").orderBy(F.col("k").asc_nulls_first(), "h"))
        )
        size = self.reps.select("v", (F.col("n") - F.ceil(F.col("n") * self.num / self.den) + 1).alias("most"))
        prefix = cut(ranked.where("k is not null").join(size, "v").where("r <= most").select("v", "h"))
        rows = cut(torn.join(prefix, "v").select("hub", F.xxhash64("hub", "h").alias("g"), "v", "label"))
        mixed = cut(rows.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("f")).where("lo < hi").select("g", "f"))
        able = cut(salted_join(rows, mixed, "g", ["v"]))
        members = cut(able.select("hub", "v", "label").distinct())
        sizes = cut(members.groupBy("hub").agg(F.count(F.lit(1)).alias("m")))
        small = members.join(sizes.where(F.col("m") <= BLOCK).select("hub"), "hub", "left_semi")
        whole = small.select(F.col("hub").alias("g"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("own"), "v", "label")
        large = salted_join(able, sizes.where(F.col("m") > BLOCK).select("hub"), "hub", ["v"], "left_semi")
        nb = F.ceil(F.col("f") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("v"), nb).cast("int")
        spread = large.select("g", "v", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), nb - 1)).alias("other"))
        parts = spread.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "v", "label")
        sets = cut(texts.join(members.select("v").distinct(), "v", "left_semi").mapInArrow(_pack(self.width), "v long, hashes binary"))
        dealt = whole.unionByName(parts).join(sets, "v").select("g", "lo", "hi", "own", "v", "label", "hashes")
        dealt = dealt.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "own", "v")
        near = cut(dealt.mapInArrow(_compare(self.num, self.den), _PAIR).distinct())
        discard(texts, spelled, held, prefix, rows, mixed, able, members, sizes, sets)
        found = self._confirmed(near)
        discard(near)
        return found

    def membership(self) -> DataFrame:
        """(id, row, n, v, root, component) of every row: its vertex, the smallest of its component, and that one's id."""
        found = self.components()
        roots = self.reps.select(F.col("v").alias("root"), F.col("id").alias("component"))
        named = cut(self.reps.select("d1", F.col("d2").alias("e2"), "v").join(found.withColumnRenamed("id", "v"), "v", "left").select("d1", "e2", "v", F.coalesce("component", "v").alias("root")))
        classes = cut(salted_join(named, roots, "root", ["v"]))
        discard(found, named)
        able = self.signed.select("id", "row", "n", "d1", "d2").where("n > 0 and id is not null")
        linked = salted_join(able, classes, "d1", ["id"]).where("d2 = e2").select("id", "row", "n", "v", "root", "component")
        alone = self.signed.where("n = 0 or id is null")
        none = F.lit(None).cast("long")
        return linked.unionByName(alone.select("id", "row", "n", none.alias("v"), none.alias("root"), F.col("id").alias("component")))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    return NearDuplicates(docs, width, num, den).membership().select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one text of each group, that of the smallest id; repeated rows of that text and id all stay.

    Rows go by id and text, so an unlike text under the id of one that goes stays. What goes is
    written first, and broadcast where it is small, so texts are not shuffled then.
    """
    key, row = common.fresh(docs, "gone", "row")
    lost = NearDuplicates(docs, width, num, den).membership().where("v <> root or id <> component").select(F.col("id").alias(key), F.col("row").alias(row)).distinct()
    gone = common.few(cut(lost))
    return docs.join(gone, (docs["doc_id"] == gone[key]) & (F.xxhash64(docs["text"]) == gone[row]), "left_anti")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 3-word shingles, its component at similarity 0.85 and whether it stays."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), 3, 85, 100)
