"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised alike: lower case, every run of characters
that are neither letters nor digits is one space. An item of m characters found
within k edits shares at least m + 1 - q - k * q of its character q-grams with the
text, on diagonals (text position - item position) no further apart than k. Shared
q-grams are therefore counted in bands of 2k + 1 diagonals that overlap by k; bands
that meet the bound are verified by an alignment confined to the band. Counts are taken
per item first, then per band for some items at a time, so a phrase that many items and
many places share takes no more memory than another.

An item of fewer than ``MIN_CHARS`` normalised characters is evidence only where it stands
exactly and between words: an automaton of all such items finds these places.

The benchmark is the stated query set: its q-gram index goes to every task in blocks
of ``BLOCK_CHARS`` characters, ``PER_SCAN`` of them at a time (a checked bound; a larger benchmark
takes more scans). Documents are only scanned to find passages; ``clean`` shuffles them
only if the documents to go are too many to be broadcast.

Defined results: null items and those without a letter or digit
are no evidence and are left out; null and empty texts hold no match; a
row of null doc_id is reported with null; repeated rows each give their matches; of
equal items each is reported; an empty table gives an empty result; texts are scanned
whole in pieces that overlap by the longest item.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import common

Q = 8
#: Edits allowed, as a share of an item's characters (fewer where the lemma would lose its force).
EDITS = 0.08
#: Shorter items must stand exactly, as words of their own.
MIN_CHARS = 24
#: Characters of benchmark items in one broadcast block: about 32 bytes of index each; and blocks that one scan looks for.
BLOCK_CHARS, PER_SCAN = 1 << 20, 4
#: Shared q-grams of items and text that are laid out at once.
ENTRIES = 1 << 20
#: Characters scanned at once.
PIECE = 1 << 18
_BITS = 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Powers of the polynomial hash for spans of 1, 2 and 4 characters.
_BASES = [np.uint64(pow(0x100000001B3, 1 << j, 1 << 64)) for j in range(3)]
assert 1 << len(_BASES) == Q
_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Normal form of each code point of the basic plane: 32 for what separates."""
    if not _TABLE:
        low = [c.lower() for c in map(chr, range(1 << 16))]
        _TABLE.append(np.array([ord(l[0]) if c.isalnum() else 32 for c, l in zip(map(chr, range(1 << 16)), low)], np.uint32))
    return _TABLE[0]


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points, and the position of each in ``text``."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _table()
    code = np.where(raw < len(table), table[np.minimum(raw, len(table) - 1)], raw)
    for c in np.unique(raw[raw >= len(table)]).tolist():
        code[raw == c] = ord(chr(c).lower()[0]) if chr(c).isalnum() else 32
    space = code == 32
    keep = np.flatnonzero(~(space & np.concatenate([[True], space[:-1]])))
    return code[keep], keep


def grams(code: np.ndarray) -> np.ndarray:
    """Hash of the q-gram that begins at each position: doubled spans, so three steps for eight characters."""
    with np.errstate(over="ignore"):
        out = code.astype(np.uint64)
        for j, b in enumerate(_BASES):
            span = 1 << j
            out = out[:-span] + out[span:] * b if len(out) > span else out[:0]
        return out * _MULT


def budget(m: int) -> int:
    return max(0, min(math.floor(EDITS * m), (m - Q) // Q))


def _trim(code: np.ndarray) -> np.ndarray:
    return code[: len(code) - 1] if len(code) and code[-1] == 32 else code


def _text(code: np.ndarray) -> str:
    return code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class Index:
    """q-gram index of some benchmark items, and an automaton of the short ones."""

    def __init__(self, items: list[tuple]):
        known = [(i, c) for i, t in items if t is not None and len(c := _trim(normalise(t.strip())[0]))]
        items = [(i, c) for i, c in known if len(c) >= MIN_CHARS]
        short: dict[str, list] = {}
        for i, c in known:
            if len(c) < MIN_CHARS:
                short.setdefault(f" {_text(c)} ", []).append(i)
        self.automaton = None
        if short:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word, ids in short.items():
                self.automaton.add_word(word, (len(word), ids))
            self.automaton.make_automaton()
        self.ids = [i for i, _ in items]
        self.codes = [c for _, c in items]
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.k = np.array([budget(m) for m in self.m], np.int64)
        self.need = self.m + 1 - Q - self.k * Q
        g = [grams(c) for c in self.codes]
        flat = np.concatenate(g) if g else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(g)), [len(x) for x in g])
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in g])]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.item = self.owner[order].astype(np.int32)
        self.grams, self.at, number = np.unique(flat, return_index=True, return_inverse=True)
        self.at = np.concatenate([np.searchsorted(number[order], np.arange(len(self.grams))), [len(flat)]])
        self.number = number.astype(np.int32)  # of each gram of each item, in the items' order
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def candidates(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, lowest diagonal) of the bands that share enough q-grams with ``code``."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = grams(code)
        at = np.flatnonzero(self.bitmap[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return none
        where = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        hit = self.grams[where] == g[at]
        at, where = at[hit], where[hit]
        if not len(at):
            return none
        # How often each gram of the items stands in the text; hence what each item shares at most.
        places = np.bincount(where, minlength=len(self.grams))
        seen = np.flatnonzero(places)
        times = self.at[seen + 1] - self.at[seen]
        entry = np.repeat(self.at[seen] - np.cumsum(times) + times, times) + np.arange(times.sum())
        shared = np.bincount(self.item[entry], np.repeat(places[seen], times), len(self.m)).astype(np.int64)
        able = np.flatnonzero(shared >= self.need)  # no band has more than the text
        # Where in the text each gram stands, grouped by gram.
        at = at[np.argsort(where, kind="stable")]
        begin = np.cumsum(places) - places
        found, i = [none], 0
        while i < len(able):
            j = i + 1 + int(np.searchsorted(np.cumsum(shared[able[i + 1 :]]), ENTRIES - shared[able[i]], "right")) if shared[able[i]] < ENTRIES else i + 1
            found.append(self._bands(able[i:j], at, begin, places, len(code)))
            i = j
        return tuple(np.concatenate([f[n] for f in found]) for n in (0, 1))

    def _bands(self, items: np.ndarray, at: np.ndarray, begin: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, lowest diagonal) of the bands of ``items`` that hold enough: one item, or some with few shared grams."""
        lead = int(self.m.max())
        own = np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i in items])
        own = own[places[self.number[own]] > 0]
        wide = (size + lead) // (int(self.k[items].min()) + 1) + 2  # more bands than any item has
        counts, keys = None, np.zeros(0, np.int64)
        total = np.cumsum(places[self.number[own]])
        a = 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + ENTRIES, "right")))
            part = own[a:b]
            gram = self.number[part]
            times = places[gram]
            where = at[np.repeat(begin[gram] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            item = np.repeat(self.owner[part], times)
            diagonal = where - np.repeat(part - self.first[self.owner[part]], times) + lead
            step = self.k[item] + 1
            band = diagonal // step
            low = (band > 0) & (diagonal - band * step < self.k[item])  # also in the upper part of the band below
            row = np.searchsorted(items, item) * wide
            key = np.concatenate([row + band, (row + band - 1)[low]])
            if len(items) == 1:
                counts = np.bincount(key, minlength=wide) if counts is None else counts + np.bincount(key, minlength=wide)
            else:
                keys = np.concatenate([keys, key])
            a = b
        if len(items) == 1:
            keys = np.flatnonzero(counts) if counts is not None else keys
            counts = counts[keys] if counts is not None else keys
        else:
            keys, counts = np.unique(keys, return_counts=True)
        item, band = items[keys // wide], keys % wide
        ok = counts >= self.need[item]
        return item[ok], (band * (self.k[item] + 1))[ok] - lead

    def exact(self, code: np.ndarray) -> list[tuple[object, int, int]]:
        """(item id, start, end) of the short items that stand in ``code`` as words of their own."""
        if self.automaton is None:
            return []
        found = self.automaton.iter(f" {_text(_trim(code))} ")
        return [(i, end - n + 1, end - 1) for end, (n, ids) in found for i in ids]

    def matches(self, code: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of verified matches in ``code``; the best of those of an item that overlap."""
        item, low = self.candidates(code)
        if not len(item):
            return []
        found = []
        for part in np.array_split(np.arange(len(item)), -(-len(item) // 256)):
            it, lo = item[part], low[part]
            edits, end = align([self.codes[i] for i in it], code, lo, 2 * self.k[it] + 1, self.k[it], None)
            good = np.flatnonzero(edits <= self.k[it])
            if len(good):
                flipped = [self.codes[i][::-1] for i in it[good]]
                last = end[good]
                _, back = align(flipped, code, -self.k[it[good]], 2 * self.k[it[good]] + 1, self.k[it[good]], last)
                found += zip(it[good].tolist(), (last - back).tolist(), last.tolist(), edits[good].tolist())
        found.sort(key=lambda x: (x[0], x[3], x[1]))
        out: list[tuple[int, int, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        for x in found:
            spans = taken.setdefault(x[0], [])  # sorted, apart from one another
            n = bisect_left(spans, (x[1], x[2]))
            if (n == 0 or spans[n - 1][1] <= x[1]) and (n == len(spans) or x[2] <= spans[n][0]):
                spans.insert(n, (x[1], x[2]))
                out.append(x)
        return out


def align(items: list[np.ndarray], code: np.ndarray, low: np.ndarray, width: np.ndarray, k: np.ndarray, last: np.ndarray | None):
    """Least edits of each item within its band of diagonals, and where the text part ends.

    Without ``last`` the text part may begin anywhere in the band. With ``last`` the text is
    read backwards from there, and the part begins exactly there; ends are then lengths.
    """
    n, wide, longest = len(items), int(width.max()), max(map(len, items))
    m = np.array([len(i) for i in items])
    pad = np.zeros((n, longest), np.uint32)
    for r, i in enumerate(items):
        pad[r, : len(i)] = i
    w = np.arange(wide)
    outside = w[None, :] >= width[:, None]
    big = np.int32(1 << 20)
    if last is None:
        cost = np.zeros((n, wide), np.int32)
    else:
        cost = np.where(w[None, :] + low[:, None] >= 0, w[None, :] + low[:, None], big).astype(np.int32)
    cost[outside] = big
    final = np.full((n, wide), big, np.int32)
    for i in range(longest):
        t = i + low[:, None] + w[None, :]
        if last is not None:
            t = last[:, None] - 1 - t
        inside = (t >= 0) & (t < len(code))
        same = inside & (code[np.clip(t, 0, len(code) - 1)] == pad[:, i : i + 1])
        new = np.where(inside, cost + ~same, big).astype(np.int32)
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        new[outside] = big
        new = (np.minimum.accumulate(new - w, axis=1) + w).astype(np.int32)
        new[outside] = big
        cost = new
        done = m == i + 1
        final[done] = cost[done]
    best = final.argmin(axis=1)
    return final[np.arange(n), best], m + low + best


_FOUND = "doc_id long, row long, item_id long, start long, end long, edits long"


def _scan(indexes: list) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Index] = [i.value for i in indexes]
        for batch in batches:
            pending, size = [], 0
            for doc in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if doc[2]:
                    pending.append(doc)
                    size += len(doc[2])
                if size >= PIECE:
                    yield from _scan_docs(held, pending)
                    pending, size = [], 0
            yield from _scan_docs(held, pending)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "row", "item_id", "start", "end", "edits"])


def _scan_docs(indexes: list[Index], docs: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Matches of several texts, laid one behind another with a gap that no match bridges."""
    if not docs:
        return
    normal = [normalise(t) for _, _, t in docs]
    for ix in indexes:
        rows = []
        for (doc, row, _), (code, where) in zip(docs, normal):
            rows += [(doc, row, i, int(where[s]), int(where[e - 1]) + 1, 0) for i, s, e in ix.exact(code)]
        if ix.ids:
            rows += _passages(ix, docs, normal)
        if rows:
            yield _rows(rows)


def _passages(ix: Index, docs: list[tuple], normal: list[tuple]) -> Iterator[tuple]:
    lap = int(2 * ix.m.max())
    parts, starts, at = [], [], 0
    gap = np.zeros(int(ix.m.max()) + int(ix.k.max()) + Q, np.uint32)
    for code, _ in normal:
        starts.append(at)
        parts += [code, gap]
        at += len(code) + len(gap)
    whole = np.concatenate(parts)
    found: set[tuple] = set()
    for a in range(0, max(1, len(whole) - lap), PIECE):  # pieces of one very long text overlap by two longest items
        for item, s, e, edits in ix.matches(whole[a : a + PIECE + lap]):
            found.add((item, s + a, e + a, edits))
    for item, s, e, edits in sorted(found):
        d = int(np.searchsorted(starts, s + 1, "right")) - 1 if s >= 0 else 0
        where = normal[d][1]
        s, e = max(0, s - starts[d]), min(e - starts[d], len(where))
        if s < e:
            yield docs[d][0], docs[d][1], ix.ids[item], int(where[s]), int(where[e - 1]) + 1, edits


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    common.text_batches(spark)
    items = benchmark.select("item_id", "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    out = None
    for first in range(0, blocks, PER_SCAN):
        held = []
        for b in range(first, min(first + PER_SCAN, blocks)):
            block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
            held.append(spark.sparkContext.broadcast(Index([tuple(r) for r in block.orderBy("item_id", "text").collect()])))
        found = own.mapInArrow(_scan(held), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits): passages of ``docs`` that are benchmark items within the edit budget."""
    return _found(docs, benchmark).drop("row")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage (rows of null id stay).

    What goes is written first, and broadcast where it is small, so texts are not shuffled then.
    """
    key, row = common.fresh(docs, "gone", "row")
    found = _found(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias(key), F.col("row").alias(row)).distinct()
    gone = common.few(common.cut(found))
    return docs.join(gone, (docs["doc_id"] == gone[key]) & (F.xxhash64(docs["text"]) == gone[row]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in ``documents``: where it stands and how many edits away it is."""
    return contaminations(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
