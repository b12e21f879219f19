"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a public SentencePiece model span a lattice over a text. Their scores
are log probabilities: the model's own if it has them (a unigram model); a model made by
merging has ranks instead, and a piece of rank r gets the probability that Zipf's law gives
it, proportional to 1 / (r + ``ZIPF``). A forward Viterbi pass gives the best score of every prefix; these are exact
heuristics for an A* search that runs backwards from the end of the text, so the
search pops complete segmentations in order of score. No piece crosses the start of
a word (checked when the model is loaded), so the lattice of a text is a chain of
lattices of chunks: the best segmentation is the chain of the chunks' best ones, and
a text's N best differ from it in at most N - 1 chunks, those of the smallest loss.
A forward and a backward pass find each distinct chunk's loss; A* runs on those few.

A merging model's own encoder merges greedily; the best segmentation here is the most
probable one, which is the same for four words of five or more. Ids are the model's, and its own
decoder gives the text back. Encoding is lossless: a space is the model's word mark, characters that no piece
holds become byte pieces, and a literal word mark in a text is encoded as bytes.

Defined results: null text: no ids (an empty list), no alternatives; the empty text
likewise; equal scores are ordered by where they differ first; repeated rows are
encoded one by one; an empty table gives an empty result; texts are encoded whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import common

MARK = "▁"
#: Added to the lowest score for a character that no piece holds.
UNKNOWN = -10.0
N_BEST = 4
#: Scores are whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: Offset of the ranks of a merging model.
ZIPF = 30
#: Chunks a worker remembers, at most (about 250 bytes each).
MEMO = 300_000


#: Ways to cut a text into chunks: words apart from other characters, or at spaces only; a word mark always stands alone.
_CUTS = (f"{MARK}| *[^\\W\\d_]+| *(?:[^\\w {MARK}]|[\\d_])+| +", f"{MARK}| *[^ {MARK}]+| +")
#: Chunks of up to so many characters are looked at in arrays, so many at once.
_WIDE, _ROWS = 40, 2048
_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h + ord(c) + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


def default_model() -> str:
    """Path of the public 32k model of this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces, scores and byte pieces of a model; small enough to broadcast (tens of thousands of rows)."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], control: set[int]):
        self.surface = [b"" if i in control else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(byte_ids):
            self.surface[i] = bytes([b])
        skip = control | set(byte_ids)
        self.byte_ids = byte_ids
        # In whole units, so that sums are exact and ties are ties in whatever order they are added up.
        scores = [round(x * UNIT) / UNIT for x in scores]
        self.edge = {p.replace(MARK, " "): (scores[i], (i,)) for i, p in enumerate(pieces) if i not in skip and p}
        # The finest cut that no piece crosses: a boundary depends on two characters only, so a crossing piece would be cut itself.
        self.chunks = next((c for c in map(re.compile, _CUTS) if all(len(c.findall(p)) == 1 for p in self.edge)), None)
        if self.chunks is None:
            raise ValueError("pieces of this model cross the start of a word")
        self.prefixes = {p[:n] for p in self.edge for n in range(1, len(p) + 1)}
        self.unknown = min((s for s, _ in self.edge.values()), default=0.0) + UNKNOWN
        # Chunks known so far, by number: where their ids lie in the pool, how many, their score, loss and last use.
        self.memo: dict[str, int] = {}
        self.pool, self.off, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score, self.loss, self.used, self.turn = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0
        self.uses = np.zeros(0, np.int64)
        self.searched: dict[tuple[str, int], list] = {}
        # For whole batches of chunks: hashes of prefixes, and of pieces in order with their scores and ids.
        hashed = sorted((_hash(p), *self.edge[p]) for p in self.edge)
        self.hashes = np.array([h for h, _, _ in hashed], np.uint64)
        self.hash_score, self.hash_id = np.array([x for _, x, _ in hashed], float), np.array([i[0] for _, _, i in hashed], np.int32)
        self.prefix_bits = np.zeros(1 << _BITS, bool)
        slots = (self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)
        self.slot = np.zeros(1 << _BITS, np.int32)
        self.slot[slots] = np.arange(len(slots))
        self.clash = {int(h): n for n, h in enumerate(self.hashes.tolist()) if self.slot[slots[n]] != n}
        self.clash_bits = np.zeros(1 << _BITS, bool)
        self.clash_bits[[h >> (64 - _BITS) for h in self.clash]] = True
        self.prefix_bits[[_hash(p) >> (64 - _BITS) for p in self.prefixes]] = True
        self.longest = max(map(len, self.edge), default=1)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no byte pieces")
        control = {i for i in n if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls([sp.id_to_piece(i) for i in n], log_probabilities([sp.get_score(i) for i in n], control | set(byte_ids)), byte_ids, control)

    def split(self, text: str | None) -> list[str]:
        return self.chunks.findall(" " + text) if text else []

    def remember(self, chunks: list[str], ids: np.ndarray, counts: np.ndarray, score: np.ndarray, loss: np.ndarray) -> None:
        known = len(self.off)
        self.memo.update(zip(chunks, range(known, known + len(chunks))))
        self.off = np.concatenate([self.off, len(self.pool) + np.cumsum(counts) - counts])
        self.pool, self.len = np.concatenate([self.pool, ids]), np.concatenate([self.len, counts])
        self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])
        self.used = np.concatenate([self.used, np.full(len(chunks), self.turn)])
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])

    def forget(self) -> None:
        """Keep the half of the chunks that was used most, of equals last; older uses count half from then on."""
        n = len(self.off)
        if not n:
            return
        worth = np.minimum(self.uses, 1 << 20) * (self.turn + 1) + self.used
        keep = worth > np.partition(worth, n // 2)[n // 2]
        order = np.flatnonzero(keep)
        number = np.cumsum(keep) - 1
        self.memo = {c: int(number[i]) for c, i in self.memo.items() if keep[i]}
        self.pool = self.gather(order)
        self.len, self.score, self.loss, self.used = self.len[order], self.score[order], self.loss[order], self.used[order]
        self.uses = self.uses[order] // 2
        self.off = np.cumsum(self.len) - self.len

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of chunks one after another."""
        counts = self.len[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.off[numbers] - ends + counts, counts) + np.arange(total)]

    def lattice(self, chunk: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """Edges (end, score, ids) by start; every character has one of its own at least."""
        out, edge, prefixes, n = [], self.edge, self.prefixes, len(chunk)
        for i in range(n):
            here = []
            for j in range(i + 1, n + 1):
                part = chunk[i:j]
                if part not in prefixes:
                    break
                if (e := edge.get(part)) is not None and part != MARK:
                    here.append((j, *e))
            if not here or here[0][0] != i + 1:
                c = chunk[i]
                here.insert(0, (i + 1, self.unknown, tuple(self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))))
            out.append(here)
        return out

    @staticmethod
    def forward(edges: list) -> tuple[list[float], list]:
        """Best score of each prefix, and the (start, edge) by which it is reached (the first of equals)."""
        n = len(edges)
        best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        for i, here in enumerate(edges):
            at = best[i]
            for e in here:
                if at + e[1] > best[e[0]]:
                    best[e[0]] = at + e[1]
                    back[e[0]] = (i, e)
        return best, back

    def chunk(self, chunk: str) -> tuple[np.ndarray, float, float]:
        """The best ids, their score, and how much the next best segmentation loses."""
        edges = self.lattice(chunk)
        best, back = self.forward(edges)
        n = len(edges)
        rest = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            rest[i] = max([e[1] + rest[e[0]] for e in edges[i]])
        path, on, v = [], set(), n
        while v:
            i, e = back[v]
            path.append(e[2])
            on.add((i, e[0]))
            v = i
        second = max([best[i] + e[1] + rest[e[0]] for i, here in enumerate(edges) for e in here if (i, e[0]) not in on], default=float("-inf"))
        ids = np.array([x for e in reversed(path) for x in e], np.int32)
        return ids, best[n], best[n] - second

    def fill(self, chunks: set[str]) -> None:
        """Remember what ``chunk`` finds for many chunks: the same passes, over arrays of chunks of like length."""
        self.turn += 1
        if len(self.memo) + len(chunks) > MEMO:
            self.forget()
        missing = [c for c in chunks if c not in self.memo]
        if wide := [c for c in missing if len(c) > _WIDE]:
            done = [self.chunk(c) for c in wide]
            self.remember(wide, np.concatenate([d[0] for d in done]), np.array([len(d[0]) for d in done]), *(np.array([d[k] for d in done]) for k in (1, 2)))
        new = sorted((c for c in missing if len(c) <= _WIDE), key=len)
        for at in range(0, len(new), _ROWS):
            self._fill(new[at : at + _ROWS])

    def _fill(self, chunks: list[str]) -> None:
        rows, wide = len(chunks), len(chunks[-1])
        size = np.array([len(c) for c in chunks])
        code = np.frombuffer("".join(c.ljust(wide, "\0") for c in chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(rows, wide)
        most = min(self.longest, wide)
        r, i = np.nonzero(np.arange(wide)[None, :] < size[:, None])
        single, found = (r, i), []
        h = np.zeros(len(r), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(most):
                h = (h + code[r, i + n].astype(np.uint64) + np.uint64(1)) * _BASE
                h ^= h >> np.uint64(29)
                key = (h >> np.uint64(64 - _BITS)).astype(np.int64)
                at = self.slot[key]
                for z in np.flatnonzero(self.clash_bits[key]):  # the few slots of two pieces
                    at[z] = self.clash.get(int(h[z]), at[z])
                hit = self.hashes[at] == h
                found.append((r[hit], i[hit], at[hit]))
                if not len(h):
                    break
                live = self.prefix_bits[key] & (i + n + 1 < size[r])
                r, i, h = r[live], i[live], h[live]
        most = max(n + 1 for n, f in enumerate(found) if n == 0 or len(f[0]))  # the longest piece in these chunks
        score, ids = np.full((rows, wide, most), -np.inf), np.full((rows, wide, most), -1, np.int32)
        score[*single, 0] = self.unknown
        for n, (a, b, at) in enumerate(found[:most]):
            score[a, b, n], ids[a, b, n] = self.hash_score[at], self.hash_id[at]
        best = np.full((rows, wide + most), -np.inf)
        best[:, 0] = 0
        back = np.zeros((rows, wide + most), np.int16)
        steps = np.arange(1, most + 1, dtype=np.int16)
        for j in range(wide):
            to = best[:, j : j + 1] + score[:, j]
            up = to > best[:, j + 1 : j + 1 + most]
            np.copyto(best[:, j + 1 : j + 1 + most], to, where=up)
            np.copyto(back[:, j + 1 : j + 1 + most], steps, where=up)
        rest = np.full((rows, wide + most), -np.inf)
        rest[np.arange(rows), size] = 0
        for j in range(wide - 1, -1, -1):
            rest[:, j] = np.where(j < size, (score[:, j] + rest[:, j + 1 : j + 1 + most]).max(axis=1), rest[:, j])
        every, on, at = np.arange(rows), np.zeros((rows, wide, most), bool), size.copy()
        while (left := at > 0).any():
            who, back_by = every[left], back[every[left], at[left]].astype(np.int64)
            at[left] -= back_by
            on[who, at[left], back_by - 1] = True
        second = np.full(rows, -np.inf)
        for j in range(wide):
            through = best[:, j : j + 1] + score[:, j] + rest[:, j + 1 : j + 1 + most]
            np.maximum(second, np.where(on[:, j], -np.inf, through).max(axis=1), out=second)
        whole = best[every, size]
        used, counts = ids[on], on.sum(axis=(1, 2))
        if (used < 0).any():  # byte pieces: several ids for a character
            where, place = np.nonzero(on)[:2]
            full = [[x] if x >= 0 else [self.byte_ids[b] for b in chunks[r][i].encode("utf-8", "surrogatepass")] for x, r, i in zip(used.tolist(), where.tolist(), place.tolist())]
            counts = np.bincount(where, [len(f) for f in full], rows).astype(np.int64)
            used = np.array([x for f in full for x in f], np.int32)
        self.remember(chunks, used, counts, whole, whole - second)

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations (score, ids) of a chunk: A* backwards from its end."""
        edges = self.lattice(chunk)
        best, _ = self.forward(edges)
        into: list[list] = [[] for _ in range(len(edges) + 1)]
        for i, here in enumerate(edges):
            for e in here:
                into[e[0]].append((i, e))
        heap: list[tuple] = [(-best[-1], len(edges), 0, 0.0, None)]
        out, tick = [], 0
        while heap and len(out) < n:
            _, v, _, tail, suffix = heapq.heappop(heap)
            if v == 0:
                ids: list[int] = []
                while suffix is not None:
                    ids += suffix[0]
                    suffix = suffix[1]
                out.append((tail, tuple(ids)))
                continue
            for i, e in into[v]:
                tick += 1
                g = tail + e[1]
                heapq.heappush(heap, (-(best[i] + g), i, tick, g, (e[2], suffix)))
        return out

    def ways(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """``n_best``, remembered: chunks of small loss come again and again."""
        if (known := self.searched.get((chunk, n))) is None:
            if len(self.searched) >= MEMO // 10:
                self.searched.clear()
            known = self.searched[chunk, n] = self.n_best(chunk, n)
        return known

    def encode(self, texts: list[str | None], n: int = N_BEST) -> list[tuple[np.ndarray, float, list]]:
        """For each text the best ids, their score, and the other n - 1 best.

        Those are (score, [(first id replaced, how many, by which ids)]).
        """
        cut = [self.split(t) for t in texts]
        self.fill(set().union(*cut))
        counts = np.array([len(c) for c in cut], np.int64)
        numbers = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        self.used[numbers] = self.turn
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        loss, score, ids = self.loss[numbers], self.score[numbers], self.gather(numbers)
        id_at = np.concatenate([[0], np.cumsum(self.len[numbers])])
        out, a = [], 0
        for chunks, b in zip(cut, np.cumsum(counts).tolist()):
            own = ids[id_at[a] : id_at[b]]
            best = float(score[a:b].sum())
            combos: list[tuple[float, tuple]] = [(0.0, ())]
            for c in sorted(_smallest(loss[a:b], min(n - 1, b - a)).tolist()):
                if loss[a + c] == np.inf:
                    continue
                at, size = int(id_at[a + c] - id_at[a]), int(id_at[a + c + 1] - id_at[a + c])
                first = tuple(own[at : at + size].tolist())
                others = [(float(score[a + c]) - x, way) for x, way in self.ways(chunks[c], n) if way != first][: n - 1]
                more = [(x + d, (*how, (at, size, way))) for x, how in combos for d, way in others]
                combos = heapq.nsmallest(n, combos + more, key=lambda x: x[0])
            out.append((own, best, [(best - x, list(how)) for x, how in combos[1:n]]))
            a = b
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding put before it is taken off."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def log_probabilities(scores: list[float], skip: set[int]) -> list[float]:
    """Scores that are log probabilities as they are; whole numbers below 0 are ranks, of which Zipf's law makes some."""
    own = [s for i, s in enumerate(scores) if i not in skip]
    if not all(s <= 0 and s == int(s) for s in own):
        return scores
    rank = [min(-s, float(len(scores))) for s in scores]  # pieces that are never merged count as the last
    total = sum(1 / (r + ZIPF) for i, r in enumerate(rank) if i not in skip)
    return [-float(np.log((r + ZIPF) * total)) for r in rank]


def _smallest(loss: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k smallest values, of equals the first."""
    if k <= 0:
        return np.zeros(0, np.int64)
    limit = np.partition(loss, k - 1)[k - 1]
    near = np.flatnonzero(loss <= limit)
    return near[np.argsort(loss[near], kind="stable")][:k]


SCHEMA = (
    "doc_id long, ids array<int>, n_pieces long, score double, "
    "alternatives array<struct<score:double, changes:array<struct<at:int, length:int, ids:array<int>>>>>, round_trip boolean"
)
_CHANGE = pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])
_ALT = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(_CHANGE))]))
#: Characters encoded into one batch of output.
_BATCH = 1 << 20


def _encode(broadcast, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = broadcast.value  # kept by the worker from task to task, with what it remembers
        for batch in batches:
            texts, start = batch.column(1).to_pylist(), 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and size < _BATCH:
                    size += len(texts[end] or "")
                    end += 1
                done = p.encode(texts[start:end], n)
                flat = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int32)
                counts = np.array([len(d[0]) for d in done], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))
                alts = [[{"score": s, "changes": [{"at": a, "length": k, "ids": w} for a, k, w in ch]} for s, ch in d[2]] for d in done]
                same = [p.decode(d[0].tolist()) == (t or "") for d, t in zip(done, texts[start:end])]
                yield pa.record_batch(
                    [batch.column(0).slice(start, end - start), ids, pa.array(counts), pa.array([d[1] for d in done], pa.float64()), pa.array(alts, _ALT), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_pieces", "score", "alternatives", "round_trip"],
                )
                start = end

    return run


def encode(docs: DataFrame, model: str | None = None, n: int = N_BEST) -> DataFrame:
    """Best ids of each text of ``docs`` (doc_id, text) and its next best segmentations as changes to them."""
    common.text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(Pieces.load(model or default_model()))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_encode(held, n), SCHEMA)


def _decode(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = broadcast.value
        for batch in batches:
            texts = [p.decode(i) if i is not None else None for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of ``encoded`` (doc_id, ids)."""
    held = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model or default_model()))
    return encoded.select("doc_id", "ids").mapInArrow(_decode(held), "doc_id long, text string")


def op7_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every document's best ids, next best segmentations, and whether decoding gives the text back; ``model``: path of the vocabulary file."""
    return encode(common.table(spark, sf_dir, "documents"), model)
