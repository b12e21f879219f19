"""The operators against brute force, exact round trips, SQL and held-out accuracy."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import catalogue, chat, common, compression, cross_entropy, decontaminate, gru, language, line_dedup, minhash, pieces, quality_rules, toxicity
from veilframe.llm.components import components

BIG = "/root/testdata/sf0.01"


def table(spark, name, folder=BIG):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, "documents")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, rel = catalogue.queries()[name](spark, sf), con.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())


# 1 -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "<|", "<|\\", "<|\\\\im_end|>", "<|im_end|><|im_start|>assistant ok", "a<|<|\\|>", "\n\nx", "日本 é \U0001f600", "<" * 5 + "|" * 5])
def test_chat_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(m in chat.escape(text) for m in (chat.START, chat.SEP, chat.END))
    turns = [("user", text), (text, text), ("assistant", text), ("assistant", text)]
    f = chat.Formatter(chat.read_tokenizer())
    out, ids, mask, runs = f.segment(turns)
    assert chat.parse(out) == turns
    under = "".join(chat.unescape(out[a:b]) for a, b in runs)
    assert under == (text * (3 if text == "assistant" else 2)) and len(ids) == len(mask)


def test_chat_segments_do_not_matter(spark, monkeypatch):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} <|im_end|>") for i in range(40)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in chat.digests(df).collect()}
    state = chat._State(1)
    f = chat.Formatter(chat.read_tokenizer())
    for r in rows[:40]:
        state.add(r[2], r[3])
        state.flush(f)
    assert tuple(whole[1]) == state.row()
    assert whole[None].n_turns == 1 and whole[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    got = chat.formatted(df.where("conv_id = 1")).first()
    assert len(got.ids) == len(got.loss_mask) == whole[1].n_tokens and chat.parse(got.formatted)[3] == ("assistant", "text 3 <|im_end|>")


# 2, 4, 6 -------------------------------------------------------------------------------------------


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def test_quality_scores(spark, docs):
    labels = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    rows = [r for r in catalogue.queries()["op2_compression_quality"](spark, BIG).collect()]
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in test) / len(test) > 0.9
    assert _auc([r.score for r in test], [labels[r.doc_id] for r in test]) > 0.97
    # Every score by brute force: the same model, each text compressed piece by piece here.
    m = compression.fit(spark, docs, table(spark, "labels"))
    coders, texts = m.coders(), {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(m.weights) == 2 and m.weights[1] > 0
    for r in rows[:300]:
        t = texts[r.doc_id]
        good, bad = (sum(len(c.compress(t[i : i + compression.PIECE])) for i in range(0, len(t), compression.PIECE)) for c in coders)
        want = 1 / (1 + math.exp(-(m.weights[0] + m.weights[1] * 10 * (bad - good) / (bad + good)))) if t else m.prior
        assert r.score == pytest.approx(want)


def _auc(scores, truth):
    """Share of pairs of a positive and a negative that are in order."""
    pos, neg = ([s for s, y in zip(scores, truth) if y == k] for k in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_quality_pieces_cover_long_texts():
    m = compression.train([(b"good prose of the land " * 40, 1), (b"bad ### $$$ text !!! " * 40, 0)] * 20)
    coders = m.coders()
    long = b"good prose of the land " * 40_000
    assert compression.sizes(long, coders)[0] >= len(long) // compression.PIECE
    assert compression.score(long, m, coders) > 0.5 > compression.score(b"bad ### $$$ text !!! " * 30, m, coders)
    assert compression.train([]).prior == 0.5 and compression.score(b"", m, coders) == m.prior


def test_gradients_through_time():
    rng = np.random.default_rng(0)
    x, u, mask, w = rng.standard_normal((5, 3, 12)), rng.standard_normal((4, 12)) * 0.5, np.ones((5, 3)), rng.standard_normal((5, 3, 4))
    mask[3:, 1] = 0
    kept: list = []
    gru.forward(x, u, mask, kept)
    dx, du = gru.backward(w.copy(), u, mask, kept)
    for a, d in ((x, dx), (u, du)):
        for _ in range(15):
            i = tuple(rng.integers(0, n) for n in a.shape)
            old, e = a[i], 1e-6
            a[i] = old + e
            up = (gru.forward(x, u, mask) * w).sum()
            a[i] = old - e
            down = (gru.forward(x, u, mask) * w).sum()
            a[i] = old
            assert abs((up - down) / (2 * e) - d[i]) < 1e-6


def test_languages(spark, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = catalogue.queries()["op4_language_id"](spark, BIG).collect()
    assert len(rows) == len(lang) and all(r.held_out == held(r.doc_id, 3, 1) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) / len(test) > 0.95


def test_every_language_is_learned(spark):
    names = [f"l{k:02}" for k in range(70)]
    rows = [(100 * k + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)}", x) for k, x in enumerate(names) for i in range(12)]
    m = language.fit(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.languages == names and m.p["w"].shape[1] == m.p["b"].shape[0] == 70


def test_language_details():
    m = language.train([("the cat and the dog " * 9, "en"), ("le chat et le chien " * 9, "fr")])
    odd = [None, "", "123 ... !", "½ ² ①", "\u0301 _ 五"[:3], "the the", "x" * 5000]
    got = language.identify(m, odd)
    assert got[:5] == [("und", 0.0)] * 5 and got[5][0] == "en" and got[6][0] in ("en", "fr")
    assert language.identify(m, ["the dog and the cat"])[0][0] == "en"
    # A text is labelled alike alone and among others.
    a, b = language.identify(m, ["the le le"])[0], language.identify(m, ["the le le", "chat dog" * 80])[0]
    assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-5
    assert language.identify(language.Model([], {}), ["x"]) == [("und", 0.0)]


@pytest.mark.parametrize("n", [1, 95, 96, 97, 192, 1000])
def test_every_byte_is_labelled_once(n):
    text = "".join(chr(97 + k % 26) for k in range(n - 1)) + "é"
    code, who, count = language.windows([None, text, ""])
    assert set(who) == {1} and count.sum() == len(text.encode())
    inside = language._inside(count).astype(bool)
    assert b"".join(bytes(w[i]) for w, i in zip(code, inside.T)) == text.encode()


def test_language_scores_are_those_of_a_scalar_network():
    m = language.train([("the cat and the dog 12 " * 9, "en"), ("le chat et le chien, " * 9, "fr"), ("der hund und die katze " * 9, "de")])
    p = {k: v.astype(float) for k, v in m.p.items()}
    for text in ("The dog 77 et la katze!", "Der Hund und " * 30):
        raw, total = text.lower().encode(), np.zeros(3)
        for a in range(0, len(raw), language.WIDE - 2 * language.LAP):
            at = range(a - language.LAP, a - language.LAP + language.WIDE)
            code = [raw[i] if 0 <= i < len(raw) else 0 for i in at]
            states = zip(_gru([p["xf"][c] for c in code], p["uf"], False), _gru([p["xb"][c] for c in code], p["ub"], True))
            for i, s in zip(at, states):
                if a <= i < min(len(raw), a + language.WIDE - 2 * language.LAP):
                    x = np.concatenate(s) @ p["w"] + p["b"]
                    total += x - np.log(np.exp(x).sum())
        prob = np.exp(total / len(raw))
        lang, score = language.identify(m, [text])[0]
        assert lang == m.languages[int(prob.argmax())] and score == pytest.approx(prob.max() / prob.sum(), abs=1e-4)


def test_toxic_documents(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, "labels").collect()}
    rows = catalogue.queries()["op6_toxicity"](spark, BIG).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in test) / len(test) > 0.9
    assert _auc([r.score for r in test], [labels[r.doc_id] for r in test]) > 0.9
    # Some scores by brute force: every window by itself, word by word, through scalar recurrences.
    m = toxicity.fit(spark, table(spark, "documents"), table(spark, "labels"))
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in sorted((r for r in rows if 0 < len(toxicity.words(texts[r.doc_id])) < 120), key=lambda r: r.doc_id)[:12]:
        assert r.score == pytest.approx(_toxic(m, toxicity.words(texts[r.doc_id])), abs=1e-4)


def _gru(inputs, u, back):
    n, out = len(u), []
    h = np.zeros(n)
    for x in inputs[::-1] if back else inputs:
        a = h @ u
        z, r = (1 / (1 + np.exp(-(x[k * n : (k + 1) * n] + a[k * n : (k + 1) * n]))) for k in (0, 1))
        c = np.tanh(x[2 * n :] + r * a[2 * n :])
        h = z * h + (1 - z) * c
        out.append(h)
    return out[::-1] if back else out


def _toxic(m, words):
    p, best = {k: v.astype(float) for k, v in m.p.items()}, -np.inf
    n = len(words)
    starts = [0] if n <= toxicity.WINDOW else sorted({*range(0, n - toxicity.WINDOW, toxicity.STRIDE), n - toxicity.WINDOW})
    for a in starts:
        e = []
        for w in words[a : a + toxicity.WINDOW]:
            bucket, _ = toxicity.grams([w])
            e.append(np.concatenate([p["words"][m.words.get(w, 0)], np.tanh(p["chars"][bucket].mean(axis=0))]))
        f, b = (_gru([x @ p["w" + d] + p["b" + d] for x in e], p["u" + d], d == "b") for d in "fb")
        states = [np.concatenate(s) for s in zip(f, b)]
        weight = np.exp([np.tanh(s @ p["wa"]) @ p["va"] for s in states])
        best = max(best, float((weight / weight.sum()) @ np.array([s @ p["wo"] for s in states]) + p["bo"][0]))
    return 1 / (1 + np.exp(-(m.curve[0] + m.curve[1] * best)))


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        w = toxicity.windows(n)
        assert sorted(set(itertools.chain.from_iterable(range(a, b) for a, b in w))) == list(range(n))
        assert all(b[0] - a[0] <= toxicity.STRIDE for a, b in zip(w, w[1:]))


def test_toxicity_finds_a_word_anywhere_in_a_long_text():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ba", "de", "ki", "lo", "mu"]) for _ in range(3))
    clean = [" ".join(word() for _ in range(60)) for _ in range(120)]
    bad = [" ".join(["vile" + word() if rng.random() < 0.05 else word() for _ in range(59)] + ["vilebade"]) for _ in range(120)]
    m = toxicity.train([(t, 0) for t in clean] + [(t, 1) for t in bad], 0.5)
    long = [word() for _ in range(3000)]
    at = long[:1500] + ["vilekimu"] + long[1500:]
    s = toxicity.scores(m, [" ".join(long), " ".join(at), None, "...", ""])
    assert s[0] < 0.5 < s[1] and list(s[2:]) == [0.25] * 3


# 3 -------------------------------------------------------------------------------------------------


def test_line_dedup_counts_sites(spark):
    line, other = "subscribe to our list today", "a line on seven sites"
    rows = [(i, f"own words of text {i} here\n  {line}\t\nyes", f"s{i}") for i in range(20)]
    rows += [(100 + i, other, f"s{i % 7}") for i in range(40)] + [(200, line + "\n" + line, None), (None, line, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_words=3).collect()}
    assert got[0].text == rows[0][1] and got[5].text == "own words of text 5 here\nyes" and got[5].n_removed == 1
    assert got[103].text == other and got[200].text == "" and got[200].n_removed == 2 and got[None].text == line
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}  # one word is a line too
    assert got[0].text == rows[0][1] and got[5].text == "own words of text 5 here" and got[5].n_removed == 2


def test_line_dedup_of_one_line_on_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST", 8)
    monkeypatch.setattr(common, "SHARE", 16)
    monkeypatch.setattr(common, "FEW", 3)  # nothing is broadcast
    rows = [(i, f"text {i}\n" + ("one hot line" if i % 3 == 0 else f"line of {i // 30}") + "\n***", f"s{i % 41}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sites = defaultdict(set)
    for i, t, s in rows:
        for x in t.split("\n"):
            sites[x].add(s)
    owner = {x: next(i for i, t, _ in rows if x in t.split("\n")) for x, s in sites.items() if len(s) >= line_dedup.SPREAD}
    want = {i: "\n".join(x for x in t.split("\n") if owner.get(x, i) == i) for i, t, _ in rows}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == want and "one hot line" in owner


def test_sketches_merge_across_the_exchange(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 3)], "h long, s long").write.parquet(f"{tmp_path}/pairs")
    plan = line_dedup.sketches(spark.read.parquet(f"{tmp_path}/pairs"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("[hll_sketch_agg") < plan.index("Exchange hashpartitioning(h") < plan.index("partial_hll_sketch_agg")


@pytest.mark.parametrize("sites", [5, 6, 7, 8, 9, 10, 11])
def test_line_dedup_is_exact_near_the_threshold(spark, sites):
    rows = [(k * 100 + i, f"shared line number {k} of text", f"site{(k * 7 + i) % 50}") for k in range(30) for i in range(sites)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert line_dedup.boilerplate(df).count() == (30 if sites >= line_dedup.SPREAD else 0)


# 5 -------------------------------------------------------------------------------------------------


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "short")]
    docs, want = [], set()
    for d in range(60):
        text = [word() for _ in range(rng.randint(0, 300))]
        if d % 2 == 0:
            i, t = items[rng.randrange(30)]
            m = len(decontaminate.normalise(t)[0])
            if m >= decontaminate.MIN_CHARS:
                s = list(t)
                for _ in range(rng.randint(0, decontaminate.budget(m))):
                    p = rng.randrange(len(s))
                    s[p : p + 1] = rng.choice([["q"], [], [s[p], "z"]])
                text.insert(rng.randint(0, len(text)), "".join(s).upper() if d % 4 else "".join(s))
                want.add((d, i))
        docs.append((d, "  ".join(text)))
    docs += [(100, None), (101, ""), (None, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.contaminations(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got} and (None, 0) in {(r.doc_id, r.item_id) for r in got}
    text, item, best = dict(docs), dict(items), {}
    for r in got:  # each is within the budget, by an alignment of its own
        a = decontaminate.normalise(text[r.doc_id][r.start : r.end])[0].tolist()
        b = decontaminate._trim(decontaminate.normalise(item[r.item_id])[0]).tolist()
        assert _edits(a, b) <= decontaminate.budget(len(b))
        best[r.doc_id, r.item_id] = min(r.edits, best.get((r.doc_id, r.item_id), 99))
    # Every text and every item, by alignment over the whole table: the same pairs and the same least edits.
    brute = {}
    for d, t in docs:
        for i, u in items:
            a, b = (decontaminate._trim(decontaminate.normalise((x or "").strip())[0]) for x in (t, u))
            if len(a) and len(b):
                if len(b) < decontaminate.MIN_CHARS:
                    hit = f" {decontaminate._text(b)} " in f" {decontaminate._text(a)} "
                    brute |= {(d, i): 0} if hit else {}
                elif (e := _least(a, b)) <= decontaminate.budget(len(b)):
                    brute[d, i] = e
    assert best == brute
    assert {r.doc_id for r in decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string")).collect()} >= {100, 101, None}


def _least(text, item):
    """Least edits of ``item`` anywhere in ``text``."""
    row = np.zeros(len(text) + 1, np.int64)
    j = np.arange(len(text) + 1)
    for i, x in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != x), row[1:] + 1)
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def test_short_items_stand_exactly_between_words(spark):
    items = [(1, "tiny"), (2, "A b!"), (3, "x"), (4, "exactly twenty chars"), (5, "😀"), (6, "日本")]
    texts = [(1, "a TINY thing"), (2, "tinyx xtiny"), (3, "see a, b? and x"), (4, "exactly twenty  chars!"), (5, "exactly twenti chars"), (6, "😀 日本 😀"), (7, "a b a b")]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, dict(texts)[r.doc_id][r.start : r.end]) for r in decontaminate.contaminations(df, bench).collect())
    assert got == [(1, 1, "TINY"), (3, 2, "a, b"), (3, 3, "x"), (4, 4, "exactly twenty  chars"), (6, 6, "日本"), (7, 2, "a b"), (7, 2, "a b")]


def test_a_phrase_that_all_items_and_places_share_takes_bounded_memory():
    import tracemalloc

    phrase = "please answer the following question with care"
    rng = random.Random(8)
    items = [(i, f"{phrase} {' '.join(rng.choice('abcdefgh') * 3 + str(rng.randrange(99)) for _ in range(20))}") for i in range(3000)]
    ix = decontaminate.Index(items)
    text = (phrase + " ") * 420 + items[7][1]
    tracemalloc.start()
    got = list(decontaminate._scan_docs([ix], [(1, 1, text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 7 in got[0].column("item_id").to_pylist() and peak < 300e6
    # One item and one text of a single letter: every position meets every other.
    got = list(decontaminate._scan_docs([decontaminate.Index([(1, "a" * 900)])], [(1, 1, "a" * 30_000)]))
    assert got[0].column("edits").to_pylist()[0] == 0


def test_clean_goes_by_text(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    df = spark.createDataFrame([(4, "so " + item), (4, "clean text"), (None, item), (5, None)], "doc_id long, text string")
    got = decontaminate.clean(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [(4, "clean text"), (None, item), (5, None)]))


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_decontamination_of_a_long_text_and_in_blocks(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    text = "filler words go on " * 60_000 + item + " and on " * 30_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, item + " again and again"), (9, "another item that is nowhere at all")], "item_id long, text string")
    want = [(1, 7, text.index(item), text.index(item) + len(item), 0)]
    assert [tuple(r) for r in decontaminate.contaminations(df, bench).where("edits = 0").collect()] == want
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert [tuple(r) for r in decontaminate.contaminations(df, bench).where("edits = 0").collect()] == want


# 7 -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load(pieces.default_model())


def _all_ways(model, chunk):
    edges, out = model.lattice(chunk), []

    def go(i, score, ids):
        if i == len(edges):
            out.append((score, ids))
        else:
            for j, w, x in edges[i]:
                go(j, score + w, ids + x)

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("chunk", [" hello", " the", "worthless", "ñezo", "￿x", "aaaaaa", "Straße", "]]))", "   "])
def test_n_best_is_every_way_in_order(model, chunk):
    want = _all_ways(model, chunk)
    got = model.n_best(chunk, 7)
    assert [x for x, _ in got] == pytest.approx([x for x, _ in want[:7]]) and len({w for _, w in got}) == len(got)
    ids, score, loss = model.chunk(chunk)
    assert score == pytest.approx(want[0][0]) and (len(want) < 2 or loss == pytest.approx(want[0][0] - want[1][0]))
    model.fill({chunk})
    k = model.memo[chunk]
    assert model.gather(np.array([k])).tolist() == ids.tolist() and model.loss[k] == pytest.approx(loss)


@pytest.mark.parametrize("text", ["hi the cat", "of an\nx", "a  b", "Ñ é."])
def test_n_best_of_a_text(model, text):
    ways = [_all_ways(model, c)[:40] for c in model.split(text)]
    want = heapq.nlargest(6, (sum(w[0] for w in way) for way in itertools.product(*[w[:12] for w in ways])))
    ids, score, rest = model.encode([text], 6)[0]
    assert [score, *(x for x, _ in rest)] == pytest.approx(want)
    for _, changes in rest:
        new = ids.tolist()
        for at, size, way in sorted(changes, reverse=True):
            new[at : at + size] = way
        assert model.decode(new) == text


@pytest.mark.parametrize("text", ["", " ", "▁a▁ ▁", "\x00\n\t  x ", "日本𠀀語", "a" * 3000, "x\r\ny", "²½ ÅÅ"])
def test_encoding_is_lossless(model, text):
    assert model.decode(model.encode([text])[0][0].tolist()) == text


def test_scores_are_log_probabilities(model, docs):
    import sentencepiece

    assert sum(math.exp(s) for s, _ in model.edge.values()) == pytest.approx(1, abs=0.02)
    assert pieces.log_probabilities([0.0, -1.5, -2.25], {0}) == [0.0, -1.5, -2.25]  # those of a unigram model stay
    assert [len(x[0]) for x in model.encode(["hello world", "straight on"])] == [3, 2]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    words = [w for r in docs.limit(200).collect() for w in (r.text or "").split(" ") if w][:20_000]
    assert sum(a[0].tolist() == b for a, b in zip(model.encode(words, 1), sp.encode(words))) > 0.75 * len(words)
    texts = ["of an ordinary text, 1 2 3.", "Straße 日本 x"]
    assert [sp.decode(x[0].tolist()) for x in model.encode(texts)] == texts


def test_pieces_in_spark(spark, docs):
    out = pieces.encode(docs).cache()
    assert out.where("not round_trip").count() == 0
    back = pieces.decode(out).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert back.where("not (text <=> coalesce(was, ''))").count() == 0 and back.count() == docs.count()


# 8 -------------------------------------------------------------------------------------------------


def brute(rows, width, num, den):
    """Smallest id of each row's component, over all pairs that share a shingle."""
    sets = {i: minhash.shingle_set((t or "").encode(), width) for i, t in rows}
    holders, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_of_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, sizes = brute(rows, 3, 85, 100)
    got = minhash.near_duplicates(docs, 3, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """Copies with few and with many edits: chains, stars and loners, over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(140)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            words[rng.randrange(140)] = rng.choice("xyz") + str(rng.randrange(6))
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "One  two\tTHREE" if i % 2 else "one two three") for i in range(9)] + [(2000, "one two"), (2001, "one"), (2002, "ONE"), (2003, ""), (2004, None), (2005, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want, sizes = brute(rows, 3, 85, 100)
    got = minhash.near_duplicates(df, 3, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes


def test_an_id_on_unlike_texts(spark):
    a, b = "a a a", " ".join(f"w{k}" for k in range(200))
    df = spark.createDataFrame([(4, a), (4, b), (9, b + " more"), (4, b), (None, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 3, 85, 100).collect() if r.doc_id)
    assert got == [(4, 1, 4), (4, 198, 4), (4, 198, 4), (9, 199, 4)]
    df = spark.createDataFrame([(4, a, 1), (4, b, 2), (3, b, 3), (None, b, 4), (5, None, 5)], "doc_id long, text string, __gone int")
    assert sorted(r["__gone"] for r in minhash.keep_one(df).collect()) == [1, 3, 4, 5]


def test_near_duplicates_of_a_filled_template(spark, monkeypatch):
    """A large group of which most pairs stay below the threshold, with hot keys everywhere."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    monkeypatch.setattr(common, "LEAST", 8)
    monkeypatch.setattr(common, "SHARE", 64)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(500):
        words = list(base)
        for k in range(0, 120, 12):
            words[k] = f"fill{rng.randrange(12)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 40, 2)] + [(2000 + i, " ".join(base)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, _ = brute(rows, 3, 85, 100)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85, 100).collect()} == want


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"Word{k % 700}" + "\t" * (k % 3) for k in range(5000)).encode()
    whole, name = minhash.shingle_hashes([text], 4)[0], minhash.digest(text)
    monkeypatch.setattr(minhash, "SLICE", 1000)
    assert (minhash.shingle_hashes([text], 4)[0] == whole).all() and len(whole) == len(minhash.shingle_set(text, 4))
    assert b"".join(minhash.pieces(text)) == text and len(list(minhash.pieces(text))) > 20 and name == minhash.digest(text.lower().replace(b"\t", b" ")) != minhash.digest(text + b"x")


def test_registers_estimate_and_collide_as_stated():
    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    shared = [draw(240) for _ in range(200)]
    a = [np.unique(np.concatenate([s, draw(60)])) for s in shared]
    b = [np.unique(np.concatenate([s, draw(60)])) for s in shared]
    n = np.full(200, 300)
    e = minhash.estimate(minhash.registers(a), minhash.registers(b), n, n)
    assert abs(e.mean() - 240 / 360) < 0.01 and e.std() < 0.07
    low = rng.integers(1, 2**64 - 1, 500_000, dtype=np.uint64)
    r = minhash.compress(low)
    zeros = np.array([64 - int(x).bit_length() for x in low[:2000]])
    assert ((r[:2000] >> 10) == np.minimum(zeros, 53)).all()
    # Unrelated minima of 1000 values each agree about as often as the published approximation says.
    x, y = (minhash.compress((rng.exponential(1, 400_000) / 1000 * 2.0**64).astype(np.uint64)) for _ in range(2))
    assert (x == y).mean() == pytest.approx(minhash.collision_rate(np.array(1000.0), np.array(1000.0)), rel=0.25)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)] + [(500, 501)] * 3
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9 -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [cross_entropy.BROADCAST_IDS, 0])
def test_cross_entropy_difference(spark, limit):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["aa", "b", "Cc", "dé", "e1"]) for _ in range(rng.randint(0, 12)))) for i in range(50)] + [(50, None), (None, "b b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = spark.createDataFrame([(i,) for i in range(0, 50, 3)] * 2, "doc_id long")
    got = {r.doc_id: r for r in cross_entropy.scored(df, cross_entropy.fit(df, good, limit)).collect()}
    low = lambda t: [w.replace("C", "c") for w in (t or "").split()]
    is_target = lambda i: i is not None and i < 50 and i % 3 == 0
    parts = [[r for r in rows if is_target(r[0])], rows]
    size = [sum(len(low(t)) for _, t in part) for part in parts]
    for i, t in rows:
        w, loss = low(t), []
        for part, scale in zip(parts, (1, size[0] / size[1])):  # both models anew, without this document
            one, two = Counter(), Counter()
            for j, u in part:
                if j != i:
                    one.update(low(u))
                    two.update(zip(low(u), low(u)[1:]))
            p1 = lambda x: (one[x] * scale + cross_entropy.UNIFORM) / (sum(one.values()) * scale + cross_entropy.UNIFORM * cross_entropy.WORDS)  # noqa: B023, E731
            loss.append(sum(-math.log(p1(x) if k == 0 else (two[w[k - 1], x] * scale + cross_entropy.BACKOFF * p1(x)) / (one[w[k - 1]] * scale + cross_entropy.BACKOFF)) for k, x in enumerate(w)))
        r = got[i]
        assert r.n_tokens == len(w)
        if w:
            assert (r.target_loss, r.background_loss, r.score) == pytest.approx((loss[0] / len(w), loss[1] / len(w), (loss[0] - loss[1]) / len(w)), rel=1e-6, abs=1e-6)
        else:
            assert (r.target_loss, r.background_loss, r.score) == (None, None, 0.0)


def test_cross_entropy_tells_all_words_apart(spark):
    # More distinct words than a fixed table of 2^18 has slots: a word or pair that stands once in another copy is counted once.
    rows = [(i, " ".join(f"w{i % 300 * 1000 + j}" for j in range(1000))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    none = spark.createDataFrame([], "doc_id long")
    u, b = cross_entropy.UNIFORM, cross_entropy.BACKOFF
    one = (1 + u) / (599_000 + u * 300_000)
    want = -(math.log(one) + 999 * math.log((1 + b * one) / (1 + b))) / 1000
    got = cross_entropy.scored(df, cross_entropy.fit(df, none)).collect()
    assert len(got) == 600 and all(r.background_loss == pytest.approx(want, rel=1e-9) for r in got)
    # Other rows than those counted ask for themselves, and nothing is taken off.
    one = (2 + u) / (600_000 + u * 300_000)
    want = -(math.log(one) + 999 * math.log((2 + b * one) / (2 + b))) / 1000
    again = cross_entropy.scored(df.where("doc_id < 9"), cross_entropy.fit(df, none)).collect()
    assert len(again) == 9 and all(r.background_loss == pytest.approx(want, rel=1e-9) for r in again)


def test_chunks_keep_keys_beside_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cross_entropy, "CHUNK", 10)
    key = pa.StructArray.from_arrays([pa.array(range(20)), pa.array([i % 3 == 0 for i in range(20)])], names=["doc_id", "target"])
    batch = pa.record_batch([key, pa.array([f"t{i}" * (i % 4) for i in range(20)])], names=["key", "text"])
    chunks = list(cross_entropy._chunks(iter([batch, batch.slice(3, 9), batch.slice(19)]), 1))
    rows = [r for _, texts, k in chunks for r in zip(k.field("doc_id").to_pylist(), k.field("target").to_pylist(), texts)]
    assert rows == [(i, i % 3 == 0, (f"t{i}" * (i % 4)).encode()) for i in [*range(20), *range(3, 12), 19]] and len(chunks) > 3


# 10 ------------------------------------------------------------------------------------------------


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, docs):
    odd = ["", None, " \n\t", "a b c", "a a a a", "a b c a b c", "x\ny\nx\n\n \n", "é # é\x0bq", "one\n one\none", "a b a b a b c", "  lead and trail  ", "  nbsp x"]
    df = docs.select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    for r in quality_rules.statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text), r.text


def test_rules_in_spark_are_the_rules_learned(spark):
    docs, labels = table(spark, "documents").select("doc_id", "text"), table(spark, "labels")
    rows = quality_rules.examples(spark, docs, labels)
    rules = quality_rules.learn(rows)
    assert rules
    got = {r.doc_id: r for r in quality_rules.judge(docs, rules).collect()}
    for r in got.values():
        fired = next((k for k, rule in enumerate(rules, 1) if all(c.holds(r.asDict()) for c in rule)), None)
        assert r.rule == fired and r.kept == (fired is None and not r.base_failed)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    test = [r for i, r in got.items() if i in truth and held(i, 5, 0) and not r.base_failed]
    assert sum(r.kept == bool(truth[r.doc_id]) for r in test) / len(test) > 0.9


def test_covering_learns_a_conjunction():
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        r = {f: rng.random() for f in quality_rules.FEATURES}
        rows.append(r | {"label": int(not (r["upper_ratio"] > 0.6 and r["digit_ratio"] > 0.5))})
    rules = quality_rules.learn(rows)
    assert rules and {c.feature for c in rules[0]} == {"upper_ratio", "digit_ratio"}
    assert quality_rules.learn([]) == [] and quality_rules.learn([r | {"label": 1} for r in rows]) == []


# all -----------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __lost string, kept boolean, n_words string"
NASTY = [
    (None, None, None, None, None, None, None, None), (1, None, None, "a", 0, "x", True, "n"), (2, "", "en", None, 0, None, None, None), (3, " \n\t\n", "en", "a", 4, None, None, None),
    (4, "same words again and again here", "en", "a", 31, None, None, None), (4, "same words again and again here", "en", "a", 31, None, None, None), (5, "same words again and again here", None, "b", 31, None, None, None),
    (4, "another text under an id that is taken", "fr", "c", 9, None, None, None), (6, "word " * 60_000, "en", "a", 1, None, None, None), (7, "x" * 200_000, "en", "a", 1, None, None, None), (8, "日本語 \U00020000 �", "de", "d", 1, None, None, None),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(params=["nasty", "empty"])
def folder(spark, tmp_path, request):
    full = request.param == "nasty"
    put = lambda rows, schema, name: spark.createDataFrame(rows if full else [], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put(NASTY, SCHEMA, "documents")
    put([(None, None, None), (1, None, 1), (4, 1, 0), (4, 0, 1), (6, 0, None), (7, 5, 5)], LABELS, "labels")
    put([(None, None), (1, ""), (2, "tiny"), (3, "same words again and again here"), (3, "same words again and again here")], "item_id long, text string", "benchmark")
    put([(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "assistant", "y" * 50_000), (2, None, None, "")], "conv_id long, turn long, role string, text string", "conversations")
    return str(tmp_path), full


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_hard_tables(spark, folder, name):
    path, full = folder
    rows = catalogue.queries()[name](spark, path).collect()
    if name.startswith("op1_"):
        assert {r.conv_id for r in rows} == ({None, 1, 2, -1} if full else {-1})
    elif name.startswith("op5_"):
        assert {(r.doc_id, r.item_id) for r in rows} == ({(4, 3), (5, 3)} if full else set())
    elif name.startswith("op8_"):
        assert len(rows) == (len(NASTY) if full else 0)
        if full:
            assert {(r.doc_id, r.component_id) for r in rows if r.doc_id in (1, 2, 3, 5)} == {(1, 1), (2, 2), (3, 3), (5, 4)}
            assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    else:
        assert len(rows) == (len(NASTY) if full else 0)


def test_common_names(spark):
    df = spark.createDataFrame([(1, 2)], "__a int, __A_0 int")
    assert common.fresh(df, "a", "a", "b") == ["__a_1", "__a_2", "__b"]
