"""The stages one by one, each on what its predecessor kept, and the whole."""

from __future__ import annotations

import re

import corpus_pipeline
from veilframe.llm import minhash
from test_operators import NASTY, SCHEMA, brute, folder  # noqa: F401


def staged(spark, sf_dir, tmp_path):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/stage{k}")
        out.append((docs, docs := spark.read.parquet(f"{tmp_path}/stage{k}")))
    return out


def test_stages_on_documents(spark, sf, tmp_path):
    s = staged(spark, sf, tmp_path)
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(after.columns == columns for _, after in s[:-1])
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert all(ids(after) <= ids(before) for before, after in s)
    # Rules: what failed the base rule is gone.
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 50 for r in s[0][1].collect())
    # Near duplicates: one of each group, by brute force on five words.
    before, after = s[2]
    want, _ = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
    assert ids(after) == {i for i, c in want.items() if i == c}
    # Benchmark passages, word for word.
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = s[3]
    leaks = {r.doc_id for r in before.collect() if any(i in norm(r.text) for i in items)}
    assert ids(after) == ids(before) - leaks or ids(after) <= ids(before) - leaks
    assert len(ids(before) - leaks - ids(after)) <= 0.01 * len(ids(before))
    assert ids(s[4][1]) == ids(s[4][0]) and s[4][1].where("not round_trip").count() == 0


def test_run_is_the_stages(spark, sf, tmp_path):
    want = staged(spark, sf, tmp_path)[-1][1]
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == want.columns
    assert sorted((r.doc_id, tuple(r.ids)) for r in got.collect()) == sorted((r.doc_id, tuple(r.ids)) for r in want.collect())


def test_short_lines_go(spark):
    rows = [(i, f"own words of text {i} here\n Les.\t", "en", f"s{i}", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {i: t if i == 0 else t.split("\n")[0] for i, t, *_ in rows}


def test_hard_tables(spark, folder, tmp_path):  # noqa: F811
    path, _ = folder
    assert len(corpus_pipeline.run(spark, path).columns) == 6
    docs = spark.createDataFrame(NASTY, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.collect()} >= {1, 2, 3, 6, 7, 8, None}, name
    assert minhash.keep_one(docs).where("doc_id = 5").count() == 0
