"""The pipeline on a small table: what goes, what stays, and that nothing is lost in packing."""

import random

import numpy as np

import corpus_pipeline
from patchloom.llm.queries import oracle_sql, queries


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    letters = {"aa": "abcdefg", "bb": "nopqrst"}
    text = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(60))
    rows = [(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb", "s", 10) for i in range(80)]
    item = " ".join(f"item{i}" for i in range(12))
    first = rows[0][1]
    rows += [(100, first, "bb", "s", 10), (101, first + " nnnnn", "bb", "s", 10), (102, text("aa") + " " + item, "aa", "s", 10), (103, None, "aa", "s", 0), (104, "123 456", None, "s", 7), (105, text("aa") + " password=abcdefabcdef99", "aa", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/out{k}")
        names.append(name)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        if k == 0:
            assert {103, 104}.isdisjoint(ids) and len(ids) == 84
        if k == 1:
            assert 0 in ids and {100, 101}.isdisjoint(ids) and len(ids) == 82
        if k == 2:
            assert 102 not in ids and len(ids) == 81
        if k == 3:
            assert "[secret]" in docs.filter("doc_id = 105").first().text and docs.count() == 81
    assert names == ["language ID", "near-duplicate removal", "benchmark decontamination", "secret scan", "packing"]
    assert len(ids) == 81
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.ids_crc32) for r in docs.collect())
    assert all(np.frombuffer(bytes(r.ids), "<u4").size == r.length for r in whole)


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries())
    assert numbers == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
