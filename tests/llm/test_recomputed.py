"""Scores of classifiers recomputed from their rules and weights, very long texts, and the pipeline at its edges."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from patchloom.llm import katz, language, near_dup, quality, secrets
from patchloom.llm.common import written

LONG = "word " * 200_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def statistics(text):
    """quality.STATISTICS of a text by definition."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    lines = text.split("\n")
    share = lambda n, of: n / of if of else 0.0
    good = lambda c: c.isalpha() or c.isnumeric()
    white = " \t\n\x0b\f\r"
    return {
        "words": math.log1p(len(words)), "word_length": share(sum(map(len, words)), len(words)), "distinct_words": share(len(set(words)), len(words)),
        "repeated_words": share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)),
        "symbols": share(sum(not good(c) and c not in white + ".,;:'\"()?-" for c in text), len(text)), "marks": share(sum(not good(c) and c not in white for c in text), len(text)),
        "capitals": share(sum(c.isupper() for c in text), len(text)), "digits": share(sum(c in "0123456789" for c in text), len(text)),
        "repeated_lines": 1 - len(set(lines)) / len(lines),
    }


def test_quality_scores_recomputed_from_rules(spark):
    rng = random.Random(1)
    text = lambda i: " ".join("".join(rng.choice("abcDEf12#") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 50))) + ("\nsame" * (i % 4))
    rows = [(i, text(i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = written(quality.with_statistics(docs).withColumn("label_", F.when(F.col("doc_id") % 7 > 1, F.col("doc_id") % 4 > 1).otherwise(F.length("text") % 3 > 1).cast("int")), "marked")
    ensemble = quality.fit_rules(marked, "label_")
    assert len(ensemble.weights) > 2
    found = {r.doc_id: r.score for r in marked.select("doc_id", ensemble.score().alias("score")).collect()}
    for i, t in rows:
        own, margin = statistics(t), ensemble.intercept
        for rule, weight in ensemble.weights.items():
            margin += weight * all(own[name] <= bound if sign == "<=" else own[name] > bound for name, sign, bound in rule)
        assert math.isclose(found[i], 1 / (1 + math.exp(-margin)), abs_tol=1e-9)


def test_language_scores_recomputed_byte_by_byte(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdefg", "bb": "nopqrst"}
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(rng.choice([1, 20, 120]))), k) for i in range(80) for k in [sorted(letters)[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language.train(docs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, network).collect()}
    for i, text, _ in rows[::7]:
        raw = text.encode()
        starts = [0] if len(raw) <= 256 else [*range(0, len(raw) - 255, 256), *([len(raw) - 256] if len(raw) % 256 else [])]
        logs = []
        for low in starts:
            x = network.embedding[list(raw[low : low + 256].ljust(256))]
            hidden = []
            for f in network.filters:
                responses = [np.einsum("we,wef->f", x[j : j + len(f)], f) for j in range(256 - len(f) + 1)]
                hidden.append(np.max(responses, 0))
            logits = np.maximum(np.concatenate(hidden) + network.bias, 0) @ network.weights + network.offset
            logs.append(logits - np.log(np.exp(logits).sum()))
        mean = np.mean(logs, 0)
        p = np.exp(mean) / np.exp(mean).sum()
        assert found[i][0] == network.classes[int(p.argmax())] and math.isclose(found[i][1], p.max(), abs_tol=1e-4)


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, LONG, "aa", "s", 1), (2, LONG + "end", "aa", "s", 1), (3, "other text of few words", "bb", "s", 1), (4, "nnn ooo ppp", "bb", "s", 1)], DOCS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.duplicate_classes(docs, shingle_words=2).collect()} == {1: (1, 1), 2: (2, 2), 3: (4, 3), 4: (2, 4)}
    assert {r.doc_id: r.n_assign for r in secrets.scan_secrets(docs).collect()} == dict.fromkeys(range(1, 5), 0)
    assert len(language.identify(docs).collect()) == 4
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert {r.doc_id for r in quality.score_quality(docs, labels).collect()} == {1, 2, 3, 4}
    scored = {r.doc_id: r for r in katz.score_texts(docs).collect()}
    assert scored[1].n_tokens == 200_001 and all(math.isfinite(r.score) for r in scored.values())


def run(spark, tmp_path, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "none of these words stands in any document at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []).count() == 0


def test_pipeline_of_repeated_ids_clashing_columns_and_a_long_text(spark, tmp_path):
    rng = random.Random(3)
    letters = {"aa": "abcdefg", "bb": "nopqrst"}
    text = lambda k: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(60))
    rows = [(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb", "s", 10) for i in range(60)]
    rows += [(3, text("aa"), "aa", "s", 10), (None, text("bb"), "bb", "s", 10), (90, " ".join(text("aa") for _ in range(2000)), "aa", "s", 10)]
    clash = ", found string, score double, lang_pred string, row_ long, ids binary, `a.b` string"
    found = run(spark, tmp_path, [(*r, "f", 1.0, "l", 2, b"i", "x") for r in rows], DOCS + clash).collect()
    starts = [r for r in found if r.start == 0]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in starts) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert sum(r.length for r in found if r.doc_id == 90) == next(r.doc_tokens for r in found if r.doc_id == 90)
