"""Collocations, near-duplicate vectors and whitening against brute force, and their defined results at the edges."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchloom.llm import phrases, queries, vector_dup, whitening

TEXTS = "doc_id long, text string, lang string, phrase string, key string, n long, f long, part int, score double, rank long"
VECTORS = "vec_id long, embedding array<float>, label int, node long, vector string, ball long, x double, n long, unit string"


def texts(spark, rows):
    """Documents of (lang, text), with other columns whose names clash with what the operator makes."""
    return spark.createDataFrame([(i, t, lang, "p", "k", 1, 2, 3, 0.5, 4) for i, (lang, t) in enumerate(rows)], TEXTS).repartition(3)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "v", 3, 0.5, 4, "u") for i, v in rows], VECTORS).repartition(3)


def mined(rows, least, top):
    """All collocations by definition."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    known = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = {(lang, w[i:j]) for (lang, w), a in known.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= 100 * f[lang, w[i:j]]}
    found = defaultdict(list)
    for (lang, w), a in known.items():
        if (lang, w) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, le, r, n[lang], -s) for lang, own in found.items() for i, (s, a, p, le, r) in enumerate(sorted(own)[:top], 1)}


def as_set(df):
    return {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def prose(seed, n, words=12):
    rng = random.Random(seed)
    name = ["alpha", "Beta", "γάμμα", "d\x01e", "d", "naïve", "x\x85y", "İ", "zeta's", "(eta)", "theta", "a"][:words]
    weights = [30, 20, 10, 5, 5, 4, 3, 3, 2, 2, 1, 1][:words]
    out = []
    for i in range(n):
        text = " ".join(rng.choices(name, weights, k=rng.randint(0, 40)))
        text = re.sub(" ", lambda m: rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; "]) if rng.random() < 0.2 else " ", text)
        out.append((rng.choice(["en", "en", "en", "de", None]), text if i % 17 else None))
    return out


@pytest.mark.parametrize("block", [50, 400, 6_000_000])
def test_collocations_equal_their_definition(spark, monkeypatch, block):
    rows = prose(1, 300) + [("en", ""), ("en", " \t\n"), ("und", "one two, one two one two")] + [("fr", "de la belle vie")] * 40 + [("en", "Beta alpha " * 300), ("en", "alpha")]
    real = phrases.token_blocks
    monkeypatch.setattr(phrases, "token_blocks", lambda batches: real(batches, block))  # pickled with the function that calls it
    for least, top in ((5, 2000), (20, 7), (1, 50)) if block == 400 else ((5, 2000),):
        assert as_set(phrases.collocations(texts(spark, rows), least, top)) == mined(rows, least, top)


def test_collocations_with_a_full_bit_table(spark, monkeypatch):
    rows = prose(2, 200)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    assert as_set(phrases.collocations(texts(spark, rows), 10)) == mined(rows, 10, 2000)


def test_collocations_at_the_edges(spark):
    assert phrases.collocations(texts(spark, [])).count() == 0
    assert phrases.collocations(texts(spark, [("en", None), (None, ""), ("de", " ,\n. ")]), 1).count() == 0
    long = [("en", "one two three four five six " * 50_000)]
    found = phrases.collocations(texts(spark, long), 100).collect()
    assert {r.a for r in found} == {50_000, 49_999} and all(len(r.phrase.split()) == 5 for r in found)
    hot = [("en", f"common w{i % 7}") for i in range(2000)]  # one word begins every phrase
    assert as_set(phrases.collocations(texts(spark, hot), 10)) == mined(hot, 10, 2000)


def test_slices_of_a_long_text_lose_nothing():
    text = b" ".join(b"w%d" % (i % 50) for i in range(5000)) + b". end of it"
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text.decode()])], ["lang", "text"])
    whole = [w for _, words, skip in phrases.token_blocks(iter([batch]), 1000) for w in words[skip:]]
    assert whole == text.replace(b".", b" \xff ").split()


def linked(rows, cosine):
    """n_links and smallest reachable id by all pairs."""
    good = [(i, np.asarray(v, float) / np.linalg.norm(np.asarray(v, float))) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    near = {a: {b for b, (_, y) in enumerate(good) if b != a and len(x) == len(y) and x @ y >= cosine} for a, (_, x) in enumerate(good)}
    out = []
    for a, (i, _) in enumerate(good):
        ids = [good[b][0] for b in reach(near, a) if good[b][0] is not None]
        out.append((i, len(near[a]), min(ids, default=None)))
    return out


def reach(near, a):
    seen, todo = {a}, [a]
    while todo:
        for b in near[todo.pop()]:
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def groups(seed, dims=24):
    """Tight groups, loose ones around the threshold, chains, exact and scaled copies, and vectors alone."""
    rng = np.random.default_rng(seed)
    rows = [v for v in rng.normal(size=(150, dims))]
    for spread, size in ((0.05, 120), (0.2, 60), (0.33, 40), (0.6, 30)):
        centre = rng.normal(size=dims)
        rows += [centre + spread * rng.normal(size=dims) for _ in range(size)]
    step = rng.normal(size=dims)
    rows += [rows[0] + 0.25 * i * step for i in range(12)]
    rows += [rows[3]] * 5 + [rows[4] * 8.0, rows[4] * 0.5]
    return [(i, np.float32(v).tolist()) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [8, 1024])
def test_duplicate_vectors_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dup, "BLOCK", block)
    rows = groups(3)
    found = vector_dup.duplicate_vectors(vectors(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(linked(rows, 0.9))
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_duplicate_vectors_at_the_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (4, [2.0, 0.0]), (4, [1.0, 0.0]), (3, None), (2, []), (1, [0.0, 0.0]), (0, [1.0, None]), (9, [nan, 1.0]), (8, [inf, 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.1]), (None, [0.0, 1.0]), (6, [-1.0, 0.0]), (10, [3e38, 1e38])]
    found = vector_dup.duplicate_vectors(vectors(spark, rows)).collect()
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found)
    alone = [(i, 0, i, True) for i in (0, 1, 2, 3, 6, 7, 8, 9)]
    assert got == Counter([(5, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (None, 4, 4, False), (10, 4, 4, False), (None, 0, None, False), *alone])
    assert vector_dup.duplicate_vectors(vectors(spark, [])).count() == 0


def test_table_counts_keep_the_chance_of_a_miss():
    for n in (1, 1000, 10**6, 10**9):
        bits, tables = vector_dup.table_counts(n, 0.9)
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= vector_dup.MISSED
        assert n / 2**bits <= vector_dup.BUCKET


def test_minres_solves_symmetric_systems():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 30))
    a = a + a.T  # indefinite
    b = rng.normal(size=(30, 3))
    assert np.abs(a @ whitening.minres(lambda y: a @ y, b, 60) - b).max() < 1e-6
    errors = [np.linalg.norm(a @ whitening.minres(lambda y: a @ y, b, k) - b) for k in range(1, 12)]
    assert all(x >= y - 1e-9 for x, y in zip(errors, errors[1:], strict=False))
    assert not whitening.minres(lambda y: a @ y, np.zeros((30, 1)), 5).any()


@pytest.mark.parametrize(("size", "k"), [(3, 5), (40, 8), (300, 6), (300, 32)])
def test_leading_eigenpairs(size, k):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, size)) * np.linspace(3, 1, size)
    v = x.T @ x / 400
    calls = []
    values, vectors_ = whitening.leading_eigenpairs(lambda u: calls.append(u.shape[1]) or v @ u, size, k)
    want, axes = np.linalg.eigh(v)
    k = min(k, size)
    assert np.allclose(values, want[::-1][:k], rtol=1e-12) and np.allclose(abs((axes[:, ::-1][:, :k] * vectors_).sum(0)), 1, atol=1e-9)
    assert np.abs(v @ vectors_ - vectors_ * values).max() < 1e-11 * want[-1]


def whitened_by_definition(rows, k):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in rows], object)
    n, s = len(x), x.sum(0)
    c = (n * x - s).astype(float) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return ((n * x - s) ** 2).sum(1), c @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_equals_its_definition(spark):
    rng = np.random.default_rng(6)
    x = np.float32(rng.normal(size=(500, 40)) * np.linspace(4, 1, 40))
    x[:170] = x[0]  # a third of all rows are one vector
    found = whitening.whitened(vectors(spark, list(enumerate(x.tolist()))), 32).toPandas()
    deviation, white, explained = whitened_by_definition(x.tolist(), 32)
    got = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(abs(got), abs(white), atol=1e-8) and (np.sign(got * white).sum(0).__abs__() > 400).all()
    one = found[found.component == 1].sort_values("vec_id")
    assert [int(d) for d in one.deviation] == deviation.tolist() and set(found.n) == {500}
    assert np.allclose(found.groupby("component").explained.first(), explained, rtol=1e-10) and found.identity_error.max() < 1e-9


def test_whitening_at_the_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i), 1.0, float(i * i)]) for i in range(6)]
    odd = [(10, None), (11, []), (12, [nan, 1.0, 2.0]), (13, [inf, 1.0, 2.0]), (14, [None, 1.0, 2.0]), (15, [1.0, 2.0])]
    found = whitening.whitened(vectors(spark, rows + odd + [rows[0], (None, [7.0, 1.0, 0.0])])).toPandas()
    assert set(found.component) == {1, 2} and set(found.n) == {8} and len(found) == 16  # the second entry is constant
    assert found.vec_id.isna().sum() == 2 and found.identity_error.max() < 1e-9
    for few in ([], odd[:1], rows[:1], [rows[1]] * 4):
        assert whitening.whitened(vectors(spark, few)).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(vectors(spark, [(1, [3e38]), (2, [0.0])])).count()


def test_deviations_beyond_64_bits_are_exact(spark):
    rows = [[float(2**i), 0.0] for i in range(40)]
    found = whitening.whitened(vectors(spark, list(enumerate(rows)))).orderBy("vec_id").filter("component = 1").collect()
    assert [int(r.deviation) for r in found] == whitened_by_definition(rows, 1)[0].tolist()


def test_registered_queries_run(spark, small):
    assert queries.op11_phrases(spark, small).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = queries.op12_vector_duplicates(spark, small)
    assert found.count() == 500 and found.filter(F.col("kept")).count() == found.select("component_id").distinct().count()
    assert dict(queries.op13_whitening(spark, small).dtypes)["deviation"] == "bigint"
