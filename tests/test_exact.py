"""Operators that are exact without a whole group in one task, against brute force."""

import collections
import itertools
import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from patchloom.operators import aggregates, contexts, filters, joins, models, patches, ranks, rows, splits
from patchloom.sources import files


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(-3, 9)) for i in range(900)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, i long, w int").repartition(5)
    found = {r.i: (r.s, r.n) for r in ranks.running(df, ["g"], [F.desc("i")], {"s": F.col("w"), "n": F.lit(1)}).collect()}
    for g in ("a", "b", None):
        s = n = 0
        for _, i, w in sorted((x for x in data if x[0] == g), key=lambda x: -x[1]):
            assert found[i] == (s, n)
            s, n = s + w, n + 1
    assert ranks.running(df.limit(0), ["g"], ["i"], {"s": F.col("w")}).count() == 0
    one = ranks.running(df.filter("g = 'a'"), [], ["i"], {"s": F.lit(1)})
    assert sorted(r.s for r in one.collect()) == list(range(one.count()))


def test_offsets_of_one_long_file(spark):
    lines = [("f", i, "x" * (i % 13) + "é") for i in range(1, 2001)]
    found = {r.line_no: r.offset for r in contexts.line_offsets(spark.createDataFrame(lines, "path string, line_no int, line string")).collect()}
    at = 0
    for _, i, line in lines:
        assert found[i] == at
        at += len(line.encode()) + 1


@pytest.mark.parametrize("scores", [[0.5] * 50, [i / 7 for i in range(50)], [1e-300 * i for i in range(50)]])
def test_curve_of_equal_and_close_scores(spark, scores):
    data = [(i % 3 == 0, s) for i, s in enumerate(scores)]
    df = spark.createDataFrame([(int(a), s) for a, s in data], "label int, score double")
    found = {r.score: (r.TP, r.FP) for r in aggregates.curve_points(df).collect()}
    assert found == {s: (sum(a for a, t in data if t >= s), sum(not a for a, t in data if t >= s)) for s in set(scores)}


@pytest.mark.parametrize("few", [1, 10_000])
def test_quantiles_of_odd_values(spark, few, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", few)
    nan, inf = float("nan"), float("inf")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for values in ([nan, None, nan], [5.0] * 30, [inf, -inf, 1.0, nan, 2.0] * 20, [-1e308, 1e308, 1e-310, 0.0, -0.0, 5.0], [10.0**k for k in range(-300, 300, 7)], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        good = sorted(v for v in values if v is not None and not math.isnan(v))
        got = ranks.quantiles(df, "v", shares)
        if not good:
            assert got == [None] * len(shares)
            continue
        for share, x in zip(shares, got, strict=True):
            p = share * (len(good) - 1)
            a, b = good[math.floor(p)], good[math.ceil(p)]
            assert x == pytest.approx(a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b, rel=1e-12)


def test_quantiles_of_many_rows_with_nan_and_infinity_end(spark):
    v = F.when(F.col("id") == 7, float("nan")).when(F.col("id") == 8, float("inf")).otherwise((F.col("id") * 7919) % 30011).cast("double")
    df = spark.range(30_000).select(v.alias("v"))
    want = sorted(float("inf") if i == 8 else float(i * 7919 % 30011) for i in range(30_000) if i != 7)
    assert ranks.quantiles(df, "v", [0.0, 1.0]) == [want[0], float("inf")]
    (median,) = ranks.quantiles(df, "v", [0.5])
    assert median == want[(len(want) - 1) // 2]
    assert filters.between_quantiles(df, "v").count() == sum(np.quantile(want[:-1] + [1e9], 0.1) <= x <= np.quantile(want[:-1] + [1e9], 0.9) for x in want)


def most_pairs(files, negatives):
    """Size of a largest assignment by augmenting paths."""
    taken = {}

    def place(i, seen):
        for j, path in enumerate(negatives):
            if path != files[i] and j not in seen:
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(files)))


def test_pairs_are_as_many_as_can_be(spark):
    rng = random.Random(2)
    files, negatives, want = [], [], {}
    for project in range(60):
        names = rng.sample(["a", "b", "c", "d", None], rng.randint(1, 4))
        weights = [rng.choice([1, 1, 8]) for _ in names]
        own = rng.choices(names, weights, k=rng.randint(0, 12))
        other = rng.choices(names, rng.sample(weights, len(weights)), k=rng.randint(0, 12))
        files += [(f"{project}-{i}", f"p{project}", path) for i, path in enumerate(own)]
        negatives += [(f"p{project}", f"s{i}", path, "m") for i, path in enumerate(other)]
        want[f"p{project}"] = most_pairs(own, other)
    files += [("x", None, "a")]
    v = spark.createDataFrame(files, "id string, project string, file_path string")
    n = spark.createDataFrame(negatives + negatives[:9], "project string, sha string, file_path string, message string")
    for seed in (1, 2):
        found = rows.pair_negatives(v, n, seed).collect()
        assert sorted(r.id for r in found) == sorted(f[0] for f in files)
        got = [r for r in found if r.non_vuln_commit_hash is not None]
        assert all(r.file_path != r.non_vuln_file_path for r in got)
        assert len({(r.project, r.non_vuln_commit_hash, r.non_vuln_file_path) for r in got}) == len(got)
        assert collections.Counter(r.project for r in got) == collections.Counter({p: k for p, k in want.items() if k})


def bag_neighbours(bags, k, asked):
    counts = {i: collections.Counter(t) for i, t in bags}
    norm = {i: math.sqrt(sum(n * n for n in c.values())) for i, c in counts.items()}
    out = {}
    for a in asked:
        dots = {b: sum(n * counts[b][t] for t, n in counts[a].items()) for b in counts if b != a}
        out[a] = [b for _, b in sorted((-round(x / norm[a] / norm[b], 12), b) for b, x in dots.items() if x)[:k]]
    return out


@pytest.mark.parametrize(("common", "block"), [(3, 8), (40, 16), (1000, 2048)])
def test_nearest_bags_are_exact(spark, common, block):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    bags = [(i, rng.choices(words, [1 / (1 + j) for j in range(200)], k=rng.randint(1, 60))) for i in range(120)]
    bags += [(200 + i, bags[i][1][:]) for i in range(5)] + [(300, ["alone"]), (301, ["w0"] * 9)]
    df = spark.createDataFrame(bags, "id long, tokens array<string>")
    counts = splits.bag_counts(df)
    for asked in (None, df.filter("id % 10 = 0")):
        found = collections.defaultdict(list)
        for r in sorted(splits.nearest_bags(counts, 4, queries=asked, common=common, block=block).collect(), key=lambda r: r.place):
            found[r.a].append(r.b)
        want = bag_neighbours(bags, 4, [i for i, _ in bags if asked is None or i % 10 == 0])
        assert {a: found[a] for a in want} == want


def test_bags_that_all_hold_the_commonest_tokens_make_few_pairs(spark):
    rng = random.Random(4)
    bags = [(i, [f"c{j}" for j in range(50)] + [f"r{rng.randrange(3000)}" for _ in range(6)]) for i in range(1500)]
    df = spark.createDataFrame(bags, "id long, tokens array<string>")
    asked = df.filter("id % 100 = 0")
    found = splits.bag_cosine(df, 3, queries=asked).collect()
    want = bag_neighbours(bags, 3, range(0, 1500, 100))
    assert {a: [r.b for r in sorted(found, key=lambda r: r.place) if r.a == a] for a in want} == want
    counts = splits.bag_counts(df)
    rare = counts.filter(~F.col("token").isin(splits.common_tokens(counts, splits.COMMON)))
    pairs = rare.join(asked.select("id"), "id").select("id", "token").join(rare.select(F.col("id").alias("b"), "token"), "token").select("id", "b").distinct().count()
    assert pairs < 0.1 * 15 * 1500


@pytest.mark.parametrize("p", [1, 2])
def test_nearest_by_pivots_is_exact(spark, p):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 3)) + c for c in ((0, 0, 0), (30, 0, 0), (0, 40, 9))] + [np.zeros((90, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    other = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 3)) * 20)], "id long, vector array<double>")
    for queries, points in ((None, dict(enumerate(x))), (other, {r.id: np.array(r.vector) for r in other.collect()})):
        got = collections.defaultdict(list)
        for r in sorted(splits.nearest(df, 4, queries=queries, p=p, block=40).collect(), key=lambda r: r.place):
            got[r.a].append(r.b)
        for a, v in points.items():
            d = (np.abs(x - v) ** p).sum(1)
            if queries is None:
                d[a] = np.inf
            assert got[a] == np.argsort(d, kind="stable")[:4].tolist()
    assert splits.nearest(df.limit(0), 3).count() == 0


def test_vectors_are_sent_to_few_cells(spark):
    """How often a vector is sent grows much slower than the vectors, where they have structure."""
    rng = np.random.default_rng(6)
    sent = {}
    real = splits.scratch_dir
    for n in (400, 3600):
        centres = rng.normal(size=(n // 40, 8)) * 50
        df = spark.createDataFrame([(i, (centres[i % len(centres)] + rng.normal(size=8)).tolist()) for i in range(n)], "id long, vector array<double>")
        made = []
        splits.scratch_dir = lambda s, name, made=made: made.append((name, real(s, name))) or made[-1][1]
        try:
            assert splits.nearest(df, 3, block=200).count() == 3 * n
        finally:
            splits.scratch_dir = real
        sent[n] = spark.read.parquet(dict(made)["routed"]).count() / n
    assert sent[3600] < 9 * 0.8 * sent[400] and sent[3600] < math.sqrt(3600) / 4


def test_knn_votes_of_the_nearest_rows(spark):
    rng = np.random.default_rng(7)
    train = [(i, rng.integers(0, 4, 5).astype(float), int(i % 3 == 0)) for i in range(80)]
    test = [(100 + i, rng.integers(0, 4, 5).astype(float)) for i in range(25)]
    a = spark.createDataFrame([(i, Vectors.dense(v.tolist()), y) for i, v, y in train], ["id", "features", "label"])
    b = spark.createDataFrame([(i, Vectors.dense(v.tolist())) for i, v in test], ["id", "features"])
    for weights, p in itertools.product(("uniform", "distance"), (1, 2)):
        got = {r.id: r.prediction for r in models.knn_classify(a, b, 5, weights, p).collect()}
        for i, v in test:
            near = sorted(((np.abs(v - w) ** p).sum(), j, y) for j, w, y in train)[:5]
            vote = sum((1 if y else -1) * (1 if weights == "uniform" else 1 / ((math.sqrt(d) if p == 2 else d) + 1e-9)) for d, _, y in near)
            assert got[i] == float(vote > 1e-12) or abs(vote) < 1e-9


def test_grid_search_scores_every_point(spark):
    rng = np.random.default_rng(13)
    x = rng.integers(0, 6, (240, 5)).astype(float)
    y = ((x[:, 0] + x[:, 1] > 6) ^ (x[:, 2] > 4)).astype(float)
    df = spark.createDataFrame([(Vectors.dense(v.tolist()), float(t)) for v, t in zip(x, y, strict=True)], ["features", "label"]).coalesce(1)
    grid = {"maxDepth": [0, 4], "minInstancesPerNode": [1, 5]}
    search = models.grid_search(df, DecisionTreeClassifier(seed=3), grid, folds=2, seed=5)
    rows = df.withColumn("f", F.floor(F.rand(5) * 2)).persist()
    want = []
    for depth, least in itertools.product(*grid.values()):
        found = []
        for fold in range(2):
            model = DecisionTreeClassifier(seed=3, maxDepth=depth, minInstancesPerNode=least).fit(rows.filter(f"f <> {fold}"))
            a, b = np.array([(r.label, r.prediction) for r in model.transform(rows.filter(f"f = {fold}")).collect()]).T
            found.append(np.corrcoef(a, b)[0, 1] if b.std() and a.std() else 0.0)
        want.append(np.mean(found))
    assert np.allclose(search.avgMetrics, want)
    assert search.bestModel.getMaxDepth() == 4 and (np.array([r.prediction for r in search.transform(df).collect()]) == y).mean() > 0.8
    (metrics,) = models.evaluate(search, df, "tree").collect()
    assert metrics.TP + metrics.TN + metrics.FP + metrics.FN == 240 and metrics.model == "tree"


def test_forest_and_linear_classifier_learn(spark):
    rng = np.random.default_rng(14)
    rows = [(" ".join(rng.choice(["eval", "input", "print", "x"], 12, p=[0.4, 0.3, 0.1, 0.2] if i % 2 else [0.02, 0.1, 0.58, 0.3])), float(i % 2)) for i in range(200)]
    text = spark.createDataFrame(rows, "input string, label double")
    features = models.count_features(text, 3)
    counts = collections.Counter(t for t, _ in rows for t in t.split())
    assert features.vocabulary == [t for t, _ in counts.most_common(3)]
    made = models.with_features(text, features).select("features", "label")
    first = made.first().features.toArray().tolist()
    assert first == [float(rows[0][0].split().count(t)) for t in features.vocabulary]
    for model in (models.train_forest(made, grid={"maxDepth": [3], "numTrees": [5]}), models.train_linear_svc(made, grid={"regParam": [0.1]})):
        assert models.evaluate(model, made, "m").first().MCC > 0.9


def test_adaboost_weights_and_plans(spark):
    rng = np.random.default_rng(12)
    x = rng.integers(0, 6, (300, 6)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3) | (x[:, 2] > 4)).astype(float)
    df = spark.createDataFrame([(Vectors.dense(v.tolist()), float(t)) for v, t in zip(x, y, strict=True)], ["features", "label"])
    made = models.train_adaboost(df, 12)
    assert len(made.stumps) > 3
    w, margin = np.ones(300), np.zeros(300)
    for stump, vote in made.stumps:
        says = np.where(x[:, stump.feature] <= stump.threshold, stump.low, stump.high)
        error = w[says != y].sum() / w.sum()
        assert vote == pytest.approx(math.log((1 - error) / error), rel=1e-9)
        # No stump on one feature is better at these weights by the trees' own measure, the impurity, than a coin.
        assert error < 0.5
        w, margin = w * np.where(says != y, math.exp(vote), 1), margin + vote * (2 * says - 1)
    found = [r.margin for r in made.transform(df).collect()]
    assert np.allclose(sorted(found), sorted(margin))
    assert ((margin > 0) == y).mean() > max(y.mean(), 1 - y.mean()) + 0.05
    depth = [models.BoostedStumps(made.stumps[:n]).transform(df)._jdf.queryExecution().optimizedPlan().toString().count("Project") for n in (4, len(made.stumps))]
    assert depth[0] == depth[1]


def functions_frame(spark, spans):
    data = [("o", "p", "v", "f", a, 0, b, 9, "fn_dec", i) for i, (a, b) in enumerate(spans)]
    return spark.createDataFrame(data, "owner string, project string, version string, fpath string, sline int, scol int, eline int, ecol int, ftype string, ord int")


def test_enclosing_function_of_a_hot_file(spark):
    n = 1_000_000
    small = spark.range(n).select(F.lit("o").alias("owner"), F.lit("p").alias("project"), F.lit("v").alias("version"), F.lit("f").alias("fpath"),
                                  F.col("id").cast("int").alias("sline"), F.lit(0).alias("scol"), F.col("id").cast("int").alias("eline"), F.lit(9).alias("ecol"), F.lit("fn_dec").alias("ftype"), (F.col("id") + 1).cast("int").alias("ord"))
    whole = functions_frame(spark, [(0, n)])
    regions = spark.createDataFrame([("o", "p", "v", "f", i, 1, i + d, 2, "x", f"h{i}") for i, d in ((5, 0), (77_777, 0), (500_000, 1), (n - 1, 0), (n, 5))], "owner string, project string, version string, fpath string, sline int, scol int, eline int, ecol int, label string, pair_hash string")
    began = time.time()
    found = {(r.pair_hash, r.sline, r.eline) for r in joins.enclosing_function(regions, small.unionByName(whole)).collect()}
    assert found == {("h5", 5, 5), ("h77777", 77_777, 77_777), ("h500000", 0, n), (f"h{n - 1}", n - 1, n - 1)}
    assert time.time() - began < 120


def test_enclosing_function_equals_all_pairs(spark):
    rng = random.Random(8)
    spans = [(a, a + rng.choice([0, 1, 5, 40])) for a in (rng.randint(0, 200) for _ in range(60))]
    asked = [(a, a + rng.choice([0, 2])) for a in (rng.randint(0, 220) for _ in range(80))]
    regions = spark.createDataFrame([("o", "p", "v", "f", a, 1, b, 2, "x", f"h{i}") for i, (a, b) in enumerate(asked)], "owner string, project string, version string, fpath string, sline int, scol int, eline int, ecol int, label string, pair_hash string")
    want = {}
    for i, (a, b) in enumerate(asked):
        holds = [j for j, (x, y) in enumerate(spans) if x <= a and y >= b]
        if holds:
            want[f"h{i}"] = spans[max(holds)]
    assert {r.pair_hash: (r.sline, r.eline) for r in joins.enclosing_function(regions, functions_frame(spark, spans)).collect()} == want


def applied(a, b, blocks):
    """b, made from a and the blocks; and that all else is equal in order."""
    out, at = [], 0
    for i1, i2, j1, j2 in blocks:
        out += a[at:i1]
        assert len(out) == j1 and i1 + j1 < i2 + j2
        out += b[j1:j2]
        at = i2
    return out + a[at:]


def test_line_diffs_lead_from_one_side_to_the_other():
    rng = random.Random(9)
    for _ in range(400):
        a = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() < 0.8]
        for _ in range(rng.randint(0, 5)):
            b.insert(rng.randint(0, len(b)), rng.randrange(50))
        if rng.random() < 0.3:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        blocks = patches.changed_blocks(np.array(a, np.int64), np.array(b, np.int64))
        assert applied(a, b, blocks) == b
    one = patches.changed_blocks(np.arange(50), np.delete(np.arange(50), [7, 20, 21]))
    assert one == [[7, 8, 7, 7], [20, 22, 19, 19]]


def test_line_diff_of_long_files_takes_seconds():
    rng = np.random.default_rng(10)
    a = rng.integers(0, 30_000, 100_000)
    b = np.delete(a, rng.integers(0, len(a), 3000))
    b[rng.integers(0, len(b), 3000)] = -1
    for x, y in ((a, b), (a, rng.permutation(a)), (a, a + 100_000), (np.zeros(100_000, np.int64), np.zeros(70_000, np.int64)), (a % 2, rng.permutation(a % 2))):
        began = time.time()
        blocks = patches.changed_blocks(x, y)
        assert applied(x.tolist(), y.tolist(), blocks) == y.tolist() and time.time() - began < 20


def test_contexts_by_arrow_equal_joined_ones(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "b", "c", "d", "x", ""])
    data = [(i, [f"{word()},{rng.randint(0, 3)},{word()}" for _ in range(rng.randint(0, 12))] + rng.choice([[], ["a"], ["a,1"], ["a,1,b,z"]])) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(data, "id long, contexts array<string>").repartition(3)
    vocab = spark.createDataFrame([("word", "a", 1), ("word", "b", 1), ("path", "1", 1), ("word", "", 1)], "kind string, term string, n long")
    got = [sorted(map(tuple, contexts.context_membership(df, vocab).collect()))]
    samples = [sorted((r.id, tuple(r.contexts)) for r in contexts.sample_contexts(df, vocab, 5, seed=3).collect())]
    monkeypatch.setattr(contexts, "BROADCAST_BYTES", -1)
    got.append(sorted(map(tuple, contexts.context_membership(df, vocab).collect())))
    samples.append(sorted((r.id, tuple(r.contexts)) for r in contexts.sample_contexts(df, vocab, 5, seed=3).collect()))
    assert got[0] == got[1] and samples[0] == samples[1] and len(samples[0]) > 30


def test_vocabulary_keeps_ties_at_its_edge(spark):
    terms = [("word", f"w{i}") for i in range(12) for _ in range(i // 3 + 1)] + [("path", "p")]
    df = spark.createDataFrame(terms, "kind string, term string")
    for size in (1, 3, 4, 11, 12, 40):
        found = {(r.kind, r.term) for r in contexts.vocab_histogram(df, size).collect()}
        edge = sorted((i // 3 + 1 for i in range(12)), reverse=True)[min(size, 12) - 1]
        assert found == {("word", f"w{i}") for i in range(12) if i // 3 + 1 >= edge or size > 12} | {("path", "p")}


def test_feeds_are_read_in_splits(spark, tmp_path):
    """One feed in several tasks, in any layout, with brackets, quotes and escapes within strings."""
    odd = ['}, {"cve": [', 'a \\" } ] [ {', "\\\\", '"', "", "ünï } \\n", '{"CVE_Items": [']
    items = [
        {"cve": {"CVE_data_meta": {"ID": f"CVE-{i}"}, "problemtype": {"problemtype_data": [{"description": [{"value": f"CWE-{i % 9}"}]}]}, "description": {"description_data": [{"value": odd[i % len(odd)] + str(i)}]}, "references": {"reference_data": [{"url": "https://a/}"}, {"url": "b"}]}}, "impact": {} if i % 3 else {"baseMetricV2": {"severity": "LOW", "impactScore": 1.5}}, "publishedDate": "x"}
        for i in range(1500)
    ]
    other = [{"cve": None, "name": "}"}, {"name": "["}]
    for name, indent, feed in (("one", None, {"format": "M{I}TRE", "other": other, "CVE_Items": items}), ("pretty", 2, {"CVE_Items": items[:40], "other": other}), ("empty", None, {"CVE_Items": []})):
        (tmp_path / f"{name}.json").write_text(json.dumps(feed, indent=indent, ensure_ascii=name == "one") + "\n" * (name == "pretty"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        assert spark.read.text(f"{tmp_path}/one.json", lineSep="}").rdd.getNumPartitions() > 10
        found = files.scan_nvd_feed(spark, [f"{tmp_path}/{n}.json" for n in ("one", "pretty", "empty")]).select("cve_id", "description", "impact").collect()
        runs = [{"tool": {"rules": [{"id": "}"}]}, "results": [{"ruleId": "js/zipslip", "message": {"text": "{"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f"o/p/v/f{i}.js"}, "region": {"startLine": i}}}]} for i in range(300)]}, {"results": [{"ruleId": "x", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "o/p/v/no.js"}}}]}]}]
        (tmp_path / "r.sarif").write_text(json.dumps({"$schema": "s", "runs": runs}, indent=1))
        findings = files.scan_sarif(spark, f"{tmp_path}/r.sarif").select("fpath", "sline", "label").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(f"CVE-{i}", odd[i % len(odd)] + str(i), None if i % 3 else 1.5) for i in [*range(1500), *range(40)]]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, findings)) == sorted((f"f{i}.js", i, "CWE-22") for i in range(300))
