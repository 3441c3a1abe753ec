"""Ranks, random rows, quantiles, neighbours and pairs against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.operators import ranks, rows, splits


def test_ranks(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["a", "b", None]), f"{rng.randrange(16**6):06x}"[: rng.choice([4, 6])].ljust(6, "0"), rng.randint(1, 5)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, g string, h string, w int")
    found = {r.id: (r.r_, r.n_, r.before_) for r in ranks.ranked(df, ["g"], F.col("h"), ["id"], F.col("w")).collect()}
    for g in ("a", "b", None):
        own, before = sorted((h, i, w) for i, x, h, w in data if x == g), 0
        for place, (_, i, w) in enumerate(own, 1):
            assert found[i] == (place, len(own), before)
            before += w
    order = sorted((h, i) for i, _, h, _ in data)
    for n in (0, 1, 77, 500, 600):
        assert {r.id for r in ranks.least_rows(df, n, F.col("h"), ["id"]).collect()} == {i for _, i in order[:n]}
        assert {r.id for r in ranks.least_rows(df, n, F.col("h"), ["id"], last=True).collect()} == {i for _, i in order[len(order) - min(n, 500) :]}


@pytest.mark.parametrize("few", [1, 10_000])
def test_quantiles(spark, few, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", few)
    rng = random.Random(4)
    values = [None] * 5 + [7.0] * 40 + [rng.lognormvariate(0, 6) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranks.quantiles(df, "v", [0.0, 0.1, 0.5, 0.9, 1.0])
    assert np.allclose(got, np.quantile([v for v in values if v is not None], [0, 0.1, 0.5, 0.9, 1]), rtol=1e-12)
    assert ranks.quantiles(df.limit(0), "v", [0.5]) == [None] and ranks.quantiles(df.filter("v = 7"), "v", [0.3]) == [7.0]


def test_nearest_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    want = {}
    for i in range(60):
        d = ((x.astype(float) - x[i].astype(float)) ** 2).sum(1)
        want[i] = [j for j in np.argsort(d, kind="stable") if j != i][:3]
    got = collections.defaultdict(list)
    for r in sorted(splits.nearest(df, 3, block=7).collect(), key=lambda r: r.place):
        got[r.a].append(r.b)
    assert got == want


def test_smote_vectors_grow_to_half(spark):
    df = spark.createDataFrame([(i, "unsafe" if i < 4 else "safe", [float(i), 1.0]) for i in range(60)], "id long, label string, vector array<float>")
    n = collections.Counter(r.label for r in splits.smote_vectors(df, 3).collect())
    assert n == {"safe": 30, "unsafe": 30}


def test_pairs_are_made_while_any_fits(spark):
    v = spark.createDataFrame([(i, "p", "a") for i in range(10)] + [(20, "q", "a"), (21, "q", "b"), (22, "q", "a")], "id long, project string, file_path string")
    n = spark.createDataFrame([("p", f"s{i}", "b" if i < 10 else "a", "m") for i in range(50)] + [("q", f"t{i}", "a", "m") for i in range(5)], "project string, sha string, file_path string, message string")
    found = rows.pair_negatives(v, n, 1).collect()
    assert len(found) == 13 and all(r.non_vuln_file_path == "b" for r in found if r.project == "p")
    assert [r.id for r in found if r.non_vuln_file_path is None] in ([20, 22], [22, 20])
    assert all(r.non_vuln_file_path != r.file_path for r in found)
