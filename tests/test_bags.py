"""Bags by brute force, and what their plans leave out."""

import collections
import hashlib
import math
import random

from pyspark.sql import functions as F

from patchloom.operators import splits


def test_all_pairs_of_queries_without_a_join_of_tokens(spark):
    rng = random.Random(5)
    bags = [(i, rng.choices([f"w{j}" for j in range(80)], [1 / (1 + j) for j in range(80)], k=rng.randint(0, 12))) for i in range(300)] + [(300, ["w0", None, "w0"]), (301, None)]
    df = spark.createDataFrame(bags, "id long, tokens array<string>")
    out = splits.bag_cosine(df, queries=df.filter("id % 100 = 0"))
    counts = {i: collections.Counter(t or []) for i, t in bags}
    norm = {i: math.sqrt(sum(n * n for n in c.values())) for i, c in counts.items()}
    want = {}
    for a in range(0, 301, 100):
        for b in counts:
            dot = sum(n * counts[b][t] for t, n in counts[a].items() if t is not None)
            if a != b and dot:
                want[a, b] = dot / norm[a] / norm[b]
    found = {(r.a, r.b): r.similarity for r in out.collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-12 for p in want)
    assert "token#" not in out._jdf.queryExecution().toString()


def test_new_bags_follow_the_rule_and_are_made_of_whole_bags(spark):
    rng = random.Random(6)
    bags = [(i, "unsafe" if i % 6 == 0 else "safe", [f"w{rng.randrange(12)}" for _ in range(rng.randint(3, 9))]) for i in range(60)]
    df = spark.createDataFrame(bags, "id long, label string, tokens array<string>")
    out = splits.smote_bags(df, 4)
    assert "token#" not in out._jdf.queryExecution().toString()
    new = sorted(" ".join(r.tokens) for r in out.filter(F.col("id").isNull()).collect())

    unsafe = {i: t for i, label, t in bags if label == "unsafe"}
    near = collections.defaultdict(list)
    for r in splits.bag_cosine(df.filter("label = 'unsafe'"), 5).collect():
        near[r.a].append(r.b)
    digest = lambda *parts: hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    fraction = lambda *parts: int(digest(*parts)[:8], 16) / 2**32
    wanted, made = 30 - len(unsafe), {}
    for t in range(-(-10 * wanted // len(unsafe))):
        for a in sorted(near):
            b = sorted(near[a])[int(fraction(4, a, t) * len(near[a]))]
            sums = collections.Counter(unsafe[a]) + collections.Counter(unsafe[b])
            bag = " ".join(w for w in sorted(sums) for _ in range(math.floor(sums[w] / 2 + (fraction(5, a, t, w) - 0.5) * 0.4 + 0.5)))
            if bag and bag not in {" ".join(sorted(x)) for x in unsafe.values()}:
                made.setdefault(bag, (t, a))
    assert new == sorted(sorted(made, key=lambda bag: (digest(6, *made[bag]), *made[bag]))[:wanted])
