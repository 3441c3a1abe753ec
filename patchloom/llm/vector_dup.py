"""Near-duplicate classes of vectors by random-hyperplane sign hashing, each link confirmed by its exact cosine.

Nodes are distinct vectors, so exact copies never multiply. A node has a key in each of several tables: the signs of its
products with a few random hyperplanes; and a sketch of 256 more signs. Nodes are first gathered into balls: in the first
tables every node looks at the smallest node of its bucket and, where that one lies within half the angle of a link, joins
its ball. Any two members of a ball are thus linked, and need no comparison. In the tables' buckets, balls (most of them of
one node) are then compared by their centres' sketches in blocks of bounded size, and the pairs left are settled by exact
angles: by the triangle inequality for whole balls, member by member where that leaves it open. So a group of near copies
costs about its size, and buckets, balls and pairs of any size are spread over tasks.

The number of hyperplanes grows with the logarithm of the nodes, which keeps buckets at about BUCKET nodes, and there are as
many tables as make a pair at the threshold miss all of them with probability MISSED.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import lean_worker, removed, written
from patchloom.llm.near_dup import bounded, components

#: Expected unrelated nodes of a bucket, and the probability that a pair at the threshold shares no table.
BUCKET, MISSED = 256, 1e-5
#: Tables in which nodes look for a ball, and tables whose buckets are compared in one round.
BALL_TABLES, ROUND = 4, 16
SKETCH = 256
#: Nodes of a block.
BLOCK = 1024
#: The sketch as longs.
LONGS = [f"s{i}" for i in range(SKETCH // 64)]
#: Standard deviations by which a sketch may differ more than expected, and room for rounding in angles.
SPREAD, ROUNDING = 5.0, 1e-7


def table_counts(n: int, cosine: float) -> tuple[int, int]:
    """(hyperplanes of a table, tables) for n nodes."""
    same = 1 - math.acos(cosine) / math.pi
    bits = min(40, max(6, math.ceil(math.log2(max(1, n) / BUCKET))))
    return bits, math.ceil(math.log(MISSED) / math.log1p(-(same**bits)))


def finite_entries(vector: Column) -> Column:
    """Whether a vector is there and has only finite entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def _clean(vector: Column) -> Column:
    return finite_entries(vector) & F.coalesce(F.exists(vector, lambda c: c != 0), F.lit(False))


def _unit(vector: np.ndarray) -> np.ndarray:
    x = np.asarray(vector, np.float64)
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def _signs(x: np.ndarray, planes: int, seed: int) -> np.ndarray:
    """Rows of bits: on which side of random hyperplanes the rows of x lie; the same planes wherever this runs."""
    return x @ np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], planes)) >= 0


def signatures(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """node, unit (vector of length 1, little-endian doubles), keys (one a table), LONGS (sketch); nodes has node, vector."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker()
        weights = 1 << np.arange(bits, dtype=np.int64)
        first = np.arange(tables, dtype=np.int64) << bits
        for batch in batches:
            for size, own in batch.groupby(batch["vector"].map(len)):
                for low in range(0, len(own), 2048):
                    part = own.iloc[low : low + 2048]
                    x = np.stack([_unit(v) for v in part["vector"]])
                    keys = _signs(x, bits * tables, 1).reshape(len(x), tables, bits) @ weights + first + (np.int64(size) << 52)
                    sketch = np.packbits(_signs(x, SKETCH, 2), axis=1).view(np.int64)
                    made = pd.DataFrame({"node": part["node"], "unit": [v.astype("<f8").tobytes() for v in x], "keys": list(keys)})
                    yield made.assign(**{name: sketch[:, i] for i, name in enumerate(LONGS)})

    return nodes.select("node", "vector").mapInPandas(sign, "node long, unit binary, keys array<long>, " + ", ".join(f"{c} long" for c in LONGS))


def _cosines(pairs: DataFrame, u: str, v: str) -> DataFrame:
    """pairs' long columns with cosine in place of the units u and v."""
    names = [c for c in pairs.columns if c not in (u, v)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dot = [float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(batch[u], batch[v], strict=True)]
            yield batch[names].assign(cosine=np.array(dot, np.float64))

    return pairs.mapInPandas(run, ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names) + ", cosine double")


def _differ() -> Column:
    """Signs in which a node's sketch and that of its bucket's head, in columns named with an h before, differ."""
    return reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"h{c}"))) for c in LONGS])


def _sketch_limit(angle: float) -> float:
    """Signs of a sketch in which vectors at this angle differ at most, but for chances below 1e-6."""
    share = angle / math.pi
    return SKETCH * share + SPREAD * math.sqrt(SKETCH * share * (1 - share))


def gathered(signed: DataFrame, most: float) -> DataFrame:
    """node, ball, angle of every node: ball is the node at its centre, at no more than most / 2."""
    keys = signed.select("node", *LONGS, F.explode(F.slice("keys", 1, BALL_TABLES)).alias("key"))
    heads = keys.groupBy("key").agg(F.min(F.struct("node", *[F.col(c).alias(f"h{c}") for c in LONGS])).alias("head"), F.count("*").alias("n"))
    heads = written(heads.filter("n > 1").select("key", F.col("head.node").alias("centre"), *[f"head.h{c}" for c in LONGS]), "vector-heads")
    asked = keys.join(bounded(heads), "key").filter((F.col("node") != F.col("centre")) & (_differ() <= F.lit(_sketch_limit(most / 2)))).select("node", "centre").distinct()
    units = signed.select("node", "unit")
    pairs = asked.join(units, "node").join(units.select(F.col("node").alias("centre"), F.col("unit").alias("other")), "centre")
    angle = F.acos(F.least(F.col("cosine"), F.lit(1.0)))
    near = _cosines(pairs, "unit", "other").withColumn("angle", angle).filter(F.col("angle") <= most / 2 - ROUNDING)
    chosen = near.groupBy("node").agg(F.min(F.struct("centre", "angle")).alias("best"))
    out = signed.select("node").join(chosen, "node", "left").select("node", F.coalesce("best.centre", "node").alias("ball"), F.coalesce(F.greatest("best.angle", F.lit(ROUNDING)), F.lit(0.0)).alias("angle"))
    out = written(out, "vector-balls")
    removed(heads)
    return out


def _near_balls(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of balls, u < v, whose centres' sketches allow a link, within blocks.

    rows: block, side (0 or 1; in a block of one side alone its balls meet each other), ball, LONGS, limit (a ball's share
    of the signs that may differ).
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker()
        block, held = None, []

        def found() -> pd.DataFrame:
            out = [np.zeros((0, 2), np.int64)]
            if held:
                own = pd.concat(held)
                side, ball, limit = own["side"].to_numpy(), own["ball"].to_numpy(), own["limit"].to_numpy()
                s = own[LONGS].to_numpy().view(np.uint64)
                alone = not side.any() or side.all()
                rest = np.arange(len(s)) if alone else np.flatnonzero(side == 1)
                asking = np.arange(len(s)) if alone else np.flatnonzero(side == 0)
                for low in range(0, len(asking), 256):
                    a = asking[low : low + 256]
                    apart = np.zeros((len(a), len(rest)), np.uint16)
                    for j in range(len(LONGS)):
                        apart += np.bitwise_count(s[a, None, j] ^ s[None, rest, j])
                    i, j = np.nonzero(apart <= limit[a, None] + limit[None, rest])
                    u, v = ball[a[i]], ball[rest[j]]
                    out.append(np.stack([np.minimum(u, v), np.maximum(u, v)], 1)[(u < v) if alone else (u != v)])
            pairs = np.unique(np.concatenate(out), axis=0)
            return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

        for batch in batches:
            cuts = np.flatnonzero(np.diff(batch["block"].to_numpy())) + 1
            for part in np.split(np.arange(len(batch)), cuts):
                if not len(part):
                    continue
                own = batch.iloc[part]
                if own["block"].iloc[0] != block:
                    if len(held) and sum(map(len, held)) > 1:
                        yield found()
                    block, held = own["block"].iloc[0], []
                held.append(own)
        yield found()

    # Blocks whose names' hashes are equal lie beside each other and stay apart by the sort.
    return rows.repartition("block").sortWithinPartitions("block").mapInPandas(compare, "u long, v long")


def candidate_balls(signed: DataFrame, balls: DataFrame, centres: DataFrame, tables: int) -> DataFrame:
    """Distinct pairs (u, v) of balls that share a bucket of some table and whose sketches allow a link; centres: ball, LONGS, limit."""
    placed = written(signed.select("node", "keys").join(balls.select("node", "ball"), "node").select("ball", "keys"), "vector-keys")
    found, centres = None, bounded(centres)
    for low in range(0, tables, ROUND):
        rows = placed.select("ball", F.explode(F.slice("keys", low + 1, ROUND)).alias("key")).distinct()
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = written(sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("parts")), "vector-buckets")
        own = F.pmod(F.xxhash64("ball", F.lit(3)), F.col("parts"))
        dealt = rows.join(sizes, "key").withColumn("own", own).select("ball", "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.select("ball", block.alias("block"), (F.col("own") > F.col("other")).cast("int").alias("side"))
        pairs = _near_balls(dealt.join(centres, "ball").select("block", "side", "ball", *LONGS, "limit")).distinct()
        pairs = written(pairs, "vector-pairs")
        removed(sizes)
        found = pairs if found is None else found.union(pairs)
    out = written(found.distinct(), "vector-candidates")
    removed(placed)
    return out


def _members_linked(open_pairs: DataFrame, balls: DataFrame, units: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """u, v, node, other (weight of the other ball's members that node is linked with) for the members of pairs of balls.

    A pair's members meet in blocks, each a matrix product.
    """
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    n = open_pairs.join(sizes.select(F.col("ball").alias("u"), F.col("members").alias("n")), "u").join(sizes.select(F.col("ball").alias("v"), F.col("members").alias("m")), "v")
    dealt = n.select("u", "v", F.explode(F.sequence(F.lit(0).cast("long"), parts("n") - 1)).alias("i"), parts("m").alias("q"))
    dealt = dealt.select("u", "v", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("j"))
    dealt = dealt.withColumn("block", F.xxhash64("u", "v", "i", "j"))
    wanted = dealt.select("u", "v", "block", F.lit(0).alias("side"), F.col("u").alias("ball"), F.col("i").alias("place"))
    wanted = wanted.union(dealt.select("u", "v", "block", F.lit(1), "v", "j"))
    placed = balls.select("node", "ball").join(sizes, "ball").select("ball", "node", F.pmod(F.xxhash64("node", F.lit(5)), parts("members")).alias("place"))
    rows = wanted.join(placed, ["ball", "place"]).join(units, "node").select("u", "v", "block", "side", "node", "weight", "unit")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker()
        place, held = None, []

        def found() -> pd.DataFrame:
            out = pd.DataFrame({"u": [], "v": [], "node": [], "other": []}, dtype=np.int64)
            if held:
                own = pd.concat(held)
                a, b = own[own["side"] == 0], own[own["side"] == 1]
                if len(a) and len(b):
                    x, y = (np.stack([np.frombuffer(s) for s in side["unit"]]) for side in (a, b))
                    linked = (x @ y.T >= cosine).astype(np.int64)
                    n = np.concatenate([linked @ b["weight"].to_numpy(), a["weight"].to_numpy() @ linked])
                    nodes = np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()])
                    out = pd.DataFrame({"u": place[0], "v": place[1], "node": nodes[n > 0], "other": n[n > 0]})
            return out

        for batch in batches:
            for key, own in batch.groupby(["u", "v", "block"], sort=False):
                if key != place:
                    yield found()
                    place, held = key, []
                held.append(own)
        yield found()

    return rows.repartition("block").sortWithinPartitions("u", "v", "block").mapInPandas(meet, "u long, v long, node long, other long")


def duplicate_vectors(df: DataFrame, cosine: float = 0.9, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id, kept.

    Rows are linked when the cosine of their vectors, in double precision, is at least cosine (above 0, below 1). n_links counts the other
    rows linked directly, component_id is the smallest key reachable, kept tells whether that is the row's own. Other
    columns of df are ignored. Rows whose vector is null, empty, zero or holds a null or an entry that isn't finite are
    linked with nothing and kept, as are vectors of another length with one another. Rows of a null key take part and
    count for no component_id; a class of such rows alone has a null one and none of them is kept. Repeated rows are
    linked with each other. No rows give none. Each link has a chance of at most MISSED to go unseen, at the threshold.
    """
    most = math.acos(cosine)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    clean = rows.filter(_clean(F.col("vector")))
    grouped = clean.groupBy("vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    nodes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "vector", "weight", "first"), "vectors")
    bits, tables = table_counts(nodes.count(), cosine)
    signed = written(signatures(nodes, bits, tables), "vector-signs")
    balls = gathered(signed, most)

    sizes = balls.join(nodes.select("node", "weight"), "node").groupBy("ball").agg(F.count("*").alias("members"), F.sum("weight").alias("weight"), (F.max("angle") + F.when(F.count("*") > 1, ROUNDING).otherwise(0.0)).alias("radius"))
    sizes = written(sizes, "vector-ball-sizes")
    sketches = signed.select(F.col("node").alias("ball"), *LONGS, "unit").join(sizes, "ball")
    # At a right angle sketches spread most; a ball's radius adds to the angle at which its members may still be linked.
    wider = SPREAD * math.sqrt(SKETCH) / 2 - _sketch_limit(most) + SKETCH * most / math.pi
    share = F.lit(_sketch_limit(most) / 2) + F.when(F.col("radius") > 0, F.col("radius") * SKETCH / math.pi + wider / 2).otherwise(0.0)
    centres = written(sketches.withColumn("limit", share), "vector-centres")
    pairs = candidate_balls(signed, balls, centres.select("ball", *LONGS, "limit"), tables)

    side = lambda end, unit: centres.select(F.col("ball").alias(end), F.col("unit").alias(unit), F.col("radius").alias(f"radius_{end}"), F.col("weight").alias(f"weight_{end}"))
    met = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v")
    met = _cosines(met, "x", "y").withColumn("angle", F.acos(F.greatest(F.least(F.col("cosine"), F.lit(1.0)), F.lit(-1.0))))
    slack = F.col("radius_u") + F.col("radius_v")
    alone = slack == 0
    state = F.when(alone, (F.col("cosine") >= cosine).cast("int")).when(F.col("angle") + slack <= most - ROUNDING, 1).when(F.col("angle") - slack > most + ROUNDING, 0).otherwise(2)
    met = written(met.select("u", "v", "weight_u", "weight_v", state.alias("state")).filter("state > 0"), "vector-links")

    whole = met.filter("state = 1")
    per_ball = whole.select(F.col("u").alias("ball"), F.col("weight_v").alias("other")).union(whole.select("v", "weight_u")).groupBy("ball").agg(F.sum("other").alias("others"))
    units = signed.select("node", "unit").join(nodes.select("node", "weight"), "node")
    parted = written(_members_linked(met.filter("state = 2").select("u", "v"), balls, units, sizes, cosine), "vector-members")
    per_node = parted.groupBy("node").agg(F.sum("other").alias("single"))
    labels = components(whole.select("u", "v").union(parted.select("u", "v")))

    known = balls.select("node", "ball").join(nodes.select("node", "first"), "node").join(labels.select(F.col("node").alias("ball"), "label"), "ball", "left")
    known = written(known.select("node", "ball", "first", F.coalesce("label", "ball").alias("label")), "vector-classes")
    least = known.groupBy("label").agg(F.min("first").alias("component"))
    counted = known.join(sizes.select("ball", "weight"), "ball").join(per_ball, "ball", "left").join(per_node, "node", "left").join(least, "label")
    links = F.col("weight") - 1 + F.coalesce("others", F.lit(0)) + F.coalesce("single", F.lit(0))
    result = written(counted.select("node", links.alias("n_links"), "component").join(nodes.select("node", "vector"), "node").drop("node"), "vector-result")
    removed(signed, balls, centres, pairs, met, parted, known, sizes, nodes)

    lost = rows.filter(~_clean(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = clean.join(result, "vector")
    kept = F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), kept.alias("kept")).union(lost)
