"""Train, validation and test splits, k folds, balancing and synthetic minority bags.

Where a split names exact sizes, rows are ranked at random within their stratum; a table without strata is dealt by
hash thresholds, so that no window takes all rows into one task.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.operators.aggregates import oversample_ratio
from patchloom.operators.ranks import ranked
from patchloom.operators.rows import keep_first, random_rows, repeats, seeded, seeded_fraction
from patchloom.session import scratch_dir

EIGHTY, SIXTY = (0.1, 0.1), (0.2, 0.2)  # shares of test and validation
#: Tokens of a block that are compared as vectors instead of by lists of bags, bags of a block, and the most pivots of a search.
COMMON, BLOCK, PIVOTS = 1024, 6144, 2048
#: Vectors of a block where cells leave little out, in how many blocks such a search is cut at least, and what a meeting of a vector with a block costs, in products of two vectors.
FLAT, SPREAD, MEETING = 16384, 16, 1000
#: Rows that a Python task gives back at once.
GIVEN = 4096


def _by_fraction(fraction: Column, shares: tuple[float, float]) -> Column:
    test, val = shares
    return F.when(fraction < test, "test").when(fraction < test + val, "val").otherwise("train")


def split_random(df: DataFrame, seed: int, key: str = "id", shares: tuple[float, float] = EIGHTY) -> DataFrame:
    """df with split by the hash of key: train, val or test."""
    return df.withColumn("split", _by_fraction(seeded_fraction(seed, key), shares))


def split_stratified(df: DataFrame, column: str, seed: int, key: str = "id") -> DataFrame:
    """80/10/10 within each value of column, sizes rounded up for test and then validation."""
    placed = ranked(df, [column], seeded(seed, key), [key])
    test = F.ceil(F.col("n_") * 0.1)
    val = F.ceil((F.col("n_") - test) / 9.0)
    split = F.when(F.col("r_") <= test, "test").when(F.col("r_") <= test + val, "val").otherwise("train")
    return placed.withColumn("split", split).select(*df.columns, "split")


def split_by_pair(df: DataFrame, seed: int, undersample_safe: float | None = None, key: str = "id") -> DataFrame:
    """80/10/10 by pair_hash, so that pairs stay together; undersample_safe drops that share of the safe rows of train that come first for their hash."""
    rows = split_random(df, seed, "pair_hash")
    if not undersample_safe:
        return rows
    place = F.row_number().over(Window.partitionBy("split", "pair_hash").orderBy(key))
    rows = rows.withColumn("first_", (place == 1) & (F.col("label") == "safe") & (F.col("split") == "train"))
    drop = F.col("first_") & (seeded_fraction(seed + 1, key) < undersample_safe)
    return rows.filter(~F.coalesce(drop, F.lit(False))).drop("first_")


def k_fold_stratified(df: DataFrame, k: int, columns: list[str], seed: int, key: str = "id") -> DataFrame:
    """df with fold (0 to k - 1), even within each stratum of the columns, null as unk."""
    stratum = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("unk")) for c in columns])
    placed = ranked(df.withColumn("stratum_", stratum), ["stratum_"], seeded(seed, key), [key])
    return placed.withColumn("fold", ((F.col("r_") - 1) % k).cast("int")).select(*df.columns, "fold")


def split_unique(df: DataFrame, seed: int, text: str = "text", key: str = "id") -> DataFrame:
    """80/10/10 of the first row per label and text (or hash)."""
    return split_random(keep_first(df, ["label", text], [key]), seed, key)


def _counts(df: DataFrame) -> tuple[int, int]:
    """Numbers of unsafe and of all rows."""
    return tuple(df.agg(F.count_if(F.col("label") == "unsafe"), F.count("*")).first())


def _cut(df: DataFrame, label: str, most: int, seed: int, key: str) -> DataFrame:
    """At most so many random rows of a label, and all others."""
    return df.filter(F.col("label") != label).unionByName(random_rows(df.filter(F.col("label") == label), most, seed, key))


def split_one_to_one(df: DataFrame, seed: int, text: str = "text", key: str = "id") -> DataFrame:
    """Distinct rows, safe ones cut to the number of unsafe ones, 80/10/10."""
    first = keep_first(df, ["label", text], [key])
    return split_random(_cut(first, "safe", _counts(first)[0], seed, key), seed, key)


def _with_repeats(first: DataFrame, dup: DataFrame, text: str) -> DataFrame:
    """first with the repeated rows whose text is in neither test nor validation added to train."""
    held = first.filter(F.col("split") != "train").select(text).distinct()
    return first.unionByName(dup.join(held, text, "left_anti").withColumn("split", F.lit("train")).select(*first.columns))


def _oversampled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Unsafe rows of train as often as their ratio says; copy numbers the copies from 0."""
    ratio = oversample_ratio(df.filter(F.col("split") == "train")).select("ratio")
    train_unsafe = (F.col("split") == "train") & (F.col("label") == "unsafe")
    times = F.when(train_unsafe, F.col("ratio")).otherwise(1).cast("int")
    return df.join(F.broadcast(ratio)).withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1))).drop("ratio")


def split_disjoint(df: DataFrame, seed: int, text: str = "text", key: str = "id") -> DataFrame:
    """Distinct rows 60/20/20; repeated ones of train's texts back to train; unsafe ones of train repeated by their ratio."""
    order = [key]
    first = split_random(keep_first(df, ["label", text], order), seed, key, SIXTY)
    return _oversampled(_with_repeats(first, repeats(df, ["label", text], order), text), seed, key)


def split_oversample(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    return _oversampled(split_random(df, seed, key), seed, key)


def split_undersample(df: DataFrame, seed: int, text: str = "text", key: str = "id") -> DataFrame:
    """Distinct rows 80/10/10, repeated ones back to train, and train's safe rows cut to three times its unsafe ones."""
    first = split_random(keep_first(df, ["label", text], [key]), seed, key)
    whole = _with_repeats(first, repeats(df, ["label", text], [key]), text)
    train = whole.filter(F.col("split") == "train")
    return whole.filter(F.col("split") != "train").unionByName(_cut(train, "safe", 3 * _counts(train)[0], seed, key))


def bag_counts(bags: DataFrame, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """key, token, n of bags, and their norm."""
    counts = bags.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy(key).agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm")), key)


def bag_cosine(bags: DataFrame, k: int | None = None, key: str = "id", tokens: str = "tokens", queries: DataFrame | None = None) -> DataFrame:
    """Cosine of token counts between bags that share a token: a (of queries, by default all), b, similarity, place from 1.

    With k, the k most similar of each a, equal ones in order of b. Without, all pairs that share a token (and no place),
    which are many where a token is in very many bags; no table of tokens or pairs is shuffled for them.
    """
    rows = _written(_vectors(bags, key, tokens), "bags")
    return _nearest(rows, k, queries, key) if k is not None else _in_blocks(rows, _asked(rows, queries, key), None)


def common_tokens(counts: DataFrame, most: int) -> list[str]:
    """The most common tokens by bags, at most so many."""
    return [r.token for r in counts.groupBy("token").count().orderBy(F.desc("count"), "token").limit(most).collect()]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _vectors(bags: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, t (64-bit hashes of the distinct tokens), n (their counts), norm: one row for each bag that has tokens, null ones only in norm."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(np.asarray(h, np.int64), return_counts=True) for h in batch["h"]]
            squares = [float((n * n).sum() + blank * blank) for (_, n), blank in zip(found, batch["blank"], strict=True)]
            yield pd.DataFrame({"key": batch["key"], "t": [t for t, _ in found], "n": [n for _, n in found], "norm": np.sqrt(squares)})

    rows = bags.filter(F.col(key).isNotNull() & F.col(tokens).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array(tokens)).alias("w"))
    rows = rows.select("key", F.size("w").alias("all"), F.transform(F.filter("w", lambda w: w.isNotNull()), lambda w: F.xxhash64(w)).alias("h")).filter("all > 0")
    whole = rows.groupBy("key").agg(F.flatten(F.collect_list("h")).alias("h"), F.sum(F.col("all") - F.size("h")).alias("blank"))
    return whole.mapInPandas(count, f"key {bags.schema[key].dataType.simpleString()}, t array<long>, n array<long>, norm double")


def _asked(rows: DataFrame, queries: DataFrame | None, key: str) -> DataFrame:
    return rows if queries is None else rows.join(queries.select(F.col(key).alias("key")).distinct(), "key", "left_semi")


class _Block:
    """Bags of one block in order of their keys: the tokens of most of them as a matrix, the others as lists of the bags that hold them."""

    def __init__(self, keys: list, tokens: list[np.ndarray], counts: list[np.ndarray], norms: list[float], dense: int):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.keys = np.array([keys[i] for i in order], dtype=None if isinstance(keys[0], (int, float)) else object)
        self.place = {keys[i]: at for at, i in enumerate(order)}
        self.norms = np.array([norms[i] for i in order])
        of = np.repeat(np.arange(len(order)), [len(tokens[i]) for i in order])
        n = np.concatenate([counts[i] for i in order]).astype(np.float64)
        self.known, token, self.sizes = np.unique(np.concatenate([tokens[i] for i in order]), return_inverse=True, return_counts=True)
        by_token = np.argsort(token, kind="stable")
        self.of, self.n, self.starts = of[by_token], n[by_token], np.cumsum(self.sizes) - self.sizes
        common = np.argsort(-self.sizes, kind="stable")[:dense]
        common = common[self.sizes[common] > len(order) / 64]
        self.column = np.full(len(self.known), -1)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), len(order)))
        column = self.column[token]
        self.matrix[column[column >= 0], of[column >= 0]] = n[column >= 0]

    def dots(self, tokens: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """Exact dot products of bags with all of the block."""
        row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        t, n = np.concatenate(tokens), np.concatenate(counts).astype(np.float64)
        at = np.minimum(np.searchsorted(self.known, t), len(self.known) - 1) if len(self.known) else np.zeros(len(t), np.int64)
        found = self.known[at] == t if len(self.known) else np.zeros(len(t), bool)
        row, n, at = row[found], n[found], at[found]
        column = self.column[at]
        given = np.zeros((len(tokens), len(self.matrix)))
        given[row[column >= 0], column[column >= 0]] = n[column >= 0]
        out = given @ self.matrix
        row, n, at = row[column < 0], n[column < 0], at[column < 0]
        times = self.sizes[at]
        if times.sum():
            held = np.repeat(self.starts[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            cells = np.repeat(row, times) * len(self.norms) + self.of[held]
            out += np.bincount(cells, np.repeat(n, times) * self.n[held], out.size).reshape(out.shape)
        return out


def _best(similar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest entries above 0 of each row, equal ones by column."""
    rounded, k = np.round(similar, 12), min(k, similar.shape[1])
    edge = np.partition(rounded, rounded.shape[1] - k, axis=1)[:, rounded.shape[1] - k]
    row, column = np.nonzero((rounded >= edge[:, None]) & (similar > 0))
    order = np.lexsort((column, -rounded[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    return row[np.arange(len(row)) - first < k], column[np.arange(len(row)) - first < k]


def _in_blocks(rows: DataFrame, asked: DataFrame, k: int | None, dense: int = COMMON, block: int = BLOCK) -> DataFrame:
    """a, b, similarity: exact cosines of bags of asked with bags of rows that share a token: all, or at least the k largest of each a.

    rows and asked: as _vectors. Bags of both sides meet in pairs of blocks, each of about block bags: what is shuffled
    grows with the bags times the blocks of the other side, and a task holds one block at a time, whatever its tokens.
    """
    n, m = rows.count(), asked.count()
    parts, others = max(1, -(-n // block), min(16, n // 256)), max(1, -(-m // block))
    place = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    given = rows.withColumn("i", place(parts, 1)).withColumn("j", every(others)).withColumn("asks", F.lit(False))
    put = asked.withColumn("j", place(others, 2)).withColumn("i", every(parts)).withColumn("asks", F.lit(True))
    met = given.unionByName(put).withColumn("pair", F.col("i") * others + F.col("j")).select("pair", "asks", "key", "t", "n", "norm")

    def answers(own: _Block, asking: list[tuple]) -> pd.DataFrame:
        keys, tokens, counts, norms = zip(*asking, strict=True)
        similar = own.dots(tokens, counts) / np.array(norms)[:, None] / own.norms[None, :]
        for row, name in enumerate(keys):
            if name in own.place:
                similar[row, own.place[name]] = 0
        row, column = np.nonzero(similar) if k is None else _best(similar, k)
        names = np.array(keys, dtype=own.keys.dtype)
        return pd.DataFrame({"a": names[row], "b": own.keys[column], "similarity": similar[row, column]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, members, own, asking = None, [], None, []
        for batch in batches:
            for p, asks, *bag in batch.itertuples(index=False, name=None):
                if p != pair:
                    if own is not None and asking:
                        yield answers(own, asking)
                    pair, members, own, asking = p, [], None, []
                if not asks:
                    members.append(bag)
                elif members or own is not None:
                    if own is None:
                        own, members = _Block(*zip(*members, strict=True), dense), []
                    asking.append(bag)
                    if len(asking) == 128:
                        yield answers(own, asking)
                        asking = []
        if own is not None and asking:
            yield answers(own, asking)

    kind = rows.schema["key"].dataType.simpleString()
    return met.repartition(parts * others, "pair").sortWithinPartitions("pair", "asks").mapInPandas(meet, f"a {kind}, b {kind}, similarity double")


def _nearest(rows: DataFrame, k: int, queries: DataFrame | None, key: str, dense: int = COMMON, block: int = BLOCK) -> DataFrame:
    found = _in_blocks(rows, _asked(rows, queries, key), k, dense, block)
    order = Window.partitionBy("a").orderBy(F.desc(F.round("similarity", 12)), "b")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def nearest_bags(counts: DataFrame, k: int, key: str = "id", queries: DataFrame | None = None, common: int = COMMON, block: int = BLOCK) -> DataFrame:
    """a, b, similarity, place: the k bags most similar to each bag of queries (by default all) that share a token with it, exactly.

    counts: key, token, n, norm. Bags meet in blocks of about block bags, in which the common most frequent tokens are
    compared by matrix products and all others by the lists of bags that hold them. All pairs are compared, so the time
    grows with the queries times the bags; the memory of a task does not.
    """
    held = F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct(F.xxhash64("token").alias("t"), F.col("n").cast("long").alias("n")))))
    rows = counts.groupBy(F.col(key).alias("key")).agg(held.alias("c"), F.first("norm").alias("norm")).select("key", "c.t", "c.n", "norm")
    return _nearest(_written(rows, "bags"), k, queries, key, common, block)


def _mixtures(pairs: DataFrame, seed: int, whole: bool, name: str) -> DataFrame:
    """Of each row's tries (ts): a, b, t and the digest of the new bag, or, if whole, the bag itself under name; empty bags are left out.

    pairs: a, b, label_ (a as text), ts, x and y (tokens of a and b). A token's count is the mean of both, and a half is
    rounded up or down by its hash: U(-0.2, 0.2) can turn nothing else.
    """

    def mix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, label, ts, x, y in batch[["a", "b", "label_", "ts", "x", "y"]].itertuples(index=False, name=None):
                counts = Counter(w for w in x if w is not None)
                counts.update(w for w in y if w is not None)
                sums = [(w, w.encode("utf-8", "surrogatepass"), n // 2, n % 2) for w, n in sorted(counts.items())]
                for t in ts:
                    head = hashlib.md5(f"{seed + 1}:{label}:{t}:".encode())
                    times = []
                    for _, raw, n, half in sums:
                        if half:
                            own = head.copy()
                            own.update(raw)
                            n += own.digest()[0] >= 128
                        times.append(n)
                    if not any(times):
                        continue
                    if whole:
                        out.append((a, b, t, [w for (w, *_), n in zip(sums, times, strict=True) for _ in range(n)]))
                    else:
                        out.append((a, b, t, hashlib.md5(b"".join((raw + b"\0") * n for (_, raw, *_), n in zip(sums, times, strict=True))).hexdigest()))
                    if len(out) >= 2000:
                        yield pd.DataFrame(out, columns=["a", "b", "t", name])
                        out = []
            yield pd.DataFrame(out, columns=["a", "b", "t", name])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInPandas(mix, f"a {kind}, b {kind}, t int, {name} {'array<string>' if whole else 'string'}")


def smote_bags(bags: DataFrame, seed: int, k: int = 5, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """Balanced bags: safe ones cut to half of all, unsafe ones grown to half by new bags between neighbours.

    A new bag has round(mean of two counts + U(-0.2, 0.2)) of each token of an unsafe bag and one of its k neighbours of
    similarity above 0. Up to ten tries for each bag wanted are made, and bags that exist are dropped. Columns: key
    (null for new bags), label, tokens (sorted). Tries are told apart by digests of their bags, and only the bags that are
    taken are made whole. Null tokens enter no new bag.
    """
    rows = bags.withColumn(tokens, F.array_sort(tokens))
    ones, every = _counts(rows)
    wanted = max(0, every // 2 - ones)
    safe = random_rows(rows.filter(F.col("label") == "safe"), every // 2, seed, key).select(key, "label", tokens)
    unsafe = _written(rows.filter(F.col("label") == "unsafe").select(key, "label", tokens), "unsafe")
    near = bag_cosine(unsafe, k, key, tokens).filter("similarity > 0").groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("near"))
    rounds = max(1, -(-10 * wanted // max(1, ones)))
    tries = near.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    pick = F.floor(seeded_fraction(seed, "a", "t") * F.size("near")).cast("int")
    chosen = tries.select("a", "t", F.get("near", pick).alias("b"))
    own = unsafe.groupBy(key).agg(F.flatten(F.collect_list(tokens)).alias("own_"))

    def made(picked: DataFrame, whole: bool, name: str) -> DataFrame:
        ts = picked.groupBy("a", "b").agg(F.collect_list("t").alias("ts")).withColumn("label_", F.col("a").cast("string"))
        pairs = ts.join(own.withColumnsRenamed({key: "a", "own_": "x"}), "a").join(own.withColumnsRenamed({key: "b", "own_": "y"}), "b")
        # The bags are small and the tries many, so the number of tasks goes by the tries.
        return _mixtures(pairs.repartition(max(1, (wanted if whole else ones * rounds) // 1000), "a", "b"), seed, whole, name)

    known = unsafe.filter(F.col(tokens).isNotNull()).select(F.md5(F.array_join(F.transform(tokens, lambda w: F.concat(w, F.lit("\0"))), "")).alias("digest_")).distinct()
    new = _written(made(chosen, False, "digest_").join(known, "digest_", "left_anti"), "tries")
    new = random_rows(_written(keep_first(new, ["digest_"], ["t", "a"]), "new"), wanted, seed + 2, "t", "a")
    new = made(new, True, tokens)
    return safe.unionByName(unsafe).unionByName(new.select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit("unsafe").alias("label"), tokens))


def split_disjoint_smote(df: DataFrame, seed: int, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """Distinct bags 60/20/20, then train balanced by smote_bags; columns key, label, tokens, split."""
    rows = df.withColumn("text_", F.md5(F.array_join(F.array_sort(tokens), " ")))
    first = _written(split_random(keep_first(rows, ["label", "text_"], [key]), seed, key, SIXTY).select(key, "label", tokens, "split"), "distinct")
    train = smote_bags(first.filter(F.col("split") == "train"), seed, key=key, tokens=tokens).withColumn("split", F.lit("train"))
    return first.filter(F.col("split") != "train").unionByName(train.select(key, "label", tokens, "split"))


def _distances(x: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    """Distances (for p = 2 by a matrix product, so not exact to the last digits) of the rows of x and y."""
    if p == 1:
        return np.stack([np.abs(y - v).sum(1) for v in x]) if len(x) else np.zeros((0, len(y)))
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0))


def _cells(rows: DataFrame, pivots: np.ndarray, p: int) -> DataFrame:
    """id, x, cell, d: the nearest pivot and how far it is."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1024):
                own = batch.iloc[low : low + 1024]
                d = _distances(np.stack(own["x"].to_numpy()).astype(np.float64), pivots, p)
                cell = d.argmin(1)
                yield pd.DataFrame({"id": own["id"], "x": own["x"], "cell": cell, "d": d[np.arange(len(d)), cell]})

    return rows.mapInPandas(deal, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>, cell long, d double")


def _flat_is_less(pivots: np.ndarray, within: np.ndarray, radius: np.ndarray, sizes: np.ndarray, parts: np.ndarray, blocks: int, p: int) -> bool:
    """Whether vectors meet all others in so many plain blocks with less work than in the cells that are left, judged by the pivots.

    The result is the same either way.
    """
    met = members = 0
    for low in range(0, len(pivots), 256):
        d = _distances(pivots[low : low + 256], pivots, p)
        other = d.copy()
        other[np.arange(len(d)), low + np.arange(len(d))] = np.maximum(radius[low : low + 256], 0)  # a pivot is nearer to itself than other vectors are to theirs
        left = d - radius <= (other + within).min(1)[:, None]
        met, members = met + (left * parts).sum(), members + (left * sizes).sum()
    return met * MEETING + members > len(pivots) * (blocks * MEETING + sizes.sum())


def nearest(vectors: DataFrame, k: int, key: str = "id", vector: str = "vector", queries: DataFrame | None = None, p: int = 2, block: int = 2000) -> DataFrame:
    """a, b, d, place: the k nearest other vectors of each of queries (by default all), equal ones in order of b; d is squared for p = 2.

    Vectors are dealt to the nearest of about sqrt(n) pivots. From the distances to all pivots, the cells' radii and the k
    smallest distances in each of them, the triangle inequality gives a vector a bound on its k-th distance, and with it the cells that may
    hold something nearer; it is sent to these alone. Where that leaves little out, as with vectors without structure, vectors
    meet all others in a few large blocks instead. Cells are cut into blocks of about block vectors, so a cell that
    holds most of them is many tasks. Products of whole matrices find what is near, and exact sums order it. So the result is
    exact; a vector is sent to no more than the pivots' number of cells, and where there is structure to far fewer.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")).filter("x IS NOT NULL")
    n = rows.count()
    if not n:
        kind = vectors.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"a {kind}, b {kind}, d double, place int")
    chosen = random_rows(rows, min(PIVOTS, math.ceil(math.sqrt(n))), 0, "id").collect()
    pivots = np.array(sorted({tuple(r.x) for r in chosen}), np.float64)
    path = scratch_dir(spark, "cells")
    _cells(rows, pivots, p).write.parquet(path)
    dealt = spark.read.parquet(path)

    # Of each cell its size, its radius and its members nearest to the pivot: one row for each pivot.
    sizes = {r.cell: (r.n, r.radius) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()}
    self_join = queries is None
    inner = Window.partitionBy("cell").orderBy("d")
    nth = dealt.withColumn("r_", F.row_number().over(inner)).filter(F.col("r_") <= k + self_join).groupBy("cell").agg(F.max("d").alias("d"), F.count("*").alias("n"))
    nth = {r.cell: r.d for r in nth.collect() if r.n == k + self_join}
    radius = np.array([sizes.get(c, (0, -np.inf))[1] for c in range(len(pivots))])
    within = np.array([nth.get(c, np.inf) for c in range(len(pivots))])
    parts = np.array([-(-sizes.get(c, (0, 0))[0] // block) for c in range(len(pivots))])
    blocks = max(-(-n // FLAT), min(SPREAD, -(-n // 512)))
    counted = np.array([sizes.get(c, (0, 0))[0] for c in range(len(pivots))])
    if _flat_is_less(pivots, within, radius, counted, parts, blocks, p):
        pivots, radius, within, parts, block = pivots[:1], np.array([np.inf]), np.array([np.inf]), np.array([blocks]), FLAT // 2
        dealt = dealt.withColumn("cell", F.lit(0).cast("long"))
    asked = dealt.select("id", "x") if self_join else queries.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")).filter("x IS NOT NULL")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                own = batch.iloc[low : low + 256]
                d = _distances(np.stack(own["x"].to_numpy()).astype(np.float64), pivots, p)
                bound = (d + within).min(1)
                room = 1e-6 * (1 + np.where(np.isfinite(bound), bound, 0) + d.max(1))
                row, cell = np.nonzero((d - radius <= (bound + room)[:, None]) & (parts > 0))
                times = parts[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                piece = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, np.int64)
                for at in range(0, len(row), GIVEN):
                    some = row[at : at + GIVEN]
                    yield pd.DataFrame({"id": own["id"].to_numpy()[some], "x": own["x"].to_numpy()[some], "cell": cell[at : at + GIVEN], "piece": piece[at : at + GIVEN]})

    kind = vectors.schema[key].dataType.simpleString()
    routed = asked.mapInPandas(route, f"id {kind}, x array<double>, cell long, piece long")
    way = scratch_dir(spark, "routed")
    routed.write.parquet(way)
    routed = spark.read.parquet(way)
    # A cell asked by very many is copied, so that a task has one block of each side.
    asks = np.ones(len(pivots), np.int64)
    for r in routed.filter("piece = 0").groupBy("cell").count().collect():
        asks[r.cell] = -(-r["count"] // (4 * block))
    copies = F.element_at(F.array(*[F.lit(int(c)) for c in asks]), F.col("cell").cast("int") + 1).cast("long")
    shares = F.element_at(F.array(*[F.lit(int(max(1, c))) for c in parts]), F.col("cell").cast("int") + 1).cast("long")
    own = F.pmod(F.xxhash64("id"), shares)
    members = dealt.select("id", "x", "cell", own.alias("piece"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("turn"), F.lit(False).alias("asks"))
    askers = routed.select("id", "x", "cell", "piece", F.pmod(F.xxhash64("id", F.lit(1)), copies).alias("turn"), F.lit(True).alias("asks"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        b, asking, out = group[~group["asks"]], group[group["asks"]], []
        if len(b) and len(asking):
            y, names = np.stack(b["x"].to_numpy()), b["id"].to_numpy()
            for low in range(0, len(asking), 256):
                part = asking.iloc[low : low + 256]
                x = np.stack(part["x"].to_numpy())
                d = _distances(x, y, p)
                if self_join:
                    d[part["id"].to_numpy()[:, None] == names[None, :]] = np.inf
                edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                for row, name in enumerate(part["id"]):
                    near = np.flatnonzero((d[row] <= edge[row] + 1e-6 * (1 + (edge[row] if np.isfinite(edge[row]) else 0))) & np.isfinite(d[row]))
                    apart = y[near] - x[row]
                    exact = (apart * apart).sum(1) if p == 2 else np.abs(apart).sum(1)
                    out += [(name, names[near[i]], float(exact[i])) for i in np.argsort(exact, kind="stable")[:k]]
        return pd.DataFrame(out, columns=["a", "b", "d"])

    found = members.unionByName(askers).groupBy("cell", "piece", "turn").applyInPandas(meet, f"a {kind}, b {kind}, d double")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter(F.col("place") <= k)


def smote_vectors(df: DataFrame, seed: int, k: int = 5, key: str = "id", vector: str = "vector") -> DataFrame:
    """Balanced numeric vectors: safe ones cut to half of all, unsafe ones grown to half between neighbours.

    Neighbours are the k nearest unsafe vectors by Euclidean distance; a pair gives as many interpolations as are wanted.
    """
    rows = df.select(key, "label", vector)
    ones, every = _counts(rows)
    safe = random_rows(rows.filter(F.col("label") == "safe"), every // 2, seed, key)
    unsafe = rows.filter(F.col("label") == "unsafe")
    wanted = max(0, every // 2 - ones)
    near = nearest(unsafe, k, key, vector).select("a", "b")
    times = -(-wanted // max(1, ones * min(k, max(1, ones - 1))))
    tries = near.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(max(1, times)))))
    share = seeded_fraction(seed + 1, "a", "b", "t")
    x, y = unsafe.select(F.col(key).alias("a"), F.col(vector).alias("x")), unsafe.select(F.col(key).alias("b"), F.col(vector).alias("y"))
    chosen = random_rows(tries, wanted, seed, "a", "b", "t").withColumn("share", share).join(x, "a").join(y, "b")
    new = chosen.withColumn("z", F.zip_with("x", "y", lambda p, q: (p + (q - p) * F.col("share")).cast("float")))
    return safe.unionByName(unsafe).unionByName(new.select(F.lit(None).cast(df.schema[key].dataType).alias(key), F.lit("unsafe").alias("label"), F.col("z").alias(vector)))
