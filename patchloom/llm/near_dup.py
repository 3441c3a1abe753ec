"""Near-duplicate classes by MinHash with tensored banding, every link confirmed on full shingle sets.

Two small collections of sub-keys, each of a few minhashes, are computed for a set; a table key is a pair of sub-keys,
one of each collection. So m sub-keys a side give m * m tables for 2 * m * k minhashes. With m = 11 and k = 3, two sets
of similarity 0.8 share no table with probability 8e-4, of 0.85 with 6e-5, and sets of similarity 0.2 share one with
probability below 1e-2.

Nodes are distinct shingle sets, so exact copies never multiply. In each table bucket all members are paired with one
leader, and these pairs are confirmed on the full sets (stars). Members too far from their leader for their partners to
be sure to resemble it choose a new leader among themselves, and those still left after STAR_ROUNDS are compared with one
another. Confirmed links join nodes to components. Members that resemble a leader but are linked to none stay in doubt:
within each cluster of resemblance, all members outside its largest component are compared with all members, in blocks of
bounded size. So the work within a group of copies grows with its size and with its strays, and no link between different
sets that share a bucket is lost to the leaders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import free_name, lean_worker, own_columns, removed, written

SUB_KEYS, HASHES = 11, 3
BLOCK = 1000
#: Tables of up to so many rows of a few longs (some 64 MB) are broadcast.
BROADCAST_ROWS = 1_000_000
KEYS_A_TASK = 1_000_000
#: Pairs of at least this similarity share a cluster in which strays are compared with all members.
RESEMBLANCE = 0.5
#: Leaders that a bucket's members choose one after another before those left are compared with one another.
STAR_ROUNDS = 3
_LOWER = bytes(range(256)).lower()
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P1
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of text's shingles of size words, A-Z in lower case; a shorter text is one shingle."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = _mixed(out * _P1 + h[j : len(h) - n + 1 + j])
    return np.unique(_mixed(out + np.uint64(n)))


def _parameters(sub_keys: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = 2 * sub_keys * hashes
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def sub_keys(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray, hashes: int) -> np.ndarray:
    """Hash of each group of hashes minhashes of a set that isn't empty."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), 2048):
        part = (shingles[low : low + 2048, None] ^ shifts) * factors
        np.minimum(least, part.min(0), out=least)
    groups = least.reshape(-1, hashes)
    out = groups[:, 0].copy()
    for j in range(1, hashes):
        out = _mixed(out * _P1 + groups[:, j])
    return _mixed(out).view(np.int64)


def node_of(shingles: np.ndarray) -> int:
    """64-bit digest of a set."""
    if not len(shingles):
        return 0
    two = np.array([shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(_mixed(shingles))], np.uint64)
    return int(_mixed(two[:1] * _P1 + two[1:] + np.uint64(len(shingles))).view(np.int64)[0])


def row_of() -> Column:
    """Hash of a row's doc_id and text: rows that repeat a doc_id with another text are told apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def signatures(docs: DataFrame, size: int, m: int, k: int) -> DataFrame:
    """row (as row_of), doc_id, n, node, a, b (the collections' sub-keys)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker()
        factors, shifts = _parameters(m, k)
        for batch in batches:
            n, node, a, b = [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text, size)
                keys = sub_keys(s, factors, shifts, k) if len(s) else np.zeros(0, np.int64)
                n.append(len(s))
                node.append(node_of(s))
                a.append(keys[:m])
                b.append(keys[m:])
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"].astype("Int64"), "n": n, "node": node, "a": a, "b": b})

    rows = docs.select(row_of().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(sign, "row long, doc_id long, n long, node long, a array<long>, b array<long>")


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table of a few longs a row, marked for broadcast when its counted rows are at most limit."""
    return F.broadcast(df) if df.count() <= limit else df


def _keys(nodes: DataFrame, *others: str) -> DataFrame:
    """node, other columns and each of its table keys."""
    pair_keys = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(x, y, i * 1000 + j))))
    return nodes.select("node", *others, F.explode(pair_keys).alias("key"))


def star_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (u: leader, v) of nodes that share a table key, and key, u of the buckets of three nodes or more.

    The leader is the bucket's smallest node. Nodes are dealt so that a task makes about KEYS_A_TASK keys, whose counts it can hold without spilling.
    """
    tasks = -(-nodes.count() * SUB_KEYS * SUB_KEYS // KEYS_A_TASK)
    nodes = nodes.repartition(max(1, tasks), "node")
    keys = _keys(nodes)
    buckets = written(keys.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("top"), F.count("*").alias("size")).filter("size > 1"), "buckets")
    two = buckets.filter("size = 2").select("u", F.col("top").alias("v"))
    more = written(buckets.filter("size > 2").select("key", "u"), "buckets-large")
    rest = keys.join(bounded(more), "key").select("u", F.col("node").alias("v")).filter("u <> v")
    return two.union(rest).distinct(), more


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) for every node of edges (u, v), by label passing and jumping.

    A round passes on the labels that the round before has changed, so settled parts make no rows.
    """
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), "edges")
    first = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label"))
    # A node that is the smallest of its neighbourhood has passed on its label, itself, in this first step.
    labels = written(first.withColumn("changed", F.col("label") != F.col("node")), "labels")
    while True:
        near = both.join(labels.filter("changed").select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        after = step.join(jump, "new").select("node", F.least("new", "further").alias("label"), (F.least("new", "further") != F.col("label")).alias("changed"))
        after, old = written(after, "labels"), labels
        removed(old)
        labels = after
        if not labels.filter("changed").limit(1).count():
            removed(both)
            return labels.select("node", "label")


def compared(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v, j) of similarity at least threshold between queries (role 0) and members (role 1) of each block.

    rows: block (any long), role, node, comp, shingles (little-endian 64-bit, sorted). Pairs of equal comp are left out.
    A task holds one block at a time.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker()
        block, queries, members = None, [], []

        def found() -> pd.DataFrame:
            out = []
            if queries and members:
                ids, at = np.unique(np.concatenate([s for *_, s in members]), return_inverse=True)
                sizes = np.array([len(s) for *_, s in members])
                starts = np.cumsum(sizes) - sizes
                nodes, comps = np.array([m[0] for m in members]), np.array([m[1] for m in members])
                for node, comp, s in queries:
                    marked = np.zeros(len(ids), np.int64)
                    place = np.searchsorted(ids, s)
                    place = place[place < len(ids)]
                    place = place[ids[place] == s[: len(place)]] if len(place) == len(s) else np.searchsorted(ids, np.intersect1d(ids, s, assume_unique=True))
                    marked[place] = 1
                    shared = np.add.reduceat(marked[at], starts)
                    union = len(s) + sizes - shared
                    for i in np.flatnonzero((shared >= threshold * union - 1e-9) & (comps != comp)):
                        out.append((node, nodes[i], int(shared[i]), int(union[i])))
            return pd.DataFrame(out, columns=["u", "v", "shared", "joint"])

        for batch in batches:
            for b, role, node, comp, s in zip(batch["block"], batch["role"], batch["node"], batch["comp"], batch["shingles"], strict=True):
                if b != block:
                    yield found()
                    block, queries, members = b, [], []
                (members if role else queries).append((node, comp, np.frombuffer(s, "<u8")))
        yield found()

    # Equal hashes of two blocks' names would compare more than asked for, and lose nothing.
    dealt = rows.select("block", "role", "node", "comp", "shingles").repartition("block").sortWithinPartitions("block", "role", "node")
    return dealt.mapInPandas(compare, "u long, v long, shared long, joint long")


def _stars(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (u: leader, v) that resemble, compared on the full sets."""
    large = written(pairs.groupBy("u").count().filter(F.col("count") > BLOCK).select("u", F.ceil(F.col("count") / BLOCK).cast("long").alias("parts")), "large-stars")
    parts = F.coalesce("parts", F.lit(1))
    stars = pairs.join(bounded(large), "u", "left").select("u", "v", F.xxhash64("u", F.pmod(F.xxhash64("v"), parts), F.lit(1)).alias("block"))
    stars = stars.select("block", F.lit(1).alias("role"), F.col("v").alias("node")).union(stars.select("block", F.lit(0), "u").distinct())
    return written(compared(stars.withColumn("comp", F.col("role").cast("long")).join(full, "node"), RESEMBLANCE), "stars")


def _far(pairs: DataFrame, star_links: DataFrame, percent: int) -> DataFrame:
    """u, node, fallen of distinct pairs (u: leader, node) whose node may link to one that doesn't resemble the leader.

    Distances 1 - J are a metric: a partner at the similarity asked for is nearer than RESEMBLANCE to the leader when
    the member is nearer than settled. Fallen ones don't resemble the leader themselves.
    """
    settled = RESEMBLANCE + 1 - percent / 100
    links = star_links.select("u", F.col("v").alias("node"), (F.col("shared") >= F.lit(settled) * F.col("joint")).alias("near"))
    left = pairs.join(links.filter("near").select("u", "node"), ["u", "node"], "left_anti")
    beside = links.filter("NOT near").select("u", "node", F.lit(False).alias("fallen"))
    return written(left.join(beside, ["u", "node"], "left").select("u", "node", F.coalesce("fallen", F.lit(True)).alias("fallen")), "far")


def _unsettled(members: DataFrame, far: DataFrame) -> DataFrame:
    """key, node, n (of key) of members (key, u: leader, node) that are far from their leader, if a key has two or more.

    Only far members are joined, so the many that are near a leader make no rows. Keys all of whose far members resemble
    the leader are done, as these share a cluster, and keys of an equal group give it once.
    """
    left = written(members.join(far, ["u", "node"]).select("key", "node", "fallen"), "unsettled")
    mixed = F.xxhash64("node", F.lit(7))
    groups = left.groupBy("key").agg(F.count("*").alias("n"), F.max("fallen").alias("fallen"), F.bit_xor(mixed).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(8))).alias("y"))
    once = groups.filter("n > 1 and fallen").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    return written(left.select("key", "node").join(once, "key"), "unsettled-groups")


def rest_links(nodes: DataFrame, pairs: DataFrame, large: DataFrame, star_links: DataFrame, full: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Further star_links of members that chose new leaders, and compared pairs of those left at last that meet the similarity."""
    far = _far(pairs.select("u", F.col("v").alias("node")), star_links, percent)
    # Keys are made again for the few nodes that are far from a leader, instead of being kept for all.
    # A key is met only under a leader that its node is far from, of which a node has at most one a table.
    known = written(far.groupBy("node").agg(F.collect_list("u").alias("leaders")).join(nodes.select("node", "a", "b"), "node"), "far-nodes")
    led = bounded(written(large.join(far.select("u").distinct(), "u", "left_semi").select(F.col("key").alias("met"), "u"), "far-keys"))
    left = _unsettled(_keys(known, "leaders").join(led, (F.col("key") == F.col("met")) & F.array_contains("leaders", F.col("u"))).select("key", "u", "node"), far)
    found = star_links
    for _ in range(STAR_ROUNDS - 1):
        if not left.limit(1).count():
            break
        members = written(left.join(left.groupBy("key").agg(F.min("node").alias("u")), "key").filter("u <> node").select("key", "u", "node"), "members")
        distinct = written(members.select("u", "node").distinct(), "member-pairs")
        more = _stars(distinct.select("u", F.col("node").alias("v")), full)
        found = found.union(more)
        left = _unsettled(members, _far(distinct, more, percent))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    own = lambda seed: F.pmod(F.xxhash64("node", F.lit(seed)), blocks)
    dealt = lambda role, name: left.select(F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), name)).alias("block"), F.lit(role).alias("role"), "node", F.col("node").alias("comp"))
    members, queries = dealt(1, lambda q: F.xxhash64("key", own(2), q)), dealt(0, lambda b: F.xxhash64("key", b, own(3)))
    enough = F.col("shared") * 100 >= F.col("joint") * percent
    return found, written(compared(members.union(queries).join(full, "node"), percent / 100).filter(enough).select("u", "v"), "links")


def confirmed_links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, large: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) between nodes whose sets meet the similarity, found from star_pairs as the module describes."""
    wanted = written(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.select("node", "row"), "node"), "candidates")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker()
        out, held = [], 0
        for batch in batches:
            for text, node in zip(batch["text"], batch["node"], strict=True):
                own = shingle_set(text, size)
                if node_of(own) != node:
                    continue
                out.append((node, own.astype("<u8").tobytes()))
                held += len(own)
                if held > 500_000:
                    yield pd.DataFrame(out, columns=["node", "shingles"])
                    out, held = [], 0
        yield pd.DataFrame(out, columns=["node", "shingles"])

    # Sets are made where the scan runs; rows that repeat make a set again, of which one is kept.
    texts = docs.select(row_of().alias("row"), "text").join(bounded(wanted), "row")
    full = written(texts.select("node", "text").mapInPandas(sets, "node long, shingles binary").dropDuplicates(["node"]), "sets")

    star_links, rest = rest_links(nodes, pairs, large, _stars(pairs, full), full, percent)
    enough = F.col("shared") * 100 >= F.col("joint") * percent
    links = star_links.filter(enough).select("u", "v").union(rest)

    comps = components(links)
    clusters = components(star_links)
    placed = written(clusters.select("node", F.col("label").alias("cluster")).join(comps, "node", "left").select("node", "cluster", F.coalesce("label", "node").alias("comp")), "clusters")
    counts = placed.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    largest = counts.groupBy("cluster").agg(F.sum("n").alias("all"), F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.max("n").alias("most"), F.count("*").alias("parts"))
    doubt = written(placed.join(largest.filter("parts > 1 and `all` > 2"), "cluster"), "doubt")
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    member_blocks, query_blocks = blocks(F.col("all")), blocks(F.col("all") - F.col("most"))
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    name = lambda mb, qb: F.xxhash64("cluster", mb, qb)
    members = doubt.select(F.explode(F.transform(F.sequence(F.lit(0), query_blocks - 1), lambda q: name(own(member_blocks, 2), q))).alias("block"), F.lit(1).alias("role"), "node", "comp")
    strays = doubt.filter("comp <> largest")
    queries = strays.select(F.explode(F.transform(F.sequence(F.lit(0), member_blocks - 1), lambda b: name(b, own(query_blocks, 3)))).alias("block"), F.lit(0).alias("role"), "node", "comp")
    more = written(compared(members.union(queries).join(full, "node"), percent / 100).filter(enough).select("u", "v"), "links")
    return links.union(more)


def _labelled(docs: DataFrame, size: int, percent: int, m: int = SUB_KEYS, k: int = HASHES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows of docs, their distinct nodes that have words, and the component's label of each linked node."""
    signed = written(signatures(docs, size, m, k), "signatures")
    filled = signed.filter("n > 0")
    nodes = written(filled.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc"), F.first("a").alias("a"), F.first("b").alias("b")), "nodes")
    pairs, large = star_pairs(nodes)
    return signed, nodes, components(confirmed_links(docs, nodes, written(pairs, "pairs"), large, size, percent))


def duplicate_classes(docs: DataFrame, shingle_words: int = 5, percent: int = 80, m: int = SUB_KEYS, k: int = HASHES) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id reachable. docs needs doc_id and text; other columns are ignored. Null texts and texts without words have
    n_shingles 0, are linked with nothing and are kept. Rows of a null doc_id take part and count for no component_id;
    a class of such rows alone has a null one, and none of them is kept unless it has no words. Repeated rows get equal
    results. No rows give none.
    """
    signed, nodes, labels = _labelled(docs, shingle_words, percent, m, k)
    grouped = labels.join(nodes.select("node", "doc"), "node")
    least = grouped.groupBy("label").agg(F.min("doc").alias("component"))
    linked = labels.join(least, "label").select("node", "component")
    known = nodes.select("node", "doc").join(linked, "node", "left").select("node", F.coalesce("component", "doc").alias("component"))
    found = signed.select("doc_id", "n", "node").join(known, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    kept = F.when(F.col("n") == 0, True).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each class, all columns kept: that of the smallest doc_id, a null one last, and then of the smallest hash.

    Rows are told apart by doc_id and text, so rows of other texts that repeat a doc_id, or have none, stay by their own
    class. Rows without words stay.
    """
    signed, _, labels = _labelled(docs, shingle_words, percent)
    own = signed.filter("n > 0").join(labels, "node", "left")
    placed = written(own.select("row", "doc_id", F.coalesce("label", "node").alias("class")), "classes")
    first = placed.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    gone = written(placed.join(first, "class").filter("row <> first.row").select("row").distinct(), "gone")
    name = free_name(docs, "row_")
    keep = docs.withColumn(name, row_of()).join(bounded(gone.withColumnRenamed("row", name)), name, "left_anti")
    again = written(placed.groupBy("row").count().filter("count > 1").select("row").join(gone, "row", "left_anti"), "repeats")
    if again.limit(1).count():
        again = bounded(again.withColumnRenamed("row", name))
        keep = keep.join(again, name, "left_anti").unionByName(keep.join(again, name, "left_semi").dropDuplicates([name]))
    return keep.select(*own_columns(docs))
