"""Phrase collocations from count streams in prefix and in suffix order.

Counts are taken level by level: words, then pairs of frequent words, then longer phrases all of whose pairs are frequent,
as no phrase is more frequent than a part of it. A task counts blocks of text by sorting, and the blocks' counts are added
up by phrase. What tells frequent words and pairs is a bit table of bounded size; the few phrases that it lets through
wrongly, or many once it is full, cost time and change no count.

The frequent phrases then form one stream, dealt out by ranges and sorted. In prefix order a phrase follows all its
beginnings, so one lockstep pass with a stack of at most five open phrases gives every phrase the counts of its beginnings,
and every beginning the count of its most frequent extension by a word at the right. The same pass over the reversed
phrases gives the counts of the ends and of extensions at the left. A range may begin below a phrase that stands in an
earlier one: the beginnings of each range's first phrase, at most four, are carried into it. So no phrase's extensions
have to fit into one task, however common its first word is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.llm.common import lean_worker, removed, written
from patchloom.llm.near_dup import bounded

LONGEST = 5
#: Bytes of text that a task counts at once.
BLOCK = 6_000_000
#: Bits of the table that tells frequent phrases, for each of them, and altogether (32 MB).
BITS_A_PHRASE, MOST_BITS = 16, 1 << 28
_BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in bytes(range(256)).lower())
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_COUNTS = "lang string, phrase string, n long"


def _slices(text: bytes, size: int) -> Iterator[bytes]:
    """text in slices that end before a blank."""
    low = 0
    while len(text) - low > size:
        at = text.find(b" ", low + size)
        if at < 0:
            break
        yield text[low:at]
        low = at
    yield text[low:]


def token_blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words with _BREAK between pieces, how many leading words the block before has had) of batches (lang, text).

    A text that is longer than a block goes on in the next one, which begins with its last words again.
    """
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)

    def taken(lang: str) -> list[bytes]:
        sizes.pop(lang)
        return _BREAK.join(held.pop(lang)).split()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            raw = text.as_py()
            if not raw:
                continue
            marked = raw.translate(_TABLE).replace(b"\n", b" \xff ")
            if len(marked) > size:
                before: list[bytes] = []
                for part in _slices(marked, size):
                    words = before + part.split()
                    yield lang, words, len(before)
                    before = words[1 - LONGEST :]
                continue
            held[lang].append(b" " + marked + b" ")
            sizes[lang] += len(marked)
            if sizes[lang] > size:
                yield lang, taken(lang), 0
        if sum(sizes.values()) > 4 * size:  # many languages
            for lang in list(held):
                yield lang, taken(lang), 0
    for lang in list(held):
        yield lang, taken(lang), 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P1
    return x ^ (x >> np.uint64(32))


def _word_digests(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_digests(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * _P1 + second)


def _known(table: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Whether both of a digest's bits are set."""
    mask, out = np.uint64(len(table) * 64 - 1), np.ones(len(digests), bool)
    for at in (digests & mask, (digests >> np.uint64(32)) & mask):
        out &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def bit_table(phrases: DataFrame, n: int) -> np.ndarray:
    """The bits of phrases (lang, phrase of one word or two), of which there are n; at most MOST_BITS of them."""
    size = min(MOST_BITS, max(1 << 12, 1 << (BITS_A_PHRASE * n - 1).bit_length()))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for lang, phrase in zip(batch["lang"], batch["phrase"], strict=True):
                d = _word_digests(lang, phrase.encode().split(b" "))
                digests.append(d[0] if len(d) == 1 else _pair_digests(d[:1], d[1:])[0])
            d = np.array(digests, np.uint64)
            at = np.concatenate([d, d >> np.uint64(32)]) & np.uint64(size - 1)
            yield pd.DataFrame({"slot": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    slots = phrases.select("lang", "phrase").mapInPandas(places, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return table


def _block_counts(lang: str, words: list[bytes], skip: int, orders: list[int], table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """lang, phrase, n of the phrases of a block that have orders[0] to orders[-1] words and only frequent parts.

    For words, the row without a phrase has their number.
    """
    ids: dict[bytes, int] = defaultdict(count().__next__)
    ids[_BREAK]
    at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    names = list(ids)

    def rows(phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), phrases, pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    if orders == [1]:
        n = np.bincount(at[skip:], minlength=len(names))
        n[0] = n[1:].sum()
        phrases = pa.array([None, *names[1:]], pa.binary()).cast(pa.string())
        seen = n > 0
        yield rows(phrases.filter(pa.array(seen)), n[seen])
        return
    names[0] = b""
    digests = _word_digests(lang, names)
    text = pa.array(names, pa.binary()).cast(pa.string())
    if orders[0] == 2:
        good = _known(table, digests)
        good[0] = False
        joined = good[at[:-1]] & good[at[1:]]
    else:
        joined = (at[:-1] > 0) & (at[1:] > 0)
        where = np.flatnonzero(joined)
        joined[where] = _known(table, _pair_digests(digests[at[where]], digests[at[where + 1]]))
    # open: where phrases of the present length begin; code: which of the distinct ones they are.
    begins = np.flatnonzero(joined)
    code, known = at[begins], text
    for size in range(2, orders[-1] + 1):
        if size > 2:
            fits = begins + size - 2 < len(joined)
            fits[fits] = joined[begins[fits] + size - 2]
            begins, code = begins[fits], code[fits]
        both, code, n = np.unique(code * len(names) + at[begins + size - 1], return_inverse=True, return_counts=True)
        known = pc.binary_join_element_wise(known.take(pa.array(both // len(names))), text.take(pa.array(both % len(names))), " ")
        if size >= orders[0]:
            if skip:
                n = np.bincount(code[begins + size > skip], minlength=len(both))
            yield rows(known.filter(pa.array(n > 0)), n[n > 0])


def _counted(texts: DataFrame, orders: list[int], table: np.ndarray | None, least: int) -> DataFrame:
    """lang, phrase, n of at least least, written; and for words the row of each language's number of words."""
    sent = None if table is None else texts.sparkSession.sparkContext.broadcast(table)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for lang, words, skip in token_blocks(batches):
            if len(words) > skip:
                yield from _block_counts(lang, words, skip, orders, None if sent is None else sent.value)

    summed = texts.mapInArrow(counts, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return written(summed.filter((F.col("n") >= least) | F.col("phrase").isNull()), "phrase-counts")


def _lockstep(stream: DataFrame) -> DataFrame:
    """lang, key, f, parts (counts of the key's beginnings of 1, 2... words), longer (count of its most frequent extension by a word).

    stream: lang, key (array of words), f, of which every beginning of a key is a key as well. Rows with a null f only add
    a count of extensions to a key of another range.
    """
    dealt = stream.repartitionByRange("lang", "key").select(F.spark_partition_id().alias("part"), "lang", "key", "f")
    dealt = written(dealt, "phrase-ranges")
    heads = dealt.groupBy("part").agg(F.min(F.struct("lang", "key")).alias("head")).select("part", "head.*")
    above = heads.filter(F.size("key") > 1).select("part", "lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("key") - 1), lambda i: F.slice("key", 1, i))).alias("key"))
    carried = above.join(dealt.drop("part"), ["lang", "key"]).select("part", "lang", "key", "f", F.lit(True).alias("carried"))
    rows = dealt.withColumn("carried", F.lit(False)).unionByName(carried).repartition("part").sortWithinPartitions("part", "lang", "key")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        place, stack, out = None, [], []

        def close() -> None:
            key, f, carry, parts, longer = stack.pop()
            out.append((place[1], key, None if carry else f, None if carry else parts, longer))

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=["lang", "key", "f", "parts", "longer"]).astype({"f": "Int64"})
            out.clear()
            return made

        for batch in batches:
            for part, lang, key, f, carry in zip(batch["part"], batch["lang"], batch["key"], batch["f"], batch["carried"], strict=True):
                key = list(key)
                if (part, lang) != place:
                    while stack:
                        close()
                    place = (part, lang)
                while stack and key[: len(stack[-1][0])] != stack[-1][0]:
                    close()
                parts = []
                if stack:
                    parts = [*stack[-1][3], stack[-1][1]]
                    stack[-1][4] = max(stack[-1][4], f)
                stack.append([key, f, carry, parts, 0])
            yield frame()
        while stack:
            close()
        yield frame()

    return rows.mapInPandas(walk, "lang string, key array<string>, f long, parts array<long>, longer long")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to 5 words that stand together most by their parts' counts.

    docs needs lang (null: und) and text (null: empty); other columns are ignored. A-Z are taken as a-z, texts are cut at
    .,;:!? and line ends into pieces and at blanks and tabs into words. a is how often a phrase stands within pieces,
    overlaps included, at least least (1 or more); n is the number of words of the language. Cut after k words it scores
    floor(1000 * a * n / (l * r)) of its parts' counts l and r; the cut of the least score counts, then the one of the
    smallest k. Phrases that lie in a longer one as frequent as they are go. The first top of a language are given, by
    score, a, and the phrase's bytes. Counts are exact and scores come from decimals of 38 digits. Repeated rows count
    again; texts without words and empty tables give no rows; texts of any length are counted in blocks.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = _counted(texts, [1], None, least)
    frequent = words.filter("phrase IS NOT NULL")
    pairs = _counted(texts, [2], bit_table(frequent, frequent.count()), least)
    longer = _counted(texts, list(range(3, LONGEST + 1)), bit_table(pairs, pairs.count()), least)

    stream = frequent.unionByName(pairs).unionByName(longer).select("lang", F.split("phrase", " ").alias("key"), F.col("n").alias("f"))
    stream = stream.filter("f IS NOT NULL")
    turned = F.reverse("key")
    forward = _lockstep(stream).select("lang", "key", "f", F.col("parts").alias("heads"), F.lit(None).cast("array<long>").alias("tails"), "longer")
    backward = _lockstep(stream.withColumn("key", turned)).select("lang", turned.alias("key"), "f", F.lit(None).cast("array<long>").alias("heads"), F.col("parts").alias("tails"), "longer")
    joined = forward.unionByName(backward).groupBy("lang", "key").agg(F.max("f").alias("a"), F.max("heads").alias("heads"), F.max("tails").alias("tails"), F.max("longer").alias("longer"))
    kept = joined.filter((F.size("key") > 1) & (F.col("longer") < F.col("a")))

    total = written(words.filter("phrase IS NULL").select("lang", F.col("n").alias("total")), "phrase-totals")
    big = lambda c: c.cast("decimal(19,0)")
    dividend = (F.lit(1000).cast("decimal(4,0)") * big(F.col("a"))).cast("decimal(22,0)")
    rows = kept.join(bounded(total), "lang").withColumn("dividend", (dividend * F.col("total").cast("decimal(16,0)")).cast("decimal(38,0)"))

    def cut(left, i):  # noqa: ANN001, ANN202
        right = F.element_at("tails", F.size("tails") - i)
        score = F.call_function("div", F.col("dividend"), (big(left) * big(right)).cast("decimal(38,0)"))
        return F.struct(score.alias("score"), (i + 1).alias("k"), left.alias("l"), right.alias("r"))

    best = rows.withColumn("best", F.array_min(F.transform("heads", cut)))
    scored = best.select("lang", F.concat_ws(" ", "key").alias("phrase"), "a", "best.l", "best.r", F.col("total").alias("n"), "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrases")
    removed(words, pairs, longer, total)
    return out
