"""Scores of texts by a word bigram model with Katz backoff, learnt from the corpus itself.

Bigram counts are discounted by Good-Turing estimates (counts above 5 are kept as they are; with least above 1, bigrams
seen less than least times give all their mass to backing off), and a history's backoff weight makes its distribution
sum to one exactly over the words known and one unknown word. Unigrams are discounted in the same way, their left-over mass being the unknown word's.

The corpus is read in chunks, the consecutive rows of a Spark partition. A chunk's distinct bigrams and their counts are
dealt to buckets by the history's hash, as compact sorted arrays: 64 bits for a history and 56 for the word after it,
so that two of a hundred million words share their bits with a chance of 7 %. The number of buckets follows the bytes of text. Buckets add the chunks' counts up and
keep the model as tables partitioned by kind: words, bigrams, and for each chunk what it asked for. Backoff weights need
the unigram counts of the words after a history, which a join fetches. Answers go to a file for each chunk, and the
second reading of the corpus evaluates its tokens by them. Both readings must see the same rows in the same partitions,
as scans of files do; a digest of the chunk's keys is compared, and a difference raises an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import crc_remainder, file_system, lean_worker, shared_dir, write_file, written

_LOWER = bytes(range(256)).lower()
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
START, END = np.uint64(1), np.uint64(2)  # as history before the first word, and as the token after the last
CHUNK_TOKENS = 1_000_000
SCORED_TOKENS = 100_000
LARGEST_DISCOUNTED = 5
_SHIFT = np.uint64(8)
#: Entries of a bucket that are added up at once: those of a range of histories.
PART_ENTRIES = 400_000
#: Bytes of text for each bucket of histories; with it a bucket has some two million entries whatever the corpus' size.
BUCKET_BYTES = 16 << 20


def _tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text in UTF-8, and the end."""
    words = _WORD.findall((text or b"").translate(_LOWER))
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


class Chunk:
    """Tokens of some documents: sorted distinct histories and bigrams, and each token's place among them."""

    def __init__(self, documents: list[np.ndarray], buckets: int):
        self.sizes = np.array([len(d) for d in documents])
        self.words = np.concatenate(documents)
        history = np.empty_like(self.words)
        history[1:] = self.words[:-1]
        self.starts = np.cumsum(self.sizes) - self.sizes
        history[self.starts] = START
        after = self.words >> _SHIFT
        order = np.lexsort((after, history, (history % np.uint64(buckets)).astype(np.uint32)))
        h, w = history[order], after[order]
        del history, after
        new_h = np.r_[True, h[1:] != h[:-1]]
        new = new_h | np.r_[True, w[1:] != w[:-1]]
        self.history, self.after = h[new_h], w[new]
        self.runs = np.diff(np.r_[np.flatnonzero(new_h[new]), new.sum()])  # distinct words after each history
        self.of_bigram = np.empty(len(order), np.int32)
        self.of_bigram[order] = np.cumsum(new) - 1
        self.of_history = np.empty(len(order), np.int32)
        self.of_history[order] = np.cumsum(new_h) - 1
        own = self.history % np.uint64(buckets)
        self.cuts = np.searchsorted(own, np.arange(buckets + 1, dtype=np.uint64))
        self.bigram_cuts = np.r_[0, np.cumsum(self.runs)][self.cuts]

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Of each bigram in the documents marked by train."""
        return np.bincount(self.of_bigram[np.repeat(train, self.sizes)], minlength=len(self.after))

    def digest(self) -> str:
        """16 hexadecimal digits."""
        return xxhash.xxh3_64_hexdigest(self.after.tobytes(), xxhash.xxh3_64_intdigest(self.history.tobytes()))


def _pack(values: np.ndarray, dtype: str) -> bytes:
    """Byte planes of values, compressed: most of their high bytes are 0."""
    width = np.dtype(dtype).itemsize
    return zlib.compress(np.ascontiguousarray(values.astype(dtype).view(np.uint8).reshape(len(values), width).T).tobytes(), 1)


def _unpack(packed: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, len(planes) // width).T).view(dtype).ravel()


def _seven(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _from_seven(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int, size: int) -> Iterator[tuple[int, Chunk, list]]:
    """Chunks of this task's rows with their numbers and their (doc_id, train) rows.

    Texts leave the Arrow batch one at a time. A caller that deletes a chunk before it asks for the next holds one at most.
    """
    lean_worker()
    number = TaskContext.get().partitionId() << 24
    documents, rows, held = [], [], 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for text, *row in zip(texts, batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), strict=True):
            documents.append(_tokens(text.as_py()))
            rows.append(row)
            held += len(documents[-1])
            if held >= size:
                full, documents, held = documents, [], 0
                chunk = Chunk(full, buckets)
                del full
                yield number, chunk, rows
                number, rows, chunk = number + 1, [], None
    if documents:
        yield number, Chunk(documents, buckets), rows


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing discounts d[r] for r up to 5 from the numbers of types seen r times (index r, up to 6).

    Near copies make these numbers uneven. Where Turing's estimates leave the range from 0 to 1, the numbers are first
    smoothed by a line through their logarithms (simple Good-Turing); where they are too few even for that, absolute
    discounts of 0.5 stand in.
    """
    k = LARGEST_DISCOUNTED
    n = of_counts.astype(float)
    r = np.arange(1, k + 1)
    d = np.ones(k + 1)
    fine = lambda: np.isfinite(d).all() and (d > 0).all() and (d[1:] < 1).all()
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = (k + 1) * n[k + 1] / n[1]
        d[1:] = ((r + 1) * n[2 : k + 2] / (n[1 : k + 1] * r) - rest) / (1 - rest)
    if not fine() and (n[1:] > 0).all():
        slope = np.polyfit(np.log(np.arange(1, k + 2)), np.log(n[1 : k + 2]), 1)[0]
        d[1:] = (1 + 1 / r) ** (slope + 1)
    if not fine():
        d[1:] = 1 - 0.5 / r
    return d


class Unigrams:
    """log10 probabilities of words by their training counts; count 0 is the one unknown word."""

    def __init__(self, tokens: int, of_counts: np.ndarray):
        self.d, self.tokens = discounts(of_counts), tokens
        k = LARGEST_DISCOUNTED
        lost = sum((1 - self.d[r]) * r * of_counts[r] for r in range(1, k + 1))
        self.unknown = lost / tokens if tokens else 1.0

    def probability(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= LARGEST_DISCOUNTED, self.d[np.minimum(c, LARGEST_DISCOUNTED)], 1.0)
        return np.where(c > 0, d * c / max(1, self.tokens), self.unknown)


def bigram_probability(c: np.ndarray, of_history: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of bigrams kept."""
    return np.where(c <= LARGEST_DISCOUNTED, d[np.minimum(c, LARGEST_DISCOUNTED)], 1.0) * c / np.maximum(of_history, 1)


def _ask(docs: DataFrame, buckets: int, size: int) -> DataFrame:
    """For each chunk and bucket: history, runs, after, n (training counts), digest of the chunk; and the chunk's training documents, in bucket 0."""

    binary = pa.binary()
    schema = [("bucket", pa.int32()), ("chunk", pa.int64()), ("history", binary), ("runs", binary), ("after", binary), ("n", binary), ("digest", pa.string()), ("documents", pa.int64())]

    def dealt(number: int, chunk: Chunk, rows: list) -> pa.RecordBatch:
        train = np.array([t for _, t in rows])
        counts, digest = chunk.counts(train), chunk.digest()
        out = []
        for b in range(buckets):
            h, w = slice(*chunk.cuts[b : b + 2]), slice(*chunk.bigram_cuts[b : b + 2])
            if h.start < h.stop or b == 0:
                blobs = chunk.history[h].astype("<u8").tobytes(), _pack(chunk.runs[h], "<u4"), _seven(chunk.after[w]), _pack(counts[w], "<u4")
                out.append((b, number, *blobs, digest, int(train.sum()) if b == 0 else 0))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*out), schema, strict=True)], schema=pa.schema(schema))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, rows in _chunks(batches, buckets, size):
            out = dealt(number, chunk, rows)
            del chunk
            yield out

    return docs.mapInArrow(ask, "bucket int, chunk long, history binary, runs binary, after binary, n binary, digest string, documents long")


_TABLE = "kind string, bucket int, chunk long, one binary, two binary, three binary, digest string, documents long, tokens long, types array<long>, unigram_types array<long>"


def _add_up(group: pd.DataFrame, least: int) -> pd.DataFrame:
    """One bucket's tables: words (history, count), bigrams seen least times or more, each chunk's places in them, statistics."""
    lean_worker()
    bucket = int(group["bucket"].iloc[0])
    group = group.sort_values("chunk")
    histories = [np.frombuffer(x, "<u8") for x in group["history"]]
    runs = [_unpack(x, "<u4") for x in group["runs"]]
    ends = [np.r_[0, np.cumsum(r, dtype=np.int64)] for r in runs]
    after, n = group["after"].tolist(), [_unpack(x, "<u4") for x in group["n"]]
    entries = sum(int(e[-1]) for e in ends)
    parts = 1 + entries // PART_ENTRIES
    edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = [np.r_[0, np.searchsorted(h, edges), len(h)] for h in histories]  # a chunk's histories are sorted
    k = LARGEST_DISCOUNTED + 2
    of_types, of_words = np.zeros(k, np.int64), np.zeros(k, np.int64)
    places: list[list[np.ndarray]] = [[] for _ in histories]
    answers: list[list[np.ndarray]] = [[] for _ in histories]
    kept: list[tuple] = []  # for each part: words, count, and of the bigrams kept: place of the history, word after it, count
    tokens = before = 0
    for part in range(parts):
        lows, highs = [c[part] for c in cuts], [c[part + 1] for c in cuts]
        from_, to = [e[i] for e, i in zip(ends, lows, strict=True)], [e[i] for e, i in zip(ends, highs, strict=True)]
        words, place = np.unique(np.concatenate([h[i:j] for h, i, j in zip(histories, lows, highs, strict=True)]), return_inverse=True)
        of_entry = np.repeat(place.astype(np.uint32), np.concatenate([r[i:j] for r, i, j in zip(runs, lows, highs, strict=True)]))
        w = np.concatenate([_from_seven(x[7 * i : 7 * j]) for x, i, j in zip(after, from_, to, strict=True)])
        c = np.concatenate([x[i:j] for x, i, j in zip(n, from_, to, strict=True)])
        order = np.lexsort((w, of_entry))
        new = np.ones(len(order), bool)
        new[1:] = (of_entry[order][1:] != of_entry[order][:-1]) | (w[order][1:] != w[order][:-1])
        type_of = np.empty(len(order), np.int64)
        type_of[order] = np.cumsum(new) - 1
        total = np.bincount(type_of, c, new.sum()).astype(np.int64)
        count = np.bincount(of_entry, c, len(words)).astype(np.int64)
        answer = np.where(total >= least, total, 0)[type_of].astype(np.uint32)
        firsts, keep, known = order[new], total >= max(least, 1), words != START
        of_types += np.bincount(total[total < k], minlength=k)
        of_words += np.bincount(count[known & (count < k)], minlength=k)
        tokens += int(count[known].sum())
        kept.append((words, count, of_entry[firsts][keep] + np.uint32(before), _seven(w[firsts][keep]), total[keep]))
        at = h_at = 0
        for i, (low, high, size) in enumerate(zip(lows, highs, np.subtract(to, from_), strict=True)):
            places[i].append(place[h_at : h_at + high - low].astype(np.uint32) + np.uint32(before))
            answers[i].append(answer[at : at + size])
            at, h_at = at + size, h_at + high - low
        before += len(words)
    words, count, of_history, total = (np.concatenate([x[i] for x in kept]) for i in (0, 1, 2, 4))
    rows = [
        ("words", bucket, 0, words.astype("<u8").tobytes(), _pack(count, "<u8"), None, "", 0, 0, [], []),
        ("bigrams", bucket, 0, _pack(of_history, "<u4"), b"".join(x[3] for x in kept), _pack(total, "<u8"), "", 0, 0, [], []),
        ("statistics", bucket, 0, None, None, None, "", int(group["documents"].sum()), tokens, of_types.tolist(), of_words.tolist()),
    ]
    for chunk, digest, p, a in zip(group["chunk"], group["digest"], places, answers, strict=True):
        rows.append(("answers", bucket, chunk, _pack(np.concatenate(p), "<u4"), _pack(np.concatenate(a), "<u4"), None, digest, 0, 0, [], []))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _TABLE.split(", ")])


def score_texts(docs: DataFrame, fold: int = 0, folds: int = 10, chunk_tokens: int = CHUNK_TOKENS, buckets: int | None = None, least: int = 1) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id) modulo folds is fold are held out of training. docs needs doc_id and text, as a scan
    of files, a table or a checkpoint; other columns are ignored. A null or empty text is the end token alone; a null
    doc_id is in training; repeated rows count each time. Without training documents every word is the unknown one, so
    scores are 0 for the model. buckets follows the bytes of text by BUCKET_BYTES where it isn't given; a bucket must fit in a task.
    least is the count from which a bigram is in the model: 1 keeps all of Katz's, 2 leaves out those seen once.
    """
    spark = docs.sparkSession
    if not buckets:
        size = docs.agg(F.sum(F.octet_length(F.col("text")).cast("long"))).first()[0] or 0
        buckets = 1 + size // BUCKET_BYTES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_remainder(F.col("doc_id"), folds) != fold).alias("train"))
    path = shared_dir(spark, "katz")
    _ask(rows, buckets, chunk_tokens).groupBy("bucket").applyInPandas(lambda group: _add_up(group, least), _TABLE).write.partitionBy("kind").parquet(f"{path}/model")
    model = spark.read.schema(_TABLE.removeprefix("kind string, ") + ", kind string").parquet(f"{path}/model")

    # Sums over the buckets' statistics: one row for each bucket of a few numbers.
    made = model.filter("kind = 'statistics'").select("documents", "tokens", "types", "unigram_types").collect()
    documents = sum(r.documents for r in made)
    tokens = sum(r.tokens for r in made) + documents
    sums = lambda name: np.sum([getattr(r, name) for r in made], 0) if made else np.zeros(LARGEST_DISCOUNTED + 2, np.int64)
    of_words = sums("unigram_types").astype(np.int64)
    if documents and documents < len(of_words):
        of_words[documents] += 1
    distinct = model.filter("kind = 'words'").mapInPandas(_known_words, "n long").agg(F.sum("n")).first()[0] or 0
    distinct += documents > 0
    d, unigrams = discounts(sums("types")), Unigrams(tokens, of_words)
    end_count = documents

    def counts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words, count in zip(batch["one"], batch["two"], strict=True):
                yield pd.DataFrame({"word": (np.frombuffer(words, "<u8") >> _SHIFT).astype(np.int64), "count": _unpack(count, "<u8").astype(np.int64)})

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, after in zip(batch["bucket"], batch["two"], strict=True):
                yield pd.DataFrame({"bucket": bucket, "word": np.unique(_from_seven(after)).astype(np.int64)})

    counts = model.filter("kind = 'words'").select("one", "two").mapInPandas(counts_of, "word long, count long").groupBy("word").agg(F.max("count").alias("count"))
    asked = model.filter("kind = 'bigrams'").select("bucket", "two").mapInPandas(wanted, "bucket int, word long")
    fetched = asked.join(counts, "word").groupBy("bucket", F.pmod(F.col("word"), F.lit(8)).alias("part")).agg(F.collect_list("word").alias("words"), F.collect_list("count").alias("counts"))
    sides = fetched.select("bucket", "words", "counts")

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Counts and backoff weights of the chunks' histories, and counts of their bigrams, for one bucket."""
        lean_worker()
        columns = ["chunk", "bucket", "digest", "count", "weight", "bigram"]
        own = dict(iter(left.groupby("kind")))
        if "answers" not in own:
            return pd.DataFrame([], columns=columns)
        count = _unpack(own["words"]["two"].iloc[0], "<u8").astype(np.int64)
        kept = own["bigrams"].iloc[0]
        alpha = np.ones(len(count))
        if len(kept["two"]):
            h, after, c = _unpack(kept["one"], "<u4").astype(np.int64), _from_seven(kept["two"]).astype(np.int64), _unpack(kept["three"], "<u8").astype(np.int64)
            words, found = (np.concatenate([np.asarray(x, np.int64) for x in right[name]] or [np.zeros(0, np.int64)]) for name in ("words", "counts"))
            order = np.argsort(words)
            words, found = np.r_[words[order], np.iinfo(np.int64).max], np.r_[found[order], 0]
            at = np.searchsorted(words, after)
            of_word = np.where(words[at] == after, found[at], 0)
            of_word[after == int(END >> _SHIFT)] = end_count
            seen = np.bincount(h, bigram_probability(c, count[h], d), len(count))
            lower = np.bincount(h, unigrams.probability(of_word), len(count))
            # A history all of whose mass is kept backs off to what is left by rounding only.
            alpha = np.maximum(1 - seen, 1e-12) / np.maximum(1 - lower, 1e-12)
        out = []
        for chunk, digest, places, bigram in zip(own["answers"]["chunk"], own["answers"]["digest"], own["answers"]["one"], own["answers"]["two"], strict=True):
            p = _unpack(places, "<u4")
            out.append((chunk, left["bucket"].iloc[0], digest, _pack(count[p], "<u8"), alpha[p].astype("<f8").tobytes(), bigram))
        return pd.DataFrame(out, columns=columns)

    left = model.filter("kind <> 'statistics'").select("bucket", F.col("kind").cast("string").alias("kind"), "chunk", "one", "two", "three", "digest")
    kind = "chunk long, bucket int, digest string, count binary, weight binary, bigram binary"
    answers = left.groupBy("bucket").cogroup(sides.groupBy("bucket")).applyInPandas(answer, kind)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for batch in batches:
            for row in batch.itertuples():
                if row.chunk != last and held:
                    _store_chunk(path, last, held)
                    held = []
                last = row.chunk
                held.append(row)
        if held:
            _store_chunk(path, last, held)
        yield pd.DataFrame({"chunks": [len(held)]})

    answers.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInPandas(store, "chunks long").agg(F.sum("chunks")).collect()

    floor, scale = 0.1, tokens + 0.1 * (distinct + 1)

    def scored(number: int, chunk: Chunk, owners: list) -> pa.RecordBatch:
        count, alpha, kept = _load_chunk(path, number, chunk.digest())
        order = np.argsort(chunk.history)
        histories = chunk.history[order]
        known, base, model = [], [], []
        ends = chunk.starts + chunk.sizes
        first = 0
        while first < len(owners):  # some documents at a time, so that a task holds few arrays of a chunk's length
            last = max(first + 1, int(np.searchsorted(ends, chunk.starts[first] + SCORED_TOKENS)))
            own = slice(chunk.starts[first], ends[last - 1])
            words, h = chunk.words[own], chunk.of_history[own]
            c = count[order[np.minimum(np.searchsorted(histories, words), len(order) - 1)]]
            c[words == END] = end_count
            seen = kept[chunk.of_bigram[own]].astype(np.int64)
            of_history = np.where(chunk.history == START, documents, count)[h]
            lower = alpha[h] * unigrams.probability(c)
            with np.errstate(divide="ignore"):
                model_logs = np.log10(np.where(seen > 0, bigram_probability(seen, of_history, d), lower))
            base_logs = np.log10((c + floor) / scale)
            for out, x in ((known, (c > 0).astype(np.int64)), (base, base_logs), (model, model_logs)):
                out.append(np.add.reduceat(x, chunk.starts[first:last] - chunk.starts[first]))
            first = last
        columns = {
            "doc_id": pa.array([o[0] for o in owners], pa.int64()), "held_out": pa.array([not o[1] for o in owners]), "n_tokens": chunk.sizes.astype(np.int64),
            "n_known": np.concatenate(known), "train_tokens": np.full(len(owners), tokens, np.int64), "base_score": np.concatenate(base), "score": np.concatenate(model),
        }
        return pa.RecordBatch.from_pydict(columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, owners in _chunks(batches, buckets, chunk_tokens):
            out = scored(number, chunk, owners)
            del chunk
            yield out

    return rows.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _known_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for words, count in zip(batch["one"], batch["two"], strict=True):
            yield pd.DataFrame({"n": [int(((_unpack(count, "<u8") > 0) & (np.frombuffer(words, "<u8") != START)).sum())]})


def _store_chunk(path: str, number: int, rows: list) -> None:
    """Arrays of one chunk, its buckets in order: digest, sizes, counts and weights of histories, counts of bigrams."""
    count = np.concatenate([_unpack(r.count, "<u8") for r in rows])
    alpha = np.concatenate([np.frombuffer(r.weight, "<f8") for r in rows])
    kept = np.concatenate([_unpack(r.bigram, "<u4") for r in rows])
    parts = [_pack(count, "<u8"), zlib.compress(alpha.astype("<f4").tobytes(), 1), _pack(kept, "<u4")]
    head = rows[0].digest.encode() + np.array(list(map(len, parts)), "<i8").tobytes()
    write_file(f"{path}/answers/{number:016x}", [head, *parts])


def _load_chunk(path: str, number: int, digest: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fs, at = file_system(f"{path}/answers/{number:016x}")
    with fs.open_input_file(at) as f:
        raw = f.read()
    a, b, c = np.frombuffer(raw[16:40], "<i8")
    if raw[:16].decode() != digest:
        raise ValueError(f"chunk {number:x} has other rows than at the first reading: docs must be read alike each time")
    raw = raw[40:]
    return _unpack(raw[:a], "<u8").astype(np.int64), np.frombuffer(zlib.decompress(raw[a : a + b]), "<f4").astype(np.float64), _unpack(raw[a + b : a + b + c], "<u4")
