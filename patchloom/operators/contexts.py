"""Path contexts: vocabularies, membership, truncation and statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.operators.ranks import running
from patchloom.operators.rows import seeded

#: A vocabulary is sent to all tasks below this size.
BROADCAST_BYTES = 64 << 20
#: Contexts of a row that a Python task gets at once where their order in the row doesn't matter.
PART = 100


def context_terms(df: DataFrame, first_only: bool = True, key: str = "id") -> DataFrame:
    """kind (word, path) and term of contexts "word,path,word": of each row's first context, or of all."""
    contexts = F.slice("contexts", 1, 1) if first_only else F.col("contexts")
    parts = df.select(F.explode(contexts).alias("c")).select(F.split("c", ",").alias("p"))
    kinds = F.array(F.struct(F.lit("word").alias("kind"), F.get("p", 0).alias("term")), F.struct(F.lit("path").alias("kind"), F.get("p", 1).alias("term")), F.struct(F.lit("word").alias("kind"), F.get("p", 2).alias("term")))
    return parts.select(F.explode(kinds).alias("k")).select("k.kind", "k.term").filter("term is not null")


def vocab_histogram(terms: DataFrame, max_size: int | None = None, min_count: int = 0) -> DataFrame:
    """kind, term, n; with max_size, terms of each kind with at least the count of the one at that place (ties are kept).

    The place is found among the distinct counts, of which n occurrences have at most sqrt(2 n), not among the terms.
    """
    counts = terms.groupBy("kind", "term").agg(F.count("*").alias("n"))
    if max_size is not None:
        sizes = counts.groupBy("kind", "n").agg(F.count("*").alias("terms"))
        above = F.sum("terms").over(Window.partitionBy("kind").orderBy(F.desc("n")))
        edge = sizes.withColumn("r_", above).filter(F.col("r_") >= max_size).groupBy("kind").agg(F.max("n").alias("edge"))
        counts = counts.join(F.broadcast(edge), "kind", "left").filter(F.col("n") >= F.coalesce("edge", F.lit(min_count))).drop("edge")
    return counts.filter(F.col("n") >= min_count)


def _known_terms(vocab: DataFrame) -> tuple[list[str], list[str]] | None:
    """Words and paths of a vocabulary of at most BROADCAST_BYTES, else None."""
    size = vocab.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    if size > BROADCAST_BYTES:
        return None
    rows = vocab.select("kind", "term").toArrow()
    return tuple(rows.filter(pc.equal(rows.column("kind"), kind)).column("term").to_pylist() for kind in ("word", "path"))


def _found_parts(contexts: pa.ListArray, words: pa.Array, paths: pa.Array) -> np.ndarray:
    """How many of the three parts of each context of all rows are in the vocabulary."""
    parts = pc.split_pattern(contexts.flatten(), ",")
    total, sizes = np.zeros(len(parts), np.int64), pc.fill_null(pc.list_value_length(parts), 0)
    for i, known in enumerate((words, paths, words)):
        there = np.asarray(pc.greater(sizes, i))
        own = pc.list_element(parts.filter(pa.array(there)), i)
        total[there] += np.asarray(pc.is_in(own, value_set=known))
    return total


def context_membership(df: DataFrame, vocab: DataFrame, key: str = "id") -> DataFrame:
    """One row for each context: key, pos, context, is_full (all three parts in the vocabulary), is_partial (any).

    A vocabulary below BROADCAST_BYTES is looked up in Arrow batches; a larger one is joined.
    """
    known = _known_terms(vocab)
    if known is None:
        return _joined_membership(df, vocab, key)
    sent = df.sparkSession.sparkContext.broadcast(known)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, paths = (pa.array(k, pa.string()) for k in sent.value)
        for batch in batches:
            contexts = batch.column(1)
            total = _found_parts(contexts, words, paths)
            rows = np.asarray(pc.list_parent_indices(contexts))
            first = np.zeros(len(batch) + 1, np.int64)
            np.cumsum(pc.fill_null(pc.list_value_length(contexts), 0), out=first[1:])
            pos = pa.array(np.arange(len(rows)) - first[rows] + np.asarray(batch.column(2))[rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pos, contexts.flatten(), pa.array(total == 3), pa.array(total > 0)], [key, "pos", "context", "is_full", "is_partial"])

    # Long rows are cut, so that a batch's size does not go by the longest texts.
    starts = F.sequence(F.lit(0), F.greatest(F.size("contexts") - 1, F.lit(0)), F.lit(PART))
    parts = df.select(key, F.explode(F.array("contexts")).alias("contexts")).select(key, "contexts", F.explode(starts).alias("at"))
    parts = parts.select(key, F.slice("contexts", F.col("at") + 1, PART).alias("contexts"), "at")
    return parts.mapInArrow(look, f"{key} {df.schema[key].dataType.simpleString()}, pos int, context string, is_full boolean, is_partial boolean")


def _joined_membership(df: DataFrame, vocab: DataFrame, key: str = "id") -> DataFrame:
    rows = df.select(key, F.posexplode("contexts").alias("pos", "context")).withColumn("p_", F.split("context", ","))
    words, paths = (vocab.filter(F.col("kind") == kind).select(F.col("term")) for kind in ("word", "path"))
    for i, own in enumerate((words, paths, words)):
        rows = rows.join(own.select(F.col("term").alias(f"t{i}_"), F.lit(1).alias(f"in{i}_")), F.get("p_", i) == F.col(f"t{i}_"), "left")
    found = [F.coalesce(F.col(f"in{i}_"), F.lit(0)) for i in range(3)]
    total = found[0] + found[1] + found[2]
    return rows.select(key, "pos", "context", (total == 3).alias("is_full"), (total > 0).alias("is_partial"))


def sample_contexts(df: DataFrame, vocab: DataFrame, max_contexts: int, seed: int = 0, key: str = "id") -> DataFrame:
    """df's key with contexts cut to max_contexts: rows over it keep full contexts first, then partial ones, at random.

    Rows within max_contexts keep all of theirs; a row over it without any context of the vocabulary is left out. With a
    vocabulary below BROADCAST_BYTES each row is cut where it is read, by sorting its own contexts; with a larger one
    contexts are joined with it.
    """
    known = _known_terms(vocab)
    if known is None:
        return _joined_sample(df, vocab, max_contexts, seed, key)
    sent = df.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, paths = (pa.array(k, pa.string()) for k in sent.value)
        for batch in batches:
            contexts, names = batch.column(1), batch.column(2).to_pylist()
            total = _found_parts(contexts, words, paths)
            stops = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(contexts), 0)))
            kept, rows, sizes = [], [], []
            for i, stop in enumerate(stops.tolist()):
                low = stops[i - 1] if i else 0
                at = np.arange(low, stop)
                if len(at) > max_contexts:
                    head = f"{seed}:{names[i]}:" if names[i] is not None else f"{seed}:"
                    full, partial = (np.flatnonzero(own) for own in (total[low:stop] == 3, (total[low:stop] > 0) & (total[low:stop] < 3)))
                    # Digests order only the kind that is cut.
                    whole, cut_, room = (full[:0], full, max_contexts) if len(full) > max_contexts else (full, partial, max_contexts - len(full))
                    if len(cut_) > room:
                        digests = b"".join([hashlib.md5(f"{head}{j}".encode()).digest() for j in cut_.tolist()])
                        high, last = np.frombuffer(digests, ">u8").reshape(-1, 2).T
                        cut_ = cut_[np.lexsort((cut_, last, high))[:room]]
                    at = low + np.sort(np.concatenate([whole, cut_]))
                    if not len(at):
                        continue
                kept.append(at)
                rows.append(i)
                sizes.append(len(at))
            if not rows:
                continue
            values = contexts.flatten().take(pa.array(np.concatenate(kept), pa.int64()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), lists], [key, "contexts"])

    rows = df.filter("contexts IS NOT NULL").select(key, "contexts", F.col(key).cast("string").alias("name_"))
    return rows.mapInArrow(cut, f"{key} {df.schema[key].dataType.simpleString()}, contexts array<string>")


def _joined_sample(df: DataFrame, vocab: DataFrame, max_contexts: int, seed: int, key: str) -> DataFrame:
    rows = df.select(key, "contexts")
    short = rows.filter(F.size("contexts") <= max_contexts)
    long = _joined_membership(rows.filter(F.size("contexts") > max_contexts), vocab, key).filter("is_partial")
    order = Window.partitionBy(key).orderBy(F.desc("is_full"), seeded(seed, key, "pos"), "pos")
    kept = long.withColumn("r_", F.row_number().over(order)).filter(F.col("r_") <= max_contexts)
    cut = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "context"))), lambda s: s["context"]).alias("contexts"))
    return short.unionByName(cut)


def context_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """max_unfiltered, average, average_sampled, total and empty: contexts before and after the cut, by rows that are left."""
    a = before.agg(F.max(F.size("contexts")).alias("max_unfiltered"), F.sum(F.size("contexts")).alias("s"), F.count("*").alias("n"))
    b = after.filter(F.size("contexts") > 0).agg(F.sum(F.size("contexts")).alias("t"), F.count("*").alias("total"))
    mean = lambda x: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col("total").cast("double")), F.lit(0.0))
    return a.join(F.broadcast(b)).select("max_unfiltered", mean("s").alias("average"), mean("t").alias("average_sampled"), "total", (F.col("n") - F.col("total")).alias("empty"))


def line_offsets(lines: DataFrame, file: str = "path", number: str = "line_no", text: str = "line") -> DataFrame:
    """lines with offset, the byte at which each starts in its file; lines end with one byte. A file's lines may be in many tasks."""
    return running(lines, [file], [number], {"offset": (F.octet_length(text) + 1).cast("long")})
