"""Packing of documents into token windows by Karmarkar-Karp multiway differencing.

Each document's ids (with an end id) are cut into full windows, and what is left over into pieces. The pieces of a
group of some hundred windows are dealt to windows by the largest differencing method: every piece starts as a partial
partition, and the two partitions with the largest imbalance merge, heavy windows of one onto light windows of the
other, until one partition is left. When a window exceeds the capacity, the group gets one window more and is dealt
again. Groups follow the order of rows inside a Spark partition, so nothing is shuffled, a task holds one group at a
time, and a repeated task gives the same windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from patchloom.llm.common import lean_worker, rest_worker
from patchloom.llm.encoding import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of sizes in k windows of near-equal sums; windows may be empty when there are fewer sizes than windows."""
    if k == 1:
        return [list(range(len(sizes)))]
    # A partial partition: its nonempty windows as (load, members), heaviest first; up to k of them.
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = max(0, len(a) + len(b) - k)  # so many windows get a part of either, the heavy of a with the light of b
        alone_a, shared_a = a[: len(a) - both], a[len(a) - both :]
        alone_b, shared_b = b[: len(b) - both], b[len(b) - both :]
        merged = alone_a + alone_b + [(x + y, m + n) for (x, m), (y, n) in zip(shared_a, reversed(shared_b), strict=True)]
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tie, merged))
        tie += 1
    windows = [members for _, members in heap[0][2]] if heap else []
    return windows + [[] for _ in range(k - len(windows))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most capacity each, the fewest with which differencing meets it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        k += 1


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, keep_space: bool = True,
    group_windows: int = 256, fill: int = 1020, max_piece: int = 256, special_as_text: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary).

    docs needs doc_id and text; other columns are ignored. A null text counts as empty, and an empty text gives the
    end id alone; a null doc_id is kept as null; repeated rows are packed each time. No rows give no rows.
    A special token's string in a text is that token, or ordinary text with special_as_text. max_piece bounds the pieces
    that differencing deals; fill is the mean load of a full group's windows.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker()
        pieces = encoder(tokenizer_path, keep_space, "<u4", special_as_text)
        end = end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        group, total, rows = [], 0, []

        def flush() -> None:
            nonlocal sequence, group, total
            for members in windows_of([g[3] for g in group], window):
                offset = 0
                for doc_id, start, of, length, ids in (group[i] for i in members):
                    rows.append((doc_id, start, length, zlib.crc32(ids), of, sequence, offset, ids))
                    offset += length
                sequence += 1
            group, total = [], 0

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[*(c.split()[0] for c in SCHEMA.split(", ")), "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            rows.clear()
            return out

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].astype("Int64"), pieces.encode_all(batch["text"]), strict=True):
                ids += end
                of, at = len(ids) // 4, 0
                while of - at >= window:
                    piece = ids[4 * at : 4 * (at + window)]
                    rows.append((doc_id, at, window, zlib.crc32(piece), of, sequence, 0, piece))
                    sequence += 1
                    at += window
                while at < of:
                    length = min(max_piece, of - at, group_windows * fill - total)
                    group.append((doc_id, at, of, length, ids[4 * at : 4 * (at + length)]))
                    at, total = at + length, total + length
                    if total == group_windows * fill:
                        flush()
                if len(rows) > 4096:
                    yield frame()
        if group:
            flush()
        pieces.rest()
        last = frame()
        rest_worker()
        yield last

    return docs.select("doc_id", "text").mapInPandas(pack, SCHEMA + ", ids binary")
