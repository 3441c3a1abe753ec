"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped when read.

Rows are range-partitioned by doc_id and sorted; each partition becomes a shard of three files: `.bin` (ids in the
smallest unsigned type that holds the vocabulary), `.idx` (64-bit offsets of the documents in the shard, one more than
documents) and `.doc` (64-bit doc_ids; the smallest value stands for null). Each task returns its shard's counts alone,
and the bases of the shards are prefix sums over these.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import file_system, lean_worker, write_file
from patchloom.llm.encoding import encoder

NULL_ID = -(2**63)
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, keep_space: bool = False, dtype: str = "<u2", special_as_text: bool = False,
) -> None:
    """Encode every text and write shards and `manifest.json` below path, in ascending doc_id order (nulls first).

    docs needs doc_id and text; other columns are ignored. A null text counts as empty, and an empty text gives the
    end id alone. Rows of one doc_id follow each other by the hash of their text. No rows give an empty manifest.
    dtype must hold the vocabulary: `<u2` up to 65,536 ids, else `<u4`. A special token's string in a text is that token,
    or ordinary text with special_as_text. A task holds no ids but those of the texts it is encoding.
    """

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker()
        pieces, width = encoder(tokenizer_path, keep_space, dtype, special_as_text), np.dtype(dtype).itemsize
        end = end_id.to_bytes(width, "little")
        number = TaskContext.get().partitionId()
        doc_ids, lengths = [], []

        def encoded() -> Iterator[bytes]:
            for batch in batches:
                doc_ids.extend(NULL_ID if pd.isna(x) else int(x) for x in batch["doc_id"].astype("Int64"))
                for found in pieces.encode_all(batch["text"]):
                    lengths.append(len(found) // width + 1)
                    yield found + end

        parts = encoded()
        first = next(parts, None)
        if first is None:
            return
        name = f"{path}/{number:06d}"
        write_file(f"{name}.bin", chain([first], parts))
        pieces.rest()
        offsets = np.zeros(len(lengths) + 1, "<i8")
        np.cumsum(lengths, out=offsets[1:])
        write_file(f"{name}.idx", [offsets.tobytes()])
        write_file(f"{name}.doc", [np.array(doc_ids, "<i8").tobytes()])
        yield pd.DataFrame({"shard": [number], "documents": [len(doc_ids)], "tokens": [int(offsets[-1])]})

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    made = sorted(ordered.select("doc_id", "text").mapInPandas(shard, "shard long, documents long, tokens long").collect())
    bases = list(accumulate((r.tokens for r in made), initial=0))
    shards = [r.asDict() | {"base": b} for r, b in zip(made, bases, strict=False)]
    write_file(f"{path}/manifest.json", [json.dumps({"dtype": dtype, "tokens": bases[-1], "shards": shards}).encode()])


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A memory map of a file in a mounted folder; a store without mounts is read as a whole shard."""
    fs, path = file_system(uri)
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_manifest(path: str) -> dict:
    fs, at = file_system(f"{path}/manifest.json")
    with fs.open_input_file(at) as f:
        return json.loads(f.read())


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document from the files: doc_id, start over all shards, n_tokens, ids_crc32, and ids if asked for."""
    manifest = read_manifest(path)
    dtype = manifest["dtype"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, base in zip(batch["shard"], batch["base"], strict=True):
                name = f"{path}/{number:06d}"
                ids, offsets, doc_ids = _mapped(f"{name}.bin", dtype), _mapped(f"{name}.idx", "<i8"), _mapped(f"{name}.doc", "<i8")
                for low in range(0, len(doc_ids), 4096):
                    own = doc_ids[low : low + 4096]
                    cuts = [ids[offsets[i] : offsets[i + 1]].astype("<u4") for i in range(low, low + len(own))]
                    out = {
                        "doc_id": pd.array(own, "Int64"), "start": offsets[low : low + len(own)] + base,
                        "n_tokens": [len(c) for c in cuts], "ids_crc32": [zlib.crc32(c.tobytes()) for c in cuts],
                    }
                    out["doc_id"][own == NULL_ID] = pd.NA
                    yield pd.DataFrame(out | ({"ids": cuts} if with_ids else {}))

    rows = [(s["shard"], s["base"]) for s in manifest["shards"]]
    listed = spark.createDataFrame(rows, "shard long, base long").repartition(max(1, len(rows)))
    return listed.mapInPandas(read, DOCUMENTS + (", ids array<long>" if with_ids else ""))
