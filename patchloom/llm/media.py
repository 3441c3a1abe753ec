"""Media columns: content-addressed payloads in tar shards, with header-only range reads for metadata.

A payload is stored once, as an 8-bit greyscale PNG 64 samples wide, under the digest of its bytes. Rows that share a
payload share its digest, and carry that digest with the shard, the offset and the length of the stored form. Metadata
columns come from range reads of the header alone.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import file_system, shared_dir, write_file, written

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
INDEX = "digest string, shard string, offset long, length long"


def padded(text: Column) -> Column:
    """UTF-8 bytes of text (null: none) with bytes 0 appended up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    missing = F.when(n == 0, WIDTH).otherwise((WIDTH - n % WIDTH) % WIDTH)
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), missing)))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Lossless 8-bit greyscale image; the payload's length must be a positive multiple of 64."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    at, data = len(_SIGNATURE), []
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        if stored[at + 4 : at + 8] == b"IDAT":
            data.append(stored[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    return lines[:, 1:].tobytes()


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack_from(">IIBB", head, 16)


def store_payloads(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Write the payloads of docs in tar shards below path; returns the index, a row for each digest: digest, shard, offset, length.

    Each task of the scan writes one shard, in which a payload stands once however many rows share it; nothing but the
    index is shuffled. A payload that several shards hold has its least place in the index, and its other copies are
    left unused. Null and empty texts share the payload of 64 zero bytes; no rows give an empty index.
    """

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"{path}/shard-{TaskContext.get().partitionId():06d}.tar"
        rows: list[tuple[str, str, int, int]] = []
        seen: set[bytes] = set()

        def members() -> Iterator[bytes]:
            at = 0
            for batch in batches:
                for payload in batch["payload"]:
                    digest = hashlib.sha256(payload).digest()
                    if digest in seen:
                        continue
                    seen.add(digest)
                    media = to_png(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    tail = b"\0" * (-len(media) % tarfile.BLOCKSIZE)
                    rows.append((digest.hex(), name, at + len(head), len(media)))
                    at += len(head) + len(media) + len(tail)
                    yield head + media + tail
            yield b"\0" * (2 * tarfile.BLOCKSIZE)

        write_file(name, members())
        yield pd.DataFrame(rows, columns=["digest", "shard", "offset", "length"])

    # The index is written, not only planned: reading it again must not write the shards again.
    made = written(docs.select(padded(F.col(text)).alias("payload")).mapInPandas(shard, INDEX), "media-index")
    places = made.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"))
    return places.select("digest", "p.shard", "p.offset", "p.length")


def read_stored(index: DataFrame, read_payloads: bool) -> DataFrame:
    """Metadata columns of stored payloads: width, height, depth, colour by reading 33 bytes of each at its offset.

    With read_payloads also payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_sha256 and mean
    (of the samples), from the whole stored form read back; a payload that doesn't match its digest raises an error.
    """
    kinds = "digest string, media_bytes long, width long, height long, depth int, colour int"
    more = ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, mean double"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, rows in batch.groupby("shard", sort=False):
                fs, path = file_system(name)
                with fs.open_input_file(path) as f:
                    for digest, offset, length in zip(rows["digest"], rows["offset"], rows["length"], strict=True):
                        row = [digest, length, *png_header(f.read_at(HEADER_BYTES, offset))]
                        if read_payloads:
                            stored = f.read_at(length, offset)
                            payload = from_png(stored)
                            found = hashlib.sha256(payload).hexdigest()
                            if found != digest:
                                raise ValueError(f"{name} at {offset}: the payload has digest {found}, not {digest}")
                            mean = float(np.frombuffer(payload, np.uint8).mean())
                            row += [len(payload), found, zlib.crc32(payload[-WIDTH:]), hashlib.sha256(stored).hexdigest(), mean]
                        out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in (kinds + more * read_payloads).split(", ")])

    return index.mapInPandas(read, kinds + more * read_payloads)


def media_columns(docs: DataFrame, path: str | None = None, text: str = "text", read_payloads: bool = False) -> DataFrame:
    """docs' doc_id with n_bytes, digest, shard, offset, length and the metadata columns of the stored payload.

    One row for each row of docs, repeated and null doc_ids included; other columns of docs are ignored.
    """
    index = store_payloads(docs, path or shared_dir(docs.sparkSession, "media"), text)
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(padded(F.col(text)), 256).alias("digest"))
    # Both sides of the first join have a digest once; only the second one sees how often documents share it.
    return rows.join(index.join(read_stored(index, read_payloads), "digest"), "digest")


def read_media(shard: str, offset: int, length: int) -> bytes:
    """The payload behind one row's shard, offset and length."""
    fs, path = file_system(shard)
    with fs.open_input_file(path) as f:
        return from_png(io.BytesIO(f.read_at(length, offset)).getvalue())
