"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the one that all executors share (spark.checkpoint.dir).

    Where a session on one machine names none, as in tests, a temporary folder becomes that shared folder; on a cluster
    that is an error, as executors would not see the driver's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete tables that written() made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """df's columns by their whole names, which may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def lean_worker() -> None:
    """Let this Python worker give large arrays back to the system as soon as they are freed.

    Workers live on between tasks beside the executor's heap, and what glibc and Arrow keep for later use would count
    against the executor. Other C libraries have no such setting, and nothing changes there.
    """
    import pyarrow as pa

    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


def rest_worker() -> None:
    """Give what this worker has freed back to the system, at the end of a task that held very many small objects."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rest_executors(spark: SparkSession) -> None:
    """Let the executors' heaps shrink to what is in use, before a stage that needs the room otherwise.

    A heap that one stage has grown stays so for many minutes, as it shrinks at full collections alone, and counts beside
    the Python workers of the next. There is a task for each core, so each executor gets one where all are free; one
    that gets none just keeps its heap.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("append").save()


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder or file URI; a plain path is local."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> None:
    """Write byte strings to uri under another name first, so that a repeated task replaces the file whole."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    fs.move(draft, path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def once(value: Column) -> Column:
    """value as a generated column: computed once a row even where functions over arrays refer to it many times.

    Without this, Catalyst may write the expression into the function and compute it for every element.
    """
    return F.explode(F.array(value))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text modulo modulus; -1 for a null doc_id, which so belongs to no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine; operators take such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
