"""Shared folders, written cuts and file access for the corpus operators.

Executors share nothing with the driver but the inputs, the warehouse and the folder named by
``spark.checkpoint.dir``. Everything an operator hands from one job to the next lies there.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections import OrderedDict
from collections.abc import Callable
from contextlib import contextmanager
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A worker holds at most so many files open, and so many bytes of them mapped or read.
MOST_OPEN, MOST_BYTES = 192, 64 << 20

_OPEN: OrderedDict[str, tuple[object, int]] = OrderedDict()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without it a folder of the warehouse, which executors share too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def fresh(spark: SparkSession, name: str) -> str:
    """A path that no other call uses, below the shared folder."""
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    The result has no lineage but the files, so lost executors cost no recomputation, and every
    later read sees the same rows.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """`name`, or with underscores behind it, so that `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spare_prefix(df: DataFrame, prefix: str) -> str:
    """`prefix`, or with underscores behind it, so that no column of `df` begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix


def file_rows() -> list[Column]:
    """What tells the rows of a table that is read from files apart, the same at each reading."""
    return [F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")]


def keyed(docs: DataFrame, row_key: list[Column] | None) -> tuple[DataFrame, list[str]]:
    """`docs` with further columns, whose names come second, that tell its rows apart at every reading.

    They are `row_key` (see `file_rows`); without it, the rows are numbered in a copy that is written first.
    """
    if row_key is None:
        name = spare(docs, "row")
        return cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), [name]
    names = [spare(docs, f"row{k}") for k in range(len(row_key))]
    return docs.select("*", *[c.alias(n) for c, n in zip(row_key, names, strict=True)]), names


def make_dirs(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jpath)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a `cut` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quarry/" in path:
            remove(df.sparkSession, path)


def _local(uri: str) -> str | None:
    """The path on a mounted file system, or None for a store that only a client reaches."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


@contextmanager
def writing(uri: str):
    """A binary file that appears under `uri` whole or not at all, also if a task runs twice."""
    path = _local(uri)
    if path is not None:
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "wb") as f:
            yield f
        os.replace(part, path)
    else:
        from pyarrow import fs

        store, key = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(f"{key}.{uuid.uuid4().hex}.tmp") as f:
            yield f
            part = f
        store.move(part.name, key)


def mapped(uri: str):
    """A pyarrow buffer over the whole file: memory-mapped where the folder is mounted."""
    path = _local(uri)
    if path is not None:
        return pa.memory_map(path, "r").read_buffer()
    from pyarrow import fs

    store, key = fs.FileSystem.from_uri(uri)
    with store.open_input_file(key) as f:
        return f.read_buffer()


def opened(uri: str, parse: Callable):
    """What `parse` makes of the file's buffer, or None if there is no such file; any other error fails the task.

    The files used last stay open, so that a worker's mappings and memory do not grow with the corpus.
    """
    if uri in _OPEN:
        _OPEN.move_to_end(uri)
        return _OPEN[uri][0]
    try:
        buffer = mapped(uri)
    except FileNotFoundError:
        return None
    _OPEN[uri] = parse(buffer), buffer.size
    while len(_OPEN) > 1 and (len(_OPEN) > MOST_OPEN or sum(n for _, n in _OPEN.values()) > MOST_BYTES):
        _OPEN.popitem(last=False)
    return _OPEN[uri][0]


def release() -> None:
    """Close the files kept open, and give the memory that this worker has freed back to the machine.

    A worker serves stage after stage. What the allocators keep of a former one counts as its memory, beside what the next one takes.
    """
    _OPEN.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def target_partitions(rows: int, per_partition: int, least: int = 1) -> int:
    """Partitions that hold about `per_partition` rows each."""
    return max(least, -(-rows // per_partition))
