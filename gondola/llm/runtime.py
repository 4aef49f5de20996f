"""What the operators share: the shared folder, written tables and files, text as bytes.

Whatever an operator writes there lies in one folder of the application. Tables
that nothing reads any more are deleted at once where that is known; what lazy
results may still read goes when the application ends (:func:`clear`).
"""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None
_OWN: dict[str, str] = {}
_USED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local master (tests) gets a new temporary
    folder; on a cluster that folder would not be shared, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-gondola-")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder in the shared one."""
    top = f"{shared_dir(spark)}/gondola-{spark.sparkContext.applicationId}"
    if not _USED:
        atexit.register(clear)
    _USED.add(top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def clear() -> None:
    """Delete the folders of this process's applications; run when it ends."""
    while _USED:
        system, inner = fs.FileSystem.from_uri(_USED.pop())
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)


def store_table(path: str, table: pa.Table) -> None:
    """An Arrow file in the shared folder, written by a task."""
    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner) as sink, ipc.new_file(sink, table.schema, options=ipc.IpcWriteOptions(compression="zstd")) as f:
        f.write_table(table)


def open_table(path: str) -> pa.Table:
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner) as f:
        return ipc.open_file(pa.BufferReader(f.read())).read_all()


def release() -> None:
    """Give freed memory of this Python worker back: workers are used again by later
    stages, beside the JVM in one executor's memory."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with :func:`release` when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def spread(paths: DataFrame, each: int = 16) -> DataFrame:
    """Rows that name files, dealt to tasks of ``each`` files or so, but to several
    tasks a core where there are few."""
    n = paths.count()
    cores = paths.sparkSession.sparkContext.defaultParallelism
    return paths.repartition(max(1, -(-n // each), min(n, 4 * cores)))


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a written table: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gondola_path = path
    return out


def drop_written(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_gondola_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _word_table() -> bytes:
    """Bytes 0-9, a-z and 0x80 up stand; A-Z become lower case; the rest spaces."""
    return bytes(
        c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
        for c in range(256)
    )


#: For bytes.translate: leaves words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the
#: text with A-Z lower-cased, apart by spaces.
WORDS = _word_table()



def tokens(text: bytes | None, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text (null: none), a list for each ``piece`` bytes or so."""
    line, at = (text or b"").translate(WORDS), 0
    while at < len(line):
        end = line.find(b" ", at + piece) if len(line) - at > piece else -1
        end = end if end >= 0 else len(line)
        yield line[at:end].split()
        at = end


#: For bytes.translate: A-Z lower-cased, nothing else changed.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
