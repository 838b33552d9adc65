"""Where the operators of this package put what must survive a lost executor.

A long lineage is cut by writing a table below ``spark.checkpoint.dir``, which
every executor and the driver share.  The setting is read from the session.  Where
it is unset, a local session gets a folder of its own; on a cluster, whose machines
share no local folder, that is an error.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: UTF-8 bytes that one numpy pass looks at; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 18
#: Rows of texts in an Arrow batch.
TEXT_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The URI of the folder that all machines share."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seekframe-")
        context.setCheckpointDir(root)
    return root


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def text_batches(spark: SparkSession) -> None:
    """Rows with whole texts go to Python in smaller batches than Spark's default of 10,000.

    A batch is held by the executor and by its worker at once; texts have kilobytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.seekframe_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``materialise`` that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, [table.seekframe_path])


def mark() -> int:
    """Where the list of tables stands now; for ``clean``."""
    return len(_made)


def clean(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Deletes the tables that operators of this driver have made in the shared folder since ``mark``, and says how many.

    To be called once the results that read them are written; the table ``keep`` stays.
    """
    spared = keep.seekframe_path if keep is not None else None
    gone = [path for path in _made[since:] if path != spared]
    _delete(spark, gone)
    return len(gone)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        _made.remove(path)


def utf8_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first, end, bytes, offsets): about ``limit`` bytes each, a null being empty.

    ``offsets`` has one entry more than the run has rows and starts at zero.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that only a cut lineage still named."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns freed memory to the system: workers are reused, and keep what they once had otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a partition, after which the worker gives its memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied
