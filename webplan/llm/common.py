"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webplan.session import checkpoint_ready, shared_folder

#: UTF-8 bytes handled at once inside a task; a longer text is handled alone.
BLOCK_BYTES = 1 << 20


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared checkpoint folder: later reads never repeat its work and a
    lost executor takes nothing with it."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint()


def utf8(text: Column) -> Column:
    """Text as bytes, so that a task gets them without decoding."""
    return text.cast("string").cast("binary")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[list]:
    """Consecutive rows of a binary or string column, at most ``limit`` bytes together (or one row); null is empty."""
    if not len(column):
        return
    none = "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    total, start = np.cumsum(size), 0
    while start < len(size):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield [x or none for x in column.slice(start, stop - start).to_pylist()]
        start = stop


def row_key(docs: DataFrame) -> Column:
    """A number for a row of documents; only rows with equal doc_id and text are sure to share it."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once as Parquet to the shared folder, and read from there; see ``discard``."""
    path = f"{shared_folder(df.sparkSession)}/webplan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table from which nothing will be read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Cells of a fixed-size table that travel as one row.
CELLS = 1 << 12


def table_rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's share of a fixed-size table as rows (part, cells), for ``combined``; parts of zeros are left out."""
    parts = table.reshape(-1, CELLS)
    full = np.flatnonzero(parts.any(axis=1))
    for at in range(0, len(full), 64):
        some = full[at : at + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["part", "cells"])


def combined(rows: DataFrame, size: int, dtype, unite=np.add) -> np.ndarray:
    """All tasks' shares (``table_rows``) of a table of ``size`` cells united on the executors; the driver gets the one
    table, whose size does not depend on the input."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "cells"])
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(cells, dtype)
                if part == held:
                    total = unite(total, own)
                else:
                    if held is not None:
                        yield row()
                    held, total = part, own
        if held is not None:
            yield row()

    out = np.zeros((size // CELLS, CELLS), dtype)
    dealt = rows.repartition("part").sortWithinPartitions("part")
    for r in dealt.mapInArrow(reduce, "part int, cells binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(r["cells"], dtype)
    return out.reshape(-1)
