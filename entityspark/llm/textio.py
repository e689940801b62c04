"""Small shared helpers of the text operators: Arrow buffers, folds, scratch storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityspark.operators.components import ensure_checkpoint_dir

#: Bytes of text that one numpy step works on; bounds a Python worker's memory.
STEP_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever it contains."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` through ``run``, which keeps its columns, whatever their names contain."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_struct_array(batch.column(0)) for batch in batches)

    return docs.select(F.struct(*map(quoted, docs.columns)).alias("own")).mapInArrow(rows, docs.schema)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fixed train / held-out split."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus))


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of the tables kept since each ``scratch`` that is open.
_kept: list[list[str]] = []


def keep(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet under the shared checkpoint folder and reads it back: a compressed checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _kept:
        _kept[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(find: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Keeps the table that ``find`` returns and deletes those that it kept on the way."""

    @wraps(find)
    def run(*given: object, **options: object) -> DataFrame:
        _kept.append([])
        try:
            found = find(*given, **options)
            inner = list(_kept[-1])
            found = keep(found)
            result = [p for p in _kept[-1] if p not in inner]
        finally:
            paths = _kept.pop()
        folder = found.sparkSession._jvm.org.apache.hadoop.fs.Path
        for path in (p for p in paths if p not in result):
            folder(path).getFileSystem(found.sparkSession._jsc.hadoopConfiguration()).delete(folder(path), True)
        if _kept:
            _kept[-1] += result
        return found

    return run


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's UTF-8 bytes and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(column) else raw[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most ``limit`` bytes of text (or a single row).

    What Arrow has freed goes back to the system after each batch: a worker is used again, and would keep it.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
        del batch
        pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The rows' texts as UTF-8 bytes; null counts as empty."""
    raw, offsets = text_buffer(batch.column(batch.schema.get_field_index(name)))
    data, cuts = raw.tobytes(), offsets.tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]
