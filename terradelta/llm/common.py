"""What the operators of this subpackage share: reading tables, cutting lineage, batches of UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import new_path
from . import bytewords

#: Bytes of text and rows that a task works on at once; one longer document is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 2048

#: What forgets things that a worker keeps between the tasks of one operator.
HELD: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df once to the shared folder (to `path` if given) and read it again: lost executors cost no recomputation, and lineage ends here."""
    path = path or new_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes its shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a number for each row, in order of doc_id: the doc_id itself where these are different whole numbers; else rows are numbered by doc_id (null first) and a hash of the text."""
    plain = docs.select("doc_id")
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and plain.where("doc_id is null").isEmpty() and plain.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return cut(ordered.withColumn(key, F.monotonically_increasing_id()))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins (one more entry for the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    n, first = len(column), column.offset
    if ends is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[first : first + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def utf8_lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of the text in lower case, letters of all scripts."""
    return utf8(pc.utf8_lower(column))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text and at most `rows` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = min(a + rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1))
            yield batch.slice(a, b - a)
            a = b


def release() -> None:
    """Give back what this worker holds beyond its libraries: a reused worker starts small, whatever operator it served."""
    for forget in HELD:
        forget()
    bytewords.release()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | dict | Iterator], schema: str, text: str = "text", limit: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with batches of bounded bytes and rows; work returns a batch, or columns, or several of them."""

    def made(out):
        return out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    def run(batches):
        release()
        try:
            for batch in slices(batches, text, limit, rows):
                out = work(batch)
                if isinstance(out, pa.RecordBatch | dict):
                    yield made(out)
                else:
                    yield from map(made, out)
        finally:
            release()

    return df.mapInArrow(run, schema)
