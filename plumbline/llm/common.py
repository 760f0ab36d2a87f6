"""What the text operators share: words, keys that keep nulls, and tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, and the words between.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without it a temporary one, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="plumbline-")
    return _own_folders[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor costs the tasks it ran, never what was computed before. The
    table stays until :func:`plumbline.sources.staging.release` or whoever owns the folder removes it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(documents: DataFrame) -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(documents["text"].cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text, in order.

    Replacing the other white space first lets the split look for a single character, which takes a
    third less time than a split by a pattern.
    """
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def null_last(column: Column) -> Column:
    """A key that is never null and sorts by code point with nulls at the end."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("z"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that added columns cannot clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def null_safe(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Equality of key columns in which null equals null."""
    condition = left[keys[0]].eqNullSafe(right[keys[0]])
    for key in keys[1:]:
        condition &= left[key].eqNullSafe(right[key])
    return condition


#: The most rows and bytes that are broadcast. A table beyond either is shuffled.
BROADCAST_ROWS = 4_000_000
BROADCAST_BYTES = 96 * 1024**2


def small(table: DataFrame, row_bytes: int | Column = 64) -> DataFrame:
    """A written table, marked for broadcast if its counted rows and bytes are within the bounds.

    ``row_bytes`` is the size of a row or an expression for it. Larger tables come back as they are, to be
    joined by a shuffle.
    """
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    seen = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(table) if seen.n <= BROADCAST_ROWS and seen.bytes <= BROADCAST_BYTES else table


def give_back() -> None:
    """Returns freed memory to the system, which the allocators of Arrow and C would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: The most rows of texts or shingles in an Arrow batch: some 4 MB each in the task's JVM and in its Python worker.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to ``BATCH_ROWS``, for texts that the default would hold by the 10,000.

    Spark reads the setting when a plan is run, and a result may be run at any time, so it stays. No result depends on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def one_by_one(
    batches: Iterator[pa.RecordBatch],
    run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
    at_end: Callable[[], None] = lambda: None,
) -> Iterator[pa.RecordBatch]:
    """What ``run`` gives for each batch. No batch is held while the next one is read.

    Python workers outlive their tasks and stay beside those of later stages, so the end of a task, after ``at_end``,
    gives its memory back.
    """
    try:
        while (batch := next(batches, None)) is not None:
            rows = run(batch)
            del batch
            yield from rows
            del rows
    finally:
        at_end()
        give_back()
