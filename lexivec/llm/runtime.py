"""Where intermediate tables live, and the few session settings the operators rely on."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.workers import ship

#: Rows and bytes handed to Python at a time, the same for every operator: what one plan sets holds for plans built before it too.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20
#: What a table may take when it is broadcast, as counted rows by the bytes of one; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Short rows (a few numbers each) that go to one file.
ROWS_A_FILE = 100_000

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local session may go without it; it then gets a folder of its own.
    """
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="lexivec-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage; what was written outlives the executor that wrote it. Later readers
    all see the same rows, whatever the plan above would give a second time. Where a bound on its (short) rows is known, they
    are gathered into one file for each ``ROWS_A_FILE``.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.__dict__["_lexivec_path"] = path
    return read


def scratch(spark: SparkSession) -> str:
    """This application's own folder within the shared one."""
    return f"{shared_dir(spark)}/lexivec-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``durable`` wrote and nothing to come reads."""
    for table in tables:
        if path := table.__dict__.get("_lexivec_path"):
            remove(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all that ``durable`` wrote in this application. For callers that have written the results they want to keep."""
    remove(spark, scratch(spark))


def sent(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df`` marked for broadcast if its rows, as counted, of ``width`` bytes each stay within ``BROADCAST_BYTES``."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def short_batches(spark: SparkSession) -> None:
    """Make the Python workers ready: the library is there, and one Arrow batch of texts takes a bounded share of memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which a worker gives back the memory it no longer uses: workers live on, and several stages' leavings add up."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined until they have so many rows or bytes, for work with a cost per call."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def full_text(column: str = "text"):
    """The whole text; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hash_bound(wanted: int, rows: int) -> int:
    """A bound on 64-bit hashes that about four times the wanted rows keep (all, if there are no more).

    The least hashes lie under it, so a task need not send its own least ones where they can't be among them.
    """
    share = min(1.0, 4 * wanted / max(1, rows))
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
