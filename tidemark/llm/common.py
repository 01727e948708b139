"""Small helpers shared by the operators: reading tables, naming, reliable checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: UTF-8 bytes of text that one vectorised step works on; a longer document makes a step of its own. A step's arrays take some
#: eighty times as much, in each of an executor's Python workers; steps four times as long are no faster.
STEP_BYTES = 500_000
#: Bits that ``with_maybe`` broadcasts, 16 MB, in rows of 4 KB.
MARK_BITS, MARK_ROW = 1 << 27, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and the master is
    local (tests)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet under a fresh name in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, df: DataFrame) -> int:
    """Shuffle partitions that the session asks for; operators never choose fewer."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_maybe(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with one more column, and its name: false only where the number ``key`` is none of those in the column of
    that name of ``keys``. It lets a join leave most rows where they are and shuffle those that it may concern.

    What is broadcast is one bit for each of MARK_BITS hashes, whatever the number of keys; with very many keys most bits
    are set and most rows pass, none wrongly held back. A null ``key`` may be either.
    """
    name = "_maybe"
    while name in df.columns:
        name += "_"
    bit = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(MARK_BITS))
    marks = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias(f"{name}at")).agg(F.bitmap_construct_agg(F.col("bit") % MARK_ROW).alias(f"{name}marks"))
    byte = F.substring(F.col(f"{name}marks"), F.shiftright(bit % MARK_ROW, 3).cast("int") + 1, F.lit(1))
    found = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (bit % 8).cast("int")) == 1
    joined = df.join(F.broadcast(marks), F.shiftright(bit, 15) == F.col(f"{name}at"), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(found, F.lit(False)).alias(name)), name


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns; whatever else the table carries, clashing names included, is left out."""
    return df.select(*[F.col(c) for c in columns])


def in_steps(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows of about ``size`` bytes of text, so that memory doesn't follow the batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i in range(n):
            if total and total + lengths[i] > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(lengths[i])
        yield batch.slice(start, n - start)


def give_back() -> None:
    """Returns to the system what this process has freed. Python workers outlive their tasks, and what they keep counts
    against their executor in every later stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def map_steps(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str, text: str = "text", setup: Callable | None = None, size: int = STEP_BYTES
) -> DataFrame:
    """mapInArrow over steps of about ``size`` bytes. ``setup()`` runs once in each task; its result is passed on to ``work``.
    A task that has read all its rows leaves its worker no more memory than it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for step in in_steps(batches, text, size):
            out = work(step, state) if setup else work(step)
            if out is not None and out.num_rows:
                yield out
            step = out = None
        give_back()

    return df.mapInArrow(run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
