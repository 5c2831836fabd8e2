"""Shared plumbing of the training-data operators: staged tables, label folds and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text a kernel looks at in one go, so that its arrays stay in the cache; longer documents are taken one at a time.
CHUNK_BYTES = 1 << 17
#: Bytes of an Arrow batch, at most (or one row): a worker's memory does not follow the length of its rows.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    folder that goes with the process; on a cluster it must be set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        conf = "file://" + made
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete every table that this application staged: call it once the results are written. Frames that an operator
    returned read staged tables until then."""
    _delete(spark, f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from files, not from lineage."""
    path = stage_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        _delete(spark, df._staged_at)


def fold(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_of(docs: DataFrame) -> F.Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches of this session, unless it has a lower bound already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_HELD: dict[tuple, object] = {}


def held(kind: str, key: tuple, make: Callable[[], object]):
    """What a worker keeps from task to task, such as tables of token ids: made when first asked for."""
    if (kind, *key) not in _HELD:
        _HELD[kind, *key] = make()
    return _HELD[kind, *key]


def drop_held(but: str | None = None) -> None:
    """Workers are used again by later tasks: a task frees what tasks of other kinds kept, and gives free memory back."""
    for key in [key for key in _HELD if key[0] != but]:
        del _HELD[key]
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, holds: str | None = None) -> DataFrame:
    """mapInArrow with a kernel from one record batch to one record batch (or None for no rows). `holds` is the kind of
    what the kernel asks `held` for."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held(holds)
        for batch in batches:
            if batch.num_rows and (out := kernel(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
