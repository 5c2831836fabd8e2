"""Streaming: watching a folder of document files, event-log folds and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, *, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Ingest new files of a folder: accepted ones are appended to out/documents, refused ones to out/refused. The
    checkpoint remembers which paths were seen, so a restart adds nothing twice; a path seen once stays seen, and a file
    that comes back under its old name needs a new one."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).load(folder).where(files.suffix_ok(F.col("path")))

    def land(batch: DataFrame, number: int) -> None:
        good, bad = files.ingest(batch)
        # A batch that is run again after a failure replaces its own part.
        good.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/refused/batch={number}")

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def latest(log: DataFrame, key: str, value: str, when: str, late: str = "10 minutes") -> DataFrame:
    """Last value of each key of a stream of events, within the lateness bound (update mode)."""
    return log.withWatermark(when, late).groupBy(key).agg(F.max_by(value, when).alias(value), F.max(when).alias(when))


def window_counts(requests: DataFrame, keys: list[str], when: str = "ts", size: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Requests of each key in fixed windows; state of a window is dropped once the watermark passes it."""
    return requests.withWatermark(when, late).groupBy(*keys, F.window(when, size)).agg(F.count("*").alias("n"))


def counters(increments: DataFrame) -> DataFrame:
    """Running totals by name (complete mode)."""
    return increments.groupBy("name").agg(F.sum("n").alias("value"))
