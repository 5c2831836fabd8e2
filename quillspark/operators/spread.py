"""How many tasks a shuffle gets: as many as its input needs, so that the work and memory of one do not grow with it."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input files for one task, and the most tasks.
TASK_BYTES, MOST = 4 << 20, 20_000


def parts(*frames: DataFrame, each: int = TASK_BYTES) -> int:
    """Tasks for what the frames read, at least the session's number; the session's number where sizes are not known."""
    least, total = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), 0
    for frame in frames:
        if not hasattr(frame, "_jdf"):
            return least
        leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
        total += sum(s for s in sizes if s < 1 << 60)  # a plan without statistics says 2^63
    return max(least, min(total // each, MOST))


def spread(n: int, key: str, *frames: DataFrame) -> list[DataFrame]:
    """The frames dealt by a key into n tasks, where that is more than the session's number; else as they are, for the
    session to deal. Joins and groups by the key, or by it and more, then need no other shuffle."""
    return [f.repartition(n, key) if n > int(f.sparkSession.conf.get("spark.sql.shuffle.partitions")) else f for f in frames]
