"""Pipeline control as set operations: what is left to do, orphans, rate windows, denylist, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def todo(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without persisted output; a rerun appends only these."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def resume(wanted: DataFrame, done: DataFrame | None, keys: list[str], force: bool = False) -> DataFrame:
    """todo(), or everything where force is set or nothing was written yet."""
    return wanted if force or done is None else todo(wanted, done, keys)


def orphans(documents: DataFrame, now: str | Column, minutes: int = 2) -> DataFrame:
    """Documents that wait in a start state longer than some minutes."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return documents.where(F.col("status").isin("uploaded", "enqueue_failed") & (F.col("upload_time").cast("timestamp") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES")))


def arrivals(listings: DataFrame, scan: str = "scan", path: str = "path") -> DataFrame:
    """The (scan, path) rows of a watched folder's listings that are to be taken: what the scan before did not list. Names
    that vanish are forgotten, so a file that comes back is taken again."""
    rows = listings.select(scan, path).distinct()
    before = F.lag(scan).over(Window.partitionBy(path).orderBy(scan))
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") < F.col(scan) - 1)).drop("before")


def reprocess(documents: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    """documents with status `uploaded` and no error for the ids that are asked for; what is persisted of them stays, so a
    run does what is left to do unless it is told to do all again."""
    asked = ids.select(key).distinct().withColumn("asked", F.lit(True))
    joined = documents.join(asked, key, "left")
    error = [F.when(F.col("asked").isNull(), F.col("error")).alias("error")] if "error" in documents.columns else []
    rest = [c for c in documents.columns if c not in ("status", "error")]
    return joined.select(*rest, F.when(F.col("asked").isNotNull(), "uploaded").otherwise(F.col("status")).alias("status"), *error)


def stage_status(progress: DataFrame) -> DataFrame:
    """progress with `status`, the place of each document in the pipeline. It has pages, prepared, recognised, failed and extracted
    (numbers of pages), indexed (boolean) and flags (a number): uploaded, preprocessing, ocr_running, extracting, ocr_done or
    ocr_partial, then needs_review or ready once indexed."""
    c = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0))
    status = (
        F.when(F.coalesce(F.col("indexed"), F.lit(False)), F.when(c("flags") > 0, "needs_review").otherwise("ready"))
        .when((c("prepared") == 0) | (c("pages") == 0), "uploaded")
        .when(c("prepared") < c("pages"), "preprocessing")
        .when(c("recognised") + c("failed") < c("pages"), "ocr_running")
        .when(c("extracted") < c("recognised"), "extracting")
        .otherwise(F.when(c("failed") > 0, "ocr_partial").otherwise("ocr_done"))
    )
    return progress.withColumn("status", status)


def typed_words(words: DataFrame, text: str = "text", conf: str = "conf") -> DataFrame:
    """The words of a recogniser's table that count: text that is not blank, and a confidence that is a number and not negative."""
    value = F.col(conf).cast("string").try_cast("double")
    return words.withColumn(conf, value).where((F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0) & F.col(conf).isNotNull() & (F.col(conf) >= 0) & ~F.isnan(conf))


def parse_rate(rate: str) -> tuple[int, int]:
    """"60/minute" as (60, 60 seconds)."""
    count, _, unit = rate.partition("/")
    return int(count), {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]


def rate_limited(requests: DataFrame, rate: str, keys: list[str], when: str = "ts", tie: str = "event_id", rounded: bool = False) -> DataFrame:
    """Requests with their fixed window, running number in it, and whether they are within the limit. A request counts in
    the window of its second; `rounded` does as SQL over whole numbers: the nearest second (the even one at a half), divided towards 0."""
    most, size = parse_rate(rate)
    at = F.col(when).cast("timestamp")
    if rounded:
        seconds = F.rint(F.unix_micros(at) / 1e6).cast("long")
        number = (seconds - seconds % size) / size
    else:
        number = F.floor(F.unix_timestamp(at) / size)
    windowed = requests.withColumn("window_no", number.cast("long"))
    running = F.row_number().over(Window.partitionBy(*keys, "window_no").orderBy(when, tie)).cast("long")
    return windowed.withColumn("number", running).withColumn("allowed", F.col("number") <= most)


def client_ip(peer: Column, forwarded: Column, trusted: list[str]) -> Column:
    """The last forwarded hop where the peer is a trusted proxy and there is one; else the peer."""
    last = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.when(peer.isin(trusted) & (F.length(last) > 0), last).otherwise(peer)


def active_denials(denied: DataFrame, now: Column) -> DataFrame:
    """Entries whose time has not run out; the latest expiry of an entry counts."""
    return denied.groupBy("signature").agg(F.max("expires_at").alias("expires_at")).where(F.col("expires_at") > now)


def allowed(sessions: DataFrame, denied: DataFrame, now: Column) -> DataFrame:
    return sessions.join(active_denials(denied, now).select("signature"), "signature", "left_anti")


def counters(increments: DataFrame) -> DataFrame:
    return increments.groupBy("name").agg(F.sum("n").cast("long").alias("value"))


def numbered(frame: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """frame with `number`: 1, 2, … in the order of a unique key, without one task for all rows. Rows are dealt by approximate
    quantiles of the key; a row's number is its place among the rows between two of them, plus the rows below. The quantiles are
    constants of the plan, so it does not matter how often or in how many partitions a branch is computed."""
    shares = [k / parts for k in range(1, parts)]
    bounds = frame.agg(F.percentile_approx(key, shares)).first()[0] or []
    part = sum((F.when(F.col(key) > b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    dealt = frame.withColumn("part", part)
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a part
    local = F.row_number().over(Window.partitionBy("part").orderBy(key))
    return dealt.withColumn("local", local).join(F.broadcast(before), "part").withColumn("number", (F.col("local") + F.col("before")).cast("long")).drop("part", "local", "before")
