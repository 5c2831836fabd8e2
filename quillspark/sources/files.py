"""File sources and sinks: document files, page headers, ground truth, stage tables, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..kernels import image
from ..schemas import SCHEMAS, stable_id, validate

# Accepted suffixes and limits.
SUFFIXES = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".pdf"]
MOST_BYTES, MOST_PIXELS, MOST_PAGES, MOST_FILES = 50 << 20, 40_000_000, 200, 20


def suffix_ok(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(SUFFIXES)


def list_documents(spark: SparkSession, folder: str, most_bytes: int | None = None) -> DataFrame:
    """Files of a folder (not below it) with a known suffix: path, modificationTime, length, content. The size limit is
    applied to the listing, before content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).where(suffix_ok(F.col("path")))
    return files.where(F.col("length") <= most_bytes) if most_bytes is not None else files


def is_pdf(content: Column) -> Column:
    """A PDF mark within the first 1024 bytes."""
    return F.contains(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), F.lit("%PDF-"))


def clean_name(path: Column) -> Column:
    """Last part of a path with other characters than letters, digits, dot, dash and underscore replaced; null if nothing is left."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]", "_")
    return F.when(~name.rlike(r"^[._]*$"), name)


def page_headers(files: DataFrame) -> DataFrame:
    """(path, page, width, height) of every frame, without decoding; PDF pages by their page objects, sized in points."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, w, h) for p, c in zip(b["path"], b["content"], strict=True) for k, (w, h) in enumerate(image.header(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "width", "height"])

    return files.select("path", "content").mapInPandas(read, "path string, page int, width long, height long")


def checked(files: DataFrame) -> DataFrame:
    """Every file with a verdict: ok, or why it is refused. One bad file never stops the others."""
    frames = page_headers(files).groupBy("path").agg(F.count("*").cast("int").alias("pages"), F.max(F.col("width") * F.col("height")).alias("pixels"))
    joined = files.select("path", "length", is_pdf(F.col("content")).alias("pdf")).join(frames, "path", "left")
    why = (
        F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large").when(F.col("pages") > MOST_PAGES, "too many pages")
        .when(F.col("pixels") > MOST_PIXELS, "too many pixels").when(F.col("pages").isNull() & ~F.col("pdf"), "unreadable").otherwise("ok")
    )
    return joined.select("path", "length", "pdf", F.coalesce("pages", F.lit(0)).alias("pages"), why.alias("verdict"))


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document rows of accepted files with status uploaded, refused files with the reason). Ids derive from path and
    size, so a rerun gives the same rows."""
    seen = checked(files)
    good = seen.where("verdict = 'ok'")
    rows = good.select(
        stable_id("path", "length").alias("id"), F.substring(F.coalesce(clean_name(F.col("path")), F.lit("document")), 1, 512).alias("filename"), F.current_timestamp().alias("upload_time"),
        F.lit("uploaded").alias("status"), F.col("path").alias("raw_image_path"), F.lit(None).cast("string").alias("processed_image_path"), F.lit(None).cast("string").alias("error_message"),
    )
    return rows, seen.where("verdict <> 'ok'")


def page_rasters(files: DataFrame, kernel, schema: str) -> DataFrame:
    """Rows that a kernel (path, raster) -> rows makes of PNG pages, one raster in memory at a time; files it cannot
    decode give no rows here (checked() names them)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                if bytes(c[:8]) == b"\x89PNG\r\n\x1a\n":
                    yield pd.DataFrame(kernel(p, image.read_png(bytes(c))), columns=names)

    return files.select("path", "content").mapInPandas(read, schema)


def component_table(files: DataFrame) -> DataFrame:
    rows = lambda path, raster: [(path, i, c["x"], c["y"], c["w"], c["h"], c["area"], c["cx"], c["cy"]) for i, c in enumerate(image.components(raster))]
    return page_rasters(files, rows, "page_id string, comp_id int, x int, y int, w int, h int, area int, cx double, cy double")


def box_table(files: DataFrame) -> DataFrame:
    rows = lambda path, raster: [(path, i, *box) for i, box in enumerate(image.region_boxes(raster))]
    return page_rasters(files, rows, "page_id string, box_id long, x int, y int, w int, h int")


def processed_pages(files: DataFrame, steps: list[str]) -> DataFrame:
    """(path, quality, content): pages after the named steps, as PNG."""

    def rows(path, raster):
        out, score = image.preprocess(raster, steps)
        return [(path, score, image.write_png(out))]

    return page_rasters(files, rows, "path string, quality double, content binary")


def ground_truth(spark: SparkSession, path: str, many_files: bool = False) -> DataFrame:
    """Labelled examples: one JSON array, or one JSON object a file. Null regions (not labelled) stay apart from none."""
    schema = StructType([*SCHEMAS["ground_truth"].fields, StructField("_corrupt_record", StringType())]) if many_files else SCHEMAS["ground_truth"]
    return spark.read.schema(schema).option("multiLine", True).json(path)


def drop_in(examples: DataFrame, images: DataFrame, most_pages: int = MOST_PAGES) -> dict[str, DataFrame]:
    """done, todo and unlabelled of a folder of examples and images (image, pages), and every problem found."""
    bad = [
        examples.where(F.col("id").isNull()).select(F.lit(None).cast("string").alias("id"), F.lit("unreadable or without id").alias("problem")),
        examples.groupBy("id").count().where("count > 1 AND id IS NOT NULL").select("id", F.lit("repeated id").alias("problem")),
        examples.where(~F.col("status").isin("done", "todo")).select("id", F.lit("unknown status").alias("problem")),
        examples.join(images, "image", "left_anti").where("id IS NOT NULL").select("id", F.lit("no such image").alias("problem")),
        examples.join(images, "image").where((F.col("page") > F.col("pages")) | (F.col("page") > most_pages)).select("id", F.lit("no such page").alias("problem")),
    ]
    problems = bad[0]
    for b in bad[1:]:
        problems = problems.unionByName(b)
    return {"done": examples.where("status = 'done'"), "todo": examples.where("status = 'todo'"), "unlabelled": images.join(examples, "image", "left_anti"), "problems": problems}


def stubs(examples: DataFrame, images: DataFrame, most_pages: int = MOST_PAGES) -> tuple[DataFrame, DataFrame]:
    """(an empty example for each page without one, skipped images with the reason). Never replaces an example."""
    skipped = images.where((F.col("pages") > most_pages) | F.col("pages").isNull()).select("image", F.when(F.col("pages").isNull(), "unreadable").otherwise("too many pages").alias("reason"))
    pages = images.where(F.col("pages").between(1, most_pages)).select("image", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    due = pages.join(examples.select("image", F.coalesce("page", F.lit(1)).alias("page")), ["image", "page"], "left_anti")
    base = F.lower(F.regexp_replace(F.regexp_replace("image", r"\.[^.]+$", ""), r"[^A-Za-z0-9]+", "-"))
    return due.select(F.concat_ws("-p", base, "page").alias("id"), "image", F.lit("todo").alias("status"), F.lit("").alias("text"), "page"), skipped


def unique_ids(wanted: DataFrame, taken: DataFrame, column: str, order: str) -> DataFrame:
    """Appends base, base-2, … where a base repeats or is taken. Numbers that are taken themselves are passed over."""
    used = taken.select(F.col(column).alias("t")).distinct()
    numbered = used.select(F.regexp_extract("t", r"^(.*?)(?:-(\d+))?$", 1).alias("base"), F.coalesce(F.nullif(F.regexp_extract("t", r"^(.*?)(?:-(\d+))?$", 2), F.lit("")).try_cast("int"), F.lit(1)).alias("k"))
    busy = numbered.groupBy("base").agg(F.collect_set("k").alias("busy"))
    turn = F.row_number().over(Window.partitionBy(column).orderBy(order))
    free = F.filter(F.sequence(F.lit(1), F.col("turn") + F.size("busy")), lambda k: ~F.array_contains("busy", k))
    rows = wanted.withColumn("turn", turn).join(busy, F.col(column) == F.col("base"), "left").withColumn("busy", F.coalesce("busy", F.array().cast("array<int>")))
    number = F.element_at(free, F.col("turn"))
    return rows.withColumn("unique_id", F.when(number == 1, F.col(column)).otherwise(F.concat_ws("-", column, number))).drop("turn", "busy", "base")


def write_stage(frame: DataFrame, table: str, path: str, partition: str | None = None, sort: str | None = None) -> DataFrame:
    """Append the good rows of a stage to its table, partitioned and sorted within files so that ranges skip row groups;
    returns the rejected rows."""
    good, bad = validate(table, frame)
    if sort:
        good = good.sortWithinPartitions(sort)
    writer = good.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return bad


def error_rows(failures: DataFrame) -> DataFrame:
    """Dead letters: status error and the message, cut to the column's length."""
    return failures.select("id", F.lit("error").alias("status"), F.substring("message", 1, 4000).alias("error_message"))
