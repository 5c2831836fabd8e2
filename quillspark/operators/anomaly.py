"""Anomaly detectors: each turns rows into flags with structured columns; explanations are derived last."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.text import alnum_ratio
from ..kernels.names import indel_pairs

# Default thresholds.
LOW_CONFIDENCE, ILLEGIBLE, LEAST_ALNUM, FIRST_YEAR, LAST_YEAR, LARGEST_AMOUNT, NAME_SIMILARITY = 60.0, 15.0, 0.4, 1000, 2100, 1_000_000, 0.75
EXPECTED_ENTITY = {"table": "amount", "signature": "person"}

FLAG_COLUMNS = ["flag_type", "severity", "page_id", "region_id", "raw_text", "measured", "threshold"]


def severity_of_gap(measured: Column, threshold: float) -> Column:
    gap = F.lit(threshold) - measured
    return F.when(gap >= 0.6 * threshold, "high").when(gap >= 0.3 * threshold, "medium").otherwise("low")


def confidence_level(value: Column) -> Column:
    return F.when(value < 0.55, "low").when(value < 0.82, "medium").otherwise("high")


def _flag(frame: DataFrame, kind: str, severity: Column | str, raw_text: Column, measured: Column, threshold: Column | float | None) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    region = F.col("region_id") if "region_id" in frame.columns else F.lit(None).cast("string")
    return frame.select(
        F.lit(kind).alias("flag_type"), severity.alias("severity"), F.col("page_id"), region.alias("region_id"), raw_text.cast("string").alias("raw_text"),
        measured.cast("double").alias("measured"), F.lit(threshold).cast("double").alias("threshold"),  # lit() passes a column through
    )


def illegible(ocr: DataFrame, least_confidence: float = ILLEGIBLE, least_alnum: float = LEAST_ALNUM) -> DataFrame:
    """Regions whose confidence is very low, or else whose text is mostly symbols."""
    ratio = alnum_ratio(F.coalesce(F.col("text"), F.lit("")))
    low = F.col("ocr_confidence") < least_confidence
    found = ocr.where(low | (ratio < least_alnum))
    return _flag(found, "illegible", "high", F.col("text"), F.when(low, F.col("ocr_confidence")).otherwise(ratio), F.when(low, least_confidence).otherwise(least_alnum))


def _is_illegible() -> Column:
    return (F.col("ocr_confidence") < ILLEGIBLE) | (alnum_ratio(F.coalesce(F.col("text"), F.lit(""))) < LEAST_ALNUM)


def low_confidence(ocr: DataFrame, words: DataFrame | None = None, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """One flag for a region below the threshold; else one for each of its words below it. Illegible regions are left
    to their own detector."""
    legible = ocr.where(~_is_illegible())
    regions = _flag(legible.where(F.col("ocr_confidence") < threshold), "low_ocr_confidence", severity_of_gap(F.col("ocr_confidence"), threshold), F.col("text"), F.col("ocr_confidence"), threshold)
    if words is None:
        return regions
    low = words.where(F.col("conf") < threshold).withColumnRenamed("text", "word").drop("page_id")
    low = low.join(legible.where(F.col("ocr_confidence") >= threshold).select("region_id", "page_id"), "region_id")
    return regions.union(_flag(low, "low_ocr_confidence", severity_of_gap(F.col("conf"), threshold), F.col("word"), F.col("conf"), threshold))


def implausible_dates(entities: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    year = F.year(F.to_date(F.try_to_timestamp(F.substring("normalized_value", 1, 10), F.lit("yyyy-MM-dd"))))
    return _flag(entities.where((F.col("entity_type") == "date") & ~year.between(first, last)), "entity_conflict", "medium", F.col("raw_text"), year, None)


def implausible_amounts(entities: DataFrame, most: float = LARGEST_AMOUNT) -> DataFrame:
    value = F.expr(r"try_cast(nullif(regexp_extract(normalized_value, '-?[0-9]+(?:\\.[0-9]+)?', 0), '') AS double)")
    return _flag(entities.where((F.col("entity_type") == "amount") & (F.abs(value) > most)), "entity_conflict", "medium", F.col("raw_text"), value, most)


#: Names of a block, and pairs of a task: two blocks of a group meet as one unit of work, units are dealt out.
NAME_BLOCK, TASK_PAIRS = 1_024, 4_000_000


def _names(people: DataFrame, group: str) -> DataFrame:
    return people.select(group, F.trim("raw_text").alias("name")).where(F.length("name") > 0).distinct()


def name_units(names: DataFrame, group: str) -> DataFrame:
    """(group, same, left, right): blocks of names of which every name on the left meets every one on the right (where
    `same`, the names of the left one another). The units of a large group lie in many tasks, as many as its pairs need."""
    counts = names.groupBy(group).agg(F.count("*").alias("_n"))
    pairs = counts.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0.0
    parts = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(pairs / TASK_PAIRS), 20_000))
    blocked = names.join(counts, group).withColumn("_blocks", F.ceil(F.col("_n") / NAME_BLOCK)).withColumn("_block", F.pmod(F.xxhash64("name"), F.col("_blocks")))
    dealt = blocked.select(group, "name", "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other"))
    dealt = dealt.select(group, F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), "name", (F.col("_block") <= F.col("_other")).alias("_left"))
    units = dealt.repartition(parts, group, "_i", "_j").groupBy(group, "_i", "_j").agg(F.collect_list(F.when(F.col("_left"), F.col("name"))).alias("left"), F.collect_list(F.when(~F.col("_left"), F.col("name"))).alias("right"))
    return units.select(group, (F.col("_i") == F.col("_j")).alias("same"), "left", "right")


def _near(a: Column, b: Column) -> Column:
    return 2 * F.least(F.length(a), F.length(b)) >= NAME_SIMILARITY * (F.length(a) + F.length(b))


def _pairs_of(names: DataFrame, group: str) -> DataFrame:
    units = name_units(names, group).select(group, "same", F.explode("left").alias("x"), F.when(F.col("same"), F.col("left")).otherwise(F.col("right")).alias("others"))
    met = units.select(group, "same", "x", F.explode("others").alias("y")).where(~F.col("same") | (F.col("x") < F.col("y")))
    return met.where(_near(F.col("x"), F.col("y"))).select(group, F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))


def name_pairs(people: DataFrame, group: str = "page_id") -> DataFrame:
    """Unordered pairs of different names within a group; names are trimmed and made distinct first. Similarity of 0.75
    bounds how far the lengths may lie apart."""
    return _pairs_of(_names(people, group), group)


def inconsistent_names(people: DataFrame, similarity: Column, group: str = "page_id", least: float = NAME_SIMILARITY) -> DataFrame:
    """Pairs of similar but different names; `similarity` reads name_a and name_b."""
    return name_pairs(people, group).withColumn("similarity", similarity).where(F.col("similarity") >= least)


def inconsistent_names_by_edits(people: DataFrame, group: str = "page_id", least: float = NAME_SIMILARITY) -> DataFrame:
    """inconsistent_names() for 1 - edits / the longer length. Names that so few characters allow one edit at most are
    not met in all pairs: two of them at one edit share what is left of each, whole or without one character."""
    length = F.length("name")
    # Edits that the longest partner of a name would still allow.
    names = _names(people, group).withColumn("_most", F.floor((1 - least) * F.floor(length / least + 1e-9) + 1e-9))
    cut = F.transform(F.sequence(F.lit(1), length), lambda i: F.concat(F.substring("name", F.lit(1), i - 1), F.substring(F.col("name"), i + 1, length)))
    parts = names.where("_most >= 1").select(group, "name", F.explode(F.array_distinct(F.concat(F.array("name"), cut))).alias("_part"))
    met = parts.where(F.col(group).isNotNull()).groupBy(group, "_part").agg(F.collect_list("name").alias("_names")).where(F.size("_names") > 1)
    met = met.select(group, "_names", F.explode("_names").alias("name_a")).select(group, "name_a", F.explode("_names").alias("name_b")).where("name_a < name_b")
    pairs = met.where(_near(F.col("name_a"), F.col("name_b"))).union(_pairs_of(names.where("_most >= 2").select(group, "name"), group))
    like = 1 - F.levenshtein("name_a", "name_b") / F.greatest(F.length("name_a"), F.length("name_b"))
    return pairs.withColumn("similarity", like).where(F.col("similarity") >= least).distinct()


def inconsistent_names_by_subsequence(people: DataFrame, group: str = "page_id", least: float = NAME_SIMILARITY) -> DataFrame:
    """inconsistent_names() for the indel ratio. Workers get blocks of names, not pairs, and return the pairs that count."""
    names = _names(people, group)
    schema = StructType([names.schema[group], StructField("name_a", StringType()), StructField("name_b", StringType()), StructField("similarity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, a, b, score in indel_pairs(batch, least, NAME_SIMILARITY):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keys), a, b, score], schema.names)

    return name_units(names, group).mapInArrow(run, schema)


def missing_entities(regions: DataFrame, entities: DataFrame, expected: dict[str, str] = EXPECTED_ENTITY) -> DataFrame:
    """Regions of a type that should hold an entity of some type, but do not."""
    wanted = F.create_map(*(F.lit(x) for pair in expected.items() for x in pair))
    due = regions.where(F.col("region_type").isin(list(expected))).withColumn("entity_type", wanted[F.col("region_type")])
    return _flag(due.join(entities.select("region_id", "entity_type"), ["region_id", "entity_type"], "left_anti"), "extraction_failure", "medium", F.col("entity_type"), F.lit(None), None)


def empty_layout(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Pages without a region; run again, it gives the same rows."""
    return _flag(pages.join(regions.select("page_id"), "page_id", "left_anti"), "extraction_failure", "high", F.lit(None), F.lit(None), None)


def all_flags(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def explain(flags: DataFrame) -> DataFrame:
    """Adds the sentence that a reviewer reads."""
    text = (
        F.when(F.col("flag_type") == "low_ocr_confidence", F.format_string("recognised with confidence %.0f, below %.0f", "measured", "threshold"))
        .when(F.col("flag_type") == "illegible", F.lit("text cannot be read"))
        .when(F.col("flag_type") == "entity_conflict", F.format_string("implausible value %s", "raw_text"))
        .otherwise(F.lit("an expected part of the page is missing"))
    )
    return flags.withColumn("explanation", text)


def resolve_entities(flags: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Each flag takes the first unused entity with the same keys, in id order; flags without a partner keep null."""
    f = flags.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("flag_id")))
    e = entities.select(*keys, "entity_id").withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("entity_id")))
    return f.join(e, [*keys, "turn"], "left").drop("turn")


def last_region_by_box(regions: DataFrame) -> DataFrame:
    """(page, box) to the region that was read last."""
    box = ["page_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h"]
    return regions.groupBy(*box).agg(F.max_by("region_id", F.struct("reading_order", "region_id")).alias("region_id"))
