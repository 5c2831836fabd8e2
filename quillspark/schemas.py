"""The document model: explicit schemas, value domains and the rules that rows must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DecimalType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

# Enumerations of the document model.
DOCUMENT_STATUS = ["uploaded", "preprocessing", "ocr_running", "ocr_done", "ocr_partial", "extracting", "indexed", "needs_review", "ready", "enqueue_failed", "error"]
REGION_TYPES = ["paragraph", "table", "signature", "margin_annotation", "stamp"]
OCR_STATUS = ["ok", "ocr_partial", "failed"]
ENTITY_TYPES = ["person", "date", "location", "amount"]
SEVERITIES = ["high", "medium", "low"]
FLAG_TYPES = ["low_ocr_confidence", "illegible", "entity_conflict", "extraction_failure"]
FLAG_STATUS = ["open", "resolved", "dismissed"]

_DDL = {
    "documents": "id string, filename string, upload_time timestamp, status string, raw_image_path string, processed_image_path string, error_message string",
    "pages": "id string, document_id string, page_number int, full_text string, processed_image_path string, created_at timestamp",
    "regions": "id string, page_id string, bbox_x int, bbox_y int, bbox_w int, bbox_h int, region_type string, reading_order int, confidence double, created_at timestamp",
    "ocr_results": "id string, region_id string, engine string, text string, confidence double, status string, notes array<string>, created_at timestamp",
    "entities": "id string, region_id string, entity_type string, raw_text string, normalized_value string, confidence double, start_char int, end_char int, "
    "date_value date, amount_value decimal(14,2), amount_currency string, created_at timestamp",
    "entity_corrections": "id string, entity_id string, original_value string, corrected_value string, reviewer string, created_at timestamp",
    "review_flags": "id string, document_id string, page_id string, region_id string, entity_id string, flag_type string, severity string, explanation string, "
    "status string, status_changed_at timestamp, created_at timestamp",
    "words": "page_id string, region_id string, idx int, text string, conf double, left int, top int, width int, height int, block_num int, par_num int, line_num int",
    "components": "page_id string, comp_id int, x int, y int, w int, h int, area int, cx double, cy double",
    "ground_truth": "id string, image string, status string, text string, entities array<struct<type:string,value:string>>, "
    "regions array<struct<type:string,bbox:array<int>>>, notes string, page_size array<int>, page int",
}


def _type(name: str) -> DataType:
    name = name.strip()
    if name.startswith("array<"):
        return ArrayType(_type(name[6:-1]))
    if name.startswith("struct<"):
        return _struct(name[7:-1], ":")
    if name.startswith("decimal("):
        return DecimalType(*map(int, name[8:-1].split(",")))
    return {"string": StringType, "int": IntegerType, "double": DoubleType, "date": DateType, "timestamp": TimestampType}[name]()


def _struct(ddl: str, between: str) -> StructType:
    """Fields of a schema text, split at commas outside brackets; no session is needed for it."""
    fields, depth, begin = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, _, kind = ddl[begin:i].strip().partition(between)
            fields.append(StructField(name, _type(kind)))
            begin = i + 1
    return StructType(fields)


SCHEMAS = {name: _struct(ddl, " ") for name, ddl in _DDL.items()}

#: Columns that must not be null, value domains, and keys that must be unique.
REQUIRED = {
    "documents": ["id", "filename", "upload_time", "status", "raw_image_path"],
    "pages": ["id", "document_id", "page_number", "created_at"],
    "regions": ["id", "page_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "region_type", "reading_order", "confidence"],
    "ocr_results": ["id", "region_id", "engine", "text", "confidence", "status"],
    "entities": ["id", "region_id", "entity_type", "raw_text", "confidence", "start_char", "end_char"],
    "entity_corrections": ["id", "entity_id", "corrected_value", "reviewer"],
    "review_flags": ["id", "document_id", "flag_type", "severity", "explanation", "status"],
}
DOMAINS = {
    ("documents", "status"): DOCUMENT_STATUS, ("regions", "region_type"): REGION_TYPES, ("ocr_results", "status"): OCR_STATUS, ("entities", "entity_type"): ENTITY_TYPES,
    ("review_flags", "severity"): SEVERITIES, ("review_flags", "flag_type"): FLAG_TYPES, ("review_flags", "status"): FLAG_STATUS,
}
LENGTHS = {("documents", "filename"): 512, ("ocr_results", "engine"): 32, ("entities", "amount_currency"): 8, ("entity_corrections", "reviewer"): 255}
UNIQUE = {"pages": ["document_id", "page_number"], "ocr_results": ["region_id"]}


def problems(table: str, frame: DataFrame) -> Column:
    """Array of what is wrong with a row; empty for a good one."""
    checks: list[Column] = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in REQUIRED.get(table, [])]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(values), F.lit(f"{c} is not a known value")) for (t, c), values in DOMAINS.items() if t == table]
    checks += [F.when(F.length(c) > most, F.lit(f"{c} is too long")) for (t, c), most in LENGTHS.items() if t == table]
    return F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")


def validate(table: str, frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their problems)."""
    marked = frame.withColumn("problems", problems(table, frame))
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return frame.groupBy(*keys).agg(F.count("*").cast("long").alias("n")).where("n > 1")


def conform(frame: DataFrame, table: str) -> DataFrame:
    """Rows in the table's schema: missing columns become null, others are cast; this is how a column is added."""
    have = set(frame.columns)
    return frame.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields))


def stable_id(*parts: Column | str) -> Column:
    """Deterministic id of a natural key, so that a rerun makes the same rows."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256)


def rank_of(column: str, values: list[str]) -> Column:
    """Position of a value in a list of values, the list's length if it is not there."""
    return reduce(lambda acc, x: acc.when(F.col(column) == x[1], F.lit(x[0])), enumerate(values), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(len(values)))
