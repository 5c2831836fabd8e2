"""Review: the flag queue, the dashboard, corrections, flag status, document detail and schema changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import parts, spread


def severity_rank(column: str = "severity") -> Column:
    return F.when(F.col(column) == "high", 0).when(F.col(column) == "medium", 1).when(F.col(column) == "low", 2).otherwise(3)


def queue(flags: DataFrame, *, status: str | None = "open", severity: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Flags by severity, oldest first. status=None gives all."""
    if status is not None:
        flags = flags.where(F.col("status") == status)
    if severity is not None:
        flags = flags.where(F.col("severity") == severity)
    ordered = flags.orderBy(severity_rank(), "created_at", "flag_id")
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit) if limit is not None else ordered


def worst_flag(flags: DataFrame) -> DataFrame:
    """The most severe open flag of each region; among equals the oldest."""
    return flags.where((F.col("status") == "open") & F.col("region_id").isNotNull()).groupBy("region_id").agg(
        F.min_by(F.struct("flag_id", "severity", "flag_type"), F.struct(severity_rank(), "created_at", "flag_id")).alias("f")
    ).select("region_id", "f.flag_id", "f.severity", "f.flag_type")


def stats(documents: DataFrame, flags: DataFrame, ocr: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of dashboard numbers; averages are null on an empty archive."""
    count = lambda c: F.count(F.when(c, 1)).cast("long")
    d = documents.agg(
        F.count("*").cast("long").alias("documents_total"), count(F.col("status") == "indexed").alias("documents_indexed"),
        count(F.col("status") == "needs_review").alias("documents_needs_review"), count(F.col("status") == "ready").alias("documents_ready"),
    )
    f = flags.agg(count(F.col("status") == "open").alias("flags_open"))
    o = ocr.agg(F.avg("ocr_confidence").alias("ocr_confidence_avg"))
    e = entities.agg(F.avg("confidence").alias("entity_confidence_avg"))
    one = lambda x: x.withColumn("one", F.lit(1))  # noqa: E731  four rows meet on a constant key
    return one(d).join(one(f), "one").join(one(o), "one").join(one(e), "one").drop("one")


def flags_by_type(flags: DataFrame) -> DataFrame:
    return flags.where(F.col("status") == "open").groupBy("flag_type").agg(F.count("*").cast("long").alias("n"))


def flag_counts(flags: DataFrame) -> DataFrame:
    """The same as one map; empty without open flags."""
    return flags_by_type(flags).agg(F.map_from_entries(F.collect_list(F.struct("flag_type", "n"))).alias("flags_by_type"))


def apply_corrections(entities: DataFrame, corrections: DataFrame) -> DataFrame:
    """Latest correction wins: normalized_value and the typed columns change, raw_text does not."""
    last = corrections.groupBy("entity_id").agg(F.max_by("corrected_value", F.struct("created_at", "correction_id")).alias("corrected_value"), F.count("*").cast("long").alias("n_corrections"))
    joined = entities.join(last, "entity_id", "left")
    value = F.coalesce("corrected_value", "normalized_value")
    fixed = F.col("corrected_value").isNotNull()
    return joined.select(
        *(c for c in entities.columns if c not in ("normalized_value", "date_value", "amount_value", "amount_currency")), value.alias("normalized_value"),
        F.when(fixed & (F.col("entity_type") == "date"), parse_date(F.col("corrected_value"))).otherwise(F.col("date_value")).alias("date_value"),
        F.when(fixed & (F.col("entity_type") == "amount"), parse_amount(F.col("corrected_value"))["value"]).otherwise(F.col("amount_value")).alias("amount_value"),
        F.when(fixed & (F.col("entity_type") == "amount"), parse_amount(F.col("corrected_value"))["currency"]).otherwise(F.col("amount_currency")).alias("amount_currency"),
        fixed.alias("corrected"), F.coalesce("n_corrections", F.lit(0)).cast("long").alias("n_corrections"),
    )


def parse_date(value: Column) -> Column:
    """ISO date in the first ten characters, or null."""
    head = F.substring(value, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(head, F.lit("yyyy-MM-dd"))))


def parse_amount(value: Column) -> Column:
    """struct(value decimal(14,2), currency) from "CUR number"; both null if it is not one."""
    currency, number = F.substring_index(value, " ", 1), F.expr("''")
    number = F.when(F.instr(value, " ") > 0, F.substring(value, F.instr(value, " ") + 1, F.length(value)))
    parsed = F.when(number.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"), number).try_cast("decimal(14,2)")
    return F.struct(parsed.alias("value"), F.when(parsed.isNotNull(), currency).alias("currency"))


def flag_status(flags: DataFrame, events: DataFrame) -> DataFrame:
    """Current status from an event log of resolved and dismissed; flags never reopen, the last event wins."""
    last = events.where(F.col("new_status").isin("resolved", "dismissed")).groupBy("flag_id").agg(F.max_by(F.struct("new_status", "at"), F.struct("at", "event_id")).alias("e"))
    joined = flags.join(last, "flag_id", "left")
    return joined.select(*(c for c in flags.columns if c not in ("status", "status_changed_at")), F.coalesce("e.new_status", "status").alias("status"), F.col("e.at").alias("status_changed_at"))


def final_status(documents: DataFrame, flags: DataFrame) -> DataFrame:
    """ready, or needs_review where a document has flags of any status."""
    flagged = flags.groupBy("document_id").agg(F.count("*").cast("long").alias("n_flags"))
    joined = documents.join(flagged, "document_id", "left")
    return joined.select("document_id", F.coalesce("n_flags", F.lit(0)).cast("long").alias("n_flags"), F.when(F.col("n_flags") > 0, "needs_review").otherwise("ready").alias("final_status"))


DETAIL_FIELDS = ("region_type", "ocr_confidence", "text"), ("entity_id", "entity_type", "raw_text")


def document_detail(documents: DataFrame, pages: DataFrame, regions: DataFrame, ocr: DataFrame, entities: DataFrame, fields: tuple[tuple[str, ...], tuple[str, ...]] = DETAIL_FIELDS) -> DataFrame:
    """One nested row per document: pages by number, regions by reading order, each with its text and entities. `fields` are
    those of a region (beside its place and id) and of an entity; every level is shuffled, so what is not asked for is left out early."""
    of_region, of_entity = fields
    by_region = entities.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct(*of_entity))).alias("entities"))
    read = ocr.select("region_id", *(c for c in ("ocr_confidence", "text") if c in of_region))
    full = regions.join(read, "region_id", "left").join(by_region, "region_id", "left")
    region = F.struct("reading_order", "region_id", *of_region, F.coalesce("entities", F.array()).alias("entities"))
    by_page = full.groupBy("page_id").agg(F.array_sort(F.collect_list(region)).alias("regions"))
    page = F.struct("page_number", "page_id", F.coalesce("regions", F.array()).alias("regions"))
    by_document = pages.join(by_page, "page_id", "left").groupBy("document_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return documents.join(by_document, "document_id", "left")


def page_text(regions: DataFrame, page: str = "page_id", order: str = "reading_order", text: str = "text") -> DataFrame:
    """Texts of a page that are not blank, in reading order, with a blank line between."""
    parts = regions.where(F.length(F.trim(text)) > 0).groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("t")))).alias("parts"))
    return parts.select(page, F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("full_text"))


def cascade(deleted: DataFrame, documents: DataFrame, pages: DataFrame, regions: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """What is left of the tree when documents go: each level drops the children of what the level above dropped."""
    gone_pages = pages.join(deleted, "document_id", "left_semi").select("page_id")
    by_page, gone_of_pages = spread(parts(regions), "page_id", regions, gone_pages)
    gone_regions = by_page.join(gone_of_pages, "page_id", "left_semi").select("region_id")
    gone_of_regions, regions = spread(parts(regions), "region_id", gone_regions, regions)
    gone_of_entities, entities = spread(parts(entities), "region_id", gone_regions, entities)
    return {
        "documents": documents.join(deleted, "document_id", "left_anti"), "pages": pages.join(gone_pages, "page_id", "left_anti"),
        "regions": regions.join(gone_of_regions, "region_id", "left_anti"), "entities": entities.join(gone_of_entities, "region_id", "left_anti"),
    }


def status_from_resolved(flags: DataFrame) -> DataFrame:
    """Schema change: a resolved mark becomes a status."""
    return flags.withColumn("status", F.when(F.col("resolved"), "resolved").otherwise("open")).drop("resolved")


def resolved_from_status(flags: DataFrame) -> DataFrame:
    """The change back; a dismissed flag becomes one that is not resolved."""
    return flags.withColumn("resolved", F.col("status") == "resolved").drop("status")


def newest(frame: DataFrame, kind: str, when: str, keep: int = 14, tie: str | None = None) -> DataFrame:
    """The newest rows of each kind."""
    order = [F.desc(when), *([F.desc(tie)] if tie else [])]
    return frame.withColumn("age", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("age") <= keep).drop("age")
