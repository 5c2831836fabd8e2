"""The document tree over the star-schema tables: customers are documents, orders pages, line items regions.

ARCHIVE_SQL is the same projection as DuckDB common table expressions, for oracles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Archive:
    documents: DataFrame
    pages: DataFrame
    regions: DataFrame
    ocr: DataFrame
    entities: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STATUS = ["indexed", "needs_review", "ready", "uploaded", "enqueue_failed"]
_TYPES = ["paragraph", "table", "signature", "margin_annotation", "stamp"]


def _pick(values: list[str], index: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    customer, orders, lineitem, nation = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation"))
    documents = customer.select(
        F.concat(F.lit("d"), "c_custkey").alias("document_id"), F.concat(F.lit("ledger_"), "c_custkey", F.lit(".png")).alias("filename"),
        _pick(_STATUS, F.col("c_custkey")).alias("status"), F.col("c_custkey").alias("upload_minute"), "c_name", "c_nationkey",
    )
    pages = orders.select(
        F.concat(F.lit("p"), "o_orderkey").alias("page_id"), F.concat(F.lit("d"), "o_custkey").alias("document_id"), F.col("o_orderkey"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("page_number"), F.to_date("o_orderdate").alias("page_date"),
    )
    keyed = lineitem.withColumn("region_id", F.concat_ws("-", F.concat(F.lit("r"), "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")))
    regions = keyed.select(
        "region_id", F.concat(F.lit("p"), "l_orderkey").alias("page_id"),
        (F.col("l_linenumber") * 100).cast("long").alias("bbox_x"), (F.col("l_quantity").cast("int") * 20).cast("long").alias("bbox_y"),
        (F.col("l_partkey") % 200 + 60).cast("long").alias("bbox_w"), (F.col("l_suppkey") % 30 + 20).cast("long").alias("bbox_h"),
        _pick(_TYPES, F.col("l_linenumber")).alias("region_type"), F.col("l_linenumber").cast("long").alias("reading_order"),
    )
    ocr = keyed.select(
        "region_id", F.concat(F.lit("p"), "l_orderkey").alias("page_id"),
        (F.col("l_quantity").cast("int") * 7 % 40 + 60).cast("double").alias("ocr_confidence"), F.concat_ws(" ", F.lit("lot"), "l_partkey", "l_returnflag", "l_linestatus").alias("text"),
    )
    owner = orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    owner = owner.join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    # One entity of each type for each region; date and amount come from the line itself, so that queries on these
    # types read no other table.
    rows = keyed.select("region_id", "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("shipped"), F.col("l_extendedprice").cast("decimal(14,2)").alias("price"))
    dates = rows.select("region_id", "l_orderkey", F.lit("date").alias("entity_type"), F.date_format("shipped", "yyyy-MM-dd").alias("raw_text"), F.col("shipped").alias("date_value"), F.lit(None).cast("decimal(14,2)").alias("amount_value"), F.lit(None).cast("string").alias("amount_currency"))
    amounts = rows.select("region_id", "l_orderkey", F.lit("amount"), F.col("price").cast("string"), F.lit(None).cast("date"), "price", F.when(F.col("l_linenumber") % 2 == 0, "USD").otherwise("GBP"))
    named = rows.join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
    people = named.select("region_id", "l_orderkey", F.lit("person"), "c_name", F.lit(None).cast("date"), F.lit(None).cast("decimal(14,2)"), F.lit(None).cast("string"))
    places = named.select("region_id", "l_orderkey", F.lit("location"), "n_name", F.lit(None).cast("date"), F.lit(None).cast("decimal(14,2)"), F.lit(None).cast("string"))
    entities = people.union(dates).union(places).union(amounts).toDF("region_id", "l_orderkey", "entity_type", "raw_text", "date_value", "amount_value", "amount_currency")
    entities = entities.select(F.concat_ws("-", "region_id", "entity_type").alias("entity_id"), "region_id", F.concat(F.lit("p"), "l_orderkey").alias("page_id"), "entity_type", "raw_text", "date_value", "amount_value", "amount_currency")
    return Archive(documents, pages, regions, ocr, entities)


ARCHIVE_SQL = """
documents_a AS (
  SELECT 'd' || c_custkey AS document_id, 'ledger_' || c_custkey || '.png' AS filename,
         (['indexed','needs_review','ready','uploaded','enqueue_failed'])[c_custkey % 5 + 1] AS status, c_custkey AS upload_minute, c_name, c_nationkey
  FROM customer),
pages_a AS (
  SELECT 'p' || o_orderkey AS page_id, 'd' || o_custkey AS document_id, o_orderkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_number, CAST(o_orderdate AS DATE) AS page_date
  FROM orders),
lines_a AS (
  SELECT 'r' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS region_id,
         'p' || l_orderkey AS page_id, * FROM lineitem),
regions_a AS (
  SELECT region_id, page_id, CAST(l_linenumber * 100 AS BIGINT) AS bbox_x, CAST(l_quantity AS BIGINT) * 20 AS bbox_y,
         l_partkey % 200 + 60 AS bbox_w, l_suppkey % 30 + 20 AS bbox_h,
         (['paragraph','table','signature','margin_annotation','stamp'])[l_linenumber % 5 + 1] AS region_type, CAST(l_linenumber AS BIGINT) AS reading_order
  FROM lines_a),
ocr_a AS (
  SELECT region_id, page_id, CAST(CAST(l_quantity AS INT) * 7 % 40 + 60 AS DOUBLE) AS ocr_confidence,
         'lot ' || l_partkey || ' ' || l_returnflag || ' ' || l_linestatus AS text
  FROM lines_a),
named_a AS (
  SELECT l.*, c.c_name, n.n_name FROM lines_a l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey),
entities_a AS (
  SELECT region_id || '-person' AS entity_id, region_id, page_id, 'person' AS entity_type, c_name AS raw_text, NULL::DATE AS date_value,
         NULL::DECIMAL(14,2) AS amount_value, NULL::VARCHAR AS amount_currency FROM named_a
  UNION ALL SELECT region_id || '-location', region_id, page_id, 'location', n_name, NULL, NULL, NULL FROM named_a
  UNION ALL SELECT region_id || '-date', region_id, page_id, 'date', strftime(l_shipdate, '%Y-%m-%d'), CAST(l_shipdate AS DATE), NULL, NULL FROM lines_a
  UNION ALL SELECT region_id || '-amount', region_id, page_id, 'amount', CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR), NULL,
         CAST(l_extendedprice AS DECIMAL(14,2)), CASE WHEN l_linenumber % 2 = 0 THEN 'USD' ELSE 'GBP' END FROM lines_a)
"""
