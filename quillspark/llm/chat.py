"""Chat formatting: collapse logged snapshots of growing conversations, then render the maximal ones.

Turns are ordered by (turn, role, text) and numbered. Each turn has a 128-bit hash of its number, role and text; the
running XOR of these over a conversation is its turn-prefix hash, kept by a streaming window. Conversations with equal
full hash and length are one (the smallest id stays). A conversation whose full hash is the hash of a proper prefix of
another one goes by an anti-join; prefixes and conversations are made distinct by partial aggregation first, so a
common first turn or a much copied conversation costs one row a task. The rest are rendered.

Defined cases: null role or text is empty; null turns come first; rows with a null conv_id are one conversation; a row
that repeats another is a turn of its own; empty input gives empty output. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixes(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, position, role, text, hash of the prefix that it ends, and whether more follows."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.withColumn("position", F.row_number().over(order)).withColumn("more", F.lead(F.lit(True)).over(order).isNotNull())
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.select(
        "conv_id", "position", "role", "text", "more",
        F.bit_xor(F.xxhash64(F.lit(1), "position", "role", "text")).over(running).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), "text", "role", "position")).over(running).alias("h2"),
    )


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): the maximal conversations, and how many logged conversations were equal to each."""
    rows = prefixes(conversations).select("conv_id", "position", "h1", "h2", "more")
    full = rows.where(~F.col("more")).groupBy("h1", "h2", "position").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = rows.where("more").select("h1", "h2", "position").distinct()
    return full.join(begun, ["h1", "h2", "position"], "left_anti").select("conv_id", F.col("position").cast("long").alias("n_turns"), "copies")


def render(conversations: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """(conv_id, n_turns, copies, text): each maximal conversation as one marked-up text."""
    kept = collapse(conversations)
    turns = prefixes(conversations).select(F.col("conv_id").alias("of"), "position", F.concat(F.lit(begin), "role", F.lit("\n"), "text", F.lit(end + "\n")).alias("part"))
    texts = turns.join(kept.select("conv_id"), F.col("of").eqNullSafe(F.col("conv_id")), "left_semi").groupBy("of")
    texts = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "part"))), lambda t: t["part"]), "").alias("text"))
    return kept.join(texts, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "n_turns", "copies", "text")


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS position,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
prefixes AS (
  SELECT conv_id, position, n, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
         OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h
  FROM turns),
complete AS (
  SELECT h, n AS n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes WHERE position = n GROUP BY h, n),
maximal AS (
  SELECT * FROM complete c
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.h = c.h AND p.position = c.n_turns AND p.position < p.n))
SELECT m.conv_id, m.n_turns, m.copies,
       string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.position) AS text
FROM maximal m JOIN turns t ON m.conv_id IS NOT DISTINCT FROM t.conv_id
GROUP BY m.conv_id, m.n_turns, m.copies
"""
