"""Search over the document tree: ranked text, page co-occurrence, fuzzy names, and their index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: pg_trgm-like match threshold: a lower similarity never matches.
LEAST_SIMILARITY = 0.3


def amounts_between_dates(entities: DataFrame, pages: DataFrame, documents: DataFrame, least, start: str, end: str, *, currency: str | None = None, limit: int | None = 100) -> DataFrame:
    """Amounts above `least` on pages that also hold a date in [start, end]: one row for each such date. Both sides are
    filtered before they meet on the page."""
    amounts = entities.where((F.col("entity_type") == "amount") & (F.col("amount_value") > F.lit(least).cast("decimal(14,2)")))
    if currency is not None:
        amounts = amounts.where(F.col("amount_currency") == currency)
    dates = entities.where((F.col("entity_type") == "date") & F.col("date_value").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    pairs = amounts.select("page_id", "entity_id", "raw_text", "amount_value", "amount_currency").join(dates.select("page_id", "date_value", F.col("entity_id").alias("date_entity_id")), "page_id")
    keys = [F.desc("amount_value"), "entity_id", "date_value", "date_entity_id"]
    # The page and document are looked up after the cut: the limit needs neither.
    top = pairs.orderBy(*keys).limit(limit) if limit is not None else pairs
    out = top.join(pages.select("page_id", "document_id"), "page_id").join(documents.select("document_id", "filename"), "document_id")
    return out.orderBy(*keys).select("entity_id", "raw_text", "amount_value", "amount_currency", "date_value", "document_id", "filename", "date_entity_id")


def _fuzzy(entities: DataFrame, kind: str, query: str, threshold: float, name: str) -> DataFrame:
    """Entities of a type similar to a query. Similarity is computed once for each distinct text."""
    rows = entities.where(F.col("entity_type") == kind)
    texts = rows.select("raw_text").distinct().withColumn(name, T.similarity(F.col("raw_text"), query)).where(F.col(name) >= max(threshold, LEAST_SIMILARITY))
    return rows.join(texts, "raw_text")


def person_near_location(entities: DataFrame, pages: DataFrame, documents: DataFrame, person: str, location: str, *, threshold: float = LEAST_SIMILARITY, limit: int | None = 50) -> DataFrame:
    """Pages that mention a person like one name and a place like another, best sum of similarities first."""
    people = _fuzzy(entities, "person", person, threshold, "person_similarity").select("page_id", F.col("entity_id").alias("person_id"), F.col("raw_text").alias("person_text"), "person_similarity")
    places = _fuzzy(entities, "location", location, threshold, "location_similarity").select("page_id", F.col("entity_id").alias("location_id"), F.col("raw_text").alias("location_text"), "location_similarity")
    keys = [F.desc(F.round(F.col("person_similarity") + F.col("location_similarity"), 9)), "person_id", "location_id"]
    pairs = people.join(places, "page_id")
    top = pairs.orderBy(*keys).limit(limit) if limit is not None else pairs
    out = top.join(pages.select("page_id", "document_id"), "page_id").join(documents.select("document_id", "filename"), "document_id")
    return out.orderBy(*keys).select("document_id", "filename", "person_id", "person_text", "location_id", "location_text", "person_similarity", "location_similarity")


def fuzzy_entity_search(names: DataFrame, query: str, *, id_column: str, text_column: str, limit: int = 10) -> DataFrame:
    """Did you mean: rows whose text is similar to a query, most similar first."""
    found = names.select(id_column, text_column, T.similarity(F.col(text_column), query).alias("similarity")).where(F.col("similarity") >= LEAST_SIMILARITY)
    return found.orderBy(F.desc("similarity"), id_column).limit(limit)


def postings(pages: DataFrame, id_column: str = "page_id", text_column: str = "full_text") -> DataFrame:
    """Inverted index: (lexeme, page, tf, length); write it sorted or bucketed by lexeme to read few files a query."""
    lexemes = T.analyze(F.col(text_column))
    exploded = pages.select(F.col(id_column).alias("page_id"), F.size(lexemes).alias("length"), F.explode(lexemes).alias("lexeme"))
    return exploded.groupBy("lexeme", "page_id", "length").agg(F.count("*").alias("tf"))


def trigram_postings(names: DataFrame, text_column: str = "raw_text") -> DataFrame:
    """(trigram, text, size) over distinct texts: candidates of a fuzzy match share a trigram with the query."""
    texts = names.select(F.col(text_column).alias("text")).distinct()
    return texts.select("text", F.size(T.trigrams(F.col("text"))).alias("size"), F.explode(T.trigrams(F.col("text"))).alias("trigram"))


def fuzzy_by_postings(index: DataFrame, query: str, threshold: float = LEAST_SIMILARITY) -> DataFrame:
    """(text, similarity) from a trigram index: reads the query's trigrams only."""
    padded = [f"  {w} " for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()]
    grams = sorted({w[i : i + 3] for w in padded for i in range(len(w) - 2)})
    shared = index.where(F.col("trigram").isin(grams)).groupBy("text", "size").agg(F.count("*").alias("shared"))
    found = shared.select("text", (F.col("shared") / (F.col("size") + len(grams) - F.col("shared"))).alias("similarity"))
    return found.where(F.col("similarity") >= max(threshold, LEAST_SIMILARITY))


def by_postings(index: DataFrame, query: str) -> DataFrame:
    """(page_id, rank) from the inverted index: an equality filter on few lexemes and one small aggregation."""
    words = T.analyze_query(query)
    hits = index.where(F.col("lexeme").isin(words)) if words else index.where(F.lit(False))
    weight = (1 + F.log(F.col("tf").cast("double"))) / (1 + F.log(F.col("length").cast("double")))
    return hits.groupBy("page_id").agg(F.round(F.sum(weight), 6).alias("rank"), F.count("*").alias("n")).where(F.col("n") == len(words)).drop("n")


def full_text(pages: DataFrame, query: str, *, text_column: str = "full_text", limit: int | None = 20, offset: int = 0, key: str = "page_id", columns: tuple[str, ...] = ()) -> DataFrame:
    """Ranked search with snippets: the snippet is made for the rows that are returned only."""
    words = T.analyze_query(query)
    lexemes = T.analyze(F.col(text_column))
    found = pages.withColumn("lexemes", lexemes).where(T.matches(F.col("lexemes"), words)).withColumn("rank", T.rank(F.col("lexemes"), words)).drop("lexemes")
    ordered = found.orderBy(F.desc("rank"), key)
    if limit is not None:
        ordered = ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)
    return ordered.withColumn("snippet", T.snippet(F.col(text_column), words)).select(key, *columns, "rank", "snippet")


def page_filters(pages: DataFrame, entities: DataFrame, ocr: DataFrame, *, date_from: str | None = None, date_to: str | None = None, entity_type: str | None = None, location: str | None = None, min_confidence: float | None = None) -> DataFrame:
    """Pages that pass every given filter, each an independent semi-join, so a page appears once."""
    if date_from is not None or date_to is not None:
        dates = entities.where(F.col("entity_type") == "date")
        if date_from is not None:
            dates = dates.where(F.col("date_value") >= F.lit(date_from).cast("date"))
        if date_to is not None:
            dates = dates.where(F.col("date_value") <= F.lit(date_to).cast("date"))
        pages = pages.join(dates.select("page_id"), "page_id", "left_semi")
    if entity_type is not None:
        pages = pages.join(entities.where(F.col("entity_type") == entity_type).select("page_id"), "page_id", "left_semi")
    if location is not None:
        pages = pages.join(_fuzzy(entities, "location", location, LEAST_SIMILARITY, "location_similarity").select("page_id"), "page_id", "left_semi")
    if min_confidence is not None:
        pages = pages.join(ocr.where(F.col("ocr_confidence") >= min_confidence).select("page_id"), "page_id", "left_semi")
    return pages


def search_documents(pages: DataFrame, entities: DataFrame, ocr: DataFrame, query: str, *, limit: int = 20, offset: int = 0, columns: tuple[str, ...] = (), text_column: str = "full_text", **filters) -> tuple[DataFrame, DataFrame]:
    """(one page of results, a one-row frame with the total)."""
    check_page(query, limit, offset, filters.get("min_confidence"))
    words = T.analyze_query(query)
    passed = page_filters(pages.where(T.matches(T.analyze(F.col(text_column)), words)), entities, ocr, **filters)
    return full_text(passed, query, text_column=text_column, limit=limit, offset=offset, columns=columns), passed.agg(F.count("*").cast("long").alias("total"))


def check_page(query: str, limit: int, offset: int, min_confidence: float | None = None) -> None:
    """Bounds of the search arguments."""
    if not 1 <= len(query) <= 500:
        raise ValueError("the query must have 1 to 500 characters")
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must lie in 1..200 and offset must not be negative")
    if min_confidence is not None and not 0 <= min_confidence <= 100:
        raise ValueError("min_confidence must lie in 0..100")


def paged(frame: DataFrame, keys: list[Column | str], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a totally ordered result."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must lie in 1..500 and offset must not be negative")
    ordered = frame.orderBy(*keys)
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)
