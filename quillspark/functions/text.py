"""Text functions as Column expressions: trigram similarity, edit distances, analysis, rank and snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the analyzer.
STOP_WORDS = (
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her "
    "him his how i if in into is it its just like me more my no not now of on one only or other our out over she so "
    "some than that the their them then there these they this to up us was we were what when which who will with would you your"
).split()


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text: lower case, words padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 0)
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 where both are empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(0.0)).otherwise(both / all_)


def similarity(a: Column, b: Column | str) -> Column:
    return jaccard(trigrams(a), trigrams(F.lit(b) if isinstance(b, str) else b))


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def character_error_rate(predicted: Column, reference: Column) -> Column:
    """Edits over the reference's length, after white space is collapsed; an empty reference gives 0 or 1."""
    p, r = normalize_space(predicted), normalize_space(reference)
    return F.when(F.length(r) == 0, F.when(F.length(p) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(p, r) / F.length(r))


def _coded(words: Column, vocabulary: Column) -> Column:
    """A string with one character of the basic plane for each word: its place in the vocabulary, from U+4E00 on."""
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 19967), 4, "0")), "UTF-16BE")
    return F.array_join(F.transform(words, code), "")


def word_error_rate(predicted: Column, reference: Column) -> Column:
    """Word edits over the reference's words. Texts of up to about 20,000 distinct words together."""
    split = lambda t: F.filter(F.split(normalize_space(t), " "), lambda w: F.length(w) > 0)
    p, r = split(predicted), split(reference)
    vocabulary = F.array_distinct(F.concat(p, r))
    edits = F.levenshtein(_coded(p, vocabulary), _coded(r, vocabulary))
    return F.when(F.size(r) == 0, F.when(F.size(p) == 0, 0.0).otherwise(1.0)).otherwise(edits / F.size(r))


def analyze(text: Column, stemmer=None) -> Column:
    """Lexemes in order: lower case, runs of letters and digits, stop words out; optionally a stemmer on the array."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 0) & ~w.isin(STOP_WORDS))
    return stemmer(words) if stemmer else words


def analyze_query(text: str) -> list[str]:
    """The same analysis on a literal: distinct lexemes in order."""
    return list(dict.fromkeys(w for w in re.split(r"[^\w]+|_", text.lower()) if w and w not in STOP_WORDS))


def matches(lexemes: Column, query: list[str]) -> Column:
    """All of the query's lexemes occur; a query without lexemes matches nothing."""
    if not query:
        return F.lit(False)
    out = F.array_contains(lexemes, query[0])
    for q in query[1:]:
        out = out & F.array_contains(lexemes, q)
    return out


def rank(lexemes: Column, query: list[str]) -> Column:
    """Sum over the query of (1 + ln tf) / (1 + ln length), rounded to 6 places."""
    total = F.lit(0.0)
    for q in query:
        tf = F.size(lexemes) - F.size(F.array_remove(lexemes, q))
        total = total + F.when(tf > 0, (1 + F.log(tf.cast("double"))) / (1 + F.log(F.size(lexemes).cast("double")))).otherwise(0.0)
    return F.round(total, 6)


def highlight(text: Column, query: list[str], start: str = "<b>", end: str = "</b>") -> Column:
    """Marks the query's words in the whole text."""
    if not query:
        return text
    return F.regexp_replace(text, r"(?i)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, query)) + r")(?![\p{L}\p{N}])", f"{start}$1{end}")


def snippet(text: Column, query: list[str], words: int = 35) -> Column:
    """About `words` words around the first hit, with the hits marked."""
    parts = F.split(normalize_space(text), " ")
    cleaned = F.transform(parts, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", ""))
    first = F.array_min(F.array(*(F.when(F.array_position(cleaned, q) > 0, F.array_position(cleaned, q)) for q in query), F.size(parts) + 1)) if query else F.lit(1)
    begin = F.greatest(F.lit(1), F.least(first - words // 3, F.size(parts) - words + 1)).cast("int")
    return highlight(F.array_join(F.slice(parts, begin, F.lit(words)), " "), query)


def snippet_parts(marked: Column) -> Column:
    """Array of (text, marked) from a snippet: pieces inside <b>…</b> are marked; empty pieces are left out."""
    pieces = F.split(marked, r"(?=<b>)|(?<=</b>)")
    part = lambda p: F.struct(F.regexp_replace(p, r"^<b>|</b>$", "").alias("text"), p.rlike(r"^<b>.*</b>$").alias("marked"))
    return F.filter(F.transform(pieces, part), lambda p: F.length(p["text"]) > 0)


# Digit repair of recognised text.
LOOKALIKES, DIGITS = "lIi|OoSZBgq", "11110052899"


def repair_digits(text: Column) -> Column:
    return F.translate(text, LOOKALIKES, DIGITS)


def alnum_ratio(text: Column) -> Column:
    """ASCII letters and digits over characters that are not white space; 1 for blank text."""
    solid = F.length(F.regexp_replace(text, r"\s+", ""))
    return F.when(solid == 0, 1.0).otherwise(F.length(F.regexp_replace(text, "[^A-Za-z0-9]+", "")) / solid)
