"""Benchmark decontamination: BM25 index of test items, block-max WAND over every passage of every document.

Index. Items are split into words (letters, digits, apostrophes; A-Z as a-z). A term's impact on an item is its BM25
contribution divided by the item's BM25 score against itself, so a passage that holds the whole item scores about 1
and one threshold suits items of all lengths. Document frequencies, the number of items and their mean length are counted over
all items. Postings lie in blocks with the largest impact of each block. Items are broadcast in shards of at most about
SHARD items and SHARD_BYTES bytes; more shards mean more passes, so what is broadcast has a bound, and hits do not
depend on it.

Query. Items are indexed by length class (up to 64, 128, 256, … words). For each class every document is cut into
passages of twice as many words, half a passage apart, so that an item fits wholly into one of them. Common terms, whose impacts stay below a share of the threshold in every item, cannot
make a hit alone: a passage is screened, for whole arrays at once, by the WAND bound that the other terms must add up
to what the common ones leave open in some item. Passages that pass run block-max WAND, which returns every item at
or above the threshold.

Verification. An item is a question and an answer (its last sentence, or its last third where it has one sentence).
A hit stands if at least `overlap` of the word trigrams of both parts (their words, if fewer than three) occur in the passage.

Defined cases: null or empty text has no passages; items without words are not indexed; null ids of documents and of
items are kept in the rows returned; repeated rows each give their rows; an empty benchmark gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, map_batches, stage, text_of
from .words import NON_WORD, HashIndex, mix64, scan

K1, B = 1.2, 0.75
#: Share of the threshold that common terms may reach in an item.
COMMON = 0.5
SHARD, SHARD_BYTES = 20_000, 16 << 20
#: Words of the shortest length class.
SHORT = 64
BLOCK = 16


def trigrams(h: np.ndarray) -> np.ndarray:
    """Hashes of runs of three words; the words themselves where there are fewer."""
    if len(h) < 3:
        return h
    return mix64((h[:-2] * np.uint64(0x9FB21C651E98DF25) + h[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + h[2:])


@dataclass
class Index:
    items: np.ndarray  # ids, or None
    parts: list[tuple[np.ndarray, np.ndarray]]  # trigrams of question and answer
    terms: np.ndarray  # distinct hashes
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # item positions, impacts, block maxima
    top: np.ndarray  # largest impact of each term
    essential: np.ndarray  # whether the term is not common
    least: np.ndarray  # what essential terms must add up to in each item
    begins: np.ndarray  # flat postings of a term: begins[t] to begins[t + 1]
    item: np.ndarray
    impact: np.ndarray
    window: int
    stride: int


def split_item(text: str) -> tuple[str, str]:
    sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if s]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 3))
    return " ".join(words[:cut]), " ".join(words[cut:])


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for s in scan(pa.array(texts, pa.string()), NON_WORD):
        out += np.split(s.hashes, s.splits[1:-1])
    return out


@dataclass
class Statistics:
    """Of all items: their number and mean length in words, and how many of them hold each term (sorted hashes)."""

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray]) -> "Statistics":
        terms, df = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
        return cls(len(words), sum(map(len, words)) / len(words), terms, df)


def build(items: list[tuple[int | None, str]], threshold: float, statistics: Statistics | None = None) -> list[Index]:
    """The indexes of the items, one for each length class that is there; without statistics the items are all there are."""
    words = _hashes([t for _, t in items])
    kept = [i for i, w in enumerate(words) if len(w)]
    if not kept:
        return []
    statistics = statistics or Statistics.of([words[i] for i in kept])
    classes: dict[int, list[int]] = {}
    for i in kept:
        classes.setdefault(max(SHORT, 1 << (len(words[i]) - 1).bit_length()), []).append(i)
    return [_build([items[i] for i in members], [words[i] for i in members], size, threshold, statistics) for size, members in sorted(classes.items())]


def _build(items: list[tuple[int | None, str]], words: list[np.ndarray], size: int, threshold: float, statistics: Statistics) -> Index:
    parts = list(zip(*(map(trigrams, _hashes(list(side))) for side in zip(*(split_item(t) for _, t in items), strict=True)), strict=True))
    lengths = np.array([len(w) for w in words], float)
    terms, inverse = np.unique(np.concatenate(words), return_inverse=True)
    owner = np.repeat(np.arange(len(words)), lengths.astype(int))
    cells, counts = np.unique(inverse.astype(np.int64) * len(words) + owner, return_counts=True)
    term, item = cells // len(words), cells % len(words)
    df = statistics.df[np.searchsorted(statistics.terms, terms)]
    idf = np.log1p((statistics.items - df + 0.5) / (df + 0.5))
    tf = counts / (counts + K1 * (1 - B + B * lengths[item] / statistics.mean))
    impact = idf[term] * tf * (K1 + 1)
    impact /= np.bincount(item, impact, len(words))[item]
    top = np.zeros(len(terms))
    np.maximum.at(top, term, impact)
    # Terms are common, most frequent first, as long as no item gets more than a share of the threshold from them.
    common, given = np.zeros(len(terms), bool), np.zeros(len(words))
    begins = np.searchsorted(term, np.arange(len(terms) + 1))
    for t in np.lexsort((terms, -df)):
        at = slice(begins[t], begins[t + 1])
        if (given[item[at]] + impact[at]).max() > threshold * COMMON:
            continue
        given[item[at]] += impact[at]
        common[t] = True
    postings = []
    for t in range(len(terms)):
        at = slice(begins[t], begins[t + 1])
        postings.append((item[at], impact[at], np.maximum.reduceat(impact[at], np.arange(0, begins[t + 1] - begins[t], BLOCK))))
    return Index(np.array([i for i, _ in items], object), parts, terms, postings, top, ~common, threshold - given, begins, item, impact, 2 * size, size)


def block_max_wand(index: Index, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """Positions and scores of all items whose summed impacts over the query's distinct terms reach the threshold."""
    lists = [[0, *index.postings[t], float(index.top[t])] for t in query]  # position, items, impacts, maxima, top
    hits, eps = [], 1e-9
    lists = [x for x in lists if len(x[1])]
    while lists:
        lists.sort(key=lambda x: x[1][x[0]])
        bound, pivot = 0.0, -1
        for k, x in enumerate(lists):
            bound += x[4]
            if bound >= threshold - eps:
                pivot = k
                break
        if pivot < 0:
            break
        at = lists[pivot][1][lists[pivot][0]]
        while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == at:
            pivot += 1
        # Bound by the blocks that hold the pivot item, where the lists may reach it.
        tight, ends = 0.0, []
        for x in lists[: pivot + 1]:
            p = x[0] + int(np.searchsorted(x[1][x[0] :], at))
            if p < len(x[1]):
                block = p // BLOCK
                tight += x[3][block]
                ends.append(x[1][min((block + 1) * BLOCK, len(x[1])) - 1])
        if tight < threshold - eps:
            # No item before the nearest block end, or the next list's item, can reach the threshold.
            to = min([int(e) + 1 for e in ends] + [int(x[1][x[0]]) for x in lists[pivot + 1 : pivot + 2]])
            to = max(to, int(at) + 1)
            moved = lists[: pivot + 1]
        elif lists[0][1][lists[0][0]] == at:
            score = sum(float(x[2][x[0]]) for x in lists[: pivot + 1])
            if score >= threshold - eps:
                hits.append((int(at), score))
            to, moved = int(at) + 1, lists[: pivot + 1]
        else:
            to, moved = int(at), lists[: pivot + 1]
        for x in moved:
            x[0] += int(np.searchsorted(x[1][x[0] :], to))
        lists = [x for x in lists if x[0] < len(x[1])]
    return hits


class Matcher:
    def __init__(self, indexes: list[Index], threshold: float, overlap: float):
        self.indexes, self.threshold, self.overlap = [(x, HashIndex(x.terms)) for x in indexes], threshold, overlap

    def documents(self, texts: pa.Array) -> list[tuple[int, int | None, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of verified hits, the best passage of each."""
        return sorted((hit for x, lookup in self.indexes for hit in self._hits(x, lookup, texts)), key=lambda hit: hit[0])

    def _hits(self, x: Index, lookup: HashIndex, texts: pa.Array) -> list[tuple]:
        best: dict = {}
        for s in scan(texts, NON_WORD):
            h = s.hashes
            term = lookup.find(h)
            at = np.flatnonzero((term >= 0) & x.essential[term])
            if not len(at):
                continue
            docs = np.searchsorted(s.splits, at, side="right") - 1
            inner = at - s.splits[docs]
            # The word lies in the passages that begin at stride * p for p from low to high.
            high = inner // x.stride
            low = np.maximum(0, (inner - x.window) // x.stride + 1)
            spread = (high - low + 1).astype(np.int64)
            # Passages are numbered through the scan; a cell is a distinct (passage, item, term).
            lengths = np.diff(s.splits)
            first = np.concatenate(([0], np.cumsum(lengths // x.stride + 1)))
            df = (x.begins[1:] - x.begins[:-1])[term[at]]
            times = spread * df
            end = np.cumsum(times)
            inside = np.arange(end[-1]) - np.repeat(end - times, times)
            wide = np.repeat(df, times)
            passage = np.repeat(first[docs] + low, times) + inside // wide
            posting = np.repeat(x.begins[term[at]], times) + inside % wide
            size = len(x.items)
            cells = np.unique((passage * size + x.item[posting]) * len(x.item) + posting)
            pair, posting = cells // len(x.item), cells % len(x.item)
            edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            enough = np.add.reduceat(x.impact[posting], edge) >= x.least[pair[edge] % size] - 1e-9
            for number in np.unique(pair[edge[enough]] // size).tolist():
                doc = int(np.searchsorted(first, number, side="right")) - 1
                passage = number - int(first[doc])
                a = int(s.splits[doc]) + passage * x.stride
                b = min(a + x.window, int(s.splits[doc + 1]))
                found = term[a:b]
                hits = block_max_wand(x, np.unique(found[found >= 0]), self.threshold)
                if hits:
                    grams = np.concatenate((trigrams(h[a:b]), h[a:b]))
                    for item, score in hits:
                        question, answer = (float(np.isin(p, grams).mean()) if len(p) else 1.0 for p in x.parts[item])
                        if question >= self.overlap and answer >= self.overlap:
                            key = (s.first + doc, item)
                            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, question, answer))
        return [(row, x.items[item], *found) for (row, item), found in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _shards(spark: SparkSession, benchmark: DataFrame, threshold: float, shard: int) -> Iterator[list[Index]]:
    """The indexes of each shard of the items, all by the statistics of the whole benchmark."""
    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of(benchmark).alias("text"))
    count, size = source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(-(-count // shard), -(-size // SHARD_BYTES))
    if shards <= 1:
        yield build([(r.item_id, r.text) for r in source.collect()], threshold)
        return
    items = stage(spark, source.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int")), "items")

    def terms(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = _hashes(column(batch, "text").to_pylist())
        held = [np.unique(w).view(np.int64) for w in words]
        splits = np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int32)
        flat = np.concatenate(held) if held else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([column(batch, "shard"), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(splits), pa.array(flat))], names=["shard", "n", "terms"])

    held = stage(spark, map_batches(items.select("shard", "text"), terms, "shard int, n long, terms array<long>"), "item_terms")
    n, mean = held.where("n > 0").agg(F.count("*"), F.avg("n")).first()
    df = stage(spark, held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "item_df")
    for k in range(shards):
        own = held.where(F.col("shard") == k).select(F.explode("terms").alias("term")).distinct()
        rows = df.join(own, "term", "left_semi").toPandas()  # of the terms of one shard
        seen = rows["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(seen)
        statistics = Statistics(n, mean or 1.0, seen[order], rows["df"].to_numpy(np.int64)[order])
        yield build([(r.item_id, r.text) for r in items.where(F.col("shard") == k).collect()], threshold, statistics)


def _matching(spark: SparkSession, indexes: list[Index], threshold: float, overlap: float):
    shared, made = spark.sparkContext.broadcast(indexes), {}

    def documents(texts: pa.Array) -> list[tuple]:
        if "matcher" not in made:
            made["matcher"] = Matcher(shared.value, threshold, overlap)
        return made["matcher"].documents(texts)

    return documents


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row for each document and test item it holds."""
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for indexes in _shards(spark, benchmark, threshold, shard):
        documents = _matching(spark, indexes, threshold, overlap)

        def kernel(batch: pa.RecordBatch, documents=documents) -> pa.RecordBatch:
            found = documents(column(batch, "text"))
            row = np.array([f[0] for f in found], np.int64)
            arrays = [column(batch, "doc_id").take(pa.array(row)), pa.array([f[1] for f in found], pa.int64()), *(pa.array([f[c] for f in found], pa.float64()) for c in (2, 3, 4))]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        if indexes:
            out = out.union(map_batches(source, kernel, SCHEMA))
    return out


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, shard: int = SHARD) -> DataFrame:
    """The rows of docs that hold no test item. Each row is judged by its own text, whatever its id."""
    for indexes in _shards(spark, benchmark, threshold, shard):
        documents = _matching(spark, indexes, threshold, overlap)

        def kernel(batch: pa.RecordBatch, documents=documents) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            keep[[f[0] for f in documents(column(batch, "text"))]] = False
            return batch.filter(pa.array(keep))

        if indexes:
            docs = map_batches(docs, kernel, docs.schema)
    return docs
