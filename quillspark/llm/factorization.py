"""Toxicity by a factorization machine over hashed terms.

Terms are a document's distinct words (letters, digits and apostrophes; A-Z as a-z) and the first 4, 5, 6 and 8 bytes of
longer ones, hashed into 2**BITS places. The score is the logistic of bias + linear weights + pairwise interactions of
factors, so a pair of terms can weigh what neither weighs alone. Training is proximal AdaGrad with an L1 penalty on
the linear weights, which leaves chance terms at zero, on a sample of at most `most` labelled documents (those with
the smallest hashes of their ids); scoring reads every word of every document where it lies.

Defined cases: null text is empty and scores the bias; a null id counts as the empty text in the fold and never joins
a label; an id with several labels is toxic if one of them says so; of rows that repeat an id one is learned from,
and each is scored; without labelled rows every score is 0.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import column, fold, map_batches, text_of
from .words import NON_WORD, scan

BITS = 20
PREFIXES = (4, 5, 6, 8)


@dataclass
class Machine:
    bias: float
    places: np.ndarray  # sorted places with any weight
    linear: np.ndarray
    factors: np.ndarray  # (places, k)

    def __post_init__(self):
        self.row = np.full(1 << BITS, -1, np.int32)
        self.row[self.places] = np.arange(len(self.places))

    def margins(self, rows: np.ndarray, splits: np.ndarray) -> np.ndarray:
        """Margins of documents given the weight rows of their distinct terms."""
        v = self.factors[rows]
        terms = np.concatenate([self.linear[rows][:, None], v, v * v], 1)
        sums = np.concatenate((np.zeros((1, terms.shape[1])), np.cumsum(terms, 0)))
        per = sums[splits[1:]] - sums[splits[:-1]]
        k = v.shape[1]
        return self.bias + per[:, 0] + 0.5 * ((per[:, 1 : k + 1] ** 2) - per[:, k + 1 :]).sum(1)


def term_places(s) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of each document of a scan, as (places, splits)."""
    docs = s.documents().astype(np.int64)
    lengths = s.ends - s.starts
    keys = [(docs << BITS) | (s.hashes >> np.uint64(64 - BITS)).astype(np.int64)]
    for length in PREFIXES:
        longer = lengths > length
        keys.append((docs[longer] << BITS) | (s.prefix_hashes(length)[longer] >> np.uint64(64 - BITS)).astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    return keys & ((1 << BITS) - 1), np.searchsorted(keys, np.arange(len(s.splits)) << BITS)


def association(toxic: np.ndarray, seen: np.ndarray, positives: float, total: int) -> np.ndarray:
    """Likelihood-ratio statistic (G squared) of each place's 2x2 table of presence against label."""
    cells = [toxic, seen - toxic, positives - toxic, total - positives - seen + toxic]
    marginal = [(seen, positives), (seen, total - positives), (total - seen, positives), (total - seen, total - positives)]
    out = np.zeros(len(seen))
    for observed, (a, b) in zip(cells, marginal, strict=True):
        expected = a * b / total
        live = (observed > 0) & (expected > 0)
        out[live] += observed[live] * np.log(observed[live] / expected[live])
    return 2 * out


def _least_count(n: np.ndarray, t: np.ndarray, bound: float, toxic: bool) -> np.ndarray:
    """For places in n documents, t of them toxic: how many of these a partner must be in, all of them toxic (or none), for its
    statistic to reach the bound; more than there are where it cannot."""
    top = (t if toxic else n - t).astype(float)
    low, high = np.zeros(len(n)), top + 1
    while (gap := high - low > 1).any():
        k = np.where(gap, np.floor((low + high) / 2), high)
        enough = (k > top) | (association(k if toxic else 0 * k, np.minimum(k, top), t, n) >= bound)
        low, high = np.where(enough | ~gap, low, k), np.where(enough & gap, k, high)
    return high


class _Postings:
    """Which documents hold which places: dense columns for products, bit rows for single pairs."""

    def __init__(self, docs: list[np.ndarray], places: np.ndarray):
        index = np.full(1 << BITS, -1, np.int32)
        index[places] = np.arange(len(places))
        rows = [(r := index[d])[r >= 0].astype(np.int64) * len(docs) + k for k, d in enumerate(docs)]
        cells = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        rows.clear()
        cells.sort()
        self.documents, self.owner = len(docs), (cells % max(1, len(docs))).astype(np.int32)
        self.begins = np.searchsorted(cells, np.arange(len(places) + 1) * len(docs))

    def _cells(self, first: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        begins = self.begins[first : to + 1]
        return self.owner[begins[0] : begins[-1]], np.repeat(np.arange(to - first), np.diff(begins))

    def dense(self, first: int, to: int, which: np.ndarray) -> np.ndarray:
        """(documents of `which`, columns first .. to-1), 1 where the document holds the place."""
        row = np.full(self.documents, -1, np.int32)
        row[which] = np.arange(len(which))
        owner, column = self._cells(first, to)
        at = row[owner]
        out = np.zeros((len(which), to - first), np.float32)
        out[at[at >= 0], column[at >= 0]] = 1
        return out

    def bits(self, first: int, to: int) -> np.ndarray:
        """Documents of columns first .. to-1 as rows of bits."""
        owner, column = self._cells(first, to)
        flags = np.zeros((to - first, self.documents), bool)
        flags[column, owner] = True
        return np.packbits(flags, axis=1)


def interacting(docs: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, toxic: np.ndarray, least: float, block: int = 512) -> np.ndarray:
    """Places of pairs that weigh together what they do not weigh alone: among the documents of either place, the other
    one is associated with the label. The bound grows with the number of pairs, so that about one pair passes by
    chance.

    No pair is left out that can reach the bound, but few have to be looked at. A partner that raises the rate needs a
    least number of toxic documents in common; such pairs are found by products over the toxic documents alone. A
    pair that raises neither place's rate needs a least number of other documents in common for both; in order of those numbers
    most blocks of columns cannot have such pairs. Products go by blocks, so memory does not grow with the vocabulary."""
    places = np.flatnonzero((seen >= 3) & (toxic > 0))
    rate = np.clip(toxic[places] / seen[places], 1e-12, 1 - 1e-12)
    most = -2 * seen[places] * (rate * np.log(rate) + (1 - rate) * np.log1p(-rate))  # of a partner that tells all labels
    count = int((most >= least).sum())
    bound = max(least, 2 * np.log(max(1, count * (count - 1) / 2)))
    places = places[most >= bound]
    n, t = seen[places].astype(float), toxic[places].astype(float)
    lower, size = _least_count(n, t, bound, False), np.floor(4 * np.log2(np.maximum(n - t, 1)))
    order = np.lexsort((lower, size))
    places, n, t, lower, size = (x[order] for x in (places, n, t, lower, size))
    held, found = _Postings(docs, places), np.zeros(len(places), bool)
    ends = [*np.flatnonzero(np.diff(size)) + 1, len(places)]
    edges = [(i, min(i + block, k)) for first, k in zip([0, *ends], ends) for i in range(first, k, block)]
    everyone = np.arange(len(docs))
    for raising, shared in ((True, everyone[labels > 0]), (False, everyone[labels <= 0])):
        need, have = (_least_count(n, t, bound, True), t) if raising else (lower, n - t)
        reach = [(need[i:k].min(), have[i:k].max()) for i, k in edges]
        for x, (i, k) in enumerate(edges):
            left, rows = None, None
            for y, (j, m) in enumerate(edges[x:], x):
                if raising and min(reach[x][0], reach[y][0]) > min(reach[x][1], reach[y][1]) or not raising and max(reach[x][0], reach[y][0]) > min(reach[x][1], reach[y][1]):
                    continue
                left = held.dense(i, k, shared) if left is None else left
                count = left.T @ (left if x == y else held.dense(j, m, shared))
                enough = (count >= need[i:k, None], count >= need[None, j:m])
                pair = enough[0] | enough[1] if raising else enough[0] & enough[1]
                a, b = np.nonzero(np.triu(pair, 1) if x == y else pair)
                if raising:
                    # If b raises a's rate and a does not raise b's, a lowers it: b's rate is the higher one.
                    one, other = enough[0][a, b], enough[1][a, b]
                    mixed = lambda p, q: (t[q] * n[p] > t[p] * n[q]) & (n[p] - t[p] >= lower[q])
                    can = one & other | one & mixed(a + i, b + j) | other & mixed(b + j, a + i)
                    a, b = a[can], b[can]
                if not len(a):
                    continue
                rows = held.bits(i, k) if rows is None else rows
                columns = rows if x == y else held.bits(j, m)
                both = np.concatenate([np.bitwise_count(rows[a[c : c + 4096]] & columns[b[c : c + 4096]]).sum(1, dtype=np.int64) for c in range(0, len(a), 4096)]).astype(float)
                common = count[a, b].astype(float)
                both_toxic = common if raising else both - common
                a, b = a + i, b + j
                keep = both >= 3
                for z in (a, b):
                    keep[keep] = association(both_toxic[keep], both[keep], t[z[keep]], n[z[keep]]) >= bound
                found[a[keep]] = found[b[keep]] = True
    return np.sort(places[found])


def train(docs: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 20, rate: float = 0.1, l1: float = 1e-4, l2: float = 1e-3, least: float = 12.0, seed: int = 7) -> Machine:
    """Proximal AdaGrad over mini-batches of 64 documents, on the places seen in 3 documents or more whose
    likelihood-ratio statistic against the label is at least `least`, alone or in a pair (see `interacting`): the other
    terms are noise at this sample size."""
    if not len(labels):
        return Machine(-50.0, np.zeros(0, np.int64), np.zeros(1), np.zeros((1, factors)))
    seen = np.bincount(np.concatenate(docs), minlength=1 << BITS) if docs else np.zeros(1 << BITS, int)
    toxic = np.bincount(np.concatenate([d for d, y in zip(docs, labels, strict=True) if y] or [np.zeros(0, np.int64)]), minlength=1 << BITS)
    often = np.flatnonzero(seen >= 3)
    alone = often[association(toxic[often], seen[often], labels.sum(), len(labels)) >= least]
    places = np.union1d(alone, interacting(docs, labels, seen, toxic, least))
    index = np.full(1 << BITS, -1, np.int32)
    index[places] = np.arange(len(places))
    docs = [(r := index[d])[r >= 0] for d in docs]
    rng = np.random.default_rng(seed)
    prior = (labels.sum() + 1.0) / (len(labels) + 2.0)
    n, k = len(places), factors
    w = np.zeros((n, 1 + k))
    w[:, 1:] = rng.normal(0, 0.01, (n, k))
    g2 = np.full((n, 1 + k), 1e-3)
    bias, bias_g2 = float(np.log(prior / (1 - prior))), 1e-3
    # Small samples get more epochs, so that the number of steps does not fall with them.
    for _ in range(max(epochs, 2_500 * 64 // len(docs))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            parts = [docs[i] for i in batch]
            lengths = np.array([len(p) for p in parts])
            flat, owner = np.concatenate(parts), np.repeat(np.arange(len(batch)), lengths)
            x = w[flat]
            sums = np.zeros((len(batch), 1 + k))
            full = lengths > 0
            if len(flat):
                begins = np.concatenate(([0], np.cumsum(lengths[full])))[:-1]
                sums[full] = np.add.reduceat(x, begins)
                squares = np.zeros(len(batch))
                squares[full] = np.add.reduceat((x[:, 1:] ** 2).sum(1), begins)
            else:
                squares = np.zeros(len(batch))
            margin = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[batch]
            step = error.sum() / len(batch)
            bias_g2 += step * step
            bias -= rate * step / np.sqrt(bias_g2)
            if not len(flat):
                continue
            e = error[owner] / len(batch)
            grad = np.empty_like(x)
            grad[:, 0] = e
            grad[:, 1:] = e[:, None] * (sums[owner, 1:] - x[:, 1:])
            rows, inverse = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(inverse, grad[:, c], len(rows)) for c in range(1 + k)], 1)
            g[:, 1:] += l2 * w[rows, 1:]
            g2[rows] += g * g
            pace = rate / np.sqrt(g2[rows])
            new = w[rows] - pace * g
            new[:, 0] = np.sign(new[:, 0]) * np.maximum(np.abs(new[:, 0]) - pace[:, 0] * l1, 0)
            w[rows] = new
    live = (w[:, 0] != 0) | (np.abs(w[:, 1:]).max(1) > 0.03)
    # The last row has no weight: places outside the model point at it.
    return Machine(bias, places[live], np.append(w[live, 0], 0.0), np.vstack([w[live, 1:], np.zeros((1, k))]))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = 8_000) -> Machine:
    """Learn from labelled rows outside the held-out fold; at most `most` of them, by the hash of their ids."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(fold("doc_id", 5) != 0)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    known = marks.join(docs.select(docs["doc_id"].cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    marks = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # An id that repeats gives the sample the one of its texts with the smallest hash.
    sample = texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("text"), "text")).alias("row")).select("doc_id", "row.text", "row.toxic")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for s in scan(column(batch, "text"), NON_WORD):
            places, splits = term_places(s)
            found += [places[a:b].astype("<u4").tobytes() for a, b in zip(splits[:-1], splits[1:], strict=True)]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "toxic"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "places"])

    rows = map_batches(sample, kernel, "doc_id long, toxic int, places binary").toPandas().sort_values(["doc_id", "places"])
    return train([np.frombuffer(p, "<u4").astype(np.int32) for p in rows["places"]], rows["toxic"].to_numpy(float))


def toxicities(machine: Machine, texts: pa.Array) -> np.ndarray:
    """The score of each text, 0 to 1."""
    out = np.full(len(texts), 0.0)
    for s in scan(texts, NON_WORD):
        places, splits = term_places(s)
        rows = machine.row[places]
        live = rows >= 0
        kept = np.concatenate(([0], np.cumsum(live)))[splits]
        out[s.first : s.first + len(splits) - 1] = machine.margins(rows[live], kept)
    return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def score(spark: SparkSession, docs: DataFrame, machine: Machine) -> DataFrame:
    """The columns of docs but for the text, plus toxicity: a pass without a shuffle."""
    shared = spark.sparkContext.broadcast(machine)
    source = docs.drop("toxicity")
    rest = [f for f in source.schema.fields if f.name != "text"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = toxicities(shared.value, column(batch, "text"))
        return pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in rest), pa.array(p)], names=[*(f.name for f in rest), "toxicity"])

    return map_batches(source, kernel, StructType([*rest, StructField("toxicity", DoubleType())]))


def below(spark: SparkSession, docs: DataFrame, machine: Machine, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose toxicity is below the limit: they are chosen where they are scored."""
    shared = spark.sparkContext.broadcast(machine)
    return map_batches(docs, lambda batch: batch.filter(pa.array(toxicities(shared.value, column(batch, "text")) < limit)), docs.schema)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = 8_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    out = score(spark, source, fit(spark, docs, labels, most))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
