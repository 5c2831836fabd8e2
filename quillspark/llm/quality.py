"""Quality by hierarchical empirical Bayes: what the text says, and what its host and path say.

Evidence. A logistic classifier reads about twenty shape measures of the text (letter case, punctuation, repeated words
and lines, word lengths, size); it is fitted on at most `most` labelled documents, those with the smallest id hashes.

Hierarchy. All documents are grouped by host (`source`) and by path within the host (`lang`, the section a document was filed
under). Expected good documents of a group are summed from the classifier's probabilities; a path's rate shrinks
towards its host's rate, a host's towards the global one, each with a prior weight estimated by moments over the
groups (a beta-binomial fit), so sparse sites stay near the prior. Posterior log odds = evidence log odds + path log
odds - global log odds. Groups are partial aggregates: a host with a third of all rows costs one row a task.

Defined cases: null text is empty; null source or lang is a group of its own, named ''; a null id never joins a label; without labelled
rows of both kinds all posteriors are the prior 1; repeated rows count each; empty input gives empty output.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import column, fold, map_batches, stage, text_of
from .words import scan

MARKS = b"!#$%&*|?.,;:-_=<>/\\@~^"


def _byte_classes() -> np.ndarray:
    """(256, 12): membership of each byte in the classes whose shares are measured."""
    table = np.zeros((256, 12))
    table[65:91, 0] = 1
    table[97:123, 1] = 1
    table[48:58, 2] = 1
    table[[9, 10, 11, 12, 13, 32], 3] = 1
    table[10, 4] = 1
    table[128:, 5] = 1
    for k, group in enumerate((b"!", b"#", b"$%&*", b"|", b".,;:", MARKS), 6):
        table[list(group), k] = 1
    return table


def measures(texts: pa.Array) -> np.ndarray:
    """(documents, measures): shares and logarithms that describe the shape of each text."""
    out, classes = [], _byte_classes()
    marks = np.zeros(256, bool)
    marks[[b for b in MARKS if b not in b".,"]] = True
    for s in scan(texts):
        docs, n = s.documents(), len(s.splits) - 1
        size, words = np.diff(s.offsets).astype(float), np.diff(s.splits).astype(float)
        cells = np.repeat(np.arange(n) << 8, np.diff(s.offsets)) + s.data
        shares = np.bincount(cells, minlength=n << 8).reshape(n, 256) @ classes / np.maximum(size, 1)[:, None]
        lengths, h = (s.ends - s.starts).astype(float), s.hashes
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (docs[1:] == docs[:-1])
        # Distinct words of a document: 40 bits of hash tell its words apart, the document's number is above them.
        key = np.sort((docs.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        fresh = np.bincount((key[np.concatenate(([True], key[1:] != key[:-1]))] >> np.uint64(40)).astype(np.int64), minlength=n) if len(h) else np.zeros(n)
        marked = marks[s.data[s.ends - 1]] if len(h) else np.zeros(0)
        per = lambda v: _per(s.splits, v) / np.maximum(words, 1)  # noqa: B023, E731
        cols = [np.log1p(words), per(lengths), per(same), fresh / np.maximum(words, 1), per(marked), per(lengths > 25), words < 5, np.log1p(size) - np.log1p(words)]
        out.append(np.concatenate([shares, np.stack(cols, 1)], 1))
    return np.concatenate(out) if out else np.zeros((0, 20))


def _per(splits: np.ndarray, values: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[splits[1:]] - sums[splits[:-1]]


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_basis((x - self.mean) / self.scale) @ self.weights, -12, 12)


def _basis(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([np.ones((len(z), 1)), z, np.minimum(z * z, 16)], 1)


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Classifier:
    """Ridge logistic regression by iteratively reweighted least squares."""
    if not len(y) or y.min() == y.max():
        k = x.shape[1]
        return Classifier(np.zeros(k), np.ones(k), np.r_[12.0, np.zeros(2 * k)], 1.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    b = _basis((x - mean) / scale)
    w = np.zeros(b.shape[1])
    penalty = np.full(b.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b @ w, -30, 30)))
        r = np.maximum(p * (1 - p), 1e-5)
        step = np.linalg.solve((b * r[:, None]).T @ b + np.diag(penalty), b.T @ (y - p) - penalty * w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w, float(y.mean()))


def fit(docs: DataFrame, labels: DataFrame, most: int = 8_000) -> Classifier:
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(fold("doc_id", 5) != 0)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    marks = marks.join(docs.select(docs["doc_id"].cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    # An id that repeats gives the sample the one of its texts with the smallest hash.
    sample = texts.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "quality"), F.struct(F.xxhash64("text"), "text")).alias("row")).select("doc_id", "row.text", "row.quality")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = measures(column(batch, "text"))
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    rows = map_batches(sample, kernel, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist()) if len(rows) else measures(pa.array([""]))[:0]
    return train(x, rows["quality"].to_numpy(float))


def evidence(spark: SparkSession, docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The columns of docs but for the text, plus log_odds: a pass without a shuffle."""
    shared = spark.sparkContext.broadcast(classifier)
    source = docs.drop("log_odds")
    rest = [f for f in source.schema.fields if f.name != "text"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = shared.value.log_odds(measures(column(batch, "text")))
        return pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in rest), pa.array(x)], names=[*(f.name for f in rest), "log_odds"])

    return map_batches(source, kernel, StructType([*rest, StructField("log_odds", DoubleType())]))


def _strength(groups: DataFrame, rate: str, center: str) -> float:
    """Prior weight (in documents) of a beta-binomial, by moments over the groups: from 1 to 10,000."""
    c = F.col(center)
    n, noise, between, within = groups.agg(
        F.sum("n"), F.sum(c * (1 - c)), F.sum(F.col("n") * F.pow(F.col(rate) - c, 2)), F.avg(c * (1 - c))
    ).first()
    return min(10_000.0, max(1.0, within / max((between - noise) / n, 1e-9) - 1)) if n else 1.0


def posteriors(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(host, path, host_rate, path_rate, global_rate): shrunken rates of every path."""
    p = 1 / (1 + F.exp(-F.col("log_odds")))
    paths = stage(spark, found.groupBy("host", "path").agg(F.sum(p).alias("good"), F.count("*").alias("n")), "paths")
    good, n = paths.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    overall = (good + 0.5) / (n + 1.0)
    shrunk = lambda center, weight: (F.col("good") + weight * center) / (F.col("n") + weight)
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    hosts = hosts.withColumn("global_rate", F.lit(overall)).withColumn("rate", F.col("good") / F.col("n"))
    hosts = hosts.select("host", "global_rate", shrunk(F.col("global_rate"), _strength(hosts, "rate", "global_rate")).alias("host_rate"))
    paths = paths.join(hosts, "host").withColumn("rate", F.col("good") / F.col("n"))
    return paths.select("host", "path", "global_rate", "host_rate", shrunk(F.col("host_rate"), _strength(paths, "rate", "host_rate")).alias("path_rate"))


def _site(docs: DataFrame) -> list[F.Column]:
    return [F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for c, name in (("source", "host"), ("lang", "path"))]


def _odds(rate: str) -> F.Column:
    return F.log(F.greatest(F.col(rate), F.lit(1e-6)) / F.greatest(1 - F.col(rate), F.lit(1e-6)))


def score(spark: SparkSession, docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, log_odds, host_rate, path_rate and posterior of each row of docs. The evidence of a document is a few numbers: it is
    staged, so that texts are read once, for the rates and for the posteriors."""
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), *_site(docs))
    found = stage(spark, evidence(spark, ids, classifier), "evidence")
    return _posterior(found.join(posteriors(spark, found), ["host", "path"])).select("doc_id", "log_odds", "host_rate", "path_rate", "posterior")


def _posterior(rated: DataFrame) -> DataFrame:
    return rated.withColumn("posterior", 1 / (1 + F.exp(-(F.col("log_odds") + _odds("path_rate") - _odds("global_rate")))))


def at_least(spark: SparkSession, docs: DataFrame, classifier: Classifier, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose posterior is the limit or more: the site's rates say what evidence a document needs, and the rows are
    chosen where their evidence is measured. Sites meet the documents in a join on short columns."""
    rates = posteriors(spark, evidence(spark, docs.select(text_of(docs).alias("text"), *_site(docs)), classifier))
    bar = F.log(F.lit(limit / (1 - limit))) - _odds("path_rate") + _odds("global_rate")
    need = stage(spark, rates.select("host", "path", bar.alias("need")), "need")
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    host, path = (F.coalesce(plain[names[docs.columns.index(c)]].cast("string"), F.lit("")) for c in ("source", "lang"))
    joined = plain.join(need, (host == need["host"]) & (path == need["path"])).select(*names, "need")
    shared, at = spark.sparkContext.broadcast(classifier), docs.columns.index("text")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = shared.value.log_odds(measures(batch.column(at)))
        kept = batch.filter(pa.array(x >= column(batch, "need").to_numpy(zero_copy_only=False)))
        return kept.select(names)

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)])
    return map_batches(joined, kernel, schema).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = 8_000, least: float = 0.5) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, posterior, keep (posterior >= least)."""
    out = score(spark, docs, fit(docs, labels, most))
    return out.select("doc_id", (1 / (1 + F.exp(-F.col("log_odds")))).alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= least).alias("keep"))
