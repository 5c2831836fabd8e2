"""Hidden Markov language model: distributed counts, distributed Baum-Welch, exact scaled forward scores.

Token model. The `head` most frequent training words form a broadcast table of bounded size with their counts; of
them the `own` most frequent are observation symbols of their own, and every other word (the open tail, known or not)
is observed as one of `BUCKETS` classes by its last two bytes. A state emits a symbol; a class then emits the word from
the add-0.1 smoothed counts within the class, so the model is a distribution over all words. Counts of tail words meet
the documents in a shuffle join on the word hash: nothing that grows with the vocabulary is broadcast.

Baum-Welch. Of about `init_docs` training documents, drawn by lot, those that are farthest from each other in symbol frequencies
are seeds, one a state. Then all training documents are assigned to the nearest seed, and the symbol counts of each
share of the corpus are the initial emissions. Every round runs scaled forward-backward over all training documents where
they lie, until a round gains less than `gain` nats a token or `rounds` are done. Partial counts (a few thousand rows of S
numbers a task, whatever the task's size) are summed by Spark and only the sums, whose size is fixed by the model, reach the driver.

Defined cases: null text is empty (its only token is the end); a null id counts as the empty text in the fold, and
is returned as null; repeated rows are scored each; an empty training set gives N = 0 and base score 0 per token.
Other columns of docs are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, column, discard, drop_held, fold, map_batches, stage, text_of
from .words import HashIndex, scan

END = 0
BUCKETS = 256
LIMIT_CELLS = 1 << 18


@dataclass
class Hmm:
    start: np.ndarray  # (S,)
    move: np.ndarray  # (S, S)
    emit: np.ndarray  # (C, S)


def batches(seqs: list[np.ndarray]):
    """Sequences, longest first, in padded time-major blocks of at most LIMIT_CELLS cells (or one sequence): the
    indexes, the symbols (T, B), and how many sequences are alive at each time."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        longest = max(1, len(seqs[order[at]]))
        take = order[at : at + max(1, LIMIT_CELLS // longest)]
        at += len(take)
        lengths = np.array([len(seqs[i]) for i in take])
        block = np.zeros((longest, len(take)), np.int32)
        for k, i in enumerate(take):
            block[: len(seqs[i]), k] = seqs[i]
        alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
        yield take, block, alive


def forward(model: Hmm, block: np.ndarray, alive: np.ndarray, keep: bool = False):
    """Scaled forward recursion; the natural log likelihood of each sequence, and with keep all scaled vectors."""
    n = block.shape[1]
    logs = np.zeros(n)
    a = model.start * model.emit[block[0]]
    rows, scales = [], []
    for t in range(len(alive)):
        m = int(alive[t])
        if t:
            a = (a[:m] @ model.move) * model.emit[block[t, :m]]
        s = a.sum(1)
        a = a / s[:, None]
        logs[:m] += np.log(s)
        if keep:
            rows.append(a)
            scales.append(s)
    return logs, rows, scales


def expect(model: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """Expected counts over the sequences: rows 0..C-1 emissions by symbol, then S rows of moves, then the starts."""
    return expected(model, seqs)[0]


def expected(model: Hmm, seqs: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """expect(), and the log likelihood of the sequences."""
    likelihood = 0.0
    symbols, states = model.emit.shape
    total = np.zeros((symbols + states + 1, states))
    for _, block, alive in batches(seqs):
        logs, rows, scales = forward(model, block, alive, keep=True)
        likelihood += float(logs.sum())
        beta = np.ones_like(rows[-1])
        gammas, moves = [rows[-1]], np.zeros((states, states))
        for t in range(len(alive) - 2, -1, -1):
            m = int(alive[t + 1])
            weighted = model.emit[block[t + 1, :m]] * beta / scales[t + 1][:, None]
            moves += rows[t][:m].T @ weighted
            beta = np.ones_like(rows[t])
            beta[:m] = weighted @ model.move.T
            gammas.append(rows[t] * beta)
        gamma = np.concatenate(gammas[::-1])
        seen = np.concatenate([block[t, : int(alive[t])] for t in range(len(alive))])
        for s in range(states):
            total[:symbols, s] += np.bincount(seen, gamma[:, s], symbols)
        total[symbols : symbols + states] += moves * model.move
        total[-1] += gammas[-1].sum(0)
    return total, likelihood


def maximise(counts: np.ndarray, prior: np.ndarray) -> Hmm:
    """Parameters from expected counts, smoothed: one pseudo-token a state shared by the overall symbol frequencies."""
    states = counts.shape[1]
    symbols = len(counts) - states - 1
    emit = counts[:symbols] + prior[:, None]
    move = counts[symbols:-1] + 0.1
    start = counts[-1] + 0.1
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def profiles(seqs: list[np.ndarray], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(splits, symbols, roots of their shares): the distinct symbols of each sequence. Profiles have unit length."""
    owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    flat = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
    cells, counts = np.unique(owner * symbols + flat, return_counts=True)
    splits = np.searchsorted(cells, np.arange(len(seqs) + 1) * symbols)
    lengths = np.maximum(np.array([len(s) for s in seqs], float), 1)
    return splits, (cells % symbols).astype(np.int32), np.sqrt(counts / lengths[cells // symbols])


def nearest(seqs: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """For each sequence the column of seeds (C, S) that is nearest to its profile."""
    splits, symbol, share = profiles(seqs, len(seeds))
    sums = np.concatenate((np.zeros((1, seeds.shape[1])), np.cumsum(seeds[symbol] * share[:, None], 0)))
    return np.argmax(sums[splits[1:]] - sums[splits[:-1]], 1)


def farthest(cells: np.ndarray, states: int) -> np.ndarray:
    """Seeds (C, states) out of profiles (n, C): each next one is the farthest from those chosen. Seeds that lack are zero."""
    out = np.zeros((cells.shape[1], states))
    if len(cells):
        chosen = [int(np.argmax((cells > 0).sum(1)))]
        near = cells @ cells[chosen[0]]
        while len(chosen) < min(states, len(cells)):
            chosen.append(int(np.argmin(near)))
            near = np.maximum(near, cells @ cells[chosen[-1]])
        out[:, : len(chosen)] = cells[chosen].T
    return out


def assigned(seqs: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """Counts as those of expect(): each sequence's symbols go to the state whose seed is nearest."""
    symbols, states = seeds.shape
    total = np.zeros((symbols + states + 1, states))
    if seqs:
        owner = np.repeat(nearest(seqs, seeds), [len(s) for s in seqs])
        total[:symbols] = np.bincount(np.concatenate(seqs) * states + owner, minlength=symbols * states).reshape(symbols, states)
    return total


def begin(counts: np.ndarray, prior: np.ndarray) -> Hmm:
    """Initial parameters from assigned counts: states tend to stay."""
    symbols, states = len(prior), counts.shape[1]
    counts = counts.copy()
    counts[symbols:-1] = 0.2 / states
    counts[symbols:-1][np.diag_indices(states)] += 5.0
    return maximise(counts, prior)


def _unpack(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2").astype(np.int32) for b in column(batch, "seq").to_pylist()]


class Scorer:
    def __init__(self, spark: SparkSession, head: int, own: int, states: int, rounds: int, init_docs: int, gain: float):
        self.spark, self.head, self.own, self.states = spark, head, own, states
        self.rounds, self.init_docs, self.gain = rounds, init_docs, gain

    def count(self, train: DataFrame) -> DataFrame:
        """Rows (w, c, tail): word hash, count, class by the last two bytes; each task sums what it holds first."""

        def run(batches_):
            # Sorted arrays of what this task has counted, merged when they grow: memory follows the task's vocabulary.
            parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            held = 0
            drop_held()

            def merged():
                w, c, b = (np.concatenate(x) for x in zip(*parts, strict=True))
                u, first, inverse = np.unique(w, return_index=True, return_inverse=True)
                return u, np.bincount(inverse, c, len(u)).astype(np.int64), b[first]

            for batch in batches_:
                for s in scan(column(batch, "text")):
                    if len(s.starts):
                        u, first, n = np.unique(s.hashes, return_index=True, return_counts=True)
                        parts.append((u, n, tails(s, first)))
                        held += len(u)
                if held > 1_000_000:
                    parts = [merged()]
                    held = len(parts[0][0])
                    if held > 750_000:
                        yield _counts(*parts[0])
                        parts, held = [], 0
            if parts:
                yield _counts(*merged())

        local = train.select(text_of(train).alias("text")).mapInArrow(run, "w long, c long, bucket int")
        return local.groupBy("w").agg(F.sum("c").alias("c"), F.min("bucket").alias("bucket"))

    def run(self, docs: DataFrame, held: F.Column) -> DataFrame:
        spark = self.spark
        bound_batches(spark)
        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), held.alias("held_out"))
        train = rows.where(~F.col("held_out"))
        counts = stage(spark, self.count(train), "counts")
        ends = train.count()
        n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        tokens, distinct = n + ends, v + (ends > 0)
        top = self.most_frequent(counts)
        words = np.array([r.w for r in top], np.int64).view(np.uint64)
        seen = np.array([r.c for r in top], np.int64)
        own = min(self.own, len(top))
        buckets = np.zeros((BUCKETS, 2))
        for r in counts.groupBy("bucket").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
            buckets[r.bucket] = r.c, r.v
        for r in top[:own]:
            buckets[r.bucket] -= r.c, 1
        # Symbols: END, then words of their own, then classes.
        prior = np.concatenate(([ends], seen[:own], buckets[:, 0])) + 0.1
        prior /= prior.sum()
        within = np.log10(buckets[:, 0] + 0.1 * (buckets[:, 1] + 1))
        encoded = stage(spark, self.encode(rows, spark.sparkContext.broadcast((words, seen, own, within))), "encoded")
        training = encoded.where(~F.col("held_out"))
        model = begin(self.summed(training, lambda seeds, seqs: (assigned(seqs, seeds), 0.0), self.seeds(training, len(prior), ends))[0], prior)
        before = None
        for _ in range(self.rounds):
            found, likelihood = self.summed(training, expected, model)
            model = maximise(found, prior)
            if before is not None and likelihood - before < self.gain * tokens:
                break
            before = likelihood
        out = self.score(encoded, counts, model)
        base = float(np.log10(tokens + 0.1 * (distinct + 1)))
        return out.select(
            "doc_id", "held_out", "n_tokens",
            (F.col("n_known") + (1 if ends else 0)).cast("long").alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("counted") + float(np.log10(ends + 0.1)) - F.col("n_tokens") * base).alias("base_score"),
            (F.col("path") + F.col("counted") - F.col("own_counted") - F.col("within")).alias("score"),
        )

    def seeds(self, training: DataFrame, symbols: int, documents: int) -> np.ndarray:
        """Farthest profiles of about `init_docs` documents, each drawn with the same chance. A profile has at most as many
        numbers as there are symbols, however long its document is."""
        lot = F.pmod(F.xxhash64("doc_id", "rid"), F.lit(1 << 40))
        drawn = training.where(lot * float(documents) < float(1 << 40) * self.init_docs) if documents > self.init_docs else training

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            splits, symbol, share = profiles(_unpack(batch), symbols)
            lists = [pa.ListArray.from_arrays(pa.array(splits.astype(np.int32)), pa.array(x)) for x in (symbol, share)]
            return pa.RecordBatch.from_arrays([column(batch, "rid"), *lists], names=["rid", "symbol", "share"])

        rows = map_batches(drawn.select("rid", "seq"), kernel, "rid long, symbol array<int>, share array<double>").orderBy("rid").limit(4 * self.init_docs).collect()
        cells = np.zeros((len(rows), symbols), np.float32)
        for i, r in enumerate(rows):
            cells[i, r.symbol] = r.share
        return farthest(cells, self.states)

    def most_frequent(self, counts: DataFrame) -> list:
        """The `head` most frequent words, of equal counts those with the smallest hashes: the counts' histogram on a logarithmic
        scale says which steps fit whole, so that no task sends more than its share of the head to the driver."""
        step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
        room, least, rest = self.head, None, []
        for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
            if r.n > room:
                rest = counts.where(step == r.step).orderBy(F.desc("c"), "w").limit(room).collect() if room else []
                break
            room, least = room - r.n, r.step
        return sorted([*(counts.where(step >= least).collect() if least is not None else []), *rest], key=lambda r: (-r.c, r.w))

    def encode(self, rows: DataFrame, shared) -> DataFrame:
        """Per document: its symbols, the summed log10(c + 0.1) of head words (and of those that are symbols of their
        own), the summed class denominators, and the tail words to be joined."""
        cache: dict = {}

        def run(batches_):
            from pyspark import TaskContext

            drop_held()
            if "index" not in cache:
                words, seen, own, within = shared.value
                cache.update(index=HashIndex(words), logs=np.log10(seen + 0.1), own=own, within=within)
            index, logs, own, within = cache["index"], cache["logs"], cache["own"], cache["within"]
            rid = TaskContext.get().partitionId() << 36
            for batch in batches_:
                ids, held = column(batch, "doc_id"), column(batch, "held_out")
                for s in scan(column(batch, "text")):
                    n = len(s.splits) - 1
                    h = s.hashes
                    at = index.find(h)
                    bucket = tails(s, np.arange(len(h)))
                    symbol = np.where((at >= 0) & (at < own), at + 1, own + 1 + bucket).astype("<u2")
                    log = np.where(at >= 0, logs[at] if len(logs) else 0.0, 0.0)
                    classed = (at < 0) | (at >= own)
                    sums = _by_document(s, [log, np.where(classed, 0.0, log), np.where(classed, within[bucket], 0.0), at >= 0])
                    tail = at < 0
                    splits = np.concatenate(([0], np.cumsum(tail)))[s.splits]
                    seq = [symbol[a:b].tobytes() + b"\0\0" for a, b in zip(s.splits[:-1], s.splits[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(rid, rid + n)), ids.slice(s.first, n), held.slice(s.first, n), pa.array(np.diff(s.splits) + 1), pa.array(sums[3].astype(np.int64)),
                            pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), pa.array(seq, pa.binary()),
                            pa.ListArray.from_arrays(pa.array(splits.astype(np.int32)), pa.array(h[tail].view(np.int64))),
                        ],
                        names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "counted", "own_counted", "within", "seq", "tail"],
                    )
                    rid += n

        return rows.mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, counted double, own_counted double, within double, seq binary, tail array<long>")

    def summed(self, encoded: DataFrame, count: Callable, model) -> tuple[np.ndarray, float]:
        """The sums over all documents of count(model, sequences): a table of counts as that of expect(), and a number."""
        states, size = self.states, (model if isinstance(model, np.ndarray) else model.emit).shape[0] + self.states + 1
        shared = self.spark.sparkContext.broadcast(model)

        def run(batches_):
            drop_held()
            total = np.zeros((size + 1, states))
            for batch in batches_:
                counts, number = count(shared.value, _unpack(batch))
                total[:size] += counts
                total[size, 0] += number
            rows = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(total[rows, s]) for s in range(states))], names=["row", *(f"s{s}" for s in range(states))])

        partial = encoded.select("seq").mapInArrow(run, "row int, " + ", ".join(f"s{s} double" for s in range(states)))
        out = np.zeros((size + 1, states))
        for r in partial.groupBy("row").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).collect():
            out[r.row] = r[1:]
        shared.unpersist()
        return out[:size], float(out[size, 0])

    def score(self, encoded: DataFrame, counts: DataFrame, model: Hmm) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(model)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            seqs, logs = _unpack(batch), np.zeros(batch.num_rows)
            for take, block, alive in batches(seqs):
                logs[take] = forward(shared.value, block, alive)[0]
            names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "counted", "own_counted", "within"]
            return pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(logs / np.log(10))], names=[*names, "path"])

        scored = map_batches(encoded.drop("tail"), kernel, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, counted double, own_counted double, within double, path double")
        known = encoded.select("rid", F.explode("tail").alias("w")).join(counts.select("w", "c"), "w", "left")
        sums = known.groupBy("rid").agg(
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("tail_counted"), F.count("c").alias("tail_known")
        )
        return scored.join(sums, "rid", "left").select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
            (F.col("counted") + F.coalesce("tail_counted", F.lit(0.0))).alias("counted"), "own_counted", "within", "path",
        )


def tails(s, which: np.ndarray) -> np.ndarray:
    """Class of each word by its last two bytes, A-Z as a-z."""
    last = s.data[s.ends[which] - 1].astype(np.uint32)
    prior = np.where(s.ends[which] - s.starts[which] > 1, s.data[s.ends[which] - 2], 0).astype(np.uint32)
    lower = lambda x: np.where((x >= 65) & (x < 91), x + 32, x)
    return ((lower(prior) * np.uint32(2654435761) + lower(last) * np.uint32(40503)) >> np.uint32(9)).astype(np.int64) % BUCKETS


def _counts(w: np.ndarray, c: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(b.astype(np.int32))], names=["w", "c", "bucket"])


def _by_document(s, values: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for v in values:
        sums = np.concatenate(([0.0], np.cumsum(v)))
        out.append(sums[s.splits[1:]] - sums[s.splits[:-1]])
    return out


def score_documents(
    spark: SparkSession, docs: DataFrame, *, head: int = 131_072, own: int = 8_192, states: int = 8, rounds: int = 3, init_docs: int = 256, gain: float = 1e-3
) -> DataFrame:
    """Train on documents whose fold(doc_id, 10) is not 0 and score every document; columns as in Scorer.run."""
    return Scorer(spark, head, own, states, rounds, init_docs, gain).run(docs, fold("doc_id", 10) == 0)
