"""Audio fingerprints of media columns: pitch-class frames, integral-image filters, packed integers, aligned search.

Fingerprint. PCM samples (little-endian 16-bit, one channel) are cut into overlapping frames; the spectrum's energy is gathered by
pitch class into 12 bins, smoothed over neighbouring frames and scaled to unit length. Sixteen rectangle filters over
(time, pitch class), evaluated on an integral image, each give two bits (Gray code of three thresholds), packed into
one 32-bit integer for each frame position.

Search. Recordings with equal fingerprints form one class (grouped by digest, partial aggregation), so copies cost
nothing more. Classes that hold a query id are looked up: equal integers of query and recording vote for a time
offset, in one aggregation over (query class, class, offset); the OFFSETS offsets of a pair with the most votes are
aligned and the bit errors of the overlap counted, if that has `least_overlap` positions or is the whole of a shorter
recording. Pairs up to `most_errors` of the bits are returned. Where a sound is held, only the place where its integer
begins votes. Integers that many recordings hold are dealt out by recording as well, so no task has all of one.

Defined cases: null or too short recordings have an empty fingerprint and match nothing; null ids are members of classes
but no queries; repeated rows are members each; empty input gives empty output. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, map_batches, stage

RATE, FRAME, HOP, SMOOTH = 2_000, 256, 64, 4
LOWEST, HIGHEST = 110.0, 950.0
#: Filters: (kind, first pitch class, height, width). Fixed by rule: kinds cycle, heights 2..6, widths 4..12.
FILTERS = [(k % 4, (5 * k) % 9, 3 + (k % 4), 4 + 2 * (k % 5)) for k in range(16)]
#: Thresholds of a filter's log ratio: three cuts make four levels, two bits in Gray code.
CUTS = (-0.25, 0.0, 0.25)
#: Offsets of a pair that are aligned; postings of one integer that a task takes, at least.
OFFSETS, HEAVY = 3, 10_000
WIDEST = max(f[3] for f in FILTERS)


def _pitch_map() -> np.ndarray:
    """(spectrum bins, 12): weights from frequencies to pitch classes."""
    out = np.zeros((FRAME // 2 + 1, 12))
    for b in range(1, FRAME // 2 + 1):
        f = b * RATE / FRAME
        if LOWEST <= f <= HIGHEST:
            x = 12 * np.log2(f / 440.0) % 12
            low, part = int(x) % 12, x - int(x)
            out[b, low] += 1 - part
            out[b, (low + 1) % 12] += part
    return out


_PITCH = _pitch_map()


def frames(pcm: np.ndarray) -> np.ndarray:
    """(time, 12) unit pitch-class frames of samples."""
    if len(pcm) < FRAME + HOP * (SMOOTH + WIDEST):
        return np.zeros((0, 12))
    window = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(window * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    chroma = np.log1p(power @ _PITCH / 1e6)
    sums = np.concatenate((np.zeros((1, 12)), np.cumsum(chroma, 0)))
    chroma = (sums[SMOOTH:] - sums[:-SMOOTH]) / SMOOTH
    return chroma / np.maximum(np.linalg.norm(chroma, axis=1, keepdims=True), 1e-6)


def pack(chroma: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each position where the widest filter fits."""
    n = len(chroma) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = np.cumsum(np.cumsum(chroma, 0), 1)

    def area(t: int, w: int, y: int, h: int) -> np.ndarray:
        return image[t + w : t + w + n, y + h] - image[t : t + n, y + h] - image[t + w : t + w + n, y] + image[t : t + n, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        h = min(h, 12 - y)
        if kind == 0:  # upper against lower half
            a, b = area(0, w, y, h // 2), area(0, w, y + h // 2, h - h // 2)
            a, b = a / (h // 2), b / (h - h // 2)
        elif kind == 1:  # earlier against later half
            a, b = area(0, w // 2, y, h), area(w // 2, w - w // 2, y, h)
        elif kind == 2:  # diagonal corners
            a = area(0, w // 2, y, h // 2) + area(w // 2, w - w // 2, y + h // 2, h - h // 2)
            b = area(0, w // 2, y + h // 2, h - h // 2) + area(w // 2, w - w // 2, y, h // 2)
        else:  # middle third in time against its sides
            third = w // 3
            b = area(third, w - 2 * third, y, h)
            a = (area(0, w, y, h) - b) / (2 * third) * (w - 2 * third)
        value = np.log((1e-3 + np.maximum(a, 0)) / (1e-3 + np.maximum(b, 0)))
        level = (value[:, None] > np.array(CUTS)).sum(1).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprint(pcm: bytes | None) -> np.ndarray:
    return pack(frames(np.frombuffer(pcm, "<i2", len(pcm) // 2))) if pcm else np.zeros(0, np.uint32)


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(differing bits, compared bits) with a[i] against b[i + offset]."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, 0
    return int(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()), 32 * (hi - lo)


def render(vector: list[float] | None, note: int = 128) -> bytes:
    """A melody for a vector: each component is a note of fixed length whose pitch glides between two of 24 semitones in
    proportion to its value, so near vectors sound alike."""
    v = np.nan_to_num(np.asarray(vector if vector is not None else [], float))
    if not len(v):
        return b""
    scale = np.sqrt(np.mean(v * v)) or 1.0
    place = np.clip((v / scale + 3) / 6 * 24, 0, 23.999)
    low, part = np.floor(place), place - np.floor(place)
    t = np.arange(note) / RATE
    fade = np.hanning(note + 2)[1:-1]
    tone = lambda p: np.sin(2 * np.pi * 220.0 * 2 ** (p[:, None] / 12) * t)
    wave = ((1 - part)[:, None] * tone(low) + part[:, None] * tone(low + 1)) * fade
    return (wave.ravel() * 12_000).astype("<i2").tobytes()


def media(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, pcm): one recording for each vector."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([render(v) for v in column(batch, "v").to_pylist()], pa.binary())], names=["id", "pcm"])

    return map_batches(vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")), kernel, "id long, pcm binary")


def fingerprints(recordings: DataFrame) -> DataFrame:
    """(id, print): the fingerprint of each recording as little-endian 32-bit integers."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [column(batch, "id"), pa.array([fingerprint(p).astype("<u4").tobytes() for p in column(batch, "pcm").to_pylist()], pa.binary())], names=["id", "print"]
        )

    return map_batches(recordings, kernel, "id long, print binary")


def search(spark: SparkSession, recordings: DataFrame, every: int = 50, most_errors: float = 0.1, least_votes: int = 2, least_overlap: int = 50) -> DataFrame:
    """Rows of two kinds. Members: (class_id, id) for each recording. Matches: (class_id of a class with a query id,
    match_class_id, offset, votes, bit_error_rate). A class is named by its smallest id."""
    prints = stage(spark, fingerprints(recordings), "prints")
    empty = F.length("print") == 0
    digest = F.when(empty, F.concat(F.lit("empty:"), F.coalesce(F.col("id").cast("string"), F.lit("")))).otherwise(F.sha2("print", 256))
    keyed = prints.withColumn("digest", digest)
    grouped = keyed.groupBy("digest").agg(F.min("id").alias("class_id"), F.first("print").alias("print"), F.max(F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False))).alias("query"))
    classes = stage(spark, grouped, "classes")

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, names, places = [], [], []
        for name, data in zip(column(batch, "digest").to_pylist(), column(batch, "print").to_pylist(), strict=True):
            p = np.frombuffer(data, "<u4")
            fresh = np.ones(len(p), bool)
            fresh[1:] = p[1:] != p[:-1]  # a held sound counts where it begins
            at = np.flatnonzero(fresh)
            keys.append(p[at].astype(np.int64))
            places.append(at)
            names += [name] * len(at)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(names, pa.string()), pa.array(np.concatenate(places).astype(np.int32))], names=["key", "name", "at"])

    full = classes.where("length(print) > 0")
    postings = map_batches(full.select("digest", "print"), split, "key long, name string, at int")
    asked = map_batches(full.where("query").select("digest", "print"), split, "key long, name string, at int").withColumnsRenamed({"name": "asker", "at": "from"})
    held = stage(spark, postings, "postings")
    # At most 100,000 integers count as heavy, whatever the number of recordings: the table of them may be broadcast.
    heavy = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(HEAVY, held.count() // 100_000))
    parts = stage(spark, heavy.select("key", F.ceil(F.col("n") / HEAVY).cast("int").alias("parts")), "heavy")
    dealt = lambda side: side.join(F.broadcast(parts), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = dealt(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    held = dealt(held).withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")).drop("parts")
    votes = asked.join(held, ["key", "part"]).where(F.col("asker") != F.col("name")).groupBy("asker", "name", (F.col("at") - F.col("from")).alias("offset")).agg(F.count("*").alias("votes"))
    ranked = F.sort_array(F.collect_list(F.struct("votes", -F.abs("offset"), "offset")), asc=False)  # a pair has as many offsets as positions
    pairs = votes.where(F.col("votes") >= least_votes).groupBy("asker", "name").agg(F.slice(ranked, 1, OFFSETS).alias("best")).select("asker", "name", "best.offset", "best.votes")
    sides = full.select("digest", "class_id", "print")
    joined = pairs.join(sides.withColumnsRenamed({"digest": "asker", "class_id": "a", "print": "x"}), "asker").join(sides.withColumnsRenamed({"digest": "name", "class_id": "b", "print": "y"}), "name")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = [], []
        for k, (x, y, offsets, count) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("x", "y", "offset", "votes")), strict=True)):
            p, q = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            need = 32 * min(least_overlap, len(p), len(q))
            tried = [(wrong / bits, n, o) for o, n in zip(offsets, count, strict=True) for wrong, bits in [bit_errors(p, q, o)] if bits and bits >= need]
            if tried and (best := min(tried, key=lambda z: (z[0], -z[1], abs(z[2]), z[2])))[0] <= most_errors:
                rows.append(k)
                found.append(best)
        sides_ = [column(batch, c).take(pa.array(rows, pa.int64())) for c in ("a", "b")]
        arrays = [*sides_, pa.array([o for *_, o in found], pa.int32()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([e for e, *_ in found], pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names=["class_id", "match_class_id", "offset", "votes", "bit_error_rate"])

    schema = "class_id long, match_class_id long, offset int, votes long, bit_error_rate double"
    matches = map_batches(joined.select("a", "b", "offset", "votes", "x", "y"), verify, schema)
    members = keyed.join(classes.select("digest", "class_id"), "digest").select("class_id", "id")
    return members.unionByName(matches, allowMissingColumns=True)
