"""Near-duplicate components by SetSketch registers.

1. One pass makes each document's set of five-word shingle hashes, a 128-bit signature of that set and M SetSketch
   registers: the minimum of M exponential variables over the set, on a logarithmic scale of base B, truncated to
   0..Q+1. Registers of a union are maxima of registers, so sketches merge.
2. Documents with equal sets form one class, grouped by signature with partial aggregation: a group of any number of
   copies costs one row a task. Later steps see one row per class.
3. Bands of registers make candidate classes. The classes of a band value are compared first against its most central
   class alone, the one whose band values have the most classes together (a star): a family's source keeps the
   registers that most of its copies have, so one star gathers the copies that are near it.
4. A candidate's Jaccard similarity is estimated jointly from both sketches and both set sizes by maximum likelihood;
   pairs whose estimate is far below the threshold, or whose sizes rule the threshold out, go. The rest are verified
   on full sets, which are computed again for those classes alone (a Bloom filter of bounded size picks them out).
5. Band values that still have several components are compared block by block. From registers, each block pair names
   its classes that have a likely partner in another component; then their full sets are brought together once a
   block, all cross-component pairs of a block pair are verified there by one matrix product, and only links that join
   two components leave it. So rows follow the classes, not their pairs, and no candidate is dropped.
6. Components: alternating large-star and small-star over staged tables until nothing changes.

Defined cases: null text is empty; documents without words have an empty set, no class mates, and are their own
component. Null ids take part in sets and components but never name one while the component has another id. Rows that repeat an id are
rows of their own. Empty input gives empty output. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, discard, map_batches, stage, text_of
from .words import mix64, scan, shingles

#: SetSketch parameters: registers, base, rate, largest value.
M, BASE, RATE, Q = 100, 1.001, 20.0, (1 << 16) - 2
#: Registers a band from a threshold on: bands miss about 8 in a million pairs at 0.85 by fives, 2 at 0.80 by fours.
ROWS = ((0.85, 5), (0.75, 4), (0.6, 2), (0.0, 1))
#: Classes and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Shingles that a matrix product takes at a time.
COLUMNS = 4096
_MULTIPLIERS = np.random.default_rng(9).integers(0, 1 << 63, size=M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rows_of(threshold: float) -> int:
    return next(rows for least, rows in ROWS if threshold >= least)


def margin(threshold: float) -> float:
    """How far below the threshold an estimate may lie and still be verified: five standard errors, 0.18 at least."""
    return max(0.18, 5 * float(np.sqrt(threshold * (1 - threshold) / M)))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (n, M) of non-empty sets of mixed 64-bit hashes."""
    out = np.empty((len(sets), M), np.uint16)
    if not sets:
        return out
    lengths = np.array([len(s) for s in sets])
    at = 0
    while at < len(sets):
        to = at + 1
        while to < len(sets) and lengths[at : to + 1].sum() <= 1 << 15:
            to += 1
        flat = np.concatenate(sets[at:to])
        begins = np.concatenate(([0], np.cumsum(lengths[at:to])))[:-1]
        least = np.empty((to - at, M), np.uint64)
        for k in range(M):
            least[:, k] = np.minimum.reduceat(flat * _MULTIPLIERS[k], begins)
        # The least of n uniform values is, through -log(1-u)/RATE, the least of n exponential ones.
        u = (least.astype(np.float64) + 0.5) / 2.0**64
        value = np.floor(1.0 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
        out[at:to] = np.clip(value, 0, Q + 1).astype(np.uint16)
        at = to
    return out


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1.0) / BASE) / np.log(BASE)


def estimate(above: np.ndarray, below: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs by maximum likelihood, from how many registers of a are above, below or equal to
    those of b and from both set sizes: the log likelihood is concave, so a ternary search finds it."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def likelihood(j):
        up, down = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
        return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1.0 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(45):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        better = likelihood(a) < likelihood(b)
        low, high = np.where(better, a, low), np.where(better, high, b)
    return (low + high) / 2


def signatures(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits of each non-empty set that depend on the set alone: two independent sums of mixed hashes."""
    if not sets:
        return []
    flat, begins = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = [np.add.reduceat(mix64(flat ^ np.uint64(salt)), begins) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    data = np.stack(out, 1).astype(">u8").tobytes()
    return [data[k : k + 16] for k in range(0, len(data), 16)]


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, node, registers) of docs (doc_id, mark, text)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, signs, registers = [], [], []
        for s in scan(column(batch, "text")):
            sets = list(shingles(s))
            full = [x for x in sets if len(x)]
            rows = zip(signatures(full), sketch(full).astype("<u2"), strict=True)
            for x in sets:
                sign, row = next(rows) if len(x) else (None, None)
                sizes.append(len(x))
                signs.append(sign)
                registers.append(None if row is None else row.tobytes())
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), column(batch, "mark"), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.array(registers, pa.binary())], names=["doc_id", "mark", "n", "node", "registers"]
        )

    return map_batches(docs, kernel, "doc_id long, mark long, n long, node binary, registers binary")


def _bit_positions(nodes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two Bloom positions from the halves of 16-byte signatures, as (n, 2) big-endian words."""
    return [nodes[:, k] % np.uint64(bits) for k in (0, 1)]


def _nodes(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), ">u8").astype(np.uint64).reshape(-1, 2)


def _bloom(wanted: DataFrame) -> np.ndarray:
    """Bloom filter of the nodes: at most 2**27 bits (16 MB), whatever their number."""
    count = wanted.count()
    bits = 1 << max(16, min(27, (24 * max(1, count)).bit_length()))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.unique(np.concatenate(_bit_positions(_nodes(column(batch, "node").to_pylist()), bits)))
        word = (at >> np.uint64(6)).astype(np.int64)
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begins)
        return pa.RecordBatch.from_arrays([pa.array(word[begins]), pa.array(value.view(np.int64))], names=["word", "value"])

    out = np.zeros(bits >> 6, np.uint64)
    rows = map_batches(wanted, kernel, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    out[rows["word"].to_numpy(np.int64)] = rows["value"].to_numpy(np.int64).view(np.uint64)
    return out


def _sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, members): the full sets of the wanted classes (staged), once each."""
    shared = spark.sparkContext.broadcast(_bloom(wanted))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        bloom, kept = shared.value, {}
        bits = len(bloom) << 6
        for s in scan(column(batch, "text")):
            sets = [x for x in shingles(s) if len(x)]
            if sets:
                signs = signatures(sets)
                there = np.ones(len(sets), bool)
                for at in _bit_positions(_nodes(signs), bits):
                    there &= (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                # Copies within a batch go here, the others in the aggregation.
                kept.update((signs[k], sets[k].tobytes()) for k in np.flatnonzero(there).tolist())
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.binary())], names=["node", "members"])

    found = map_batches(docs, kernel, "node binary, members binary").groupBy("node").agg(F.first("members").alias("members"))
    return stage(spark, found.join(wanted, "node", "left_semi"), "sets")


def _estimated(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, n_a, n_b, r_a, r_b) whose joint estimate is not far below the threshold."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ra, rb = (np.frombuffer(b"".join(column(batch, c).to_pylist()), "<u2").reshape(-1, M) for c in ("r_a", "r_b"))
        above, below = (ra > rb).sum(1), (ra < rb).sum(1)
        j = estimate(above, below, M - above - below, *(column(batch, c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")))
        keep = pa.array(j >= threshold - margin(threshold))
        return pa.RecordBatch.from_arrays([column(batch, "a").filter(keep), column(batch, "b").filter(keep)], names=["a", "b"])

    return map_batches(pairs, kernel, "a binary, b binary")


def _verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| on full sets."""
    wanted = stage(spark, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = _sets(spark, docs, wanted)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(column(batch, "x").to_pylist(), column(batch, "y").to_pylist(), strict=True):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= percent * (len(s) + len(t) - both))
        mask = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([column(batch, "a").filter(mask), column(batch, "b").filter(mask)], names=["a", "b"])

    joined = pairs.join(sets.withColumnsRenamed({"node": "a", "members": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "members": "y"}), "b")
    links = stage(spark, map_batches(joined, kernel, "a binary, b binary"), "links")
    discard(spark, wanted, sets)
    return links


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): alternating large-star and small-star. Each round makes
    every node point at smaller ones; it ends when the set of links no longer changes, as stars."""
    edges = stage(spark, links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after_large = large.where(F.col("a") != F.col("b")).distinct()
        least = after_large.groupBy("a").agg(F.min("b").alias("m"))
        small = after_large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        nxt = stage(spark, small.where(F.col("a") != F.col("b")).distinct(), "small")
        discard(spark, edges)
        edges = nxt
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == mark:
            break
        mark = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


def _with_component(spark: SparkSession, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes with their component; the smallest member and nodes without links name themselves."""
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _blocks(members: DataFrame, fields: list[str]) -> DataFrame:
    """(place, same, left, right): the classes of each band value, dealt into blocks, block against block. `members` has
    band, place, node, n and the fields; left and right are arrays of structs of node, n and the fields."""
    size = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    dealt = members.join(members.groupBy("band").agg(F.ceil(size).cast("int").alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Dealt anew, or the blocks of a band value would be gathered where its rows met their number of blocks: in one task.
    dealt = dealt.repartition("band", "place", "block")
    blocks = dealt.groupBy("band", "place", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("node", "n", *fields)).alias("rows"))
    left = blocks.select("band", "place", "block", F.col("rows").alias("left"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"))
    joined = left.join(blocks.select("band", F.col("block").alias("other"), F.col("rows").alias("right")), ["band", "other"])
    return joined.select("band", "place", (F.col("block") == F.col("other")).alias("same"), "left", "right")


def _numbered(*sides: list[dict]) -> list[np.ndarray]:
    number = {c: i for i, c in enumerate({x["component"] for side in sides for x in side})}
    return [np.array([number[x["component"]] for x in side]) for side in sides]


def _likely(members: DataFrame, threshold: float) -> DataFrame:
    """(band, place, node): classes that have a likely partner in another component; each pair is looked at where it
    first shares a band value. `members`: band, place, node, n, component, registers."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        bands, places, nodes = [], [], []
        for band, place, same, left, right in zip(*(column(batch, c).to_pylist() for c in ("band", "place", "same", "left", "right")), strict=True):
            ra, rb = (np.frombuffer(b"".join(x["registers"] for x in side), "<u2").reshape(-1, M) for side in (left, right))
            na, nb = (np.array([x["n"] for x in side], float) for side in (left, right))
            ca, cb = _numbered(left, right)
            found: set[bytes] = set()
            for at in range(0, len(left), 64):
                rows = slice(at, at + 64)
                open_pair = (ca[rows, None] != cb[None]) & (np.minimum(na[rows, None], nb[None]) >= threshold * np.maximum(na[rows, None], nb[None]))
                if same:
                    open_pair &= np.arange(at, at + len(na[rows]))[:, None] < np.arange(len(nb))[None]
                i, j = np.nonzero(open_pair)
                if not len(i):
                    continue
                i += at
                equal = ra[i] == rb[j]
                first = equal[:, : M // rows_of(threshold) * rows_of(threshold)].reshape(len(i), -1, rows_of(threshold)).all(2).argmax(1) == place
                pick = first & (equal.sum(1) >= M * (threshold - margin(threshold)) * 0.8)
                i, j = i[pick], j[pick]
                if len(i):
                    above, below = (ra[i] > rb[j]).sum(1), (ra[i] < rb[j]).sum(1)
                    likely = estimate(above, below, M - above - below, na[i], nb[j]) >= threshold - margin(threshold)
                    found.update(left[k]["node"] for k in np.unique(i[likely]).tolist())
                    found.update(right[k]["node"] for k in np.unique(j[likely]).tolist())
            bands += [band] * len(found)
            places += [place] * len(found)
            nodes += found
        return pa.RecordBatch.from_arrays([pa.array(bands, pa.int64()), pa.array(places, pa.int32()), pa.array(nodes, pa.binary())], names=["band", "place", "node"])

    blocks = _blocks(members, ["component", "registers"])
    return map_batches(blocks, kernel, "band long, place int, node binary").distinct()


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of sorted sets, as a matrix: products over the members that both sides have."""
    flat_a, flat_b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(flat_a, flat_b)
    cells = []
    for side, flat in ((left, flat_a), (right, flat_b)):
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.searchsorted(common, flat)
        hit = common[np.minimum(at, len(common) - 1)] == flat if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        cells.append((at[hit][order], row[hit][order]))
    out = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, len(common), COLUMNS):
        wide = min(COLUMNS, len(common) - low)
        tables = []
        for side, (at, row) in zip((left, right), cells, strict=True):
            a, b = np.searchsorted(at, (low, low + wide))
            table = np.zeros((len(side), wide), np.float32)
            table[row[a:b], at[a:b] - low] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def _joining(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components: of each block pair a forest that joins what its links join. `members`: band, place, node,
    n, component, members."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [], []
        for left, right in zip(*(column(batch, c).to_pylist() for c in ("left", "right")), strict=True):
            both = intersections(*([np.frombuffer(x["members"], np.uint64) for x in side] for side in (left, right)))
            na, nb = (np.array([x["n"] for x in side]) for side in (left, right))
            ca, cb = _numbered(left, right)
            linked = (100 * both >= percent * (na[:, None] + nb[None] - both)) & (ca[:, None] != cb[None])
            parent = list(range(int(max(ca.max(), cb.max())) + 1))

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]  # noqa: B023
                    x = parent[x]  # noqa: B023
                return x

            for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
                x, y = find(int(ca[i])), find(int(cb[j]))
                if x != y:
                    parent[x] = y
                    a.append(left[i]["node"])
                    b.append(right[j]["node"])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return map_batches(_blocks(members, ["component", "members"]).select("left", "right"), kernel, "a binary, b binary")


def _starred(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Likely pairs (a, b) of pairs (a, n_a, b, n_b), which may repeat."""
    fit = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    once = pairs.where(fit).groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    registers = classes.select("node", "registers")
    joined = once.join(registers.withColumnsRenamed({"node": "a", "registers": "r_a"}), "a").join(registers.withColumnsRenamed({"node": "b", "registers": "r_b"}), "b")
    return _estimated(joined, threshold)


def _classed(spark: SparkSession, docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, mark, n, node, component) of each row of docs; node and component are null without words. `mark` is a hash
    of the text."""
    threshold = percent / 100
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    sketched = stage(spark, _sketched(source.withColumn("mark", F.xxhash64("text"))), "sketched")
    classes = stage(spark, sketched.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("registers").alias("registers")), "classes")
    rows = rows_of(threshold)
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("registers", 2 * rows * k + 1, 2 * rows)) for k in range(M // rows)))
    bands = classes.select("node", "n", F.posexplode(keys).alias("place", "band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    # Band values that only one class has make no candidates: they go before anything is written.
    bands = stage(spark, bands.join(shared, "band").select("band", "place", "node", "n", "size"), "bands")

    central = bands.join(bands.groupBy("node").agg(F.sum("size").alias("mates")), "node")
    leaders = central.groupBy("band").agg(F.max(F.struct("mates", "node", "n")).alias("lead")).select("band", F.col("lead.node").alias("a"), F.col("lead.n").alias("n_a"))
    stars = bands.join(leaders, "band").where(F.col("node") != F.col("a")).select("a", "n_a", F.col("node").alias("b"), F.col("n").alias("n_b"))
    stars = stage(spark, _starred(stars, classes, threshold), "stars")
    links = _verified(spark, source, stars, percent)
    named = stage(spark, _with_component(spark, classes, components(spark, links)), "named")

    members = bands.where("size > 2").select("band", "place", "node").join(named.select("node", "component", "n", "registers"), "node")
    open_ = members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    likely = stage(spark, _likely(members.join(open_, "band"), threshold), "likely")
    if not likely.isEmpty():
        wanted = stage(spark, likely.select("node").distinct(), "wanted")
        sets = _sets(spark, source, wanted)
        joining = stage(spark, _joining(likely.join(named.select("node", "component", "n"), "node").join(sets, "node"), percent), "joining")
        before, named = named, stage(spark, _with_component(spark, classes, components(spark, links.union(joining))), "named")
        discard(spark, wanted, sets, joining, before)
    discard(spark, bands, stars, links, likely, classes)
    return sketched.select("doc_id", "mark", "n", "node").join(named.select("node", "component"), "node", "left")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Links: 100 * |A and B| >= percent * |A or B|."""
    classed = stage(spark, _classed(spark, docs, percent), "classed")
    smallest = classed.where("node is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = classed.join(smallest, "component", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs that stay: one of each component, the one with the smallest id (a row without an id only where
    no row has one; of rows that share the id, the one whose text has the smallest hash), and every row without words."""
    classed = _classed(spark, docs, percent)
    row = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark")
    counted = classed.groupBy("component", "node", "doc_id", "mark").agg(F.count("*").alias("copies"))
    chosen = counted.where("node is not null").groupBy("component").agg(F.min(F.struct(row.alias("row"), "copies")).alias("best"))
    wordless = counted.where("node is null").select("doc_id", "mark", F.lit(1).alias("copies"))
    kept = stage(spark, chosen.select("best.row.doc_id", "best.row.mark", "best.copies").union(wordless).distinct(), "kept")
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("mark"), *(docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)))
    # Rows are told apart by id and text; where both repeat, one of the equal rows stays.
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["mark"] == kept["mark"])
    alone = rows.join(kept.where("copies = 1"), same, "left_semi")
    again = rows.join(kept.where("copies > 1"), same, "left_semi").dropDuplicates(["doc_id", "mark"])
    return alone.union(again).select(names).toDF(*docs.columns)
