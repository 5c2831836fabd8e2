"""Token ids in a binary format compressed by Re-Pair grammars, with random access by document.

Documents are dealt into shards by ranges of doc_id, sorted, encoded with the tokenizers library, and closed by an end
id. A shard is written in blocks of about `block` ids (a longer document is a block of its own). In each block pairs of
neighbouring symbols that occur LEAST times or more are replaced by new symbols until there are none: a round counts
the pairs, and where two overlap the more frequent one is replaced, so that symbols of one round become material of the
next. With LEAST = 3 every rule pays for its bits. A pair that occurs fewer times can only lose occurrences, so a round
looks at the frequent pairs and those beside new symbols alone. A pair whose left symbol ends with the end id is never
replaced: documents stay separate runs of symbols, and the rules' expansion lengths turn any position of a document
into a position in the grammar.

Block format, little-endian: magic 'RPG2'; base (first new symbol), number of rules, rounds, documents, symbols, bits a
symbol, bytes a length (2 or 4); the first rule after each round as u32; the rules' left and right symbols; their
expansion lengths; the first symbol of each document as u32; the symbols. Symbols of up to 16 bits are u16; each further
bit lies in a plane of its own, packed eight to a byte. Blocks are rows of a Parquet dataset (shard, block, first id of the block within
the shard, document ids, payload), so any store that Spark can write holds them, and a lost task writes its shard again.

Defined cases: null text is empty (its only id is the end); null doc_ids come first, equal doc_ids in the order in which they were read;
strings of the tokenizer's added tokens have the ids that the library gives them; an empty table gives an empty dataset.
Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, column, drop_held, held, stage, text_of
from .words import PieceTable, scan

BLOCK_IDS, LEAST = 1 << 20, 3
#: Bytes of text for each shard that the documents are dealt into; a shard is a task's work.
SHARD_BYTES = 32 << 20
_HEAD = struct.Struct("<4sIIIIIII")

#: The pre-tokenizer pattern and the normalizers for which pieces may be asked for one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def _cuts() -> np.ndarray:
    """(256, 256): between which bytes that pattern always ends a match. These are ASCII letters, digits and marks beside
    a byte of another kind, and digits beside digits; not what follows an apostrophe, which may begin a short form, and
    nothing beside a byte of a longer character."""
    kind = np.full(256, 3)
    kind[48:58] = 2
    kind[65:91] = kind[97:123] = 1
    kind[128:] = 0
    out = (kind[:, None] != kind[None]) | ((kind[:, None] == 2) & (kind[None] == 2))
    out &= (kind[:, None] > 0) & (kind[None] > 0)
    out[39] = False
    return out


class WordCoder:
    """The tokenizers library, asked once for each piece of text that its pre-tokenizer always parts from what is around
    it (see `_cuts`); the tokenizer lower-cases, so pieces that are equal up to the case of A-Z have equal ids. Texts
    with an added token, and all texts if the tokenizer is of another kind, go to the library whole."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        # A task has one core: threads of the library beside it only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.end = Tokenizer.from_file(path), struct.pack("<I", end)
        parts = json.loads(self.tokenizer.to_str())
        added = [t["content"].encode() for t in parts["added_tokens"]]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        splits = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        kinds = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        self.by_pieces = kinds == NORMALIZERS and splits[0].get("pattern") == {"Regex": WORD_PATTERN} and splits[0].get("behavior") == "Removed" and all(not p.get("add_prefix_space") for p in splits[1:])
        self.bytewise = self.by_pieces and [p["type"] for p in splits[1:]] == ["ByteLevel"]
        self.table, self.cuts = PieceTable(self._pieces), _cuts()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._joined(self._ids([p.decode() for p in pieces]))

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _ask, for pieces between cuts. ASCII letters alone are one match, which the normalizers only lower-case and
        the byte map leaves as it is: they go to the library's model at once."""
        if not self.bytewise:
            return self._ask(pieces)
        tokenize = self.tokenizer.model.tokenize
        coded = [[t.id for t in tokenize(p.decode().lower())] if p.isalpha() else None for p in pieces]
        rest = [k for k, ids in enumerate(coded) if ids is None]
        for k, ids in zip(rest, self._ids([pieces[k].decode() for k in rest]), strict=True):
            coded[k] = ids
        return self._joined(coded)

    @staticmethod
    def _joined(coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum())), lengths

    def _whole(self, text: bytes) -> bytes:
        return self._ask([text])[0].astype("<u4").tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, with the end."""
        for s in scan(texts, cuts=self.cuts):
            # Texts of a scan touch, so a token found across two of them is checked again in the text alone.
            odd = not self.by_pieces or self.added is not None and self.added.search(s.data.tobytes())
            ids, lengths = self.table.ids(s, np.arange(len(s.starts)))
            cut = np.concatenate(([0], np.cumsum(lengths)))[s.splits].tolist()
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                if odd:
                    text = s.data[s.offsets[k] : s.offsets[k + 1]].tobytes()
                    if not self.by_pieces or self.added.search(text):
                        yield self._whole(text) + self.end
                        continue
                yield ids[a:b].tobytes() + self.end


def coder(path: str, end: int) -> WordCoder:
    return held("words", (path, end), lambda: WordCoder(path, end))


def _bits(most: int) -> int:
    return max(16, int(most).bit_length())


def compress(ids: np.ndarray, end: int, least: int = LEAST) -> tuple[int, list[np.ndarray], np.ndarray]:
    """(base, rules (n, 2) of each round, symbols) of ids: no pair that may be replaced occurs `least` times."""
    base = int(max(ids.max(initial=0), end)) + 1
    s, rules, number = ids.astype(np.uint32), [], base
    closed = np.zeros(base, bool)  # symbols whose last id is the end
    closed[end] = True
    alive = ~closed[ids.astype(np.int64)]  # places whose pair may still be frequent
    alive[-1:] = False
    while len(at := np.flatnonzero(alive)):
        width, place = np.uint64((number - 1).bit_length()), np.uint64(len(s).bit_length())
        pair = (s[at].astype(np.uint64) << width) | s[at + 1]
        if 2 * int(width) + int(place) <= 64:
            # Pair and place in one number: a sort gathers the places of each pair, in order.
            keys = np.sort((pair << place) | at.astype(np.uint64))
            where, pair = (keys & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64), keys >> place
        else:
            order = np.argsort(pair, kind="stable")
            where, pair = at[order], pair[order]
        edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        count = np.diff(np.append(edge, len(pair)))
        many = count >= least
        live = np.repeat(many, count)
        alive[where[~live]] = False
        if not many.any():
            break
        where, count, pair = where[live], count[many], pair[edge[many]]
        row = np.repeat(np.arange(len(count)), count)
        # Of overlapping pairs the more frequent goes first; a run of one symbol is taken from the left.
        rank = np.empty(len(count), np.int32)
        rank[np.lexsort((pair, count))] = np.arange(1, len(count) + 1)
        weight = np.zeros(len(s) + 2, np.int32)
        weight[where + 1] = own = rank[row]
        before, after = weight[where], weight[where + 2]
        take = (own >= before) & (own >= after)
        blocked = np.bincount(row[~take], minlength=len(count))
        if (own == before).any():
            run = np.concatenate(([True], (np.diff(where) > 1) | (row[1:] != row[:-1])))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            take &= (np.arange(len(where)) - begin) % 2 == 0
        used = np.bincount(row[take], minlength=len(count))
        enough = used >= least
        # What a more frequent neighbour kept back is counted again; a pair that is short without that never gets there.
        alive[where[(used + blocked < least)[row]]] = False
        take &= enough[row]
        if not take.any():
            continue
        where, row, chosen = where[take], (np.cumsum(enough) - 1)[row[take]], pair[enough]
        new = np.stack([chosen >> width, chosen & ((np.uint64(1) << width) - np.uint64(1))], 1).astype(np.uint32)
        s[where] = number + row
        closed = np.concatenate((closed, closed[new[:, 1]]))
        number += len(new)
        rules.append(new)
        keep = np.ones(len(s), bool)
        keep[where + 1] = False
        s, alive = s[keep], alive[keep]
        # Only pairs with a new symbol have to be looked at anew.
        fresh = np.sort(where)
        fresh -= np.arange(len(fresh))
        fresh = np.concatenate((fresh, fresh[fresh > 0] - 1))
        alive[fresh] = ~closed[s[fresh]]
        alive[-1] = False
    return base, rules, s


def lengths_of(base: int, rules: list[np.ndarray]) -> np.ndarray:
    """Expansion lengths of all symbols, ids first. The rules of a round refer to ids and to earlier rounds."""
    out = np.ones(base, np.int64)
    for part in rules:
        out = np.concatenate((out, out[part[:, 0]] + out[part[:, 1]]))
    return out


def _pack(values: np.ndarray, bits: int) -> bytes:
    planes = [np.packbits((values >> np.uint32(k)) & np.uint32(1), bitorder="little").tobytes() for k in range(16, bits)]
    return b"".join(((values & np.uint32(0xFFFF)).astype("<u2").tobytes(), *planes))


def _packed_size(n: int, bits: int) -> int:
    return 2 * n + (bits - 16) * ((n + 7) // 8)


def _unpack(data: memoryview, n: int, bits: int, first: int, to: int) -> np.ndarray:
    """Values first .. to-1 of n packed ones."""
    out = np.frombuffer(data, "<u2", to - first, 2 * first).astype(np.uint32)
    low, size = first // 8, (n + 7) // 8
    for k in range(bits - 16):
        plane = np.frombuffer(data, np.uint8, -(-to // 8) - low, 2 * n + k * size + low) if to > first else np.zeros(0, np.uint8)
        out |= np.unpackbits(plane, bitorder="little")[first - 8 * low : to - 8 * low].astype(np.uint32) << np.uint32(16 + k)
    return out


def write_block(ids: np.ndarray, sizes: np.ndarray, end: int) -> bytes:
    """One block: the ids of whole documents, sizes[i] ids each."""
    base, rounds, s = compress(ids, end)
    lengths = lengths_of(base, rounds)
    ends = np.cumsum(lengths[s])
    starts = np.searchsorted(ends, np.cumsum(sizes) - sizes, side="right")
    rules = np.concatenate(rounds) if rounds else np.zeros((0, 2), np.uint32)
    bits, long = _bits(base + len(rules) - 1), 2 if lengths.max(initial=0) < 1 << 16 else 4
    head = _HEAD.pack(b"RPG2", base, len(rules), len(rounds), len(sizes), len(s), bits, long)
    marks = np.cumsum([len(r) for r in rounds]).astype("<u4")
    return b"".join((head, marks.tobytes(), _pack(rules[:, 0], bits), _pack(rules[:, 1], bits), lengths[base:].astype(f"<u{long}").tobytes(), starts.astype("<u4").tobytes(), _pack(s, bits)))


class Block:
    """Random access to a written block."""

    def __init__(self, payload: bytes):
        magic, self.base, n, rounds, self.documents, self.size, self.bits, long = _HEAD.unpack_from(payload)
        if magic != b"RPG2":
            raise ValueError("not a grammar block")
        data, at = memoryview(payload), _HEAD.size
        marks = np.frombuffer(data, "<u4", rounds, at)
        at += 4 * rounds
        side, sides = _packed_size(n, self.bits), []
        for _ in range(2):
            sides.append(_unpack(data[at : at + side], n, self.bits, 0, n))
            at += side
        self.rules = np.split(np.stack(sides, 1), marks[:-1]) if rounds else []
        self.lengths = np.concatenate((np.ones(self.base, np.int64), np.frombuffer(data, f"<u{long}", n, at).astype(np.int64)))
        at += long * n
        self.starts = np.frombuffer(data, "<u4", self.documents, at).astype(np.int64)
        self.packed, self._expansions = data[at + 4 * self.documents :], None

    def symbols(self, first: int = 0, to: int | None = None) -> np.ndarray:
        return _unpack(self.packed, self.size, self.bits, first, self.size if to is None else to)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols, gathered from the expansions of all symbols, which are made once, round by round."""
        if self._expansions is None:
            flat, begins, made = np.arange(self.base, dtype=np.uint32), np.cumsum(self.lengths) - self.lengths, self.base
            for part in self.rules:
                flat = np.concatenate((flat, _gather(flat, begins, self.lengths, part.ravel())))
                made += len(part)
            self._expansions = flat, begins
        return _gather(*self._expansions, self.lengths, symbols)

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols())

    def sizes(self) -> np.ndarray:
        whole = self.lengths[self.symbols()]
        return np.add.reduceat(whole, self.starts) if self.documents else whole[:0]

    def document(self, k: int, first: int = 0, count: int | None = None) -> np.ndarray:
        """Ids first .. first+count-1 of document k; only the symbols that hold them are expanded."""
        s = self.symbols(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < self.documents else self.size)
        ends = np.cumsum(self.lengths[s])
        last = int(ends[-1]) if count is None else min(first + count, int(ends[-1]))
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = (int(np.searchsorted(ends, x, side="right")) for x in (first, last - 1))
        skip = first - (int(ends[a - 1]) if a else 0)
        return self._expand(s[a : b + 1])[skip : skip + last - first]


def _gather(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    n = lengths[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(begins[symbols] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int = 2, block: int = BLOCK_IDS, path_label: str = "grammar") -> DataFrame:
    """Encode and write docs; the dataset of blocks, read back: shard, block, first, n_ids, doc_ids, payload. The number
    of shards follows the bytes of text; ids that repeat, and null ones, may spread over several shards."""
    bound_batches(spark)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), F.monotonically_increasing_id().alias("place"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    dealt = source.repartitionByRange(shards, "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        drop_held("words")
        words, shard = coder(tokenizer, end), TaskContext.get().partitionId()
        coded_docs, ids, size, number, first = [], [], 0, 0, 0

        def flush():
            data = np.frombuffer(b"".join(coded_docs), "<u4")
            payload = write_block(data, np.array([len(x) // 4 for x in coded_docs]), end)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["shard", "block", "first", "n_ids", "doc_ids", "payload"],
            )

        for batch in batches:
            for doc, coded in zip(column(batch, "doc_id").to_pylist(), words.encode(column(batch, "text")), strict=True):
                if coded_docs and size + len(coded) // 4 > block:
                    yield flush()
                    coded_docs, ids, first, number, size = [], [], first + size, number + 1, 0
                coded_docs.append(coded)
                ids.append(doc)
                size += len(coded) // 4
        if coded_docs:
            yield flush()

    return stage(spark, dealt.mapInArrow(run, "shard int, block int, first long, n_ids long, doc_ids array<long>, payload binary"), path_label)


def read(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """One row per document of a written dataset: doc_id, start, ids (little-endian unsigned 32-bit)."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    starts, total = {}, 0
    for r in sizes:  # one number a shard: as many as the writer had partitions
        starts[r.shard] = total
        total += r.n
    shared = spark.sparkContext.broadcast(starts)

    def run(batches):
        for batch in batches:
            for shard, first, docs, payload in zip(*(column(batch, c).to_pylist() for c in ("shard", "first", "doc_ids", "payload")), strict=True):
                b = Block(payload)
                ids = b.ids().astype("<u4")
                ends = np.cumsum(b.sizes())
                starts = ends - b.sizes()
                parts = [ids[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + shared.value[shard] + first), pa.array(parts, pa.binary())], names=["doc_id", "start", "ids"])

    return blocks.select("shard", "first", "doc_ids", "payload").mapInArrow(run, "doc_id long, start long, ids binary")


def digests(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    return read_back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
