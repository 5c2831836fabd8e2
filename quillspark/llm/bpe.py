"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

The transducer reads bytes and gives for each the last token of the canonical encoding of what was read: the longest one
that fits the last token of the encoding before it. The encoding of a whole piece is read off from its end. A later token
can only start at a live cut, one behind which some token begins with the bytes read since and fits what is before the cut.
A state is the bytes from the first live cut on, the live cuts, and for each the token before it; tokens that the same few
later tokens fit count as one, so that most states are met again. The tokens that all live cuts share can never change, so
a stream emits them: lookahead is bounded by the longest token. States and arcs are made when first met and kept in tables
of bounded size.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
import re
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import column, held, map_batches, text_of
from .words import SPACE, PieceTable, scan

#: Matches of the pattern, transducer states, judged token pairs and pieces of text that a worker remembers before it starts afresh.
MEMO_MATCHES, MAX_STATES, MAX_FITS, MAX_PIECES = 60_000, 80_000, 200_000, 1_000_000
#: Left neighbours are told apart by what fits them where so few tokens can follow, else by name; the left neighbour of the first token.
FEW, START = 32, -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {v: k for k, v in ranks.items()}
        self.sizes = {v: len(k) for k, v in ranks.items()}
        self.order, self.beyond = sorted(ranks), b"\xff" * max(self.sizes.values())
        self.fits: dict[tuple[int, int], bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple[bytes, tuple[int, ...], tuple[int, ...]]] = []
        self.newest: list[int] = []  # of each state the last token of what was read
        self.arcs: dict[int, int] = {}  # state | byte to state; states are numbered in steps of 256
        self.stands: dict[tuple[int, bytes], int | None] = {}
        self.classes: dict[int, int] = {}
        self._state((b"", (0,), (START,)))

    def _state(self, key: tuple) -> int:
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.states) << 8
            self.states.append(key)
            self.newest.append(key[2][-1])
        return got

    def _parts(self, piece: bytes, least: int = 1) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def merge(self, piece: bytes) -> list[int]:
        """Merges by rank, lowest first and leftmost among equals: the definition that the transducer is compiled from."""
        return [self.ranks[p] for p in self._parts(piece)]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a single byte."""
        got = self.splits.get(token)
        if got is None and len(piece := self.tokens[token]) > 1:
            parts = self._parts(piece, 2)
            got = self.splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return got

    def _fit(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes together is just these tokens. Both are undone merge by merge, the
        later one first: they fit if no two tokens that ever meet at the boundary would have merged before."""
        got = self.fits.get((left, right))
        if got is None:
            if left == START:
                got = self.merge(self.tokens[right]) == [right]
            else:
                got, a, b, bound, tokens, ranks = None, left, right, 1 << 60, self.tokens, self.ranks
                while got is None:
                    if ranks.get(tokens[a] + tokens[b], 1 << 60) < bound:
                        got = False
                    else:
                        sa, sb = self._split(a), self._split(b)
                        if sa is None and sb is None:
                            got = True
                        elif sb is None or sa is not None and a > b:
                            bound, a = a, sa[1]
                        else:
                            bound, b = b + 1, sb[0]
            if len(self.fits) >= MAX_FITS:
                self.fits.clear()
            self.fits[left, right] = got
        return got

    def _stand(self, left: int, begun: bytes) -> int | None:
        """The token that stands for `left` before a token that begins with these bytes and goes on: the first one met that
        the same such tokens fit. None if none fits, so that no token can start at this cut any more."""
        got = self.stands.get((left, begun), START - 1)
        if got == START - 1:
            first, end = bisect_right(self.order, begun), bisect_right(self.order, begun + self.beyond)
            if end - first > FEW:
                got = left
            else:
                fitting = 0
                for t in self.order[first:end]:
                    fitting = fitting << 1 | self._fit(left, self.ranks[t])
                # Which tokens they are, how many, and which of them fit, in one number.
                got = self.classes.setdefault(((first << 32) + end) << FEW | fitting, left) if fitting else None
            if len(self.stands) >= MAX_FITS:
                self.stands.clear()
                self.classes.clear()
            self.stands[left, begun] = got
        return got

    def _step(self, state: int, byte: int) -> int:
        tail, cuts, lefts = self.states[state >> 8]
        text = tail + bytes((byte,))
        ranks, fits, stands = self.ranks, self.fits, self.stands
        for cut, left in zip(cuts, lefts):
            token = ranks.get(text[cut:])
            if token is not None:
                fit = fits.get((left, token))
                if fit or fit is None and self._fit(left, token):
                    break
        else:
            raise ValueError("the ranks have no token for a byte, or tokens that merges do not reach")
        live, kept = [], []
        for cut, left in zip(cuts, lefts):
            begun = text[cut:]
            stand = stands[left, begun] if (left, begun) in stands else self._stand(left, begun)
            if stand is not None:
                live.append(cut)
                kept.append(stand)
        drop = live[0] if live else len(text)
        live.append(len(text))
        kept.append(token)
        arc = self.arcs[state | byte] = self._state((text[drop:], tuple([c - drop for c in live]), tuple(kept)))
        return arc

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._clear()
        state, met, get, step = 0, [], self.arcs.get, self._step
        for byte in piece:
            state = get(state | byte) or step(state, byte)
            met.append(state)
        out, at, sizes, newest = [], len(met), self.sizes, self.newest
        while at:
            out.append(token := newest[met[at - 1] >> 8])
            at -= sizes[token]
        out.reverse()
        return out

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in parts, each as soon as no later byte can change it."""
        state, at, chains = 0, 0, {0: ()}  # the pending tokens before each live cut
        for part in pieces:
            for byte in part:
                state = self.arcs.get(state | byte) or self._step(state, byte)
                at, token = at + 1, self.newest[state >> 8]
                chains[at] = (*chains[at - self.sizes[token]], token)
                tail, cuts, _ = self.states[state >> 8]
                chains = {c: chains[c] for c in [at - len(tail) + cut for cut in cuts]}
                shared = os.path.commonprefix(list(chains.values()))
                if shared:
                    chains = {c: chain[len(shared) :] for c, chain in chains.items()}
                    yield from shared
        yield from chains[at]


_RUN = re.compile(r"\s\s")


class Encoder:
    """Text to little-endian unsigned 32-bit ids. Where no two white-space characters meet, text is cut before each
    space: no match of the pattern crosses such a cut, so equal pieces have equal ids and are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine, self.pattern = Transducer(ranks), regex.compile(pattern)
        self.matches: dict[str, bytes] = {}
        self.table = PieceTable(self._spaced, MAX_PIECES)  # pieces by what follows their space
        size = max(ranks.values()) + 1
        tokens = [self.machine.tokens.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _match(self, match: str) -> bytes:
        ids = self.machine.encode(match.encode())
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(match) <= 64:
            if len(self.matches) >= MEMO_MATCHES:
                self.matches.clear()
            self.matches[match] = got
        return got

    def encode(self, text: str) -> bytes:
        get, new = self.matches.get, self._match
        return b"".join([get(m) or new(m) for m in self.pattern.findall(text)])

    def _spaced(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = [self.encode(" " + p.decode()) for p in pieces]
        return np.frombuffer(b"".join(coded), "<u4"), np.array([len(c) // 4 for c in coded], np.int64)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """encode() of each text, by pieces where a text can be cut."""
        for s in scan(texts, SPACE, cased=True):
            inner = np.ones(len(s.starts), bool)
            inner[s.splits[:-1][np.diff(s.splits) > 0]] = False  # first pieces have no space before them
            which = np.flatnonzero(inner)
            ids, lengths = self.table.ids(s, which)
            cut = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(inner)))[s.splits]].tolist()
            for k, (a, b) in enumerate(zip(s.offsets.tolist(), s.offsets[1:].tolist())):
                raw = s.data[a:b].tobytes()
                if not raw or raw[0] == 32 or raw[-1] == 32 or _RUN.search(text := raw.decode()):
                    yield self.encode(raw.decode())
                else:
                    yield self.encode(text.partition(" ")[0]) + ids[cut[k] : cut[k + 1]].tobytes()

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.begins[at] - (ends - lengths), lengths) + np.arange(total)].tobytes()


class Utf8Stream:
    """Incremental UTF-8 decoder: the state is the begun but unfinished character at the end of what was read."""

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many trailing bytes begin a character that needs more bytes."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if need > back else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        keep = self.unfinished(data)
        self.pending = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def encoder(path: str, pattern: str) -> Encoder:
    # The memos hold many small objects and no cycles: full collections would walk them again and again.
    gc.set_threshold(200_000, 50, 100)
    return held("bpe", (path, pattern), lambda: Encoder(load_ranks(path), pattern))


def encode_decode(docs: DataFrame, path: str, pattern: str, step: int = 1 << 16, only: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit), n_tokens, decoded (text), and the hex SHA-256
    of the ids and of the decoded bytes; with `only`, these columns alone leave the workers. Null text is empty text. Other
    columns of docs are ignored. No shuffle."""
    fields = {"doc_id": "long", "ids": "binary", "n_tokens": "long", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    names = [n for n in fields if not only or n in only]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(path, pattern)
        rows: list[tuple] = []
        for ids in coder.encode_all(column(batch, "text")):
            machine, digest, out = Utf8Stream(), hashlib.sha256(), []
            for at in range(0, len(ids), 4 * step):
                part = coder.decode(ids[at : at + 4 * step])
                digest.update(part)
                out.append(machine.feed(part))
            out.append(machine.finish())
            row = {"ids": ids, "n_tokens": len(ids) // 4, "decoded": "".join(out), "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": digest.hexdigest()}
            rows.append(tuple(row[n] for n in names if n != "doc_id"))
        made = dict(zip((n for n in names if n != "doc_id"), zip(*rows, strict=True), strict=True))
        types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([column(batch, n) if n == "doc_id" else pa.array(made[n], types[fields[n]]) for n in names], names=names)

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_batches(source, kernel, ", ".join(f"{n} {fields[n]}" for n in names), holds="bpe")
