"""Byte-level BPE on padded numpy matrices.

Texts are cut by the tokenizer's pattern. Pieces not met before are put, by length, into
padded matrices of token ids. In each round every row merges its leftmost pair of
minimum rank; ranks of pairs are looked up in a hash table of all pairs that make a
token, and finished rows are taken out of the matrix. A piece of more than ``WIDEST``
bytes would make a round of its own length for every byte, so it follows the same rule
(minimum rank, then leftmost) with a heap.

Ids are held as little-endian unsigned 32-bit numbers in a binary column. Encoding and
decoding are maps over rows: nothing is shuffled, and a long text is one row's work.

Defined results: a null text is encoded like an empty one, to no ids; decoding gives the
bytes that were encoded; null ids decode to null; columns that are not named pass
through, and a column that is already called ``ids`` or ``decoded`` is replaced.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemark.llm.common import prepare, slices, tidy

NONE = np.int64(1 << 40)
WIDEST = 256
#: Pieces remembered by a task; beyond it the memory starts afresh.
REMEMBERED = 200_000
#: Cells of one matrix.
CELLS = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Bpe:
    """Ranks of tokens, a hash table of the pairs that make a token, and known pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self._hash(pairs)
        self.pieces: dict[str, bytes] = {}

    def _hash(self, pairs: dict[int, int]) -> None:
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, NONE, dtype=np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, slot in zip(keys.tolist(), self._slots(keys).tolist()):
            while self.keys[slot] != -1:
                slot = (slot + 1) & int(self.mask)
            self.keys[slot], self.values[slot] = key, pairs[key]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it makes no token or has no right side (-1)."""
        keys = ((left << 32) | right).ravel()
        keys[(right < 0).ravel()] = -2
        slots = self._slots(keys)
        out = np.full(len(keys), NONE, dtype=np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[slots]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slots[hit]]
            on = ~hit & (there != -1)
            open_, slots = open_[on], (slots[on] + 1) & self.mask
        return out.reshape(left.shape)

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of about one length."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        flat = self.single[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)]
        ids = flat.reshape(-1, width)
        ids[np.arange(width) >= sizes[:, None]] = -1
        ranks = np.full((len(pieces), width), NONE, dtype=np.int64)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        out: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        columns = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            own = np.arange(len(rows))
            least = ranks[own, at]
            done = least == NONE
            if done.any():
                for row, line in zip(rows[done].tolist(), ids[done]):
                    out[row] = line[line >= 0]
                go = ~done
                rows, ids, ranks, at, least = rows[go], ids[go], ranks[go], at[go], least[go]
                own = np.arange(len(rows))
                if not len(rows):
                    break
            source = columns + (columns > at[:, None])
            source[:, -1] = np.minimum(source[:, -1], len(columns) - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            ids[own, at] = least
            ids[:, -1], ranks[:, -1] = -1, NONE
            after = np.minimum(at + 1, len(columns) - 1)
            right = np.where(at + 1 < len(columns), ids[own, after], -1)
            ranks[own, at] = self.pair_ranks(ids[own, at], right)
            inner = np.flatnonzero(at > 0)
            before = at[inner] - 1
            ranks[inner, before] = self.pair_ranks(ids[inner, before], ids[inner, at[inner]])
            used = int((ids >= 0).sum(axis=1).max())
            if used < len(columns) // 2:
                ids, ranks, columns = ids[:, :used], ranks[:, :used], columns[:used]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        rank_of = lambda a, b: self.ranks.get(self.tokens[ids[a]] + self.tokens[ids[b]])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1)
                if (r := rank_of(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            other = after[at]
            if ids[at] != left or other < 0 or ids[other] != right:
                continue
            ids[at], ids[other] = rank, -1
            after[at] = after[other]
            if after[at] >= 0:
                before[after[at]] = at
            for a in (before[at], at):
                if a >= 0 and after[a] >= 0 and (r := rank_of(a, after[a])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[after[a]]))
        return np.array([i for i in ids if i >= 0], dtype=np.int64)

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces into the memory."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                self.pieces[piece] = rank.to_bytes(4, "little")
            elif len(raw) > WIDEST:
                self.pieces[piece] = self.merge_long(raw).astype("<u4").tobytes()
            else:
                by_width.setdefault(-(-len(raw) // 4) * 4, []).append((piece, raw))
        for width, own in by_width.items():
            height = max(1, CELLS // width)
            for begin in range(0, len(own), height):
                part = own[begin:begin + height]
                for (piece, _), ids in zip(part, self.merge_rows([raw for _, raw in part])):
                    self.pieces[piece] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        self.learn(set().union(*cut).difference(self.pieces))
        known = self.pieces.__getitem__
        return [b"".join(map(known, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return batch.set_column(batch.schema.get_field_index(name), name, values)


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns and ``ids``. ``path`` is a rank file that every executor has."""
    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in slices(batches):
            ids = bpe.encode(batch.column("text").to_pylist())
            yield _with_column(batch, "ids", pa.array(ids, pa.binary()))

    prepare(documents.sparkSession)
    out = documents.withColumn("ids", F.lit(None).cast("binary"))
    return out.mapInArrow(run, out.schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns and ``decoded``, the bytes that the ids stand for."""
    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in slices(batches, "ids"):
            raw = [None if i is None else bpe.decode(i) for i in batch.column("ids").to_pylist()]
            yield _with_column(batch, "decoded", pa.array(raw, pa.binary()))

    prepare(encoded.sparkSession)
    out = encoded.withColumn("decoded", F.lit(None).cast("binary"))
    return out.mapInArrow(run, out.schema)


def round_trip(documents: DataFrame, path: str, pattern: str, ids: str = "ids", same: str = "decodes") -> DataFrame:
    """All columns, the ids, and whether they decode to the bytes of the text; one Python worker a task.

    Columns that are already called ``ids`` or ``same`` are replaced.
    """
    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = bpe.encode(texts)
            right = [bpe.decode(i) == (t or "").encode("utf-8", "surrogatepass") for i, t in zip(found, texts)]
            batch = _with_column(batch, ids, pa.array(found, pa.binary()))
            yield _with_column(batch, same, pa.array(right, pa.bool_()))

    prepare(documents.sparkSession)
    out = documents.withColumn(ids, F.lit(None).cast("binary")).withColumn(same, F.lit(None).cast("boolean"))
    return out.mapInArrow(tidy(run, lambda: tokenizer(path, pattern).pieces.clear()), out.schema)
