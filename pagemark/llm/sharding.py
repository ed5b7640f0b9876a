"""Sharding by bytes: a minimax contiguous partition of groups of equal texts.

Groups stand in the order of the hash of their text and are never split. The capacity is
the smallest for which cutting greedily needs no more than the given number of shards; it
is found by binary search, and the order is cut there.

The driver never holds the groups. It starts with the sizes of pieces of the order that
share ``DIGITS`` hexadecimal digits, at most 16 ** DIGITS of them. On pieces a capacity
is checked twice, cutting no later than the end of a piece (if that fits, the capacity is
enough) and cutting anywhere inside one (if that doesn't fit, it is not). While neither
decides, only the pieces between the two cuts are taken apart by one more digit, in one
aggregation over the groups. Each round leaves a bracket of about a piece's size, so the
pieces in between stay a few thousand however many groups there are; in the end they are
single groups, and the answer is exact.

Slots number the rows of a shard without gaps. Rows are counted in cells (shard, two
digits, one of ``PARTS`` parts by id), the counts of the cells before are added, and rows
are numbered inside their cell, so a group with a third of all rows is spread out too.

Everything on executors is DataFrame functions. Defined results: a null text has size 1
and is a group of its own, apart from the empty text; repeated rows get a slot each; rows
without an id come first in their cell; an empty table gives no rows; shards beyond what
is needed stay empty; a text longer than a shard's share fills one alone; only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemark.llm.common import settle

SHARDS = 16
DIGITS = 3
PARTS = 64


@dataclass(frozen=True)
class Piece:
    """A run of groups whose keys start alike; one group if ``groups`` is 1."""

    key: str
    size: int
    groups: int
    largest: int


@dataclass
class Order:
    """Pieces in order, with the sizes before each."""

    pieces: list[Piece]
    before: list[int] = field(init=False)

    def __post_init__(self):
        self.pieces = sorted(self.pieces, key=lambda p: p.key)
        self.before = [0, *accumulate(p.size for p in self.pieces)]

    @property
    def total(self) -> int:
        return self.before[-1]

    def reach(self, begin: int, capacity: int, inside: bool) -> int:
        """Where a shard that starts at size ``begin`` ends: at a piece's end or, for
        ``inside``, anywhere in a piece of several groups."""
        limit = begin + capacity
        if limit >= self.total:
            return self.total
        at = bisect_right(self.before, limit) - 1
        if inside and self.pieces[at].groups > 1:
            return limit
        return self.before[at]

    def cuts(self, capacity: int, shards: int, inside: bool = False) -> list[int]:
        """Ends of the shards; the last is short of the total if the capacity isn't enough."""
        ends, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity, inside)
            ends.append(at)
        return ends

    def least(self, shards: int, inside: bool = False) -> int:
        """The smallest capacity that is enough."""
        low = max([0, -(-self.total // shards), *(p.largest for p in self.pieces)])
        high = max(low, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, inside)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def undecided(self, low: int, high: int, shards: int) -> list[Piece]:
        """Pieces of several groups in which a cut may lie for capacities from low to high."""
        chosen = {}
        for first, last in zip(self.cuts(low, shards), self.cuts(high, shards, inside=True)):
            begin = max(0, bisect_right(self.before, first) - 1)
            end = min(len(self.pieces), bisect_right(self.before, last))
            for piece in self.pieces[begin:end]:
                if piece.groups > 1:
                    chosen[piece.key] = piece
        return list(chosen.values())


def _pieces(groups: DataFrame, digits: int) -> list[Piece]:
    sums = groups.groupBy(F.substring("group_key", 1, digits).alias("key")).agg(
        F.sum("bytes").alias("size"), F.count("*").alias("groups"), F.max("bytes").alias("largest")
    )
    return [Piece(*row) for row in sums.collect()]


def shard_starts(groups: DataFrame, shards: int = SHARDS, digits: int = DIGITS) -> list[str]:
    """Keys at which shards 1, 2, ... begin, for groups (group_key, bytes)."""
    order = Order(_pieces(groups, digits))
    while order.pieces:
        digits += 1
        enough = order.least(shards)
        needed = order.least(shards, inside=True)
        open_ = order.undecided(needed, enough, shards)
        if not open_:
            break
        keys = [p.key for p in open_]
        parts = []
        for length in sorted({len(k) for k in keys}):
            own = [k for k in keys if len(k) == length]
            parts += _pieces(groups.filter(F.substring("group_key", 1, length).isin(own)), length + 1)
        opened = set(keys)
        order = Order([p for p in order.pieces if p.key not in opened] + parts)
    if not order.pieces:
        return []
    ends = order.cuts(order.least(shards), shards)
    at = {size: piece.key for size, piece in zip(order.before, order.pieces)}
    return [at[end] for end in ends if end in at]


def shard_documents(documents: DataFrame, shards: int = SHARDS, digits: int = DIGITS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.repeat(F.lit("0"), 33)).alias("group_key"),
    )
    rows = settle(rows, "shard-rows")
    groups = settle(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")), "shard-groups")
    starts = shard_starts(groups, shards, digits)
    shard = sum((F.when(F.col("group_key") >= s, 1).otherwise(0) for s in starts), F.lit(0))
    placed = rows.select(
        "*", shard.cast("int").alias("shard"), F.substring("group_key", 1, 2).alias("digits"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PARTS)).cast("int").alias("part"),
    )
    # at most 256 * PARTS cells and as many again for each cut
    counts = placed.groupBy("shard", "digits", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("digits", "part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "shard", "digits", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("shard", "digits", "part").orderBy("group_key", "doc_id", "text_crc32")
    numbered = placed.withColumn("number", F.row_number().over(inside))
    return numbered.join(F.broadcast(offsets), ["shard", "digits", "part"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("offset") + F.col("number") - 1).cast("long").alias("slot"),
    )
