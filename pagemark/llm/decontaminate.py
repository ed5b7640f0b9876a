"""Benchmark decontamination: windows of test items looked up in training documents.

The test items are normalised and cut into windows of consecutive words on Spark. Their
size is measured before anything is broadcast: a block of at most ``BLOCK_BYTES`` is
broadcast as a hash set, and a larger benchmark goes over the documents block by block,
each pass adding to the hits of the ones before. Documents are scanned where they lie,
so nothing is shuffled and no key can be hot.

A scan turns words into numbers (0 for a word in no window), hashes every window without
a zero, looks the hashes up and verifies each hit word by word.

Defined results: a null text has no words; null item ids or item texts take no part;
repeated items count once, repeated documents each for themselves; a document without
words is not contaminated; an empty benchmark contaminates nothing. Columns other than
the named ones pass through ``remove_documents`` and ``remove_spans`` untouched.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemark.llm.common import free_name, prepare, settle, slices, tidy

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Bytes to word bytes: A-Z to lower case, other ASCII but a-z and 0-9 to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (item, gram): the distinct windows of each item, words joined by a space."""
    def cut(batches):
        for batch in slices(batches):
            items, grams = [], []
            for item, text in zip(*(batch.column(c).to_pylist() for c in ("item", "text"))):
                words = words_of(text)
                last = max(1, len(words) - window + 1) if words else 0
                own = {b" ".join(words[i:i + window]) for i in range(last)}
                items += [item] * len(own)
                grams += [g.decode("utf-8", "surrogatepass") for g in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(grams, pa.string())], ["item", "gram"]
            )

    prepare(benchmark.sparkSession)
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return texts.dropna().mapInArrow(cut, "item string, gram string").distinct()


class GramSet:
    """A block of windows: numbered words, and hashed windows with their items by length."""

    def __init__(self, rows: list[tuple[str, str]]):
        grams: dict[bytes, set[str]] = {}
        for item, gram in rows:
            grams.setdefault(gram.encode(), set()).add(item)
        self.words = {w: i + 1 for i, w in enumerate(sorted({w for g in grams for w in g.split()}))}
        self.lengths = {}
        for length in sorted({g.count(b" ") + 1 for g in grams}):
            own = sorted(g for g in grams if g.count(b" ") + 1 == length)
            ids = np.array([[self.words[w] for w in g.split()] for g in own], dtype=np.int64)
            seed = 0
            while True:  # another seed if two windows share a hash
                codes = self._codes(seed)
                hashes = self._hash(codes, ids.ravel(), np.arange(len(own)) * length, length)
                if len(np.unique(hashes)) == len(own):
                    break
                seed += 1
            order = np.argsort(hashes)
            self.lengths[length] = (
                seed, hashes[order], ids[order], [sorted(grams[own[i]]) for i in order]
            )
        self._cache = {}

    def _codes(self, seed: int) -> np.ndarray:
        draw = np.random.Generator(np.random.PCG64(seed + 1))
        return draw.integers(1, 2**63, size=len(self.words) + 1, dtype=np.uint64)

    @staticmethod
    def _hash(codes, ids, at, length):
        total = np.zeros(len(at), dtype=np.uint64)
        for k in range(length):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += codes[ids[at + k]]
        return total

    def find(self, ids: np.ndarray):
        """(position, length, items) arrays of verified hits; 0 stands between documents."""
        zeros = np.concatenate(([0], np.cumsum(ids == 0)))
        for length, (seed, hashes, table, items) in self.lengths.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(zeros[length:] == zeros[:-length])
            if not len(at):
                continue
            codes = self._cache.setdefault(seed, self._codes(seed))
            found = self._hash(codes, ids, at, length)
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            hit = np.flatnonzero(hashes[place] == found)
            at, place = at[hit], place[hit]
            same = np.ones(len(at), dtype=bool)
            for k in range(length):
                same &= ids[at + k] == table[place, k]
            for position, row in zip(at[same].tolist(), place[same].tolist()):
                yield position, length, items[row]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
HITS_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


def _scan(held: Broadcast, column: str):
    def run(batches):
        grams: GramSet = held.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            earlier = batch.column(column).to_pylist()
            words = [words_of(t) if t is not None else [] for t in texts]
            counts = np.array([len(w) for w in words], dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(counts + 1)))
            ids = np.zeros(int(starts[-1]), dtype=np.int64)
            for own, begin, n in zip(words, starts.tolist(), counts.tolist()):
                ids[begin:begin + n] = np.fromiter(map(grams.words.get, own, repeat(0)), np.int64, n)
            spans = [[] if e is None else [(s["begin"], s["end"]) for s in e["spans"]] for e in earlier]
            items = [set() if e is None else set(e["items"]) for e in earlier]
            for position, length, own in grams.find(ids):
                row = int(np.searchsorted(starts, position, side="right")) - 1
                begin = position - int(starts[row])
                spans[row].append((begin, begin + length))
                items[row].update(own)
            hits = [
                {"n_words": n, "spans": [{"begin": b, "end": e} for b, e in merged(s)], "items": sorted(i)}
                for n, s, i in zip(counts.tolist(), spans, items)
            ]
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, column, pa.array(hits, HITS_ARROW))

    return tidy(run)


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
              block_bytes: int = BLOCK_BYTES, column: str = "hits") -> DataFrame:
    """All columns of ``documents`` and ``column``: words, merged hit spans (in words), items.

    A column of the documents that is already called so is replaced. Windows beyond
    ``block_bytes`` make several passes, each written before the next, so that a task holds
    one block of them.
    """
    spark = documents.sparkSession
    prepare(spark)
    grams = settle(item_windows(benchmark, window), "benchmark-windows")
    total = grams.agg(F.sum(F.octet_length("gram") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = documents.withColumn(column, F.lit(None).cast(HITS))
    for block in range(blocks):
        own = grams.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast(GramSet([tuple(r) for r in own.collect()]))
        out = out.mapInArrow(_scan(held, column), out.schema)
        if block + 1 < blocks:
            out = settle(out, "benchmark-pass")
    return out


def remove_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit."""
    hits = free_name(documents.columns, "hits")
    found = find_hits(documents, benchmark, window, column=hits)
    return found.filter(F.size(F.col(hits)["spans"]) == 0).drop(hits)


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All documents, hit words and what stands between them taken out of the text."""
    hits_ = free_name(documents.columns, "hits")

    def cut(batches):
        for batch in slices(batches):
            out = []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column(hits_).to_pylist()):
                if hits["spans"]:
                    places = [m.span() for m in WORD.finditer(text)]
                    kept, last = [], 0
                    for span in hits["spans"]:
                        kept.append(text[last:places[span["begin"]][0]])
                        last = places[span["end"] - 1][1]
                    text = "".join([*kept, text[last:]])
                out.append(text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    found = find_hits(documents, benchmark, window, column=hits_)
    return found.mapInArrow(cut, found.schema).drop(hits_)
