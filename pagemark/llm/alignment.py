"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Tokenizer A is a byte-level file of the tokenizers library and reads the text behind one
space; B is a sentencepiece model, which adds that space itself. Both cut the same bytes.
All tokens of a slice of texts are sorted by start, ends are accumulated to a running
maximum, and a new group begins where a start reaches it: there both tokenizers have a
border. Inside the groups every overlapping pair of an A and a B token is a link; tokens
are in order, so the partners of a token are a range that two searches find.

``align`` gives the groups of each text and its distinct links. ``score`` adds what the
corpus says about them: in how many documents an id pair is linked, and whether that is
the highest number of its A id. Pairs are counted in chunks of about ``CHUNK_BYTES`` of
text, where most repeat: a chunk has a dictionary of its pairs and names them by place.
Only dictionaries are joined with the counts, by pair, and come back to their chunk, whose
links are kept as compressed planes meanwhile. A pair that is everywhere is one row of each
chunk. The highest counts are broadcast: one number for each id of A's vocabulary.

Texts are encoded in segments, cut before every space between other characters, and each
segment that a task has not met is encoded once. A's pattern always begins a new piece there,
and so does B if no entry of its vocabulary has a space behind another character, which is
checked; if one has, a text is one segment. Long texts are aligned in parts of about
``PART_CHARS`` characters, cut at such places too; where there is none, a part is longer. A
chunk is at least one document.

Defined results: a null or empty text, and one whose tokens do not give its own bytes
again (such as one with U+2581), has no tokens, zeros and an empty digest; strings of special
tokens are ordinary text; repeated rows count as documents of their own; documents without
an id are aligned and counted like others; an empty table gives no rows; other columns are
left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemark.llm.common import SLICE_BYTES, prepare, settle, slices, tidy

CHUNK_BYTES = 8 << 20
PART_CHARS = 1 << 18
#: Segments remembered by a task; beyond it the memory starts afresh.
REMEMBERED = 400_000
SPACE_MARK = "▁"
# a space alone would be nothing to B
_BETWEEN = re.compile(r"(?<=\S)(?= [\s\S])")

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, "
    "times array<int>"
)
_CHUNKS = (
    "chunk long, doc_ids array<long>, counts array<long>, digests array<string>, lengths array<int>, "
    "links binary, times binary, pairs array<long>, held_by array<int>"
)
SCORED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def overlaps(start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray):
    """Positions (i, j) of all overlapping pairs of two runs of intervals in order."""
    first = np.searchsorted(other_end, start, "right")
    n = np.searchsorted(other_start, end, "left") - first
    left = np.repeat(np.arange(len(start)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n - first, n), n


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The group of each interval: a new one begins where a start reaches the running end."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.concatenate(([0], np.cumsum(start[order][1:] >= reach[:-1]))) if len(order) else 0
    return group


class Aligner:
    """Two tokenizers, the bytes of their tokens, and the alignment of texts."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = byte_characters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token)) if set(token) <= byte_of.keys() else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.cuttable = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own], dtype=np.int64)
                                      for own in (self.a_bytes, self.b_bytes))
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.bad: set[str] = set()
        self.named = np.array([mark + str(i) for mark in ",|;" for i in range(self.width)], dtype=object)

    def parts(self, text: str, limit: int = PART_CHARS) -> list[str]:
        """A space and the text, cut where both tokenizers begin anew."""
        whole, begin, out = " " + text, 0, []
        while self.cuttable and len(whole) - begin > limit:
            cut = whole.rfind(" ", begin + 1, begin + limit)
            if cut < 0 or whole[cut - 1].isspace():
                found = _BETWEEN.search(whole, begin + limit)
                if not found:
                    break
                cut = found.start()
            out.append(whole[begin:cut])
            begin = cut
        return [*out, whole[begin:]]

    def forget(self) -> None:
        for known in (*self.known, self.bad):
            known.clear()

    def _learn(self, segments: list[str]) -> None:
        """Ids of new segments, and which of them do not give their own bytes again."""
        a_ids = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b_ids = self.b.encode([x[1:] for x in segments], num_threads=1)
        raw = [x.encode() for x in segments]
        whole, ends = b"".join(raw), np.cumsum([len(x) for x in raw])
        for ids, token_bytes, sizes, known in zip(
                (a_ids, b_ids), (self.a_bytes, self.b_bytes), (self.a_sizes, self.b_sizes), self.known):
            flat = list(chain.from_iterable(ids))
            numbers = np.array(flat, dtype="<u4")
            cuts = np.cumsum([len(x) for x in ids])
            packed, at = numbers.tobytes(), (4 * cuts).tolist()
            known.update(zip(segments, map(packed.__getitem__, map(slice, [0, *at], at))))
            reached = np.concatenate(([0], np.cumsum(sizes[numbers])))[cuts]
            if b"".join(map(token_bytes.__getitem__, flat)) != whole or (reached != ends).any():
                self.bad.update(x for x, own, bytes_ in zip(segments, ids, raw)
                                if b"".join(map(token_bytes.__getitem__, own)) != bytes_)

    def encode(self, parts: list[str]) -> tuple[list[bool], list[bytes], list[bytes]]:
        """Of each part whether its tokens give it again, and if so its ids in A and in B."""
        cut = [_BETWEEN.split(p) if self.cuttable else [p] for p in parts]
        if len(self.known[0]) > REMEMBERED:
            self.forget()
        new = list(set().union(*cut).difference(self.known[0]))
        for begin in range(0, len(new), 10_000):
            self._learn(new[begin:begin + 10_000])
        good = [self.bad.isdisjoint(segments) for segments in cut]
        a, b = ([b"".join(map(known.__getitem__, segments)) if ok else b"" for segments, ok in zip(cut, good)]
                for known in self.known)
        return good, a, b

    def align(self, parts: list[str], doc: list[int]):
        """Of each part whether its tokens give it again, n_a, n_b, n_groups, n_links and groups;
        and distinct (doc, pair, times) of them all, in order."""
        good, *ids = self.encode(parts)
        n_a, n_b = (np.array([len(x) // 4 for x in own], dtype=np.int64) for own in ids)
        a, b = (np.frombuffer(b"".join(own), "<u4").astype(np.int64) for own in ids)
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        a_start, b_start = a_end - self.a_sizes[a], b_end - self.b_sizes[b]
        side = np.repeat(np.array([0, 1], dtype=np.int64), [len(a), len(b)])
        group = coalesce(np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end)), side)

        edges = np.concatenate(([0], np.cumsum(n_a)))
        own = np.concatenate((group[:len(a)], [0]))
        n_groups = np.where(n_a > 0, own[edges[1:] - 1] - own[np.minimum(edges[:-1], len(a))] + 1, 0)
        order = np.argsort(2 * group + side, kind="stable")
        new_group = np.diff(group[order], prepend=-1) > 0
        new_side = np.diff(side[order], prepend=0) > 0
        mark = np.where(new_group, 2, np.where(new_side, 1, 0))
        names = self.named[mark * self.width + np.concatenate((a, b))[order]].tolist()
        cuts = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        groups = ["".join(names[x:y])[1:] for x, y in zip(cuts[:-1], cuts[1:])]

        left, right, n = overlaps(a_start, a_end, b_start, b_end)
        n_links = np.diff(np.concatenate(([0], np.cumsum(n)))[edges])
        pairs, place = np.unique(a[left] << 32 | b[right], return_inverse=True)
        of_doc = np.repeat(np.repeat(np.array(doc, dtype=np.int64), n_a), n)
        keys, times = np.unique(of_doc * max(1, len(pairs)) + place, return_counts=True)
        links = (keys // max(1, len(pairs)), pairs[keys % max(1, len(pairs))], times) if len(keys) else (
            keys, keys, times)
        return good, n_a, n_b, n_groups, n_links, groups, links


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _added(doc: np.ndarray, pair: np.ndarray, times: np.ndarray):
    """Rows of the same document and pair as one."""
    if not len(doc):
        return doc, pair, times
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))))
    return doc[first], pair[first], np.add.reduceat(times, first)


def _aligned(own: Aligner, batch: pa.RecordBatch, part_chars: int, slice_bytes: int) -> pa.RecordBatch:
    """The rows of some texts; a long one is worked on in several goes."""
    texts = batch.column("text").to_pylist()
    rows = len(texts)
    sums = np.zeros((4, rows), dtype=np.int64)
    groups: list[list[str]] = [[] for _ in range(rows)]
    bad: set[int] = set()
    links: list[tuple] = []
    parts: list[str] = []
    docs: list[int] = []
    size = 0

    def work() -> None:
        nonlocal size
        good, *numbers, texts_, found = own.align(parts, docs)
        for i, (doc, ok) in enumerate(zip(docs, good)):
            sums[:, doc] += [n[i] for n in numbers]
            groups[doc].append(texts_[i])
            if not ok:
                bad.add(doc)
        links.append(found)
        if len(links) > 8:  # the parts of a long text repeat most pairs
            links[:] = [_added(*(np.concatenate(x) for x in zip(*links)))]
        parts.clear()
        docs.clear()
        size = 0

    for doc, text in enumerate(texts):
        for part in own.parts(text, part_chars) if text else ():
            if parts and size + len(part) > slice_bytes:
                work()
            parts.append(part)
            docs.append(doc)
            size += len(part)
    if parts:
        work()
    none = np.zeros(0, dtype=np.int64)
    doc, pair, times = _added(*(np.concatenate(x) for x in zip(*links))) if links else (none, none, none)
    if bad:
        out = np.array(sorted(bad))
        sums[:, out] = 0
        stay = ~np.isin(doc, out)
        doc, pair, times = doc[stay], pair[stay], times[stay]
    offsets = pa.array(np.searchsorted(doc, np.arange(rows + 1)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *(pa.array(s, pa.int64()) for s in sums),
         pa.array(["" if i in bad else ";".join(g) for i, g in enumerate(groups)], pa.string()),
         pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int64())),
         pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
    )


def _runner(a_path: str, b_path: str, part_chars: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in slices(batches, limit=slice_bytes):
            yield _aligned(own, batch, part_chars, slice_bytes)

    return tidy(run, lambda: aligner(a_path, b_path).forget())


def _columns(documents: DataFrame) -> DataFrame:
    prepare(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(documents: DataFrame, a_path: str, b_path: str, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of every document.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the distinct links, a shifted left by
    32 bits and b, and ``times`` how often each occurs.
    """
    return _columns(documents).mapInArrow(_runner(a_path, b_path, part_chars, SLICE_BYTES), ALIGNED)


def squeeze(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _chunks(rows: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Aligned rows as chunks, each one row with a dictionary of its pairs."""
    task = TaskContext.get()
    chunk = (task.partitionId() if task else 0) << 32
    held: list[pa.RecordBatch] = []
    digests: list[str] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal chunk, size
        numbers = [np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("n_a", "n_b", "n_groups", "n_links")]
        pair, times = (np.concatenate([h.column(c).flatten().to_numpy() for h in held]) for c in ("pairs", "times"))
        lengths = np.concatenate([np.diff(h.column("pairs").offsets.to_numpy()) for h in held])
        pairs, place = np.unique(pair, return_inverse=True)
        row = [[chunk], [[i for h in held for i in h.column("doc_id").to_pylist()]], [np.concatenate(numbers)],
               [digests], [lengths], [squeeze(np.diff(place, prepend=0))], [squeeze(times)], [pairs],
               [np.bincount(place, minlength=len(pairs))]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()),
                 pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [part.split()[0] for part in _CHUNKS.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)
        held.clear()
        digests.clear()
        chunk, size = chunk + 1, 0
        return out

    for batch in rows:
        texts = batch.column("groups").to_pylist()
        digests += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
        size += sum(map(len, texts)) // 3  # about as long as the texts
        held.append(batch.drop_columns("groups"))
        if size > chunk_bytes:
            yield close()
    if held:
        yield close()


def _score(chunk: pa.Table, counted: pa.Table) -> pa.Table:
    """The rows of the documents of a chunk; ``counted`` has its pairs by place."""
    kinds = [pa.int64()] * 7 + [pa.string()]
    names = [part.split()[0] for part in SCORED.split(", ")]
    if not chunk.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    own = {c: chunk.column(c)[0] for c in chunk.column_names}
    size = counted.num_rows
    n, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    at = counted.column("place").to_numpy()
    n[at] = counted.column("n").to_numpy()
    best[at] = counted.column("best").to_numpy()
    place, times = np.cumsum(expand(own["links"].as_py()), dtype=np.uint32), expand(own["times"].as_py()).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(own["lengths"].as_py() or [], dtype=np.int64))).astype(np.int64)
    n_best, count_sum = (np.diff(np.concatenate(([0], np.cumsum(v[place] * times)))[ends]) for v in (best, n))
    numbers = np.array(own["counts"].as_py(), dtype=np.int64).reshape(4, -1)
    return pa.table([pa.array(own["doc_ids"].as_py(), pa.int64()), *(pa.array(x) for x in numbers),
                     pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
                     pa.array(own["digests"].as_py(), pa.string())], names=names)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold a pair, and 1 if no pair of its A id has more."""
    held = chunks.select(F.explode(F.arrays_zip("pairs", "held_by")).alias("x"))
    counts = settle(held.groupBy(F.col("x.pairs").alias("pair")).agg(
        F.sum("x.held_by").alias("n")), "alignment-counts")
    a = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # as many rows as A has ids
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select(
        "pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def score(documents: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES,
          part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    rows = _runner(a_path, b_path, part_chars, SLICE_BYTES)
    chunks = settle(_columns(documents).mapInArrow(
        lambda batches: _chunks(rows(batches), chunk_bytes), _CHUNKS), "alignment-chunks")
    places = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    counted = places.join(pair_counts(chunks), "pair").select(
        F.col("chunk").alias("owner"), "place", "n", "best")
    return chunks.drop("pairs", "held_by").groupBy("chunk").cogroup(counted.groupBy("owner")).applyInArrow(
        _score, SCORED)
