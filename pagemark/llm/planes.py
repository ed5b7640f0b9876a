"""Token ids as compressed planes: the output format of tokenised documents.

Documents are range-partitioned by id, and every partition is one shard. A task reads its
shard in order, tokenises it, and gathers whole documents into segments of about
``SEGMENT_IDS`` ids. A segment is cut into blocks of ``BLOCK_IDS`` ids; a block is
transposed into bit or byte planes, and each plane is compressed with zstandard. Planes
of zeros take no space. The frame of a segment starts with its chunk index:

    magic "PLN1", unit (1 byte: 1 or 8 bits a plane), 3 bytes 0,
    ids in the segment (u64), ids in a block (u32), planes in a block (u32),
    compressed bytes of every plane of every block (u32 each, 0: all zero), the planes

Segments are rows of a table that Spark writes, so a lost task is written again and any
store that Spark reaches will do. Beside the frame a row holds the shard, the place of
the segment in it, the ids before it in the shard, and the ids and lengths of its
documents: reading those columns alone is reading the index. Since a segment holds whole
documents, reading is a map over rows; the only thing the driver holds is one total for
each shard.

Defined results: a null text is tokenised like an empty one and gives the end id alone;
documents without an id come first; a repeated row is written again; an empty table gives
an empty one. A document longer than a segment is a segment of its own.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemark.llm.common import prepare, slices

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20
LEVEL = 3
HEAD = struct.Struct("<4sB3xQII")
MAGIC = b"PLN1"
#: Words remembered by a task; beyond it the memory starts afresh.
REMEMBERED = 600_000
#: The suffix of tokens that end a piece, and marks that are pieces of their own.
SUFFIX = "</w>"
MARKS = b".,;:!?"
RUN_WORDS = 100


def pack(ids: np.ndarray, unit: int = 8, block_ids: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """The frame of a run of unsigned 32-bit ids; ``unit`` is 1 for bit, 8 for byte planes."""
    if unit not in (1, 8):
        raise ValueError("unit must be 1 or 8")
    ids = np.ascontiguousarray(ids, dtype="<u4")
    squeeze = zstandard.ZstdCompressor(level=level).compress
    sizes, bodies = [], []
    for begin in range(0, len(ids), block_ids):
        block = np.ascontiguousarray(ids[begin:begin + block_ids].view(np.uint8).reshape(-1, 4).T)
        if unit == 1:
            bits = np.unpackbits(block[:, :, None], axis=2, bitorder="little")
            block = np.packbits(bits.transpose(0, 2, 1).reshape(32, -1), axis=1, bitorder="little")
        for plane in block:
            body = squeeze(plane.tobytes()) if plane.any() else b""
            sizes.append(len(body))
            bodies.append(body)
    head = HEAD.pack(MAGIC, unit, len(ids), block_ids, 32 // unit)
    return b"".join([head, np.array(sizes, dtype="<u4").tobytes(), *bodies])


def unpack(frame: bytes) -> np.ndarray:
    """The ids of a frame."""
    magic, unit, count, block_ids, planes = HEAD.unpack_from(frame)
    if magic != MAGIC or unit not in (1, 8) or planes != 32 // unit:
        raise ValueError("not a frame of token planes")
    blocks = -(-count // block_ids)
    sizes = np.frombuffer(frame, "<u4", blocks * planes, HEAD.size).tolist()
    at = HEAD.size + 4 * len(sizes)
    expand = zstandard.ZstdDecompressor().decompress
    out = np.empty(count, dtype="<u4")
    for block in range(blocks):
        begin = block * block_ids
        n = min(block_ids, count - begin)
        width = n if unit == 8 else -(-n // 8)
        rows = np.zeros((planes, width), dtype=np.uint8)
        for plane, size in enumerate(sizes[block * planes:(block + 1) * planes]):
            if size:
                rows[plane] = np.frombuffer(expand(frame[at:at + size]), np.uint8)
                at += size
        if unit == 1:
            bits = np.unpackbits(rows, axis=1, count=n, bitorder="little").reshape(4, 8, n)
            rows = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")[:, :, 0]
        out[begin:begin + n] = np.ascontiguousarray(rows.T).view("<u4").ravel()
    return out


class WordTokenizer:
    """A tokenizer file of the tokenizers library whose pieces never span white space.

    Texts are cut at ASCII white space, which such a tokenizer drops and which no
    normalisation reaches across, and only words not met before go to the library. Marks
    behind letters are pieces of their own, so a word and its marks are encoded apart.
    Words of letters alone go in runs: each is one piece, and a piece's last token is one
    with the suffix. If a run has not as many of those as words, its words go one by one.

    The library finds the strings of special tokens in a text before anything else. Texts
    that hold one go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(SUFFIX)]] = True

    def _each(self, words: list[str]) -> None:
        for begin in range(0, len(words), 10_000):
            part = words[begin:begin + 10_000]
            for word, own in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                self.words[word.encode("utf-8", "surrogatepass")] = np.array(own.ids, dtype="<u4").tobytes()

    def _runs(self, words: list[bytes]) -> None:
        runs = [words[i:i + RUN_WORDS] for i in range(0, len(words), RUN_WORDS)]
        found = self.library.encode_batch_fast([b" ".join(r).decode() for r in runs], add_special_tokens=False)
        for run, own in zip(runs, found):
            ids = np.array(own.ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(run) or ends[-1] != 4 * len(ids):
                self._each([word.decode() for word in run])
                continue
            raw = ids.tobytes()
            for word, begin, end in zip(run, [0, *ends], ends):
                self.words[word] = raw[begin:end]

    def _learn(self, new: list[bytes]) -> None:
        letters, others, marked = set(), set(), []
        for raw in new:
            base = raw.rstrip(MARKS)
            if not base.isalpha():  # bytes: letters of ASCII alone need no decoding
                word = base.decode("utf-8", "surrogatepass")
                if not (word.isalpha() and word.lower().isalpha()):  # no mark joins what follows
                    others.add(raw.decode("utf-8", "surrogatepass"))
                    continue
            if base not in self.words:
                letters.add(base)
            if base != raw:
                tail = raw[len(base):]
                marked.append((raw, base, tail))
                if tail not in self.words:
                    others.add(tail.decode())
        self._each(list(others))
        self._runs(list(letters))
        for raw, base, tail in marked:
            self.words[raw] = self.words[base] + self.words[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if t and any(s in t for s in self.special)}
        cut = [b"" if i in whole else (t or "").encode("utf-8", "surrogatepass") for i, t in enumerate(texts)]
        cut = [raw.split() for raw in cut]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        self._learn(list(set().union(*cut).difference(self.words)))
        known = self.words.__getitem__
        out = [b"".join(map(known, words)) for words in cut]
        for i in whole:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


SEGMENTS = (
    "shard int, segment long, start_in_shard long, n_ids long, doc_ids array<long>, "
    "lengths array<long>, frame binary"
)


def _segments(tokenizer: Callable[[], object], end_id: int, unit: int, segment_ids: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer().encode
        shard, segment, start = 0, 0, 0
        doc_ids: list = []
        runs: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal segment, start, size
            ids = np.frombuffer(b"".join(runs), "<u4")
            row = [[shard], [segment], [start], [len(ids)], [list(doc_ids)],
                   [[len(r) // 4 for r in runs]], [pack(ids, unit)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
                     pa.list_(pa.int64()), pa.binary()]
            segment, start, size = segment + 1, start + len(ids), 0
            doc_ids.clear()
            runs.clear()
            names = [part.split()[0] for part in SEGMENTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

        for batch in slices(batches):
            shard = batch.column("shard")[0].as_py()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(),
                                   encode(batch.column("text").to_pylist())):
                ids += end
                if runs and size + len(ids) // 4 > segment_ids:
                    yield close()
                doc_ids.append(doc_id)
                runs.append(ids)
                size += len(ids) // 4
        if runs:
            yield close()

    return run


def write_planes(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 1,
                 shards: int | None = None, unit: int = 8, segment_ids: int = SEGMENT_IDS) -> None:
    """Tokenise whole texts in ascending order of ``doc_id`` and write their segments."""
    spark = documents.sparkSession
    prepare(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        shards, F.col("doc_id").asc_nulls_first()
    ).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    numbered = ordered.withColumn("shard", F.spark_partition_id())
    run = _segments(lambda: word_tokenizer(tokenizer_path), end_id, unit, segment_ids)
    # the planes are compressed already
    numbered.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from written segments; ids as little-endian u32.

    ``start`` counts the ids of all documents before it. The driver adds up one total for
    each shard, of which there are as many as the writer was given.
    """
    def run(batches):
        for batch in slices(batches, "frame"):
            for row in batch.to_pylist():
                ids = unpack(row["frame"])
                ends = np.cumsum(row["lengths"])
                starts = ends - np.array(row["lengths"])
                raw = [ids[b:e].tobytes() for b, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()),
                     pa.array(starts + row["start"], pa.int64()),
                     pa.array(row["lengths"], pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    prepare(spark)
    written = spark.read.schema(SEGMENTS).parquet(path)
    before, offsets = 0, []
    for shard, total in sorted(
        (r.shard, r.total) for r in written.groupBy("shard").agg(F.sum("n_ids").alias("total")).collect()
    ):
        offsets.append((shard, before))
        before += total
    totals = spark.createDataFrame(offsets, "shard int, before long")
    placed = written.join(F.broadcast(totals), "shard").select(
        (F.col("start_in_shard") + F.col("before")).alias("start"), "doc_ids", "lengths", "frame"
    )
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def ids_crc32(ids: bytes) -> int:
    """What ``crc32`` of the ids column gives."""
    return zlib.crc32(ids)
