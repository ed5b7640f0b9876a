"""Language identification by rank-order profiles of n-grams.

A profile is the most frequent n-grams (one to three letters, words bounded by a mark)
of a language, in order. A text's own profile is compared with each language's by the
out-of-place distance: for every n-gram the difference of the two ranks, or the length of
the profile if the language hasn't it. The least distance wins; ties go to the language
that comes first in order.

Profiles are counted over all texts that have a language: tasks count n-grams of their
rows, the counts are added by (language, n-gram), and the first ``SIZE`` of each language
are ranked. Only these reach the driver and the tasks, as (n-gram, language, rank); their
number is bounded by ``MAX_LANGUAGES`` * SIZE, 64 MB. Identification is a map over rows. Work on a text is in
numpy, in slices of some megabytes; a long text is one row's work.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if nothing was learned; null languages are not learned from; repeated rows
count as often as they stand there; a column of the documents that is already called
like one of the new ones (``lang_pred`` and ``lang_score``, if no other names are given) is
replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemark.llm.common import prepare, slices, tidy

SIZE = 400
MAX_LANGUAGES = 10_000
#: Texts worked on at a time; their numpy copies take 60 times as much.
SLICE = 1 << 18
UNKNOWN = "und"
#: Letters are below 2 ** 18; an n-gram is up to three of them and its length.
BITS = 18
#: Distinct n-grams and counts held by a task before they are combined.
HELD = 1_000_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The small letter of each code point, 0 if it is no letter."""
    out = np.zeros(0x110000, dtype=np.int64)
    for point in range(1 << BITS):
        char = chr(point)
        if char.isalpha():
            small = ord(char.lower()[0])
            out[point] = small if small < 1 << BITS else point
    return out


def grams_of(texts: list[str | None]) -> list[np.ndarray]:
    """The n-grams of each text, as numbers, repeats included."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    found = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    # one mark between words, and so between texts
    found = np.concatenate(([0], found))
    kept = np.flatnonzero((found != 0) | np.concatenate(([True], found[:-1] != 0)))
    codes = found[kept]
    ends = np.cumsum([len(t or "") + 1 for t in texts])  # of each text, its mark included
    bounds = np.concatenate(([0], np.searchsorted(kept, ends + 1) - 1))
    out = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = codes[begin:end + 1]  # from mark to mark
        if end <= begin:
            out.append(np.zeros(0, dtype=np.int64))
            continue
        two = own[:-1] << BITS | own[1:]
        inner = own[1:-1] != 0
        three = (two[:-1] << BITS | own[2:])[inner]
        out.append(np.concatenate((
            own[own != 0], two | (np.int64(1) << 3 * BITS), three | (np.int64(2) << 3 * BITS),
        )))
    return out


def _added(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches):
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def rows():
        for lang, parts in held.items():
            grams, counts = _added(*(np.concatenate(p) for p in zip(*parts)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                ["lang", "gram", "n"],
            )

    for batch in slices(batches, limit=SLICE):
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, grams in zip(batch.column("lang").to_pylist(), grams_of(batch.column("text").to_pylist())):
            by_lang.setdefault(lang, []).append(grams)
        for lang, parts in by_lang.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            held.setdefault(lang, []).append((grams, counts.astype(np.int64)))
            size += len(grams)
        if size > HELD:
            yield from rows()
            held, size = {}, 0
    yield from rows()


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from learning: a fifth of the ids, by their checksum."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(labelled: DataFrame, size: int = SIZE) -> dict[str, list[int]]:
    """The profile of each language, from rows (lang, text)."""
    prepare(labelled.sparkSession)
    texts = labelled.select(F.col("lang").cast("string").alias("lang"), "text").dropna()
    counts = texts.mapInArrow(tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    rows = top.select("lang", "gram", "rank").limit(MAX_LANGUAGES * size + 1).toArrow()
    if rows.num_rows > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = rows.sort_by([("lang", "ascending"), ("rank", "ascending")])
    profiles: dict[str, list[int]] = {}
    for lang, gram in zip(rows.column("lang").to_pylist(), rows.column("gram").to_pylist()):
        profiles.setdefault(lang, []).append(gram)
    return profiles


class Profiles:
    """For every n-gram the languages that have it and its rank there."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size = size
        self.names = sorted(profiles)
        own = [np.array(profiles[name], dtype=np.int64) for name in self.names]
        grams = np.concatenate([np.zeros(0, dtype=np.int64), *own])
        langs = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])
        ranks = np.concatenate([np.zeros(0, dtype=np.int32), *(np.arange(len(x), dtype=np.int32) for x in own)])
        order = np.argsort(grams, kind="stable")
        self.langs, self.ranks = langs[order], ranks[order]
        self.grams, first = np.unique(grams[order], return_index=True)
        self.starts = np.append(first, len(grams))

    def guess(self, grams: np.ndarray) -> tuple[str, float]:
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        own, counts = np.unique(grams, return_counts=True)
        own = own[np.argsort(-counts, kind="stable")[:self.size]]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = self.grams[at] == own
        # every n-gram is out of place by the whole length, less what a language that has it saves
        counts = np.where(there, self.starts[at + 1] - self.starts[at], 0)
        entry = np.arange(counts.sum()) + np.repeat(self.starts[at] - np.cumsum(counts) + counts, counts)
        gap = np.abs(self.ranks[entry] - np.repeat(np.arange(len(own)), counts))
        saved = np.bincount(self.langs[entry], self.size - gap, len(self.names)).astype(np.int64)
        away = self.size * len(own) - saved
        best = int(away.argmin())
        return self.names[best], float(1 - away[best] / (self.size * len(own)))


def identify(documents: DataFrame, profiles: dict[str, list[int]], size: int = SIZE,
             pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """All columns, the language and its score: from 0 to 1, 1 for the profile itself."""
    spark = documents.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(Profiles(profiles, size))

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            found = [held.value.guess(g) for g in grams_of(batch.column("text").to_pylist())]
            for name, kind, values in ((pred, pa.string(), [f[0] for f in found]),
                                       (score, pa.float64(), [f[1] for f in found])):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(values, kind))
            yield batch

    out = documents.withColumn(pred, F.lit(None).cast("string")).withColumn(
        score, F.lit(None).cast("double")
    )
    return out.mapInArrow(tidy(run), out.schema)
