"""Source divergence audit: which sources of a language differ, and by which terms.

Terms are runs of letters (A-Z lower-cased, all beyond ASCII a letter). A language keeps
the terms found in at least ``LEAST_DOCS`` of its documents. Each (language, source) group,
and each language, gives a kept term the share ``1 + floor(SCALE * (count + SMOOTH) / (N +
SMOOTH * V))``, where N counts its kept terms and V the kept terms of the language. Shares
and sums are whole numbers, so results are exact.

Tasks count the terms of their documents before anything is shuffled. Two reports follow:

* ``term``: the terms of a group whose share is most above that of its language. A term's
  excess grows with its count in the group and falls with that in the language, and ties
  go to the smaller term in UTF-8. So a term that ``top`` others dominate (no lower group
  count, no higher language count, earlier in UTF-8) is out whatever the sums are.
  Partitions keep their skyband, the terms dominated by fewer than ``top``; skybands are
  merged by (group, salt), then by group, and what is left is ranked exactly.
* ``pair``: the sum of absolute differences of shares over all kept terms, for every two
  sources of a language. A term that both lack adds the same to all, so only occurring
  terms are read: chunks of a language's terms become small matrices of terms by sources,
  for every two blocks of at most ``BLOCK`` sources, and their sums are added up. No pairs
  are made for a term; the pairs of sources are the result itself.

Nothing is collected, and no table is broadcast by the library. Memory of a task is
bounded by ``HELD`` entries, or a chunk of about ``CHUNK_ROWS`` rows.

Defined results: null text, language and source count as empty ones; a group without kept
terms still has its pairs; a language that keeps no term has pairs of value 0; a language
of one source has none; repeated rows count as often as they stand there; an empty table
gives no rows; a very long text is one row's work; only the three columns are read, so
others may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemark.llm.common import prepare, settle, slices

LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Entries that a task holds before it passes on what it has.
HELD = 400_000
CHUNK_ROWS = 50_000
#: Sources in a block of a matrix, and its rows.
BLOCK = 128
TERMS_AT_ONCE = 2_048
SALTS = 16

_SMALL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_COUNTS = "lang binary, source binary, term binary, n long, docs long"
_ROWS = "lang string, source string, term string, n long, lang_n long"


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_SMALL).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.binary()), pa.array([source] * len(n), pa.binary()),
                     pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()),
                     pa.array([docs[term] for term in n], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in slices(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            terms = terms_of(text)
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and documents that hold it."""
    prepare(documents.sparkSession)
    raw = documents.select(*(
        F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")
    ))
    parts = raw.mapInArrow(_count, _COUNTS)
    names = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]
    return parts.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def dominated_by_fewer(n: np.ndarray, lang_n: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Rows that fewer than k others dominate: higher n, lower lang_n, earlier place.

    Rows are visited in an order in which a row comes after all that dominate it. It is
    enough to count the kept ones among them: the first k of k or more are kept.
    """
    order = np.lexsort((place, lang_n, -n))
    kept = np.zeros(0, dtype=np.int64)
    for begin in range(0, len(order), 256):
        own = order[begin:begin + 256]
        earlier = np.concatenate((kept, own))
        over = (lang_n[earlier, None] <= lang_n[own]) & (place[earlier, None] < place[own])
        over[len(kept):] &= np.arange(len(own))[:, None] < np.arange(len(own))
        kept = np.concatenate((kept, own[over.sum(axis=0) < k]))
    return np.sort(kept)


def _groups_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    codes = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(rows):
            yield (batch.column("lang")[int(rows[0])].as_py(), batch.column("source")[int(rows[0])].as_py()), rows


def _skyband(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The skyband of rows of one group."""
    place = np.empty(batch.num_rows, dtype=np.int64)
    place[pc.sort_indices(batch.column("term").cast(pa.binary())).to_numpy()] = np.arange(batch.num_rows)
    n, lang_n = (batch.column(c).to_numpy() for c in ("n", "lang_n"))
    return batch.take(pa.array(dominated_by_fewer(n, lang_n, place, k)))


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """The rows without those that k others of their group and partition dominate.

    Rows that are held beyond ``HELD`` are thinned out; if that doesn't help they are
    passed on. More than the skyband is never wrong, only more work for the next step.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.RecordBatch]] = {}
        size = 0

        def thin() -> None:
            for key, parts in held.items():
                one = pa.Table.from_batches(parts).combine_chunks().to_batches()
                held[key] = [_skyband(one[0], k)] if one else []

        for batch in batches:
            for key, at in _groups_of(batch):
                held.setdefault(key, []).append(batch.take(pa.array(at)))
            size += batch.num_rows
            if size > HELD:
                thin()
                size = sum(p.num_rows for parts in held.values() for p in parts)
                if size > HELD // 2:
                    yield from (p for parts in held.values() for p in parts)
                    held, size = {}, 0
        thin()
        yield from (p for parts in held.values() for p in parts)

    return rows.mapInArrow(run, _ROWS)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)) in whole numbers of any size."""
    above = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + kept * SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _pair_sums(table: pa.Table, width: int, at_once: int) -> pa.Table:
    """Sums of one chunk of terms over two blocks of sources; rows without a term are the base shares."""
    at, p = (table.column(c).to_numpy() for c in ("at", "p"))
    is_base = np.asarray(pc.is_null(table.column("term")).to_numpy(zero_copy_only=False))
    sources = at[is_base]
    order = np.argsort(sources)
    sources, base = sources[order], p[is_base][order]
    term = table.column("term").filter(pa.array(~is_base)).combine_chunks().dictionary_encode()
    if isinstance(term, pa.ChunkedArray):
        term = term.combine_chunks()
    row, column, own = term.indices.to_numpy(), np.searchsorted(sources, at[~is_base]), p[~is_base]
    order = np.argsort(row, kind="stable")
    row, column, own = row[order], column[order], own[order]
    sums = np.zeros((len(sources), len(sources)), dtype=np.int64)
    for begin in range(0, len(term.dictionary), at_once):
        end = min(begin + at_once, len(term.dictionary))
        some = slice(*np.searchsorted(row, [begin, end]))
        shares = np.tile(base, (end - begin, 1))
        shares[row[some] - begin, column[some]] = own[some]
        for i in range(len(sources)):
            sums[i] += np.abs(shares - shares[:, i:i + 1]).sum(axis=0)
    # what the terms would add that both lack is added once for all chunks
    sums -= len(term.dictionary) * np.abs(base[:, None] - base)
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    block = sources // width
    wanted = (np.minimum(block[:, None], block) == lo) & (np.maximum(block[:, None], block) == hi)
    a, b = np.nonzero(wanted & ~np.eye(len(sources), dtype=bool) & (sums != 0))
    lang = table.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(sources[a], pa.int32()),
                     pa.array(sources[b], pa.int32()), pa.array(sums[a, b], pa.int64())],
                    names=["lang", "at", "other", "more"])


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): see above; rank 1 is the most divergent."""
    counts = settle(term_counts(documents), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(
        F.col("docs") >= least_docs).drop("docs")
    rows = settle(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"),
                  "divergence-terms")

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    of_lang = rows.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    by_lang = Window.partitionBy("lang")
    groups = documents.select(*named).distinct().join(totals, ["lang", "source"], "left").join(
        of_lang, "lang", "left").fillna(0, ["total", "rows", "kept", "lang_total"])
    place = F.row_number().over(by_lang.orderBy("source")) - 1
    groups = settle(groups.withColumn("at", place).withColumn("sources", F.count("*").over(by_lang)).withColumn(
        "chunks", F.greatest(F.ceil(F.sum("rows").over(by_lang) / CHUNK_ROWS), F.lit(1)).cast("int")
    ), "divergence-groups")
    base = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(0)

    salted = skybands(rows, top).repartition(
        "lang", "source", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    merged = skybands(skybands(salted, top).repartition("lang", "source"), top)
    excess = merged.join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (share(F.col("n"), F.col("total"), F.col("kept"))
         - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).alias("value"),
    ).filter("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = excess.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    # every row goes to the matrices of its block with each block, once
    def blocked(frame: DataFrame) -> DataFrame:
        own = (F.col("at") / BLOCK).cast("int")
        with_ = F.explode(F.sequence(F.lit(0), ((F.col("sources") - 1) / BLOCK).cast("int")))
        return frame.withColumn("own", own).withColumn("with_", with_).select(
            "lang", F.least("own", "with_").alias("lo"), F.greatest("own", "with_").alias("hi"), "chunk",
            "term", "at", "p",
        )

    chunk = F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")
    occurring = rows.drop("lang_n").join(groups, ["lang", "source"]).withColumn("chunk", chunk).withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("kept")))
    lacking = groups.filter("kept > 0").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    ).withColumn("term", F.lit(None).cast("string")).withColumn("p", base)
    width, at_once = BLOCK, TERMS_AT_ONCE
    sums = blocked(occurring).unionByName(blocked(lacking)).groupBy("lang", "lo", "hi", "chunk").applyInArrow(
        lambda chunk: _pair_sums(chunk, width, at_once), "lang string, at int, other int, more long")
    sums = sums.groupBy("lang", "at", "other").agg(F.sum("more").alias("more"))
    one = groups.select("lang", "source", "at", "kept", base.alias("base"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("other"), base.alias("base2"))
    pairs = one.join(two, "lang").filter("at != other").join(sums, ["lang", "at", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.abs(F.col("base") - F.col("base2")) * F.col("kept") + F.coalesce("more", F.lit(0))).alias("value"),
    ).withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)
