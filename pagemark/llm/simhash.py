"""SimHash near-duplicates, found by deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that of two fingerprints at most
``distance`` bits apart one segment differs in at most one bit (three segments for four
bits). Each segment is indexed once for every bit of it with that bit left out, so such
two segments have a variant in common: 64 keys for a fingerprint, and an equality join
on them finds every pair that has to be verified.

Work is done on distinct fingerprints, so copies never meet in a join. Within a key, the
fingerprints are first linked to the smallest one, which joins dense groups without
their pairs. Only keys of three or more members that still hold several components are
joined, and there only members outside one of the components with the members of other components. No link is
lost: two linked fingerprints share a key, and are in one component or are compared.
Nothing is collected, capped or broadcast. Keys have 20 or 21 free bits, so beyond some
ten million distinct fingerprints the rows compared grow with their square; that is a
property of the method.

Defined results: a null or wordless text has fingerprint zero and is linked like any
other; a repeated row is a copy of itself; a null id is used for a group only if all its
ids are null; an empty table gives no rows; a very long text is one row's work, in slices of
the task's batch; ``near_duplicates`` reads doc_id and text alone, and ``keep_one`` gives all
columns back as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemark.llm.common import components, free_name, prepare, settle, slices

WIDTH = 4
DISTANCE = 4
SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, width: int = WIDTH) -> list[int]:
    """XXH64 of every run of ``width`` words; of the whole text if it has fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate(([0], ends[:-width]))
    cuts = map(slice, begins.tolist(), (ends[width - 1:] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    return [digest(joined[cut], SEED) for cut in cuts]


def majority_bits(hashes: list[list[int]]) -> np.ndarray:
    """For each list, the bits set in more than half of its numbers; zero if it is empty."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([np.array(hashes[i], dtype=np.uint64) for i in full])
    sizes = sizes[full]
    # counts fit a byte in blocks of 255 rows, so eight of them are added up in one number
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    inside = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    begins = np.repeat(np.cumsum(sizes) - sizes, blocks) + 255 * inside
    lanes = np.uint64(0x0101010101010101)
    found = np.zeros(len(full), dtype=np.uint64)
    for bit in range(8):
        packed = np.add.reduceat((flat >> np.uint64(bit)) & lanes, begins)
        counts = np.add.reduceat(
            packed.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0
        )
        for byte, over in enumerate((2 * counts > sizes[:, None]).T):
            found |= over.astype(np.uint64) << np.uint64(8 * byte + bit)
    out[full] = found
    return out


def fingerprints(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, fingerprint): a hash of the text, the 64 bits as a signed number."""
    def run(batches):
        for batch in slices(batches):
            hashes = [shingle_hashes(t, width) for t in batch.column("text").to_pylist()]
            bits = pa.array(majority_bits(hashes).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), bits],
                ["doc_id", "text_key", "fingerprint"],
            )

    prepare(documents.sparkSession)
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    )
    return texts.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def variant_keys(column: str, distance: int = DISTANCE):
    """The keys of a fingerprint: which bit is left out, and the rest of its segment."""
    cuts = max(2, distance // 2 + 1)  # the fewest with distance // cuts <= 1
    edges = [64 * i // cuts for i in range(cuts + 1)]
    keys = []
    for low, high in zip(edges, edges[1:]):
        segment = F.shiftrightunsigned(column, low).bitwiseAND((1 << (high - low)) - 1)
        for bit in range(high - low):
            under = segment.bitwiseAND((1 << bit) - 1)
            over = F.shiftleft(F.shiftrightunsigned(segment, bit + 1), bit)
            keys.append(over.bitwiseOR(under).bitwiseOR(F.lit((low + bit) << 48).cast("long")))
    return F.array(*keys)


def link_fingerprints(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fingerprint, root) for every distinct fingerprint that has a link; root names its group."""
    keyed = prints.select("fingerprint").distinct().select(
        "fingerprint", F.explode(variant_keys("fingerprint", distance)).alias("key")
    )
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    same = Window.partitionBy("key")
    shared = settle(
        keyed.select(
            "key", "fingerprint", F.min("fingerprint").over(same).alias("least"),
            F.count("*").over(same).alias("members"),
        ).filter("members > 1"), "simhash-keys",
    )
    star = shared.filter((F.col("fingerprint") != F.col("least")) & near("fingerprint", "least"))
    first = settle(
        components(star.select(F.col("fingerprint").alias("a"), F.col("least").alias("b"))), "simhash-first"
    )
    # of two members all has been compared
    grouped = shared.filter("members > 2").join(
        first.withColumnsRenamed({"node": "fingerprint", "component": "root"}), "fingerprint", "left"
    ).select("key", "fingerprint", F.coalesce("root", "fingerprint").alias("root"))
    mixed = settle(
        grouped.select(
            "key", "fingerprint", "root", F.min("root").over(same).alias("main"),
            F.max("root").over(same).alias("most"),
        ).filter("main < most").drop("most"), "simhash-mixed",
    )
    left = mixed.filter("root != main").select(
        "key", F.col("fingerprint").alias("p"), F.col("root").alias("a")
    )
    right = mixed.select(
        "key", F.col("fingerprint").alias("q"), F.col("root").alias("b"),
        (F.col("root") == F.col("main")).alias("is_main"),
    )
    across = left.join(right, "key").filter(
        (F.col("a") != F.col("b")) & (F.col("is_main") | (F.col("p") < F.col("q"))) & near("p", "q")
    ).select("a", "b")
    second = components(across).withColumnsRenamed({"node": "root", "component": "top"})
    linked = first.select(F.col("node").alias("fingerprint"), F.col("component").alias("root"))
    alone = second.select(F.col("root").alias("fingerprint")).join(
        linked.select("fingerprint"), "fingerprint", "left_anti"
    ).select("fingerprint", F.col("fingerprint").alias("root"))
    return settle(
        linked.unionByName(alone).join(second, "root", "left").select(
            "fingerprint", F.coalesce("top", "root").alias("root")
        ), "simhash-links",
    )


def near_duplicates(documents: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id, root) for every document.

    ``component_id`` is the smallest id that links reach from the document, ``root`` a
    fingerprint that names its group.
    """
    prints = settle(fingerprints(documents, width), "simhash-prints")
    links = link_fingerprints(prints, distance)
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    rooted = settle(least.join(links, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    ), "simhash-roots")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(
        rooted.join(groups, "root").select("fingerprint", "root", "component_id"), "simhash-groups"
    )
    return prints.join(named, "fingerprint").select(
        "doc_id", "text_key", "fingerprint", "component_id", "root"
    )


def keep_one(documents: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One document of each group, that of the smallest id, with all its columns.

    Of rows of a group that repeat the id, the one with the smaller text hash stays; an
    id that is in two groups stays in both.
    """
    own_id, own_text = (free_name(documents.columns, c) for c in ("kept_id", "kept_text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    kept = near_duplicates(documents, width, distance).groupBy("root").agg(first).select(
        F.col("first.doc_id").alias(own_id), F.col("first.text_key").alias(own_text)
    )
    keyed = documents.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(
        own_text, F.xxhash64("text")
    )
    same = F.col(f"d.{own_id}").eqNullSafe(F.col(f"k.{own_id}")) & (
        F.col(f"d.{own_text}") == F.col(f"k.{own_text}"))
    rows = keyed.alias("d").join(kept.alias("k"), same, "left_semi")
    return rows.dropDuplicates([own_id, own_text]).select(*documents.columns)
