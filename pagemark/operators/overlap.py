"""n-gram overlap of texts whose gram sets are too large for one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemark.functions.arrays import let
from pagemark.functions.signals import NGRAM_SIZES, gram_counts, hashed_grams, word_hashes

CHUNK_WORDS = 4096
#: Characters of a pair, for each word of a chunk, that one part of its grams stands for.
WORD_CHARS = 8
#: Parts that the grams of a chunk are dealt into as arrays; of more parts, each gram is a row.
ROW_PARTS = 64


def semantic_overlap_exploded(
    pairs: DataFrame, key: str, a: str = "text_a", b: str = "text_b",
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """(key, overlap), equal to ``functions.signals.semantic_overlap``.

    A pair of a chunk of words at most on either side is counted in its row, and only its
    two counts are shuffled. Longer texts are cut into chunks, which overlap so that no
    n-gram is lost; hashes of the grams are built chunk by chunk, so no row holds those of
    a whole text. They are dealt by value into parts and shuffled as arrays by (key, part),
    so the work of one long pair spreads over the cluster and a gram costs eight bytes.
    Rows that share a key are one pair: their grams are dealt in the same way, whatever
    their lengths. A missing text counts as an empty one.
    """
    no_words = F.array().cast("array<bigint>")

    def piece(kind: int, ws: Column, other: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), ws.alias("words"), other.alias("other"))

    def chunks(side: int, ws: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(ws), F.lit(1)), F.lit(chunk_words))
        return F.transform(firsts, lambda i: piece(
            side, F.slice(ws, i, F.lit(chunk_words + max(NGRAM_SIZES) - 1)), no_words))

    def cut(ws: Column) -> Column:
        small = (F.size(ws["a"]) <= chunk_words) & (F.size(ws["b"]) <= chunk_words)
        # without words of its own, a long pair's row keeps the key of one that has no grams
        return F.when((F.col("key_rows") == 1) & small, F.array(piece(0, ws["a"], ws["b"]))).otherwise(
            F.concat(F.array(piece(0, no_words, no_words)), chunks(1, ws["a"]), chunks(2, ws["b"])))

    def row(part: Column, **values: Column) -> Column:
        empty = {"a": no_words, "b": no_words, "shared": F.lit(0), "total": F.lit(0)}
        return F.struct(part.alias("part"), *(values.get(c, v).alias(c) for c, v in empty.items()))

    def side(part: Column, grams: Column) -> Column:
        first = F.col("p.kind") == 1
        return row(part, a=F.when(first, grams).otherwise(no_words),
                   b=F.when(first, no_words).otherwise(grams))

    def dealt(grams: Column) -> Column:
        n = F.col("parts")
        width = F.ceil(F.sqrt(n))  # runs of parts first, then the parts of each run

        def run(first: Column) -> Column:
            last = F.least(first + width, n) - 1
            return let(
                F.filter(grams, lambda g: F.pmod(g, n).between(first, last)),
                lambda some: F.transform(F.sequence(first, last), lambda part: side(
                    part, F.filter(some, lambda g: F.pmod(g, n) == part))),
            )

        runs = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), n - 1, width), run))
        filled = F.filter(runs, lambda r: (F.size(r["a"]) > 0) | (F.size(r["b"]) > 0))
        return F.when(n <= ROW_PARTS, filled).otherwise(
            F.transform(grams, lambda g: side(F.pmod(g, n), F.array(g))))

    def counted(n: Column) -> Column:
        return row(F.lit(-1).cast("long"), shared=n["shared"], total=n["a"] + n["b"] - n["shared"])

    same_key = Window.partitionBy(key)
    chars = F.coalesce(F.length(a), F.lit(0)).cast("long") + F.coalesce(F.length(b), F.lit(0))
    n_parts = F.floor(F.sum(chars).over(same_key) / F.lit(chunk_words * WORD_CHARS)) + 1
    sized = pairs.select(
        key, F.struct(a, b).alias("texts"), F.count(F.lit(1)).over(same_key).alias("key_rows"),
        n_parts.alias("parts"),
    ).withColumn("parts", F.when(F.col("key_rows") == 1, F.least("parts", F.lit(ROW_PARTS))).otherwise(F.col("parts")))
    hashed = F.struct(word_hashes(F.col("texts")[a]).alias("a"), word_hashes(F.col("texts")[b]).alias("b"))
    pieces = sized.select(key, "parts", F.explode(let(hashed, cut)).alias("p"))
    grams = F.array_distinct(F.concat(*(hashed_grams(F.col("p.words"), n) for n in NGRAM_SIZES)))
    rows = pieces.select(key, F.explode(
        F.when(F.col("p.kind") == 0, F.array(let(gram_counts(F.col("p.words"), F.col("p.other")), counted)))
        .otherwise(let(grams, dealt))
    ).alias("r")).select(key, "r.*")
    # dealt first, so that arrays are not gathered on the side that makes them
    sets = rows.repartition(key, "part").groupBy(key, "part").agg(
        F.sum("shared").alias("shared"), F.sum("total").alias("total"),
        F.array_distinct(F.flatten(F.collect_list("a"))).alias("a"),
        F.array_distinct(F.flatten(F.collect_list("b"))).alias("b"),
    )
    met = F.size(F.array_intersect("a", "b"))
    counts = sets.select(
        key, (F.col("shared") + met).alias("shared"),
        (F.col("total") + F.size("a") + F.size("b") - met).alias("total"),
    ).groupBy(key).agg(F.sum("shared").alias("shared"), F.sum("total").alias("total"))
    return counts.select(
        key, F.when(F.col("total") == 0, 0.0).otherwise(F.col("shared") / F.col("total")).alias("overlap")
    )
