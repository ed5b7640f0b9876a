"""Line dedup: near-equal lines found by a segment-partition edit join.

Two lines of at least ``MIN_CHARS`` characters are linked if at most ``EDITS`` single
character edits apart. A line is cut into EDITS + 1 segments of even length; a line that
is within EDITS of it holds at least one of them unchanged, and only near the same place.
So every line is indexed by its segments, each hashed with its number and the length of
the line, and probed with those of its substrings that may be a segment of a line up to
EDITS characters shorter (the places that remain when the edits on both sides of the
segment are counted). Candidates share a hash and, with an edit changing the counts of
letters by two at most, have nearly the same letters; they are verified by an edit
distance that keeps the 2 * EDITS + 1 cells about the diagonal as bits of one number.

Copies of a line are combined before they are indexed. Within a key, lines are first
linked to the smallest indexed line of the key; only keys that then still hold several
groups are joined, and only lines of different groups, so a group of near copies does not
meet itself pair by pair. Many different lines may share a segment too (a URL prefix, a
time stamp). What two near lines have beside a shared segment is within EDITS as well, so
keys of more than ``CROWD`` rows are extended: the rest of the line is cut and probed in the
same way, and lines meet only if they share a segment of the rest as well, and again for
what is still crowded, up to ``LEVELS`` times. Lines that share that many segments, and so
nearly all of their text, meet pair by pair in the end.

Everything is DataFrame functions: no Python on executors, nothing collected. The ids of at
most ``broadcast_rows`` lines that have candidates are broadcast; more go through a shuffle.

A line is named by its 64-bit hash; two different lines share one with a probability of
about n * n / 2 ** 65 for n lines.

Defined results: shorter lines are never linked or removed; null texts have no lines and
stay null; rows that repeat both id and text count as one document and come out alike; a
null id comes first in the order of documents; an empty table gives no rows; a very long text
or line is one row's work; ``line_classes`` reads doc_id and text alone, and ``dedupe_lines`` gives
all other columns back as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemark.llm.common import components, free_name, settle

EDITS = 2
CROWD = 32
LEVELS = 3
MIN_CHARS = 20
#: An edit changes the counts of letters by two at most.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def segment_keys(line: Column, length: Column, edits: int = EDITS) -> list[tuple[Column, int, bool, Column, Column]]:
    """(key, shorter, own, at, size) of the line's own segments, and of its substrings that may
    be segments of lines that are ``shorter`` characters shorter."""
    parts = edits + 1
    out = []
    for shorter in range(edits + 1):
        of = length - shorter
        for part in range(parts):
            begin = F.floor(of * part / parts).cast("int")
            size = F.floor(of * (part + 1) / parts).cast("int") - begin
            left, right = part, edits - part  # edits that may stand before and behind
            for shift in range(max(-left, shorter - right), min(left, shorter + right) + 1):
                key = F.xxhash64(F.substr(line, begin + shift + 1, size), of * parts + part)
                out.append((key, shorter, not shorter and not shift, begin + shift, size))
    return out


def _spot(at: Column, size: Column, shorter: int) -> Column:
    """Place and size of a segment, and how much shorter the line sought is, as one number."""
    return F.shiftleft(at.cast("long"), 32) + size.cast("long") * 16 + shorter


def edit_distance(a: str, b: str, edits: int = EDITS) -> Column:
    """The edit distance of two columns if it is at most ``edits``, else a larger number.

    What both begin or end with is left out. Then one step for each character of ``b``
    moves the band: bit k of the numbers stands for row j - edits + k at column j.
    """
    width, top = 2 * edits + 1, 2 * edits
    full = (1 << width) - 1
    steps = F.array(*(F.lit(1 << p) for p in range(26, -1, -1)))

    def common(x: Column, y: Column) -> Column:
        room = F.least(F.length(x), F.length(y))
        return F.aggregate(steps, F.lit(0), lambda n, s: F.when(
            (n + s <= room) & (F.substr(x, n + 1, s) == F.substr(y, n + 1, s)), n + s
        ).otherwise(n))

    def characters(trimmed: Column) -> Column:
        return F.split(trimmed, "")

    def banded(pattern: Column, text: Column, m: Column) -> Column:
        vp = sum(1 << k for k in range(width) if k >= edits)
        start = F.struct(
            _long(vp).alias("vp"), _long(0).alias("vn"),
            F.least(F.lit(edits), m).cast("long").alias("d"),
        )

        def step(state: Column, pair: Column) -> Column:
            # first the match bits, bound once, then the additions along the band
            j = pair["j"]
            match = _long(0)
            for k in range(width):
                i = j - edits + k
                match = match + F.when(
                    (i >= 1) & (F.get(pattern, i - 1) == pair["c"]), _long(1 << k)
                ).otherwise(_long(0))
            return _bind(match, lambda pm: _advance(state, pm, j, m))

        def _advance(state: Column, pm: Column, j: Column, m: Column) -> Column:
            vp, vn = state["vp"], state["vn"]
            carry = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)
            d0_of = carry.bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(_long(full))

            def with_d0(d0: Column) -> Column:
                hp_of = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(_long(full))
                hn = d0.bitwiseAND(vp)
                down = F.shiftright(d0, 1)

                def with_hp(hp: Column) -> Column:
                    low = F.when(j + edits <= m, F.lit(top)).otherwise(m - j + edits).cast("int")
                    bit = lambda x: F.getbit(x, low).cast("long")
                    moved = F.when(
                        j + edits <= m, _long(1) - bit(d0)
                    ).otherwise(bit(hp) - bit(hn))
                    return F.struct(
                        hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(_long(full)).alias("vp"),
                        down.bitwiseAND(hp).alias("vn"),
                        (state["d"] + moved).alias("d"),
                    )

                return _bind(hp_of, with_hp)

            return _bind(d0_of, with_d0)

        letters = F.transform(text, lambda c, p: F.struct((p + 1).alias("j"), c.alias("c")))
        return F.aggregate(letters, start, step, lambda s: s["d"])

    x, y = F.col(a), F.col(b)
    room = F.least(F.length(x), F.length(y))

    def measured(cut: Column) -> Column:
        head, tail = cut["head"], cut["tail"]
        m, n = F.length(x) - head - tail, F.length(y) - head - tail
        inner = lambda s, size: F.substr(s, head + 1, size)
        return F.when(F.abs(m - n) > edits, _long(edits + 1)).when(
            (m == 0) | (n == 0), F.greatest(m, n).cast("long")
        ).otherwise(_bind(
            F.struct(characters(inner(x, m)).alias("p"), characters(inner(y, n)).alias("t"), m.alias("m")),
            lambda s: banded(s["p"], s["t"], s["m"]),
        ))

    head_of = common(x, y)
    return _bind(head_of, lambda head: _bind(
        F.least(common(F.reverse(x), F.reverse(y)), room - head),
        lambda tail: measured({"head": head, "tail": tail}),
    ))


def _bind(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def eligible_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, line_no, line_id, line, n) of lines that are long enough."""
    lines = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )
    return lines.withColumn("n", F.length("line")).filter(F.col("n") >= min_chars).withColumn(
        "line_id", F.xxhash64("line")
    )


def shared_keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key, line_id, own, spot, main) for keys that an indexed line shares with another line."""
    entries = segment_keys(F.col("line"), F.col("n"), edits)
    keys = [F.first(key).alias(f"k{i}") for i, (key, *_) in enumerate(entries)]
    distinct = lines.groupBy("line_id").agg(F.first("n").alias("n"), *keys)
    rows = F.inline(F.array(*(
        F.struct(F.col(f"k{i}").alias("key"), F.lit(own).alias("own"), _spot(at, size, shorter).alias("spot"))
        for i, (_, shorter, own, at, size) in enumerate(entries)
    )))
    same = Window.partitionBy("key")
    keyed = distinct.select("line_id", rows)
    return keyed.select(
        "key", "line_id", "own", "spot", F.min("line_id").over(same).alias("least"),
        F.max("line_id").over(same).alias("most"),
        F.min(F.when(F.col("own"), F.col("line_id"))).over(same).alias("main"),
    ).filter("least < most and main is not null").select("key", "line_id", "own", "spot", "main")


def _meeting(rows: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b, high, low) of lines of a key that are in different groups and have alike letters."""
    there = rows.select(
        "key", F.col("line_id").alias("b"), F.col("root").alias("root_b"), F.col("outside").alias("b_outside"),
        *(F.col(x).alias(f"b_{x}") for x in LETTERS),
    )
    owners = rows.filter("own").select(
        "key", F.col("line_id").alias("a"), F.col("root").alias("root_a"), F.col("outside").alias("a_outside"),
        *(F.col(x).alias(f"a_{x}") for x in LETTERS),
    )
    return owners.join(there, "key").filter(
        F.expr("root_a != root_b and (a_outside or b_outside)") & _alike(edits)
    ).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"),
        F.greatest("root_a", "root_b").alias("high"), F.least("root_a", "root_b").alias("low"),
    )


def _extended(rows: DataFrame, edits: int) -> DataFrame:
    """The rows of crowded keys under keys that have a segment of the rest of the line as well.

    ``rest`` is what the line has beside the segments of its key so far.
    """
    at, size = F.shiftright("spot", 32), F.shiftright(F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)), 4)
    rest = F.concat(F.substr(F.col("rest"), F.lit(1), at.cast("int")),
                    F.substr("rest", (at + size + 1).cast("int")))
    cut = rows.withColumn("shorter", F.col("spot").bitwiseAND(F.lit(15)).cast("int")).withColumn("rest", rest)
    made = F.array(*(
        F.struct(key.alias("more"), F.lit(shorter).alias("by"), F.lit(own).alias("indexed"),
                 _spot(begin, length, shorter).alias("next"))
        for key, shorter, own, begin, length in segment_keys(F.col("rest"), F.length("rest"), edits)
    ))
    return cut.select("*", F.inline(made)).filter(F.col("by") == F.col("shorter")).select(
        F.xxhash64("key", "more").alias("key"), "line_id", (F.col("own") & F.col("indexed")).alias("own"),
        F.col("next").alias("spot"), "root", "outside", "rest", *LETTERS,
    )


def candidates(rows: DataFrame, texts: DataFrame, edits: int = EDITS, crowd: int = CROWD,
               levels: int = LEVELS) -> DataFrame:
    """Pairs to verify, from rows (key, line_id, own, spot, root, outside, letters) of mixed keys."""
    found = None
    for level in range(1, levels + 1):
        crowded = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max("own").alias("any")).filter(
            (F.col("rows") > crowd) & F.col("any")).select("key")
        if level == levels:
            now, crowded = rows, None
        else:
            crowded = settle(crowded, "line-crowds")
            now = rows.join(crowded, "key", "left_anti")
        pairs = _meeting(now, edits)
        found = pairs if found is None else found.unionByName(pairs)
        if crowded is None or crowded.isEmpty():
            break
        hot = rows.join(crowded, "key", "left_semi")
        if level == 1:
            hot = hot.join(texts.select("line_id", F.col("line").alias("rest")), "line_id")
        rows = settle(_extended(hot, edits), "line-extended")
    return found.distinct()


def _texts_of(lines: DataFrame, ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """(line_id, line, counts of letters) once for each id. Few ids go to the lines, many meet them in a shuffle."""
    if ids.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    texts = lines.join(ids, "line_id", "left_semi").groupBy("line_id").agg(F.first("line").alias("line"))
    counts = [
        (F.length("line") - F.length(F.translate("line", x + x.upper(), ""))).alias(x) for x in LETTERS
    ]
    return texts.select("line_id", "line", *counts)


def _named(texts: DataFrame, side: str) -> DataFrame:
    return texts.withColumnsRenamed({x: f"{side}_{x}" for x in LETTERS} | {"line": f"line_{side}"})


def _alike(edits: int) -> Column:
    """Whether the letters of both sides are such that ``edits`` can be enough."""
    return sum((F.abs(F.col(f"a_{x}") - F.col(f"b_{x}")) for x in LETTERS), F.lit(0)) <= 2 * edits


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Those of the pairs (a, b, ...) whose lines are within ``edits``."""
    left = _named(texts, "a").withColumnRenamed("line_id", "a")
    right = _named(texts, "b").withColumnRenamed("line_id", "b")
    near = _alike(edits) & (edit_distance("line_a", "line_b", edits) <= edits)
    return pairs.join(left, "a").join(right, "b").filter(near).select(*pairs.columns)


def link_lines(lines: DataFrame, edits: int = EDITS, broadcast_rows: int = 500_000) -> DataFrame:
    """(line_id, root) for lines that are linked to another one; root names their group."""
    shared = settle(shared_keys(lines, edits), "line-keys")
    ids = settle(shared.select("line_id").distinct(), "line-ids")
    texts = settle(_texts_of(lines, ids, broadcast_rows), "line-texts")
    star = shared.filter("line_id != main").select(
        F.col("line_id").alias("a"), F.col("main").alias("b")
    ).distinct()
    first = settle(components(_verified(star, texts, edits)), "line-first")
    rooted = first.withColumnsRenamed({"node": "line_id", "component": "root"})
    of_main = first.withColumnsRenamed({"node": "main", "component": "main_root"})
    grouped = settle(
        shared.join(rooted, "line_id", "left").join(of_main, "main", "left").join(
            texts.drop("line"), "line_id"
        ).select(
            "key", "line_id", "own", "spot", F.coalesce("root", "line_id").alias("root"),
            (F.coalesce("root", "line_id") != F.coalesce("main_root", "main")).alias("outside"), *LETTERS,
        ), "line-grouped",
    )
    mixed = grouped.filter("outside").select("key").distinct()
    across = settle(candidates(grouped.join(mixed, "key", "left_semi"), texts, edits), "line-across")
    found = _verified(across, texts, edits).select(F.col("high").alias("a"), F.col("low").alias("b"))
    second = settle(components(found).withColumnsRenamed({"node": "root", "component": "top"}), "line-second")
    alone = second.select(F.col("root").alias("line_id")).join(
        rooted.select("line_id"), "line_id", "left_anti"
    ).select("line_id", F.col("line_id").alias("root"))
    return settle(
        rooted.unionByName(alone).join(second, "root", "left").select(
            "line_id", F.coalesce("top", "root").alias("root")
        ), "line-links",
    )


def line_classes(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per eligible line: its class, where the class comes first, whether it is that line."""
    lines = eligible_lines(documents, min_chars)
    links = link_lines(lines, edits)
    placed = lines.select("doc_id", "text_key", "line_no", "line_id").distinct().join(
        links, "line_id", "left"
    ).select("doc_id", "text_key", "line_no", F.coalesce("root", "line_id").alias("class_id"))
    placed = settle(placed, "line-places")
    place = F.struct("doc_id", "text_key", "line_no")
    repeated = settle(
        placed.groupBy("class_id").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"),
        "line-classes",
    )
    return placed.join(repeated, "class_id", "left").select(
        "doc_id", "text_key", "line_no", "class_id",
        F.coalesce("first.doc_id", "doc_id").alias("first_doc_id"),
        F.coalesce("first.line_no", "line_no").alias("first_line_no"),
        (F.col("first").isNull() | F.col("first").eqNullSafe(place)).alias("kept"),
    )


def dedupe_lines(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All documents and columns; of each class of lines only the first one stays in the texts."""
    own_id, own_text, out = (free_name(documents.columns, c) for c in ("drop_id", "drop_text", "drops"))
    drops = line_classes(documents, edits, min_chars).filter(~F.col("kept")).groupBy(
        F.col("doc_id").alias(own_id), F.col("text_key").alias(own_text)
    ).agg(F.collect_list("line_no").alias(out))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (
        F.xxhash64("text") == F.col(own_text))
    kept = _bind(F.split("text", "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(out)),
        lambda i: F.get(lines, i),
    ), "\n"))
    text = F.when(F.col(out).isNull(), F.col("text")).otherwise(kept)
    return documents.join(drops, same, "left").withColumn("text", text).select(*documents.columns)
