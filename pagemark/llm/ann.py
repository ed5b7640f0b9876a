"""Nearest neighbours by inner product from balanced posting lists.

Vectors are turned into ones of equal length by one more component, so that the largest
inner product is the smallest distance. Centroids come from a bounded sample; every
vector is put into the list of its nearest centroid, and, near a boundary, into those of
others whose distance is within ``CLOSURE`` of it, unless a centroid already chosen is
nearer to them than half the vector's distance. Lists of more than ``PART_ROWS`` vectors are cut into
parts by a hash, so every block of the index is of about one size.

A query finds centroids by a walk over a graph of their neighbours that is held in memory
(at most ``MAX_LISTS`` of them), which widens until it is past ``RATIO`` times the least
distance; the lists within that ratio, and some at least, are its probes, nearest first.
They are searched in rounds, the first ``FIRST`` lists and then ``GROWTH`` times as many as
before. Queries of a list are gathered in blocks and meet its blocks in an equi-join; a
task multiplies two matrices. After a round the worst answer so far is a bound: later
rounds pass on only what reaches it, and skip lists that lie beyond it as a whole (the
distance of their centroid less the farthest member's). So what is passed on grows with
the queries, not with the lists that they search. Scores are computed anew from the
original vectors in double precision, always in the same order, for all that come within
rounding of the bound, so ties are decided by the smaller id alone.

Equal vectors are indexed and asked once: for k answers the k + 1 smallest ids of each
are enough, so neither a vector that a third of the rows share nor a query that is asked
very often makes a group that grows.

Defined results: vectors that are null, zero, or hold nulls or numbers that are not
finite take no part; those of each length are searched for themselves; a query with fewer
candidates gets all that its lists hold; repeated rows of an id count once if the vectors
are equal; an empty table gives no rows; columns other than ``vec_id`` and ``embedding`` are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemark.llm.common import prepare, settle

SAMPLE = 20_000
#: The sample is smaller for long vectors.
SAMPLE_BYTES = 64 << 20
LIST_ROWS = 512
MAX_LISTS = 4_096
PART_ROWS = 1_024
REPLICAS = 2
CLOSURE = 1.02
DIVERSITY = 0.25
RATIO = 1.14
LEAST_PROBES = 8
FIRST, GROWTH = 4, 4
#: Relative; many times what a product of two rows can be off by.
ROUNDING = 1e-9
BEAM = 64
DEGREE = 24
ROUNDS = 12
ROWS = 512


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, in double precision."""
    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T)
    return np.maximum(out, 0)


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means in which lists that are too large are made to look farther away."""
    draw = np.random.Generator(np.random.PCG64(7))
    centroids = sample[draw.choice(len(sample), lists, replace=False)].copy()
    share = len(sample) / lists
    extra = np.zeros(lists)
    for _ in range(rounds):
        own = np.empty(len(sample), dtype=np.int64)
        spread = 0.0
        for begin in range(0, len(sample), ROWS):
            away = distances(sample[begin:begin + ROWS], centroids)
            own[begin:begin + ROWS] = (away + extra).argmin(axis=1)
            spread += away.min(axis=1).sum()
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        lost = np.flatnonzero(~full)
        if len(lost):
            centroids[lost] = sample[draw.choice(len(sample), len(lost))]
        extra += 0.1 * spread / len(sample) * (counts / share - 1).clip(-1, 1)
    return centroids


class CentroidGraph:
    """Centroids, each linked to its neighbours in diverse directions and to some far ones."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.centroids = centroids
        n = len(centroids)
        draw = np.random.Generator(np.random.PCG64(11))
        self.links = np.zeros((n, degree), dtype=np.int64)
        for begin in range(0, n, ROWS):
            away = distances(centroids[begin:begin + ROWS], centroids)
            near = np.argsort(away, axis=1)[:, :degree - 4]
            rows = near.shape[0]
            self.links[begin:begin + rows, :near.shape[1]] = near
            self.links[begin:begin + rows, near.shape[1]:] = draw.integers(
                0, n, (rows, degree - near.shape[1]))
        self.links.sort(axis=1)
        self.repeats = np.zeros(self.links.shape, dtype=bool)
        self.repeats[:, 1:] = self.links[:, 1:] == self.links[:, :-1]
        self.entries = draw.choice(n, min(n, 16), replace=False)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nearest centroids that the walk met, nearest first, and distances."""
        n, rows = len(self.centroids), len(queries)
        beam = min(beam, n)
        own = np.arange(rows)
        ids = np.tile(self.entries, (rows, 1))
        away = distances(queries, self.centroids[self.entries])
        seen = np.zeros((rows, n), dtype=bool)
        seen[:, self.entries] = True
        spent = np.zeros(ids.shape, dtype=bool)
        while True:
            order = np.argsort(away, axis=1, kind="stable")[:, :beam]
            ids, away, spent = (np.take_along_axis(x, order, axis=1) for x in (ids, away, spent))
            at = (spent | ~np.isfinite(away)).argmin(axis=1)
            go = ~spent[own, at] & np.isfinite(away[own, at])
            if not go.any():
                return ids, away
            spent[own, at] = True
            node = ids[own, at]
            new = self.links[node]
            gap = queries[:, None, :] - self.centroids[new]
            found = np.einsum("qnd,qnd->qn", gap, gap)
            found[seen[own[:, None], new] | self.repeats[node] | ~go[:, None]] = np.inf
            seen[own[:, None], new] |= go[:, None]
            ids = np.concatenate((ids, new), axis=1)
            away = np.concatenate((away, found), axis=1)
            spent = np.concatenate((spent, np.zeros(new.shape, dtype=bool)), axis=1)


    def within(self, queries: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """``search`` with a beam wide enough to pass the ratio for every query."""
        beam = BEAM
        while True:
            ids, away = self.search(queries, beam)
            if ids.shape[1] >= len(self.centroids) or (away[:, -1] > away[:, 0] * ratio * ratio).all():
                return ids, away
            beam *= 2


def closure_lists(x: np.ndarray, centroids: np.ndarray, replicas: int = REPLICAS,
                  closure: float = CLOSURE) -> tuple[list[list[int]], list[list[float]]]:
    """The lists of each vector, and its distances: its nearest, and others near its boundary
    in other directions."""
    away = distances(x, centroids)
    wide = min(4 * replicas, len(centroids))
    near = np.argpartition(away, wide - 1, axis=1)[:, :wide]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(away, near, 1), axis=1, kind="stable"), 1)
    out, far = [], []
    for row, order in enumerate(near.tolist()):
        own = away[row]
        chosen = [order[0]]
        limit = own[order[0]] * closure * closure
        for c in order[1:]:
            if own[c] > limit or len(chosen) == replicas:
                break
            gap = centroids[chosen] - centroids[c]
            if ((gap * gap).sum(axis=1) >= DIVERSITY * own[c]).all():
                chosen.append(c)
        out.append(chosen)
        far.append(own[chosen].tolist())
    return out, far


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors that take part."""
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).filter(F.col("vec_id").isNotNull()).filter(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).filter(F.exists("vector", lambda x: x != 0))


def _classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(class_id, ids, vector): equal vectors once, with their ``keep`` smallest ids."""
    keyed = vectors.select(
        "vec_id", "vector", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(7), "vector").alias("g")
    )
    order = Window.partitionBy("h", "g").orderBy("vec_id")
    few = keyed.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= keep)
    return few.groupBy("h", "g").agg(
        F.min("vec_id").alias("class_id"), F.array_sort(F.collect_set("vec_id")).alias("ids"),
        F.first("vector").alias("vector"),
    )


def _sample(classes: DataFrame, total: int, rows: int) -> np.ndarray:
    """``rows`` vectors or all: those of the smallest hashes, of which few more reach one task."""
    few = classes.select("vector", "class_id", F.xxhash64("class_id").alias("h"))
    if total > 2 * rows:
        few = few.filter(F.pmod("h", F.lit(total)) < 2 * rows)
    return matrix(few.orderBy("h", "class_id").limit(rows).select("vector").toArrow().column("vector").combine_chunks())


def _blocks(rows: DataFrame, by: str, name: str, others: tuple[str, ...] = ()) -> DataFrame:
    """Rows (list, <name>, vectors, others): the rows of a list in parts of about PART_ROWS."""
    counts = rows.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    parted = rows.join(F.broadcast(counts), "list").withColumn(
        "part", F.pmod(F.xxhash64(F.lit(3), by), F.col("parts"))
    )
    packed = parted.groupBy("list", "part").agg(F.collect_list(F.struct(by, "vector", *others)).alias("rows"))
    return packed.select(
        "list", F.col(f"rows.{by}").alias(name), F.flatten("rows.vector").alias(f"{name}_vectors"),
        *(F.col(f"rows.{c}").alias(c) for c in others),
    )


def best_of_block(asks: np.ndarray, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, x: np.ndarray,
                  best: int) -> Iterator[pa.RecordBatch]:
    """Rows (ask, class_id, score): the ``best`` of a block for each ask, if they reach its bound."""
    rough = q @ x.T
    least = bound
    if len(ids) > best:
        least = np.maximum(least, np.partition(rough, len(ids) - best, axis=1)[:, len(ids) - best])
    slack = ROUNDING * np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1).max())
    row, column = np.nonzero(rough >= (least - slack)[:, None])
    step = max(1, (1 << 22) // q.shape[1])
    exact = np.concatenate([np.zeros(0)] + [
        (q[row[i:i + step]] * x[column[i:i + step]]).sum(axis=1) for i in range(0, len(row), step)])
    order = np.lexsort((ids[column], -exact, row))
    row, column, exact = row[order], column[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = (place < best) & (exact >= bound[row])
    yield pa.RecordBatch.from_arrays(
        [pa.array(asks[row[kept]]), pa.array(ids[column[kept]]), pa.array(exact[kept])], ["ask", "class_id", "score"])


SCHEMA = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query (vec_id, embedding), itself left out."""
    prepare(vectors.sparkSession)
    points, asked = usable(vectors), usable(queries)
    lengths = [r.n for r in points.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    parts = [_nearest(points.filter(F.size("vector") == n), asked.filter(F.size("vector") == n), k, n)
             for n in lengths]
    return reduce(DataFrame.unionByName, parts, vectors.sparkSession.createDataFrame([], SCHEMA)) if (
        len(parts) != 1) else parts[0]


def _nearest(points: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    spark = points.sparkSession
    classes = settle(_classes(points, k + 1), "ann-classes")
    total, longest = classes.agg(
        F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    ).first()
    asked = settle(queries.select(
        F.col("vec_id").alias("query_id"), "vector", F.xxhash64("vector").alias("h"),
        F.xxhash64(F.lit(7), "vector").alias("g"),
    ).distinct(), "ann-queries")

    sample = _sample(classes, total, max(256, min(SAMPLE, SAMPLE_BYTES // (8 * width))))
    lengthened = lambda x: np.concatenate(
        (x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None]), axis=1)
    lists = int(max(1, min(MAX_LISTS, total // LIST_ROWS, len(sample) // 4)))
    graph = CentroidGraph(balanced_centroids(lengthened(sample), lists))
    held = spark.sparkContext.broadcast(graph)

    def assign(batches):
        centroids = held.value.centroids
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                chosen, away = closure_lists(lengthened(matrix(part.column("vector"))), centroids)
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(c) for c in chosen]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for own in chosen for c in own], pa.int32()),
                     part.column("class_id").take(at), part.column("vector").take(at),
                     pa.array([a for own in away for a in own], pa.float64())],
                    ["list", "class_id", "vector", "away"],
                )

    postings = settle(classes.select("class_id", "vector").mapInArrow(
        assign, "list int, class_id long, vector array<double>, away double"), "ann-postings")
    # one row for each list
    shapes = settle(postings.groupBy("list").agg(
        F.count("*").alias("n"), F.sqrt(F.max("away")).alias("reach")), "ann-lists")
    sizes = np.zeros(lists, dtype=np.int64)
    for row in shapes.collect():
        sizes[row["list"]] = row["n"]
    sized = spark.sparkContext.broadcast(sizes)
    needed = 2 * REPLICAS * (k + 1)

    def probe(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                x = matrix(part.column("vector"))
                met, away = held.value.within(np.concatenate((x, np.zeros((len(x), 1))), axis=1), RATIO)
                chosen, far_ = [], []
                for own, far in zip(met, away):
                    held_rows = np.cumsum(sized.value[own])
                    wanted = max(LEAST_PROBES, int((far <= far[0] * RATIO * RATIO).sum()))
                    enough = int(np.searchsorted(held_rows, needed)) + 1
                    chosen.append(own[:max(wanted, enough)])
                    far_.append(far[:max(wanted, enough)])
                counts = [len(c) for c in chosen]
                at = pa.array(np.repeat(np.arange(part.num_rows), counts))
                place = np.concatenate([np.arange(n) for n in counts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(chosen), pa.int32()), part.column("ask").take(at),
                     pa.array(place, pa.int32()), pa.array(np.sqrt(np.concatenate(far_)), pa.float64())],
                    ["list", "ask", "place", "away"],
                )

    asks = settle(asked.groupBy("h", "g").agg(
        F.min("query_id").alias("ask"), F.first("vector").alias("vector")), "ann-asks")
    # written in few small files, and a walk is much work
    tasks = max(1, min(asks.count() // 64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    probes = settle(asks.select("ask", "vector").repartition(tasks, F.xxhash64("ask")).mapInArrow(
        probe, "list int, ask long, place int, away double"), "ann-probes")
    best = k + 1

    def score(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                asks_, ids, bound = (np.array(batch.column(c)[row].values) for c in ("asks", "points", "bound"))
                q = np.array(batch.column("asks_vectors")[row].values).reshape(len(asks_), -1)
                x = np.array(batch.column("points_vectors")[row].values).reshape(len(ids), -1)
                yield from best_of_block(asks_, q, bound, ids, x, best)

    order = Window.partitionBy("ask").orderBy(F.desc("score"), "class_id")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    last = probes.agg(F.max("place")).first()[0]
    top, begin, end = None, 0, FIRST
    while last is not None and begin <= last:
        now = probes.filter(F.col("place").between(begin, end - 1)).join(F.broadcast(shapes), "list")
        now = now.join(asks.select("ask", "vector"), "ask")
        if top is None:
            now = now.withColumn("bound", F.lit(float("-inf")))
        else:
            bounds = top.groupBy("ask").agg(F.min("score").alias("bound"), F.count("*").alias("found")).select(
                "ask", F.when(F.col("found") >= best, F.col("bound")).alias("bound"))
            now = now.join(bounds, "ask", "left").fillna(float("-inf"), ["bound"])
            # the distance of the worst answer so far; what is in a list is no nearer than this
            worst = F.sqrt(F.greatest(square + longest - 2 * F.col("bound"), F.lit(0.0)))
            now = now.filter(F.col("away") - F.col("reach") <= worst * (1 + 1e-6) + longest ** 0.5 * 1e-6)
        met = _blocks(now.select("list", "ask", "vector", "bound"), "ask", "asks", ("bound",)).join(
            _blocks(postings.select("list", "class_id", "vector"), "class_id", "points"), "list").drop("list")
        found = met.mapInArrow(score, "ask long, class_id long, score double")
        found = found if top is None else found.unionByName(top)
        # a vector may stand in several lists
        top = settle(found.distinct().withColumn("at", F.row_number().over(order)).filter(
            F.col("at") <= best).drop("at"), "ann-found")
        begin, end = end, end + (end - begin) * GROWTH
    if top is None:
        return spark.createDataFrame([], SCHEMA)
    named = top.join(classes.select("class_id", "ids"), "class_id").select(
        "ask", "score", F.explode("ids").alias("vec_id")
    )
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    answers = named.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= best).drop("at")
    same = asked.join(asks.select("h", "g", "ask"), ["h", "g"]).select("query_id", "ask")
    own = settle(answers, "ann-answers").join(same, "ask").filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
