"""What the operators share: tables, shared scratch tables, text slices, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of about this many bytes are worked on at a time inside a Python task. Numpy copies
#: take many times that, two tasks share an executor, and workers keep what they once used.
SLICE_BYTES = 1 << 20
#: Arrow batches that reach Python tasks stay under this size (but for one longer row).
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, and let Python tasks find the library where the driver did."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pagemark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as a table in the shared folder and read it again.

    Cuts the lineage, and what is computed once is not computed again for each use or
    when an executor is lost.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``limit`` bytes in ``column``, but at least one row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = total = 0
        for row, size in enumerate(sizes):
            if row > begin and total + size > limit:
                yield batch.slice(begin, row - begin)
                begin, total = row, 0
            total += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def tidy(run: Callable[[Iterator], Iterator], *clear: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """The same map over batches, after which its Python worker gives memory back.

    Workers live on and serve the tasks of other stages; what they remember and what the
    allocators hold would add up from stage to stage.
    """
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for forget in clear:
                forget()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the links (a, b): one row (node, component) per node.

    ``component`` is the smallest node of the component. Every round hooks each node to
    its smallest smaller neighbour, shortens the resulting trees to their roots, and goes
    on with the links between roots. A round at least halves the nodes that have links
    left, so rounds grow with the logarithm of the nodes. All steps are aggregations and
    equi-joins on tables in the shared folder; a node with many links is combined before
    the shuffle. Null ends and self-links are ignored; no links give no rows.
    """
    ordered = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).filter("a > b and b is not null")
    links = settle(ordered.distinct(), name)
    labels = None
    while not links.isEmpty():
        parents = settle(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), name)
        while True:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            parents = settle(
                parents.join(above, "root", "left").select(
                    "node", F.coalesce("above", "root").alias("root"),
                    F.col("above").isNotNull().alias("moved"),
                ), name,
            )
            moved = not parents.filter("moved").isEmpty()
            parents = parents.select("node", "root")
            if not moved:
                break
        if labels is None:
            labels = parents
        else:
            higher = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            labels = labels.join(higher, "root", "left").select(
                "node", F.coalesce("higher", "root").alias("root")
            ).unionByName(parents.join(labels.select("node"), "node", "left_anti"))
            labels = settle(labels, name)
        left = parents.select(F.col("node").alias("a"), F.col("root").alias("up_a"))
        right = parents.select(F.col("node").alias("b"), F.col("root").alias("up_b"))
        raised = links.join(left, "a", "left").join(right, "b", "left").select(
            F.coalesce("up_a", "a").alias("a"), F.coalesce("up_b", "b").alias("b")
        )
        links = settle(raised.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).filter("a > b").distinct(), name)
    if labels is None:
        return ordered.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    roots = labels.select(F.col("root").alias("node")).distinct().join(
        labels.select("node"), "node", "left_anti"
    )
    return labels.select("node", F.col("root").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def free_name(columns: Iterable[str], wanted: str) -> str:
    """A column name that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
