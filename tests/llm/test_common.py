"""Components against union-find, slices of batches, scratch tables."""

import random

import pyarrow as pa
import pytest

from pagemark.llm import common


def plain(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    return {x: top(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["path", "star", "random", "shuffled path"])
def test_components(spark, kind):
    rng = random.Random(len(kind))
    names = list(range(-60, 60))
    if kind == "shuffled path":
        rng.shuffle(names)
    if kind.endswith("path"):
        edges = list(zip(names, names[1:]))
    elif kind == "star":
        edges = [(7, n) for n in names if n != 7]
    else:
        edges = [(rng.choice(names), rng.choice(names)) for _ in range(70)]
    edges = [(a, b) for a, b in edges if a != b]
    rows = [*edges, *edges[:5], (3, 3), (None, 4), (5, None)]
    got = common.components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == plain(edges)
    assert len(got) == len({r.node for r in got})


def test_no_links(spark):
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_slices():
    texts = ["a" * 10, None, "b" * 100, "", "c" * 3, "d" * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    cut = [b.column("text").to_pylist() for b in common.slices(iter([batch]), limit=12)]
    assert cut == [["a" * 10, None], ["b" * 100], ["", "c" * 3, "d" * 4]]
    assert list(common.slices(iter([batch.slice(0, 0)]))) == []


def test_settle(spark):
    df = common.settle(spark.range(5).filter("id > 9"), "none")
    assert df.columns == ["id"] and df.collect() == []
