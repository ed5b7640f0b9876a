"""Shards against a plain minimax partition, and the defined results."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagemark.llm import sharding


def plain_capacity(sizes, shards):
    def enough(capacity):
        used, room = 0, 0
        for size in sizes:
            if size > room:
                used, room = used + 1, capacity
            room -= size
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return low


def plain_cuts(sizes, shards):
    capacity, shard, room, out = plain_capacity(sizes, shards), 0, None, []
    for size in sizes:
        room = capacity if room is None else room
        if size > room:
            shard, room = shard + 1, capacity
        room -= size
        out.append(shard)
    return out


def key_of(text):
    return "0" * 33 if text is None else hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("shards", [1, 3, 16])
@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, shards, hot):
    rng = random.Random(shards)
    texts = ["w" * rng.randrange(400) + str(rng.randrange(900)) for _ in range(1500)] + [None, None, "", "é"]
    texts += ["copy " * 20] * (800 if hot else 3)
    rows = [(i if i % 97 else None, t, -1) for i, t in enumerate(texts)] + [(7, "again", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_documents(docs, shards, digits=1).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    sizes = defaultdict(int)
    for _, t, _ in rows:
        sizes[key_of(t)] += len((t or "").encode()) + 1
    keys = sorted(sizes)
    want = dict(zip(keys, plain_cuts([sizes[k] for k in keys], shards)))
    by_crc = {zlib.crc32(t.encode()): want[key_of(t)] for _, t, _ in rows if t}
    assert all(r.shard == by_crc[r.text_crc32] for r in got if r.text_crc32)


def test_random_orders():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 50, rng.randrange(1, 400)]) for _ in range(rng.randrange(1, 60))]
        order = sharding.Order([sharding.Piece(f"{i:04}", s, 1, s) for i, s in enumerate(sizes)])
        shards = rng.randrange(1, 9)
        assert order.least(shards) == plain_capacity(sizes, shards)


def test_empty_and_few(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(empty).collect() == []
    one = spark.createDataFrame([(4, None)], "doc_id long, text string")
    assert [tuple(r) for r in sharding.shard_documents(one).collect()] == [(4, 1, 0, 0, 0)]


def test_slots_of_a_hot_group_are_spread(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_documents(docs)
    assert sorted(r.slot for r in got.collect()) == list(range(5000))
