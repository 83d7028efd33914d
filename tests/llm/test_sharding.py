"""Shards against a walk over all capacities, with giants, ties, nulls and repeated rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard string, other string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "mine") for i, t in rows], SCHEMA)


def brute(rows, shards):
    """Expected (id, size, crc, shard, slot), by trying capacities one after the other."""
    import hashlib

    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    size = {t: (len(t.encode()) + 1) * len(ids) for t, ids in groups.items()}
    key = {t: (min([i for i in ids if i is not None], default=None) is None, min([i for i in ids if i is not None], default=0), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()}
    left, shard, giants = sum(size.values()), {}, 0
    for t in sorted(groups, key=lambda t: (-size[t], key[t])):
        if size[t] * (shards - giants) <= left:
            break
        shard[t], left, giants = giants, left - size[t], giants + 1
    order = sorted((t for t in groups if t not in shard), key=key.get)

    def walk(capacity):
        out, n, room = {}, giants, capacity
        for t in order:
            if size[t] > capacity:
                return None
            if size[t] > room:
                n, room = n + 1, capacity
            room -= size[t]
            out[t] = n
        return out if n < shards or not order else None

    capacity = max([size[t] for t in order], default=0)
    while order and walk(capacity) is None:
        capacity += 1
    shard |= walk(capacity) or {}
    out, slots = [], {}
    for t in sorted(groups, key=lambda t: (shard[t], t in order, key[t])):
        for i in sorted(groups[t], key=lambda i: (i is None, i or 0)):
            slots[shard[t]] = slots.get(shard[t], -1) + 1
            out.append((i, len(t.encode()) + 1, zlib.crc32(t.encode()), shard[t], slots[shard[t]]))
    return out


def odd_rows(seed, n, hot=0):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, rnd.randint(-50, 500)]), rnd.choice([None, "", "ç漢 ", "x" * rnd.randint(1, 90), f"t{rnd.randint(0, 5)}" * 9])) for _ in range(n)]
    return rows + [(1000 + i, "hot text " * 5) for i in range(hot)]


@pytest.mark.parametrize("rows,shards,cells", [(odd_rows(1, 120), 8, 1 << 14), (odd_rows(2, 90, 80), 8, 4), (odd_rows(3, 5), 8, 7), (odd_rows(4, 60, 60), 3, 2), ([(1, "a")], 8, 64)])
def test_shards_equal_brute_force(spark, rows, shards, cells):
    got = sharding.assign(frame(spark, rows).repartition(5), shards=shards, cells=cells).collect()
    key = lambda r: (r[3], r[4])
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got), key=key) == sorted(brute(rows, shards), key=key)
    assert {r["other"] for r in got} == {"mine"}


def test_search_equals_all_capacities():
    rnd = random.Random(6)
    for n, shards, cells in [(1, 1, 4), (3, 5, 4), (40, 3, 2), (200, 7, 16), (500, 2, 9), (300, 8, 1000)]:
        sizes = [rnd.choice([1, 2, 3, 50, rnd.randint(1, 400)]) for _ in range(n)]
        ends = np.cumsum(sizes)
        asked = []

        def largest_ends(left, right):
            asked.append(len(left))
            return np.array([max([e for e in ends.tolist() if a < e <= b], default=-1) for a, b in zip(left, right)])

        capacity, cuts = sharding.minimax_cuts(largest_ends, int(ends[-1]), max(sizes), shards, cells)

        def walk(c):
            out, room = [], c
            for e, s in zip(ends.tolist(), sizes):
                if s > room:
                    out.append(e - s)
                    room = c
                room -= s
            return out

        want = next(c for c in range(max(sizes), int(ends[-1]) + 1) if len(walk(c)) < shards)
        assert capacity == want and cuts == walk(want)
        assert max(asked, default=0) <= max(2 * n + 2 * shards, 2 * cells)


def test_empty_and_write(spark, tmp_path):
    assert sharding.assign(frame(spark, [])).count() == 0
    rows = odd_rows(9, 50)
    sharding.write(frame(spark, rows).drop("size", "shard"), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 50 and back.where(F.col("other") != "mine").count() == 0
    spans = back.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 for r in spans)
