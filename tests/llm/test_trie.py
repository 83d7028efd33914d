"""The conversation trie against a plain dictionary of prefixes, with nulls, ties, repeats and long conversations."""

import hashlib
import random
import zlib

import pytest

from threadloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, s string, p string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def brute(rows, stride, heads):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    strings = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % stride) * (1 if c >= 0 else -1)
        strings[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = {}
    for c, s in strings.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        kids = children.get(n, [])
        leaves[n] = sum(leaves[k] for k in kids) if kids else 1
        saved[n] = sum(saved[k] for k in kids) + ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
    out = []
    for n, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(strings[c]) == len(n)))
        out.append((min(convs), len(n), min(nodes[n[:-1]]) if n else None, len(convs), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def talk(seed, n, words, longest, step=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        c = k * step - 20
        for t in range(rnd.randint(1, longest)):
            rows.append((c, rnd.choice([None, t, t, t]), rnd.choice(["user", "user", None]), rnd.choice([None, "", "ç漢", *words])))
    return rows


@pytest.mark.parametrize("heads,rows", [(6, talk(1, 150, ["a", "bb"], 9)), (1, talk(2, 80, ["a"], 6, 7)), (6, talk(3, 40, ["x" * 50], 60))])
def test_trie_equals_brute_force(spark, heads, rows):
    rows += [(None, 1, "user", "lost"), rows[0], rows[0]]
    got = trie.expand(trie.build(frame(spark, rows).repartition(6), heads=heads))
    assert rows_of(got) == sorted(brute(rows, trie.STRIDE, heads), key=str)


def test_caterpillar_and_copies(spark):
    """Strings that leave one long string at every depth, and many equal ones."""
    rows = [(k, t, "u", f"t{t}" if t < k else f"own {k}") for k in range(1, 40) for t in range(k + 1)]
    rows += [(k, t, "u", f"t{t}") for k in range(100, 160) for t in range(3)]
    got = trie.expand(trie.build(frame(spark, rows), heads=1))
    assert rows_of(got) == sorted(brute(rows, trie.STRIDE, 1), key=str)


def test_one_conversation_over_many_partitions(spark):
    rows = [(7, t, "u", f"turn {t % 50}") for t in range(3000)] + [(8, t, "u", f"turn {t % 50}") for t in range(900)]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(trie.expand(trie.build(frame(spark, rows).repartition(8), heads=1)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert got == sorted(brute(rows, trie.STRIDE, 1), key=str)


def test_turnless_and_empty(spark):
    assert trie.expand(trie.build(frame(spark, []))).count() == 0
    picks = [c for c in range(100) if zlib.crc32(str(c).encode()) % 6 >= 3][:2]
    rows = [(1000 + 100 * c + c, 1, "u", "short") for c in picks] + [(c, 1, "u", "short") for c in picks if c % 100]
    assert rows_of(trie.expand(trie.build(frame(spark, rows)))) == sorted(brute(rows, 100, 6), key=str)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 20) for b in range(a + 1, 40)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", trie.two_fattest("a", "b").alias("f")).collect()
    for r in got:
        assert r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda n: n & -n)
