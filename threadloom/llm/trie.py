"""Prefix trie of conversations, built as a z-fast trie.

A conversation is a string of turns (role, text). A prefix is named by a rolling hash
of 127 bits, so a node of any depth is one key, whatever the length of the texts.

1. Turns are sorted over the cluster by (conversation, turn) and hashed from left to
   right inside each partition. The hash of two pieces one after the other follows from
   the hashes of the pieces, so a conversation may lie in any number of partitions; each
   partition hands on one row about the conversation that it doesn't hold to the end.
2. Conversations may be rebuilt before: with a group size ``stride`` and ``heads``, the
   first h turns come from the group's first conversation (h = crc32(id) % heads). The
   hashes of the rebuilt prefixes follow from those of the two pieces as well.
3. Equal conversations are one string with a weight. The trie is compacted: a node per
   place where strings part or end, with the edge above it. A node is found under its
   handle, the prefix of its edge's two-fattest depth (the depth with the most trailing
   zero bits). A string finds its exit node by fat binary search: the probe at the
   two-fattest depth of what is left of its length tells on which side to go on. The
   handles that a string can meet are handed to it by one join beforehand.
4. Strings are inserted in batches. All open strings are located at once; edges are
   split at all exit points; of the strings that go on from one exit point with the
   same turn one is hung in, the others are located again in the next round, below it.
   It is the one with the most turns from its group's first conversation, which others
   share, and else one drawn by hash, so that few rounds are needed.
5. Members, leaves and sums are added up per compacted node from the strings through
   it, in a grouping that Spark combines inside tasks. Then edges are expanded to one
   row per depth.

Saved tokens of a node: a turn that n conversations share is needed once. Below a
node, the shared cost is the sum over strings of their rest, weighted, less the part of
the rest that each string has added to the trie, which is a stretch at its end.

Cases: rows without a conversation id take no part; a null role or text is empty; turns
are ordered by turn (null first), then role, then text, and a repeated row is one more
turn; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.batches import map_batches
from threadloom.session import cut_lineage

STRIDE, HEADS = 100, 6
#: Prefix hashes are polynomials modulo a prime. The base is fixed, so reruns agree.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(sha256(b"prefix trie").digest()[:15], "big")
ROOT = bytes(16)
#: Ids that a task joins to one piece before the pieces of a node are hashed in order.
PIECE = 4096


@dataclass
class Trie:
    """Compacted nodes with their edges; prefixes of one conversation per string; strings; and all conversations."""

    nodes: DataFrame  # x, p: depth and hash of the extent; up, uph: of the parent's; owner: a string that spells the edge
    prefixes: DataFrame  # s, d, p, c, ch: string, depth, hash, code points up to here and of the last text
    strings: DataFrame  # s (smallest conversation), len, full, weight, chars, c_own (code points that others had added before it)
    members: DataFrame  # conv, full


def _key(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _number(key: bytes) -> int:
    return int.from_bytes(key, "big")


# ---------------------------------------------------------------- prefix hashes


def hashed_turns(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, i, h, c, ch): for every turn its place from 1, the hash of the turns up to it, their code points and its own."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    order = ["conv", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    one = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    ranged = ranged.select("conv", one.alias("one"), F.length("text").cast("long").alias("ch"))

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, first, i, h, c = None, None, 0, 0, 0
        for batch in source:
            out = []
            for key, one, ch in zip(batch.column("conv").to_pylist(), batch.column("one").to_pylist(), batch.column("ch").to_pylist()):
                if key != conv:
                    first = key if conv is None else first
                    conv, i, h, c = key, 0, 0, 0
                i, h, c = i + 1, (h * BASE + _number(one) + 1) % PRIME, c + ch
                out.append((key, i, _key(h), c, ch, key == first))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["conv", "i", "h", "c", "ch", "head"])

    rows = map_batches(ranged, scan, "conv long, i long, h binary, c long, ch long, head boolean")
    rows = cut_lineage(rows.withColumn("part", F.spark_partition_id()))
    ends = rows.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "i", "h", "c")).alias("last"))
    carried: dict[int, tuple[int, int, int]] = {}
    held: tuple[int, int, int, int] | None = None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # one row per partition
        conv, i, h, c = r["last"]["conv"], r["last"]["i"], _number(r["last"]["h"]), r["last"]["c"]
        if held and held[0] == r["first"]:
            carried[r["part"]] = held[1:]
            if conv == held[0]:
                i, h, c = held[1] + i, (held[2] * pow(BASE, i, PRIME) + h) % PRIME, held[3] + c
        held = (conv, i, h, c)

    def carry(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for conv, i, h, c, ch, head, part in zip(*[batch.column(n).to_pylist() for n in ("conv", "i", "h", "c", "ch", "head", "part")]):
                before = carried.get(part) if head else None
                if before:
                    i, h, c = before[0] + i, _key((before[1] * pow(BASE, i, PRIME) + _number(h)) % PRIME), before[2] + c
                out.append((conv, i, h, c, ch))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["conv", "i", "h", "c", "ch"])

    return map_batches(rows, carry, "conv long, i long, h binary, c long, ch long")


def rebuilt(turns: DataFrame, stride: int, heads: int) -> DataFrame:
    """(conv, hb, skip, len, full, chars, delta, c0, head, nxt) per conversation; nxt is its first prefix.

    Its string is the first ``hb`` turns of the group's first conversation and its own
    turns after ``skip``. A prefix that reaches into the own turns has the own prefix's
    hash plus ``delta`` times a power of the base. ``head`` has the ``hb`` first prefixes.
    """
    few = F.collect_list(F.when(F.col("i") <= heads, F.struct("i", "h", "c", "ch")))  # ``heads`` rows at most
    convs = turns.groupBy("conv").agg(F.max(F.struct("i", "h", "c")).alias("end"), F.sort_array(few).alias("own"))
    pick = (F.crc32(F.col("conv").cast("string")) % heads).cast("int")
    both = convs.withColumns({"pick": pick, "base": F.col("conv") - F.col("conv") % stride})
    # fewer than two strides of conversations have one base
    both = both.withColumn("head", F.max(F.when(F.col("conv") == F.col("base"), F.col("own"))).over(W.partitionBy("base")))
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<i:long,h:binary,c:long,ch:long>>")), F.lit(1), F.col("pick"))
    both = both.withColumn("head", head)
    both = both.select("conv", "end", "head", F.size("head").cast("long").alias("hb"), F.least("end.i", F.col("pick").cast("long")).alias("skip"), "own")
    last = lambda a, n, field: F.get(a, (n - 1).cast("int")).getField(field)
    sides = both.select(
        "conv", "head", "hb", "skip", (F.col("end.i") - F.col("skip")).alias("m"), F.col("end.h").alias("h"),
        last("head", F.col("hb"), "h").alias("h_base"), last("own", F.col("skip"), "h").alias("h_skip"),
        F.get("head", F.lit(0)).getField("h").alias("h_first"), last("own", F.col("skip") + 1, "h").alias("h_own"),
        (F.coalesce(last("head", F.col("hb"), "c"), F.lit(0)) - F.coalesce(last("own", F.col("skip"), "c"), F.lit(0))).alias("c0"), F.col("end.c").alias("c"),
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            delta, full, nxt = [], [], []
            for m, h, base, skip, first, own in zip(*[batch.column(n).to_pylist() for n in ("m", "h", "h_base", "h_skip", "h_first", "h_own")]):
                d = ((_number(base) if base else 0) - (_number(skip) if skip else 0)) % PRIME
                delta.append(_key(d))
                full.append(_key((_number(h) + d * pow(BASE, m, PRIME)) % PRIME))
                nxt.append(first or (_key((_number(own) + d * BASE) % PRIME) if own and m else None))
            names = ["conv", "head", "hb", "skip", "m", "c0", "c"]
            made = [pa.array(x, pa.binary()) for x in (delta, full, nxt)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], [*names, "delta", "full", "nxt"])

    kind = sides.schema["head"].dataType.simpleString()
    told = map_batches(sides, run, f"conv long, head {kind}, hb long, skip long, m long, c0 long, c long, delta binary, full binary, nxt binary")
    return told.select("conv", "head", "hb", "skip", (F.col("hb") + F.col("m")).alias("len"), (F.col("c0") + F.col("c")).alias("chars"), "delta", "c0", "full", "nxt")


def prefixes_of(strings: DataFrame, turns: DataFrame) -> DataFrame:
    """(s, d, p, c, ch) for all prefixes of the strings, but for the empty one."""
    from_head = strings.select("s", F.inline("head")).select("s", F.col("i").alias("d"), F.col("h").alias("p"), "c", "ch")
    facts = strings.select(F.col("s").alias("conv"), "hb", "skip", "delta", "c0")
    own = turns.join(facts, "conv").where(F.col("i") > F.col("skip"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            powers: dict[int, int] = {}
            depth, key, chars = [], [], []
            for i, h, c, hb, skip, delta, c0 in zip(*[batch.column(n).to_pylist() for n in ("i", "h", "c", "hb", "skip", "delta", "c0")]):
                m = i - skip
                power = powers.get(m)
                if power is None:
                    power = powers[m] = pow(BASE, m, PRIME)
                depth.append(hb + m)
                key.append(_key((_number(h) + _number(delta) * power) % PRIME))
                chars.append(c0 + c)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(depth, pa.int64()), pa.array(key, pa.binary()), pa.array(chars, pa.int64()), batch.column("ch")], ["s", "d", "p", "c", "ch"]
            )

    return from_head.unionByName(map_batches(own, run, "s long, d long, p binary, c long, ch long"))


# ---------------------------------------------------------------- the trie


def two_fattest(low: str, high: str) -> Column:
    """The number in (low, high] with the most trailing zero bits."""
    return F.expr(f"{high} & shiftleft(-1L, length(bin({low} ^ {high})) - 1)")


def fat_search(length: int, handles: dict[int, tuple]) -> tuple | None:
    """The deepest node whose handle is a prefix of a string and whose extent is not longer than it; None for the root.

    ``handles``: the nodes (x, p, up, uph) under the string's prefixes, by depth. A probe
    at the two-fattest depth of (low, high] either finds a node, and the search goes on
    below its extent, or rules out everything from that depth on.
    """
    low, high, found = 0, length, None
    while low < high:
        probe = high & (-1 << ((low ^ high).bit_length() - 1))
        node = handles.get(probe)
        if node is None:
            high = probe - 1
        elif node[0] <= length:
            low, found = node[0], node
        else:  # the string ends on this node's edge
            return (node[2], node[3], None, None)
    return found


HANDLE, EXTENT, FIRST = 0, 1, 2


def exit_nodes(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(s, len, full, hb, lo, e, v, v_x, v_owner): depth and hash of the deepest extent that is a prefix of the string, and the edge below it on its way.

    ``open_`` has the prefixes of the open strings. They are looked up among handles,
    extents and first turns of edges in one join. A row then holds the finds of one
    string, a few per compacted node on its path, and is searched on its own. Every
    open string shares a first turn with some edge, so none is missing here.
    """
    kind = lambda column, n: F.struct(F.col(column).alias("key"), F.lit(n).alias("kind"))
    keys = nodes.select(F.explode(F.array(kind("handle", HANDLE), kind("p", EXTENT), kind("first", FIRST))).alias("k"), F.struct("x", "p", "up", "uph", "owner").alias("node"))
    keys = keys.select("k.key", "k.kind", "node")
    finds = open_.join(keys, open_["p"] == keys["key"]).groupBy("s").agg(
        *[F.first(c).alias(c) for c in ("len", "full", "hb")], F.collect_list(F.struct("kind", "d", "node")).alias("finds")
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for length, finds in zip(batch.column("len").to_pylist(), batch.column("finds").to_pylist()):
                at: tuple[dict, dict, dict] = ({}, {}, {})
                for f in finds:
                    n = f["node"]
                    at[f["kind"]][f["d"]] = (n["x"], n["p"], n["up"], n["uph"], n["owner"])
                node = fat_search(length, at[HANDLE])
                # A handle that fits doesn't say that the whole extent does.
                if node and node[2] is not None and at[EXTENT].get(node[0], (0, b""))[1] != node[1]:
                    node = (node[2], node[3])
                lo, e = node[:2] if node else (0, ROOT)
                child = at[FIRST].get(lo + 1)
                out.append((lo, e, *((child[1], child[0], child[4]) if child else (None, None, None))))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            names = ["s", "len", "full", "hb"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array(c, k) for c, k in zip(columns, kinds)]], [*names, "lo", "e", "v", "v_x", "v_owner"])

    return map_batches(finds, run, "s long, len long, full binary, hb long, lo long, e binary, v binary, v_x long, v_owner long")


def located(open_: DataFrame, prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(s, len, full, hb, v, inside, l, z, c_own, nxt): where a string leaves the trie.

    l, z, c_own: depth, hash and code points of the part that is there already; v: the
    edge's lower end if that is inside an edge; nxt: the hash one turn on, null at the
    string's end. On an edge, the string agrees with the edge's owner up to some depth.
    """
    rows = exit_nodes(open_, nodes).withColumn("to", F.coalesce(F.least("v_x", "len"), "lo"))
    mine = open_.select("s", "d", "p", "c").join(rows, "s").where((F.col("d") >= F.col("lo")) & (F.col("d") <= F.col("to") + 1))
    spelt = prefixes.select(F.col("s").alias("v_owner"), "d", "p", F.lit(True).alias("same"))
    both = mine.join(spelt, ["v_owner", "d", "p"], "left").withColumn("same", (F.col("d") == F.col("lo")) | F.coalesce("same", F.lit(False)))
    told = both.groupBy("s").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("len", "full", "hb", "lo", "v")],
        F.max(F.when(F.col("same"), F.struct("d", "p", "c"))).alias("at"), F.min(F.when(~F.col("same"), F.struct("d", "p"))).alias("on"),
    )
    l = F.coalesce("at.d", F.lit(0)).cast("long")  # noqa: E741
    return told.select(
        "s", "len", "full", "hb", "v", (F.col("v").isNotNull() & (l > F.col("lo"))).alias("inside"), l.alias("l"), F.coalesce("at.p", F.lit(ROOT)).alias("z"),
        F.coalesce("at.c", F.lit(0)).cast("long").alias("c_own"), F.col("on.p").alias("nxt"),
    )


def with_handles(edges: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Complete (x, p, up, uph, owner) to rows of nodes."""
    rows = edges.withColumn("f", two_fattest("up", "x"))
    spelt = prefixes.select(F.col("s").alias("owner"), "d", F.col("p").alias("q")).join(rows, "owner")
    spelt = spelt.where((F.col("d") == F.col("f")) | (F.col("d") == F.col("up") + 1))
    # an edge is told by its lower end
    return spelt.groupBy("p").agg(
        *[F.first(c).alias(c) for c in ("x", "up", "uph", "owner")],
        F.max(F.when(F.col("d") == F.col("f"), F.col("q"))).alias("handle"), F.max(F.when(F.col("d") == F.col("up") + 1, F.col("q"))).alias("first"),
    )


def build(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stride: int = STRIDE, heads: int = HEADS) -> Trie:
    """The trie of all conversations; ``heads`` 1 takes them as they are."""
    turns = hashed_turns(df, conv_id, turn, role, text)
    convs = cut_lineage(rebuilt(turns, stride, heads))
    best = F.min(F.struct("conv", "len", "chars", "head", "hb", "skip", "delta", "c0", "nxt")).alias("r")
    strings = cut_lineage(convs.groupBy("full").agg(best, F.count("*").alias("weight")).select("full", "weight", "r.*").withColumnRenamed("conv", "s"))
    prefixes = cut_lineage(prefixes_of(strings, turns))
    # The first batch meets the bare root.
    root = {"v": F.lit(None).cast("binary"), "inside": F.lit(False), "l": F.lit(0).cast("long"), "z": F.lit(ROOT), "c_own": F.lit(0).cast("long")}
    found = strings.select("s", "len", "full", "hb", "nxt").withColumns(root)
    nodes, near, settled = None, prefixes, []
    while True:
        chosen = found.where("nxt is not null").groupBy("nxt").agg(F.max(F.struct("hb", F.xxhash64("s"), "s")).alias("r"))
        marked = found.join(chosen.select("r.s", F.lit(True).alias("hung")), "s", "left").withColumn("hung", F.coalesce("hung", F.lit(False)))
        marked = cut_lineage(marked.withColumn("open", F.col("nxt").isNotNull() & ~F.col("hung")))
        leaves = marked.where("hung").select(F.col("len").alias("x"), F.col("full").alias("p"), F.col("l").alias("up"), F.col("z").alias("uph"), F.col("s").alias("owner"))
        nodes = cut_lineage(with_handles(leaves, prefixes) if nodes is None else _split(nodes, marked, leaves, prefixes))
        settled.append(marked.where("not open").select("s", "c_own"))
        open_ = marked.where("open").select("s", "len", "full", "hb")
        if open_.isEmpty():
            break
        near = cut_lineage(near.select("s", "d", "p", "c").join(open_, "s"))
        found = cut_lineage(located(near, prefixes, nodes))
    owned = settled[0]
    for more in settled[1:]:
        owned = owned.unionByName(more)
    return Trie(nodes, prefixes, strings.select("s", "len", "full", "weight", "chars").join(owned, "s"), convs.select("conv", "full"))


def _split(nodes: DataFrame, marked: DataFrame, leaves: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Nodes with edges cut at all exit points inside them, and the new leaves."""
    edges = nodes.select(F.col("p").alias("v"), F.col("x").alias("l"), F.col("p").alias("z"), "up", "uph", "owner", "handle", "first")
    points = edges.unionByName(marked.where("inside").select("v", "l", "z").distinct(), allowMissingColumns=True)
    along, whole = W.partitionBy("v").orderBy("l"), W.partitionBy("v")
    known = {c: F.max(c).over(whole) for c in ("up", "uph", "owner")}  # one row of an edge has its upper end and owner
    points = points.withColumns({"prior_l": F.lag("l").over(along), "prior_z": F.lag("z").over(along), "pieces": F.count("*").over(whole), **known})
    ends = [F.col("l").alias("x"), F.col("z").alias("p"), F.coalesce("prior_l", "up").alias("up"), F.coalesce("prior_z", "uph").alias("uph"), F.col("owner")]
    fresh = with_handles(points.where("pieces > 1").select(*ends).unionByName(leaves), prefixes)
    return points.where("pieces = 1").select(*ends, "handle", "first").unionByName(fresh)


def ends_digests(members: DataFrame) -> DataFrame:
    """(full, ends_sha256): SHA-256 of the conversation ids of equal strings, rising, joined by commas.

    Tasks join pieces of the sorted ids; the pieces of a string are then hashed in
    order, which holds one piece at a time.
    """

    def join(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, ids = None, []
        for batch in source:
            out = []
            for key, conv in zip(batch.column("full").to_pylist(), batch.column("conv").to_pylist()):
                if key != full or len(ids) == PIECE:
                    if ids:
                        out.append((full, ids[0], ",".join(map(str, ids))))
                    full, ids = key, []
                ids.append(conv)
            yield batch_of(out)
        if ids:
            yield batch_of([(full, ids[0], ",".join(map(str, ids)))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.binary(), pa.int64(), pa.string()))], ["full", "conv", "ids"])

    def digest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, state = None, sha256()

        def out_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 2
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.binary(), pa.string()))], ["full", "ends_sha256"])

        for batch in source:
            out = []
            for key, ids in zip(batch.column("full").to_pylist(), batch.column("ids").to_pylist()):
                if key != full:
                    if full is not None:
                        out.append((full, state.hexdigest()))
                    full, state = key, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield out_of(out)
        if full is not None:
            yield out_of([(full, state.hexdigest())])

    ranged = members.select("full", "conv").repartitionByRange("full", "conv").sortWithinPartitions("full", "conv")
    pieces = map_batches(ranged, join, "full binary, conv long, ids string")
    pieces = pieces.repartition("full").sortWithinPartitions("full", "conv").select("full", "ids")
    return map_batches(pieces, digest, "full binary, ends_sha256 string")


def expand(trie: Trie) -> DataFrame:
    """One row per node of the trie at every depth, the root included."""
    nodes, prefixes = trie.nodes, trie.prefixes
    children = cut_lineage(nodes.groupBy(F.col("uph").alias("p")).agg(F.count("*").alias("children")))
    ends = children.select(F.col("p").alias("full"), F.lit(False).alias("leaf"))
    strings = trie.strings.join(ends, "full", "left").withColumn("leaf", F.coalesce("leaf", F.lit(True)).cast("long"))
    strings = cut_lineage(strings.select("s", "weight", "chars", "c_own", "leaf"))
    through = prefixes.select("s", "p", "c").join(nodes.select("p"), "p").join(strings, "s")
    root = strings.select(F.lit(ROOT).alias("p"), F.lit(0).cast("long").alias("c"), "s", "weight", "chars", "c_own", "leaf")
    sums = through.unionByName(root).groupBy("p").agg(
        F.min("s").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.max("c").alias("c_x"),
        F.sum(F.col("weight") * (F.col("chars") - F.col("c")) - (F.col("chars") - F.greatest("c_own", "c"))).alias("below"),
    )
    sums = cut_lineage(sums.join(children, "p", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long"))))
    digests = ends_digests(trie.members)
    above = sums.select(F.col("p").alias("uph"), F.col("conv_id").alias("up_conv"))
    ends_in = sums.join(digests, sums["p"] == digests["full"], "left").drop("full")
    edges = nodes.select("p", "x", "up", "uph", "owner").join(above, "uph")
    # The root has no edge; every other row of the sums has one.
    edges = cut_lineage(ends_in.join(edges, "p", "left"))
    spelt = prefixes.select(F.col("s").alias("owner"), "d", "c", "ch").join(edges.where("owner is not null"), "owner").where((F.col("d") > F.col("up")) & (F.col("d") <= F.col("x")))
    none, at_end = F.lit(sha256(b"").hexdigest()), F.col("d") == F.col("x")
    rows = spelt.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == F.col("up") + 1, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(at_end, F.col("children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("c_x") - F.col("c") + F.col("ch"))).alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"),
    )
    top = edges.where("owner is null")
    top = top.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"), "n_leaves",
        F.col("below").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    return rows.unionByName(top)
