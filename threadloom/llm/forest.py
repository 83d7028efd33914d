"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A document's set holds the hashes of its distinct five-word shingles (A-Z
lower-cased; with fewer words the whole sequence is one shingle). Documents with
equal sets form one class and are handled once. Each class enters every tree of
the forest with its signature read in that tree's order, and the tree is sorted.

1. Neighbours. In every tree a class and that of its two neighbours with the longer
   common prefix are candidates, if this has ``DEPTH`` values, or one less where a
   class has no such neighbour. In a dense region the sort itself goes deeper, so neighbours there
   share as much as anything does. The ``FIRST_BEST`` likeliest of each class are
   confirmed, which joins most of each group, however many copies it holds.
2. Completion. Regions (a tree's classes with a common prefix of ``DEPTH`` values)
   whose classes are not yet all in one component are looked at again: classes
   outside the region's largest component meet all classes of other components,
   block by block. Where signatures agree well enough, the ``SKETCH`` least hashes of
   the two sets are compared. They are the whole set for most texts, so that a block
   knows its links and hands on a spanning forest of them: no more pairs than it has
   classes. Pairs of longer texts are candidates if the sketches agree well enough.

All candidates are confirmed on full sets: 100 * intersection >= 75 * union.
A pair of similarity 0.75 misses all 32 regions with probability 3e-8, a signature
estimate below ``ESTIMATE`` has a probability of about 3e-6, and so has a sketch
estimate below ``SKETCH_ESTIMATE``.

Cases: null and wordless texts have no set and stand alone; null ids take part
(a component whose ids are all null has a null component_id); repeated rows are
one class and get equal results; an empty table gives an empty result; columns
other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.batches import map_batches
from threadloom.llm.keyfilter import mark_maybe
from threadloom.llm.words import find_words, gram_hash, inside, mix, slices
from threadloom.operators.graph import connected_components
from threadloom.session import cut_lineage, loose

SHINGLE = 5
TREES, DEPTH, LABEL = 32, 3, 8
VALUES = TREES * DEPTH
ESTIMATE = 0.55
#: Least hashes of a set that classes bring to the blocks of unsettled regions.
SKETCH, SKETCH_ESTIMATE = 512, 0.66
BLOCK = 512
SALTS = 16
#: Bytes of text worked on at once, and bytes of full sets in one batch.
SLICE, SET_BYTES = 1 << 20, 1 << 22
#: Neighbours of a class that are confirmed first. What this leaves out is left to the completion, which has no limit.
FIRST_BEST = 4

_MULTIPLIERS = mix(np.arange(1, VALUES + 1, dtype=np.uint64), 9) | np.uint64(1)
#: Tree t reads the signature from its own place onward.
_ORDERS = np.array([[(t * DEPTH + k) % VALUES for k in range(LABEL)] for t in range(TREES)])


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    for _, _, data, offsets in slices(texts, SLICE):
        words = find_words(data, offsets, lower=True)
        counts = np.diff(words.first)
        at = inside(words.first, size)
        grams = gram_hash(words.hash, size)[at]
        ends = np.cumsum(np.maximum(counts - size + 1, 0))
        for d, (n, end) in enumerate(zip(counts.tolist(), ends.tolist())):
            if n >= size:
                yield np.unique(grams[end - (n - size + 1) : end])
            elif n:
                yield gram_hash(words.hash[words.first[d] : words.first[d] + n], n)
            else:
                yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set."""
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 4096):
        some = (hashes[i : i + 4096, None] * _MULTIPLIERS) >> np.uint64(32)
        np.minimum(out, some.min(0).astype(np.uint32), out)
    return out


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h, n_shingles, cls, sig, low) per document; low has the signature's low 16 bits, enough to estimate.

    cls, the digest of the set, and the signature are null without words.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n, cls, sig, low = [], [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                cls.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                values = signature(s) if len(s) else None
                sig.append(values.tobytes() if len(s) else None)
                low.append(values.astype(np.uint16).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), pa.array(low, pa.binary())],
                ["id", "h", "n_shingles", "cls", "sig", "low"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return map_batches(rows, run, f"id {kind}, h long, n_shingles long, cls binary, sig binary, low binary")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column whose values all have ``width`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), np.uint8)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return data[first : first + len(column) * width].reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def tree_entries(classes: DataFrame) -> DataFrame:
    """(label, cls): one row per tree and class; a label is the tree's number and ``LABEL`` values, made to sort."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                sigs = _fixed(batch.column("sig"), 4 * VALUES).copy().view(np.uint32)
                labels = sigs[:, _ORDERS]
                trees = np.broadcast_to(np.arange(TREES, dtype=np.uint32)[None, :, None], (len(sigs), TREES, 1))
                # cast after concatenate, which gives native byte order; asked() reads the tree's number big-endian
                rows = np.concatenate([trees, labels], axis=2).astype(">u4").reshape(len(sigs) * TREES, LABEL + 1)
                cls = np.repeat(_fixed(batch.column("cls"), 16), TREES, axis=0)
                yield pa.RecordBatch.from_arrays([_binary(rows), _binary(cls)], ["label", "cls"])

    return map_batches(classes.select("cls", "sig"), run, "label binary, cls binary")


def neighbours(entries: DataFrame) -> DataFrame:
    """(region, cls, other) from the sorted trees.

    region: tree and first ``DEPTH`` values, for classes that may share them
    with another; other: the class before it in the order, where the prefix is
    long enough. The ends of a partition are always given as members of their
    region, because what stands beyond is not seen.
    """
    wide, key = 4 * (LABEL + 1), 4 * (DEPTH + 1)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_label, last_cls = np.zeros((0, wide), np.uint8), np.zeros((0, 16), np.uint8)
        joined = False  # whether the entry held over has a deep neighbour before it
        for batch in source:
            if not batch.num_rows:
                continue
            label = np.concatenate([last_label, _fixed(batch.column("label"), wide)])
            cls = np.concatenate([last_cls, _fixed(batch.column("cls"), 16)])
            same = (label[1:] == label[:-1]).reshape(len(label) - 1, LABEL + 1, 4).all(2)
            depth = np.cumprod(same, axis=1).sum(1) - 1  # values shared with the entry before; -1 in another tree
            deep = depth >= DEPTH
            n = len(label)
            before, behind = np.append(joined, deep), np.append(deep, False)
            alone = ~(before | behind)
            # of its two neighbours a class takes the one with the longer common prefix
            longer = (depth >= np.append(depth[1:], -2)) | (depth > np.append(-2, depth[:-1]))
            pair = np.flatnonzero(longer & (deep | ((depth == DEPTH - 1) & (alone[1:] | alone[:-1])))) + 1
            member = before | behind
            member[-1] = True  # may belong with the next batch; given again there if it does
            member[0] = True
            m = np.flatnonzero(member)
            region = pa.concat_arrays([_binary(label[m][:, :key]), pa.nulls(len(pair), pa.binary())])
            yield pa.RecordBatch.from_arrays(
                [region, pa.concat_arrays([_binary(cls[m]), _binary(cls[pair])]), pa.concat_arrays([pa.nulls(len(m), pa.binary()), _binary(cls[pair - 1])])],
                ["region", "cls", "other"],
            )
            last_label, last_cls, joined = label[n - 1 :], cls[n - 1 :], n > 1 and bool(deep[-1])

    parts = entries.repartitionByRange("label", "cls").sortWithinPartitions("label", "cls")
    return map_batches(parts, run, "region binary, cls binary, other binary")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, estimate) for pairs whose sizes allow the similarity and whose signatures agree well enough."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x, y = (_fixed(batch.column(c), 2 * VALUES).copy().view(np.uint16) for c in ("low_a", "low_b"))
            estimate = (x == y).mean(1) if len(x) else np.zeros(0)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(estimate)], ["a", "b", "estimate"])
            yield out.filter(pa.array(estimate >= ESTIMATE))

    side = lambda s: classes.select(F.col("cls").alias(s), F.col("low").alias(f"low_{s}"), F.col("n_shingles").alias(f"n_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    near = both.where(100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b"))
    return map_batches(near.select("a", "b", "low_a", "low_b"), run, "a binary, b binary, estimate double")


def best_of_each(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that are among the ``FIRST_BEST`` best estimates of one of the two.

    A class has at most two neighbours per tree, so the ranked groups are small.
    What is left out here comes up again in the completion if it is still needed.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")
    both = pairs.select("estimate", ends).select("estimate", "e.x", "e.y")
    rank = F.row_number().over(W.partitionBy("x").orderBy(F.desc("estimate"), "y"))
    return _ordered(both.withColumn("rank", rank).where(F.col("rank") <= FIRST_BEST), "x", "y")


def _involved_texts(docs: DataFrame, text: str, doc_id: str, wanted: DataFrame) -> DataFrame:
    """The text of each wanted class, read from its chosen document.

    A filter of fixed size keeps most other texts out of the shuffle; the join
    behind it is exact.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = mark_maybe(rows, wanted, "h").where("maybe").select("id", "text", "h")
    same = (rows["h"] == wanted["h"]) & rows["id"].eqNullSafe(wanted["id"])
    return rows.join(wanted, same).select("cls", "text").dropDuplicates(["cls"])


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= 75 * union of their full sets."""

    def to_sets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets, first, held = [], 0, 0
            for i, s in enumerate(shingle_sets(batch.column("text")), 1):
                sets.append(s.tobytes())
                held += s.nbytes
                if held >= SET_BYTES or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("cls").slice(first, i - first), pa.array(sets, pa.binary())], ["cls", "set"])
                    sets, first, held = [], i, 0

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            linked = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                linked.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = cut_lineage(ends.join(classes.select("cls", "id", "h"), "cls"))
    sets = cut_lineage(map_batches(_involved_texts(docs, text, doc_id, wanted), to_sets, "cls binary, set binary"))
    side = lambda s: sets.select(F.col("cls").alias(s), F.col("set").alias(f"set_{s}"))
    return map_batches(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a binary, b binary")


def _blocks(members: DataFrame, components: DataFrame, classes: DataFrame) -> DataFrame:
    """(block, asks, cls, comp, sig): unsettled regions in blocks of bounded size.

    A class outside the region's largest component asks in every block of the
    region; all classes answer in their own block. Askers are dealt to blocks too.
    """
    own = F.coalesce("component", "cls").alias("comp")
    placed = members.join(components, "cls", "left").select("region", "cls", own)
    parts = placed.groupBy("region", "comp").agg(F.count("*").alias("n"))
    regions = parts.groupBy("region").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main"), F.count("*").alias("comps")
    ).where("comps > 1")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    regions = regions.select("region", "main", "n", "n_main", salts)
    # An aggregated side can't be split by Spark at a hot region, so both sides are salted.
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(regions, ["region", "salt"])
    to = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    spot = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    placed = placed.select(
        "region", "cls", "comp", (F.col("comp") != F.col("main")).alias("apart"), to(F.col("n")).alias("rows"), to(F.col("n") - F.col("n_main")).alias("cols")
    )
    dealt = [F.col("region"), F.col("cls"), F.col("comp")]
    asks = placed.where("apart").select(*dealt, F.lit(True).alias("asks"), spot(F.col("cols"), 1).alias("c"), F.explode(every(F.col("rows"))).alias("r"))
    answers = placed.select(*dealt, F.lit(False).alias("asks"), F.explode(every(F.col("cols"))).alias("c"), spot(F.col("rows"), 2).alias("r"))
    both = asks.unionByName(answers).withColumn("block", F.concat("region", F.encode(F.concat_ws(",", F.lit(""), "c", "r"), "utf-8")))
    return both.join(classes, "cls").select("block", "asks", "cls", "comp", "sig", "n_shingles", "sketch")


def with_sketches(members: DataFrame, components: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(cls, sig, n_shingles, sketch) of the classes in unsettled regions; sketches are made where the texts are read."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            least = [(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(least, pa.binary())], ["id", "h", "sketch"])

    own = F.coalesce("component", "cls")
    told = members.join(components, "cls", "left").groupBy("region").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b")
    unsettled = members.join(loose(told.select("region")), "region").select("cls").distinct()
    wanted = cut_lineage(unsettled.join(classes.select("cls", "id", "h", "sig", "n_shingles"), "cls"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    made = map_batches(mark_maybe(rows, wanted, "h").where("maybe").select("id", "h", "text"), run, f"id {kind}, h long, sketch binary")
    same = (made["h"] == wanted["h"]) & made["id"].eqNullSafe(wanted["id"])
    return made.join(wanted, same).select("cls", "sig", "n_shingles", "sketch").dropDuplicates(["cls"])


def sketch_overlap(x: np.ndarray, y: np.ndarray, size: int) -> tuple[int, float]:
    """Common values of two sketches, and the similarity that the least values of both together show."""
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    common = y[x[at] == y]
    both = np.union1d(x, y)
    size = min(size, len(both))
    return len(common), float((common <= both[size - 1]).sum()) / size


def _ask(group: dict[str, np.ndarray], tree: int, size: int, least: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    asks = group["asks"]
    q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
    _, comp = np.unique(group["comp"].view("V16").ravel(), return_inverse=True)
    root = comp.copy()  # of every row; components join as links are found
    left, right = [], []
    for i in q:
        other = m[root[m] != root[i]]
        n = group["n"][other]
        other = other[100 * np.minimum(n, group["n"][i]) >= 75 * np.maximum(n, group["n"][i])]
        if not len(other):
            continue
        equal = group["sig"][other] == group["sig"][i]
        estimate = equal.mean(1)
        # a pair that shares regions of several trees counts in the first of them
        first = equal.reshape(-1, TREES, DEPTH).all(2).argmax(1)
        good = np.flatnonzero((estimate >= ESTIMATE) & (first == tree))
        for j in other[good[np.argsort(-estimate[good], kind="stable")]]:
            if root[i] == root[j]:
                continue
            common, similar = sketch_overlap(group["sketch"][i], group["sketch"][j], size)
            total = int(group["n"][i] + group["n"][j])
            if max(group["n"][i], group["n"][j]) <= size:  # the sketches are the sets
                if 100 * common < 75 * (total - common):
                    continue
                # Values are half hashes, of which one or two may agree by chance.
                if 100 * (common - 2) >= 75 * (total - common + 2):
                    root[root == root[j]] = root[i]
            elif similar < least:
                continue
            left.append(group["cls"][i])
            right.append(group["cls"][j])
    return left, right


def asked(blocks: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components inside blocks: a spanning forest of known links, and likely pairs of long texts."""

    size, least = SKETCH, SKETCH_ESTIMATE

    def pairs_of(key: bytes, parts: list[pa.RecordBatch]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        table = pa.Table.from_batches(parts)
        cols = {
            "cls": _fixed(table.column("cls"), 16), "comp": _fixed(table.column("comp"), 16), "sig": _fixed(table.column("sig"), 4 * VALUES).copy().view(np.uint32),
            "sketch": np.array([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("sketch")] + [None], object)[:-1],
            "n": table.column("n_shingles").to_numpy(), "asks": table.column("asks").to_numpy(zero_copy_only=False),
        }
        return _ask(cols, int.from_bytes(key[:4], "big"), size, least)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []  # one block at a time
        left, right = [], []

        def out() -> pa.RecordBatch:
            columns = [pa.array([x.tobytes() for x in side], pa.binary()) for side in (left, right)]
            left.clear()
            right.clear()
            return pa.RecordBatch.from_arrays(columns, ["a", "b"])

        for batch in source:
            keys = batch.column("block").to_pylist()
            i = 0
            for j in range(1, len(keys) + 1):
                if j < len(keys) and keys[j] == keys[i]:
                    continue
                if held and keys[i] != block:
                    for side, found in zip((left, right), pairs_of(block, held)):
                        side += found
                    held = []
                block = keys[i]
                held.append(batch.slice(i, j - i))
                i = j
            yield out()
        if held:
            for side, found in zip((left, right), pairs_of(block, held)):
                side += found
            yield out()

    parts = blocks.repartition("block").sortWithinPartitions("block")
    return _ordered(map_batches(parts, run, "a binary, b binary"), "a", "b")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    return grouped(docs, doc_id, text).select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id (nulls last); documents without words all stay.

    Only documents that may go, or whose id and text come up again, are shuffled.
    """
    rows = cut_lineage(grouped(docs, doc_id, text).select("id", "h", "group"))
    named = rows.where("group is not null")
    best = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("best")).select("best.id", "best.h")
    copies = named.groupBy("id", "h").agg(F.count("*").alias("copies"))
    best = best.select("id", "h", F.lit(True).alias("stays"))
    same = copies["h"].eqNullSafe(best["h"]) & copies["id"].eqNullSafe(best["id"])
    told = copies.join(best, same, "left").select(copies["id"], copies["h"], F.coalesce("stays", F.lit(False)).alias("stays"), "copies")
    told = cut_lineage(told.where("not stays or copies > 1").select(F.col("id").alias("_i"), F.col("h").alias("_k"), "stays"))
    marked = mark_maybe(docs.withColumn("_h", F.xxhash64(text)), told.withColumnRenamed("_k", "_h"), "_h", "_maybe")
    maybe = marked.where("_maybe")
    maybe = maybe.join(told, (maybe["_h"] == told["_k"]) & maybe[doc_id].eqNullSafe(told["_i"]), "left")
    once = maybe.where("stays").dropDuplicates(["_i", "_k"])
    parts = [marked.where("not _maybe"), maybe.where("stays is null"), once]
    first, *rest = (p.select(*docs.columns) for p in parts)
    for part in rest:
        first = first.unionByName(part)
    return first


def _named(links: DataFrame) -> DataFrame:
    """(cls, component) of all linked classes."""
    found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return cut_lineage(found.select(F.col("id").alias("cls"), "component"))


def _joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """The components with some links more: only those links are walked, between whole components."""
    if more.isEmpty():
        return found
    end = lambda s: found.select(F.col("cls").alias(s), F.col("component").alias(f"_{s}"))
    ends = more.join(end("a"), "a", "left").join(end("b"), "b", "left")
    ends = cut_lineage(ends.select("a", "b", F.coalesce("_a", "a").alias("src"), F.coalesce("_b", "b").alias("dst")))
    top = connected_components(ends).select(F.col("id").alias("component"), F.col("component").alias("_top"))
    pairs = F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("src").alias("component")), F.struct(F.col("b").alias("cls"), F.col("dst").alias("component"))))
    nodes = found.unionByName(ends.select(pairs.alias("e")).select("e.*")).distinct()
    return cut_lineage(nodes.join(top, "component", "left").select("cls", F.coalesce("_top", "component").alias("component")))


def grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h, n_shingles, component_id, group) per row; group tells components apart and is null without words."""
    rows = cut_lineage(signatures(docs, doc_id, text))
    # One class per set, with the smallest id and one document to read its text from.
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.min(F.struct("id", "h", "n_shingles", "sig", "low")).alias("r")
    )
    classes = cut_lineage(classes.select("cls", "least", "copies", "r.*"))
    near = cut_lineage(neighbours(tree_entries(classes)))
    members = near.where("region is not null").select("region", "cls").distinct()
    pairs = cut_lineage(best_of_each(likely(_ordered(near.where("other is not null"), "cls", "other"), classes)))
    links = cut_lineage(confirm(pairs, docs, classes, doc_id, text))
    found = _named(links)
    sketched = with_sketches(members, found, classes, docs, doc_id, text)
    pairs = cut_lineage(asked(_blocks(members, found, sketched)).join(pairs, ["a", "b"], "left_anti"))
    more = cut_lineage(confirm(pairs, docs, classes, doc_id, text))
    found = _joined(found, more)
    linked = found.join(classes, "cls")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.select("cls", "component").join(least, "component").select("cls", "component_id", F.col("component").alias("group"))
    # Classes of one document without links keep their own id and need no join.
    copies = classes.where("copies > 1").join(linked, "cls", "left_anti").select("cls", F.col("least").alias("component_id"), F.col("cls").alias("group"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    named = linked.unionByName(copies).select("cls", "component_id", "group", F.lit(True).alias("named"), salts)
    rows = rows.select("id", "h", "n_shingles", "cls", F.pmod(F.xxhash64("id", "h"), F.lit(SALTS)).cast("int").alias("salt"))
    out = rows.join(named, ["cls", "salt"], "left")
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "h", "n_shingles", component.alias("component_id"), F.coalesce("group", "cls").alias("group"))
