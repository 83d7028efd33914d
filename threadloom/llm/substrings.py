"""Substring de-duplication with suffix trees over a sparse set of suffixes, partitioned by prefix.

A window is 35 consecutive words of a document. All words of windows that occur
more than once, in other documents or in the same one, are removed.

Every window holds one anchor: the start of its least eight-word gram. The anchor
depends on the window's words alone, so equal windows have equal anchors at equal
places, and only suffixes that start at anchors (about one in eleven) are sorted
into trees. Neighbouring windows with the same anchor are one row: the anchor's
context, that is the words from the first of these windows to the end of the last.

1. Anchors are dealt by their eight-word prefix. Equal contexts are found first,
   already inside each map task, so a passage with any number of copies sends at
   most one row per task. Windows of contexts that occur twice are repeats.
2. Prefixes that still hold different contexts get subtrees. A prefix with more
   than ``GROUP`` contexts is prolonged to the whole window, which splits it as far
   as it can be split; windows equal inside a map task are again one row.
3. A subtree sorts the anchored suffixes of its prefix and the reversed words left
   of the anchors; longest common prefixes between neighbours in the two orders
   are the inner nodes. A window with l words left of its anchor is a repeat if
   another anchor shares the right node of depth 35 - l and the left node of depth
   l: the nodes whose common depth reaches 35 are the maximal repeats.

Words are compared by 64-bit hashes, contexts and prolonged prefixes by 128 bits, and
spans go back to their documents by a key that two hashes of id and text make unique.

Cases: null texts and texts of fewer than 35 words lose nothing; repeated rows
are repeats of one another; null ids are allowed; an empty table gives an empty
result; other columns pass through, except those named like an output column.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.batches import extended, map_batches, put
from threadloom.llm.keyfilter import mark_maybe
from threadloom.llm.words import find_words, gram_hash, inside, mix, range_hash, slices
from threadloom.session import cut_lineage

WINDOW, GRAM = 35, 8
RIGHT, LEFT = WINDOW, WINDOW - GRAM
CONTEXT = LEFT + WINDOW
#: Contexts of one prefix up to which it is one subtree in the memory of a task.
GROUP = 20_000
#: Rows that a map task looks over for equal contexts at once, and leaves of the trees built side by side.
ROWS = 1 << 18
LEAVES = 1 << 14
#: Bytes of text worked on at once.
SLICE = 1 << 20
SALTS = 16
SPAN, WHOLE, TREE = 0, 1, 2

_ROW = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("key", "context", "doc")]
    + [T.StructField(n, T.IntegerType()) for n in ("kind", "start", "size", "left")]
    + [T.StructField("words", T.BinaryType())]
)
_PLAIN = ("key", "context", "doc", "kind", "start", "size", "left")


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of every run of ``width`` values."""
    n = len(values)
    at, value, span = np.arange(n), values, 1
    while span < width:
        step = min(span, width - span)
        m = len(value) - step
        if m <= 0:
            return at[:0]
        right = value[step:] < value[:m]
        at = np.where(right, at[step:], at[:m])
        value = np.where(right, value[step:], value[:m])
        span += step
    return at


def anchors(words) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: prefix and context hashes, document, first window, windows, words left of the anchor."""
    starts = inside(words.first, WINDOW)
    names = ("key", "context", "doc", "start", "size", "left")
    if not len(starts):
        return {n: np.zeros(0, np.int64) for n in names}
    grams = gram_hash(words.hash, GRAM)
    at = leftmost_least(grams, WINDOW - GRAM + 1)[starts]
    doc = words.doc[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    first, size = starts[new], np.diff(np.append(new, len(starts)))
    left = at[new] - first
    context = mix(range_hash(words.hash, first, first + size - 1 + WINDOW) ^ (left * 64 + size).astype(np.uint64))
    doc = doc[new]
    return dict(zip(names, (grams[at[new]].view(np.int64), context.view(np.int64), doc, first - words.first[doc], size, left)))


class Combiner:
    """Map-side: of equal (key, context) in a task one row goes on, and all their windows are repeats."""

    def __init__(self):
        self.parts: list[dict[str, np.ndarray]] = []
        self.rows = 0

    def add(self, part: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.rows += len(part["key"])
        if self.rows >= ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        parts, self.parts, self.rows = self.parts, [], 0
        order = np.lexsort([np.concatenate([p[n] for p in parts]) for n in ("context", "key")])
        x = {}
        for name in list(parts[0]):  # one column at a time, so that only one is held twice
            x[name] = np.concatenate([p.pop(name) for p in parts])[order]
        head = np.concatenate([[True], (x["key"][1:] != x["key"][:-1]) | (x["context"][1:] != x["context"][:-1])])
        several = np.repeat(np.diff(np.append(np.flatnonzero(head), len(head))) > 1, np.diff(np.append(np.flatnonzero(head), len(head))))
        yield from out_rows(spans({n: v[several] for n, v in x.items()}))
        yield from out_rows({n: v[head] for n, v in x.items()})


def spans(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of repeated windows, dealt by document."""
    n = len(x["doc"])
    zero = np.zeros(n, np.int64)
    return {"key": mix(x["doc"].view(np.uint64)).view(np.int64), "context": zero, "doc": x["doc"], "kind": zero + SPAN, "start": x["start"], "size": x["size"], "left": zero}


def out_rows(x: dict[str, np.ndarray], words: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    n = len(x["key"])
    if n:
        cols = [pa.array(x[name], f.dataType == T.LongType() and pa.int64() or pa.int32()) for name, f in zip(_PLAIN, _ROW.fields)]
        cols.append(pa.nulls(n, pa.binary()) if words is None else pa.array([w.tobytes() for w in words], pa.binary()))
        for i in range(0, n, 20_000):
            yield pa.RecordBatch.from_arrays([c.slice(i, 20_000) for c in cols], _ROW.names)


def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy() for n in _PLAIN}


def anchor_rows(docs: DataFrame) -> DataFrame:
    """Anchors of (doc, text) rows."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Combiner()
        for batch in source:
            keys = batch.column("doc").to_numpy()
            for i, j, data, offsets in slices(batch.column("text"), SLICE):
                part = anchors(find_words(data, offsets))
                part["doc"] = keys[i:j][part["doc"]]
                yield from held.add(part | {"kind": np.full(len(part["key"]), TREE)})
        yield from held.flush()

    return map_batches(docs, run, _ROW)


def grouped(rows: DataFrame) -> DataFrame:
    """All rows of a key in one partition, in order."""
    return rows.repartition("kind", "key").sortWithinPartitions("kind", "key", "context")


def equal_contexts(rows: DataFrame) -> DataFrame:
    """Spans of contexts that occur twice, and one row per context of prefixes that hold several."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # the rows of the last context, which may go on
        prior = False  # whether its prefix has an earlier context

        def finish(x: dict[str, np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, prior
            done = x["kind"] == SPAN
            yield from out_rows({n: v[done] for n, v in x.items()})
            x = {n: v[~done] for n, v in x.items()}
            n = len(x["key"])
            if not n:
                held = None
                return
            fresh = np.concatenate([[not prior], (x["key"][1:] != x["key"][:-1]) | (x["kind"][1:] != x["kind"][:-1])])
            head = np.flatnonzero(fresh | np.concatenate([[True], x["context"][1:] != x["context"][:-1]]))
            sizes = np.diff(np.append(head, n))
            follows = np.append(~fresh[head[1:]], False)  # another context of the same prefix comes next
            mixed = ~fresh[head] | follows
            if not last:
                held, prior = {k: v[head[-1] :] for k, v in x.items()}, not fresh[head[-1]]
                head, sizes, mixed = head[:-1], sizes[:-1], mixed[:-1]
                x = {k: v[: n - len(held["key"])] for k, v in x.items()}
            yield from out_rows(spans({k: v[np.repeat(sizes > 1, sizes)] for k, v in x.items()}))
            open_ = head[mixed & (x["kind"][head] == TREE)]
            yield from out_rows({k: v[open_] for k, v in x.items()})

        for batch in source:
            if batch.num_rows:
                x = columns(batch)
                yield from finish({k: np.concatenate([held[k], v]) for k, v in x.items()} if held else x, False)
        if held:
            yield from finish(held, True)

    return map_batches(grouped(rows), run, _ROW)


def context_rows(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """The words of opened contexts, read again from their documents; windows one by one for prolonged prefixes."""
    large = opened.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    large = large.select("key", salts, F.lit(True).alias("large"))
    salted = opened.withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.lit(SALTS)).cast("int"))
    told = salted.join(large, ["key", "salt"], "left").withColumn("large", F.coalesce("large", F.lit(False)))
    row = F.struct("key", "context", "start", "size", "left", "large")
    wanted = cut_lineage(told.groupBy("doc").agg(F.collect_set(row).alias("rows")))
    some = mark_maybe(docs, wanted, "doc").where("maybe").select("doc", "text")
    # Repeated rows have one key; one of them is enough to read the words.
    some = some.join(wanted, "doc").dropDuplicates(["doc"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Combiner()
        for batch in source:
            docs_ = batch.column("doc").to_numpy()
            lists = batch.column("rows")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            flat = lists.flatten()
            all_rows = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("key", "context", "start", "size", "left", "large")}
            for i, j, data, offsets in slices(batch.column("text"), SLICE):
                words = find_words(data, offsets)
                x = {n: v[ends[i] : ends[j]] for n, v in all_rows.items()}
                of = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                x["doc"] = docs_[i:j][of]
                first = words.first[of] + x["start"]
                for k in range(0, len(of), 4096):
                    y = {n: v[k : k + 4096] for n, v in x.items()}
                    small = ~y["large"]
                    at = first[k : k + 4096][small][:, None] + np.arange(CONTEXT)
                    length = (y["size"][small] - 1 + WINDOW)[:, None]
                    spelt = np.where(np.arange(CONTEXT) < length, words.hash[np.minimum(at, len(words.hash) - 1)], np.uint64(0))
                    cold = {n: v[small] for n, v in y.items() if n != "large"} | {"kind": np.full(int(small.sum()), TREE)}
                    yield from out_rows(cold, spelt)
                big = x["large"]
                size = x["size"][big].astype(np.int64)
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(first[big], size) + step
                one = np.ones(len(at), np.int64)
                yield from held.add(
                    {
                        "key": range_hash(words.hash, at, at + WINDOW).view(np.int64), "context": range_hash(mix(words.hash, 5), at, at + WINDOW).view(np.int64),
                        "doc": np.repeat(x["doc"][big], size), "kind": one * WHOLE, "start": np.repeat(x["start"][big], size) + step, "size": one, "left": one * 0,
                    }
                )
        yield from held.flush()

    return map_batches(some, run, _ROW)


def _nodes(group: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """nodes[d, i]: the node of depth d above leaf i of the trees of all groups; ``symbols`` are the leaves' words.

    The leaves are sorted, and a node of depth d ends where the common prefix of
    two neighbours is shorter than d.
    """
    n, depth = symbols.shape
    order = np.lexsort((*symbols.T[::-1], group))
    same = symbols[order][1:] == symbols[order][:-1]
    common = np.cumprod(same, axis=1).sum(1)
    common[group[order][1:] != group[order][:-1]] = -1
    out = np.empty((depth + 1, n), np.int32)
    for d in range(depth + 1):
        out[d, order] = np.concatenate([[0], np.cumsum(common < d)])
    return out


def repeats(group: np.ndarray, words: np.ndarray, size: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each leaf and l, whether its window with l words left of the anchor is also another leaf's."""
    n = len(group)
    rows = np.arange(n)[:, None]
    pad = np.concatenate([words, np.zeros((n, 1), np.uint64)], axis=1)
    right_at = np.minimum(left[:, None] + np.arange(RIGHT), CONTEXT)
    left_at = left[:, None] - 1 - np.arange(LEFT)
    right = _nodes(group, pad[rows, right_at])
    before = _nodes(group, pad[rows, np.where(left_at < 0, CONTEXT, left_at)])
    out = np.zeros((n, LEFT + 1), bool)
    for l in range(LEFT + 1):  # noqa: E741
        has = np.flatnonzero((l <= left) & (l > left - size))
        if len(has) > 1:
            node = right[WINDOW - l, has].astype(np.int64) << 32 | before[l, has]
            _, which, counts = np.unique(node, return_inverse=True, return_counts=True)
            out[has, l] = counts[which] > 1
    return out


def joined(doc: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Single windows as runs of neighbours."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
    last = np.append(head[1:], len(doc)) - 1
    return {"doc": doc[head], "start": start[head], "size": start[last] - start[head] + 1 if len(doc) else start}


def subtrees(rows: DataFrame) -> DataFrame:
    """Spans of windows that subtrees or prolonged prefixes show as repeats."""

    def trees(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            return
        table = pa.Table.from_batches(tables).combine_chunks().to_batches()[0]
        x = columns(table)
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64).reshape(-1, CONTEXT)
        group = np.cumsum(np.concatenate([[0], x["key"][1:] != x["key"][:-1]]))
        hit = repeats(group, words, x["size"].astype(np.int64), x["left"].astype(np.int64))
        i, l = np.nonzero(hit)  # noqa: E741
        yield from out_rows(spans(joined(x["doc"][i], x["start"][i] + x["left"][i] - l)))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        whole: dict[str, np.ndarray] | None = None
        for batch in source:
            if not batch.num_rows:
                continue
            kind = batch.column("kind").to_numpy()
            plain = batch.filter(pa.array(kind == SPAN))
            yield plain
            x = columns(batch.filter(pa.array(kind == WHOLE)))
            if len(x["key"]):
                if whole:
                    x = {k: np.concatenate([whole[k], v]) for k, v in x.items()}
                same = (x["key"][1:] == x["key"][:-1]) & (x["context"][1:] == x["context"][:-1])
                hit = np.append(False, same) | np.append(same, False)
                yield from out_rows(spans({k: v[hit] for k, v in x.items()}))
                whole = {k: v[-1:] for k, v in x.items()}
            tree = batch.filter(pa.array(kind == TREE))
            if not tree.num_rows:
                continue
            if count + tree.num_rows > LEAVES:
                # build what is complete: all but the last key
                keys = tree.column("key").to_numpy()
                cut = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])
                if held and cut == 0 and held[-1].column("key")[held[-1].num_rows - 1].as_py() != keys[0]:
                    yield from trees(held)
                    held, count = [], 0
                elif cut:
                    yield from trees([*held, tree.slice(0, cut)])
                    held, count, tree = [], 0, tree.slice(cut)
            held.append(tree)
            count += tree.num_rows
        yield from trees(held)

    return map_batches(grouped(rows), run, _ROW)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, start, size) runs of windows that occur more than once among (doc, text) rows."""
    found = cut_lineage(equal_contexts(anchor_rows(docs)))
    more = subtrees(context_rows(docs, found.where(F.col("kind") == TREE)))
    both = found.where(F.col("kind") == SPAN).unionByName(more)
    return both.select("doc", "start", "size")


def _hashes(doc_id: str, text: str) -> tuple[Column, Column]:
    """Two 64-bit hashes of id and text, independent of each other."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), F.col(text).isNull(), text, doc_id)


def with_doc_key(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Add ``_doc``, 64 bits that rows share only if both id and text are equal.

    Keys that rows with different second hashes share are looked for among all rows;
    they grow with the square of the rows, some three for 10^10. Rows that may have one
    of them get a key of both hashes. A row taken for one of them by mistake does too,
    which is as good, so no exact join is needed.
    """
    first, second = _hashes(doc_id, text)
    rows = df.withColumn("_doc", first)
    pairs = rows.select("_doc", second.alias("_second"))
    shared = pairs.groupBy("_doc").agg(F.min("_second").alias("least"), F.max("_second").alias("most")).where("least < most")
    marked = mark_maybe(rows, cut_lineage(shared.select("_doc")), "_doc", "_shared")
    key = F.when(F.col("_shared"), F.xxhash64("_doc", second)).otherwise(F.col("_doc"))
    return marked.withColumn("_doc", key).drop("_shared")


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "kept_text", digests: bool = False) -> DataFrame:
    """Add the text without repeated windows, n_words and n_removed.

    Removed words go with the white space before them; what is left stays as it
    was. With ``digests`` the SHA-256 of the kept words joined by one space is
    added as kept_sha256 in place of the text.
    """
    keyed = with_doc_key(df, doc_id, text)
    docs = keyed.select(F.col("_doc").alias("doc"), F.col(text).alias("text"))
    cut = repeated_windows(docs).groupBy("doc").agg(F.collect_set(F.struct("start", "size")).alias("_cut"))
    cut = cut_lineage(cut.withColumnRenamed("doc", "_doc"))
    marked = mark_maybe(keyed, cut, "_doc", "_maybe")
    whole = marked.where("not _maybe").withColumn("_cut", F.lit(None).cast("array<struct<start:int,size:int>>"))
    some = marked.where("_maybe").join(cut, "_doc", "left")
    rows = whole.unionByName(some).drop("_doc", "_maybe")
    added: dict[str, T.DataType] = {"n_words": T.LongType(), "n_removed": T.LongType()}
    added |= {"kept_sha256": T.StringType()} if digests else {out: T.StringType()}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = batch.column("_cut")
            ends = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            flat = lists.flatten()
            start, size = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "size"))
            n_words, n_removed, kept = [], [], []
            for i, j, data, offsets in slices(batch.column(text), SLICE):
                words = find_words(data, offsets)
                counts = np.diff(words.first)
                of = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                first = words.first[of] + start[ends[i] : ends[j]]
                level = np.bincount(first, minlength=len(words.start) + 1) - np.bincount(first + size[ends[i] : ends[j]] - 1 + WINDOW, minlength=len(words.start) + 1)
                gone = np.cumsum(level)[:-1] > 0
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) if len(words.first) > 1 else np.zeros(0, np.int64)
                removed[counts == 0] = 0
                n_words += counts.tolist()
                n_removed += removed.tolist()
                kept += _spelt(words, gone, removed, digests)
            batch = batch.drop_columns(["_cut"])
            new = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            yield put(batch, new | {"kept_sha256" if digests else out: pa.array(kept, pa.string())})

    return map_batches(rows, run, extended(rows.drop("_cut"), added))


def _spelt(words, gone: np.ndarray, removed: np.ndarray, digests: bool) -> list[str]:
    """Kept texts, or digests of their words joined by one space."""
    data = words.data
    if digests:
        # every kept word with the byte behind it, which becomes the space, if it is of the same document
        start, end = words.start[~gone], words.end[~gone]
        inner = ~np.isin(end, words.offsets)
        level = np.zeros(len(data) + 2, np.int32)
        np.add.at(level, start, 1)
        np.add.at(level, end + inner, -1)
        keep = np.cumsum(level)[: len(data)] > 0
        joined = data.copy()
        joined[end[inner]] = 32
    out = []
    for d in range(len(words.first) - 1):
        a, b = words.offsets[d], words.offsets[d + 1]
        if digests:
            i, j = words.first[d], words.first[d + 1]
            part = joined[a:b][keep[a:b]].tobytes()
            # the space behind the last kept word, unless that word ends the document
            ends = i < j and not gone[j - 1] and words.end[j - 1] == b
            out.append(sha256(part if ends else part[:-1]).hexdigest())
        elif not removed[d]:
            out.append(data[a:b].tobytes().decode())
        else:
            i, j = words.first[d], words.first[d + 1]
            stay = np.ones(b - a, bool)
            for w in np.flatnonzero(gone[i:j]) + i:
                stay[(words.end[w - 1] if w > i else a) - a : words.end[w] - a] = False
            out.append(data[a:b][stay].tobytes().decode())
    return out
