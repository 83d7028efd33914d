"""Document fingerprints of closed syncmers.

A run of 12 bytes is a closed syncmer if the least of the nine four-byte runs in
it stands at one of its two ends. That depends on the 12 bytes alone, so an
anchor survives any edit that doesn't touch it. A fingerprint holds all anchors of
a text in the order of their places, repeated ones too, so it grows with the text.

The likeness of two fingerprints is twice the length of their longest common
subsequence of anchors over the number of all anchors, so anchors before and after
an inserted or deleted passage all count. Equal texts have likeness 1.

Cases: null texts count as empty and have an empty fingerprint, which is like
another empty one (1) and unlike all others (0); a text without a syncmer is
one anchor; ties in the id go by text; null ids come first; repeated rows stay;
an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.batches import extended, map_batches, put
from threadloom.llm.words import mix

LONG, SHORT = 12, 4
#: Up to so many pairs of equal anchors for each anchor, the common subsequence is found pair by pair.
PAIRS = 32
#: Parts of the id order for each shuffle partition.
PARTS = 4
#: Bytes of texts that are hashed together.
RUN = 1 << 21


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """For each text rows (hash, place) of its anchors, by place."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= RUN):
            n += len(texts[j])
            j += 1
        out += _sketch_run(texts[i:j])
        i = j
    return out


def _sketch_run(texts: list[bytes]) -> list[np.ndarray]:
    sizes = np.array([len(x) for x in texts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = b"".join(texts)
    found = [np.zeros((0, 2), ">u4")] * len(texts)
    if len(data) >= LONG:
        # the eight bytes from each place on; a syncmer is told by two of these
        eight = np.ndarray((len(data) - SHORT + 1,), "<u8", data + bytes(8), strides=(1,)).astype(np.uint64)
        short = mix(eight & np.uint64((1 << 8 * SHORT) - 1))
        width = LONG - SHORT + 1
        least, span = short, 1
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        last = short[LONG - SHORT :]
        at = np.flatnonzero((short[: len(least)] == least) | (last == least))
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + LONG <= offsets[doc + 1]
        at, doc = at[inside], doc[inside]
        hashes = mix(mix(eight[at], 1) * np.uint64(3) + eight[at + LONG - 8]) >> np.uint64(32)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        rows = np.stack([hashes.astype(">u4"), (at - offsets[doc]).astype(">u4")], axis=1)
        found = [rows[a:b] for a, b in zip(first[:-1], first[1:])]
    for d, text in enumerate(texts):
        if text and not len(found[d]):
            found[d] = np.array([[int.from_bytes(sha256(text).digest()[:4], "big"), 0]], ">u4")
    return found


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    n = min(len(x), len(y))
    ends = 0
    for _ in range(2):  # what both begin with, then, turned round, what both end with
        differ = np.flatnonzero(x[:n] != y[:n])
        same = int(differ[0]) if len(differ) else n
        x, y, n, ends = x[same:][::-1], y[same:][::-1], n - same, ends + same
    x = x[np.isin(x, y)]
    y = y[np.isin(y, x)]
    if not len(x):
        return ends
    _, kind, count = np.unique(x, return_inverse=True, return_counts=True)
    other, copies = np.unique(y, return_inverse=True, return_counts=True)[1:]
    places = np.split(np.argsort(kind, kind="stable"), np.cumsum(count)[:-1])
    if int((count * copies).sum()) <= PAIRS * len(y):
        backward = [p[::-1].tolist() for p in places]
        last: list[int] = []  # the least place at which a chain of each length can end
        for k in other.tolist():
            for p in backward[k]:
                at = bisect_left(last, p)
                last[at : at + 1] = [p]
        return ends + len(last)

    # Texts full of repeats have too many pairs; here each bit is a place of x, and a zero in the end is a step of the chain.
    @lru_cache(256)
    def mask(k: int) -> int:
        bits = np.zeros(len(x), np.uint8)
        bits[places[k]] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    whole = (1 << len(x)) - 1
    chain = whole
    for k in other.tolist():
        up = chain & mask(k)
        chain = ((chain + up) | (chain - up)) & whole
    return ends + len(x) - chain.bit_count()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of anchors in common in the same order, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return 2 * _common(a[:, 0].astype(np.uint32), b[:, 0].astype(np.uint32)) / (len(a) + len(b))


def _by_size(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``RUN`` bytes of text, since fingerprints are several times as long."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + RUN, "right")))
        yield batch.slice(i, j - i)
        i = j


def hexed(sketch: np.ndarray) -> str:
    return sketch.tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text to every row."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in source for part in _by_size(whole, text)):
            found = sketches([(x or "").encode() for x in batch.column(text).to_pylist()])
            yield put(batch, {out: pa.array([hexed(x) for x in found], pa.string())})

    return map_batches(df, run, extended(df, {out: T.StringType()}))


def with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(part, guest, id, text): the id order in parts, each with the first row of the next part as a guest at its end.

    The parts begin at ids of the table itself, found by a range sort of ids
    alone. After the last part comes the first row of all.
    """
    ids = docs.select(F.col(doc_id).alias("id")).where("id is not null")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * PARTS
    ranged = ids.repartitionByRange(parts, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("first"))
    # At most one id per part comes to the driver.
    firsts = np.array(sorted({r["first"] for r in ranged.collect()}), np.int64)
    nulls = not docs.where(F.col(doc_id).isNull()).isEmpty()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = max(1, len(firsts))
        for batch in source:
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            key = batch.column("id").fill_null(0).to_numpy()
            part = np.where(known, np.searchsorted(firsts, key, "right") - 1, 0)
            opens = (firsts[part] == key) & known if len(firsts) else np.zeros(len(key), bool)
            # with null ids in the table these come first of all, and part 0 is no longer opened by its id
            first = ~known if nulls else opens & (part == 0)
            guest = np.flatnonzero(first | (opens & (part > 0)))
            to = np.where(first[guest], count - 1, part[guest] - 1)
            for rows, where, flag in ((np.arange(len(key)), part, False), (guest, to, True)):
                if len(rows):
                    some = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(where, pa.int32()), pa.array(np.full(len(rows), flag)), some.column("id"), some.column("text")],
                        ["part", "guest", "id", "text"],
                    )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = map_batches(rows, run, "part int, guest boolean, id long, text string")
    return dealt.repartition("part").sortWithinPartitions("part", "guest", F.asc_nulls_first("id"), "text")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, whose second half comes from the start of the next document."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for whole in source:
            for some in _by_size(whole, "text"):
                rows = [*zip(*(some.column(c).to_pylist() for c in ("part", "guest", "id", "text")))]
                own = sketches([r[3].encode() for r in rows])
                todo = []
                for row, sketch in zip(rows, own):
                    if held is not None and held[0][0] == row[0]:
                        todo.append((*held, row[3], sketch))
                    held = None if row[1] else (row, sketch)  # the first guest ends its part
                if todo:
                    yield _edited(todo)

    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(with_next(docs, doc_id, text), run, columns)


def _edited(todo: list[tuple]) -> pa.RecordBatch:
    texts = []
    for row, _, following, _ in todo:
        half = len(row[3]) // 2
        texts.append((row[3][: len(row[3]) - half] + following[:half]).encode())
    changed = sketches(texts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row[2] for row, *_ in todo], pa.int64()),
            pa.array([len(row[3]) for row, *_ in todo], pa.int64()),
            pa.array([sha256(x).hexdigest() for x in texts], pa.string()),
            pa.array([hexed(x) for _, x, *_ in todo], pa.string()),
            pa.array([hexed(x) for x in changed], pa.string()),
            pa.array([likeness(x, y) for (_, x, *_), y in zip(todo, changed)], pa.float64()),
            pa.array([likeness(x, y) for _, x, _, y in todo], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
