"""Language identification with a byte convolutional network.

A text is cut into windows of 256 bytes. Bytes are embedded, filters of widths
2, 3 and 4 pass over every window, each filter keeps its largest value, and a
softmax over these gives the languages' probabilities. A document's prediction is
the mean over all its windows, weighted by their bytes, so every byte counts.

The network is trained in numpy on the driver from at most ``PER_LANGUAGE`` labelled
documents of each language (the first in a seeded order), one window from each.
That bound is the only one: prediction runs over all windows of all documents.

Cases: null texts and texts without a letter get ``und`` with score 0, and so do
all texts if nothing is labelled; rows with null labels or null ids are never
learnt from; repeated rows get equal results; an empty table gives an empty
result; other columns pass through, except those named like an output column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.batches import extended, map_batches, put
from threadloom.llm.words import slices

WINDOW = 256
WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 8
PER_LANGUAGE = 1000
UNKNOWN = "und"
#: Windows that go through the network at once.
AT_ONCE = 256
#: Parts of a language that are ranked on their own before the language is.
SALTS = 16
_WIDEST = max(WIDTHS)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that are not learnt from; also for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        net = cls(languages, draw(0.5, 256, EMBED), draw(0.25, _WIDEST * EMBED, n), np.zeros(n, np.float32), draw(0.3, n, len(languages)), np.zeros(len(languages), np.float32))
        net.embed[0] = 0
        net.filters *= net.mask()
        return net

    @staticmethod
    def mask() -> np.ndarray:
        """Filters narrower than the widest have zeros in their last rows."""
        rows = np.arange(_WIDEST * EMBED)[:, None]
        return (rows < np.repeat(WIDTHS, FILTERS)[None, :] * EMBED).astype(np.float32)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """For every byte of every window the embedded bytes that a filter sees there; beyond the window zeros."""
        n = len(windows)
        wide = np.zeros((n, WINDOW + _WIDEST - 1, EMBED), np.float32)
        wide[:, :WINDOW] = self.embed[windows]
        flat = wide.reshape(n, -1)
        view = np.lib.stride_tricks.as_strided(flat, (n, WINDOW, _WIDEST * EMBED), (flat.strides[0], EMBED * 4, 4))
        return view.reshape(n * WINDOW, -1)

    def pooled(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of every filter in every window, and the filters' values."""
        values = (columns @ self.filters).reshape(-1, WINDOW, self.filters.shape[1])
        return np.maximum(values.max(1) + self.bias, 0), values

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float64)
        for i in range(0, len(windows), AT_ONCE):
            hidden, _ = self.pooled(self.columns(windows[i : i + AT_ONCE]))
            out[i : i + AT_ONCE] = softmax(hidden @ self.dense + self.dense_bias)
        return out

    def learn(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 1) -> Network:
        """Adam over shuffled batches; half of the windows are shortened, as short texts are."""
        rng = np.random.default_rng(seed)
        params = [self.embed, self.filters, self.bias, self.dense, self.dense_bias]
        first, second, mask, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], self.mask(), 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for i in range(0, len(order), 128):
                part = order[i : i + 128]
                x, y = windows[part].copy(), labels[part]
                lengths = np.where(rng.random(len(part)) < 0.5, WINDOW, rng.integers(12, WINDOW, len(part)))
                x[np.arange(WINDOW) >= lengths[:, None]] = 0
                step += 1
                for p, g, m, v in zip(params, self.gradients(x, y, mask), first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return self

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        n, f = len(x), self.filters.shape[1]
        columns = self.columns(x)
        hidden, values = self.pooled(columns)
        out = softmax(hidden @ self.dense + self.dense_bias)
        out[np.arange(n), y] -= 1
        out = (out / n).astype(np.float32)
        back = (out @ self.dense.T) * (hidden > 0)
        # only the place of the largest value of each filter has a gradient
        at = values.argmax(1)
        seen = columns.reshape(n, WINDOW, -1)[np.arange(n)[:, None], at]
        filters = np.einsum("nf,nfk->kf", back, seen) * mask
        embed = np.zeros_like(self.embed)
        bytes_ = np.concatenate([x, np.zeros((n, _WIDEST - 1), np.uint8)], axis=1)
        for k in range(_WIDEST):
            what = bytes_[np.arange(n)[:, None], at + k]
            np.add.at(embed, what.ravel(), (back[:, :, None] * self.filters[k * EMBED : (k + 1) * EMBED].T[None]).reshape(n * f, EMBED))
        embed[0] = 0
        return [embed, filters, back.sum(0), hidden.T @ out, out.sum(0)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts: (bytes with zeros behind the text, document, bytes of the text in it)."""
    counts = -(-np.diff(offsets) // WINDOW)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    sizes = np.minimum(offsets[1:][doc] - start, WINDOW)
    padded = np.append(data, np.zeros(WINDOW, np.uint8))
    windows = padded[start[:, None] + np.arange(WINDOW)]
    windows[np.arange(WINDOW) >= sizes[:, None]] = 0
    return windows, doc, sizes


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, seed: int = 11) -> Network | None:
    """Learn from labelled documents that are not held out; None if there are none."""
    place = F.xxhash64(F.lit(seed), doc_id, text)
    # One window of each document, at a place of the seeded order, is all that leaves the executors.
    at = F.pmod(place, F.greatest(F.lit(1), F.length(text) - WINDOW // 2)) + 1
    rows = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.substring(F.col(text), at.cast("int"), F.lit(WINDOW)).alias("part"), place.alias("place"))
    # A language may have most of the rows: each of its salts is ranked first, so the last ranking sees few of them.
    rows = rows.withColumn("salt", F.pmod("place", F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy("place", "part"))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= per_language)
    sample = rows.select("lang", "part", "place").toArrow().to_pandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["place", "lang", "part"])
    languages = sorted(set(sample["lang"]))
    windows = np.zeros((len(sample), WINDOW), np.uint8)
    for i, part in enumerate(sample["part"]):
        part = np.frombuffer(part.encode()[:WINDOW], np.uint8)
        windows[i, : len(part)] = part
    labels = sample["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    return Network.fresh(languages, seed).learn(windows, labels)


def predict(df: DataFrame, net: Network | None, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its probability."""
    marked = df.withColumn("_letters", F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            found, sure = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters))
            for i, j, data, offsets in slices(batch.column(text)) if net else ():
                total = np.zeros((j - i, len(net.languages)))
                windows, doc, sizes = cut_windows(data, offsets)
                np.add.at(total, doc, net.probabilities(windows) * sizes[:, None])
                total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
                best = total.argmax(1)
                known = letters[i:j]
                found[i:j][known] = np.array(net.languages, object)[best[known]]
                sure[i:j][known] = np.clip(total.max(1)[known], 0, 1)
            batch = batch.drop_columns(["_letters"])
            yield put(batch, {out: pa.array(found, pa.string()), score: pa.array(sure, pa.float64())})

    return map_batches(marked, run, extended(df, {out: T.StringType(), score: T.DoubleType()}))
