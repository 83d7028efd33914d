"""Whitening of embeddings: leading principal components of their covariance, scaled to variance one.

Every entry c of a vector becomes the whole number floor(256 * c), so sums are
exact whatever the order of the rows. The fit counts each distinct vector once.

1. Distinct vectors are found by a grouping that Spark combines inside each task,
   and are written once.
2. Sums per dimension, then products of the centred vectors: each task adds up its
   own vectors and hands on one row per entry of its matrix, which Spark sums.
3. The matrix (dimensions squared, whatever the number of rows) is brought to
   tridiagonal form by Householder reflections on the driver. Bisection on Sturm
   counts finds the leading eigenvalues, inverse iteration their vectors; vectors of
   eigenvalues close to each other are made orthogonal to the earlier ones.
4. The components travel to the tasks with the function, which projects each batch.

Cases: rows whose vector is null or holds a null or non-finite entry take no part
and get nulls; an entry beyond the range of a long is taken as the nearest long.
The fit takes vectors of the commonest length (of equally common ones the longest);
others get null deviations and null entries. A component without variance (rank
below the number asked for, a single vector) has null entries and explains 0, or
null if no component has any. A deviation beyond a long is null. Fewer dimensions
than components give fewer components. Repeated rows are projected alike, null ids
pass through, an empty table gives an empty result. Other columns pass through,
except those named like an output column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.batches import extended, map_batches, put
from threadloom.session import cut_lineage

SCALE = 256
COMPONENTS = 4
#: Eigenvalues nearer to each other than this share of the largest one are one cluster.
CLUSTER = 1e-3
#: Rows turned into matrices at once.
ROWS = 4096
_LEAST, _MOST = -(2**63), 2**63 - 1
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


@dataclass
class Model:
    """n fitted vectors with their sums; components are rows. Eigenvalues without variance are 0."""

    dims: int
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.values]


# ---------------------------------------------------------------- vectors in batches


def whole_vectors(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of longs) for usable rows of each length in a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable = (sizes >= 0) & (broken[ends[1:]] == broken[ends[:-1]])
    for size in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == size))
        for i in range(0, len(rows), ROWS):
            some = rows[i : i + ROWS]
            scaled = np.floor(flat[ends[some][:, None] + np.arange(size)] * SCALE)
            inside = np.where(np.abs(scaled) < 2.0**63, scaled, 0).astype(np.int64)
            yield some, np.where(scaled >= 2.0**63, _MOST, np.where(scaled < -(2.0**63), _LEAST, inside))


def packed(x: np.ndarray) -> list[bytes]:
    """One value per vector, equal for equal vectors: the entries in the least width that holds them, width first."""
    low, high = (x.min(1), x.max(1)) if x.shape[1] else (np.zeros(len(x), np.int64),) * 2
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), bool)
    for k, kind in enumerate(_WIDTHS):
        fits = left & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        for i, row in zip(np.flatnonzero(fits).tolist(), x[fits].astype(kind)):
            out[i] = bytes([k]) + row.tobytes()
        left &= ~fits
    return out


def unpacked(column: pa.Array, dims: int) -> Iterator[np.ndarray]:
    """Matrices of longs from packed vectors of one length."""
    values = column.to_pylist()
    for k, kind in enumerate(_WIDTHS):
        some = [v for v in values if v[0] == k]
        for i in range(0, len(some), ROWS):
            joined = b"".join(v[1:] for v in some[i : i + ROWS])
            yield np.frombuffer(joined, kind).reshape(-1, dims).astype(np.int64)


def distinct_vectors(df: DataFrame, embedding: str) -> DataFrame:
    """(dims, x): each distinct usable vector once."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for _, x in whole_vectors(batch.column("v")):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(packed(x), pa.binary())], ["dims", "x"])

    return map_batches(df.select(F.col(embedding).alias("v")), run, "dims int, x binary").distinct()


def exact_sum(x: np.ndarray) -> list[int]:
    """Sums of columns as whole numbers of any size."""
    if x.size and max(-int(x.min()), int(x.max())) < (_MOST // max(1, len(x))):
        return x.sum(0).tolist()
    return [sum(column) for column in x.T.tolist()]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums: as longs where no square sum can leave their range, else as Python numbers."""
    reach = max([n * max(-int(x.min()), int(x.max())) + max(map(abs, sums), default=0)] if x.size else [0])
    if x.shape[1] * reach * reach <= _MOST:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return deviations(x, n, sums).astype(np.float64) / n


# ---------------------------------------------------------------- eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and unit reflectors of Q' a Q; reflector k acts on entries k + 1 and on."""
    a = a.copy()
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) == 0:
            reflectors.append(np.zeros(len(v)))
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each of the places."""
    tiny = np.finfo(float).tiny ** 0.5
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for d, s in zip(diagonal[1:], side):
        q = d - at - s * s / np.where(np.abs(q) < tiny, np.copysign(tiny, q), q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection."""
    n = len(diagonal)
    around = np.abs(np.append(side, 0)) + np.abs(np.append(0, side))
    low = np.full(k, (diagonal - around).min())
    high = np.full(k, (diagonal + around).max())
    high += np.finfo(float).eps * n * np.maximum(np.abs(low), np.abs(high)) + np.finfo(float).tiny
    rank = n - np.arange(k)  # the i-th largest has fewer than rank eigenvalues below it
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        under = below(diagonal, side, middle) >= rank
        low, high = np.where(under, low, middle), np.where(under, middle, high)


def solve(diagonal: np.ndarray, side: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) x = right by elimination with row exchanges; pivots under ``least`` are set to it."""
    n = len(diagonal)
    main, upper, second = (diagonal - shift).copy(), np.append(side, 0.0), np.zeros(n)
    x = right.copy()
    for i in range(n - 1):
        row = [side[i], main[i + 1], upper[i + 1]]
        if abs(row[0]) > abs(main[i]):
            main[i], upper[i], second[i], row = row[0], row[1], row[2], [main[i], upper[i], second[i]]
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(main[i]) < least:
            main[i] = least
        factor = row[0] / main[i]
        main[i + 1], upper[i + 1] = row[1] - factor * upper[i], row[2] - factor * second[i]
        x[i + 1] -= factor * x[i]
    if abs(main[n - 1]) < least:
        main[n - 1] = least
    for i in range(n - 1, -1, -1):
        x[i] -= (upper[i] * x[i + 1] if i + 1 < n else 0) + (second[i] * x[i + 2] if i + 2 < n else 0)
        x[i] /= main[i]
    return x


def leading_vectors(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix and their unit vectors as rows."""
    n = len(a)
    k = min(k, n)
    scale = np.abs(a).max() if n else 0.0
    if not scale:
        return np.zeros(k), np.eye(k, n)
    diagonal, side, reflectors = tridiagonal(a / scale)
    values = leading_values(diagonal, side, k)
    span = max(np.abs(diagonal).max(), np.abs(side).max(initial=0.0))
    least = np.finfo(float).eps * span
    rng = np.random.default_rng(1)
    found: list[np.ndarray] = []
    for i, value in enumerate(values):
        first = i  # the cluster reaches back as long as neighbours are close
        while first and values[first - 1] - values[first] < CLUSTER * span:
            first -= 1
        x = rng.standard_normal(n)
        for _ in range(6):
            x = solve(diagonal, side, value, x / np.linalg.norm(x), least)
            x /= np.abs(x).max()
            for _ in range(2):
                for other in found[first:i]:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
        found.append(x)
    out = np.array(found)
    for j in range(len(reflectors) - 1, -1, -1):
        v = reflectors[j]
        out[:, j + 1 :] -= 2 * np.outer(out[:, j + 1 :] @ v, v)
    return values * scale, out


# ---------------------------------------------------------------- fit and projection


def _sums(vectors: DataFrame, dims: int) -> list[int]:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in source:
            for x in unpacked(batch.column("x"), dims):
                total = [a + b for a, b in zip(total, exact_sum(x))]
        values = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), values], ["i", "s"])

    rows = map_batches(vectors.select("x"), run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    told = {r["i"]: int(r["s"]) for r in rows.collect()}  # one row per dimension
    return [told[i] for i in range(dims)]


def _covariance(vectors: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in source:
            for x in unpacked(batch.column("x"), dims):
                c = centred(x, n, sums)
                total += c.T @ c
        for i in range(dims):
            j = np.arange(i, dims)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i), pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, i:])], ["i", "j", "v"])

    rows = map_batches(vectors.select("x"), run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    table = rows.toArrow()  # dims * (dims + 1) / 2 rows
    i, j, v = (table.column(c).to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((dims, dims))
    out[i, j] = out[j, i] = v / n
    return out


def _identity_error(vectors: DataFrame, model: Model) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    real = np.flatnonzero(model.values > 0)
    if not len(real):
        return None
    names = [f"w{i}" for i in real]
    dims, n, sums = model.dims, model.n, model.sums
    axes = (model.components[real] / np.sqrt(model.values[real])[:, None]).T

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for x in unpacked(batch.column("x"), dims):
                w = centred(x, n, sums) @ axes
                yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(len(names))], names)

    rows = map_batches(vectors.select("x"), run, ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = rows.agg(*[F.abs(F.covar_pop(a, b) - (1 if a == b else 0)) for a, b in pairs]).first()
    return float(max(row))


def fit(df: DataFrame, embedding: str = "embedding", k: int = COMPONENTS) -> Model:
    """Components of the covariance of the distinct vectors."""
    vectors = cut_lineage(distinct_vectors(df, embedding))
    top = vectors.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if top is None or not top["dims"]:
        return Model(0, top["n"] if top else 0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    dims, n = top["dims"], top["n"]
    vectors = vectors.where(F.col("dims") == dims)
    sums = _sums(vectors, dims)
    covariance = _covariance(vectors, dims, n, sums)
    values, components = leading_vectors(covariance, k)
    trace = float(np.trace(covariance))
    values = np.where(values > 8 * dims * np.finfo(float).eps * trace, values, 0.0)
    model = Model(dims, n, sums, components, values, trace)
    model.identity_error = _identity_error(vectors, model)
    return model


def transform(df: DataFrame, model: Model, embedding: str = "embedding", out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Add the whitened vector (array, null for rows without a usable vector) and the squared deviation."""
    dims, n, sums, k = model.dims, model.n, model.sums, len(model.values)
    scale = np.array([1 / np.sqrt(v) if v > 0 else np.nan for v in model.values])
    axes = (model.components * scale[:, None]).T

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows: list[list | None] = [None] * batch.num_rows
            squares: list[int | None] = [None] * batch.num_rows
            for at, x in whole_vectors(batch.column(embedding)):
                if x.shape[1] != dims or not dims:
                    for i in at.tolist():
                        rows[i] = [None] * k
                    continue
                d = deviations(x, n, sums)
                square = (d * d).sum(1).tolist()
                w = (d.astype(np.float64) / n) @ axes
                for i, s, r in zip(at.tolist(), square, w.tolist()):
                    squares[i] = s if s <= _MOST else None
                    rows[i] = [None if v != v else v for v in r]
            yield put(batch, {out: pa.array(rows, pa.list_(pa.float64())), deviation: pa.array(squares, pa.int64())})

    return map_batches(df, run, extended(df, {out: T.ArrayType(T.DoubleType()), deviation: T.LongType()}))


def whiten(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per usable vector and component."""
    model = fit(df, embedding, k)
    rows = transform(df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("_v")), model, "_v", out="_w")
    long = rows.where("_w is not null").select("vec_id", "deviation", F.posexplode("_w").alias("_i", "whitened"))
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained]).cast("array<double>")
    return long.select(
        "vec_id", (F.col("_i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_i")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
