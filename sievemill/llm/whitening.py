"""Whitening of embeddings: a distributed centred covariance, and its leading eigenvectors by tridiagonalisation and bisection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SCALE, SHIFT = 1024, 100_000
#: Dimensions at most: the driver holds a square of them.
MOST_DIMENSIONS = 4096
#: Entries of vectors in one NumPy step, and bytes of partial squares that one merging task takes.
STEP, MERGE_BYTES = 1 << 22, 1 << 26
#: Entries beyond this count as this: up to it, sums are exact.
LARGEST = 1 << 52
COMPONENTS = 8


# -- eigenvectors of a symmetric matrix --------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The diagonal, the side diagonal and the reflections (unit vectors, one for each column) of Householder's reduction."""
    a, n, mirrors = np.array(a, np.float64), len(a), []
    side = np.zeros(max(0, n - 1))
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        side[k] = -np.copysign(np.linalg.norm(x), x[0])
        x[0] -= side[k]
        size = np.linalg.norm(x)
        v = x / size if size > 0 else x
        mirrors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w)
        rest -= np.outer(w, v)
    if n > 1:
        side[n - 2] = a[n - 1, n - 2]
    return np.diagonal(a).copy(), side, mirrors


def below(diagonal: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are below each of `at`: the negative terms of Sturm's sequence."""
    least, count, q = np.finfo(float).tiny, np.zeros(len(at), np.int64), np.ones(len(at))
    for d, e in zip(diagonal, np.concatenate([[0.0], side * side]), strict=True):
        q = d - at - e / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, by bisection to the last bit that halving can tell."""
    reach = np.concatenate([[0.0], np.abs(side)]) + np.concatenate([np.abs(side), [0.0]])
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    low -= np.abs(low) * 1e-12 + 1e-300
    high += np.abs(high) * 1e-12 + 1e-300
    place = len(diagonal) - np.arange(k)  # so many eigenvalues are at most the one sought
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        enough = below(diagonal, side, middle) >= place
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)


def solver(diagonal: np.ndarray, side: np.ndarray, shift: float, least: float):
    """Solves (T - shift) y = b by elimination with row exchanges; pivots are `least` in size at least."""
    n = len(diagonal)
    up, over, swap, factor = np.zeros((n, 3)), diagonal - shift, [], []
    row = [over[0], side[0] if n > 1 else 0.0, 0.0]
    for i in range(n - 1):
        following = [side[i], over[i + 1], side[i + 1] if i + 2 < n else 0.0]
        exchanged = abs(following[0]) > abs(row[0])
        if exchanged:
            row, following = following, row
        if abs(row[0]) < least:
            row[0] = least
        f = following[0] / row[0]
        up[i] = row
        swap.append(exchanged)
        factor.append(f)
        row = [following[1] - f * row[1], following[2] - f * row[2], 0.0]
    if abs(row[0]) < least:
        row[0] = least
    up[n - 1] = row

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(n - 1):
            if swap[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            rest = up[i, 1] * y[i + 1] if i + 1 < n else 0.0
            rest += up[i, 2] * y[i + 2] if i + 2 < n else 0.0
            y[i] = (y[i] - rest) / up[i, 0]
            if abs(y[i]) > 1e150:
                y /= abs(y[i])
        return y

    return solve


def leading_vectors(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns. Vectors of eigenvalues that lie
    close together are made orthogonal in every step of the inverse iteration. The greatest entry of a vector is positive."""
    size = np.abs(a).max() if a.size else 0.0
    if not size > 0:
        return np.zeros(k), np.eye(len(a), k)
    diagonal, side, mirrors = tridiagonal(a / size)
    values = leading_values(diagonal, side, k)
    norm = max(np.abs(diagonal).max(), np.abs(side).max() if len(side) else 0.0)
    eps = np.finfo(float).eps
    found, first, rng = np.zeros((len(a), k)), 0, np.random.default_rng(1)
    shift = np.inf
    for j in range(k):
        if j and values[j - 1] - values[j] > 1e-3 * norm:
            first = j
        shift = min(values[j], shift - 10 * eps * norm) if j > first else values[j]  # equal values are told apart a little
        solve, y = solver(diagonal, side, shift, eps * norm), rng.uniform(-1, 1, len(a))
        for _ in range(6):
            y = solve(y / np.linalg.norm(y))
            for _ in range(2):
                y -= found[:, first:j] @ (found[:, first:j].T @ y)
        found[:, j] = y / np.linalg.norm(y)
    for i in range(len(mirrors) - 1, -1, -1):
        v = mirrors[i][:, None]
        found[i + 1 :] -= 2 * v @ (v.T @ found[i + 1 :])
    found /= np.linalg.norm(found, axis=0)
    found *= np.where(found[np.abs(found).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return values * size, found


# -- sums over all vectors ---------------------------------------------------------------------------------


def whole_numbers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows that take part, and their floor(SCALE * c) + SHIFT, a row each; in steps of bounded size. Shorter vectors count as
    filled with zeros."""
    lists = batch.column(1)
    flat = lists.flatten().cast(pa.float64())
    bad = ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    ends = np.cumsum(size)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    sound = lists.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends] == wrong[ends - size])
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    rows, width = np.flatnonzero(sound), int(size[sound].max(initial=0))
    for at in range(0, len(rows), max(1, STEP // max(1, width))):
        part = rows[at : at + max(1, STEP // max(1, width))]
        x = np.full((len(part), width), SHIFT, np.int64)
        own = size[part]
        inside = np.arange(width) < own[:, None]
        place = (ends - size)[part][:, None] + np.arange(width)
        x[inside] = np.clip(np.floor(SCALE * values[place[inside]]), -LARGEST, LARGEST).astype(np.int64) + SHIFT
        yield part, x


def joined(a: tuple, b: tuple, fill: float) -> tuple:
    """Moments (rows, means, centred square) of two sets of rows as one. The narrower one's missing columns all hold `fill`."""
    width = max(len(a[1]), len(b[1]))

    def wide(x: tuple) -> tuple:
        more = width - len(x[1])
        return x if not more else (x[0], np.concatenate([x[1], np.full(more, fill)]), np.pad(x[2], (0, more)))

    (n, p, s), (m, q, t) = wide(a), wide(b)
    if not n or not m:
        return (m, q, t) if m else (n, p, s)
    apart = q - p
    return n + m, p + apart * (m / (n + m)), s + t + np.outer(apart, apart) * (n * m / (n + m))


def moments(x: np.ndarray) -> tuple:
    """Rows, means and the square of the rows, which are centred before they are multiplied."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    return len(x), mean, centred.T @ centred


def gathered(partial: DataFrame, fill: float) -> tuple:
    """The partial moments of tasks (part, rows, means, square) as one. They meet in groups of bounded size, in a tree, in the order of their parts."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out = (0, np.zeros(0), np.zeros((0, 0)))
        for r in group.sort_values("part").itertuples():
            mean = np.frombuffer(r.means)
            out = joined(out, (r.rows, mean, np.frombuffer(r.square).reshape(len(mean), -1)), fill)
        return pd.DataFrame([(int(group["part"].min()) // fan, out[0], out[1].tobytes(), out[2].tobytes())], columns=["part", "rows", "means", "square"])

    kept = cut(partial)
    last, size = kept.agg(F.max("part"), F.max(F.length("means"))).first()
    parts, width = (last or 0) + 1, (size or 0) // 8
    if width > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {width} dimensions; at most {MOST_DIMENSIONS} can be whitened")
    fan = int(np.clip(MERGE_BYTES // max(1, 8 * width * width), 2, 256))
    while parts > fan:
        kept = kept.groupBy((F.col("part") / fan).cast("long").alias("_group")).applyInPandas(merge, kept.schema)
        parts = -(-parts // fan)
    out = (0, np.zeros(0), np.zeros((0, 0)))
    for r in sorted(kept.collect(), key=lambda r: r["part"]):
        mean = np.frombuffer(r["means"])
        out = joined(out, (r["rows"], mean, np.frombuffer(r["square"]).reshape(len(mean), -1)), fill)
    return out


PARTIAL = "part long, rows long, means binary, square binary"
HALF = 26


def covariance(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """How many vectors take part, their exact sum in each dimension, and their covariance (divisor: that number)."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, high, low = (0, np.zeros(0), np.zeros((0, 0))), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, x in whole_numbers(batch):
                out = joined(out, moments(x.astype(np.float64)), SHIFT)
                more, before = x.shape[1] - len(high), int(out[0]) - len(x)
                if more > 0:  # rows before are filled up
                    high, low = (np.concatenate([v, np.full(more, f * before)]) for v, f in ((high, SHIFT >> HALF), (low, SHIFT & (1 << HALF) - 1)))
                filled = np.full(max(0, -more), len(x), np.int64)
                high += np.concatenate([(x >> HALF).sum(axis=0), filled * (SHIFT >> HALF)])
                low += np.concatenate([(x & (1 << HALF) - 1).sum(axis=0), filled * (SHIFT & (1 << HALF) - 1)])
        if out[0]:
            columns = [[TaskContext.get().partitionId()], [out[0]], [out[1].tobytes()], [out[2].tobytes()], [high.tobytes() + low.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "rows", "means", "square", "sums"])

    partial = cut(rows.mapInArrow(own, f"{PARTIAL}, sums binary"))
    n, _, square = gathered(partial.drop("sums"), SHIFT)
    width = len(square)

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                high, low = np.frombuffer(raw, np.int64).reshape(2, -1)
                fill = np.full(width - len(high), m, np.int64)
                high, low = np.concatenate([high, fill * (SHIFT >> HALF)]), np.concatenate([low, fill * (SHIFT & (1 << HALF) - 1)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(high), pa.array(low)], ["dim", "high", "low"])

    sums = partial.select("rows", "sums").mapInArrow(halves, "dim int, high long, low long").groupBy("dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    exact = {r["dim"]: (r["high"] << HALF) + r["low"] for r in sums.collect()}
    return n, [exact[i] for i in range(width)], square / max(1, n)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of (n * x - S) squared over the dimensions, exact; null where a long can't hold it."""
    reach = max((max(abs(n * int(x[:, i].max()) - s), abs(n * int(x[:, i].min()) - s)) for i, s in enumerate(sums)), default=0) if len(x) else 0
    if n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62 and reach * reach * max(1, len(sums)) < 1 << 63:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    found = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in found]


def whitened(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error for each vector and component.

    Entries c count as x = floor(SCALE * c) + SHIFT. Each task centres its rows and multiplies them; the tasks' squares are joined in a tree,
    with what their means differ by. The driver holds one square of dimensions (at most MOST_DIMENSIONS) and finds its leading eigenvectors; these are
    broadcast, and projections are made where the vectors are. identity_error is measured on the projections themselves, in a pass of its own.

    Vectors that are null, or hold null or non-finite entries, are left out. Vectors shorter than the longest count as filled with zeros. Null keys
    and repeated rows: a vector each. Fewer dimensions than components: a row for each dimension. Ties of eigenvalues: any unit vectors at right
    angles, the same for all rows. A component without variance (rank too low, equal vectors): whitened is null, explained 0, and it doesn't count in
    identity_error. A deviation that a long can't hold is null; entries beyond LARGEST count as it. Other columns play no part. Empty table: no rows.
    """
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums, square = covariance(rows)
    if not n or not len(square):
        return vectors.sparkSession.createDataFrame([], schema)
    k = min(components, len(square))
    values, axes = leading_vectors(square, k)
    real = values > len(square) * np.finfo(float).eps * max(values.max(), 0.0)
    mean = np.array([s / n for s in sums])
    scaled = np.where(real, axes / np.sqrt(np.where(real, values, 1.0)), 0.0)
    trace = np.trace(square)
    explained = np.where(real, values / trace, 0.0) if trace > 0 else np.zeros(k)
    shared = vectors.sparkSession.sparkContext.broadcast((mean, scaled))

    def projected(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        mean, scaled = shared.value
        for part, x in whole_numbers(batch):
            if x.shape[1] < len(mean):
                x = np.pad(x, ((0, 0), (0, len(mean) - x.shape[1])), constant_values=SHIFT)
            yield part, x, (x - mean) @ scaled

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = (0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            for _, _, y in projected(batch):
                out = joined(out, moments(y), 0.0)
        if out[0]:
            columns = [[TaskContext.get().partitionId()], [out[0]], [out[1].tobytes()], [out[2].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "rows", "means", "square"])

    _, _, spread = gathered(rows.mapInArrow(own, PARTIAL), 0.0)
    error = float(np.abs(spread / n - np.eye(k))[np.ix_(real, real)].max(initial=0.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x, y in projected(batch):
                deviation = pa.array(deviations(x, n, sums), pa.int64())
                each, number = np.repeat(np.arange(len(part)), k), np.tile(np.arange(k), len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(part[each])), pa.array((number + 1).astype(np.int32)), pa.array(np.full(len(each), n)), deviation.take(pa.array(each)),
                        pa.array(y.ravel(), mask=~real[number]), pa.array(explained[number]), pa.array(np.full(len(each), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, schema)
