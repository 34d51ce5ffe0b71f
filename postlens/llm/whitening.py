"""Whitening of embeddings by a bidiagonal qd solver.

An entry c becomes the whole number floor(64 c) + ``OFFSET``. Each distinct
vector x counts once in the fit: n vectors with sums S. Rows centred without
rounding, (n x - S) / n, are reduced by QR: each task folds its blocks of
``BLOCK`` rows into one triangle, triangles are folded ``FAN`` at a time until
one is left. Its singular values and right vectors (see ``bidiagonal``) are
those of the centred rows, so no covariance is ever formed; e = value^2 / n.

Defined results: a row is dropped if its vector is null, empty, or holds a
null, a NaN or an infinity. Vectors of different lengths are fitted apart, each
length as a table of its own. Whole numbers beyond 2^40 either way count as
2^40. Components whose eigenvalue is nothing to double precision (constant
dimensions, fewer distinct vectors than dimensions) are not returned, so a
table of one distinct vector has none. ``deviation`` is exact; where it
doesn't fit a long it is null. Null and repeated ids are kept as they are;
other columns are ignored. Each vector's largest entry decides its sign.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.bidiagonal import EPS, right_vectors
from postlens.llm.tables import slices, stored

COMPONENTS = 16
OFFSET = 1_000_000
SCALE = 64
BOUND = 1 << 40
BLOCK = 8192
FAN = 16
_LONG = (1 << 63) - 1
_X = pa.list_(pa.int64())


@dataclass(frozen=True)
class Fit:
    """The fit of vectors of one length: their number, sums, components (columns), eigenvalues, total variance."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """(rows that stay, [(length, their places, their whole numbers as a matrix)])."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    flat = vectors.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    starts = np.cumsum(lengths) - lengths
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    good = (lengths > 0) & (bad[starts + lengths] == bad[starts])
    groups = []
    for length in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == length))
        block = values[starts[rows][:, None] + np.arange(length)]
        block = np.clip(np.floor(block * SCALE), -BOUND, BOUND - OFFSET)
        groups.append((int(length), rows, block.astype(np.int64) + OFFSET))
    return good, groups


def _lists(matrix: np.ndarray, kind=pa.int64()) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1), kind))


def _rows(batches):
    for whole in batches:
        for batch in slices(whole):
            ids = batch.column("vec_id")
            for _, rows, x in whole_numbers(batch.column("embedding"))[1]:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), _lists(x)], ["vec_id", "x"])


def matrices(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, its rows, their vectors) for each length in batches with a column x."""
    for whole in batches:
        for batch in slices(whole):
            x = batch.column("x")
            lengths, flat = np.asarray(x.value_lengths()), np.asarray(x.flatten())
            starts = np.cumsum(lengths) - lengths
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                yield batch, rows, flat[starts[rows][:, None] + np.arange(length)]


def _sums(batches):
    """One row for each length and dimension a task sees: vectors, sum of their entries."""
    counts, sums = {}, {}
    for _, rows, x in matrices(batches):
        d = x.shape[1]
        counts[d] = counts.get(d, 0) + len(rows)
        part = [int(s) for s in x.sum(axis=0)]
        sums[d] = [a + b for a, b in zip(sums.get(d, [0] * d), part)]
    for d, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([counts[d]] * d, pa.int64()),
             pa.array([str(t) for t in total])], ["dims", "place", "n", "total"])


def numerators(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n x - S, exact: as longs where they fit, else as Python's whole numbers."""
    sums = np.array(fit.sums, dtype=object)
    reach = max(abs(fit.n * int(x.max()) - min(fit.sums)), abs(max(fit.sums) - fit.n * int(x.min())), fit.n * int(np.abs(x).max()))
    if reach < 1 << 62 and max(map(abs, fit.sums)) < 1 << 62:
        return x * fit.n - sums.astype(np.int64)
    return x.astype(object) * fit.n - sums


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    """x - S / n, rounded once."""
    top = numerators(x, fit)
    return (top / fit.n).astype(np.float64)


def deviations(x: np.ndarray, fit: Fit) -> pa.Array:
    top = numerators(x, fit)
    if top.dtype != object and int(np.abs(top).max(initial=0)) ** 2 * top.shape[1] <= _LONG:
        return pa.array((top * top).sum(axis=1))
    exact = [sum(int(v) ** 2 for v in row) for row in top]
    return pa.array([v if v <= _LONG else None for v in exact], pa.int64())


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square upper factor of rows' QR."""
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == rows.shape[1] else np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def _triangles(shared):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for _, _, x in matrices(batches):
            d = x.shape[1]
            for at in range(0, len(x), BLOCK):
                block = centred(x[at : at + BLOCK], shared.value[d])
                held[d] = triangle(np.vstack([held[d], block]) if d in held else block)
        yield from _as_triangles(held)

    return run


def _as_triangles(held: dict[int, np.ndarray]):
    for d, r in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([r.astype("<f8").tobytes()])], ["dims", "r"])


def _folded(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            r = np.frombuffer(data, dtype="<f8").reshape(d, d)
            held[d] = triangle(np.vstack([held[d], r])) if d in held else r
    yield from _as_triangles(held)


def _grams(shared):
    """Sums of products of whitened vectors, one matrix for each length a task sees."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for _, _, x in matrices(batches):
            fit = shared.value[x.shape[1]]
            w = whitened(x, fit)
            held[x.shape[1]] = held.get(x.shape[1], 0) + w.T @ w
        for d, g in held.items():
            k = len(g)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * k * k, pa.int32()), pa.array(range(k * k), pa.int32()), pa.array(g.reshape(-1))],
                ["dims", "place", "total"])

    return run


def whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return centred(x, fit) @ (fit.vectors / np.sqrt(fit.eigenvalues))


def components(r: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(vectors, eigenvalues, trace) from the triangle; eigenvalues that are nothing beside the largest are left out."""
    squares, vectors = right_vectors(r, count)
    values = squares[: vectors.shape[1]]
    keep = values > (EPS * max(n, len(r))) ** 2 * squares[0] if len(squares) and squares[0] > 0 else np.zeros(len(values), bool)
    vectors = vectors[:, keep]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else 1.0
    return vectors * signs, values[keep] / n, float((r * r).sum() / n)


def fit_of(distinct: DataFrame, count: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length in a table of distinct vectors x."""
    sc = distinct.sparkSession.sparkContext
    sums = distinct.mapInArrow(_sums, "dims int, place int, n bigint, total string")
    rows = sums.groupBy("dims", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    fits: dict[int, Fit] = {}
    for r in sorted(rows.collect()):  # one row a dimension
        old = fits.get(r["dims"])
        fits[r["dims"]] = Fit(r["n"], (*(old.sums if old else ()), int(r["total"])), np.empty((0, 0)), np.empty(0), 0.0)
    if not fits:
        return {}
    shared = sc.broadcast(fits)
    triangles = distinct.mapInArrow(_triangles(shared), "dims int, r binary")
    parts = distinct.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        triangles = triangles.repartition(parts).mapInArrow(_folded, "dims int, r binary")
    for r in triangles.repartition(1).mapInArrow(_folded, "dims int, r binary").collect():  # one triangle a length
        d = r["dims"]
        square = np.frombuffer(r["r"], dtype="<f8").reshape(d, d)
        fits[d] = Fit(fits[d].n, fits[d].sums, *components(square, fits[d].n, count))
    shared = sc.broadcast(fits)
    grams = distinct.mapInArrow(_grams(shared), "dims int, place int, total double")
    error = grams.groupBy("dims", "place").agg(F.sum("total").alias("total")).collect()  # count^2 rows a length
    for r in error:
        f = fits[r["dims"]]
        k = f.vectors.shape[1]
        off = abs(r["total"] / f.n - (r["place"] // k == r["place"] % k))
        fits[r["dims"]] = Fit(f.n, f.sums, f.vectors, f.eigenvalues, f.trace, max(f.identity_error, off))
    return fits


def _whiten(shared):
    def run(batches):
        for batch, rows, x in matrices(batches):
            fit = shared.value[x.shape[1]]
            k = fit.vectors.shape[1]
            if not k:
                continue
            each = np.repeat(rows, k)
            deviation = deviations(x, fit)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(each), fit.n)),
                    deviation.take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(whitened(x, fit).reshape(-1)),
                    pa.array(np.tile(fit.eigenvalues / fit.trace, len(rows))),
                    pa.array(np.full(len(each), fit.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component (1 to ``count``), n, deviation, whitened, explained, identity_error of embeddings(vec_id, embedding)."""
    sc = embeddings.sparkSession.sparkContext
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("embedding IS NOT NULL").mapInArrow(_rows, "vec_id bigint, x array<bigint>")
    fits = fit_of(stored(rows.select("x").distinct(), "distinct-vectors"), count)
    shape = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_whiten(sc.broadcast(fits)), shape)
