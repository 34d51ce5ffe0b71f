import numpy as np
import pytest

from postlens.llm import queries, whitening as wh
from postlens.llm.bidiagonal import bidiagonalise, dqds, right_vectors

SHAPE = "vec_id long, embedding array<float>, label string"


def plain(rows):
    """(n, sums, x by row, eigenvalues, vectors) by numpy's own solver and whole-number sums."""
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, kept, values[::-1], vectors[:, ::-1]


def cases():
    rng = np.random.default_rng(5)
    for d in (1, 2, 5, 33):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        yield rng.standard_normal((d, d))
        yield q
        yield (q * np.where(np.arange(d) < d // 2, 2.0, 1.0)) @ q.T
        yield (q * 0.5 ** np.arange(d)) @ q.T
        yield rng.standard_normal((d, d)) * (np.arange(d) % 2)
        yield np.zeros((d, d))
        yield np.eye(d) * 3
        yield np.outer(rng.standard_normal(d), rng.standard_normal(d))


@pytest.mark.parametrize("i", range(32))
def test_solver_equals_numpy(i):
    a = np.linalg.qr(list(cases())[i])[1]
    values, vectors = right_vectors(a, 16)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.abs(values - want).max() <= 1e-13 * max(want[0], 1e-300)
    assert vectors.shape[1] == min(16, (want > 1e-26 * want[0]).sum()) or not want[0]
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max(initial=0) < 1e-11
    off = a.T @ (a @ vectors) - vectors * values[: vectors.shape[1]]
    assert np.abs(off).max(initial=0) <= 1e-12 * max(want[0], 1e-300)


def test_small_singular_values_keep_their_digits():
    q, e = np.array([1.0, 1e-8, 1e-16, 1e-20]), np.array([1e-9, 1e-17, 1e-22])
    from fractions import Fraction

    def below(x):  # eigenvalues below x, by exact signs of pivots
        gram = [Fraction(q[0])] + [Fraction(q[k]) + Fraction(e[k - 1]) for k in range(1, 4)]
        pivot, count = gram[0] - x, int(gram[0] < x)
        for k in range(1, 4):
            pivot = gram[k] - x - Fraction(q[k - 1]) * Fraction(e[k - 1]) / pivot
            count += pivot < 0
        return count

    for place, value in enumerate(dqds(q, e)[::-1]):
        assert below(Fraction(value) * Fraction(1 - 1e-13)) == place and below(Fraction(value) * Fraction(1 + 1e-13)) == place + 1


def test_bidiagonal_is_orthogonally_equal():
    a = np.random.default_rng(2).standard_normal((9, 9))
    diagonal, beside, right = bidiagonalise(a)
    b = np.diag(diagonal) + np.diag(beside, 1)
    assert np.allclose(right @ b.T @ b @ right.T, a.T @ a) and np.allclose(right.T @ right, np.eye(9))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(20) * np.linspace(1, 3, 20)).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(300)]  # copies count once in the fit
    odd = [(None, rows[5][1]), (2000, None), (2001, []), (2002, [*rows[0][1][:19], None]), (2003, [*rows[0][1][:19], float("nan")]),
           (2004, [*rows[0][1][:19], float("-inf")])]
    everything = rows + odd
    df = spark.createDataFrame([(i, v, "x") for i, v in everything], SHAPE).repartition(20)
    got = {}
    for r in wh.whiten(df).collect():
        got.setdefault(r["vec_id"], []).append(r)
    n, sums, kept, values, vectors = plain(everything)
    assert n == 200 and set(got) == {i for i, _ in kept}
    for i, x in kept:
        mine = sorted((r for r in got[i]), key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, 17)) * 1
        assert {(r["n"], r["deviation"]) for r in mine} == {(n, sum((n * c - s) ** 2 for c, s in zip(x, sums)))}
        want = np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ vectors[:, :16] / np.sqrt(values[:16])
        assert np.allclose(np.abs([r["whitened"] for r in mine]), np.abs(want), atol=1e-9)
        assert np.allclose([r["explained"] for r in mine], (values / values.sum())[:16], rtol=1e-10)
        assert all(r["identity_error"] < 1e-10 for r in mine)


def test_whitened_rows_have_one_sign(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    rows = wh.whiten(df).collect()
    w = np.zeros((60, 6))
    for r in rows:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.allclose(w.T @ w / 60, np.eye(6), atol=1e-10)


def test_constant_dimensions_and_few_vectors(spark):
    rows = [(i, [float(i), 7.0, float(i * i % 5)]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["component"] for r in wh.whiten(df).collect()} == {1, 2}
    assert {r["component"] for r in wh.whiten(df.where("vec_id < 2")).collect()} == {1}
    assert wh.whiten(df.where("vec_id < 1")).count() == 0
    assert wh.whiten(df.limit(0)).count() == 0


def test_lengths_are_fitted_apart_and_large_entries_bounded(spark):
    rows = [(i, [float(i), float(i % 3)]) for i in range(8)] + [(10 + i, [float(i * i), 1.0, float(i % 2)]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r["vec_id"] // 10, r["n"]) for r in wh.whiten(df).collect()} == {(0, 8), (1, 8)}
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], "vec_id long, embedding array<double>")
    assert {(r["component"], r["deviation"]) for r in wh.whiten(huge).collect() if r["vec_id"] == 1} == {(1, None)}


def test_query_over_its_table(spark):
    got = queries.QUERIES["op13_embedding_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    n, sums, kept, values, vectors = plain([(r[0], r[1]) for r in rows])
    assert len(got) == 16 * len(kept) and set(got["n"]) == {n}
    x = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for _, x in kept])
    want = np.abs(x @ vectors[:, :16] / np.sqrt(values[:16]))
    have = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in kept]].to_numpy()
    assert np.allclose(np.abs(have), want, atol=1e-9)
