import math
import random

import numpy as np
import pytest

from paperlake.llm import exact_roots as R
from paperlake.llm import whitening as W
from paperlake.llm.queries import QUERIES
from tests.llm.conftest import SMALL


def leverrier(a):
    """Coefficients of det(x - a), constant first, by Faddeev and LeVerrier in integers."""
    n = len(a)
    a = np.array(a, dtype=object)
    m, c = np.zeros((n, n), dtype=object), [1]
    eye = np.array([[int(i == j) for j in range(n)] for i in range(n)], dtype=object)
    for k in range(1, n + 1):
        m = a.dot(m) + eye * c[-1]
        c.append(-int(a.dot(m).trace()) // k)
    return c[::-1]


def scatter(rows):
    x = np.array(rows, dtype=object)
    n, s = len(x), x.sum(axis=0)
    return (n * x.T.dot(x) - np.outer(s, s)).tolist()


def polynomial(a):
    primes = R.primes_beyond(2 * R.coefficient_bound(sum(a[i][i] for i in range(len(a))), len(a)))
    return R.combine(R.polynomial_residues(a, primes).tolist(), primes)


@pytest.mark.parametrize("size,rows,most", [(1, 5, 9), (2, 9, 10**9), (6, 40, 50), (6, 4, 50), (9, 30, 10**12)])
def test_polynomial_is_exact(size, rows, most):
    r = random.Random(size * rows)
    a = scatter([[r.randint(-most, most) for _ in range(size)] for _ in range(rows)])
    assert polynomial(a) == leverrier(a)


def test_polynomial_where_pivots_vanish():
    for a in ([[3, 0, 0], [0, 3, 0], [0, 0, 3]], [[0] * 4] * 4, [[1, 0, 1, 0], [0, 2, 0, 0], [1, 0, 1, 0], [0, 0, 0, 5]]):
        assert polynomial(a) == leverrier(a)


def test_roots_with_multiplicity_and_close_ones():
    large = 10**16  # relative to it roots are exact to 110 bits
    a = np.diag([7, 2, 2, 2, 0, large, large + 1]).tolist()
    found = R.largest_roots(leverrier(a), 7)
    assert [many for _, _, many in found] == [1, 1, 1, 3]
    assert [at >> bits for at, bits, _ in found[:2]] == [large + 1, large]
    assert np.allclose([at / 2**bits for at, bits, _ in found[2:]], [7, 2], rtol=1e-14)


def test_null_vectors_of_a_multiple_root():
    q = [[2, 1, 2], [1, 2, -2], [2, -2, -1]]  # orthogonal rows of length 3
    a = [[sum(q[k][i] * q[k][j] * e for k, e in enumerate((9, 9, 4))) for j in range(3)] for i in range(3)]
    (one, two) = R.largest_roots(leverrier(a), 3)
    assert (one[2], two[2]) == (2, 1)
    v = np.array(R.null_vectors(a, *one) + R.null_vectors(a, *two))
    assert abs(v @ v.T - np.eye(3)).max() < 1e-15
    assert abs(np.array(a) @ v[0] - 81 * v[0]).max() < 1e-12 and abs(abs(v[2]) - abs(np.array(q[2])) / 3).max() < 1e-15


def entries(c):
    return [math.floor(64 * float(v)) + 1_000_000 for v in c]


def test_query_against_an_eigendecomposition(spark):
    data = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    x = np.array([entries(v) for v in data.values()], dtype=np.int64)
    n = len(x)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    rows = QUERIES["op11_whitening"](spark, SMALL).collect()
    assert len(rows) == 32 * n and {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error < 1e-9
    spread = dict(zip(data, ((n * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist()))
    assert all(r.deviation == spread[r.vec_id] for r in rows)
    found = {(r.vec_id, r.component): r for r in rows}
    centred = x - x.mean(axis=0)
    for c in range(1, 33):
        wanted = centred @ vectors[:, -c] / math.sqrt(values[-c])
        mine = np.array([found[i, c].whitened for i in data])
        assert min(abs(mine - wanted).max(), abs(mine + wanted).max()) < 1e-8
        assert abs(found[next(iter(data)), c].explained * values.sum() / values[-c] - 1) < 1e-10


def whitened(df, **kw):
    model = W.fit(df, "v", **kw)
    return model, {r.id: r for r in W.whiten(df, model, "v").collect()}


def test_rows_that_take_no_part(spark):
    r = random.Random(2)
    good = [(k, [r.uniform(-1, 1) for _ in range(3)], "x") for k in range(40)]
    odd = [(90, None, "x"), (91, [0.1, None, 0.2], "x"), (92, [0.1, float("nan"), 0.2], "x"), (93, [float("inf"), 0.0, 0.0], "x"),
           (94, [1.0], "x"), (95, [], "x"), (96, [1e30, 0.0, 0.0], "x")]
    schema = "id long, v array<double>, whitened string"
    model, rows = whitened(spark.createDataFrame(good + odd, schema).repartition(5))
    again, same = whitened(spark.createDataFrame(good, schema).coalesce(1))
    assert sorted(rows) == list(range(40)) and model.n == 40 and model.sums == again.sums
    assert all(np.allclose(rows[k].whitened, same[k].whitened, atol=1e-12) and rows[k].deviation == same[k].deviation for k in rows)
    twice, double = whitened(spark.createDataFrame(good + good, schema))
    assert twice.n == 80 and np.allclose(double[3].whitened, same[3].whitened, atol=1e-12)


def test_tables_without_variance(spark):
    schema = "id long, v array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(k, [0.5, 0.25]) for k in range(9)], [(1, None)]):
        model, found = whitened(spark.createDataFrame(rows, schema))
        assert not model.variances and all(list(r.whitened) == [] and r.deviation == 0 for r in found.values())
        assert W.identity_error(W.whiten(spark.createDataFrame(rows, schema), model, "v"), model) == 0.0
    model, found = whitened(spark.createDataFrame([(k, [float(k), 3.0, float(k)]) for k in range(5)], schema))
    assert len(model.variances) == 1 and model.explained == [1.0]  # the others have none


def test_large_entries_stay_exact(spark):
    r = random.Random(4)
    rows = [(k, [r.uniform(-1, 1) * 2.0**e for e in (55, 40, 3)]) for k in range(30)]
    model, found = whitened(spark.createDataFrame(rows, "id long, v array<double>"))
    x = [[math.floor(64 * c) for c in v] for _, v in rows]
    assert model.sums == [sum(c) for c in zip(*x)]
    assert all(r.deviation is None for r in found.values())  # beyond 64 bits
    assert W.identity_error(W.whiten(spark.createDataFrame(rows, "id long, v array<double>"), model, "v"), model) < 1e-9
