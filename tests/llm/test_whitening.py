"""Whitening against a dense eigendecomposition in exact sums."""
import numpy as np
import pytest

from parley.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, x long, n long, whitened double, label int"


def brute(vectors, k=16):
    """Distinct whole vectors, n, sums, eigenvalues (falling) and vectors."""
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (fit * n - sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, n, sums, e[::-1], v[:, ::-1]


def whitened(spark, rows, k=16):
    df = spark.createDataFrame([(*r, 1, 2, 3.0, 4) for r in rows], SCHEMA).repartition(3)
    return W.whiten(df, k).toPandas()


def check(got, ids, vectors, k=16):
    x, n, sums, e, v = brute(vectors)
    found = min(k, int((e > 1e-10 * e[0]).sum()))
    assert len(got) == len(ids) * found and set(got["n"]) == {n}
    away = [(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))) for row in x]
    for j in range(found):
        part = got[got["component"] == j + 1].sort_values("vec_id", kind="stable")
        order = np.argsort(ids, kind="stable")
        assert part["vec_id"].tolist() == [ids[i] for i in order]
        assert sorted(part["deviation"].tolist()) == sorted(away)
        assert part["explained"].to_numpy() == pytest.approx(e[j] / e.sum(), rel=1e-9)
        z = ((x * n - sums) / n) @ v[:, j] / np.sqrt(e[j])
        if len(set(ids)) == len(ids):
            assert part["deviation"].tolist() == [away[i] for i in order]
            sign = np.sign(part["whitened"].to_numpy() @ z[order])
            gap = min([abs(e[j] - e[i]) for i in (j - 1, j + 1) if 0 <= i < len(e)])
            assert part["whitened"].to_numpy() == pytest.approx(sign * z[order], abs=1e-11 * e[0] / gap + 1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-4


@pytest.mark.parametrize("kind", ["flat", "steep", "low rank", "few dimensions"])
def test_against_dense(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "flat":
        x = rng.normal(size=(900, 48))
    elif kind == "steep":
        x = 2000 * rng.normal(size=(700, 40)) * 10.0 ** -np.linspace(0, 3.5, 40)
    elif kind == "low rank":
        x = np.round(rng.normal(size=(300, 5)) * 8) @ np.round(rng.normal(size=(5, 36)) * 4)
    else:
        x = rng.normal(size=(200, 3))
    check(whitened(spark, [(i, r.tolist()) for i, r in enumerate(x)]), list(range(len(x))), x)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    x[10:40] = x[10]  # copies count once in the fit
    ids = list(range(60))
    ids[50] = 49  # an id twice
    rows = [(i, r.tolist()) for i, r in zip(ids, x, strict=True)]
    odd = [(70, None), (71, [None] + [0.0] * 5), (72, [float("nan")] * 6), (73, [float("inf")] + [0.0] * 5), (74, [])]
    got = whitened(spark, rows + odd)
    check(got, ids, x)
    more = whitened(spark, [*rows, *odd, (None, x[3].tolist()), (80, [1.0, 2.0])])
    assert len(more) == 62 * 6 and set(more["n"]) == set(got["n"])
    other = more[more["vec_id"] == 80]
    assert len(other) == 6 and other["deviation"].isna().all() and other["whitened"].isna().all()
    nameless = more[more["vec_id"].isna()].sort_values("component")
    same = more[more["vec_id"] == 3].sort_values("component")
    assert nameless["whitened"].tolist() == same["whitened"].tolist()


def test_nothing_to_fit(spark):
    assert len(whitened(spark, [])) == 0
    assert len(whitened(spark, [(1, None)])) == 0
    assert len(whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])) == 0
    with pytest.raises(Exception, match="does not fit a long"):
        whitened(spark, [(1, [1e300, 2.0])])


def test_deviations_are_exact():
    big = np.array([[1 << 40, 5], [3, 1 << 40]], dtype=np.int64)
    sums = big.sum(axis=0)
    assert W.deviations(big, 2, sums) == [None, None]
    small = np.array([[1_000_003, 999_999], [1_000_000, 1_000_001]], dtype=np.int64)
    assert W.deviations(small, 2, small.sum(axis=0)) == [9 + 4, 9 + 4]
    middle = np.array([[2_000_000_000, 1], [1, 1]], dtype=np.int64)
    assert W.deviations(middle, 2, middle.sum(axis=0)) == [1999999999 ** 2] * 2


def test_a_missed_eigenvector_is_noticed(spark):
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.normal(size=(500, 40)) * np.r_[50, np.ones(39)]).astype(np.int64) + 1_000_000
    blocks = spark.createDataFrame([(x.astype("<i8").tobytes(),)], "x binary")
    v = W.Covariance.of(blocks, 40)
    _, _, _, e, vec = brute((x - 1_000_000) / 64)
    q = vec[:, 1:33]  # an invariant block without the first
    assert not W._probed(v, q, e[1:33], 16, 8, rng)
    assert W._probed(v, vec[:, :32], e[:32], 16, 8, rng)
