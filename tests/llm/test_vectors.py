"""Nearest neighbours and exact top-k against brute force."""
import numpy as np
import pytest

from parley.llm.ann import nearest
from parley.llm.common import written
from parley.llm.topk import Lists, top_k

SCHEMA = "vec_id long, embedding array<double>, id long, score double, rank int, label int"


def odd_vectors(n=400, d=12, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[5:60] = x[5]  # copies
    x[70] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, None), (n + 20, [None] + [0.1] * (d - 1)), (n + 40, [float("nan")] * d), (n + 41, [float("inf")] + [0.0] * (d - 1)),
             (n + 60, [1.0]), (n + 80, []), (None, [0.5] * d), (20, x[20].tolist())]
    return [(*r, 1, 2.0, 3, 4) for r in rows], x


def brute(x, ids, queries, k, score):
    out = {}
    for q in queries:
        s = score(x, x[ids.index(q)])
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def ids_of(df, mod):
    return df.where(f"vec_id % {mod} = 0").selectExpr("vec_id as id")


def test_top_k_is_exact(spark, monkeypatch):
    from parley.llm import topk
    rows, x = odd_vectors()
    monkeypatch.setattr(topk, "CANDIDATES", 90)
    monkeypatch.setattr(topk, "QUERIES", 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = by_query(top_k(df, ids_of(df, 10), 10).collect())
    whole = np.floor(1024 * x).astype(np.int64)
    want = brute(whole, list(range(len(x))), range(0, len(x), 10), 10, lambda m, q: m @ q)
    assert got == {q: [(i, int(s)) for i, s in v] for q, v in want.items()}
    few = spark.createDataFrame(rows[:5], SCHEMA)
    assert [len(v) for v in by_query(top_k(few, ids_of(few, 2), 10).collect()).values()] == [4, 4, 4]
    assert top_k(df.limit(0), ids_of(df, 10), 10).count() == 0


@pytest.mark.parametrize("n", [1, 2, 11, 12, 300])
def test_lists_with_ties(n):
    y = np.random.default_rng(n).integers(-3, 4, (n, 3))
    lists = Lists(np.arange(n) * 2, y)
    for i in range(0, n, 7):
        ids, scores = lists.top(y[i], 2 * i, 10)
        s = y @ y[i]
        want = [j for j in np.lexsort((np.arange(n), -s)) if j != i][:10]
        assert ids.tolist() == [2 * j for j in want] and scores.tolist() == s[want].tolist()


def test_nearest_recall_copies_and_odd_rows(spark):
    rows, x = odd_vectors(1500, 16)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = by_query(nearest(df, ids_of(df, 20), 20).collect())
    live = [i for i in range(1500) if i != 70]
    want = brute(x[live], live, [i for i in range(0, 1500, 20)], 20, lambda m, q: m @ q)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        assert len(found) == 20 and q not in {i for i, _ in found}
        assert [s for _, s in found] == pytest.approx([float(x[i] @ x[q]) for i, _ in found], abs=1e-12)
        assert found == sorted(found, key=lambda r: (-r[1], r[0]))
    small = spark.createDataFrame(rows[:6], SCHEMA)
    assert [len(v) for v in by_query(nearest(small, ids_of(small, 2), 20).collect()).values()] == [5, 5, 5]
    assert nearest(df.limit(0), ids_of(df, 20), 20).count() == 0


@pytest.mark.parametrize("kind", ["one long vector", "uneven norms", "near copies"])
def test_nearest_recall_whatever_the_norms_and_distances(spark, kind):
    rng = np.random.default_rng(6)
    unit = lambda n: (v := rng.normal(size=(n, 16))) / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(2500)
    if kind == "one long vector":
        x[7] *= 100
    elif kind == "uneven norms":
        x *= np.exp(rng.normal(size=(2500, 1)))
    else:
        x[200:2300] = x[200] + 0.003 * unit(2100)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_query(nearest(df, ids_of(df, 25), 20).collect())
    want = brute(x, list(range(2500)), range(0, 2500, 25), 20, lambda m, q: m @ q)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_rounds_end_when_the_lists_are_still_or_fail(spark, monkeypatch):
    from parley.llm import ann
    monkeypatch.setattr(ann, "STILL", 0)
    monkeypatch.setattr(ann, "TOLD", 1)
    x = np.random.default_rng(8).normal(size=(1500, 16))
    codes, space = ann.coded(spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, vec binary"))
    codes = written(codes, "codes")
    graph = ann.build_graph(codes, space, 8).toPandas()
    assert len(graph) == 1500 and all(set(old) == {1} for old in graph["old"])
    monkeypatch.setattr(ann, "most_rounds", lambda nodes: 2)
    with pytest.raises(RuntimeError, match="still new"):
        ann.build_graph(codes, space, 8)
    beams = [ann.beam_of(n, 20) for n in (10, 10_000, 50_000, 1_000_000)]
    assert beams == sorted(beams) and beams[1] == 192 and beams[2] > 256 and ann.beam_of(10, 300) > 300


def test_a_hop_expands_the_best_of_each_beam():
    from parley.llm.ann import next_out
    old = np.array([0, 1, 0, 0, 1, 1, 0, 0, 0, 0], dtype=bool)
    counts = np.array([4, 0, 2, 4])
    assert next_out(old, counts, 2).tolist() == [True, False, True, False, False, False, True, True, False, False]
    assert next_out(old, counts, 9).tolist() == (~old).tolist() and not next_out(np.zeros(0, bool), np.zeros(0, int), 2).size
