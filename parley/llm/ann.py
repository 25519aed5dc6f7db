"""Approximate nearest neighbours by largest inner product: NN-descent builds
a neighbour graph through iterative Spark joins, greedy search walks it.

Rows: every distinct vector is one node, named by its smallest id, so copies
cost nothing and cannot fill each other's neighbour lists. A node carries a
code: its vector without loss, as 4-byte floats if all vectors of the table are
such, else as 8-byte ones. The graph is one of nearest neighbours by distance,
after a component that makes all norms equal (which turns largest inner product
among the nodes into nearest neighbour); the search goes by inner product. Both
are computed in double precision.

NN-descent: each node starts with the best of ``START`` random groups of nodes.
A round tells each node's neighbours, in and out, about each other (a join of
neighbours of neighbours by way of their common neighbour), and each node keeps
the best ``degree`` it has heard of. Rounds end when few lists change.

Search: a query has a beam of the best nodes it has seen, at first its own
neighbours and the best of the ``HEAD`` longest vectors, which are few nodes'
neighbours where norms differ much. A hop joins the best quarter beam of the
entries not yet expanded with the adjacency table, scores their neighbours where
they are, and sends back those better than the beam's last; entries that better
ones push out of the beam meanwhile are never expanded. A query ends when no
entry is left to expand.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import written
from parley.llm.vectors import matrix, packed

#: Nodes of a random group at the start, and how many groups a node is in.
GROUP, START = 512, 2
#: A round's joins tell a node at most this many partners by each common neighbour.
TOLD = 6
#: Rounds end when a smaller share of all list entries is new.
STILL = 0.01
#: The longest vectors, which every query is compared with at the start.
HEAD = 4096


def next_out(old: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Of packed beams, best first, the entries that the next hop expands: the
    best ``most`` of each that are not yet expanded."""
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(~old) - ~old  # unexpanded entries before this one, in all beams
    start = np.concatenate([[0], np.cumsum(~old)])[np.cumsum(counts) - counts]
    return ~old & (before - start[owner] < most)


def most_rounds(nodes: int) -> int:
    """No table of so many nodes should need more rounds; one that does fails."""
    return 12 + 2 * nodes.bit_length()


def beam_of(nodes: int, k: int) -> int:
    """The beam grows with the table's size; it holds all that is asked for."""
    return max(2 * k + 8, 192, round(192 * (nodes / 10_000) ** 0.4))


class Space(NamedTuple):
    """The type of the codes' components, and the largest squared norm."""

    dtype: str
    high: float

    def vectors(self, column) -> np.ndarray:
        return matrix(column, self.dtype).astype(np.float64)

    def equal(self, column) -> np.ndarray:
        """The vectors with the component that makes all norms equal."""
        x = self.vectors(column)
        rest = np.sqrt(np.maximum(0, self.high - (x * x).sum(axis=1))) if len(x) else np.zeros(0)
        return np.hstack([x, rest[:, None]])


def _near(x: np.ndarray) -> np.ndarray:
    """Less the squared distances of all rows. (Inner products would do as the
    norms are equal, but lose what sets the rows apart when the norm is large.)
    Rounded, so that equals are equal wherever they are computed."""
    x = x - x.mean(axis=0)
    n = (x * x).sum(axis=1)
    return (2 * (x @ x.T) - n[:, None] - n[None, :]).astype(np.float32).astype(np.float64)


def _sorted_stream(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of rows sorted by ``key``, cut so that no key is in two of them."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        last = pdf[key].iloc[-1]
        if held and held[-1][key].iloc[-1] == last and pdf[key].iloc[0] == last:
            held.append(pdf)
            continue
        n = int(np.searchsorted(pdf[key].to_numpy(), last, "left"))
        out = pd.concat([*held, pdf.iloc[:n]], ignore_index=True)
        if len(out):
            yield out
        held = [pdf.iloc[n:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _best(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, old: np.ndarray, keep: int):
    """Per owner the ``keep`` best distinct ids, best first; an id that is there
    as old stays old. Returns row order arrays (owner, id, sim, old)."""
    o = np.lexsort((~old, ids, owner))
    owner, ids, sims, old = owner[o], ids[o], sims[o], old[o]
    first = np.r_[True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])] if owner.size else np.zeros(0, bool)
    owner, ids, sims, old = owner[first], ids[first], sims[first], old[first]
    o = np.lexsort((ids, -sims, owner))
    owner, ids, sims, old = owner[o], ids[o], sims[o], old[o]
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if owner.size else np.zeros(0, int)
    rank = np.arange(owner.size) - np.repeat(start, np.diff(np.r_[start, owner.size]))
    top = rank < keep
    return owner[top], ids[top], sims[top], old[top]


def _lists(owner, ids, sims, old) -> pd.DataFrame:
    """One row an owner, its lists packed."""
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if owner.size else np.zeros(0, int)
    end = np.r_[start[1:], owner.size]
    cut = lambda x, t: [x[a:b].astype(t).tobytes() for a, b in zip(start, end, strict=True)]
    return pd.DataFrame({"id": owner[start], "ids": cut(ids, "<i8"), "sims": cut(sims, "<f8"), "old": cut(old, "?")})


def _flat(column, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(all items, number of items of each row) of packed lists."""
    size = np.dtype(dtype).itemsize
    counts = np.array([len(x) // size for x in column], dtype=np.int64)
    return np.frombuffer(b"".join(column), dtype=dtype), counts


def release() -> None:
    """Let Spark drop the shuffle files of tables that are no longer used."""
    from pyspark import SparkContext
    gc.collect()
    SparkContext._active_spark_context._jvm.System.gc()


def coded(nodes: DataFrame) -> tuple[DataFrame, Space]:
    """``id, code`` of ``id, vec``, and what is needed to read the codes."""
    def ranges(frames):
        for pdf in frames:
            x = matrix(pdf["vec"])
            if len(x):
                with np.errstate(over="ignore"):
                    exact = bool((x.astype("<f4") == x).all())
                yield pd.DataFrame({"high": [(x * x).sum(axis=1).max()], "exact": [exact]})

    m = nodes.select("vec").mapInPandas(ranges, "high double, exact boolean") \
        .agg(F.max("high").alias("high"), F.min("exact").alias("exact")).first()
    space = Space("<f4" if m["exact"] else "<f8", m["high"] or 0.0)

    def code(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "code": [r.tobytes() for r in matrix(pdf["vec"]).astype(space.dtype)]})

    return nodes.mapInPandas(code, "id long, code binary"), space


def start_lists(codes: DataFrame, space: Space, degree: int) -> DataFrame:
    """``id, ids, sims, old``: each node's best of its random groups."""
    n = codes.count()
    groups = max(1, -(-n // GROUP))

    def within(frames):
        for pdf in _sorted_stream(frames, "grp"):
            ids, x = pdf["id"].to_numpy(), space.equal(pdf["code"])
            for _, at in pdf.groupby("grp").indices.items():
                s = _near(x[at])
                np.fill_diagonal(s, -np.inf)
                k = min(degree, len(at) - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(at), 0), int)
                yield pd.DataFrame({"id": ids[at], "ids": [ids[at][t].astype("<i8").tobytes() for t in top],
                                    "sims": [r[t].astype("<f8").tobytes() for r, t in zip(s, top, strict=True)],
                                    "old": [np.zeros(k, "?").tobytes()] * len(at)})

    rounds = range(START if groups > 1 else 1)
    grouped = codes.select("id", "code", F.explode(F.array(*[
        F.pmod(F.xxhash64(F.lit(r), "id"), F.lit(groups)) + r * groups for r in rounds])).alias("grp"))
    return grouped.repartition("grp").sortWithinPartitions("grp") \
        .mapInPandas(within, "id long, ids binary, sims binary, old binary")


def merged(lists: DataFrame, degree: int) -> DataFrame:
    """Rows of packed lists of an id become one row, its best ``degree``."""
    def merge(frames):
        for pdf in _sorted_stream(frames, "id"):
            ids, counts = _flat(pdf["ids"], "<i8")
            sims, _ = _flat(pdf["sims"], "<f8")
            old, _ = _flat(pdf["old"], "?")
            owner = np.repeat(pdf["id"].to_numpy(), counts)
            own = ids != owner
            out = _lists(*_best(owner[own], ids[own], sims[own], old[own], degree))
            alone = np.setdiff1d(pdf["id"].to_numpy(), out["id"].to_numpy())  # without any neighbour
            yield out
            yield pd.DataFrame({"id": alone, "ids": [b""] * len(alone), "sims": [b""] * len(alone),
                                "old": [b""] * len(alone)})

    return lists.repartition("id").sortWithinPartitions("id") \
        .mapInPandas(merge, "id long, ids binary, sims binary, old binary")


def around(graph: DataFrame, codes: DataFrame, degree: int) -> DataFrame:
    """``center, id, old, code, last``: each node with its neighbours, in and
    out, up to twice ``degree`` of them (outgoing first, then by hash), their
    codes, and the similarity of the worst neighbour they have so far."""
    def edges(frames):
        for pdf in frames:
            ids, counts = _flat(pdf["ids"], "<i8")
            old, _ = _flat(pdf["old"], "?")
            owner = np.repeat(pdf["id"].to_numpy(), counts)
            yield pd.DataFrame({"center": np.r_[owner, ids], "id": np.r_[ids, owner], "old": np.r_[old, old],
                                "back": np.r_[np.zeros(ids.size, bool), np.ones(ids.size, bool)]})

    def last(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "last": [
                float(np.frombuffer(s, "<f8")[-1]) if len(s) >= 8 * degree else float("-inf") for s in pdf["sims"]]})

    near = Window.partitionBy("center").orderBy("back", F.xxhash64("center", "id"))
    e = graph.mapInPandas(edges, "center long, id long, old boolean, back boolean").repartition("center") \
        .groupBy("center", "id").agg(F.min("old").alias("old"), F.min("back").alias("back"))
    e = e.withColumn("n", F.row_number().over(near)).where(F.col("n") <= 2 * degree).drop("n", "back")
    return e.join(codes, "id").join(graph.mapInPandas(last, "id long, last double"), "id")


def descend(graph: DataFrame, codes: DataFrame, space: Space, degree: int) -> DataFrame:
    """One round of NN-descent."""
    def tell(frames):
        for pdf in _sorted_stream(frames, "center"):
            ids, x = pdf["id"].to_numpy(), space.equal(pdf["code"])
            fresh, last = ~pdf["old"].to_numpy(dtype=bool), pdf["last"].to_numpy()
            center = pdf["center"].to_numpy()
            start = np.flatnonzero(np.r_[True, center[1:] != center[:-1]])
            who, ids_out, sims_out = [], [], []
            for a, b in zip(start, np.r_[start[1:], len(pdf)], strict=True):
                k = min(TOLD, b - a - 1)
                if k < 1 or not fresh[a:b].any():
                    continue
                s = _near(x[a:b])
                s[~(fresh[a:b][:, None] | fresh[a:b][None, :])] = -np.inf
                s[ids[a:b][:, None] == ids[a:b][None, :]] = -np.inf
                s[s <= last[a:b][:, None]] = -np.inf
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(s, top, axis=1)
                for i in np.flatnonzero(best.max(axis=1) > -np.inf):
                    ok = best[i] > -np.inf
                    who.append(ids[a + i])
                    ids_out.append(ids[a:b][top[i][ok]].astype("<i8").tobytes())
                    sims_out.append(best[i][ok].astype("<f8").tobytes())
            yield pd.DataFrame({"id": np.array(who, dtype=np.int64), "ids": ids_out, "sims": sims_out,
                                "old": [bytes(len(s) // 8) for s in sims_out]})

    told = around(graph, codes, degree).repartition("center").sortWithinPartitions("center") \
        .mapInPandas(tell, "id long, ids binary, sims binary, old binary")

    def aged(frames):
        for pdf in frames:
            yield pdf.assign(old=[b"\x01" * len(o) for o in pdf["old"]])

    return merged(graph.mapInPandas(aged, graph.schema).unionAll(told), degree)


def build_graph(codes: DataFrame, space: Space, degree: int = 32) -> DataFrame:
    """``id, ids, sims, old``: the neighbour lists of NN-descent."""
    graph = written(merged(start_lists(codes, space, degree), degree), "ann-graph")
    rounds = most_rounds(codes.count())
    for _ in range(rounds):
        graph = written(descend(graph, codes, space, degree), "ann-graph")
        release()
        fresh = graph.agg(F.sum(F.length(F.regexp_replace(F.hex("old"), "01", "")) / 2).alias("new"),
                          F.sum(F.length("old")).alias("all")).first()
        if not fresh["all"] or fresh["new"] <= STILL * fresh["all"]:
            return graph
    raise RuntimeError(f"after {rounds} rounds {fresh['new']:.0f} of {fresh['all']} neighbours are still new")


def adjacency(graph: DataFrame, codes: DataFrame, degree: int) -> DataFrame:
    """``node, near, codes``: the neighbours of a node, in and out, with their
    codes; dealt by node."""
    return around(graph, codes, degree).select("center", "id", "code").repartition("center") \
        .groupBy("center").agg(F.collect_list(F.struct("id", "code")).alias("all")) \
        .select(F.col("center").alias("node"), F.col("all.id").alias("near"), F.col("all.code").alias("codes"))


def longest(codes: DataFrame, space: Space) -> tuple[np.ndarray, list[bytes]]:
    """Ids and codes of the ``HEAD`` longest vectors."""
    def norms(frames):
        for pdf in frames:
            x = space.vectors(pdf["code"])
            yield pdf.assign(n=(x * x).sum(axis=1) if len(x) else [])

    rows = codes.mapInPandas(norms, "id long, code binary, n double").orderBy(F.desc("n"), "id").limit(HEAD).collect()
    return np.array([r["id"] for r in rows], dtype=np.int64), [bytes(r["code"]) for r in rows]


def graph_search(queries: DataFrame, graph: DataFrame, codes: DataFrame, space: Space, degree: int,
                 beam: int) -> DataFrame:
    """``id, ids, sims, old``: for each query node its beam, best first."""
    near = adjacency(graph, codes, degree).persist(StorageLevel.DISK_ONLY)
    q = written(queries.join(codes, "id").select("id", "code"), "ann-queries")
    head_ids, head_codes = longest(codes, space)

    def heads(frames):
        y = space.vectors(head_codes)
        for pdf in frames:
            x, rows = space.vectors(pdf["code"]), []
            for i, own in enumerate(pdf["id"]):
                s = (y * x[i]).sum(axis=1)
                s[head_ids == own] = -np.inf
                top = np.argsort(-s, kind="stable")[:degree]
                top = top[s[top] > -np.inf]
                rows.append((own, head_ids[top].tobytes(), s[top].tobytes(), bytes(len(top))))
            yield pd.DataFrame(rows, columns=["id", "ids", "sims", "old"])

    # A query starts with its own node and the best of the longest, all unexpanded.
    beams = q.select("id", F.col("id").alias("node"), F.lit(float("-inf")).alias("last"))
    state = written(q.mapInPandas(heads, "id long, ids binary, sims binary, old binary"), "ann-beams")

    most = max(1, beam // 4)

    def frontier(frames):
        for pdf in frames:
            ids, counts = _flat(pdf["ids"], "<i8")
            old, _ = _flat(pdf["old"], "?")
            last = [float(np.frombuffer(s, "<f8")[-1]) if len(s) >= 8 * beam else float("-inf") for s in pdf["sims"]]
            new = next_out(old, counts, most)
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), counts)[new], "node": ids[new],
                                "last": np.repeat(np.array(last, dtype=np.float64), counts)[new]})

    def expand(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            x = space.vectors(pdf["code"])
            rows = []
            for i, (ids, codes_, last) in enumerate(zip(pdf["near"], pdf["codes"], pdf["last"], strict=True)):
                ids = np.asarray(ids, dtype="<i8")
                s = (space.vectors(codes_) * x[i]).sum(axis=1)
                ok = s >= last  # of equals, the smaller id
                rows.append((ids[ok].tobytes(), s[ok].tobytes(), bytes(int(ok.sum()))))
            yield pd.DataFrame(rows, columns=["ids", "sims", "old"]).assign(id=pdf["id"])[["id", "ids", "sims", "old"]]

    def aged(frames):
        for pdf in frames:
            old, counts = _flat(pdf["old"], "?")
            told = old | next_out(old, counts, most)
            ends = np.cumsum(counts)
            yield pdf.assign(old=[told[e - n:e].tobytes() for n, e in zip(counts, ends, strict=True)])

    schema = "id long, ids binary, sims binary, old binary"
    beams = beams.unionAll(state.mapInPandas(frontier, "id long, node long, last double"))
    while True:
        seen = beams.join(q, "id").join(near, "node").select("id", "code", "near", "codes", "last") \
            .mapInPandas(expand, schema)
        state = written(merged(state.mapInPandas(aged, schema).unionAll(seen), beam), "ann-beams")
        beams = state.mapInPandas(frontier, "id long, node long, last double")
        release()
        if beams.isEmpty():
            break
    near.unpersist()
    return state


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
            degree: int = 32, beam: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query id (``queries.id``) the
    ``k`` nearest other ids found, all of them where there are no more.

    Score: the inner product of the original vectors in double precision; ties
    go to the smaller id. ``beam``: by the table's size if not given. Null, zero, ragged and non-finite vectors and null ids
    take no part, neither as queries nor as candidates; see ``packed``. Other
    columns are not read. An empty table gives no rows.
    """
    rows = written(packed(vectors, id_col, vector_col).where(~F.hex("vec").rlike("^([08]0{15})*$")), "ann-vectors")
    nodes = written(rows.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"), "ann-nodes")
    member = written(rows.join(nodes.withColumnRenamed("id", "node"), "vec").select("node", "id"), "ann-members")
    asked = written(member.join(queries.select("id").distinct(), "id").select("node", F.col("id").alias("query_id")),
                    "ann-asked")
    coded_, space = coded(nodes)
    codes = written(coded_, "ann-codes")
    graph = build_graph(codes, space, degree)
    beam = beam or beam_of(codes.count(), k)
    found = graph_search(asked.select(F.col("node").alias("id")).distinct(), graph, codes, space, degree, beam)

    def candidates(frames):  # and the query's own node, for its copies
        for pdf in frames:
            ids, counts = _flat(pdf["ids"], "<i8")
            rank = np.arange(ids.size) - np.repeat(np.cumsum(counts) - counts, counts)
            top = rank < 2 * k + 8  # in the order of their scores
            at = pdf["id"].to_numpy()
            yield pd.DataFrame({"id": np.r_[np.repeat(at, counts)[top], at], "node": np.r_[ids[top], at]})

    pairs = found.mapInPandas(candidates, "id long, node long").distinct()
    a = nodes.select(F.col("id"), F.col("vec").alias("x"))
    b = nodes.select(F.col("id").alias("node"), F.col("vec").alias("y"))

    def score(frames):
        for pdf in frames:
            s = (matrix(pdf["x"]) * matrix(pdf["y"])).sum(axis=1) if len(pdf) else []
            yield pd.DataFrame({"id": pdf["id"], "node": pdf["node"], "score": s})

    scored = pairs.join(a, "id").join(b, "node").mapInPandas(score, "id long, node long, score double")
    # k + 1 of a node's copies are enough for any query, its own among them.
    few = member.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("id"))) \
        .where(F.col("n") <= k + 1).select("node", F.col("id").alias("vec_id"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return asked.withColumnRenamed("node", "id").join(scored, "id").join(few, "node") \
        .where("vec_id <> query_id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
