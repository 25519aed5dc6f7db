from collections import defaultdict

import pytest

from parley.operators import turns as T
from parley.session import table
from tests import replay


def _convs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append((r.turn, r.role, r.text))
    for v in by.values():
        v.sort()
    return by


def _fixture(spark):
    # edge rows: one-row conversation, two rows over the limit, empty text,
    # oversize middle turn, NULL text
    rows = [(1, 0, "system", "a b c"), (1, 1, "user", "x " * 30),
            (1, 2, "assistant", "y " * 5), (1, 3, "user", "z " * 3),
            (2, 0, "user", "only row " * 10),
            (3, 0, "system", "s " * 8), (3, 1, "user", "u " * 9),
            (4, 0, "user", ""), (4, 1, "assistant", None), (4, 2, "user", "q"),
            (5, 0, "system", "p"), (5, 3, "user", "a a"), (5, 9, "assistant", "b " * 40),
            (5, 10, "user", "c c c"), (5, 14, "assistant", "d"), (5, 20, "user", "e e")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("limit,chunk", [(15, 2), (25, 3), (60, 5)])
def test_truncate_fixture_vs_replay(spark, limit, chunk):
    df = _fixture(spark)
    got = T.history_truncate(df, limit, parts=chunk).collect()
    by = defaultdict(list)
    for r in df.collect():
        by[r.conv_id].append((r.turn, r.text))
    for v in by.values():
        v.sort()
    exp = {}
    for cid, hist in by.items():
        kept, over = replay.truncate(hist, limit)
        exp[cid] = ([t for t, _ in kept], "overflow" if over else "ok")
    res = defaultdict(list)
    status = {}
    for r in got:
        res[r.conv_id].append(r.turn)
        status[r.conv_id] = r.status
    assert {c: (sorted(v), status[c]) for c, v in res.items()} == exp


@pytest.mark.parametrize("limit,chunk", [(60, 2), (200, 3), (400, 5), (1000, 5)])
def test_truncate_sf_vs_replay(spark, sf_dir, limit, chunk):
    convs = _convs(spark, sf_dir)
    got = T.history_truncate(table(spark, sf_dir, "conversations"), limit,
                             parts=chunk).collect()
    res = defaultdict(list)
    for r in got:
        res[r.conv_id].append(r.turn)
    for cid, rows in convs.items():
        kept, _ = replay.truncate([(t, x) for t, _, x in rows], limit)
        assert sorted(res[cid]) == [t for t, _ in kept], cid


@pytest.mark.parametrize("limit,chunk", [(12, 2), (20, 1), (60, 3), (200, 5), (400, 4)])
def test_context_at_turn_vs_replay(spark, sf_dir, limit, chunk):
    cases = [(_fixture(spark), None), (table(spark, sf_dir, "conversations"), None)]
    for df, _ in cases:
        by = defaultdict(list)
        for r in df.collect():
            by[r.conv_id].append((r.turn, r.role, r.text))
        exp = {}
        for cid, rows in by.items():
            rows.sort()
            for turn, v in replay.context_replay(rows, limit).items():
                exp[(cid, turn)] = v
        got = {(r.conv_id, r.turn): (r.first_kept, r.turns_sent, r.words, r.status)
               for r in T.context_at_turn(df, limit, parts=chunk, position_rows=chunk).collect()}
        assert got == exp


def test_model_limits(spark):
    df = spark.createDataFrame([("gpt-4",), ("gpt-3.5-turbo",), ("nope",), (None,)],
                               "model string")
    got = {r.model: (r.context_window, r.hard_limit, r.soft_limit) for r in
           T.model_limits(df, T.models_table(spark), max_tokens=512).collect()}
    assert got == {"gpt-4": (8192, 6144, 5760), "gpt-3.5-turbo": (16385, 12288, 11904),
                   "nope": (8192, 6144, 5760), None: (8192, 6144, 5760)}


def test_repeated_model_names_do_not_multiply_rows(spark):
    df = spark.createDataFrame([("m",), ("m",)], "model string")
    got = T.model_limits(df, T.models_table(spark, [("m", 90), ("m", 70)])).collect()
    assert [r.context_window for r in got] == [70, 70]


def test_each_turn_has_its_own_limit(spark):
    """A limit column larger than any chunk, and other for each turn."""
    rows = [(1, i, "system" if i == 0 else "user", "w " * 5, 1000 if i % 2 else 20) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, lim long")
    from pyspark.sql import functions as F
    got = {r.turn: (r.first_kept, r.words) for r in
           T.context_at_turn(df, F.col("lim"), parts=5, position_rows=2).collect()}
    assert got[39] == (1, 240) and got[38] == (37, 18)


def test_history_render_truncated(spark):
    df = _fixture(spark).where("conv_id = 1")
    got = T.history_render(df, limit=15).first().history
    kept, _ = replay.truncate([(r.turn, r.text) for r in df.orderBy("turn").collect()], 15)
    assert got.count("\n\n") == len(kept) - 1 and got.startswith("System: a b c")


def test_history_render(spark):
    df = _fixture(spark).where("conv_id in (1, 4)")
    got = {r.conv_id: r.history for r in T.history_render(df).collect()}
    assert got[4] == "Human: \n\nAI: \n\nHuman: q"
    assert got[1].startswith("System: a b c\n\nHuman: x")


def test_context_at_turn_column_limit(spark, sf_dir):
    from pyspark.sql import functions as F
    df = table(spark, sf_dir, "conversations")
    lim = {0: 60, 1: 200, 2: 400}
    with_lim = df.withColumn("lim", F.when(F.col("conv_id") % 3 == 0, 60)
                             .when(F.col("conv_id") % 3 == 1, 200).otherwise(400))
    got = {(r.conv_id, r.turn): (r.first_kept, r.turns_sent, r.words, r.status)
           for r in T.context_at_turn(with_lim, F.col("lim"), parts=4,
                                      position_rows=3).collect()}
    by = defaultdict(list)
    for r in df.collect():
        by[r.conv_id].append((r.turn, r.role, r.text))
    for cid, rows in by.items():
        rows.sort()
        for turn, v in replay.context_replay(rows, lim[cid % 3]).items():
            assert got[(cid, turn)] == v


def test_truncation_keeps_conversations_without_a_key(spark):
    rows = [(None, 0, "system", "a"), (None, 1, "user", "b c"), (None, 2, "user", "d"), (1, 0, "user", "x"), (1, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id or -1, r.turn, r.text, r.n_words, r.status) for r in T.history_truncate(df, 4).collect()))
    assert got == [(-1, 0, "a", 2, "ok"), (-1, 2, "d", 2, "ok"), (1, 0, "x", 2, "ok"), (1, 1, "y", 2, "ok")]
