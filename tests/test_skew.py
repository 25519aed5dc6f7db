"""A hot key: one conversation far larger than the rest, split over many range
partitions, must give the same answer as the definition; order values may be
anything."""
from collections import defaultdict

import pytest

from parley.operators import turns as T
from parley.session import table
from tests import replay

HOT_TURNS = 6000


def _hot(spark, sf_dir):
    rows = [(10 ** 9, i, "system" if i == 0 else ("user" if i % 2 else "assistant"),
             " ".join(["w"] * (1 + (i * 7919) % 23))) for i in range(HOT_TURNS)]
    hot = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return table(spark, sf_dir, "conversations").unionByName(hot)


@pytest.mark.parametrize("limit", [120, 700])
def test_hot_conversation_truncate_and_context(spark, sf_dir, limit):
    df = _hot(spark, sf_dir)
    by = defaultdict(list)
    for r in df.collect():
        by[r.conv_id].append((r.turn, r.role, r.text))
    for v in by.values():
        v.sort()
    kept = defaultdict(list)
    for r in T.history_truncate(df, limit, parts=12).collect():
        kept[r.conv_id].append(r.turn)
    ctx = {(r.conv_id, r.turn): (r.first_kept, r.turns_sent, r.words, r.status)
           for r in T.context_at_turn(df, limit, parts=12, position_rows=512).collect()}
    for cid, rows in by.items():
        exp_kept, _ = replay.truncate([(t, x) for t, _, x in rows], limit)
        assert sorted(kept[cid]) == [t for t, _ in exp_kept]
        for turn, v in replay.context_replay(rows, limit).items():
            assert ctx[(cid, turn)] == v


@pytest.mark.parametrize("spread", ["epoch", "random", "dense"])
def test_half_the_rows_in_one_key_with_any_order_values(spark, spread):
    import random

    from pyspark.sql import functions as F

    from parley.plans.ordered import PART, ordered_scan
    r = random.Random(2)
    value = {"epoch": lambda i: 1_700_000_000_000_000 + i * 977, "dense": lambda i: i,
             "random": lambda i: r.randrange(-1 << 62, 1 << 62)}[spread]
    rows = [(0 if i % 2 else 1 + i % 300, value(i), i % 7, "c" if i % 5 == 0 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, o long, n long, c string")
    parts = 10
    got = ordered_scan(df, "k", "o", sums=["n"], firsts=["n"], lasts=["n"], carries=["c"], position="p",
                       group_rows="g", parts=parts)
    by = defaultdict(list)
    for k, o, n, c in sorted(rows):
        by[k].append((o, n, c))
    want = set()
    for k, xs in by.items():
        run, prev = 0, None
        for i, (o, n, c) in enumerate(xs):
            run += n
            want.add((k, o, run, sum(x[1] for x in xs), xs[0][1], xs[-1][1], prev, i, len(xs)))
            prev = c or prev
    assert {(x.k, x.o, x.n_run, x.n_total, x.n_first, x.n_last, x.c_prev, x.p, x.g) for x in got.collect()} == want
    # The hot key lies in several partitions, none far larger than the others.
    ranged = df.repartitionByRange(parts, "k", "o").groupBy(F.spark_partition_id().alias(PART)).count().collect()
    assert max(x["count"] for x in ranged) < 3 * len(rows) / parts
