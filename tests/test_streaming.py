"""Stream = batch: the same table fed as ordered micro-batches gives the
batch operator's answer."""
import time
import uuid

import pytest
from pyspark.sql import functions as F

from parley.operators import completions as C
from parley.operators import prompts as P
from parley.operators import turns as T
from parley.session import scratch_path, table
from parley.streaming import stateful as S


def _files(spark, df, bounds, col):
    """Write ``df`` as one parquet file per range of ``col`` (in order)."""
    src = scratch_path(spark, "stream-src")
    lo = None
    for hi in bounds + [None]:
        part = df
        if lo is not None:
            part = part.where(F.col(col) >= lo)
        if hi is not None:
            part = part.where(F.col(col) < hi)
        part.coalesce(1).write.mode("append").parquet(src)
        lo = hi
    return src


@pytest.fixture(autouse=True)
def rocksdb(spark):
    """Typed state needs this state store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def _run(spark, sdf, mode="append"):
    name = "q" + uuid.uuid4().hex[:8]
    q = (sdf.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", scratch_path(spark, "stream-ckpt")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_stream_context_at_turn_equals_batch(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    src = _files(spark, conv, [2, 4], "turn")
    stream = spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", 1).parquet(src)
    for limit in (60, 200):
        got = _run(spark, S.stream_context_at_turn(stream, limit))
        exp = T.context_at_turn(conv, limit).collect()
        g = {(r.conv_id, r.turn): (r.first_kept, r.turns_sent, r.words, r.status)
             for r in got.collect()}
        assert not any(r.late for r in got.collect())
        assert g == {(r.conv_id, r.turn): (r.first_kept, r.turns_sent, r.words, r.status)
                     for r in exp}


def test_stream_context_column_limit(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").withColumn(
        "lim", F.when(F.col("conv_id") % 2 == 0, 60).otherwise(300))
    src = _files(spark, conv, [2, 4], "turn")
    stream = spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = _run(spark, S.stream_context_at_turn(stream, F.col("lim")))
    exp = T.context_at_turn(conv, F.col("lim"))
    assert {(r.conv_id, r.turn): (r.first_kept, r.words, r.status) for r in got.collect()} == \
        {(r.conv_id, r.turn): (r.first_kept, r.words, r.status) for r in exp.collect()}


def test_stream_prompt_kind_equals_batch(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    src = _files(spark, ev, [3000, 7000], "event_id")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = _run(spark, S.stream_prompt_kind(stream, session="user_id", seq="event_id",
                                           state=("event_type",),
                                           answered=F.col("event_type") != "error"))
    exp = P.prompt_kind(ev, session="user_id", order=("event_id",), state=("event_type",),
                        answered=F.col("event_type") != "error")
    assert {(r.session, r.event_id): r.prompt_kind for r in got.collect()} == \
        {(r.user_id, r.event_id): r.prompt_kind for r in exp.collect()}


def test_stream_late_rows_flagged(spark):
    df = spark.createDataFrame([(1, 1, "a", True), (1, 2, "a", True)],
                               "session_id long, seq long, state string, answered boolean")
    late = spark.createDataFrame([(1, 1, "b", True)], df.schema)
    src = scratch_path(spark, "stream-src")
    df.coalesce(1).write.parquet(src)
    late.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    rows = sorted(((r.seq, r.prompt_kind, r.late) for r in
                   _run(spark, S.stream_prompt_kind(stream)).collect()), key=lambda r: (r[0], not r[2]))
    assert rows == [(1, None, True), (1, "contextful", False), (2, "contextless", False)]


def test_stream_latest_nonempty_update_mode(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("props"))
        .otherwise("").alias("v"))
    src = _files(spark, ev, [5000], "event_id")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = _run(spark, S.stream_latest_nonempty(stream, "v", key="user_id",
                                               order=("event_id",)), mode="update")
    # update mode emits a row per changed key per batch: keep the newest
    final = {}
    for r in got.collect():
        final[r.user_id] = r.latest if r.latest is not None else final.get(r.user_id)
    exp = {r.user_id: r.latest for r in
           C.latest_nonempty(ev, "v", key="user_id", order=("event_id",)).collect()}
    assert final == exp


def test_stream_log_roundtrip_and_notebooks(spark):
    from parley.sources import logtext as LT
    from parley.sources import notebooks as NB
    rows = [(f"2024-01-01 10:00:{i:02d}", "ERROR" if i % 2 else "INFO",
             f"m{i}" + ("\n2024-01-01 00:00:00,000 [INFO]: fake\n  t" if i % 2 else ""))
            for i in range(40)]
    df = spark.createDataFrame(rows, "ts string, level string, message string") \
        .withColumn("ts", F.to_timestamp_ntz("ts"))
    src = scratch_path(spark, "stream-in")
    df.coalesce(1).write.parquet(src)
    logs = scratch_path(spark, "stream-logs")
    q = LT.stream_log_write(spark.readStream.schema(df.schema).parquet(src), logs,
                            scratch_path(spark, "stream-ckpt"))
    q.processAllAvailable()
    q.stop()
    got = _run(spark, LT.stream_log_records(spark, logs))
    assert sorted((r.ts, r.level, r.message) for r in got.collect()) == \
        sorted((r.ts, r.level, r.message) for r in df.collect())
    # notebooks: the batch function on a file stream
    nb_dir = scratch_path(spark, "stream-nb")
    spark.createDataFrame([('{"metadata": {}, "cells": [{"cell_type": "code", '
                            '"source": ["x = 1"]}]}',)], "value string") \
        .coalesce(1).write.text(nb_dir)
    nbs = spark.readStream.schema(NB.NOTEBOOK).json(nb_dir)
    assert [r.text for r in _run(spark, NB.notebook_text(nbs).select("text")).collect()] == \
        ["\n```\nx = 1\n```\n"]


def test_stream_settings_upsert_and_enrich(spark):
    from parley.operators import logs as L
    from parley.operators import settings as SET
    ch = spark.createDataFrame(
        [("u", "model_name", "gpt-4", 1), ("u", "openai_api_key", "sk-1", 2),
         ("u", "model_name", None, 3), ("v", "model_name", "gpt-4o", 4)],
        "owner string, key string, value string, seq long")
    src = _files(spark, ch, [3], "seq")
    stream = spark.readStream.schema(ch.schema).option("maxFilesPerTrigger", 1).parquet(src)
    final = {}
    for r in _run(spark, S.stream_settings_upsert(stream), mode="update").collect():
        final[(r.owner, r.key)] = r.value  # later updates overwrite
    live = {k: v for k, v in final.items() if v is not None}
    assert live == {(r.owner, r.key): r.value for r in SET.settings_upsert(None, ch).collect()}
    assert final[("u", "model_name")] is None  # the deletion surfaced
    # error enrichment as a stream-static join
    recs = spark.createDataFrame([(1, "s1", "ERROR", "boom"), (2, "s1", "INFO", "ok")],
                                 "id int, session_id string, level string, message string")
    ex = spark.createDataFrame([("s1", "EXPLAINED", "fix()")],
                               "session_id string, completion string, code string")
    rsrc = scratch_path(spark, "stream-src")
    recs.write.parquet(rsrc)
    got = _run(spark, L.error_enrich(spark.readStream.schema(recs.schema).parquet(rsrc), ex))
    assert {r.id: r.message for r in got.collect()} == \
        {r.id: r.message for r in L.error_enrich(recs, ex).collect()}


def test_stream_revision_diff_equals_batch(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    src = _files(spark, conv, [2, 4], "turn")
    stream = spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = _run(spark, S.stream_revision_diff(stream, doc="conv_id", version="turn"))
    exp = C.revision_diff(conv, doc="conv_id", version="turn")
    assert {(r.conv_id, r.turn): (r.lines_added, r.lines_removed) for r in got.collect()} == \
        {(r.conv_id, r.turn): (r.lines_added, r.lines_removed) for r in exp.collect()}


def test_stream_context_state_is_bounded_and_late_turns_are_told(spark):
    """A long stretch of answers only, then a question, then late turns."""
    schema = "conv_id long, turn long, role string, text string"
    parts = [[(1, 0, "system", "s")] + [(1, i, "assistant", "w w w") for i in range(1, 200)],
             [(1, 200 + i, "assistant", "w") for i in range(100)], [(1, 400, "user", "q q")],
             [(1, 50, "user", "late"), (1, 401, "user", "on time")]]
    src = scratch_path(spark, "stream-src")
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r.turn: r for r in _run(spark, S.stream_context_at_turn(stream, 30)).collect()}
    on_time = spark.createDataFrame([r for p in parts for r in p if r[1] != 50], schema)
    want = {r.turn: r for r in T.context_at_turn(on_time, 30).collect()}
    for t in (400, 401):
        assert (got[t].first_kept, got[t].turns_sent, got[t].words, got[t].late) == \
            (want[t].first_kept, want[t].turns_sent, want[t].words, False)
    assert got[50].late and got[50].words is None


def test_stream_revision_diff_late_versions(spark):
    schema = "doc_id long, version long, text string"
    src = scratch_path(spark, "stream-src")
    for rows in ([(1, 2, "a\nb")], [(1, 1, "late"), (1, 3, "a\nc\nc")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r.version: (r.lines_added, r.lines_removed, r.late) for r in _run(spark, S.stream_revision_diff(stream)).collect()}
    assert got == {2: (2, 0, False), 1: (None, None, True), 3: (2, 1, False)}


def test_row_wise_operators_on_a_stream(spark):
    from parley.operators import logs as L
    df = spark.createDataFrame([(1, "why?\n```\nfix()\n```", 'duck()\ntoken = "sk-12345"')],
                               "id long, completion string, code string")
    src = scratch_path(spark, "stream-src")
    df.write.parquet(src)
    read = lambda: spark.readStream.schema(df.schema).parquet(src)
    for op in (lambda d: C.extract_code_blocks(d, keys=("id",)), lambda d: C.parse_completion(d).drop("extra"),
               lambda d: L.route_turns(d, "completion"), lambda d: L.strip_lines(d, "code", out="kept"),
               lambda d: L.redact_secrets(d, "code", 'token = "([^"]+)"', 1, keys=("id",))):
        assert _run(spark, op(read())).collect() == op(df).collect() != []


def test_a_million_rows_of_one_key_in_a_batch(spark):
    """Questions, turns and versions of one key, in any order, in one batch;
    then a second batch that goes on from the state."""
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit("hot").alias("session_id"), F.col("id").alias("seq"), (F.col("id") % 7 < 4).alias("answered"),
        F.concat(F.lit("s"), F.floor(F.col("id") / 3)).alias("state"))
    src = scratch_path(spark, "stream-src")
    rows.where(F.col("seq") < n - 10).orderBy(F.xxhash64("seq")).coalesce(1).write.parquet(src)
    rows.where(F.col("seq") >= n - 10).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = _run(spark, S.stream_prompt_kind(stream))
    assert got.count() == n and not got.where("late").count()
    # By hand: the same state as the last answered question before it?
    state = lambda i: i // 3
    want, last = 0, None
    for i in range(n):
        want += last is not None and state(i) == state(last)
        last = i if i % 7 < 4 else last
    assert got.where("prompt_kind = 'contextless'").count() == want
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 5 == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("w w").alias("text"))
    src = scratch_path(spark, "stream-src")
    turns.orderBy(F.xxhash64("turn")).coalesce(1).write.parquet(src)
    got = _run(spark, S.stream_context_at_turn(spark.readStream.schema(turns.schema).parquet(src), 303))
    assert got.count() == n // 5
    # Each turn has three words: the pinned one and 100 more fit.
    assert got.where("turn >= 100 and first_kept = turn - 99 and words = 303 and status = 'ok'").count() == n // 5 - 20


def test_orders_of_several_columns_and_times(spark):
    rows = [("a", "2024-01-01 00:00:00.000001", "x", "s", True), ("a", "2024-01-01 00:00:00.000001", "y", "s", False),
            ("a", "2024-01-01 00:00:00.000002", "a", "t", True), ("b", "1969-12-31 23:59:59.999999", "", None, True)]
    later = [("a", "2024-01-01 00:00:00.000002", "b", "t", True), ("a", "2024-01-01 00:00:00.000001", "z", "t", True),
             ("b", "1970-01-01 00:00:00", "", None, None), ("b", "1970-01-01 00:00:00", "", "late twin", None)]
    schema = "session_id string, at string, part string, state string, answered boolean"
    for kind in ("timestamp", "timestamp_ntz"):
        src = scratch_path(spark, "stream-src")
        for batch in (rows, later):
            df = spark.createDataFrame(batch, schema).withColumn("at", F.col("at").cast(kind))
            df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        got = {(r.session, str(r.at), r.part, r.late): r.prompt_kind
               for r in _run(spark, S.stream_prompt_kind(stream, seq=("at", "part"))).collect()}
        assert got == {("a", "2024-01-01 00:00:00.000001", "x", False): "contextful",
                       ("a", "2024-01-01 00:00:00.000001", "y", False): "contextless",
                       ("a", "2024-01-01 00:00:00.000002", "a", False): "contextful",
                       ("a", "2024-01-01 00:00:00.000002", "b", False): "contextless",
                       ("a", "2024-01-01 00:00:00.000001", "z", True): None,
                       ("b", "1969-12-31 23:59:59.999999", "", False): "contextful",
                       ("b", "1970-01-01 00:00:00", "", False): "contextless",
                       ("b", "1970-01-01 00:00:00", "", True): None}


def _in_steps(spark, schema, steps, make, wait_s):
    """The rows of each step as a file, a pause after each. With timers Spark
    runs batches all the time, so what is waited for is one result a step."""
    src, name = scratch_path(spark, "stream-src"), "q" + uuid.uuid4().hex[:8]
    spark.createDataFrame(steps[0], schema).coalesce(1).write.parquet(src)
    q = (make(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName(name)
         .trigger(processingTime="200 milliseconds").option("checkpointLocation", scratch_path(spark, "stream-ckpt")).start())

    def told(n):
        until = time.time() + 60
        while spark.table(name).count() < n and q.isActive and time.time() < until:
            time.sleep(0.1)
        assert spark.table(name).count() == n

    try:
        told(1)
        for i, rows in enumerate(steps[1:], 2):
            time.sleep(wait_s)
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            told(i)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_idle_state_is_dropped(spark):
    """After the pause a session, a conversation and a document start anew;
    rows of another key in between don't keep them."""
    rows = _in_steps(spark, "session_id string, seq long, state string, answered boolean",
                     [[("a", 1, "s", True)], [("b", 1, "s", True)], [("a", 2, "s", True)]],
                     lambda df: S.stream_prompt_kind(df, idle_timeout_ms=1500), 1.2)
    assert {(r.session, r.seq): r.prompt_kind for r in rows} == {("a", 1): "contextful", ("b", 1): "contextful", ("a", 2): "contextful"}
    rows = _in_steps(spark, "conv_id long, turn long, role string, text string",
                     [[(1, 0, "system", "x y"), (1, 1, "user", "z")], [(2, 0, "user", "w")], [(1, 2, "user", "v")]],
                     lambda df: S.stream_context_at_turn(df, 100, idle_timeout_ms=1500), 1.5)
    assert {(r.conv_id, r.turn): r.words for r in rows} == {(1, 1): 5, (2, 0): 2, (1, 2): 2}
    rows = _in_steps(spark, "doc_id long, version long, text string",
                     [[(1, 1, "a\nb")], [(2, 1, "a")], [(1, 2, "a\nb")]],
                     lambda df: S.stream_revision_diff(df, idle_timeout_ms=1500), 1.5)
    assert {(r.doc_id, r.version): (r.lines_added, r.lines_removed) for r in rows} == {(1, 1): (2, 0), (2, 1): (1, 0), (1, 2): (2, 0)}


def test_a_version_writes_only_the_lines_it_changed(spark):
    """10,000 lines; each later version changes two. Counts go on from the state."""
    lines = [f"line {i}" for i in range(10_000)]
    versions = [(1, 0, "\n".join(lines))]
    for v in range(1, 5):
        lines[v], lines[-v] = f"new {v}", "line 7"
        versions.append((1, v, "\n".join(lines)))
    schema = "doc_id long, version long, text string"
    src, name = scratch_path(spark, "stream-src"), "q" + uuid.uuid4().hex[:8]
    for row in versions:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
    q = (S.stream_revision_diff(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
         .writeStream.format("memory").queryName(name).option("checkpointLocation", scratch_path(spark, "stream-ckpt")).start())
    try:
        q.processAllAvailable()
        updated = [sum(o["numRowsUpdated"] for o in p["stateOperators"]) for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()
    got = {r.version: (r.lines_added, r.lines_removed) for r in spark.table(name).collect()}
    assert got == {0: (10_000, 0), **{v: (2, 2) for v in range(1, 5)}}
    assert updated[0] >= 10_000 and max(updated[1:]) < 10
