"""Logs that grow while they are streamed."""
import os
import random

import pytest
from pyspark.sql import functions as F

from parley.session import scratch_path
from parley.sources import logstream as G
from parley.sources import logtext as LT


def _drained(spark, path, out, ckpt, **options):
    q = (G.stream_growing_log(spark, path, **options).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def _folder(spark, name):
    path = scratch_path(spark, name).removeprefix("file:")
    os.makedirs(path)
    return path


def _some_log(seed, records=120):
    r = random.Random(seed)
    out = ["no record yet\n", "\n", "2024-01-01 [INFO]: nor this\n"] if seed % 2 else []
    for i in range(records):
        out.append(f"2024-01-01 10:{i // 60:02d}:{i % 60:02d},{i % 1000:03d} [{r.choice(['INFO', 'ERROR', '', 'Level 15'])}]: m{i} é\n")
        out += [r.choice(["  at x\n", "\n", " 2024-01-01 00:00:00,000 [INFO]: fake\n", "long " * 300 + "\n", "cr\r\n"])
                for _ in range(r.randrange(4))]
    return "".join(out).encode()


def _rows(df):
    return [(os.path.basename(r.file), r.ts, r.level or "", r.message) for r in df.collect()]


def _key(row):
    return tuple("" if x is None else str(x) for x in row)


def test_a_log_that_grows_equals_the_batch_reader(spark):
    """Cut anywhere, also inside a record, a line and a character."""
    path, out, ckpt = _folder(spark, "grow"), scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    logs = {f"{i}.log": _some_log(i) for i in range(3)}
    r = random.Random(7)
    cuts = {name: sorted(r.sample(range(1, len(data)), 4)) + [len(data)] for name, data in logs.items()}
    for step in range(5):
        for name, data in logs.items():
            with open(f"{path}/{name}", "ab") as f:
                f.write(data[cuts[name][step - 1] if step else 0:cuts[name][step]])
        _drained(spark, path, out, ckpt, partition_bytes=700)  # each step is a restart from the checkpoint
        got = spark.read.parquet(out)
        told = got.groupBy("file").agg(F.max("start").alias("s")).collect()
        assert all(t.s < cuts[os.path.basename(t.file)][step] for t in told)
    assert spark.read.parquet(out).where("level is not null or ts is not null").count() == 3 * 120 - 3
    _drained(spark, path, out, ckpt, drain=True, partition_bytes=700)
    got, want = spark.read.parquet(out), LT.log_records(spark, path)
    assert sorted(map(_key, _rows(got))) == sorted(map(_key, _rows(want)))
    by_start = sorted((os.path.basename(x.file), x.start, x.message) for x in got.where("ts is not null").collect())
    by_rec = sorted((os.path.basename(x.file), x.rec, x.message) for x in want.where("rec > 0").collect())
    assert [(a, c) for a, _, c in by_start] == [(a, c) for a, _, c in by_rec]


def test_batches_while_the_stream_runs(spark):
    path, out = _folder(spark, "grow"), scratch_path(spark, "out")
    line = lambda i: f"2024-01-01 10:00:00,{i:03d} [INFO]: m{i}\n"
    with open(f"{path}/a.log", "w") as f:
        f.write(line(0) + "more")
    q = (G.stream_growing_log(spark, path).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "ckpt")).start())
    try:
        q.processAllAvailable()
        for i in range(1, 4):
            with open(f"{path}/a.log", "a") as f:
                f.write(f" of {i - 1}\n" + line(i) + "more")
            q.processAllAvailable()
            assert sorted(r.message for r in spark.read.parquet(out).collect()) == [f"m{k}\nmore of {k}" for k in range(i)]
    finally:
        q.stop()


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_ranges_tell_each_record_once(tmp_path, block):
    for seed in range(4):
        data = _some_log(seed, 30)
        file = tmp_path / f"{seed}.log"
        file.write_bytes(data)
        with G.opened(str(file), str(file)) as f:
            whole = list(G.records_in(f, G.LogRange(str(file), 0, 0, len(data), len(data))))
            assert b"".join(b + b"\n" for _, _, b in whole) == data and sum(r for _, r, _ in whole) == 30
            assert all(data[s:s + len(b)] == b for s, _, b in whole)
            for size in (1, 13, 100, 5000):
                parts = [G.LogRange(str(file), 0, lo, min(lo + size, len(data)), len(data)) for lo in range(0, len(data), size)]
                assert [x for p in parts for x in G.records_in(f, p, block)] == whole
            starts = [s for s, r, _ in whole if r]
            for size in range(0, len(data), 97):
                complete = [s for s in starts if G._START.match(data[:size], s)]
                assert G.last_start(f, size, 0, block) == (complete[-1] if complete else None)


def test_rewritten_and_drained_files(spark):
    path, out, ckpt = _folder(spark, "grow"), scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    line = lambda i: f"2024-01-01 10:00:00,{i:03d} [INFO]: m{i}\n"
    with open(f"{path}/a.log", "w") as f:
        f.write("".join(map(line, range(20))))
    _drained(spark, path, out, ckpt, drain=True)
    with open(f"{path}/a.log", "w") as f:
        f.write(line(50))
    _drained(spark, path, out, ckpt, drain=True)
    assert sorted(r.message for r in spark.read.parquet(out).collect()) == sorted([f"m{i}" for i in range(20)] + ["m50"])
    with open(f"{path}/a.log", "a") as f:
        f.write("a line of no record\n")
    with pytest.raises(Exception, match="went on with lines of no record"):
        _drained(spark, path, out, ckpt)


def test_empty_and_hidden_files(spark):
    path, out = _folder(spark, "grow"), scratch_path(spark, "out")
    for name in ("empty.log", "_hidden.log", ".tmp"):
        with open(f"{path}/{name}", "w") as f:
            f.write("" if name == "empty.log" else "2024-01-01 10:00:00,000 [INFO]: m\n")
    _drained(spark, path, out, scratch_path(spark, "ckpt"), drain=True)
    assert spark.read.schema("file string").parquet(out).count() == 0
