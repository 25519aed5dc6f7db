"""Quality counts of each micro-batch, as the batch operators give them."""
import time

from parley.operators import prompts as P
from parley.operators import settings as S
from parley.session import scratch_path
from parley.streaming import quality as Q

SCHEMA = "id long, fields map<string,string>, n string"
BATCHES = [[(1, {"a": "x", "b": None}, "1"), (2, {"a": "x"}, "two"), (3, None, None)],
           [(4, {"a": "", "b": "", "c": ""}, "4x"), (5, {"a": "p", "b": "q"}, " 5 ")]]


def test_counts_of_each_batch(spark):
    src, path, out = (scratch_path(spark, n) for n in ("src", "quality", "out"))
    for rows in BATCHES:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    listener = Q.QualityTable(spark, path)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        checked = Q.observe_prompt_fields(P.prompt_field_check(Q.observe_types(stream, {"n": "int"}), "{a} {b}"))
        q = checked.writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", scratch_path(spark, "ckpt")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        want = {}
        for i, rows in enumerate(BATCHES):
            df = spark.createDataFrame(rows, SCHEMA)
            report = P.prompt_field_report(P.prompt_field_check(df, "{a} {b}")).first().asDict()
            types = S.schema_check(df, {"n": "int"}).first()
            want |= {(i, "prompt_fields", m): v for m, v in report.items()}
            want |= {(i, "types", "n__n"): types["values"], (i, "types", "n__bad"): types["violations"]}
        until, got = time.time() + 60, {}
        while got != want and time.time() < until:  # listeners are told a little later
            time.sleep(0.5)
            try:
                got = {(r.batch, r.name, r.metric): r.value for r in Q.quality_table(spark, path).collect()}
            except Exception:  # noqa: BLE001 - not written yet
                got = {}
        assert got == want
        assert spark.read.parquet(out).count() == 5  # all rows pass on
    finally:
        spark.streams.removeListener(listener)


def test_a_batch_told_twice_counts_once(spark):
    path = scratch_path(spark, "quality")
    for _ in range(2):
        spark.createDataFrame([("q", 0, "types", "n__n", 3)], Q.QUALITY).write.mode("append").parquet(path)
    assert [tuple(r) for r in Q.quality_table(spark, path).collect()] == [("q", 0, "types", "n__n", 3)]
