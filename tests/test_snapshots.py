"""A snapshot in buckets equals the plain upsert, and rewrites little."""
import pytest
from pyspark.sql import functions as F

from parley.operators import settings as S
from parley.operators import snapshots as N
from parley.session import scratch_path

SCHEMA = "owner string, key string, value string"


def _rows(df):
    return sorted((r.owner or "-", r.key, r.value) for r in df.collect())


def _files(spark, path):
    return {f.split("/data/")[1] for f in spark.read.schema("value string").parquet(f"{path}/data").inputFiles()}


def test_few_changes_rewrite_the_touched_buckets_only(spark):
    path = scratch_path(spark, "snapshot")
    first = spark.range(5000).selectExpr("concat('o', id % 50) as owner", "concat('k', id) as key", "concat('v', id) as value", "id as seq")
    assert N.upsert_snapshot(path, first, buckets=32) == 1
    before, (_, at) = _files(spark, path), N.manifest(spark, path)
    # One in a hundred keys, of three buckets: new values, a deletion, new keys.
    some = first.where(N._bucket("owner", "key", 32).isin(3, 17, 30)).limit(50)
    changes = some.withColumn("value", F.when(F.col("seq") % 5 > 0, F.concat(F.lit("new"), "seq"))) \
        .unionAll(some.withColumn("value", F.lit("older")).withColumn("seq", F.col("seq") - 10_000))
    assert N.upsert_snapshot(path, changes) == 2
    _, now = N.manifest(spark, path)
    assert {b for b in now if now[b] != at[b]} == {3, 17, 30}
    written = _files(spark, path) - before
    assert {f.split("/")[1] for f in written} == {"bucket=3", "bucket=17", "bucket=30"}
    want = S.settings_upsert(S.settings_upsert(None, first), changes)
    assert _rows(N.read_snapshot(spark, path, SCHEMA)) == _rows(want)
    assert _rows(N.read_snapshot(spark, path, SCHEMA, version=1)) == _rows(S.settings_upsert(None, first))


def test_a_run_that_dies_leaves_the_snapshot_as_it_was(spark, monkeypatch):
    path = scratch_path(spark, "snapshot")
    df = lambda *rows: spark.createDataFrame(list(rows), SCHEMA + ", seq long")
    N.upsert_snapshot(path, df(("a", "x", "1", 1), (None, "x", "2", 1)), buckets=4)
    # Data of version 2 are written, its manifest is not.
    df(("a", "x", "half", 1)).select("owner", "key", "value", F.lit(0).alias("bucket")) \
        .write.partitionBy("bucket").parquet(f"{path}/data/v=2")
    assert _rows(N.read_snapshot(spark, path, SCHEMA)) == [("-", "x", "2"), ("a", "x", "1")]
    assert N.upsert_snapshot(path, df(("a", "x", None, 2), ("b", "y", "3", 2))) == 2
    assert _rows(N.read_snapshot(spark, path, SCHEMA)) == [("-", "x", "2"), ("b", "y", "3")]
    # All of a bucket may go; nothing to do keeps the version; two writers don't mix.
    assert N.upsert_snapshot(path, df((None, "x", None, 3), ("b", "y", None, 3))) == 3
    assert _rows(N.read_snapshot(spark, path, SCHEMA)) == [] and N.upsert_snapshot(path, spark.createDataFrame([], SCHEMA + ", seq long")) == 3
    monkeypatch.setattr(N, "manifest", lambda *a, **k: (2, {b: 1 for b in range(4)}))
    with pytest.raises(Exception, match="already exists"):
        N.upsert_snapshot(path, df(("c", "z", "4", 1)))


def test_no_snapshot_yet(spark):
    assert N.read_snapshot(spark, scratch_path(spark, "none"), SCHEMA).collect() == []
