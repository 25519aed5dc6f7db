"""O26 kept as files: a snapshot in hash buckets, of which an upsert rewrites
only those that its changes touch.

``data/v=<n>/bucket=<b>`` has bucket b as version n wrote it, and
``manifest/n=<n>`` (one small file, so it is there whole or not at all) says for
each bucket which version holds it. A reader takes the newest manifest and never
sees half of an upsert; data that no manifest names are of a run that died.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.settings import settings_upsert
from parley.session import cut_lineage

BUCKETS = 64


def _bucket(owner: str, key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(owner), F.col(key)), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """The newest version (or the one asked for) and each bucket's version; 0
    and nothing if there is no snapshot yet. As many rows as buckets."""
    try:
        all_ = spark.read.schema("bucket int, version long, n long").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    if version is None:
        version = all_.agg(F.max("n")).first()[0] or 0
    return version, {r["bucket"]: r["version"] for r in all_.where(F.col("n") == version).collect()}


def _read(spark: SparkSession, path: str, schema: str, versions: dict[int, int]) -> DataFrame | None:
    """The given buckets, each from its version's folder."""
    parts = []
    for n in sorted(set(versions.values())):
        mine = [b for b, v in versions.items() if v == n]
        parts.append(spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/data/v={n}").where(F.col("bucket").isin(mine)))
    return reduce(DataFrame.unionAll, parts) if parts else None


def _schema(owner: str, key: str, value: str, df: DataFrame) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (owner, key, value))


def read_snapshot(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The snapshot's rows (``schema`` of owner, key and value), of the newest
    version or the one asked for; none if there is no snapshot."""
    _, versions = manifest(spark, path, version)
    df = _read(spark, path, schema, versions)
    return spark.createDataFrame([], schema) if df is None else df.drop("bucket")


def upsert_snapshot(path: str, changes: DataFrame, *, buckets: int = BUCKETS, owner: str = "owner", key: str = "key",
                    value: str = "value", seq: str = "seq") -> int:
    """Apply ``changes`` (see ``settings_upsert``) to the snapshot at ``path``
    and return its new version; the old one if there are no changes.

    The changes are brought down to one a key first, so a key changed very often
    costs one row; the touched buckets are read, merged and written, the others
    keep their files. ``buckets`` counts for the first upsert, a snapshot keeps
    its number; so many that one of them suits a task. One writer at a time: of
    two, the later one fails at its manifest."""
    spark = changes.sparkSession
    last, versions = manifest(spark, path)
    buckets = len(versions) or buckets
    newest = changes.groupBy(owner, key).agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(seq)).alias("_l")).select(
        owner, key, F.col("_l.v").alias(value), F.lit(1).cast("bigint").alias("_seq"))
    newest = cut_lineage(newest.withColumn("bucket", _bucket(owner, key, buckets)))
    touched = [r["bucket"] for r in newest.select("bucket").distinct().collect()]
    if not touched and versions:
        return last
    schema = _schema(owner, key, value, changes)
    base = _read(spark, path, schema, {b: v for b, v in versions.items() if b in set(touched)})
    merged = settings_upsert(base.drop("bucket") if base is not None else None, newest, owner=owner, key=key, value=value, seq="_seq")
    n = last + 1
    merged.withColumn("bucket", _bucket(owner, key, buckets)).repartition("bucket") \
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={n}")
    now = {b: versions.get(b, n) for b in range(buckets)} | dict.fromkeys(touched, n)
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(v).cast("long").alias("version")) for b, v in now.items()]))
    spark.range(1, numPartitions=1).select(rows.alias("r")).select("r.*").write.mode("error").parquet(f"{path}/manifest/n={n}")
    return n
