"""Line dedup with levelled sorted runs of line hashes.

``LineRuns`` holds the keys of all lines seen so far as sorted runs (Parquet
in the shared checkpoint folder, range-partitioned and sorted by hash). A new
batch is reduced to its distinct keys, merge-anti-joined with the runs, and the
keys that no run has become a new run of level 0. Once a level has ``fanout``
runs they are merged into one of the next level, so a key is rewritten only a
logarithmic number of times and a batch meets few runs.

All DataFrame operations: no Python on the executors.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import SPACES, text_or_empty, written
from parley.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped of white space at both ends, A-Z (alone) lower-cased."""
    s = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(h1, h2, doc_id, th, pos)`` of every line whose key is long enough.

    The key's identity is 128 bits of two differently seeded xxHash64; ``th``
    tells apart rows of one id with other texts. A null id counts as the
    largest, and all null ids as one document.
    """
    lines = docs.select(
        F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"),
        F.xxhash64(text_or_empty()).alias("th"),
        F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")) \
        .where(F.char_length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
                       "doc_id", "th", "pos")


class LineRuns:
    """The levelled runs. ``fanout`` runs of a level become one of the next."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: dict[int, list[DataFrame]] = defaultdict(list)

    def _write(self, keys: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "line-run")
        keys.select("h1", "h2").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2") \
            .write.parquet(path)
        return self.spark.read.schema("h1 bigint, h2 bigint").parquet(path)

    def keys(self) -> DataFrame:
        """The keys of all runs; a key is in one run only."""
        runs = [r for level in self.levels.values() for r in level]
        return reduce(DataFrame.unionAll, runs,
                      self.spark.createDataFrame([], "h1 bigint, h2 bigint"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of ``line_hashes`` rows whose ids follow those of all
        earlier batches. Returns the rows to drop: ``doc_id, th, pos``.

        A line goes if its key is in a run, or if a smaller id of the batch
        holds it. The batch's keys are pre-aggregated, so a line that every
        document has is one row here and in the runs; only the keys that
        repeat meet the lines again, in a join that AQE may split.
        """
        firsts = written(lines.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "line-keys")
        if any(self.levels.values()):
            new = written(firsts.join(self.keys().hint("merge"), ["h1", "h2"], "left_anti"), "line-new")
            known = firsts.join(new.select("h1", "h2"), ["h1", "h2"], "left_anti") \
                .select("h1", "h2", F.lit(-1 << 63).alias("first"), F.lit(True).alias("known"))
        else:
            new, known = firsts, None
        repeated = new.where(F.col("first") < F.col("last")).select("h1", "h2", "first", F.lit(False).alias("known"))
        repeated = repeated if known is None else repeated.unionAll(known)
        drops = lines.join(repeated, ["h1", "h2"]) \
            .where(F.col("known") | (F.col("doc_id") > F.col("first"))).select("doc_id", "th", "pos")
        drops = written(drops, "line-drops")
        self.levels[0].append(self._write(new))
        self._compact()
        return drops

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._write(reduce(DataFrame.unionAll, self.levels[level]))
            self.levels[level] = []
            level += 1
            self.levels[level].append(merged)


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids that cut the table into about equal batches (one small aggregate)."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10000)
                    .alias("c")).first()["c"]
    return sorted(set(cuts or []))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """The rows of ``docs`` with ``kept`` (the text without dropped lines; null
    text gives the empty text), ``n_lines`` and ``n_dropped`` appended.

    Null or empty text is one empty line. Repeated rows of an id are one
    document and keep what it keeps. Columns of those three names are replaced.
    An empty table gives no rows. ``batches`` shapes the work, not the result.
    """
    spark = docs.sparkSession
    bounds = batch_bounds(docs, batches)
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("doc_id") > b).cast("int")
    path = scratch_path(spark, "line-hashes")
    line_hashes(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    runs = LineRuns(spark, fanout)
    drops = []
    for i in range(len(bounds) + 1):
        lines = spark.read.schema("h1 bigint, h2 bigint, doc_id bigint, th bigint, pos int, batch int") \
            .parquet(path).where(F.col("batch") == i).drop("batch")
        drops.append(runs.add(lines))
    gone = reduce(DataFrame.unionAll, drops).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("_gone")) \
        .withColumnsRenamed({"doc_id": "_gid", "th": "_gth"})

    out = docs.drop("kept", "n_lines", "n_dropped")
    out = out.withColumns({"_gid0": F.coalesce("doc_id", F.lit((1 << 63) - 1)),
                           "_gth0": F.xxhash64(text_or_empty())})
    out = out.join(gone, (F.col("_gid0") == F.col("_gid")) & (F.col("_gth0") == F.col("_gth")), "left")
    out = out.withColumn("_lines", F.split(text_or_empty(), "\n", -1))
    kept = F.expr("""array_join(transform(
        array_except(sequence(0, size(_lines) - 1), _gone), i -> _lines[i]), '\n')""")
    return out.withColumns({
        "kept": F.when(F.col("_gone").isNull(), text_or_empty()).otherwise(kept),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dropped": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint"),
    }).drop("_lines", "_gone", "_gid", "_gth", "_gid0", "_gth0")
