"""Streaming O30: model calls on a stream of prompts, each prompt paid for once.

Every micro-batch runs as batch jobs (``foreachBatch``). Answers go to a
journal, keyed by the prompt's digest, slice by slice; prompts that the journal
already answers are not sent. If a batch dies, Spark replays it with the same
rows: what the journal has by then is not paid for again, and the batch's
result is overwritten, so no row is there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.completions import batch_complete
from parley.session import cut_lineage

JOURNAL = "digest string, completion string, error string, attempt long"
#: Prompts sent between two writes of the journal: what a kill can cost.
SLICE_ROWS = 10_000


def prompt_digest(prompt: str = "prompt") -> Column:
    """A NULL prompt is not an empty one."""
    return F.sha2(F.concat(F.when(F.col(prompt).isNull(), "0").otherwise("1"), F.coalesce(F.col(prompt), F.lit(""))), 256)


def journal(spark: SparkSession, path: str) -> DataFrame:
    """All attempts so far; there may be none."""
    spark.createDataFrame([], JOURNAL).write.mode("append").parquet(path)
    return spark.read.schema(JOURNAL).parquet(path)


def answers(attempts: DataFrame) -> DataFrame:
    """``digest, completion, error``: the first answer of each prompt, else its
    last error."""
    one = attempts.groupBy("digest").agg(
        F.min(F.when(F.col("error").isNull(), F.struct("attempt", "completion"))).alias("ok"),
        F.max(F.struct("attempt", "error")).alias("failed"))
    return one.select("digest", F.col("ok.completion").alias("completion"),
                      F.when(F.col("ok").isNull(), F.col("failed.error")).alias("error"))


def complete_batch(batch: DataFrame, number: int, *, journal_path: str, out: str, model: Callable | None = None,
                   native: Callable[[Column], Column] | None = None, prompt: str = "prompt",
                   slice_rows: int = SLICE_ROWS) -> None:
    """Answer one micro-batch and write its rows with ``completion`` and
    ``error`` to ``out/n=<number>``.

    Equal prompts are sent once, whatever batch they are in, and a prompt that
    failed before is sent again. The new prompts are dealt by digest into slices
    of about ``slice_rows``; each is one job over all executors, and its answers
    are in the journal before the next starts. Equal prompts are brought together
    before the shuffle; the answers are joined back by digest, where AQE splits a
    prompt that very many rows have."""
    spark = batch.sparkSession
    rows = cut_lineage(batch.withColumn("_digest", prompt_digest(prompt)))
    asked = rows.groupBy(F.col("_digest").alias("digest")).agg(F.first(prompt).alias("prompt"))
    known = journal(spark, journal_path).where(F.col("error").isNull()).select("digest")
    new = cut_lineage(asked.join(known, "digest", "left_anti"))
    n = new.count()
    slices = -(-n // max(1, slice_rows))
    for k in range(slices):
        part = new.where(F.pmod(F.xxhash64("digest"), F.lit(slices)) == k)
        if model is not None:  # as many tasks as cores, whatever the slice's files
            part = part.repartition(min(spark.sparkContext.defaultParallelism, max(1, slice_rows)))
        done = batch_complete(part, model, native=native).select("digest", "completion", "error",
                                                                 F.lit(number).cast("long").alias("attempt"))
        done.write.mode("append").parquet(journal_path)
    told = answers(journal(spark, journal_path).join(asked.select("digest"), "digest", "left_semi")) \
        .withColumnRenamed("digest", "_digest")
    rows.join(told, "_digest", "left").drop("_digest").write.mode("overwrite").parquet(f"{out.rstrip('/')}/n={number}")


def stream_batch_complete(prompts: DataFrame, *, journal_path: str, out: str, checkpoint: str,
                          model: Callable | None = None, native: Callable[[Column], Column] | None = None,
                          prompt: str = "prompt", slice_rows: int = SLICE_ROWS, trigger: dict | None = None) -> StreamingQuery:
    """Start the stream; see ``complete_batch``. ``model`` and ``native`` are
    those of ``batch_complete``. The journal may be shared by streams and must
    be in a folder that all executors see. The journal's digests are read once a
    batch, its answers for the batch's prompts only."""
    writer = prompts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: complete_batch(batch, number, journal_path=journal_path, out=out, model=model, native=native,
                                             prompt=prompt, slice_rows=slice_rows))
    return (writer.trigger(**trigger) if trigger else writer).start()
